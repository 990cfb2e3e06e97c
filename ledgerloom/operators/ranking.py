"""Ordered statistics over frames too large for one task.

`Window.orderBy` without a partition pulls every row into one task, and so does
a window over a group that holds most of the rows. Here the rows are range
partitioned on (group, order), so a hot group spreads over as many tasks as it
needs; the sorted frame is staged once with its row positions, and only
per-partition totals are combined across partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.sources.staging import Staging

# monotonically_increasing_id keeps the partition number above 33 bits of position.
_POSITION_BITS = 33


def staged_order(df: DataFrame, staging: Staging, groups: Sequence[str], order: Sequence[Column],
                 partitions: int | None = None) -> DataFrame:
    """The frame sorted across partitions, with `_part` and `_seq` written down."""
    keys = [F.col(g).asc_nulls_first() for g in groups] + list(order)
    spread = (df.repartitionByRange(partitions, *keys) if partitions
              else df.repartitionByRange(*keys))
    numbered = spread.sortWithinPartitions(*keys).withColumn("_pos", F.monotonically_increasing_id())
    stored = staging.write(numbered, "ordered")
    return stored.select(
        "*",
        F.shiftright(F.col("_pos"), _POSITION_BITS).alias("_part"),
        F.col("_pos").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)).alias("_seq"),
    ).drop("_pos")


def running_totals(df: DataFrame, staging: Staging, groups: Sequence[str], order: Sequence[Column],
                   weights: Mapping[str, Column], partitions: int | None = None) -> DataFrame:
    """Adds, per weight w, `w` = running total within the group and `w_all` = group total.

    (group, order) should be unique per row: pre-aggregate equal values first,
    so that a value held by very many rows is one row here.
    """
    groups = list(groups)
    weighed = df.select("*", *[w.alias(f"_w_{n}") for n, w in weights.items()])
    rows = staged_order(weighed, staging, groups, order, partitions)

    # One row per (partition, group): at most #groups + #partitions rows.
    parts = rows.groupBy("_part", *groups).agg(
        *[F.sum(f"_w_{n}").alias(f"_p_{n}") for n in weights])
    across = Window.partitionBy(*groups).orderBy("_part")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    offsets = parts.select(
        "_part", *[F.col(g).alias(f"_g_{g}") for g in groups],
        *[F.coalesce(F.sum(f"_p_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in weights],
        *[F.sum(f"_p_{n}").over(whole).alias(f"{n}_all") for n in weights],
    ).withColumnRenamed("_part", "_at")

    inside = (Window.partitionBy("_part", *groups).orderBy("_seq")
              .rowsBetween(Window.unboundedPreceding, 0))
    local = rows.select("*", *[F.sum(f"_w_{n}").over(inside).alias(f"_l_{n}") for n in weights])
    match = F.col("_part") == F.col("_at")
    for g in groups:
        match = match & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return local.join(offsets, match).select(
        *df.columns,
        *[(F.col(f"_o_{n}") + F.col(f"_l_{n}")).alias(n) for n in weights],
        *[F.col(f"{n}_all") for n in weights],
    )


def with_rank(df: DataFrame, staging: Staging, groups: Sequence[str], order: Sequence[Column],
              partitions: int | None = None) -> DataFrame:
    """1-based row number within the group as `rn`, group size as `rn_all`.

    The rows of a group are next to each other in the staged order, so a rank is the row's position less that of the
    group's first row in the partition, plus the group's rows in the partitions before: no further sort of the rows.
    """
    groups = list(groups)
    rows = staged_order(df, staging, groups, order, partitions)
    parts = rows.groupBy("_part", *groups).agg(F.count("*").alias("_n"), F.min("_seq").alias("_first"))
    across = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        F.col("_part").alias("_at"), *[F.col(g).alias(f"_g_{g}") for g in groups],
        (F.coalesce(F.sum("_n").over(across), F.lit(0)) - F.col("_first") + 1).alias("_o"),
        F.sum("_n").over(Window.partitionBy(*groups)).alias("rn_all"))
    match = F.col("_part") == F.col("_at")
    for g in groups:
        match = match & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return rows.join(offsets, match).select(*df.columns, (F.col("_seq") + F.col("_o")).alias("rn"), "rn_all")


@dataclass(frozen=True)
class Tile:
    """A bucketing request: NTILE(buckets) over (key nulls last, id)."""

    key: str
    buckets: int


def tile_of(rank: Column, n: Column, k: int) -> Column:
    """Bucket of a 1-based rank: the first n mod k buckets hold one row more."""
    q = F.floor(n / k)
    r = n % k
    big = r * (q + 1)
    return F.when(rank <= big, F.floor((rank - 1) / (q + 1)) + 1).otherwise(
        r + F.floor((rank - 1 - big) / F.nullif(q, F.lit(0))) + 1)


def assign_tiles(df: DataFrame, staging: Staging, id_col: str, tiles: Mapping[str, Tile],
                 partitions: int | None = None) -> DataFrame:
    """NTILE columns without a global window.

    All requested orderings are ranked in one range-partitioned pass over
    (ordering, key, id). Only the last row of each bucket is needed to place
    every other row, so at most sum(buckets) boundary rows reach the driver and
    the bucket becomes a per-row comparison: no join back, no shuffle of `df`.
    """
    names = list(tiles)
    long = df.select(F.col(id_col).alias("_id"), F.inline(F.array(*[
        F.struct(F.lit(i).alias("_which"), as_number(df, tiles[n].key).cast("double").alias("_key"))
        for i, n in enumerate(names)])))
    ranked = with_rank(long, staging, ["_which"],
                       [F.col("_key").asc_nulls_last(), F.col("_id").asc_nulls_last()], partitions)
    tile = F.lit(None).cast("bigint")
    last = F.lit(False)
    for i, n in enumerate(names):
        k = tiles[n].buckets
        here = F.col("_which") == i
        tile = F.when(here, tile_of(F.col("rn"), F.col("rn_all"), k)).otherwise(tile)
        next_tile = tile_of(F.col("rn") + 1, F.col("rn_all"), k)
        ends = (F.col("rn") < F.col("rn_all")) & (next_tile != tile_of(F.col("rn"), F.col("rn_all"), k))
        last = F.when(here, ends).otherwise(last)
    edges = (ranked.select("_which", "_key", "_id", tile.alias("_tile"), last.alias("_last"))
             .filter("_last").orderBy("_which", "_tile").collect())

    scored = []
    for i, n in enumerate(names):
        key = as_number(df, tiles[n].key).cast("double")
        bucket = F.lit(1)
        for e in [e for e in edges if e["_which"] == i]:
            bucket = bucket + F.when(_after(key, F.col(id_col), e["_key"], e["_id"]), 1).otherwise(0)
        scored.append(bucket.cast("bigint").alias(n))
    return df.select("*", *scored)


def as_number(df: DataFrame, name: str) -> Column:
    """Dates become day numbers so every ordering shares one key type."""
    return F.unix_date(F.col(name)) if dict(df.dtypes)[name] == "date" else F.col(name)


def _after(key: Column, ident: Column, edge_key, edge_id) -> Column:
    """Strictly after the edge row in (key nulls last, id) order."""
    if edge_key is None:
        return key.isNull() & (ident > F.lit(edge_id))
    edge = F.lit(edge_key)
    return key.isNull() | (key > edge) | ((key == edge) & (ident > F.lit(edge_id)))
