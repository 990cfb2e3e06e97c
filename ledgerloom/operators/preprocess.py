"""Preparing model inputs: imputation, scaling, indicators, splits, samples."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.quantiles import column_medians
from ledgerloom.operators.ranking import with_rank
from ledgerloom.sources.staging import Staging


def as_double(name: str) -> Column:
    """Numeric reading of a column; text that is not a number becomes NULL."""
    return F.col(name).try_cast("double")


def median_imputed(df: DataFrame, staging: Staging, columns: Sequence[str]) -> DataFrame:
    """Columns as doubles with NULL replaced by the exact column median."""
    numeric = df.select(*[c for c in df.columns if c not in columns],
                        *[as_double(c).alias(c) for c in columns])
    medians = column_medians(numeric, staging, columns)
    return numeric.select(*[
        F.coalesce(F.col(c), F.lit(medians[c])).alias(c) if c in columns else F.col(c)
        for c in df.columns])


def scales(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column in one pass; a constant column scales by 1."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns],
                 *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}


def standardised(df: DataFrame, scale: Mapping[str, tuple[float, float]], prefix: str = "") -> list[Column]:
    return [((F.col(c) - F.lit(m)) / F.lit(s)).alias(f"{prefix}{c}") for c, (m, s) in scale.items()]


def level_index(df: DataFrame, staging: Staging, columns: Sequence[str]) -> DataFrame:
    """(name, level, at): the place, from 0, of every level but the first of its column, in text order.

    However many levels there are, they stay a table: distinct ones are ranked by range, and nothing is collected.
    """
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("level")) for c in columns])))
    ranked = with_rank(long.filter(F.col("level").isNotNull()).distinct(), staging, ["name"], [F.col("level").asc()])
    return staging.write(ranked.filter("rn > 1").select("name", "level", (F.col("rn") - 2).cast("int").alias("at")), "level_index")


def category_levels(index: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """The levels of an index by column: names of features, as many as the weights of a model over them."""
    rows = index.orderBy("name", "at").collect()
    return {c: [r["level"] for r in rows if r["name"] == c] for c in columns}


def one_hot(df: DataFrame, train: DataFrame, index: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    """Adds the indicators of all columns as one sparse vector; a first, unknown or missing level is all zeros.
    Without any level beyond the first of each column there is nothing to add.

    Every column is looked up in its part of the index, which is broadcast only where Spark finds it small enough.
    """
    sizes = {r["name"]: r["n"] for r in index.groupBy("name").agg(F.count("*").alias("n")).collect()}
    used = [c for c in columns if c in sizes]

    def placed(rows: DataFrame) -> DataFrame:
        for c in used:
            levels = index.filter(F.col("name") == c).select(F.col("level").alias(f"_l_{c}"), F.col("at").alias(f"_a_{c}"))
            # The place after the last one is the one that the encoder leaves out.
            rows = rows.join(levels, F.col(c).cast("string") == F.col(f"_l_{c}"), "left").drop(f"_l_{c}").withColumn(
                f"_a_{c}", F.coalesce(f"_a_{c}", F.lit(sizes[c])).cast("double"))
        return rows

    if not used:
        return df
    encoder = OneHotEncoder(inputCols=[f"_a_{c}" for c in used], outputCols=[f"_v_{c}" for c in used], dropLast=True)
    coded = encoder.fit(placed(train.select(*used))).transform(placed(df))
    return VectorAssembler(inputCols=[f"_v_{c}" for c in used], outputCol=out).transform(coded).drop(
        *[f"_{kind}_{c}" for c in used for kind in "av"])


def indicators(levels: Mapping[str, list[str]], prefix: str = "") -> list[Column]:
    """0/1 columns for the levels of an index; an unknown level is all zeros."""
    return [F.when(F.col(c) == v, 1.0).otherwise(0.0).alias(f"{prefix}{c}_{v}")
            for c, vs in levels.items() for v in vs]


def shuffle_key(ident: Column, seed: int) -> Column:
    """A portable pseudo-random order."""
    return F.md5(F.concat_ws(":", ident.cast("string"), F.lit(str(seed))))


def stratified_split(df: DataFrame, staging: Staging, ident: str, label: str, share: float,
                     seed: int, partitions: int | None = None) -> DataFrame:
    """Adds `is_test`: the first `share` of each class in a seeded order.

    One boundary row per class is collected; every other row is placed by
    comparison, so a class holding nearly all rows is never one task.
    """
    slim = df.select(F.col(label).alias("_y"), F.col(ident).alias("_id"),
                     shuffle_key(F.col(ident), seed).alias("_h"))
    ranked = with_rank(slim, staging, ["_y"], [F.col("_h"), F.col("_id")], partitions)
    wanted = F.floor(F.lit(share) * F.col("rn_all") + 0.5)
    edges = ranked.filter(F.col("rn") == wanted).select("_y", "_h", "_id").collect()
    h = shuffle_key(F.col(ident), seed)
    test = F.lit(False)
    for e in edges:
        inside = (h < F.lit(e["_h"])) | ((h == F.lit(e["_h"])) & (F.col(ident) <= F.lit(e["_id"])))
        test = test | (F.col(label).eqNullSafe(F.lit(e["_y"])) & inside)
    return df.withColumn("is_test", test)


def hash_sample(df: DataFrame, ident: str, n: int, seed: int) -> DataFrame:
    """A repeatable sample without replacement: the first n rows in a seeded order."""
    return df.orderBy(shuffle_key(F.col(ident), seed), F.col(ident)).limit(n)


def log_scaled(name: str) -> Column:
    return F.log1p(F.greatest(F.col(name), F.lit(0.0))).alias(name)


def finite(x: float | None) -> float | None:
    return None if x is None or math.isnan(x) or math.isinf(x) else float(x)
