"""Exact interpolated quantiles per group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.ranking import running_totals
from ledgerloom.sources.staging import Staging


def bounded_quantile(value: Column, q: float, weight: Column | None = None) -> Column:
    """Aggregate: exact quantile for a domain known to be small.

    The buffer is one entry per distinct value, so use it only where the number
    of distinct values is bounded (days of a window, shares at six decimals) or
    the group size is checked. The rounding removes the last-bit difference
    between ways of writing the interpolation.
    """
    v = value.cast("double")
    p = F.percentile(v, F.lit(q)) if weight is None else F.percentile(v, F.lit(q), weight)
    return F.round(p, 6)


def spread_quantiles(df: DataFrame, staging: Staging, groups: Sequence[str], value: str,
                     quantiles: Mapping[str, float], partitions: int | None = None, weight: str | None = None) -> DataFrame:
    """Exact quantiles of groups of any size and any number of distinct values; `weight` names a column of row counts.

    Equal values are counted first, so a value held by a third of all rows is
    one row; the counted values are range partitioned and only the one or two
    values around each wanted position survive to the final grouping.
    """
    groups = list(groups)
    counted = (df.filter(F.col(value).isNotNull())
               .groupBy(*groups, value).agg((F.sum(weight) if weight else F.count("*")).alias("_n")))
    ranked = running_totals(counted, staging, groups, [F.col(value).asc()], {"cum": F.col("_n")}, partitions)
    v = F.col(value).cast("double")
    first = F.col("cum") - F.col("_n")          # zero-based position of the first copy
    picks, wanted, outs = [], F.lit(False), []
    for i, q in enumerate(quantiles.values()):
        pos = (F.col("cum_all") - 1) * F.lit(q)
        lo, hi = F.floor(pos), F.ceil(pos)
        at_lo = (first <= lo) & (lo < F.col("cum"))
        at_hi = (first <= hi) & (hi < F.col("cum"))
        wanted = wanted | at_lo | at_hi
        picks += [F.max(F.when(at_lo, v)).alias(f"_lo{i}"), F.max(F.when(at_hi, v)).alias(f"_hi{i}"),
                  F.max(pos - lo).alias(f"_f{i}")]
    for i, name in enumerate(quantiles):
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        outs.append((lo + (hi - lo) * F.col(f"_f{i}")).alias(name))
    return ranked.filter(wanted).groupBy(*groups).agg(*picks).select(*groups, *outs)


def column_medians(df: DataFrame, staging: Staging, columns: Sequence[str],
                   partitions: int | None = None) -> dict[str, float | None]:
    """Exact medians of many columns in one pass; one number per column is collected."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])))
    rows = spread_quantiles(long, staging, ["name"], "value", {"median": 0.5}, partitions).collect()
    found = {r["name"]: r["median"] for r in rows}
    return {c: found.get(c) for c in columns}


def grouped_medians(df: DataFrame, staging: Staging, group: str, columns: Sequence[str],
                    partitions: int | None = None) -> DataFrame:
    """One row per group with the exact median of each column."""
    long = df.select(F.col(group), F.inline(F.array(*[
        F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])))
    tall = spread_quantiles(long, staging, [group, "name"], "value", {"median": 0.5}, partitions)
    return tall.groupBy(group).agg(*[
        F.max(F.when(F.col("name") == c, F.col("median"))).alias(c) for c in columns])
