"""Exponentially weighted trailing values along a merchant's calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.exact import paise, ratio


def trailing_rate(dense: DataFrame, value: str, newest: float, name: str) -> DataFrame:
    """name = (1 - newest) * previous + newest * value, carried over a missing month.

    The fold runs over one array per merchant, at most one entry per calendar
    month, and starts from the first observed value.
    """
    state = f"struct<now:double,path:array<struct<month:date,{name}:double>>>"
    months = F.sort_array(F.collect_list(F.struct("month", F.col(value).cast("double").alias("v"))))

    def step(acc, row):
        blended = F.lit(1 - newest) * acc["now"] + F.lit(newest) * row["v"]
        now = F.coalesce(F.when(acc["now"].isNull(), row["v"]).otherwise(blended), acc["now"])
        entry = F.struct(row["month"].alias("month"), now.alias(name))
        return F.struct(now.alias("now"), F.array_append(acc["path"], entry).alias("path")).cast(state)

    start = F.from_json(F.lit('{"path": []}'), state)
    folded = dense.groupBy("merchant_id").agg(months.alias("_m")).select(
        "merchant_id", F.aggregate("_m", start, step, lambda s: s["path"]).alias("_p"))
    return folded.select("merchant_id", F.inline("_p"))


def share_of_total(df: DataFrame, group: str, value: str, name: str, digits: int = 6) -> DataFrame:
    """Each group's part of the grand total; the total is one broadcast row."""
    per = df.groupBy(group).agg(F.sum(paise(F.col(value))).alias("_v"))
    total = per.agg(F.sum("_v").alias("_t"))
    return per.crossJoin(F.broadcast(total)).select(
        group, ratio(F.col("_v"), F.col("_t"), digits).alias(name))
