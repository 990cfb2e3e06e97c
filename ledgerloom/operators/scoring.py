"""Yes/no rules scored as classifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.exact import ratio

MEASURES = ["tp", "fp", "fn", "tn", "flagged", "precision", "recall", "f1"]


def confusion(df: DataFrame, groups: Sequence[str], predicted: Column, actual: Column,
              weight: Column | None = None, extra: Sequence[Column] = ()) -> DataFrame:
    """Confusion counts, precision, recall and F1 per group; an undefined rate reads 0.

    An unknown prediction counts as "not flagged".
    """
    p, a = F.coalesce(predicted, F.lit(False)), F.coalesce(actual, F.lit(False))
    n = F.lit(1).cast("bigint") if weight is None else weight
    none = F.lit(0).cast("bigint")

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, n).otherwise(none)), none)

    counts = df.groupBy(*groups).agg(
        total(p & a).alias("tp"), total(p & ~a).alias("fp"),
        total(~p & a).alias("fn"), total(~p & ~a).alias("tn"), *extra)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "*", (tp + fp).alias("flagged"),
        F.coalesce(ratio(tp, tp + fp, 4), F.lit(0.0)).alias("precision"),
        F.coalesce(ratio(tp, tp + fn, 4), F.lit(0.0)).alias("recall"),
        F.coalesce(ratio(tp * 2, tp * 2 + fp + fn, 4), F.lit(0.0)).alias("f1"),
    )


def best_by(df: DataFrame, measure: str, setting: str) -> DataFrame:
    """The row with the highest measure; the smaller setting wins a tie."""
    return df.orderBy(F.col(measure).desc(), F.col(setting).asc()).limit(1)
