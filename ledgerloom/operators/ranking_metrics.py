"""Quality of a probability score against 0/1 outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.exact import ratio
from ledgerloom.operators.quantiles import spread_quantiles
from ledgerloom.operators.ranking import running_totals
from ledgerloom.sources.staging import Staging

WIDE = "decimal(38,0)"


def score_counts(df: DataFrame, score: str, label: str) -> DataFrame:
    """Positives and negatives per distinct score."""
    y = F.col(label).cast("bigint")
    return df.groupBy(F.col(score).alias("score")).agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))


def ranking_metrics(df: DataFrame, staging: Staging, score: str, label: str) -> DataFrame:
    """One row: rows, positives, ROC-AUC, average precision and Brier score.

    Ties share a rank. Scores are counted first and ordered by range, so the
    prefix sums never need all scores in one task.
    """
    counts = score_counts(df, score, label)
    sums = running_totals(counts, staging, [], [F.col("score").asc()],
                          {"pos_to": F.col("pos"), "neg_to": F.col("neg")})
    # pairs won, counted twice so that a tied pair is one half
    won = F.sum((F.col("pos") * (F.lit(2) * (F.col("neg_to") - F.col("neg")) + F.col("neg"))).cast(WIDE))
    tp = F.col("pos_to_all") - F.col("pos_to") + F.col("pos")
    fp = F.col("neg_to_all") - F.col("neg_to") + F.col("neg")
    hit = F.col("pos").cast("decimal(18,0)") * tp.cast("decimal(18,0)") / (tp + fp).cast("decimal(18,0)")
    p, n = F.max("pos_to_all"), F.max("neg_to_all")
    pairs = (F.lit(2) * p * n).cast(WIDE)
    y = F.col("pos") + F.col("neg")
    miss = F.round(F.pow(F.col("score") - 1, 2), 12).cast("decimal(24,12)") * F.col("pos") + \
        F.round(F.pow(F.col("score"), 2), 12).cast("decimal(24,12)") * F.col("neg")
    return sums.agg(
        F.sum(y).alias("n"), p.alias("positives"),
        F.round(won / F.nullif(pairs, F.lit(0).cast(WIDE)), 6).cast("double").alias("roc_auc"),
        F.round(F.sum(hit) / F.nullif(p.cast("decimal(18,0)"), F.lit(0).cast("decimal(18,0)")), 6)
        .cast("double").alias("average_precision"),
        F.round(F.sum(miss) / F.sum(y).cast("decimal(18,0)"), 6).cast("double").alias("brier"),
    )


def quantile_edges(df: DataFrame, staging: Staging, score: str, bins: int) -> list[float]:
    """Distinct quantile edges, outermost included."""
    wanted = {f"e{i}": i / bins for i in range(bins + 1)}
    row = spread_quantiles(df, staging, [], score, wanted).first()
    return sorted({row[k] for k in wanted if row[k] is not None})


def quantile_bins(df: DataFrame, staging: Staging, score: str, bins: int, name: str = "decile") -> DataFrame:
    """Right-closed quantile bins counted from 1; duplicate edges merge bins."""
    edges = quantile_edges(df, staging, score, bins)
    bucket = F.lit(1)
    for e in edges[1:-1]:
        bucket = bucket + F.when(F.col(score) > F.lit(e), 1).otherwise(0)
    return df.withColumn(name, bucket.cast("bigint"))


def decile_lift(df: DataFrame, staging: Staging, score: str, label: str, bins: int = 10) -> DataFrame:
    """Outcome rate per score decile and its lift over the base rate."""
    binned = quantile_bins(df.select(score, label), staging, score, bins)
    per = binned.groupBy("decile").agg(
        F.count("*").alias("merchants"), F.sum(F.col(label).cast("bigint")).alias("_pos"))
    # one row per decile from here on
    total = per.agg(F.sum("merchants").alias("_n"), F.sum("_pos").alias("_p"))
    rows = per.crossJoin(F.broadcast(total))
    return rows.select(
        "decile", "merchants", ratio(F.col("_pos"), F.col("merchants"), 4).alias("churn_rate"),
        ratio(F.col("_pos") * F.col("_n"), F.col("merchants") * F.col("_p"), 2).alias("lift_vs_base"))
