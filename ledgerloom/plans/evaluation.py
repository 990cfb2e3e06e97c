"""Churn rules scored against what merchants did next.

A status is computed as of a day T, using nothing after T; the outcome is
whether the merchant ever succeeded again after T.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.exact import ratio, tally
from ledgerloom.operators.quantiles import bounded_quantile
from ledgerloom.operators.scoring import MEASURES, best_by, confusion
from ledgerloom.params import Params
from ledgerloom.plans.churn import adaptive_rule, merchant_churn_status


def asof_status(merchants: DataFrame, days: DataFrame, gaps: DataFrame, observed: dt.date,
                params: Params) -> DataFrame:
    """Status at T = observed - outcome_days beside the later outcome."""
    asof = observed - dt.timedelta(days=params.outcome_days)
    past = F.col("txn_date") <= F.lit(asof)
    status = merchant_churn_status(merchants, days.filter(past), gaps.filter(past), asof, params)
    back = days.filter(~past & (F.col("successful_txns") > 0)).select("merchant_id").distinct().withColumn(
        "returned", F.lit(True))
    silent = F.coalesce(F.col("days_since_last_success") >= params.at_risk_days, F.lit(False))
    returned = F.coalesce("returned", F.lit(False))
    return status.join(back, "merchant_id", "left").select(
        *status.columns, (~returned).alias("actual"), (silent & returned).alias("dormant"))


def lifecycle_status(status: DataFrame, lifecycle: DataFrame) -> DataFrame:
    """The same frame from a table of known outcomes instead of later behaviour."""
    known = lifecycle.select(
        "merchant_id", (F.col("true_churn_month_index") >= 0).alias("actual"),
        F.col("dormant_at_end").alias("dormant"))
    return status.join(known, "merchant_id")


def rule_score(scored: DataFrame) -> DataFrame:
    """The three named rules side by side."""
    counts = scored.groupBy("churn_d1_naive", "churn_d2_adaptive", "churn_d3_value_decay", "actual").agg(
        F.count("*").alias("n"))
    rules = F.inline(F.array(*[
        F.struct(F.lit(name).alias("rule"), (F.col(col) == 1).alias("hit"))
        for name, col in [("adaptive", "churn_d2_adaptive"), ("naive", "churn_d1_naive"),
                          ("value_decay", "churn_d3_value_decay")]]))
    return confusion(counts.select("n", "actual", rules), ["rule"], F.col("hit"), F.col("actual"), F.col("n"))


def fixed_window_sweep(scored: DataFrame, params: Params) -> DataFrame:
    """Every silence window in one job.

    Merchants are first counted by (silence, outcome): the grid multiplies that
    small histogram, never the merchants.
    """
    lo, hi, step = params.fixed_windows
    counts = scored.groupBy(F.col("days_since_last_success").alias("silence"), "actual").agg(
        F.count("*").alias("n"))
    grid = F.explode(F.sequence(F.lit(lo), F.lit(hi), F.lit(step)))
    rows = counts.select("*", grid.alias("window_days"))
    return confusion(rows, ["window_days"], F.col("silence") >= F.col("window_days"),
                     F.col("actual"), F.col("n"))


def multipliers(params: Params) -> list[float]:
    lo, hi, step = params.multiplier_grid
    return [round(lo + i * step, 6) for i in range(int(round((hi - lo) / step)) + 1)]


def adaptive_sweep(scored: DataFrame, params: Params) -> DataFrame:
    """Every multiplier of the merchant's own rhythm, in one job."""
    counts = scored.groupBy(
        F.col("days_since_last_success").alias("silence"), "actual",
        F.coalesce("p90_gap_days", F.lit(params.default_p90_gap)).alias("p90"),
        F.least(F.coalesce("baseline_gap_count", F.lit(0)), F.lit(params.min_baseline_gaps)).alias("gaps"),
    ).agg(F.count("*").alias("n"))
    grid = F.explode(F.array(*[F.lit(m) for m in multipliers(params)]))
    rows = counts.select("*", grid.alias("multiplier"))
    hit = adaptive_rule(F.col("silence"), F.col("gaps"), F.col("p90"), F.col("multiplier"), params) == 1
    # p90 gaps are tenths of days, so the thresholds take few distinct values.
    threshold = F.greatest(F.lit(float(params.adaptive_floor_days)), F.col("multiplier") * F.col("p90"))
    middle = bounded_quantile(threshold, 0.5, F.col("n")).alias("median_threshold_days")
    return confusion(rows, ["multiplier"], hit, F.col("actual"), F.col("n"), [middle]).select(
        "multiplier", "median_threshold_days", *MEASURES)


def best_rules(fixed: DataFrame, adaptive: DataFrame, params: Params) -> DataFrame:
    def row(df: DataFrame, rule: str, setting: str) -> DataFrame:
        return df.select(F.lit(rule).alias("rule"), F.col(setting).cast("double").alias("setting"), *MEASURES)

    return (
        row(fixed.filter(F.col("window_days") == params.at_risk_days), "conventional", "window_days")
        .unionByName(row(best_by(fixed, "f1", "window_days"), "best_fixed", "window_days"))
        .unionByName(row(best_by(adaptive, "f1", "multiplier"), "best_adaptive", "multiplier"))
    )


def two_tier_point(scored: DataFrame, fixed: DataFrame, params: Params) -> DataFrame:
    """At risk at the short window; confirmed at the smallest window precise enough.

    When no window reaches the target precision the most precise one is used.
    """
    precise = F.col("precision") >= params.confirm_precision
    rank = F.struct(F.col("precision"), -F.col("window_days"))
    window = fixed.agg(F.coalesce(
        F.min(F.when(precise, F.col("window_days"))), F.max_by("window_days", rank)).alias("window_days"))
    confirmed = fixed.join(F.broadcast(window), "window_days", "left_semi")
    counts = scored.groupBy(F.col("days_since_last_success").alias("silence"), "actual").agg(
        F.count("*").alias("n"))
    early = confusion(counts.withColumn("window_days", F.lit(params.at_risk_days)), ["window_days"],
                      F.col("silence") >= params.at_risk_days, F.col("actual"), F.col("n"))
    return (early.select(F.lit("at_risk").alias("tier"), "window_days", *MEASURES)
            .unionByName(confirmed.select(F.lit("confirmed").alias("tier"), "window_days", *MEASURES)))


def _false_positive(params: Params) -> Column:
    silent = F.coalesce(F.col("days_since_last_success") >= params.at_risk_days, F.lit(False))
    return silent & ~F.col("actual")


def false_positive_profile(scored: DataFrame, params: Params) -> DataFrame:
    """How many of the wrongly flagged are dormant, and how slow their rhythm is."""
    fp = _false_positive(params)
    dormant = tally(fp & F.col("dormant"))
    p90 = F.col("p90_gap_days")
    return scored.agg(
        tally(fp).alias("false_positives"),
        dormant.alias("of_which_dormant"),
        F.coalesce(ratio(dormant, tally(fp), 4), F.lit(0.0)).alias("share_dormant"),
        bounded_quantile(F.when(fp, p90), 0.5).alias("median_p90_gap_fp"),
        bounded_quantile(p90, 0.5).alias("median_p90_gap_population"),
    )


def false_positive_rate_by(scored: DataFrame, column: str, params: Params) -> DataFrame:
    fp = tally(_false_positive(params))
    return scored.groupBy(column).agg(
        F.count("*").alias("merchants"), ratio(fp, F.count("*"), 4).alias("fp_rate"))


def evaluation_summary(scored: DataFrame, fixed: DataFrame) -> DataFrame:
    ceiling = fixed.agg(F.max("precision").alias("precision_ceiling"))
    n = F.count("*")
    return scored.agg(
        n.alias("merchants_scored"), ratio(tally(F.col("actual")), n, 4).alias("true_churn_rate"),
    ).crossJoin(F.broadcast(ceiling))


def rule_comparison(rules: DataFrame, tiers: DataFrame) -> DataFrame:
    confirmed = tiers.filter(F.col("tier") == "confirmed").select(
        F.lit("confirmed").alias("rule"), "precision", "recall", "f1")
    return rules.select("rule", "precision", "recall", "f1").unionByName(confirmed)
