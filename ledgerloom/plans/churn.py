"""Activity rhythm and three competing churn rules."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.calendar import month_of
from ledgerloom.functions.exact import flag, mean_of_ints, paise, ratio, rupees, tally
from ledgerloom.operators.quantiles import bounded_quantile
from ledgerloom.params import Params


def analysis_window(days: DataFrame) -> DataFrame:
    span = days.agg(F.min("txn_date").alias("first_date"), F.max("txn_date").alias("observation_date"))
    return span.withColumn("observation_month", month_of(F.col("observation_date")))


def merchant_activity_gaps(days: DataFrame) -> DataFrame:
    """Days between consecutive days with a success."""
    active = days.filter(F.col("successful_txns") > 0).select("merchant_id", "txn_date").distinct()
    by_day = Window.partitionBy("merchant_id").orderBy("txn_date")
    gap = F.datediff("txn_date", F.lag("txn_date").over(by_day)).cast("bigint")
    return active.withColumn("gap_days", gap).filter(F.col("gap_days").isNotNull())


def gap_baseline(gaps: DataFrame, observed: dt.date, params: Params) -> DataFrame:
    """A merchant's rhythm from gaps that closed before the at-risk window opened.

    Distinct gaps are bounded by the days of history, so the quantile buffer is.
    """
    opened = observed - dt.timedelta(days=params.at_risk_days)
    gap = F.col("gap_days")
    return gaps.filter(F.col("txn_date") < F.lit(opened)).groupBy("merchant_id").agg(
        F.count("*").alias("baseline_gap_count"),
        mean_of_ints(gap, 3).alias("mean_gap_days"),
        bounded_quantile(gap, 0.9).alias("p90_gap_days"),
        bounded_quantile(gap, 0.5).alias("p50_gap_days"),
    )


def _seen_columns() -> list[Column]:
    return [
        F.max(F.when(F.col("successful_txns") > 0, F.col("txn_date"))).alias("last_success_date"),
        F.max("txn_date").alias("last_attempt_date"),
        F.min("txn_date").alias("first_txn_date"),
        F.count_distinct(month_of(F.col("txn_date"))).alias("months_with_activity"),
    ]


def _value_columns(observed: dt.date, params: Params) -> list[Column]:
    recent = F.col("txn_date") > F.lit(observed - dt.timedelta(days=params.at_risk_days))
    earlier = (~recent) & (F.col("txn_date") > F.lit(
        observed - dt.timedelta(days=params.at_risk_days + params.prior_window_days)))
    none = F.lit(0).cast("bigint")
    return [
        rupees(F.sum(F.when(recent, F.col("tpv_paise")))).alias("tpv_30d"),
        rupees(F.sum(F.when(earlier, F.col("tpv_paise")))).alias("tpv_prior_90d"),
        F.sum(F.when(recent, F.col("attempted_txns")).otherwise(none)).alias("attempts_30d"),
        F.sum(F.when(recent, F.col("successful_txns")).otherwise(none)).alias("successes_30d"),
    ]


def last_seen(days: DataFrame) -> DataFrame:
    return days.groupBy("merchant_id").agg(*_seen_columns())


def recent_value(days: DataFrame, observed: dt.date, params: Params) -> DataFrame:
    """Last-30-day value beside the 90 days before it."""
    return days.groupBy("merchant_id").agg(*_value_columns(observed, params))


def adaptive_rule(silence: Column, gaps: Column, p90: Column, multiplier: float | Column,
                  params: Params) -> Column:
    """Silent for longer than a multiple of the merchant's own p90 gap.

    Merchants with too little history fall back to the fixed window.
    """
    factor = multiplier if isinstance(multiplier, Column) else F.lit(multiplier)
    own = F.greatest(F.lit(float(params.adaptive_floor_days)), factor * p90)
    thin = F.coalesce(gaps, F.lit(0)) < params.min_baseline_gaps
    return F.when(thin, flag(silence >= params.at_risk_days)).otherwise(flag(silence > own))


def merchant_churn_status(merchants: DataFrame, days: DataFrame, gaps: DataFrame,
                          observed: dt.date, params: Params) -> DataFrame:
    """One row per merchant that ever attempted a payment, with all three flags."""
    seen = days.groupBy("merchant_id").agg(*_seen_columns(), *_value_columns(observed, params))
    rows = (seen.join(gap_baseline(gaps, observed, params), "merchant_id", "left")
            .join(merchants.select("merchant_id", "category", "city_tier", "acquisition_channel",
                                   "device_type", "state"), "merchant_id"))
    silence = F.col("days_since_last_success")
    p90 = F.col("p90_gap_days")
    now = F.coalesce("tpv_30d", F.lit(0.0))
    prior = F.coalesce("tpv_prior_90d", F.lit(0.0))
    # now / (prior / 3) written as 3 * now / prior keeps the ratio exact.
    scaled_now, scaled_prior = paise(now) * params.prior_window_days, paise(prior) * params.at_risk_days
    decayed = scaled_now.cast("double") < scaled_prior.cast("double") * params.decay_ratio
    shown = F.round(F.lit(params.adaptive_multiplier) * F.coalesce(p90, F.lit(params.default_p90_gap)), 1)
    flagged = rows.withColumn(
        "days_since_last_success",
        F.datediff(F.lit(observed), F.col("last_success_date")).cast("bigint"),
    ).withColumn(
        "churn_d2_adaptive",
        adaptive_rule(silence, F.col("baseline_gap_count"), p90, params.adaptive_multiplier, params))
    return flagged.select(
        "merchant_id", "category", "city_tier", "acquisition_channel", "device_type", "state",
        F.lit(observed).alias("observation_date"), "first_txn_date", "last_success_date",
        "months_with_activity", "days_since_last_success",
        "baseline_gap_count", "p50_gap_days", "p90_gap_days",
        F.greatest(F.lit(float(params.adaptive_floor_days)), shown).alias("adaptive_threshold_days"),
        now.alias("tpv_30d"), prior.alias("tpv_prior_90d"),
        F.when(prior > 0, ratio(scaled_now, scaled_prior, 4)).alias("tpv_run_rate_ratio"),
        flag(silence >= params.at_risk_days).alias("churn_d1_naive"),
        "churn_d2_adaptive",
        flag((F.col("churn_d2_adaptive") == 1) | ((prior > 0) & decayed))
        .alias("churn_d3_value_decay"),
    )


def churn_definition_comparison(status: DataFrame) -> DataFrame:
    d1, d2, d3 = (F.col(c) for c in ("churn_d1_naive", "churn_d2_adaptive", "churn_d3_value_decay"))
    n = F.count("*")
    return status.agg(
        n.alias("merchants_scored"),
        F.sum(d1).alias("d1_flagged"), F.sum(d2).alias("d2_flagged"), F.sum(d3).alias("d3_flagged"),
        ratio(F.sum(d1), n, 4).alias("d1_rate"),
        ratio(F.sum(d2), n, 4).alias("d2_rate"),
        ratio(F.sum(d3), n, 4).alias("d3_rate"),
        tally((d1 == 1) & (d2 == 0)).alias("d1_only"),
        tally((d2 == 1) & (d1 == 0)).alias("d2_only"),
        tally((d3 == 1) & (d2 == 0)).alias("d3_incremental"),
        tally(F.col("last_success_date").isNull()).alias("never_succeeded"),
    )
