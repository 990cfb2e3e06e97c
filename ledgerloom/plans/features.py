"""Leak-free merchant features, RFM scores and exposure deciles."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.calendar import month_index
from ledgerloom.functions.exact import (
    double_or_null, fine_mean, flag, mean_of_ints, mean_paise, paise, ratio, rupees, tally)
from ledgerloom.operators.quantiles import bounded_quantile
from ledgerloom.operators.ranking import Tile, assign_tiles
from ledgerloom.params import Params
from ledgerloom.sources.staging import Staging

NEVER = dt.date(1900, 1, 1)


@dataclass(frozen=True)
class Split:
    """Feature months lie before label_start; the label looks at what follows."""

    window_start: dt.date
    label_start: dt.date
    window_end: dt.date
    observation_date: dt.date


def feature_split(monthly: DataFrame, window: DataFrame, label_months: int) -> DataFrame:
    """One row; the label window is the last `label_months` months with activity."""
    months = monthly.select("month").distinct()
    latest = months.orderBy(F.col("month").desc()).limit(label_months)
    return (
        months.agg(F.min("month").alias("window_start"), F.max("month").alias("window_end"))
        .crossJoin(F.broadcast(latest.agg(F.min("month").alias("label_start"))))
        .crossJoin(F.broadcast(window.select("observation_date")))
        .select("window_start", "label_start", "window_end", "observation_date")
    )


# What the features read of a merchant-month.
FACTS = [
    "merchant_id", "month", "attempted_txns", "successful_txns", "tpv_inr", "active_days", "avg_ticket_inr",
    "tickets_raised", "tickets_unresolved", "tickets_payment_failure", "avg_settlement_delay_days",
]


def month_behaviour(facts: DataFrame, label_start: dt.date, trailing: int = 3) -> DataFrame:
    """Everything a merchant's feature months say, in one window pass and one grouping.

    The last months' rate and the tenure at the cutoff are those of the gap-free calendar there: silent months add nothing
    to a sum, and the calendar has one row for every month since the first.
    """
    cutoff = (label_start - dt.timedelta(days=1)).replace(day=1)
    by_month = Window.partitionBy("merchant_id").orderBy("month")
    rows = facts.filter(F.col("month") < F.lit(label_start)).select(
        "*", F.row_number().over(by_month).alias("_nth"),
        F.count("*").over(Window.partitionBy("merchant_id")).alias("_months"))
    first, last = F.col("_nth") <= 3, F.col("_nth") > F.col("_months") - 3
    recent = F.col("month") > F.add_months(F.lit(cutoff), -trailing)
    ok, tried = F.col("successful_txns"), F.col("attempted_txns")

    def rate(cond):
        return double_or_null(F.sum(F.when(cond, ok)), F.sum(F.when(cond, tried)))

    tpv = F.sum(paise(F.col("tpv_inr")))
    tickets = F.sum(paise(F.col("avg_ticket_inr")))
    return rows.groupBy("merchant_id").agg(
        F.count("*").alias("active_months"),
        F.sum(tried).alias("attempted_txns"),
        F.sum(ok).alias("successful_txns"),
        rupees(tpv).alias("tpv_inr"),
        rupees(mean_paise(tpv, F.count("tpv_inr"))).alias("avg_monthly_tpv"),
        mean_of_ints(tried, 3).alias("avg_monthly_txns"),
        F.round(F.stddev_samp("tpv_inr")
                / F.nullif(rupees(tpv) / F.nullif(F.count("tpv_inr"), F.lit(0)), F.lit(0.0)), 4)
        .alias("tpv_cv"),
        ratio(F.sum(ok), F.sum(tried), 6).alias("success_rate"),
        F.round(rate(last) - rate(first), 6).alias("sr_trend"),
        rupees(mean_paise(tickets, F.count("avg_ticket_inr"))).alias("avg_ticket_inr"),
        mean_of_ints(F.col("active_days"), 2).alias("avg_active_days"),
        *[F.sum(c).alias(c) for c in ("tickets_raised", "tickets_unresolved", "tickets_payment_failure")],
        fine_mean(F.col("avg_settlement_delay_days"), 4).alias("avg_settlement_delay_days"),
        ratio(F.sum(F.when(recent, ok)), F.sum(F.when(recent, tried)), 6).alias("success_rate_3m_at_cutoff"),
        (month_index(F.lit(cutoff), F.min("month")) + 1).cast("bigint").alias("tenure_months"),
    )


def sr_trend(facts: DataFrame, label_start: dt.date) -> DataFrame:
    return month_behaviour(facts, label_start).select("merchant_id", "sr_trend")


def success_days(days: DataFrame, split: Split, confirmed_days: int) -> DataFrame:
    """Last success before the cutoff, and whether the merchant fell silent later.

    The label compares the last success of all history with the observation
    date, so a merchant silent since before the cutoff is labelled too.
    """
    ok = F.col("successful_txns") > 0
    limit = split.observation_date - dt.timedelta(days=confirmed_days)
    before = F.col("txn_date") < F.lit(split.label_start)
    seen = days.groupBy("merchant_id").agg(
        F.max(F.when(ok & before, F.col("txn_date"))).alias("last_success_before"),
        F.max(F.when(ok, F.col("txn_date"))).alias("last_success"))
    return seen.select(
        "merchant_id", "last_success_before",
        flag(F.coalesce("last_success", F.lit(NEVER)) < F.lit(limit)).alias("churned"))


def merchant_features_base(merchants: DataFrame, facts: DataFrame, days: DataFrame, gaps: DataFrame,
                           exposure: DataFrame, degraded: str | None, split: Split, params: Params) -> DataFrame:
    """All feature columns but the RFM scores."""
    start = split.label_start
    to_degraded = exposure.groupBy("merchant_id").agg(F.round(F.coalesce(F.sum(
        F.when(F.col("issuer_bank") == F.lit(degraded), F.col("exposure_share"))), F.lit(0.0)), 6)
        .alias("degraded_issuer_exposure"))
    rhythm = gaps.filter(F.col("txn_date") < F.lit(start)).groupBy("merchant_id").agg(
        bounded_quantile(F.col("gap_days"), 0.9).alias("p90_gap_days"),
        mean_of_ints(F.col("gap_days"), 3).alias("mean_gap_days"))
    who = merchants.select("merchant_id", "category", "city_tier", "acquisition_channel", "device_type",
                           "state", "gst_registered", "competitor_density")
    rows = (
        month_behaviour(facts, start, params.trailing_months)
        .join(success_days(days, split, params.confirmed_days), "merchant_id")
        .join(to_degraded, "merchant_id", "left")
        .join(rhythm, "merchant_id", "left")
        .join(who, "merchant_id")
    )
    return rows.select(
        *who.columns,
        "active_months", "attempted_txns", "successful_txns", "tpv_inr", "avg_monthly_tpv",
        "avg_monthly_txns", "tpv_cv", "success_rate", "success_rate_3m_at_cutoff", "sr_trend",
        "avg_ticket_inr", "avg_active_days", "tickets_raised", "tickets_unresolved",
        "tickets_payment_failure", "avg_settlement_delay_days",
        "tenure_months",
        F.round(F.coalesce("p90_gap_days", F.lit(params.default_p90_gap)), 2).alias("p90_gap_days"),
        F.coalesce("mean_gap_days", F.lit(params.default_mean_gap)).alias("mean_gap_days"),
        "degraded_issuer_exposure",
        F.datediff(F.lit(start), F.col("last_success_before")).cast("bigint").alias("recency_days"),
        "last_success_before", "churned",
    )


def rfm_base(merchants: DataFrame, issuer_months: DataFrame, days: DataFrame, split: Split, params: Params) -> DataFrame:
    """The merchants of the features with what the RFM scores read, straight from the rollups."""
    return (
        issuer_months.filter(F.col("month") < F.lit(split.label_start)).groupBy("merchant_id").agg(
            F.sum("attempted_txns").alias("attempted_txns"), rupees(F.sum("tpv_paise")).alias("tpv_inr"))
        .join(success_days(days, split, params.confirmed_days).drop("churned"), "merchant_id")
        .join(merchants.select("merchant_id"), "merchant_id")
    )


def rfm_scored(base: DataFrame, staging: Staging, params: Params) -> DataFrame:
    """Adds recency, frequency and money quintiles; ties are split by merchant id."""
    k = params.rfm_buckets
    return assign_tiles(base, staging, "merchant_id", {
        "r_score": Tile("last_success_before", k),
        "f_score": Tile("attempted_txns", k),
        "m_score": Tile("tpv_inr", k),
    })


def merchant_features(base: DataFrame, staging: Staging, params: Params) -> DataFrame:
    """All feature columns with the RFM scores."""
    scored = rfm_scored(base, staging, params)
    kept = [c for c in base.columns if c not in ("last_success_before", "churned")]
    return scored.select(*kept, "r_score", "f_score", "m_score", "churned")


def exposure_tiles(features: DataFrame, exposure: DataFrame, staging: Staging, params: Params) -> DataFrame:
    """Exposure decile per merchant with enough baseline attempts to trust a share."""
    enough = exposure.groupBy("merchant_id").agg(F.sum("attempts_pre").alias("n")).filter(
        F.col("n") >= params.min_baseline_attempts).select("merchant_id")
    eligible = features.join(enough, "merchant_id", "left_semi").select(
        "merchant_id", "degraded_issuer_exposure", "churned", "city_tier", "success_rate_3m_at_cutoff")
    return assign_tiles(eligible, staging, "merchant_id", {
        "exposure_decile": Tile("degraded_issuer_exposure", params.exposure_buckets)})


def exposure_vs_churn(tiles: DataFrame) -> DataFrame:
    n = F.count("*")
    return tiles.groupBy("exposure_decile").agg(
        F.round(F.min("degraded_issuer_exposure"), 4).alias("min_exposure"),
        F.round(F.max("degraded_issuer_exposure"), 4).alias("max_exposure"),
        n.alias("merchants"),
        ratio(F.sum("churned"), n, 4).alias("churn_rate"),
        ratio(tally(F.col("city_tier") == "tier_3"), n, 4).alias("tier3_share"),
        fine_mean(F.col("success_rate_3m_at_cutoff"), 4).alias("avg_sr_at_cutoff"),
    )
