"""Which issuer moved the network success rate, and which merchants felt it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.calendar import month_of
from ledgerloom.functions.exact import double_or_null, fine_mean, paise, ratio, rupees, sum_rupees


def bank_month_sr(bank_months: DataFrame) -> DataFrame:
    cells = bank_months.groupBy("month", "issuer_bank").agg(
        F.sum("attempted_txns").alias("attempted_txns"),
        F.sum("successful_txns").alias("successful_txns"),
        F.sum(paise(F.col("attempted_value_inr"))).alias("_asked"),
        F.sum(paise(F.col("tpv_inr"))).alias("_tpv"),
    )
    in_month = F.sum("attempted_txns").over(Window.partitionBy("month"))
    return cells.select(
        "month", "issuer_bank", "attempted_txns", "successful_txns",
        ratio(F.col("successful_txns"), F.col("attempted_txns"), 6).alias("success_rate"),
        rupees(F.col("_asked")).alias("attempted_value_inr"),
        rupees(F.col("_asked") - F.col("_tpv")).alias("failed_value_inr"),
        ratio(F.col("attempted_txns"), in_month, 6).alias("volume_share"),
    )


def first_months(monthly: DataFrame, k: int) -> DataFrame:
    """The first k distinct months present; one row per month before the limit."""
    return monthly.select("month").distinct().orderBy("month").limit(k)


def issuer_baseline(bank_month: DataFrame, months: int) -> DataFrame:
    """Success rate and volume share per issuer before anything happened."""
    early = bank_month.join(F.broadcast(first_months(bank_month, months)), "month", "left_semi")
    per_issuer = early.groupBy("issuer_bank").agg(
        F.sum("successful_txns").alias("ok"), F.sum("attempted_txns").alias("tried"))
    whole = Window.partitionBy()
    return per_issuer.select(
        "issuer_bank",
        double_or_null(F.col("ok"), F.col("tried")).alias("sr_baseline"),
        double_or_null(F.col("tried"), F.sum("tried").over(whole)).alias("share_baseline"),
        double_or_null(F.sum("ok").over(whole), F.sum("tried").over(whole)).alias("network_sr_baseline"),
    )


def sr_contribution(bank_month: DataFrame, months: int) -> DataFrame:
    """Change against the baseline split into rate, mix and their interaction."""
    sr, share = F.col("success_rate"), F.col("volume_share")
    sr0, share0 = F.col("sr_baseline"), F.col("share_baseline")
    return bank_month.join(issuer_baseline(bank_month, months), "issuer_bank").select(
        "month", "issuer_bank", "success_rate", "sr_baseline", "volume_share", "share_baseline",
        F.round(sr - sr0, 6).alias("sr_delta"),
        F.round(share0 * (sr - sr0), 8).alias("rate_effect"),
        F.round((share - share0) * (sr0 - F.col("network_sr_baseline")), 8).alias("mix_effect"),
        F.round((share - share0) * (sr - sr0), 8).alias("interaction_effect"),
        "failed_value_inr",
    )


def incident_culprit_ranking(contribution: DataFrame) -> DataFrame:
    """Issuers ranked by worst rate and, separately, by damage to the network."""
    effect = F.sum(F.rint(F.col("rate_effect") * 1e8).cast("bigint"))
    worst = contribution.groupBy("issuer_bank").agg(
        fine_mean(F.col("success_rate"), 6).alias("avg_success_rate"),
        fine_mean(F.col("volume_share"), 6).alias("avg_volume_share"),
        F.min("sr_delta").alias("worst_sr_delta"),
        ratio(effect, F.lit(100000000), 6).alias("cumulative_rate_effect"),
        sum_rupees(F.col("failed_value_inr")).alias("total_failed_value_inr"),
    )
    return worst.select(
        "*",
        F.rank().over(Window.orderBy("avg_success_rate")).alias("rank_by_worst_sr"),
        F.rank().over(Window.orderBy("cumulative_rate_effect")).alias("rank_by_network_impact"),
    )


def degraded_issuer(ranking: DataFrame) -> DataFrame:
    """The issuer with the most negative cumulative effect; ties go to the first name."""
    order = F.struct("cumulative_rate_effect", "issuer_bank")
    return ranking.agg(F.min_by("issuer_bank", order).alias("issuer_bank"))


def impact_order(contribution: DataFrame) -> DataFrame:
    """Issuer-months by the size of their rate effect, largest first; one row per issuer and month, so one ordering task."""
    size = F.abs("rate_effect")
    return contribution.select("month", "issuer_bank", "rate_effect", F.rank().over(Window.orderBy(size.desc_nulls_last())).alias(
        "impact_rank")).orderBy("impact_rank", "month", "issuer_bank")


def failure_reason_mix(attempts: DataFrame) -> DataFrame:
    """Failures by issuer, month and reason, from counts of equal attempts."""
    counts = attempts.filter(F.col("status") == "FAILED").groupBy(
        month_of(F.col("txn_date")).alias("month"), "issuer_bank", "failure_reason").agg(
        F.sum("attempts").alias("failures"))
    cell = Window.partitionBy("month", "issuer_bank")
    return counts.withColumn(
        "reason_share", ratio(F.col("failures"), F.sum("failures").over(cell), 6))


def merchant_bank_exposure(bank_months: DataFrame, early: Sequence[dt.date]) -> DataFrame:
    """Where a merchant's attempts went before the incident."""
    counts = bank_months.filter(F.col("month").isin(*early)).groupBy("merchant_id", "issuer_bank").agg(
        F.sum("attempted_txns").alias("attempts_pre"))
    total = F.sum("attempts_pre").over(Window.partitionBy("merchant_id"))
    return counts.withColumn("exposure_share", ratio(F.col("attempts_pre"), total, 6))


def sliced_success_rate(issuer_months: DataFrame, merchants: DataFrame, issuer: str | None = None,
                        city_tier: str | None = None, category: str | None = None) -> DataFrame:
    """Monthly success rate of a slice; a filter left out keeps everything. Reads the rollup, not the attempts."""
    rows = issuer_months.select("merchant_id", "month", "attempted_txns", "successful_txns", "issuer_bank")
    if issuer is not None:
        rows = rows.filter(F.col("issuer_bank") == issuer)
    wanted = {"city_tier": city_tier, "category": category}
    if any(v is not None for v in wanted.values()):
        chosen = merchants
        for name, value in wanted.items():
            if value is not None:
                chosen = chosen.filter(F.col(name) == value)
        rows = rows.join(chosen.select("merchant_id"), "merchant_id", "left_semi")
    tried, ok = F.sum("attempted_txns"), F.sum("successful_txns")
    return rows.groupBy("month").agg(
        tried.alias("attempted_txns"), ok.alias("successful_txns"), ratio(ok, tried, 6).alias("success_rate"))
