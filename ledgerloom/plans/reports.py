"""Shapes a report page needs, from finished marts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.display import compact_money
from ledgerloom.functions.exact import fine_mean, ratio, sum_rupees


def kpi_row(bank_month: DataFrame, health: DataFrame, status_counts: DataFrame, at_risk: DataFrame) -> DataFrame:
    """Attempts, TPV, latest active count, confirmed churn rate, revenue still recoverable."""
    attempts = bank_month.agg(F.sum("attempted_txns").alias("attempts"))
    network = health.agg(sum_rupees(F.col("tpv_inr")).alias("tpv_inr"),
                         F.max_by("active_merchants", "month").alias("active_merchants"))
    lost = F.sum(F.when(F.col("status") == "confirmed_churn", F.col("merchants")).otherwise(0))
    risk = F.sum(F.when(F.col("status") == "at_risk", F.col("annualised_revenue_at_risk")))
    by_status = at_risk.agg(lost.alias("_lost"), risk.alias("revenue_at_risk"))
    scored = status_counts.select("merchants_scored")
    # every side is a single row
    row = attempts.crossJoin(network).crossJoin(by_status).crossJoin(scored)
    return row.select(
        "attempts", "tpv_inr", compact_money(F.col("tpv_inr")).alias("tpv_text"), "active_merchants",
        ratio(F.col("_lost"), F.col("merchants_scored"), 4).alias("confirmed_churn_rate"),
        "revenue_at_risk", compact_money(F.col("revenue_at_risk")).alias("revenue_at_risk_text"))


def cohort_triangle(retention: DataFrame, measure: str = "logo_retention") -> DataFrame:
    """Cohorts down, elapsed months across; as wide as the calendar is long."""
    last = retention.agg(F.max("month_index")).first()[0] or 0
    wide = retention.groupBy("cohort_month").pivot("month_index", list(range(last + 1))).agg(F.first(measure))
    return wide.select("cohort_month", *[F.col(str(i)).alias(f"m{i}") for i in range(last + 1)])


def flow_series(health: DataFrame) -> DataFrame:
    """Signed monthly flows, boundary months left out because they cannot be confirmed."""
    whole = health.filter(F.col("is_censored_boundary") == 0)
    return whole.select("month", F.inline(F.array(*[
        F.struct(F.lit(name).alias("flow"), F.col(col).cast("bigint").alias("merchants")) if sign > 0 else
        F.struct(F.lit(name).alias("flow"), (-F.col(col)).cast("bigint").alias("merchants"))
        for name, col, sign in [
            ("new", "new_merchants", 1), ("reactivated", "reactivated_merchants", 1),
            ("went_silent", "went_silent_merchants", -1), ("net", "net_merchant_adds", 1)]])))


def issuer_ranking(ranking: DataFrame) -> DataFrame:
    return ranking.orderBy("rank_by_network_impact", "issuer_bank").select(
        "issuer_bank", "avg_success_rate", "avg_volume_share", "cumulative_rate_effect",
        "rank_by_worst_sr", "rank_by_network_impact")


def growth_and_retention(health: DataFrame, m3: DataFrame) -> DataFrame:
    """The rising top line beside the month-3 retention of the cohort that started then."""
    later = m3.select(F.col("cohort_month").alias("month"), "m3_logo_retention", "m3_tpv_retention")
    return health.select("month", "active_merchants", "tpv_inr").join(later, "month", "left")


def issuer_heatmap(bank_month: DataFrame) -> DataFrame:
    """Issuers down, months across."""
    months = [r[0] for r in bank_month.select("month").distinct().orderBy("month").collect()]
    named = bank_month.withColumn("_m", F.date_format("month", "yyyy_MM"))
    return named.groupBy("issuer_bank").pivot("_m", [m.strftime("%Y_%m") for m in months]).agg(
        F.first("success_rate"))


def reason_mix_of(mix: DataFrame, issuer: str) -> DataFrame:
    return mix.filter(F.col("issuer_bank") == issuer).select("month", "failure_reason", "failures", "reason_share")


def headline_metrics(health: DataFrame, low_sr: float) -> DataFrame:
    rate = F.col("success_rate")
    return health.agg(
        sum_rupees(F.col("tpv_inr")).alias("total_tpv_inr"),
        fine_mean(rate, 6).alias("average_success_rate"),
        F.min(rate).alias("lowest_success_rate"),
        F.max("active_merchants").alias("peak_active_merchants"),
        F.count_if(rate < low_sr).alias("months_below_threshold"))
