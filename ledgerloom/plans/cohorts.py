"""Cohort retention and the monthly flow of merchants."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.calendar import month_index
from ledgerloom.functions.exact import flag, mean_paise, paise, ratio, rupees, tally


def cohort_retention(facts: DataFrame) -> DataFrame:
    """Cohort x elapsed month: how many merchants are active, and their TPV."""
    per_merchant = Window.partitionBy("merchant_id")
    dated = facts.select("merchant_id", "month", "tpv_inr",
                         F.min("month").over(per_merchant).alias("cohort_month"))
    cells = dated.groupBy("cohort_month", F.col("month").alias("activity_month")).agg(
        F.count("*").alias("active_merchants"), F.sum(paise(F.col("tpv_inr"))).alias("_tpv"))
    # From here on there is one row per cohort and month. Every member of a
    # cohort is active in its first month, so that cell holds the size.
    cells = cells.withColumn("month_index", month_index(F.col("activity_month"), F.col("cohort_month")))
    cohort = Window.partitionBy("cohort_month")
    start = F.col("month_index") == 0
    sized = cells.select(
        "*",
        F.max(F.when(start, F.col("active_merchants"))).over(cohort).alias("cohort_size"),
        F.max(F.when(start, F.col("_tpv"))).over(cohort).alias("_tpv0"),
    )
    return sized.select(
        "cohort_month", "activity_month", "month_index", "cohort_size", "active_merchants",
        ratio(F.col("active_merchants"), F.col("cohort_size"), 4).alias("logo_retention"),
        rupees(F.col("_tpv")).alias("tpv_inr"),
        ratio(F.col("_tpv"), F.col("_tpv0"), 4).alias("tpv_retention"),
    )


def cohort_retention_at(retention: DataFrame, index: int = 3) -> DataFrame:
    return retention.filter(F.col("month_index") == index).select(
        "cohort_month", "cohort_size",
        F.col("logo_retention").alias(f"m{index}_logo_retention"),
        F.col("tpv_retention").alias(f"m{index}_tpv_retention"),
    )


def merchant_transitions(dense: DataFrame) -> DataFrame:
    """Each merchant-month beside the activity before and after it."""
    by_month = Window.partitionBy("merchant_id").orderBy("month")
    return dense.select(
        "merchant_id", "month", "was_active",
        F.lag("was_active").over(by_month).alias("prev_active"),
        F.lead("was_active").over(by_month).alias("next_active"),
        F.col("tenure_months").alias("rn"),
    )


def merchant_flows(dense: DataFrame) -> DataFrame:
    """Merchants joining, returning, going silent and confirmed lost, per month."""
    now, before, after = F.col("was_active"), F.col("prev_active"), F.col("next_active")
    silent = (now == 0) & (before == 1)
    return merchant_transitions(dense).groupBy("month").agg(
        tally(F.col("rn") == 1).alias("new_merchants"),
        tally((now == 1) & (before == 0)).alias("reactivated_merchants"),
        tally(silent).alias("went_silent_merchants"),
        tally(silent & (after == 0)).alias("churned_merchants"),
    )


def network_health_monthly(facts: DataFrame, dense: DataFrame) -> DataFrame:
    """Stock, flow and growth of the network; one row per month with activity."""
    totals = facts.groupBy("month").agg(
        F.count("*").alias("active_merchants"),
        F.sum(paise(F.col("tpv_inr"))).alias("tpv"),
        F.sum("successful_txns").alias("ok"),
        F.sum("attempted_txns").alias("tried"),
        F.sum(paise(F.col("failed_value_inr"))).alias("failed"),
        F.sum("tickets_raised").alias("tickets_raised"),
    )
    # Both sides are one row per calendar month; so are the windows below.
    monthly = totals.join(merchant_flows(dense), "month")
    by_month, everything = Window.orderBy("month"), Window.partitionBy()
    prev_active = F.lag("active_merchants").over(by_month)
    prev_tpv = F.lag("tpv").over(by_month)
    month = F.col("month")
    edge = (month == F.min("month").over(everything)) | (month == F.max("month").over(everything))
    return monthly.select(
        "month", "active_merchants", "new_merchants", "reactivated_merchants",
        "went_silent_merchants", "churned_merchants", rupees(F.col("tpv")).alias("tpv_inr"),
        ratio(F.col("ok"), F.col("tried"), 6).alias("success_rate"),
        rupees(F.col("failed")).alias("failed_value_inr"), "tickets_raised",
        rupees(mean_paise(F.col("tpv"), F.col("active_merchants"))).alias("tpv_per_active_merchant"),
        ratio(F.col("active_merchants") - prev_active, prev_active, 6).alias("merchant_mom_growth"),
        ratio(F.col("tpv") - prev_tpv, prev_tpv, 6).alias("tpv_mom_growth"),
        (F.col("new_merchants") + F.col("reactivated_merchants") - F.col("went_silent_merchants"))
        .alias("net_merchant_adds"),
        flag(edge).alias("is_censored_boundary"),
    )
