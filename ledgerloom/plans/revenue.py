"""Money already lost, money at risk, and the slice an issuer fix could claim."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.exact import fine_mean, paise, rupees
from ledgerloom.params import Params


def revenue_params(spark: SparkSession, params: Params) -> DataFrame:
    return spark.range(1).select(F.lit(params.take_rate).alias("take_rate"))


def realised_failure_loss(health: DataFrame, params: Params) -> DataFrame:
    """Revenue on failed value, and the part above the early success rate; one row per month."""
    early = health.orderBy("month").limit(params.baseline_months)
    micros = F.sum(F.rint(F.col("success_rate") * 1e6).cast("bigint"))
    base = early.agg((micros.cast("double") / 1e6 / F.count("success_rate")).alias("_base"))
    failed, take = F.col("failed_value_inr"), F.lit(params.take_rate)
    exposed = rupees(paise(F.col("failed_value_inr")) + paise(F.col("tpv_inr")))
    short = F.greatest(F.lit(0.0), F.col("_base") - F.col("success_rate"))
    return health.crossJoin(F.broadcast(base)).select(
        "month", "failed_value_inr",
        F.round(failed * take, 2).alias("revenue_lost_inr"),
        "success_rate",
        F.round(short * exposed * take, 2).alias("excess_revenue_lost_inr"),
    )


def merchant_status(silence: Column, params: Params) -> Column:
    return (F.when(silence >= params.confirmed_days, "confirmed_churn")
            .when(silence >= params.at_risk_days, "at_risk")
            .otherwise("active"))


def run_rate(facts: DataFrame, params: Params) -> DataFrame:
    """Mean TPV of the last few active months, so silence does not deflate it.

    `run_rate_units` is the same mean times a common multiple of the possible
    month counts: an exact amount that can be summed over merchants.
    """
    k = params.run_rate_months
    unit = math.lcm(*range(1, k + 1))
    latest = Window.partitionBy("merchant_id").orderBy(F.col("month").desc())
    recent = (facts.select("merchant_id", "month", "tpv_inr")
              .withColumn("rn", F.row_number().over(latest)).filter(F.col("rn") <= k))
    n = F.count("tpv_inr")
    parts = F.lit(None).cast("int")
    for c in range(1, k + 1):
        parts = F.when(n == c, F.lit(unit // c)).otherwise(parts)
    return recent.groupBy("merchant_id").agg(
        F.sum(paise(F.col("tpv_inr"))).alias("_total"), n.alias("_n"), parts.alias("_parts")).select(
        "merchant_id",
        (rupees(F.col("_total")) / F.nullif(F.col("_n"), F.lit(0))).alias("monthly_tpv_run_rate"),
        (F.col("_total") * F.col("_parts")).alias("run_rate_units"),
    )


def exposure_median(features: DataFrame) -> DataFrame:
    """Population median exposure; shares at six decimals bound the distinct values."""
    counts = features.filter(F.col("degraded_issuer_exposure").isNotNull()).groupBy(
        "degraded_issuer_exposure").agg(F.count("*").alias("n"))
    return counts.agg(F.percentile("degraded_issuer_exposure", F.lit(0.5), F.col("n")).alias("median_exposure"))


def revenue_at_risk(status: DataFrame, facts: DataFrame, features: DataFrame, params: Params) -> DataFrame:
    """By silence status: run rate, annualised revenue, and the attributable slice."""
    unit = math.lcm(*range(1, params.run_rate_months + 1))
    labelled = status.select(
        "merchant_id", merchant_status(F.col("days_since_last_success"), params).alias("status"))
    exposed = features.select("merchant_id", "degraded_issuer_exposure")
    rows = (
        labelled.join(run_rate(facts, params), "merchant_id")
        .join(exposed, "merchant_id", "left")
        .crossJoin(F.broadcast(exposure_median(features)))
    )
    above = F.coalesce(F.col("degraded_issuer_exposure") > F.col("median_exposure"), F.lit(False))
    sums = rows.groupBy("status").agg(
        F.count("*").alias("merchants"),
        F.sum("run_rate_units").alias("_units"),
        F.sum(F.when(above, F.col("run_rate_units")).otherwise(F.lit(0))).alias("_attributable"),
        fine_mean(F.col("degraded_issuer_exposure"), 4).alias("avg_issuer_exposure"),
    )

    # Three rows from here on, so wide decimals cost nothing.
    def monthly(col: str) -> Column:
        return _wide(F.col(col)) / F.lit(unit)

    def yearly(col: str) -> Column:
        yearly_bps = F.lit(str(round(params.take_rate_bps * 12, 4))).cast("decimal(10,4)")
        return _wide(F.col(col)) * yearly_bps / F.lit(unit * 10000)

    return sums.select(
        "status", "merchants",
        rupees(F.round(monthly("_units"), 0)).alias("monthly_tpv_at_risk"),
        rupees(F.round(yearly("_units"), 0)).alias("annualised_revenue_at_risk"),
        "avg_issuer_exposure",
        rupees(F.round(yearly("_attributable"), 0)).alias("attributable_revenue_at_risk"),
    )


def _wide(col: Column) -> Column:
    return col.cast("decimal(22,0)")
