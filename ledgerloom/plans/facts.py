"""Merchant-month facts and the gap-free calendar."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.calendar import month_range
from ledgerloom.functions.exact import flag, mean_paise, paise, ratio, rupees, tally


def merchant_bank_month(issuer_months: DataFrame) -> DataFrame:
    return issuer_months.select(
        "merchant_id", "month", "issuer_bank", "attempted_txns", "successful_txns",
        ratio(F.col("successful_txns"), F.col("attempted_txns"), 6).alias("success_rate"),
        rupees(F.col("tpv_paise")).alias("tpv_inr"),
        rupees(F.col("attempted_paise")).alias("attempted_value_inr"),
    )


def ticket_counts(tickets: DataFrame) -> DataFrame:
    return tickets.groupBy("merchant_id", F.col("ticket_month").alias("month")).agg(
        F.count("*").alias("tickets_raised"),
        tally(~F.col("resolved")).alias("tickets_unresolved"),
        tally(F.col("ticket_category") == "PAYMENT_FAILURE").alias("tickets_payment_failure"),
    )


def merchant_month(issuer_months: DataFrame, medians: DataFrame | None, tickets: DataFrame,
                   settlements: DataFrame, partitions: int | None = None, one_delay: bool = False) -> DataFrame:
    """One row per merchant per month with at least one attempt.

    Rates divide by attempts; TPV and tickets count successes only. Without `medians` there is no such column.

    Medians, tickets and delays are dealt by merchant, into as many `partitions` as the rollup has buckets, and grouped
    with its rows by month: the rollup itself, much the widest side, is not moved, nor are the rows that come out. Every
    delay of a merchant-month makes a row of its own, as in a join; with `one_delay` there is at most one, and no list.
    """
    keys = ["merchant_id", "month"]
    base = issuer_months.groupBy(*keys).agg(
        F.sum("attempted_txns").alias("attempted_txns"),
        F.sum("successful_txns").alias("successful_txns"),
        F.sum("failed_txns").alias("failed_txns"),
        F.sum("tpv_paise").alias("tpv_paise"),
        F.sum("attempted_paise").alias("attempted_paise"),
        F.bit_count(F.bit_or("day_bits")).cast("bigint").alias("active_days"),
        F.count("*").alias("distinct_issuers"),
        F.min("first_txn_date").alias("first_txn_date"),
        F.max("last_txn_date").alias("last_txn_date"),
    )
    delay = "avg_settlement_delay_days"
    delays = settlements.select("merchant_id", F.col("settle_month").alias("month"),
                                F.col(delay) if one_delay else F.struct(delay).alias("_delay"))
    # Under another name than the rollup's own, Spark sees that all sides of the union are dealt alike.
    met = base.withColumn("_fact", F.lit(1)).withColumnRenamed("merchant_id", "_m")
    for side in ([] if medians is None else [medians]) + [ticket_counts(tickets), delays]:
        # Keys that are NULL meet nothing.
        known = side.filter(F.col("merchant_id").isNotNull() & F.col("month").isNotNull())
        dealt = known.repartition(partitions, "merchant_id") if partitions else known.repartition("merchant_id")
        met = met.unionByName(dealt.withColumnRenamed("merchant_id", "_m"), allowMissingColumns=True)
    # At most one row of each side but the delays, so a maximum is its value.
    values = [c for c in met.columns if c not in ("_m", "month", "_delay")]
    lists = [] if one_delay else [F.collect_list("_delay").alias("_delay")]
    joined = met.groupBy("_m", "month").agg(*[F.max(c).alias(c) for c in values], *lists).filter(F.col("_fact") == 1).withColumnRenamed(
        "_m", "merchant_id")
    if not one_delay:
        joined = joined.withColumn("_delay", F.explode_outer("_delay")).withColumn(delay, F.col(f"_delay.{delay}"))
    none = F.lit(0).cast("bigint")
    return joined.select(
        *keys, "attempted_txns", "successful_txns", "failed_txns",
        ratio(F.col("successful_txns"), F.col("attempted_txns"), 6).alias("success_rate"),
        rupees(F.col("tpv_paise")).alias("tpv_inr"),
        rupees(F.col("attempted_paise")).alias("attempted_value_inr"),
        rupees(F.col("attempted_paise") - F.coalesce("tpv_paise", none)).alias("failed_value_inr"),
        "active_days",
        rupees(mean_paise(F.col("tpv_paise"), F.col("successful_txns"))).alias("avg_ticket_inr"),
        *([] if medians is None else ["median_ticket_inr"]), "distinct_issuers", "first_txn_date", "last_txn_date",
        *[F.coalesce(c, none).alias(c)
          for c in ("tickets_raised", "tickets_unresolved", "tickets_payment_failure")],
        delay,
    )


def merchant_month_dense(facts: DataFrame, last_month: dt.date, trailing: int = 3) -> DataFrame:
    """Every calendar month from a merchant's first one to `last_month`.

    Each fact row is stretched up to the merchant's next fact row, so silent
    months appear without a calendar join.
    """
    by_month = Window.partitionBy("merchant_id").orderBy("month")
    after_last = F.add_months(F.lit(last_month), 1)
    until = F.coalesce(F.lead("month").over(by_month), after_last)
    stretched = facts.select(
        "merchant_id", F.col("month").alias("seen"), "attempted_txns", "successful_txns", "tpv_inr",
        "success_rate", "tickets_unresolved", "avg_settlement_delay_days", until.alias("until"),
    ).withColumn("month", F.explode(month_range(F.col("seen"), F.add_months("until", -1))))
    live = F.col("month") == F.col("seen")

    def zero_fill(name: str):
        return F.coalesce(F.when(live, F.col(name)), F.lit(0).cast("bigint")).alias(name)

    filled = stretched.select(
        "merchant_id", "month", zero_fill("attempted_txns"), zero_fill("successful_txns"),
        F.coalesce(F.when(live, paise(F.col("tpv_inr"))), F.lit(0).cast("bigint")).alias("_paise"),
        F.when(live, F.col("success_rate")).alias("success_rate"),
        zero_fill("tickets_unresolved"),
        F.when(live, F.col("avg_settlement_delay_days")).alias("avg_settlement_delay_days"),
        flag(live).alias("was_active"),
    )
    recent = by_month.rowsBetween(1 - trailing, 0)
    so_far = by_month.rowsBetween(Window.unboundedPreceding, 0)
    tpv, prev = F.col("_paise"), F.col("_prev")
    return filled.select(
        "*",
        F.lag("_paise").over(by_month).alias("_prev"),
        F.sum("successful_txns").over(recent).alias("_ok"),
        F.sum("attempted_txns").over(recent).alias("_tried"),
        F.sum("_paise").over(recent).alias("_3m"),
        F.row_number().over(by_month).cast("bigint").alias("tenure_months"),
        F.sum("was_active").over(so_far).alias("active_months_to_date"),
    ).select(
        "merchant_id", "month", "attempted_txns", "successful_txns", rupees(tpv).alias("tpv_inr"),
        "success_rate", "tickets_unresolved", "avg_settlement_delay_days", "was_active",
        rupees(prev).alias("prev_tpv_inr"), rupees(tpv - prev).alias("tpv_mom_delta"),
        F.when(prev > 0, ratio(tpv - prev, prev, 6)).alias("tpv_mom_pct"),
        ratio(F.col("_ok"), F.col("_tried"), 6).alias("success_rate_3m"),
        rupees(F.col("_3m")).alias("tpv_3m"), "tenure_months", "active_months_to_date",
    )
