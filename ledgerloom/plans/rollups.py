"""Pre-aggregated grains every mart reads instead of raw attempts.

Raw attempts are read once, into counts of equal attempts: a histogram of amounts and failure reasons in rows, which any
coarser grain adds up. Counting is combined on the map side and dealt by all its columns, so neither a merchant with a third of all
attempts nor an amount or a reason that most attempts share gathers in one task. No list or map grows with a merchant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.calendar import day_bit, month_of
from ledgerloom.functions.exact import paise, rupees
from ledgerloom.operators.quantiles import spread_quantiles
from ledgerloom.params import Params
from ledgerloom.sources.staging import Staging


def attempt_counts(transactions: DataFrame) -> DataFrame:
    """Merchant x issuer x day x status x reason x amount: the number of equal attempts. Counts of two inputs add up to those of both."""
    return transactions.groupBy(
        "merchant_id", "issuer_bank", "txn_date", "status", "failure_reason", paise(F.col("amount_inr")).alias("paise")).agg(
        F.count("*").alias("attempts"))


def issuer_day(counts: DataFrame) -> DataFrame:
    """Merchant x issuer x day: attempts, successes and both values."""
    ok, n = F.col("status") == "SUCCESS", F.col("attempts")
    none = F.lit(0).cast("bigint")
    return counts.groupBy("merchant_id", "issuer_bank", "txn_date").agg(
        F.sum(n).alias("attempted_txns"),
        F.sum(F.when(ok, n).otherwise(none)).alias("successful_txns"),
        F.sum(F.when(F.col("status") == "FAILED", n).otherwise(none)).alias("failed_txns"),
        F.sum(F.when(ok, F.col("paise") * n)).alias("tpv_paise"),
        F.sum(F.col("paise") * n).alias("attempted_paise"),
    )


def issuer_month(days: DataFrame) -> DataFrame:
    """Merchant x issuer x month, with the days seen kept as one bit each."""
    return days.groupBy("merchant_id", month_of(F.col("txn_date")).alias("month"), "issuer_bank").agg(
        F.sum("attempted_txns").alias("attempted_txns"),
        F.sum("successful_txns").alias("successful_txns"),
        F.sum("failed_txns").alias("failed_txns"),
        F.sum("tpv_paise").alias("tpv_paise"),
        F.sum("attempted_paise").alias("attempted_paise"),
        F.bit_or(day_bit(F.col("txn_date"))).alias("day_bits"),
        F.min("txn_date").alias("first_txn_date"),
        F.max("txn_date").alias("last_txn_date"),
    )


def ticket_medians(counts: DataFrame, issuer_months: DataFrame, staging: Staging,
                   params: Params) -> DataFrame:
    """Exact median successful amount per merchant-month, half-up to paise.

    A merchant-month up to `hot_group_rows` successes is ordered inside one
    task, equal amounts as one row. Larger ones go through the spread quantile,
    which never puts a group in one task. Both give the same values.
    """
    keys = ["merchant_id", "month"]
    amounts = counts.filter((F.col("status") == "SUCCESS") & F.col("paise").isNotNull()).select(
        "merchant_id", month_of(F.col("txn_date")).alias("month"), "paise", "attempts")
    hot = (issuer_months.groupBy(*keys).agg(F.sum("successful_txns").alias("n"))
           .filter(F.col("n") > params.hot_group_rows).select(*keys))
    n_hot = hot.count()
    if not n_hot:
        return _middle_of_counts(amounts)
    small = _middle_of_counts(amounts.join(hot, keys, "left_anti"))
    large = spread_quantiles(amounts.join(hot, keys, "left_semi"), staging, keys, "paise", {"m": 0.5}, weight="attempts")
    return small.unionByName(large.select(*keys, rupees(F.floor(F.col("m") + 0.5)).alias("median_ticket_inr")))


def _middle_of_counts(amounts: DataFrame) -> DataFrame:
    """Middle one or two amounts: each group moves once, to one task, which adds up its equal amounts and orders them."""
    group = Window.partitionBy("merchant_id", "month")
    counts = amounts.repartition("merchant_id", "month").groupBy("merchant_id", "month", "paise").agg(F.sum("attempts").alias("k"))
    placed = counts.select(
        "*", F.sum("k").over(group.orderBy("paise").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.sum("k").over(group).alias("n"))
    two = F.lit(2).cast("bigint")
    first, second = F.call_function("div", F.col("n") + 1, two), F.call_function("div", F.col("n"), two) + 1
    middle = placed.filter((F.col("upto") >= first) & (F.col("upto") - F.col("k") < second))
    both = F.min("paise") + F.max("paise")
    return middle.groupBy("merchant_id", "month").agg(
        rupees(F.call_function("div", both + 1, two)).alias("median_ticket_inr"))
