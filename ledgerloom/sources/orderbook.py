"""An order-and-shipment star schema read as payment activity.

customer = merchant, lineitem = payment attempt, the supplier's nation = issuer,
a returned line = a failed attempt, an urgent order = a support ticket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.exact import ratio
from ledgerloom.sources.staging import Staging
from ledgerloom.sources.tables import Sources, typed_settlements, typed_tickets, typed_transactions


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def by_remainder(col: Column, base: int, *names: str) -> Column:
    """The name at position col mod base; the last one catches the rest."""
    picked = F.when(col % base == 0, names[0])
    for i, name in enumerate(names[1:-1], start=1):
        picked = picked.when(col % base == i, name)
    return picked.otherwise(names[-1])


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The largest join of the order book, with the columns that attempts and settlements need."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_returnflag", "l_tax")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey", "o_orderkey")


def attempts(spark: SparkSession, folder: str, lines: DataFrame) -> DataFrame:
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    # 25 nations is a fixed bound.
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    failed = F.col("l_returnflag") == "R"
    return (
        lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_custkey").alias("merchant_id"),
            F.col("l_shipdate").alias("txn_ts"),
            F.col("l_extendedprice").alias("amount_inr"),
            F.col("n_name").alias("issuer_bank"),
            F.when(failed, "FAILED").otherwise("SUCCESS").alias("status"),
            F.when(failed, F.col("o_orderpriority")).otherwise("").alias("failure_reason"),
        )
    )


def merchants(spark: SparkSession, folder: str) -> DataFrame:
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    key = F.col("c_custkey")
    return (
        table(spark, folder, "customer")
        .join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            key.alias("merchant_id"),
            F.col("c_mktsegment").alias("category"),
            by_remainder(F.col("c_nationkey"), 3, "tier_1", "tier_2", "tier_3").alias("city_tier"),
            by_remainder(key, 4, "field_sales", "self_serve", "referral", "partner_bank")
            .alias("acquisition_channel"),
            by_remainder(key, 3, "qr_static", "soundbox", "pos").alias("device_type"),
            F.col("n_name").alias("state"),
            (F.col("c_acctbal") > 0).alias("gst_registered"),
            (((key * 37) % 97).cast("double") / 97).alias("competitor_density"),
        )
    )


def tickets(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
        .select(
            F.col("o_custkey").alias("merchant_id"),
            F.col("o_orderdate").alias("created_at"),
            F.when(F.col("o_orderstatus") == "F", "PAYMENT_FAILURE").otherwise("OTHER")
            .alias("ticket_category"),
            (F.col("o_orderstatus") != "O").alias("resolved"),
        )
    )


def settlements(lines: DataFrame) -> DataFrame:
    tax = F.rint(F.col("l_tax") * 10000).cast("bigint")
    return (
        lines.groupBy(F.col("o_custkey").alias("merchant_id"), F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("m"))
        .agg(ratio(F.sum(tax), F.count("*") * 100, 3).alias("avg_settlement_delay_days"))
        .select("merchant_id", F.substring(F.col("m").cast("string"), 1, 7).alias("month"),
                "avg_settlement_delay_days")
    )


def bind(spark: SparkSession, folder: str, staging: Staging | None = None) -> Sources:
    """The four sources. With `staging`, lines and orders are joined once and written for both that read them."""
    lines = order_lines(spark, folder)
    if staging:
        lines = staging.write(lines, "order_lines")
    return Sources(
        transactions=typed_transactions(attempts(spark, folder, lines)),
        merchants=merchants(spark, folder),
        support_tickets=typed_tickets(tickets(spark, folder)),
        settlements=typed_settlements(settlements(lines)),
        one_delay=True,
    )
