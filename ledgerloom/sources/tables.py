"""Source schemas, readers and the typed views over raw tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.calendar import month_of

TRANSACTIONS = T.StructType([
    T.StructField("txn_id", T.LongType()),
    T.StructField("merchant_id", T.StringType()),
    T.StructField("txn_ts", T.TimestampType()),
    T.StructField("amount_inr", T.DecimalType(18, 2)),
    T.StructField("issuer_bank", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("failure_reason", T.StringType()),
])

MERCHANTS = T.StructType([
    T.StructField("merchant_id", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("city_tier", T.StringType()),
    T.StructField("acquisition_channel", T.StringType()),
    T.StructField("device_type", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("cohort_month_index", T.IntegerType()),
    T.StructField("gst_registered", T.BooleanType()),
    T.StructField("slow_settlement", T.BooleanType()),
    T.StructField("competitor_density", T.DoubleType()),
    T.StructField("onboarded_month", T.StringType()),
    T.StructField("onboarded_before_window", T.BooleanType()),
])

TICKETS = T.StructType([
    T.StructField("merchant_id", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("ticket_category", T.StringType()),
    T.StructField("resolved", T.BooleanType()),
])

SETTLEMENTS = T.StructType([
    T.StructField("merchant_id", T.StringType()),
    T.StructField("month", T.StringType()),
    T.StructField("avg_settlement_delay_days", T.DoubleType()),
])

LIFECYCLE = T.StructType([
    T.StructField("merchant_id", T.StringType()),
    T.StructField("true_churn_month_index", T.IntegerType()),
    T.StructField("true_churn_month", T.StringType()),
    T.StructField("still_active_at_end", T.BooleanType()),
    T.StructField("ever_active", T.BooleanType()),
    T.StructField("dormant_at_end", T.BooleanType()),
])


@dataclass(frozen=True)
class Sources:
    """The four typed inputs every mart is built from."""

    transactions: DataFrame
    merchants: DataFrame
    support_tickets: DataFrame
    settlements: DataFrame
    # Whether settlements are known to hold at most one row per merchant and month.
    one_delay: bool = False


def typed_transactions(raw: DataFrame) -> DataFrame:
    """Day and month keys, an empty failure reason as NULL.

    A part-per-month layout already carries `txn_month` as its partition
    column; it is kept as is so month filters still prune parts.
    """
    keyed = raw.withColumn("txn_date", F.col("txn_ts").cast("date"))
    if "txn_month" in raw.columns:
        keyed = keyed.withColumn("txn_month", F.col("txn_month").cast("date"))
    else:
        keyed = keyed.withColumn("txn_month", month_of(F.col("txn_ts")))
    return (
        keyed
        .withColumn("failure_reason", F.nullif(F.col("failure_reason"), F.lit("")))
    )


def typed_tickets(raw: DataFrame) -> DataFrame:
    return raw.select(
        "merchant_id", "created_at", month_of(F.col("created_at")).alias("ticket_month"),
        "ticket_category", "resolved",
    )


def typed_settlements(raw: DataFrame) -> DataFrame:
    """Source months are yyyy-MM text."""
    return raw.select(
        "merchant_id",
        F.to_date(F.concat(F.col("month"), F.lit("-01"))).alias("settle_month"),
        "avg_settlement_delay_days",
    )


def read_sources(spark: SparkSession, folder: str) -> Sources:
    """Parquet layout: a transactions folder of monthly parts beside three files."""
    def load(name: str, schema: T.StructType) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{folder}/{name}")

    monthly = T.StructType(TRANSACTIONS.fields + [T.StructField("txn_month", T.DateType())])
    return Sources(
        transactions=typed_transactions(load("transactions", monthly)),
        merchants=load("merchants.parquet", MERCHANTS),
        support_tickets=typed_tickets(load("support_tickets.parquet", TICKETS)),
        settlements=typed_settlements(load("settlements.parquet", SETTLEMENTS)),
    )


def read_lifecycle(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LIFECYCLE).parquet(path)


def read_csv_report(spark: SparkSession, name: str, schema: T.StructType, *folders: str) -> DataFrame:
    """A CSV report from the first folder that has it."""
    for folder in folders:
        path = f"{folder}/{name}"
        if path_exists(spark, path):
            return spark.read.schema(schema).option("header", True).csv(path)
    raise FileNotFoundError(f"{name} is in none of {folders}")


def read_json_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
