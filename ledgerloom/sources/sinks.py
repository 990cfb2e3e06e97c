"""Files written for other tools."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.display import iso_dates

# The marts exported for reporting.
EXPORTED = [
    "network_health_monthly", "cohort_retention", "bank_month_sr", "sr_contribution",
    "revenue_at_risk", "realised_failure_loss", "incident_culprit_ranking", "exposure_vs_churn",
    "cohort_m3_retention",
]


def write_monthly_parts(transactions: DataFrame, path: str) -> None:
    """One folder per month; only the months present are replaced.

    Rows are ranged on (month, merchant, attempt), so a task writes few months, and
    a month or a merchant of a month that holds most rows is written by many tasks.
    """
    attempt = F.xxhash64(*transactions.columns)
    (transactions.repartitionByRange(F.col("txn_month"), F.col("merchant_id"), attempt).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("txn_month").parquet(path))


def write_csv(df: DataFrame, path: str) -> None:
    iso_dates(df).write.mode("overwrite").option("header", True).csv(path)


def export_marts(marts: Mapping[str, DataFrame], folder: str) -> dict[str, str]:
    """Every mart as CSV with ISO dates; returns where each one went."""
    places = {}
    for name, df in marts.items():
        places[name] = f"{folder}/{name}"
        write_csv(df, places[name])
    return places


def content_digest(df: DataFrame) -> DataFrame:
    """(n_rows, content): rows and the sum of 32-bit hashes of whole rows, the same in any order of rows and any split into files.

    A row counts as the texts of its columns by name: dates as yyyy-MM-dd, doubles as whole millionths, null as ~.
    """
    def text(f: T.StructField) -> Column:
        col = F.col(f.name)
        if isinstance(f.dataType, T.DoubleType):
            col = F.round(col * 1e6).cast("bigint")
        elif isinstance(f.dataType, T.DateType):
            col = F.date_format(col, "yyyy-MM-dd")
        return F.coalesce(col.cast("string"), F.lit("~"))

    row = F.concat_ws("|", *[text(f) for f in sorted(df.schema.fields, key=lambda f: f.name)])
    value = F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("bigint")
    return df.select(value.alias("v")).agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("v"), F.lit(0).cast("bigint")).alias("content"))


def manifest(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, columns and file count per table as read back from storage."""
    rows = []
    for name, df in tables.items():
        per_file = df.select(F.input_file_name().alias("f")).groupBy("f").agg(F.count("*").alias("n"))
        rows.append(per_file.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_parts"))
                    .select(F.lit(name).alias("table_name"), "n_rows", "n_parts",
                            F.lit(",".join(df.columns)).alias("columns")))
    return reduce(DataFrame.unionByName, rows)


def head_sample(df: DataFrame, n: int, *order: str) -> DataFrame:
    """A small browsable extract, the same on every run."""
    return df.orderBy(*order).limit(n)


def scorecard(single: Mapping[str, DataFrame], many: Mapping[str, DataFrame]) -> DataFrame:
    """One nested row: each one-row frame as a struct, each small report as an array of structs."""
    parts = [df.agg(F.first(F.struct(*df.columns)).alias(name)) for name, df in single.items()]
    parts += [df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name)) for name, df in many.items()]
    return reduce(DataFrame.crossJoin, parts)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
