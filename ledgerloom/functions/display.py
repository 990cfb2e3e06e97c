"""Text shaping used by reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def compact_money(col: Column) -> Column:
    """Short rupee figure in billions, millions or thousands."""
    v = col.cast("double")
    return (
        F.when(F.abs(v) >= 1e9, F.format_string("₹%.2fB", v / 1e9))
        .when(F.abs(v) >= 1e6, F.format_string("₹%.1fM", v / 1e6))
        .when(F.abs(v) >= 1e3, F.format_string("₹%.0fK", v / 1e3))
        .otherwise(F.format_string("₹%,.0f", v))
    )


def strip_encoder_prefix(col: Column) -> Column:
    return F.regexp_replace(col, "^(num|cat)__", "")


def iso_dates(df: DataFrame) -> DataFrame:
    """Dates and timestamps as yyyy-MM-dd text, for CSV consumers."""
    temporal = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return df.select(*[
        F.date_format(f.name, "yyyy-MM-dd").alias(f.name)
        if isinstance(f.dataType, temporal) else F.col(f.name)
        for f in df.schema.fields
    ])


def plain_numbers(df: DataFrame) -> DataFrame:
    """Decimals as doubles and every integer as BIGINT, for consumers without decimals."""
    def shape(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.DecimalType):
            return F.col(f.name).cast("double").alias(f.name)
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            return F.col(f.name).cast("bigint").alias(f.name)
        return F.col(f.name)
    return df.select(*[shape(f) for f in df.schema.fields])
