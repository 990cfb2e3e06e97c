"""Month and day arithmetic on DATE columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_of(col: Column) -> Column:
    return F.trunc(col.cast("date"), "MM")


def month_index(later: Column, earlier: Column) -> Column:
    """Whole calendar months from `earlier` to `later`."""
    years = F.year(later) - F.year(earlier)
    return (years * 12 + F.month(later) - F.month(earlier)).cast("int")


def month_range(first: Column, last: Column) -> Column:
    return F.sequence(first, last, F.expr("INTERVAL 1 MONTH"))


def day_bit(day: Column) -> Column:
    """One bit per day of month, so distinct days are a bit_or and a bit_count."""
    return F.call_function("shiftleft", F.lit(1), F.dayofmonth(day) - 1)
