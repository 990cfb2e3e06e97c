"""Column helpers whose results do not depend on row order or engine.

Money is added up as whole paise and every ratio of counts or paise is whole
number arithmetic before it is rounded, so a tie such as 10.005 always rounds
the same way and a re-run after a lost executor returns the same digits. Marts
show rupees as doubles, which hold every paisa up to 2^53 (90 trillion rupees).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def paise(rupees_col: Column) -> Column:
    """Whole paise of a two-decimal rupee amount."""
    return F.rint(rupees_col.cast("double") * 100.0).cast("bigint")


def rupees(paise_col: Column) -> Column:
    return paise_col.cast("double") / 100.0


def sum_rupees(rupees_col: Column) -> Column:
    """Aggregate: exact sum of rupee amounts."""
    return rupees(F.sum(paise(rupees_col)))


def ratio(num: Column, den: Column, digits: int) -> Column:
    """num / den for whole-number columns, half-up to `digits`; NULL on a zero denominator.

    Whole numbers of up to 20 digits throughout, so the result rounds alike at every size.
    """
    n, d = num.cast("decimal(20,0)"), F.nullif(den.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    twice = F.abs(n) * F.lit(2 * 10 ** digits).cast("decimal(12,0)") + d
    scaled = F.call_function("div", twice, d * F.lit(2).cast("decimal(1,0)"))
    return F.when(n < 0, -scaled).otherwise(scaled).cast("double") / float(10 ** digits)


def mean_paise(total: Column, n: Column) -> Column:
    """Mean of a paise total, half-up to whole paise."""
    count = F.nullif(n.cast("bigint"), F.lit(0).cast("bigint"))
    return F.call_function("div", total * 2 + count, count * 2)


def fine_mean(col: Column, digits: int) -> Column:
    """Aggregate: mean of a column carried at six decimals, rounded half-up."""
    micros = F.rint(col * 1e6).cast("bigint")
    return ratio(F.sum(micros), F.count(col) * 1000000, digits)


def mean_of_ints(col: Column, digits: int) -> Column:
    """Aggregate: mean of an integer column, rounded half-up."""
    return ratio(F.sum(col), F.count(col), digits)


def double_or_null(num: Column, den: Column) -> Column:
    """Plain floating ratio, NULL on a zero denominator."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def flag(cond: Column) -> Column:
    """1 where the condition holds, 0 where it fails or is unknown."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def tally(cond: Column) -> Column:
    """Aggregate: rows meeting a condition."""
    return F.count_if(cond)
