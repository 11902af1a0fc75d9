"""Scalar building blocks (X1–X23) as JVM-side column expressions.

All of them are plain ``pyspark.sql.functions`` compositions, so they stay in
whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def as_of_ts(as_of: str) -> Column:
    """The explicit "now" of a job (no operator reads the wall clock)."""
    return F.to_timestamp(F.lit(as_of))


def as_of_date(as_of: str) -> Column:
    return F.to_date(as_of_ts(as_of))


def dround(c: Column, n: int = 2) -> Column:
    """Round a double half away from zero on its binary value: round(x·10ⁿ)/10ⁿ.
    (A decimal is rounded exactly with ``F.round``; use this for doubles only.)"""
    m = float(10 ** n)
    return F.round(c * F.lit(m)) / F.lit(m)


def ratio(num: Column, den: Column) -> Column:
    """num / den in double arithmetic, NULL when den is 0 or NULL (NULLIF guard)."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def pct(num: Column, den: Column, n: int = 2) -> Column:
    """Guarded percentage, rounded to n places."""
    return dround(ratio(num, den) * F.lit(100.0), n)


def days_between(a: Column, b: Column) -> Column:
    """Fractional days between timestamps."""
    return (F.unix_micros(a) - F.unix_micros(b)).cast("double") / F.lit(86400e6)


def hours_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(a) - F.unix_micros(b)).cast("double") / F.lit(3600e6)


def to_int_rounded(c: Column) -> Column:
    """``::INTEGER`` of a fraction rounds half away from zero (a bare cast truncates)."""
    return F.round(c).cast("int")


def date_diff_days(a: Column, b: Column) -> Column:
    """``date - date`` as an integer number of days."""
    return F.datediff(a, b)


def dow_sunday0(c: Column) -> Column:
    """X11: day of week with 0 = Sunday."""
    return F.dayofweek(c) - 1


def array_length_pg(c: Column) -> Column:
    """ARRAY_LENGTH(a, 1) is NULL for an empty or NULL array."""
    return F.nullif(F.size(c), F.lit(0))


def digits_only(c: Column) -> Column:
    """REGEXP_REPLACE(x, '\\D', '', 'g')."""
    return F.regexp_replace(c, r"\D", "")


def clip01(c: Column) -> Column:
    """Clip into [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def null_safe_flag(cond: Column, *required: Column) -> Column:
    """a comparison flag that is NULL unless every input is present."""
    present = None
    for r in required:
        present = r.isNotNull() if present is None else (present & r.isNotNull())
    return F.when(present, cond)
