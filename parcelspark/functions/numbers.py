"""Scalar column helpers: rounding, tolerant parsing, safe change."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_even(c: Column | str, digits: int) -> Column:
    """Half-even rounding on doubles, as Python's and NumPy's ``round`` do.

    ``rint`` stays inside generated code, unlike ``bround`` on doubles which
    goes through BigDecimal for every row.
    """
    c = col(c).cast("double")
    return F.rint(c) if digits == 0 else F.rint(c * float(10**digits)) / float(10**digits)


def round_up(c: Column | str) -> Column:
    """Half-up rounding of a non-negative value to a bigint (SQL ``::int``)."""
    return F.floor(col(c) + F.lit(0.5)).cast("bigint")


def change(current: Column | str, previous: Column | str) -> Column:
    """``(current - previous) / previous``; null on a missing or zero divisor."""
    current, previous = col(current).cast("double"), col(previous).cast("double")
    return (current - previous) / F.nullif(previous, F.lit(0.0))


def clip(c: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(col(c), F.lit(low)), F.lit(high))


def nonblank(c: Column | str) -> Column:
    """Text with blanks treated as missing."""
    return F.nullif(F.trim(col(c)), F.lit(""))


def first_text(*cs: Column | str) -> Column:
    """First non-blank alternative, for feeds that renamed their keys."""
    return F.coalesce(*[nonblank(c) for c in cs])


def to_number(c: Column | str) -> Column:
    """'1,234.5' -> 1234.5; blank or junk -> null."""
    return F.replace(nonblank(c), F.lit(","), F.lit("")).try_cast("double")


def to_integer(c: Column | str) -> Column:
    """'1,234' -> 1234; '12345.0' -> 12345 (towards zero); junk -> null.

    The direct bigint cast comes first because a double loses digits above 2**53.
    """
    text = F.replace(nonblank(c), F.lit(","), F.lit(""))
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))


def saturating(count: Column, full_at: float, low: float, high: float) -> Column:
    """Confidence growing linearly from ``low`` to ``high`` at ``full_at`` samples."""
    share = F.least(count.cast("double"), F.lit(float(full_at))) / F.lit(float(full_at))
    return round_even(F.lit(low) + F.lit(high - low) * share, 3)


def percent_change(new: Column | str, old: Column | str) -> Column:
    """Change of whole numbers in percent, to two digits, halves away from zero; null where ``old`` is 0.

    Integer arithmetic, so that a half is exact.
    """
    base = F.col(old) if isinstance(old, str) else old
    rise = ((F.col(new) if isinstance(new, str) else new) - base).cast("decimal(20,0)")
    size = F.nullif(F.abs(base).cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    cents = F.floor((F.abs(rise) * 20000 + size) / (size * 2))
    return F.signum(rise.cast("double")) * F.signum(base.cast("double")) * cents.cast("double") / 100
