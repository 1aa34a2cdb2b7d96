"""Numeric Column helpers: rounding, null-safe coercion, percentages, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(c: Column, digits: int = 0) -> Column:
    """Round half to even at ``digits`` decimals, as numpy does it:
    ``rint(x * 10**d) / 10**d``.  (Spark ``round`` is half-up; ``bround``
    rounds the decimal string, which differs at binary near-ties.)"""
    if digits == 0:
        return F.rint(c)
    scale = float(10 ** digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


_SPLIT = 134217729.0  # 2**27 + 1, Veltkamp split constant


def round_py(c: Column, digits: int) -> Column:
    """Python's ``round(x, digits)`` on the exact binary value of ``x``.

    ``p = fl(x * 10**d)`` is exact except near a .5 tie; the product's
    rounding error is recovered exactly with Dekker's split (plain double
    arithmetic), and decides ties: above -> up, below -> down, exact -> even.
    (Java's ``%.1f`` rounds the shortest decimal string half-up instead.)"""
    s = F.lit(float(10 ** digits))
    x = c.cast("double")
    p = x * s
    big = x * F.lit(_SPLIT)
    hi = big - (big - x)
    lo = x - hi
    err = (hi * s - p) + lo * s
    f = F.floor(p).cast("double")
    at_tie = (p - f) == F.lit(0.5)
    tie_value = F.when(err > 0, f + 1.0).when(err < 0, f).otherwise(F.rint(p))
    return F.when(at_tie, tie_value).otherwise(F.rint(p)) / s


def fmt_py(c: Column, digits: int) -> Column:
    """Python's ``f"{x:.{digits}f}"``."""
    return F.format_string(f"%.{digits}f", round_py(c, digits))


# A plain decimal: Spark's cast alone would also read "12d", "1f" and "0x1p3".
PLAIN_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def safe_double(c: Column, dtype: str | None = None) -> Column:
    """``coalesce(try_cast(c AS double), 0)`` with NaN -> 0.

    Numeric sources are cast directly; strings go through ``try_cast`` after
    trimming, so ``" 12 "`` -> 12 and ``"1,234"`` / ``"abc"`` -> 0.
    """
    if dtype is not None and dtype in ("double", "float", "int", "bigint", "smallint", "tinyint") \
            or (dtype or "").startswith("decimal"):
        x = c.cast("double")
    else:
        text = F.trim(c.cast("string"))
        x = F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double"))
    return F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x)


def pct(part: Column, total: Column) -> Column:
    """100 * part / total, 0 when total is 0."""
    return F.when(total == 0, F.lit(0.0)).otherwise(F.lit(100.0) * part.cast("double") / total.cast("double"))


def ln1p_pos(c: Column) -> Column:
    """log1p clamped at 0 so sums below -1 cannot yield null."""
    return F.log1p(F.greatest(c.cast("double"), F.lit(0.0)))


def format_int(c: Column) -> Column:
    """Integer with a space as thousands separator (half-even rounding)."""
    return F.replace(F.format_number(F.rint(c.cast("double")), 0), F.lit(","), F.lit(" "))


