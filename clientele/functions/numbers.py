"""Casts, exact money sums, rounding and number texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Amounts and quantities are summed exactly to this scale, so sums do not depend on the order of the rows.
AMOUNT = "decimal(22,6)"


def safe_bigint(c: Column) -> Column:
    """Integer id from text; anything that is not a whole number becomes null.

    Plain digits, also with a point and zeros behind them, are cast as they are, which keeps ids beyond 2**53
    and fails for no row (a cast that fails costs an exception). Other spellings take the detour over double.
    """
    as_double = c.try_cast("double")
    whole = F.when(as_double == F.floor(as_double), as_double.try_cast("bigint"))
    plain = F.when(c.rlike(r"^[+-]?\d{1,18}$"), c.cast("bigint")).when(c.rlike(r"^[+-]?\d{1,18}\.0*$"), F.substring_index(c, ".", 1).cast("bigint"))
    return plain.when(c.rlike(r"\d"), F.coalesce(c.try_cast("bigint"), whole))


def exact_sum(c: Column, kind: str = AMOUNT) -> Column:
    """Sum of amounts or quantities that does not depend on the order of the rows; ``kind`` sets the scale."""
    return F.sum(c.cast(kind)).cast("double")


def exact_mean(c: Column, weight: Column | None = None) -> Column:
    """Mean of whole numbers or amounts, summed as decimals."""
    if weight is None:
        return F.sum(c.cast(AMOUNT)).cast("double") / F.count(c)
    weight = weight.cast("decimal(15,0)")
    return F.sum(c.cast(AMOUNT) * weight).cast("double") / F.sum(F.when(c.isNotNull(), weight)).cast("double")


def half_even(c: Column, decimals: int = 1) -> Column:
    """Round half to even after scaling, the NumPy rule."""
    scale = 10**decimals
    return F.rint(c * scale) / scale


def percent_text(c: Column, decimals: int = 1) -> Column:
    """'12.3%' from 12.34 (the value is already in percent)."""
    return F.format_string(f"%.{decimals}f%%", half_even(c, decimals))


def ratio_text(c: Column) -> Column:
    """'12%' from 0.123."""
    return F.format_string("%.0f%%", F.rint(c * 100))


def money_text(c: Column) -> Column:
    return F.concat(F.lit("₹"), F.format_number(c, 2))


def count_text(c: Column) -> Column:
    return F.format_number(c, 0)


def plain_text(c: Column) -> Column:
    """A number as text without trailing zeros, whole ones without a decimal point."""
    return F.regexp_replace(c.cast(AMOUNT).cast("string"), r"\.?0+$", "")
