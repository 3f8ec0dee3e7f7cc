"""Parsing, calendar parts and ranges that reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def parse_datetime(c: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Timestamp from text with an explicit pattern; unreadable text becomes null."""
    return F.try_to_timestamp(c, F.lit(pattern)).cast("timestamp_ntz")


def in_year(c: Column, year: int) -> Column:
    """Half-open range instead of ``year(c) = y``: only the range is pushed to the scan.

    Date constants suit dates and timestamps: Spark casts the constant, not the column.
    """
    return (c >= F.expr(f"date'{year:04d}-01-01'")) & (c < F.expr(f"date'{year + 1:04d}-01-01'"))


def elapsed_days(earlier: Column, later: Column) -> Column:
    """Whole 24-hour days between two timestamps (not calendar midnights crossed)."""
    return F.timestamp_diff("DAY", earlier, later)


def month_name(c: Column) -> Column:
    return F.date_format(c, "MMMM")


def long_date(c: Column) -> Column:
    return F.date_format(c, "MMMM dd, yyyy")


def time_of_day(c: Column) -> Column:
    return F.date_format(c, "HH:mm:ss")
