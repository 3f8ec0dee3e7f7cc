"""Text clean-up, code labels and list texts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F


def upper_or_null(c: Column) -> Column:
    """Upper case; the text NAN stands for a missing value."""
    return F.nullif(F.upper(c), F.lit("NAN"))


def label(c: Column, labels: Mapping) -> Column:
    """Look a code up in a small fixed dictionary; unknown codes become null."""
    pairs = [F.lit(part) for item in labels.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), c)


def quoted_list(names: Column) -> Column:
    """'a', 'b', 'c' from an array of names."""
    return F.array_join(F.transform(names, lambda n: F.concat(F.lit("'"), n, F.lit("'"))), ", ")


def bracket_list(values: Column) -> Column:
    """[1, 2, 3] from an array."""
    return F.concat(F.lit("["), F.array_join(values.cast("array<string>"), ", "), F.lit("]"))
