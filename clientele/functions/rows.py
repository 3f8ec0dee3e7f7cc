"""One-row results inside other frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def one_row(df: DataFrame) -> Column:
    """The only row of ``df`` as a struct, for use in any other frame's expressions.

    A scalar subquery: computed once, sent as a value, and refused by Spark if there
    turns out to be a second row.
    """
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns])).scalar()
