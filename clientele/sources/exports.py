"""CSV exports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from clientele.operators.rfm import tier_export


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """Header plus rows; each task writes its own file."""
    df.write.option("header", True).option("encoding", encoding).csv(path)


def write_tiers(tiered: DataFrame, path: str) -> None:
    """One folder of CSV files per tier above the base tier.

    The rebalance hint gathers small tiers into few files and splits large ones.
    """
    export = tier_export(tiered).hint("rebalance", "Tier")
    export.write.option("header", True).partitionBy("Tier").csv(path)
