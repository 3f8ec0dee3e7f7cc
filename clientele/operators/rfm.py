"""Scores, segments and tiers from features and quintile cuts, and their profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from clientele.functions import scoring
from clientele.functions.numbers import exact_mean, half_even
from clientele.functions.rows import one_row
from clientele.operators.quantiles import exact_quantiles


Cuts = Mapping[str, Sequence[float]]


def rfm_quantiles(features: DataFrame, weight: str | None = None) -> DataFrame:
    """One row: the four quintile cuts of each feature."""
    return exact_quantiles(features, scoring.FEATURES, scoring.QUINTILES, weight)


def fit_cuts(features: DataFrame, weight: str | None = None) -> Cuts:
    """The cuts as numbers, four per feature, for scoring now or later."""
    row = rfm_quantiles(features, weight).first()
    return {c: list(row[c] or [None] * len(scoring.QUINTILES)) for c in scoring.FEATURES}


def with_scores(features: DataFrame, cuts: Cuts) -> DataFrame:
    """R, F, M bands, their digits and their sum: comparisons with constants, no join."""
    r = scoring.band(F.col("Recency"), cuts["Recency"], highest_first=True)
    f = scoring.band(F.col("Frequency"), cuts["Frequency"])
    m = scoring.band(F.col("Monetary"), cuts["Monetary"])
    return features.withColumns({"R": r, "F": f, "M": m}).withColumns(
        {
            "RFM_Segment": scoring.digits(F.col("R"), F.col("F"), F.col("M")),
            "RFM_Score": F.col("R") + F.col("F") + F.col("M"),
        }
    )


def with_segment(scored: DataFrame) -> DataFrame:
    named = scored.withColumn("Segment", scoring.segment(F.col("R"), F.col("F")))
    return named.withColumn("Description", scoring.segment_description(F.col("Segment")))


def with_tier(scored: DataFrame) -> DataFrame:
    named = scored.withColumn("Tier", scoring.tier(F.col("RFM_Score")))
    return named.withColumn("Tier_Description", scoring.tier_description(F.col("Tier")))


def share(df: DataFrame, group: str) -> DataFrame:
    """Rows per group and their percentage, one decimal; one pass over the rows."""
    counts = df.groupBy(group).agg(F.count("*").alias("Count"))
    total = one_row(counts.agg(F.sum("Count").alias("total")))["total"]
    return counts.select(group, "Count", half_even(F.col("Count") / total * 100).alias("Percent"))


def _profile(df: DataFrame, group: str, description: Column) -> DataFrame:
    return (
        df.groupBy(group)
        .agg(
            F.count("*").alias("Customer_Count"),
            exact_mean(F.col("Recency")).alias("Avg_Days_Since_Last_Visit"),
            exact_mean(F.col("Frequency")).alias("Avg_Visits"),
            exact_mean(F.col("Monetary")).alias("Avg_Bill_Value"),
        )
        .withColumn("Description", description)
    )


def segment_profile(segmented: DataFrame) -> DataFrame:
    return _profile(segmented, "Segment", scoring.segment_description(F.col("Segment")))


def tier_profile(tiered: DataFrame) -> DataFrame:
    return _profile(tiered, "Tier", scoring.tier_description(F.col("Tier")))


# The column names of an exported tier.
EXPORT_NAMES = {
    "Recency": "Days since last visit",
    "Frequency": "Number of Visits",
    "Monetary": "Total Billed",
}


def tier_export(tiered: DataFrame) -> DataFrame:
    """Clients above the base tier with the names of the export.

    AVB is the client's mean of Total Billed inside the tier. All rows of a client
    carry the same value, so the mean is the value itself and needs no shuffle.
    """
    renamed = tiered.filter(F.col("Tier") != scoring.BASE_TIER).withColumnsRenamed(EXPORT_NAMES)
    return renamed.withColumn("AVB", F.col("Total Billed"))
