"""Per-client visit features: spend, number of visits, days since the last one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clientele.columns import RfmColumns
from clientele.functions.dates import elapsed_days
from clientele.functions.numbers import exact_sum
from clientele.functions.rows import one_row
from clientele.functions.scoring import FEATURES


def client_visits(rows: DataFrame, cols: RfmColumns = RfmColumns()) -> DataFrame:
    """One row per client, and one for rows without a client (their dates still count
    for the cut-off). Combined before the single shuffle on the client."""
    return rows.groupBy(cols.client).agg(
        F.count(cols.client).alias("NumVisits"),
        F.coalesce(exact_sum(F.col(cols.spend)), F.lit(0.0)).alias("TotalSpend"),
        F.max(cols.date).alias("LastVisit"),
    )


def latest_visit(visits: DataFrame) -> Column:
    """The latest date of staged visits as a constant."""
    latest = F.max("LastVisit").cast("string").alias("latest")
    return F.lit(visits.agg(latest).first()["latest"]).cast(dict(visits.dtypes)["LastVisit"])


def with_recency(visits: DataFrame, cutoff: Column, client: str = "ClientID") -> DataFrame:
    """Days between each client's last visit and the cut-off."""
    return visits.filter(F.col(client).isNotNull()).select(
        client,
        "TotalSpend",
        "NumVisits",
        elapsed_days(F.col("LastVisit"), cutoff).alias("DaysSinceLastVisit"),
    )


def client_features(tickets: DataFrame, cols: RfmColumns = RfmColumns()) -> DataFrame:
    """Features at client grain; the cut-off is a second, one-column scan."""
    latest = one_row(tickets.agg(F.max(cols.date).alias("latest")))["latest"]
    return with_recency(client_visits(tickets, cols), latest, cols.client)


def as_rfm(features: DataFrame) -> DataFrame:
    """Name the features Recency, Frequency and Monetary."""
    return features.withColumnsRenamed(
        {"DaysSinceLastVisit": "Recency", "NumVisits": "Frequency", "TotalSpend": "Monetary"}
    )


def unpivot_features(df: DataFrame, ids: list[str], features: tuple[str, ...] = FEATURES) -> DataFrame:
    """One row per id and attribute."""
    doubles = df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features])
    return doubles.unpivot(ids, list(features), "Attribute", "Value")
