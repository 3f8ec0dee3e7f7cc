"""RFM scoring per client or per row, and clustering."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from clientele.columns import LineColumns, RfmColumns, TicketColumns
from clientele.functions.numbers import AMOUNT
from clientele.functions.scoring import FEATURES
from clientele.operators import cluster, joins, rfm
from clientele.operators.visits import as_rfm, client_visits, latest_visit, with_recency
from clientele.session import stage
from clientele.sources.artefacts import load_rfm_model, save_rfm_model


def rfm_features(rows: DataFrame, cols: RfmColumns = RfmColumns()) -> DataFrame:
    """Recency, Frequency and Monetary per client.

    The rows are scanned and shuffled once; what is left has one row per client and
    is staged, because cut-off, quantiles and scores each read it.
    """
    visits = stage(client_visits(rows, cols), "client_visits")
    return as_rfm(with_recency(visits, latest_visit(visits), cols.client))


def score(features: DataFrame, cuts: rfm.Cuts | None = None) -> DataFrame:
    """Scores, segment and tier of every client; cuts are fitted unless given."""
    scored = rfm.with_scores(features, rfm.fit_cuts(features) if cuts is None else cuts)
    return rfm.with_tier(rfm.with_segment(scored))


def rfm_by_client(rows: DataFrame, cols: RfmColumns = RfmColumns()) -> DataFrame:
    """Every client counts once in the quintiles."""
    return score(rfm_features(rows, cols))


def rfm_of_sales(sales: DataFrame, scaler: cluster.Scaler | None = None, clustering: cluster.Clustering | None = None) -> DataFrame:
    """The whole client table of an export: attributes and averages of ``sales`` with scores,
    segment, tier and cluster.

    ``sales`` has one row per client, so everything here is a projection behind its staging;
    a model that is not given is fitted.
    """
    features = stage(as_rfm(sales), "sales_features")
    if scaler is None or clustering is None:
        fitted = fit_model(features)
        scaler, clustering = fitted.scaler, fitted.clustering
    return cluster.assign_features(score(features), scaler, clustering)


def rfm_by_row(rows: DataFrame, cols: RfmColumns = RfmColumns()) -> DataFrame:
    """Scores on every row that has a client with complete features; every row counts
    in the quintiles, so a client weighs as much as it has rows.

    The cuts are fitted per client with that weight. Only the features are joined to
    the rows; scores and names are computed behind the join, where they cost no shuffle.
    """
    features = rfm_features(rows, cols)
    cuts = rfm.fit_cuts(features, weight="Frequency")
    known = rows.filter(F.col(cols.client).isNotNull())
    return score(known.join(features.na.drop(subset=list(FEATURES)), cols.client), cuts)


def line_features(
    lines: DataFrame,
    tickets: DataFrame,
    line_cols: LineColumns = LineColumns(),
    ticket_cols: TicketColumns = TicketColumns(),
) -> DataFrame:
    """Features of the lines joined with their tickets, without joining line by line.

    Lines are combined per ticket first: how many, and their latest date. A line
    counts as a visit, at the time of day it has, and spends its ticket's total. Lines without a known client
    still count for the cut-off.
    """
    visited = line_cols.stamp if line_cols.stamp in lines.columns else line_cols.date
    per_ticket = lines.groupBy(F.col(line_cols.ticket).alias("_ticket")).agg(
        F.count("*").alias("_lines"), F.max(visited).alias("_latest")
    )
    owners = tickets.filter(F.col(ticket_cols.client).isNotNull())
    spent = F.col(ticket_cols.total).cast(AMOUNT) * F.col("_lines").cast("decimal(15,0)")
    visits = (
        per_ticket.join(owners, F.col("_ticket") == F.col(ticket_cols.ticket), "left")
        .groupBy(ticket_cols.client)
        .agg(
            F.sum("_lines").alias("NumVisits"),
            F.coalesce(F.sum(spent).cast("double"), F.lit(0.0)).alias("TotalSpend"),
            F.max("_latest").alias("LastVisit"),
        )
    )
    staged = stage(visits, "line_visits")
    return as_rfm(with_recency(staged, latest_visit(staged), ticket_cols.client))


def rfm_by_line(
    lines: DataFrame,
    tickets: DataFrame,
    line_cols: LineColumns = LineColumns(),
    ticket_cols: TicketColumns = TicketColumns(),
) -> DataFrame:
    """``rfm_by_row`` for lines joined with their tickets.

    The features go to the tickets first, so the lines are joined once.
    """
    features = line_features(lines, tickets, line_cols, ticket_cols)
    cuts = rfm.fit_cuts(features, weight="Frequency")
    complete = features.na.drop(subset=list(FEATURES))
    return score(joins.lines_of_clients(lines, tickets, complete, line_cols, ticket_cols), cuts)


@dataclass(frozen=True)
class RfmModel:
    """Everything needed to score and cluster other clients later."""

    cuts: rfm.Cuts
    scaler: cluster.Scaler
    clustering: cluster.Clustering

    def save(self, spark: SparkSession, path: str) -> None:
        save_rfm_model(spark, self.cuts, self.scaler, self.clustering, path)

    def predict(self, features: DataFrame, raw_features: bool = False) -> DataFrame:
        """Cluster, scores, segment and tier of every complete client.

        Asks the data for one row first: predicting nothing is an error.
        """
        complete = features.na.drop(subset=list(FEATURES))
        if complete.isEmpty():
            raise ValueError("no rows with Recency, Frequency and Monetary to predict")
        return score(cluster.assign_features(complete, self.scaler, self.clustering, raw_features), self.cuts)


def load_model(spark: SparkSession, path: str) -> RfmModel:
    return RfmModel(*load_rfm_model(spark, path))


def fit_model(
    features: DataFrame,
    k: int = 4,
    seed: int = 42,
    weight: str | None = None,
    names: Mapping[int, str] | None = None,
) -> RfmModel:
    """Cuts, scaler and clusters. ``weight`` = 'Frequency' fits at row grain."""
    weighted = features.withColumn("_weight", F.col(weight)) if weight else features
    rooted = cluster.with_cube_roots(weighted.na.drop(subset=list(FEATURES)))
    fitted = cluster.fit_scaler(rooted, "_weight" if weight else None)
    ready = stage(cluster.standardise(rooted, fitted), "standardised")
    clustering = cluster.fit(ready, k, seed, "_weight" if weight else None, names)
    return RfmModel(rfm.fit_cuts(features, weight), fitted, clustering)


def standardised_clusters(features: DataFrame, model: RfmModel) -> DataFrame:
    """Standardised features with their cluster, for the attribute chart."""
    rooted = cluster.with_cube_roots(features.na.drop(subset=list(FEATURES)))
    return cluster.assign(cluster.standardise(rooted, model.scaler), model.clustering)
