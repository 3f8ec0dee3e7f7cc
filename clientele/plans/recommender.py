"""Recommenders over tickets (two tables) and bookings (four tables)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from clientele.columns import BookingColumns, LineColumns, TicketColumns
from clientele.operators import cleaning, recommend, similarity
from clientele.operators.joins import booking_service_chain, lines_with_tickets
from clientele.operators.sampling import sample_keys
from clientele.session import stage
from clientele.sources.artefacts import load_tables, save_tables

# The thresholds on offer and the recommended one.
THRESHOLDS = (0.25, 0.50, 0.75, 0.95)
DEFAULT_THRESHOLD = 0.75


def ticket_services(
    lines: DataFrame,
    tickets: DataFrame,
    line_cols: LineColumns = LineColumns(),
    ticket_cols: TicketColumns = TicketColumns(),
) -> DataFrame:
    """Lines that belong to a category group, with the client of their ticket."""
    grouped = cleaning.with_integer_ids(lines, line_cols.ticket).filter(F.col(line_cols.group).isNotNull())
    open_tickets = cleaning.with_integer_ids(
        cleaning.without_closed(tickets, ticket_cols.ticket), ticket_cols.ticket
    )
    return lines_with_tickets(grouped, open_tickets, line_cols, ticket_cols)


def ticket_service_freq(
    lines: DataFrame,
    tickets: DataFrame,
    line_cols: LineColumns = LineColumns(),
    ticket_cols: TicketColumns = TicketColumns(),
) -> DataFrame:
    rows = ticket_services(lines, tickets, line_cols, ticket_cols).select(ticket_cols.client, line_cols.item)
    return recommend.client_service_freq(stage(rows, "client_services"), ticket_cols.client, line_cols.item)


def booking_service_freq(
    booking_services: DataFrame,
    bookings: DataFrame,
    services: DataFrame,
    categories: DataFrame,
    cols: BookingColumns = BookingColumns(),
) -> DataFrame:
    chain = booking_service_chain(booking_services, bookings, services, categories, cols)
    rows = chain.select(cols.client, cols.service_name)
    return recommend.client_service_freq(stage(rows, "client_services"), cols.client, cols.service_name)


@dataclass(frozen=True)
class Recommender:
    """Staged client vectors and their distinct profiles."""

    vectors: DataFrame
    profiles: DataFrame

    def candidates(self, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
        return recommend.candidates(self.vectors, self.profiles, threshold)

    def clients(self, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
        """Clients with at least one candidate."""
        return recommend.clients_with_recommendations(self.vectors, self.profiles, threshold)

    def top(self, threshold: float = DEFAULT_THRESHOLD, n: int = recommend.TOP_SERVICES) -> DataFrame:
        """Best ``n`` new services per client, each service once."""
        return recommend.top_services(self.vectors, self.profiles, threshold, n)

    def top_raw(self, threshold: float = DEFAULT_THRESHOLD, n: int = recommend.TOP_SERVICES) -> DataFrame:
        """First ``n`` entries per client with a service repeated per neighbour."""
        return recommend.top_services_raw(self.vectors, self.profiles, threshold, n)

    def nearest(self, threshold: float = DEFAULT_THRESHOLD, k: int = 10) -> DataFrame:
        return similarity.nearest_clients(self.vectors, self.profiles, threshold, k)

    def similar_pairs(self, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
        """Similar profiles; with ``membership`` this tells all similar clients without
        writing out every pair of clients that share one vector."""
        return similarity.similar_profiles(self.profiles, threshold)

    def membership(self) -> DataFrame:
        return similarity.client_profiles(self.vectors, self.profiles)

    def taken(self) -> DataFrame:
        return recommend.services_taken(self.vectors)

    def save(self, path: str, floor: float = THRESHOLDS[0]) -> None:
        """Store the vectors and every score above the lowest threshold on offer.

        A service's score is its best similarity, so the recommendations at any
        higher threshold are the stored scores above it: one run serves all.
        """
        settings = self.vectors.sparkSession.range(1, numPartitions=1).select(F.lit(float(floor)).alias("floor"))
        save_tables({"vectors": self.vectors, "candidates": self.candidates(floor), "settings": settings}, path)

    def nearest_profiles(self, threshold: float = DEFAULT_THRESHOLD, k: int | None = None) -> DataFrame:
        """All similar other profiles of each profile, which grow with the square of what is alike,
        or only the ``k`` most similar ones: at most ``k`` rows each."""
        if k is None:
            return similarity.all_neighbours(self.profiles, threshold)
        return similarity.top_neighbours(self.profiles, threshold, k)

    def save_similarity(self, path: str, floor: float = THRESHOLDS[0], k: int | None = None) -> None:
        """Store each profile's similar ones, all or the ``k`` nearest, and which clients it stands for."""
        save_tables({"profile_similarity": self.nearest_profiles(floor, k), "client_profiles": self.membership()}, path)


def fit(freq: DataFrame, sample_n: int | None = None) -> Recommender:
    """Vectors of all clients, or of a reproducible sample of them."""
    if sample_n is not None:
        freq = freq.join(sample_keys(freq, "client", sample_n), "client", "left_semi")
    vectors = stage(similarity.client_vectors(stage(freq, "client_service_freq")), "client_vectors")
    return Recommender(vectors, stage(similarity.profiles_of(vectors), "client_profiles"))


def saved_scores(spark: SparkSession, path: str, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Recommendations from a saved recommender at a threshold not below its floor."""
    stored = load_tables(spark, ["candidates", "settings"], path)
    floor = stored["settings"].first()["floor"]
    if threshold < floor:
        raise ValueError(f"saved for thresholds from {floor}")
    return stored["candidates"].filter(F.col("score") > threshold).select("client", "service", "score")


def saved_top(
    spark: SparkSession, path: str, threshold: float = DEFAULT_THRESHOLD, n: int = recommend.TOP_SERVICES
) -> DataFrame:
    """The best ``n`` stored services of each client."""
    return recommend.rank_services(saved_scores(spark, path, threshold), n)
