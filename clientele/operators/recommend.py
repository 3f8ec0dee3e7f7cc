"""Service frequencies, recommendations and their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clientele.operators.joins import with_group_values
from clientele.operators.similarity import (
    first_members,
    served_profiles,
    service_scores,
    similar_to,
    staged_profiles,
    top_neighbours,
    top_service_scores,
)

TOP_SERVICES = 5


def client_service_freq(rows: DataFrame, client: str, service: str) -> DataFrame:
    """Times each client took each service; rows without either are left out.

    Keys are (client, service), combined before the shuffle, so neither a busy client
    nor a popular service is one group.
    """
    return (
        rows.filter(F.col(client).isNotNull() & F.col(service).isNotNull())
        .groupBy(F.col(client).alias("client"), F.col(service).alias("service"))
        .agg(F.count("*").alias("frequency"))
    )


def with_frequency(rows: DataFrame, client: str, service: str) -> DataFrame:
    """Every row with the frequency of its (client, service)."""
    return with_group_values(rows, [client, service], Frequency=F.count("*"))


def client_service_pivot(freq: DataFrame, services: list[str] | None = None) -> DataFrame:
    """Wide export: one row per client, one column per service, 0 where not taken.

    Without a list Spark looks the services up first and stops at
    ``spark.sql.pivotMaxValues``. A list must name every service: one that it lacks
    is an error, not a column left out.
    """
    if services is not None:
        other = freq.filter(F.col("service").isNotNull() & ~F.col("service").isin(*services)).select("service").first()
        if other is not None:
            raise ValueError(f"the list lacks the service {other.service}")
    return freq.groupBy("client").pivot("service", services).agg(F.sum("frequency")).na.fill(0)


def services_taken(vectors: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` services of each client in name order, as one text."""
    return vectors.select("client", F.array_join(F.slice(F.array_sort("items.service"), 1, n), ", ").alias("services_taken"))


def candidates(vectors: DataFrame, profiles: DataFrame, threshold: float) -> DataFrame:
    """Services a client has not taken but similar clients have: best similarity (the
    score) and number of those clients."""
    scores = service_scores(profiles, threshold).withColumnRenamed("client", "profile")
    return (
        staged_profiles(vectors, profiles)
        .join(scores, "profile")
        .select("client", "service", "score", "supporters")
    )


def rank_services(scores: DataFrame, n: int = TOP_SERVICES) -> DataFrame:
    """Best ``n`` services per client from finished scores: score first, then name."""
    order = Window.partitionBy("client").orderBy(F.desc("score"), "service")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def top_services(vectors: DataFrame, profiles: DataFrame, threshold: float, n: int = TOP_SERVICES) -> DataFrame:
    """Each client's best ``n`` new services, every service once.

    Ranked per profile, then handed to the profile's clients.
    """
    ranked = top_service_scores(profiles, threshold, n).withColumnRenamed("client", "profile")
    return staged_profiles(vectors, profiles).join(ranked, "profile").select("client", "service", "score", "rank")


def top_services_raw(vectors: DataFrame, profiles: DataFrame, threshold: float, n: int = TOP_SERVICES) -> DataFrame:
    """The first ``n`` entries when neighbours are read by descending similarity and
    each lists its services the client lacks; a service repeats once per neighbour.

    Every neighbour that offers something fills at least one entry, so ``n`` offering
    profiles and ``n`` clients of each are enough.
    """
    membership = staged_profiles(vectors, profiles)
    near = top_neighbours(profiles, threshold, n, offering=True)
    people = first_members(membership, n).select(F.col("profile").alias("_p"), F.col("client").alias("person"))
    items = profiles.select(F.col("client").alias("_q"), F.col("items.service").alias("services"))
    order = Window.partitionBy("profile").orderBy(F.desc("score"), "neighbour", "service")
    entries = (
        near.withColumnRenamed("client", "profile")
        .join(items.withColumnRenamed("services", "offered"), F.col("neighbour") == F.col("_q"))
        .drop("_q")
        .join(items.withColumnRenamed("services", "owned"), F.col("profile") == F.col("_q"))
        .select("profile", "neighbour", "similarity", F.array_except("offered", "owned").alias("new"))
        .join(people, F.col("neighbour") == F.col("_p"))
        .select(
            "profile",
            F.col("person").alias("neighbour"),
            F.explode("new").alias("service"),
            F.col("similarity").alias("score"),
        )
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
    )
    return membership.join(entries, "profile").select("client", "neighbour", "service", "score", "rank")


def recommend_for(client, freq: DataFrame, threshold: float) -> DataFrame:
    """New services for one client with their scores, without scoring anyone else.

    ``freq`` is read a few times and should be staged or a saved table.
    """
    near = similar_to(client, freq, threshold)
    owned = freq.filter(F.col("client") == client).select("service")
    return (
        freq.withColumnRenamed("client", "neighbour")
        .join(near, "neighbour")
        .join(owned, "service", "left_anti")
        .groupBy("service")
        .agg(F.max("similarity").alias("score"))
        .select(F.lit(client).alias("client"), "service", "score")
    )


def clients_with_recommendations(vectors: DataFrame, profiles: DataFrame, threshold: float) -> DataFrame:
    """Clients for whom a similar client has a new service: one such neighbour is enough."""
    served = served_profiles(profiles, threshold).select(F.col("client").alias("profile"))
    return staged_profiles(vectors, profiles).join(served, "profile", "left_semi").select("client")


def match_text(score: Column) -> Column:
    """'83%' from 0.8312, rounded half to even."""
    return F.concat(F.rint(score * 100).cast("int").cast("string"), F.lit("%"))


def confidence_report(top: DataFrame) -> DataFrame:
    """Service and match text of each client's top services."""
    return top.select(
        "client",
        "rank",
        F.col("service").alias("Service Description"),
        match_text(F.col("score")).alias("Confidence Match"),
    )


# The texts of the client message.
GREETING = "Dear %s,"
REASON = (
    "Because you've taken: %s in the past, we recommend the following services based on what similar customers "
    "like you have taken and enjoyed — it could be a great addition to your beauty routine!:"
)


def messages(top: DataFrame, taken: DataFrame) -> DataFrame:
    """Greeting, reason and numbered services for each client; a handful of rows per client."""
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("service"), F.lit(" - "), match_text(F.col("score")), F.lit(" Match"))
    listed = top.groupBy("client").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("rows"))
    return listed.join(taken, "client").select(
        "client",
        F.format_string(GREETING, F.col("client").cast("string")).alias("greeting"),
        F.format_string(REASON, "services_taken").alias("reason"),
        F.array_join("rows.line", "\n").alias("recommendations"),
    )
