"""Client clusters: standardised features, k-means, names and profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F

from clientele.functions.numbers import AMOUNT, half_even, percent_text, ratio_text
from clientele.functions.rows import one_row
from clientele.functions.scoring import FEATURES
from clientele.functions.text import label

# The names of the four clusters, by cluster id.
FIXED_NAMES = {3: "New Customers", 2: "At Risk Customers", 1: "Loyal Customers", 0: "Churned Customers"}


Scaler = Mapping[str, tuple[float, float]]


@dataclass(frozen=True)
class Clustering:
    """Fitted parameters: a handful of numbers, whatever the size of the data."""

    centroids: Sequence[Sequence[float]]
    names: dict[int, str]


def with_cube_roots(features: DataFrame) -> DataFrame:
    """Features as cube roots, which tames their skew before scaling."""
    return features.withColumns({c: F.cbrt(F.col(c).cast("double")) for c in FEATURES})


def scaler(rooted: DataFrame, weight: str | None = None) -> DataFrame:
    """One row: mean and population deviation of each feature (0 becomes 1).

    With a ``weight`` a row counts that many times; the deviation then takes a second
    pass around the mean, because a one-pass sum of squares loses digits.
    """
    means = {c: f"{c}_mean" for c in FEATURES}
    if weight is None:
        spreads = {c: F.stddev_pop(c) for c in FEATURES}
        fitted = rooted.agg(
            *[F.avg(c).alias(m) for c, m in means.items()], *[s.alias(f"{c}_std") for c, s in spreads.items()]
        )
    else:
        w = F.col(weight).cast("double")
        sizes = {c: F.sum(F.when(F.col(c).isNotNull(), w)) for c in FEATURES}
        centre = rooted.agg(*[(F.sum(F.col(c) * w) / sizes[c]).alias(m) for c, m in means.items()])
        middle = one_row(centre)
        spreads = {c: F.sqrt(F.sum(w * F.pow(F.col(c) - middle[m], 2)) / sizes[c]) for c, m in means.items()}
        fitted = rooted.agg(*[s.alias(f"{c}_std") for c, s in spreads.items()]).withColumns(
            {m: middle[m] for m in means.values()}
        )
    return fitted.withColumns({f"{c}_std": F.when(F.col(f"{c}_std") == 0, 1.0).otherwise(F.col(f"{c}_std")) for c in FEATURES})


def fit_scaler(rooted: DataFrame, weight: str | None = None) -> Scaler:
    """Mean and deviation of each feature as numbers."""
    row = scaler(rooted, weight).first()
    return {c: (row[f"{c}_mean"], row[f"{c}_std"]) for c in FEATURES}


def standardise(rooted: DataFrame, fitted: Scaler) -> DataFrame:
    """(x - mean) / std for each feature."""
    return rooted.withColumns({c: (F.col(c) - F.lit(mean)) / F.lit(std) for c, (mean, std) in fitted.items()})


def fit(
    standardised: DataFrame,
    k: int = 4,
    seed: int = 42,
    weight: str | None = None,
    names: Mapping[int, str] | None = None,
) -> Clustering:
    """k-means over the standardised features; the input should be staged.

    Clusters are named by their centroids, or by id with given ``names`` (FIXED_NAMES).
    """
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features", handleInvalid="skip")
    kmeans = KMeans(k=k, seed=seed, maxIter=100, featuresCol="features")
    if weight:
        kmeans.setWeightCol(weight)
    columns = [*FEATURES, *([weight] if weight else [])]
    model = kmeans.fit(vectors.transform(standardised.select(*columns)))
    centroids = [[float(x) for x in centre] for centre in model.clusterCenters()]
    return Clustering(centroids, dict(names) if names else name_clusters(centroids))


def name_clusters(centroids: Sequence[Sequence[float]]) -> dict[int, str]:
    """Names for four clusters by where they lie.

    The two with the most recent visits are Loyal (more visits) and New; the other
    two are At Risk (more visits) and Churned. Ids are arbitrary, places are not.
    """
    if len(centroids) != len(FIXED_NAMES):
        return {i: f"Cluster {i}" for i in range(len(centroids))}
    by_recency = sorted(range(4), key=lambda i: (centroids[i][0], i))

    def more_visits(pair: Sequence[int]) -> list[int]:
        return sorted(pair, key=lambda i: (-centroids[i][1], i))

    loyal, new = more_visits(by_recency[:2])
    at_risk, churned = more_visits(by_recency[2:])
    return {loyal: "Loyal Customers", new: "New Customers", at_risk: "At Risk Customers", churned: "Churned Customers"}


def _squared_distance(centroid: Sequence[float]) -> Column:
    return sum(((F.col(c) - float(x)) * (F.col(c) - float(x)) for c, x in zip(FEATURES, centroid)), F.lit(0.0))


def assign(standardised: DataFrame, clustering: Clustering) -> DataFrame:
    """Nearest centroid per row (the lowest id on a tie) and its name; no shuffle."""
    distances = [
        F.struct(_squared_distance(centroid).alias("d"), F.lit(i).alias("cluster"))
        for i, centroid in enumerate(clustering.centroids)
    ]
    return standardised.withColumn("Cluster", F.array_min(F.array(*distances))["cluster"]).withColumn(
        "Cluster Segment", label(F.col("Cluster"), clustering.names)
    )


def assign_features(features: DataFrame, fitted: Scaler, clustering: Clustering, raw_features: bool = False) -> DataFrame:
    """Cluster of every row, next to its unscaled features.

    ``raw_features`` scales the features without taking cube roots first, as the
    prediction of a saved model did in the application this replaces.
    """
    plain = features.na.drop(subset=list(FEATURES))
    kept = plain.withColumns({f"_{c}": F.col(c) for c in FEATURES})
    rooted = kept.withColumns({c: F.col(c).cast("double") for c in FEATURES}) if raw_features else with_cube_roots(kept)
    assigned = assign(standardise(rooted, fitted), clustering)
    return assigned.withColumns({c: F.col(f"_{c}") for c in FEATURES}).drop(*[f"_{c}" for c in FEATURES])


def _cluster_means(assigned: DataFrame, *group: str) -> DataFrame:
    """Size, mean features and relative importance per cluster in one pass.

    The population means come from the clusters' own sums; that window spans the k
    rows left after the aggregation.
    """
    sums = [F.sum(F.col(c).cast(AMOUNT)).alias(f"_sum_{c}") for c in FEATURES]
    sizes = [F.count(c).alias(f"_n_{c}") for c in FEATURES]
    stats = assigned.groupBy(*group).agg(F.count("*").alias("Count"), *sums, *sizes)
    clusters = Window.partitionBy()
    columns = [F.sum("Count").over(clusters).alias("Total")]
    for c in FEATURES:
        mean = F.col(f"_sum_{c}").cast("double") / F.col(f"_n_{c}")
        population = F.sum(f"_sum_{c}").over(clusters).cast("double") / F.sum(f"_n_{c}").over(clusters)
        columns += [mean.alias(c), (mean / population - 1).alias(f"Relative {c}")]
    return stats.select(*group, "Count", *columns)


def relative_importance(assigned: DataFrame) -> DataFrame:
    """Cluster mean over population mean, minus 1, per feature."""
    means = _cluster_means(assigned, "Cluster Segment")
    return means.select("Cluster Segment", *[f"Relative {c}" for c in FEATURES])


def cluster_profile(assigned: DataFrame) -> DataFrame:
    """Size, share, mean features and relative importance of every cluster."""
    return _cluster_means(assigned, "Cluster", "Cluster Segment").select(
        "Cluster",
        "Cluster Segment",
        "Count",
        percent_text(F.col("Count") / F.col("Total") * 100).alias("Percent"),
        half_even(F.col("Recency")).alias("Avg_Days_Since_Last_Visit"),
        half_even(F.col("Frequency")).alias("Avg_Num_Visits"),
        half_even(F.col("Monetary")).alias("Avg_Bill_Value"),
        *[ratio_text(F.col(f"Relative {c}")).alias(f"Relative {c}") for c in FEATURES],
    )


def cluster_snake(assigned_standardised: DataFrame) -> DataFrame:
    """Mean standardised value per attribute and cluster; averaged before unpivoting."""
    means = assigned_standardised.groupBy("Cluster Segment").agg(*[F.avg(c).alias(c) for c in FEATURES])
    return means.unpivot(["Cluster Segment"], list(FEATURES), "Attribute", "Value")
