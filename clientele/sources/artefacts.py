"""Fitted parameters and prepared tables as Parquet."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from clientele.functions.scoring import FEATURES
from clientele.operators.cluster import Clustering, Scaler
from clientele.operators.rfm import Cuts
from clientele.session import shuffles_dropped

FEATURE_PARAMETERS = "feature string, cuts array<double>, mean double, std double"
CENTROIDS = "cluster int, centroid array<double>, name string"


def save_tables(tables: Mapping[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        with shuffles_dropped(df.sparkSession):
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_tables(spark: SparkSession, names: list[str], path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def centroid_frame(spark: SparkSession, clustering: Clustering) -> DataFrame:
    rows = [(i, list(c), clustering.names[i]) for i, c in enumerate(clustering.centroids)]
    return spark.createDataFrame(rows, CENTROIDS)


def save_rfm_model(spark: SparkSession, cuts: Cuts, scaler: Scaler, clustering: Clustering, path: str) -> None:
    """Quintile cuts, scaler and centroids: two tables of a few rows."""
    rows = [(c, list(cuts[c]), *scaler[c]) for c in FEATURES]
    features = spark.createDataFrame(rows, FEATURE_PARAMETERS)
    save_tables({"features": features, "centroids": centroid_frame(spark, clustering)}, path)


def load_rfm_model(spark: SparkSession, path: str) -> tuple[Cuts, Scaler, Clustering]:
    tables = load_tables(spark, ["features", "centroids"], path)
    features = tables["features"].collect()  # one row per feature
    rows = tables["centroids"].orderBy("cluster").collect()  # k rows
    clustering = Clustering([list(r["centroid"]) for r in rows], {r["cluster"]: r["name"] for r in rows})
    scaler = {r["feature"]: (r["mean"], r["std"]) for r in features}
    return {r["feature"]: list(r["cuts"]) for r in features}, scaler, clustering
