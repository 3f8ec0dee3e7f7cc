"""Features, scores at both grains, clusters and saved models."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clientele.columns import RfmColumns
from clientele.functions.scoring import FEATURES
from clientele.operators import cluster, rfm, sampling, visits
from clientele.plans import rfm as plan
from clientele.sources import artefacts, exports, tables

COLS = RfmColumns("who", "day", "paid")


def visit_rows(n_clients=60, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n_clients):
        for _ in range(int(rng.integers(1, 12 if c % 10 else 200))):
            day = dt.datetime(2023, 1, 1) + dt.timedelta(hours=int(rng.integers(0, 8000)))
            rows.append((f"k{c:02d}", None if rng.random() < 0.02 else day, float(np.round(rng.gamma(2, 40), 2))))
    rows += [(None, dt.datetime(2024, 1, 5, 3), 10.0)] * 5
    return rows


@pytest.fixture(scope="module")
def rows_df(spark):
    return spark.createDataFrame(visit_rows(), "who string, day timestamp_ntz, paid double").cache()


def pandas_scores(frame, grain):
    frame = frame.copy()
    cutoff = frame["day"].max()
    known = frame[frame["who"].notna()].copy()
    groups = known.groupby("who")
    known["Recency"] = (cutoff - groups["day"].transform("max")).dt.days
    known["Frequency"] = groups["who"].transform("count")
    known["Monetary"] = groups["paid"].transform("sum").round(2)
    if grain == "client":
        known = known.drop_duplicates("who").copy()
    cuts = known[list(FEATURES)].quantile([0.2, 0.4, 0.6, 0.8])

    def score(x, c, numbers):
        return next((n for n, q in zip(numbers, cuts[c]) if x <= q), numbers[-1])

    known.loc[:, "code"] = [
        f"{score(r, 'Recency', (5, 4, 3, 2, 1))}{score(f, 'Frequency', (1, 2, 3, 4, 5))}{score(m, 'Monetary', (1, 2, 3, 4, 5))}"
        for r, f, m in zip(known["Recency"], known["Frequency"], known["Monetary"])
    ]
    return known


def test_client_grain(rows_df):
    want = pandas_scores(rows_df.toPandas(), "client").set_index("who")["code"].to_dict()
    got = {r["who"]: r["RFM_Segment"] for r in plan.rfm_by_client(rows_df, COLS).collect()}
    assert got == want


def test_row_grain_weighs_clients_by_rows(rows_df):
    want = pandas_scores(rows_df.toPandas(), "row")
    got = plan.rfm_by_row(rows_df, COLS).toPandas()
    assert len(got) == len(want)
    assert got.groupby("who")["RFM_Segment"].agg(["nunique"]).max().item() == 1
    assert got.groupby("who")["RFM_Segment"].first().to_dict() == want.groupby("who")["code"].first().to_dict()
    by_client = pandas_scores(rows_df.toPandas(), "client").set_index("who")["code"].to_dict()
    assert got.groupby("who")["RFM_Segment"].first().to_dict() != by_client


def test_the_cut_off_sees_rows_without_a_client(rows_df):
    newest = rows_df.filter("who is not null").agg(F.max("day")).first()[0]
    recency = plan.rfm_features(rows_df, COLS).agg(F.min("Recency")).first()[0]
    assert recency == (dt.datetime(2024, 1, 5, 3) - newest).days


def test_client_features_is_the_same_in_one_plan(rows_df, rows):
    lazy = visits.as_rfm(visits.client_features(rows_df, COLS))
    assert rows(lazy, "who", *FEATURES) == rows(plan.rfm_features(rows_df, COLS), "who", *FEATURES)


def test_unpivot_and_shares(spark, rows_df, rows):
    features = plan.rfm_features(rows_df, COLS)
    assert visits.unpivot_features(features, ["who"]).count() == 3 * features.count()
    share = rfm.share(spark.createDataFrame([("a",), ("a",), ("b",)], "g string"), "g")
    assert rows(share) == [("a", 2, 66.7), ("b", 1, 33.3)]


@pytest.fixture(scope="module")
def features(rows_df):
    return plan.rfm_features(rows_df, COLS)


@pytest.fixture(scope="module")
def model(features):
    return plan.fit_model(features)


def test_scaler_matches_population_deviation(features):
    x = np.cbrt(features.toPandas()[list(FEATURES)].astype(float))
    fitted = cluster.fit_scaler(cluster.with_cube_roots(features))
    for c in FEATURES:
        assert np.allclose(fitted[c], (x[c].mean(), x[c].std(ddof=0)))
    weighted = cluster.fit_scaler(cluster.with_cube_roots(features.withColumn("w", F.col("Frequency"))), "w")
    w = features.toPandas()["Frequency"].to_numpy()
    for c in FEATURES:
        full = np.repeat(x[c].to_numpy(), w)
        assert np.allclose(weighted[c], (full.mean(), full.std()))


def test_constant_feature_is_not_divided_by_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (1.0, 4.0, 9.0)], "Recency double, Frequency double, Monetary double")
    fitted = cluster.fit_scaler(df)
    assert fitted["Recency"] == (1.0, 1.0)
    assert {r["Recency"] for r in cluster.standardise(df, fitted).collect()} == {0.0}


def test_clusters_keep_their_invariants(features, model):
    assigned = plan.standardised_clusters(features, model).toPandas()
    centres = np.array(model.clustering.centroids)
    x = assigned[list(FEATURES)].to_numpy()
    distances = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (assigned["Cluster"].to_numpy() == distances.argmin(axis=1)).all()
    assert sorted(assigned["Cluster"].unique()) == [0, 1, 2, 3]
    inertia, single = distances.min(axis=1).sum(), ((x - x.mean(axis=0)) ** 2).sum()
    assert inertia < 0.7 * single
    assert sorted(set(model.clustering.names.values())) == sorted(cluster.FIXED_NAMES.values())


def test_names_follow_the_centroids():
    centroids = [[1.0, 2.0, 0.0], [-1.0, 0.1, 0.0], [2.0, -1.0, 0.0], [-0.5, 3.0, 0.0]]
    names = cluster.name_clusters(centroids)
    assert names == {0: "At Risk Customers", 1: "New Customers", 2: "Churned Customers", 3: "Loyal Customers"}


def test_given_names_go_by_id(features):
    assert plan.fit_model(features, names=cluster.FIXED_NAMES).clustering.names == cluster.FIXED_NAMES


def test_nearest_centroid_ties_take_the_lowest_id(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0)], "Recency double, Frequency double, Monetary double")
    given = cluster.Clustering([[1.0, 0, 0], [-1.0, 0, 0]], {0: "a", 1: "b"})
    assert cluster.assign(df, given).first()["Cluster"] == 0


def test_profile_adds_up(features, model):
    profile = cluster.cluster_profile(cluster.assign_features(features, model.scaler, model.clustering)).toPandas()
    assert profile["Count"].sum() == features.count()
    assert abs(profile["Percent"].str.rstrip("%").astype(float).sum() - 100) < 0.5
    snake = cluster.cluster_snake(plan.standardised_clusters(features, model)).toPandas()
    assert len(snake) == 12


def test_saved_model_predicts_the_same(spark, features, model, tmp_path, rows):
    model.save(spark, str(tmp_path))
    loaded = plan.load_model(spark, str(tmp_path))
    cols = ("who", "RFM_Segment", "Segment", "Tier", "Cluster")
    assert rows(loaded.predict(features), *cols) == rows(model.predict(features), *cols)
    raw = loaded.predict(features, raw_features=True)
    assert raw.count() == features.count()


def test_row_grain_fit_weighs_clients(features, model):
    weighted = plan.fit_model(features, weight="Frequency")
    assert weighted.cuts != model.cuts
    assert len(weighted.clustering.centroids) == 4


def test_predicting_nothing_is_an_error(features, model):
    with pytest.raises(ValueError):
        model.predict(features.filter("who = 'nobody'"))


def test_tier_files(spark, rows_df, tmp_path):
    tiered = plan.rfm_by_client(rows_df, COLS).select("who", *FEATURES, "RFM_Score", "Tier")
    exports.write_tiers(tiered, str(tmp_path / "tiers"))
    folders = sorted(p.name for p in (tmp_path / "tiers").iterdir() if p.is_dir())
    assert folders == [f"Tier={t}" for t in sorted(["Platinum", "Gold", "Silver", "Bronze"])]
    schema = "who string, `Days since last visit` bigint, `Number of Visits` bigint, `Total Billed` double, RFM_Score int, AVB double"
    for tier in ("Platinum", "Bronze"):
        back = tables.read_csv(spark, str(tmp_path / "tiers" / f"Tier={tier}"), schema, "UTF-8").toPandas()
        assert len(back) == tiered.filter(F.col("Tier") == tier).count()
        assert (back["AVB"] == back["Total Billed"]).all()


def test_preview_takes_a_few_of_each_group(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 998, "big").otherwise("small").alias("g"), F.col("id").cast("string").alias("k"))
    counts = {r["g"]: r["count"] for r in sampling.preview(df, "g", "k").groupBy("g").count().collect()}
    assert counts == {"big": 3, "small": 2}
    assert sampling.sample_keys(df, "k", 10).collect() == sampling.sample_keys(df.repartition(7), "k", 10).collect()


def test_small_parameter_tables(spark, model, tmp_path):
    frame = artefacts.centroid_frame(spark, model.clustering)
    assert frame.count() == 4
    assert isinstance(frame.toPandas(), pd.DataFrame)


def test_lines_give_the_same_as_their_joined_rows(spark, rows):
    rng = np.random.default_rng(8)
    tickets = spark.createDataFrame(
        [(i, f"k{i % 23}" if i % 11 else None, None if i % 13 == 0 else float(i)) for i in range(150)] + [(7, "k1", 2.5)],
        "TicketID bigint, ClientID string, Total double",
    )
    lines = spark.createDataFrame(
        [
            (None if i % 17 == 0 else int(rng.integers(0, 170)), "x", dt.datetime(2023, 1, 1) + dt.timedelta(days=int(rng.integers(0, 300))))
            for i in range(500)
        ],
        "TicketID bigint, Total string, Bill_Date timestamp_ntz",
    )
    from clientele.operators.joins import lines_with_tickets

    joined = lines_with_tickets(lines, tickets.filter("ClientID is not null"))
    by_row = plan.rfm_by_row(joined, RfmColumns("ClientID", "Bill_Date", "ticket_total"))
    by_line = plan.rfm_by_line(lines, tickets)
    cols = ("TicketID", "ClientID", "Bill_Date", *FEATURES, "RFM_Segment", "Tier")
    assert rows(by_line, *cols) == rows(by_row, *cols)
