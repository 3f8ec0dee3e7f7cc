"""Similarity and recommendations against brute force, both ways of meeting."""

import math
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clientele.operators import cosine_blocks, recommend, similarity
from clientele.plans import recommender


def sparse_baskets(seed=3, clients=240, services=150):
    """Few services per client, some popular, many copies of one vector."""
    rng = np.random.default_rng(seed)
    weights = 1 / np.arange(1, services + 1)
    weights /= weights.sum()
    out = {}
    for i in range(clients):
        if i % 3 == 0:
            out[f"c{i:04d}"] = {"s000": 1}
            continue
        n = int(rng.integers(1, 5))
        chosen = rng.choice(services, size=n, replace=False, p=weights)
        out[f"c{i:04d}"] = {f"s{c:03d}": int(rng.integers(1, 6)) for c in chosen}
    return out


def dense_baskets(seed=4, clients=90, services=9):
    rng = np.random.default_rng(seed)
    out = {}
    for i in range(clients):
        counts = rng.integers(0, 4, services)
        counts[rng.integers(0, services)] = 1
        out[f"c{i:04d}"] = {f"s{c}": int(x) for c, x in enumerate(counts) if x}
    return out


def cosine(a, b):
    dot = float(sum(x * b[s] for s, x in a.items() if s in b))
    norms = float(sum(x * x for x in a.values())) * float(sum(x * x for x in b.values()))
    return dot / math.sqrt(norms)


def brute_pairs(baskets, threshold):
    names = sorted(baskets)
    return {
        (a, b): s
        for i, a in enumerate(names)
        for b in names[i + 1 :]
        if (s := cosine(baskets[a], baskets[b])) > threshold
    }


def brute_entries(baskets, threshold):
    """client -> [(score, neighbour, service)] in reading order."""
    entries = defaultdict(list)
    for (a, b), s in brute_pairs(baskets, threshold).items():
        for x, y in ((a, b), (b, a)):
            entries[x] += [(-s, y, service) for service in baskets[y] if service not in baskets[x]]
    return {c: sorted(e) for c, e in entries.items() if e}


def frame(spark, baskets):
    data = [(c, s, n) for c, b in baskets.items() for s, n in b.items()]
    return spark.createDataFrame(data, "client string, service string, frequency bigint")


@pytest.fixture(scope="module", params=["sparse", "dense", "sparse small blocks", "dense small blocks"])
def case(request, spark):
    baskets = sparse_baskets() if request.param.startswith("sparse") else dense_baskets()
    patch = pytest.MonkeyPatch()
    if request.param.endswith("small blocks"):
        patch.setattr(similarity, "BLOCK_ROWS", 16)
        patch.setattr(cosine_blocks, "TILE_ROWS", 5)
        patch.setattr(cosine_blocks, "MAX_ENTRIES", 40)
    fitted = recommender.fit(frame(spark, baskets))
    yield baskets, fitted
    patch.undo()


THRESHOLDS = [0.0, 0.5, 0.75]


@pytest.mark.parametrize("threshold", THRESHOLDS)
def test_pairs_of_all_clients(case, threshold):
    baskets, fitted = case
    profile = {r["client"]: r["profile"] for r in fitted.membership().collect()}
    pairs = {(r["client_a"], r["client_b"]): r["similarity"] for r in fitted.similar_pairs(threshold).collect()}
    assert set(profile) == set(baskets)
    for client, representative in profile.items():
        assert baskets[client] == baskets[representative]
    expanded = {}
    for a, b in brute_pairs(baskets, -1.0):
        p, q = sorted((profile[a], profile[b]))
        s = 1.0 if p == q else pairs.get((p, q))
        if s is not None and s > threshold:
            expanded[a, b] = s
    assert expanded == brute_pairs(baskets, threshold)


def test_each_pair_is_found_once(case):
    _, fitted = case
    counts = Counter((r["client_a"], r["client_b"]) for r in fitted.similar_pairs(0.3).collect())
    assert counts and max(counts.values()) == 1


@pytest.mark.parametrize("threshold", THRESHOLDS)
def test_candidates(case, threshold):
    baskets, fitted = case
    want = {}
    for client, entries in brute_entries(baskets, threshold).items():
        for service in {e[2] for e in entries}:
            scores = [-e[0] for e in entries if e[2] == service]
            want[client, service] = (max(scores), len(scores))
    got = {(r["client"], r["service"]): (r["score"], r["supporters"]) for r in fitted.candidates(threshold).collect()}
    assert got == want
    assert all(service not in baskets[client] for client, service in got)


def test_raw_top_repeats_services_in_neighbour_order(case):
    baskets, fitted = case
    got = defaultdict(list)
    for r in sorted(fitted.top_raw(0.5).collect(), key=lambda r: r["rank"]):
        got[r["client"]].append((-r["score"], r["neighbour"], r["service"]))
    assert dict(got) == {c: e[:5] for c, e in brute_entries(baskets, 0.5).items()}


def test_top_lists_every_service_once(case):
    baskets, fitted = case
    want = {}
    for client, entries in brute_entries(baskets, 0.5).items():
        best = {}
        for s, _, service in entries:
            best[service] = min(best.get(service, 0), s)
        want[client] = sorted((s, service) for service, s in best.items())[:5]
    got = defaultdict(list)
    for r in sorted(fitted.top(0.5).collect(), key=lambda r: r["rank"]):
        got[r["client"]].append((-r["score"], r["service"]))
    assert dict(got) == want


def test_nearest(case):
    baskets, fitted = case
    near = defaultdict(list)
    for (a, b), s in brute_pairs(baskets, 0.25).items():
        near[a].append((-s, b))
        near[b].append((-s, a))
    got = defaultdict(list)
    for r in sorted(fitted.nearest(0.25, k=4).collect(), key=lambda r: r["rank"]):
        got[r["client"]].append((-r["similarity"], r["neighbour"]))
    assert dict(got) == {c: sorted(n)[:4] for c, n in near.items()}


def test_one_client_without_the_grid(spark, case):
    baskets, fitted = case
    client = sorted(baskets)[1]
    alone = {(r["service"], r["score"]) for r in recommend.recommend_for(client, frame(spark, baskets), 0.5).collect()}
    every = {(r["service"], r["score"]) for r in fitted.candidates(0.5).collect() if r["client"] == client}
    assert alone == every


def test_the_cheaper_way_is_taken(spark):
    def counted(baskets):
        fitted = recommender.fit(frame(spark, baskets))
        _, sizes = similarity._by_service(fitted.profiles, 0.75)
        return sum(r["n"] ** 2 for r in sizes.collect()), fitted.profiles.count() ** 2

    by_service, together = counted(sparse_baskets())
    assert by_service < together / 4
    by_service, together = counted(dense_baskets())
    assert by_service > together


def test_blocks_that_cannot_be_similar_make_no_cell(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(2)
    data = {}
    for i in range(400):  # ten camps around a service each, all with some of one common service
        camp, extra = f"s{i % 10}", f"x{int(rng.integers(0, 40))}"
        data[f"c{i:03d}"] = {camp: int(rng.integers(20, 40)), "common": int(rng.integers(1, 4)), extra: int(rng.integers(1, 9))}
    fitted = recommender.fit(frame(spark, data))
    together = fitted.profiles.withColumn("group", F.lit(None).cast("string"))
    placed = similarity.in_blocks(together, 25)
    bounds = similarity.block_bounds(placed)
    cells = similarity.block_cells(bounds, 0.75)
    blocks = placed.select("block").distinct().count()
    kept = cells.count()
    assert blocks >= 20 and kept <= blocks * (blocks + 1) / 2 / 3
    assert {tuple(r) for r in cells.filter("i = j").select("i").collect()} == {tuple(r) for r in placed.select("block").distinct().collect()}
    pairs = {(r["client_a"], r["client_b"]): r["similarity"] for r in fitted.similar_pairs(0.75).collect()}
    profile = {r["client"]: r["profile"] for r in fitted.membership().collect()}
    want = {(a, b): s for (a, b), s in brute_pairs(data, 0.75).items() if profile[a] == a and profile[b] == b}
    assert pairs == want


def test_cells_are_packed_into_bounded_tasks(spark, monkeypatch):
    baskets = sparse_baskets(seed=6)
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 4)
    want = {tuple(r) for r in recommender.fit(frame(spark, baskets)).similar_pairs(0.5).collect()}
    monkeypatch.setattr(similarity, "MAX_TASKS", 3)
    found = recommender.fit(frame(spark, baskets)).similar_pairs(0.5)
    assert found.rdd.getNumPartitions() <= 3
    assert {tuple(r) for r in found.collect()} == want


def test_clients_with_candidates(case):
    baskets, fitted = case
    assert {r["client"] for r in fitted.clients(0.5).collect()} == set(brute_entries(baskets, 0.5))


def test_known_cosines(spark):
    baskets = {"a": {"x": 1}, "b": {"x": 2}, "c": {"x": 1, "y": 1}}
    fitted = recommender.fit(frame(spark, baskets))
    pairs = {(r["client_a"], r["client_b"]): r["similarity"] for r in fitted.similar_pairs(0.0).collect()}
    assert pairs == {("a", "b"): 1.0, ("a", "c"): 1 / math.sqrt(2), ("b", "c"): 2 / math.sqrt(8)}
    got = {(r["client"], r["service"]) for r in fitted.candidates(0.5).collect()}
    assert got == {("a", "y"), ("b", "y")}  # the parallel pair a, b offers nothing


def test_threshold_is_strict_and_monotone(spark):
    baskets = sparse_baskets(seed=9, clients=60)
    fitted = recommender.fit(frame(spark, baskets))
    seen = None
    for threshold in recommender.THRESHOLDS:
        found = {(r["client"], r["service"]) for r in fitted.candidates(threshold).collect()}
        assert seen is None or found <= seen
        seen = found
    quarter = recommender.fit(frame(spark, {"a": {"x": 1, "y": 1}, "b": {"y": 1, "z": 1}}))
    assert quarter.similar_pairs(0.5).count() == 0
    assert quarter.similar_pairs(0.49).count() == 1


def test_negative_threshold_is_refused(spark):
    with pytest.raises(ValueError):
        recommender.fit(frame(spark, {"a": {"x": 1}})).similar_pairs(-0.1)


def test_saved_recommender_serves_higher_thresholds(spark, tmp_path):
    baskets = sparse_baskets(seed=5, clients=120)
    fitted = recommender.fit(frame(spark, baskets))
    fitted.save(str(tmp_path))
    fitted.save_similarity(str(tmp_path))
    for threshold in (0.25, 0.75):
        stored = {tuple(r) for r in recommender.saved_scores(spark, str(tmp_path), threshold).collect()}
        fresh = {(r["client"], r["service"], r["score"]) for r in fitted.candidates(threshold).collect()}
        assert stored == fresh
    stored = {tuple(r) for r in recommender.saved_top(spark, str(tmp_path), 0.75).collect()}
    assert stored == {tuple(r) for r in fitted.top(0.75).collect()}
    with pytest.raises(ValueError):
        recommender.saved_scores(spark, str(tmp_path), 0.1)
    assert spark.read.parquet(str(tmp_path / "profile_similarity")).count() == fitted.nearest_profiles(0.25).count()


def test_sample_is_part_of_the_clients(spark):
    baskets = dense_baskets()
    whole = {(r["client_a"], r["client_b"]) for r in recommender.fit(frame(spark, baskets)).similar_pairs(0.5).collect()}
    sampled = recommender.fit(frame(spark, baskets), sample_n=30)
    assert sampled.vectors.count() == 30
    assert {(r["client_a"], r["client_b"]) for r in sampled.similar_pairs(0.5).collect()} <= whole
    assert recommender.fit(frame(spark, baskets), sample_n=10_000).vectors.count() == len(baskets)


def test_nearest_profiles_are_the_best_of_all_pairs(spark):
    rng = np.random.default_rng(8)
    data = {f"c{i}": {f"s{j}": int(n) for j, n in enumerate(rng.integers(0, 3, 6)) if n} for i in range(40)}
    fitted = recommender.fit(frame(spark, {c: b for c, b in data.items() if b}))
    both = [(r["client_a"], r["client_b"], r["similarity"]) for r in fitted.similar_pairs(0.3).collect()]
    want = {}
    for a, b, s in both + [(b, a, s) for a, b, s in both]:
        want.setdefault(a, []).append((-s, b))
    found = {}
    for r in fitted.nearest_profiles(0.3, 4).collect():
        found.setdefault(r["client"], []).append((-r["similarity"], r["neighbour"]))
    assert {c: sorted(v) for c, v in found.items()} == {c: sorted(v)[:4] for c, v in want.items()}


def test_all_similar_profiles_are_found_not_only_the_nearest(spark, tmp_path):
    import __spark_entry__

    weights = [[1 + i % 4, 2, 3, 5 + i] for i in range(14)]  # all alike, so each has more than ten partners
    parts = [(i, f"Brand#{i}", "T", 1) for i in range(1, 5)]
    orders = [(c, c, 1.0) for c in range(1, 15)]
    lines = [(c, s, 1, "F") for c, w in enumerate(weights, 1) for s, n in enumerate(w, 1) for _ in range(n)]
    tables = {
        "part": (parts, "p_partkey long, p_brand string, p_type string, p_size int"),
        "orders": (orders, "o_orderkey long, o_custkey long, o_totalprice double"),
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linestatus string"),
    }
    for name, (rows, schema) in tables.items():
        data = spark.createDataFrame(rows, schema)
        if name == "orders":
            data = data.withColumn("o_orderdate", F.expr("timestamp_ntz'1997-01-01 00:00:00'"))
        if name == "lineitem":
            data = data.selectExpr("*", "1.0D AS l_quantity", "1.0D AS l_extendedprice", "timestamp_ntz'1997-01-01 00:00:00' AS l_shipdate")
        data.write.parquet(str(tmp_path / f"{name}.parquet"))
    baskets = {str(c): {f"Brand#{s}": n for s, n in enumerate(w, 1)} for c, w in enumerate(weights, 1)}
    want = {p: s for (a, b), s in brute_pairs(baskets, 0.75).items() for p in ((a, b), (b, a))}
    assert max(Counter(a for a, _ in want).values()) > 10 and len({tuple(sorted(b.items())) for b in baskets.values()}) == 14
    found = __spark_entry__.queries()["client_similarity"](spark, str(tmp_path)).collect()
    assert len(found) == len(want) and {(r["client"], r["neighbour"]): r["similarity"] for r in found} == want


def test_a_list_of_services_must_be_complete(spark):
    freq = spark.createDataFrame([("a", "x", 1), ("a", "y", 2)], "client string, service string, frequency long")
    with pytest.raises(ValueError, match="lacks the service y"):
        recommend.client_service_pivot(freq, ["x"])


def test_blocks_stay_small_however_many_profiles():
    for rows in (10, 10**6, 10**9):
        assert rows / similarity.grid_size(rows, 8) <= similarity.BLOCK_ROWS


def test_scores_and_nearest_do_not_pass_through_all_pairs(spark, monkeypatch):
    baskets = dense_baskets(seed=12, clients=120)
    fitted = recommender.fit(frame(spark, baskets))
    monkeypatch.setattr(similarity, "similar_profiles", lambda *_: pytest.fail("all pairs were asked for"))
    n, k = fitted.profiles.count(), 3
    seats = similarity.stripes(fitted.profiles, 0.25)
    times = seats.filter("side = 0").groupBy("client").count().agg(F.max("count")).first()[0]
    assert times == 1  # all together: the rows of a stripe are in one task
    near = seats.mapInArrow(cosine_blocks.nearest_kernel(0.25, k, False), "client string, neighbour string, similarity double")
    assert n < near.count() < n * k * 2 < len(brute_pairs(baskets, 0.25))
    found = seats.mapInArrow(cosine_blocks.scores_kernel(0.25, True), "client string, code long, score double, supporters long")
    assert found.count() == found.select("client", "code").distinct().count()
    want = {c: sorted(e)[:1][0][0] for c, e in brute_entries(baskets, 0.25).items()}
    best = {r["client"]: -r["score"] for r in fitted.top(0.25, 1).collect()}
    assert best == want
    assert {r["client"] for r in fitted.clients(0.25).collect()} == set(want)
    assert fitted.nearest_profiles(0.25, k).count() == fitted.profiles.count() * k


@pytest.mark.parametrize("baskets", [sparse_baskets(seed=21, clients=90), dense_baskets(seed=22, clients=60, services=4)], ids=["sparse", "dense"])
def test_scores_and_nearest_with_little_room(spark, monkeypatch, baskets):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 16)
    monkeypatch.setattr(similarity, "STRIPES_PER_CORE", 1)
    for name, value in {"TILE_ROWS": 7, "MAX_ENTRIES": 30, "HELD_CELLS": 50, "WAITING": 3, "OUT_ROWS": 4}.items():
        monkeypatch.setattr(cosine_blocks, name, value)
    fitted = recommender.fit(frame(spark, baskets))
    want = {}
    for client, entries in brute_entries(baskets, 0.5).items():
        for service in {e[2] for e in entries}:
            scores = [-e[0] for e in entries if e[2] == service]
            want[client, service] = (max(scores), len(scores))
    got = {(r["client"], r["service"]): (r["score"], r["supporters"]) for r in fitted.candidates(0.5).collect()}
    assert got == want
    near = defaultdict(list)
    for (a, b), s in brute_pairs(baskets, 0.25).items():
        near[a].append((-s, b))
        near[b].append((-s, a))
    found = defaultdict(list)
    for r in sorted(fitted.nearest(0.25, k=2).collect(), key=lambda r: r["rank"]):
        found[r["client"]].append((-r["similarity"], r["neighbour"]))
    assert dict(found) == {c: sorted(x)[:2] for c, x in near.items()}
    raw = defaultdict(list)
    for r in sorted(fitted.top_raw(0.5, 3).collect(), key=lambda r: r["rank"]):
        raw[r["client"]].append((-r["score"], r["neighbour"], r["service"]))
    assert dict(raw) == {c: e[:3] for c, e in brute_entries(baskets, 0.5).items()}


def stripe_batches(counts):
    """One stripe of one block that meets itself, as the kernels get it."""
    n, width = counts.shape
    owned = [np.flatnonzero(row) for row in counts]
    columns = {
        "group": pa.nulls(n, pa.string()), "stripe": pa.array([0] * n, pa.int32()), "block": pa.array([0] * n, pa.int32()),
        "client": pa.array(range(n), pa.int64()), "members": pa.array([1 + i % 3 for i in range(n)], pa.int64()),
        "norm2": pa.array((counts * counts).sum(axis=1), pa.int64()), "rarer": pa.array([0] * n, pa.int32()),
        "codes": pa.array(owned, pa.list_(pa.int64())), "counts": pa.array([r[o] for r, o in zip(counts, owned)], pa.list_(pa.int64())),
    }
    for side in (0, 1):
        meets = pa.array([[0] if side else []] * n, pa.list_(pa.int32()))
        yield pa.record_batch({**columns, "side": pa.array([side] * n, pa.int32()), "meets": meets})


def dense_counts(n, width):
    counts = np.random.default_rng(31).integers(0, 5, (n, width))
    counts[:, 0] += 1
    counts[:, -1] = 0
    counts[: n // 100, -1] = 1  # a service of few
    return counts


def sparse_counts(n, width):
    rng = np.random.default_rng(33)
    counts = np.zeros((n, width), dtype=np.int64)
    for _ in range(3):
        counts[np.arange(n), np.minimum(rng.geometric(0.05, n), width) - 1] += rng.integers(1, 4, n)
    return counts


def all_cosines(counts):
    norms = (counts * counts).sum(axis=1).astype(float)
    sims = (counts @ counts.T) / np.sqrt(np.multiply.outer(norms, norms))
    np.fill_diagonal(sims, -1)
    return sims


@pytest.mark.parametrize("offering", [False, True])
def test_floors_rise_before_many_pairs_are_looked_at(monkeypatch, offering):
    counts, k = dense_counts(1500, 12), 3
    looked, exact = [], cosine_blocks.Meeting.exact
    monkeypatch.setattr(cosine_blocks, "TILE_ROWS", 50)
    monkeypatch.setattr(cosine_blocks.Meeting, "exact", lambda self, i, j: (looked.append(len(i)), exact(self, i, j))[1])
    found = pa.Table.from_batches(cosine_blocks.nearest_kernel(0.3, k, offering)(stripe_batches(counts))).to_pylist()
    sims = all_cosines(counts)
    if offering:
        sims[(counts > 0).astype(int) @ (counts > 0).T == (counts > 0).sum(axis=1)[None, :]] = -1
    got = defaultdict(list)
    for r in found:
        got[r["client"]].append((-r["similarity"], r["neighbour"]))
    for i, row in enumerate(sims):
        assert sorted(got[i])[:k] == sorted((-s, j) for j, s in enumerate(row) if s > 0.3)[:k]
    assert sum(looked) < 10 * k * len(counts)


@pytest.mark.parametrize("threshold", [0.0, 0.5, 0.95])
@pytest.mark.parametrize("width", [12, 400])
def test_who_is_served_is_compared_until_one_is_found(monkeypatch, threshold, width):
    counts = dense_counts(600, width) if width < 20 else sparse_counts(600, width)
    compared, start = [], cosine_blocks.Meeting.__init__
    monkeypatch.setattr(cosine_blocks, "TILE_ROWS", 40)
    monkeypatch.setattr(cosine_blocks.Meeting, "__init__", lambda self, a, b, *x: (compared.append(a.rows * b.rows), start(self, a, b, *x))[1])
    found = pa.Table.from_batches(cosine_blocks.served_kernel(threshold)(stripe_batches(counts))).to_pylist()
    shared = (counts > 0).astype(int) @ (counts > 0).T
    offers = (all_cosines(counts) > threshold) & (shared < (counts > 0).sum(axis=1)[None, :])
    want = np.flatnonzero(offers.any(axis=1)).tolist()
    assert sorted(r["client"] for r in found) == want
    if offers.mean() > 0.3:
        assert len(want) == len(counts) and sum(compared) < offers.size / 4


def test_clients_served_do_not_need_their_nearest(spark, monkeypatch):
    baskets = dense_baskets(seed=41, clients=80)
    fitted = recommender.fit(frame(spark, baskets))
    monkeypatch.setattr(recommend, "top_neighbours", lambda *_, **__: pytest.fail("nearest ones were asked for"))
    assert sorted(r["client"] for r in fitted.clients(0.5).collect()) == sorted(brute_entries(baskets, 0.5))


@pytest.mark.parametrize("most", [1, 40, 10**5, 10**7], ids=str)
@pytest.mark.parametrize("threshold", [0.0, 0.2, 0.5, 0.7, 0.98])
def test_backing_is_exact_added_up_or_multiplied(monkeypatch, most, threshold):
    monkeypatch.setattr(cosine_blocks, "TILE_ROWS", 300)
    counts = dense_counts(300, 21)
    batch = list(stripe_batches(counts))[1]
    members = np.random.default_rng(5).integers(1, most + 1, len(counts))
    batch = batch.set_column(batch.schema.get_field_index("members"), "members", pa.array(members, pa.int64()))
    [part] = cosine_blocks._parts(pa.Table.from_batches([batch]), cosine_blocks.Numbers())
    meeting = cosine_blocks.Meeting(part, part, False, cosine_blocks.Room())
    owned = np.zeros((len(counts), part.width), dtype=np.int64)
    owned[part.row, part.code] = 1
    want = (all_cosines(counts) > threshold).astype(np.int64) @ (owned * members[:, None])
    assert (meeting.backing(threshold) == want).all()


def test_few_others_are_not_multiplied(monkeypatch):
    monkeypatch.setattr(cosine_blocks, "TILE_ROWS", 600)
    counts = dense_counts(600, 12) + 3
    monkeypatch.setattr(cosine_blocks.Part, "packed", property(lambda self: pytest.fail("a product was asked for")))
    found = pa.Table.from_batches(cosine_blocks.scores_kernel(0.3, True)(stripe_batches(np.where(np.arange(12) % 600 == np.arange(600)[:, None] % 13, 0, counts))))
    assert found.num_rows


def test_best_scores_come_from_the_nearest_before_others_are_looked_up(monkeypatch):
    counts = dense_counts(1500, 12)
    looked, cross = [], np.ix_
    monkeypatch.setattr(cosine_blocks, "TILE_ROWS", 500)
    monkeypatch.setattr(np, "ix_", lambda *x: (looked.append(len(x[0]) * len(x[1])), cross(*x))[1])
    found = pa.Table.from_batches(cosine_blocks.scores_kernel(0.3, True)(stripe_batches(counts))).to_pylist()
    sims, owned = all_cosines(counts), counts > 0
    want = {}
    for i, c in np.argwhere(~owned):
        near = np.flatnonzero((sims[i] > 0.3) & owned[:, c])
        if len(near):
            want[i, c] = (sims[i, near].max(), sum(1 + int(x) % 3 for x in near))
    codes = {(r["client"], r["code"]): (r["score"], r["supporters"]) for r in found}
    assert codes == want
    assert sum(looked) < len(counts) ** 2 // 20


@pytest.mark.parametrize("query", [
    lambda f: f.candidates(0.5), lambda f: f.clients(0.5), lambda f: f.top(0.5), lambda f: f.top_raw(0.5), lambda f: f.nearest(0.5, k=3),
])
def test_results_do_not_hold_the_shuffles_of_the_stripes(spark, query):
    """What is shuffled for stripes and for the clients' profiles is gone before a result is read."""
    rows = [(f"c{i}", s, 1 + i % 3) for i in range(12) for s in ("a", "b", f"s{i % 4}")]
    fitted = recommender.fit(spark.createDataFrame(rows, "client string, service string, frequency long"))
    found = query(fitted)
    read = {name for path in found.inputFiles() for name in path.split("/")}
    assert read & {"similarity_scores", "similarity_nearest"} and "client_vectors" not in read
    assert not read & {"similarity_blocks", "similarity_stripes"}
    assert found.count()


def test_frequencies_are_counted_from_joined_rows_that_are_staged(spark):
    lines = spark.createDataFrame([(1, "a", "g"), (1, "a", "g"), (2, "b", "g"), (3, "c", None), (None, "d", "g")], "TicketID long, Descr string, Group1 string").selectExpr("*", "1.0D AS Total")
    tickets = spark.createDataFrame([("1", "x"), ("2", "y"), ("3", "x"), ("Closed", "z")], "TicketID string, ClientID string").selectExpr("*", "1.0D AS Total")
    freq = recommender.ticket_service_freq(lines, tickets)
    assert all("/client_services/" in path for path in freq.inputFiles()) and freq.inputFiles()
    assert sorted(map(tuple, freq.collect())) == [("x", "a", 2), ("y", "b", 1)]


def test_saving_leaves_no_shuffle_files(spark, tmp_path):
    from test_session import shuffle_files

    rows = [(f"c{i}", s, 1 + i % 3) for i in range(12) for s in ("a", "b", f"s{i % 4}")]
    fitted = recommender.fit(spark.createDataFrame(rows, "client string, service string, frequency long"))
    before = shuffle_files(spark)
    fitted.save(str(tmp_path / "saved"))
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
