"""The quality classifier: features against plain n-grams, the fit against its optimum, held-out accuracy, odd rows."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest

from clientele.llm import quality_classifier as quality


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioustrnl") for _ in range(rng.randrange(2, 9))) for _ in range(n)).capitalize() + "."


def junk(rng, n):
    words = prose(rng, n).split()
    return rng.choice([" | ".join(words), " ".join(w.upper() + "!!" for w in words), " ".join(w + rng.choice(["###", "$$$"]) for w in words), " ".join([words[0]] * n)])


def test_slices_have_the_features_of_the_whole():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("ab B1. \n#é") for _ in range(rng.randrange(400))).encode()
        longest = max(map(len, re.findall(rb"\s+|\S+", text)), default=0)
        whole = quality.features(text)
        for size in (longest + 2, longest + 60):
            assert quality.features(text, size).tolist() == whole.tolist()
    assert len(quality.features(b"")) == 0 and len(quality.features(b" \n")) > 0
    assert len(quality.features(b"x" * 300, 100)) >= 3


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5))
    y = np.where(x @ [1.0, -2, 0.5, 0, 1] + rng.normal(size=60) > 0, 1, -1)
    found = quality.descend([(np.arange(5), r) for r in x], y, 5)
    cost = np.where(y == 1, quality.PENALTY * 60 / (2 * (y == 1).sum()), quality.PENALTY * 60 / (2 * (y == -1).sum()))
    loss = lambda w: (w @ w) / 2 + (cost * np.maximum(0, 1 - y * (x @ w[:-1] + w[-1]))).sum()
    for _ in range(3000):
        assert loss(found) <= loss(found + rng.normal(size=6) * rng.choice([0.3, 0.03])) * 1.01


def labelled(spark, n=700, seed=5):
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        good = rng.random() < 0.8
        docs.append((k, prose(rng, rng.randrange(5, 200)) if good else junk(rng, rng.randrange(5, 200))))
        if k % 5 != 4:
            labels.append((k, int(good)))
    truth = {k: int(not any(m in t for m in ("|", "!!", "##", "$$")) and len(set(t.lower().strip(".").split())) > 2) for k, t in docs}
    return docs, labels, truth


def frames(spark, docs, labels):
    return (
        spark.createDataFrame([(*d, "x", 0.5, 3) for d in docs], "doc_id long, text string, found string, score double, label int"),
        spark.createDataFrame([(*x, 9) for x in labels], "doc_id long, quality int, text int"),
    )


def test_held_out_accuracy_and_contract(spark):
    docs, labels, truth = labelled(spark)
    found = quality.classify(*frames(spark, docs, labels)).collect()
    assert [list(r.asDict()) for r in found[:1]] == [["doc_id", "held_out", "score", "predicted"]]
    assert sorted(r.doc_id for r in found) == [k for k, _ in docs]
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    tested = [r for r in found if r.held_out]
    assert len(tested) > 80 and sum(r.predicted == truth[r.doc_id] for r in tested) / len(tested) >= 0.97


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels, _ = labelled(spark, 200)
    turned = [(k, 1 - y if zlib.crc32(str(k).encode()) % 5 == 0 else y) for k, y in labels]
    scores = [{r.doc_id: r.score for r in quality.classify(*frames(spark, docs, x)).collect()} for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_odd_rows(spark):
    docs, labels, _ = labelled(spark, 150)
    odd = [(None, "a text"), (1000, None), (1001, ""), (1002, "x" * 100000), (1003, "word " * 50000), (3, "another text"), (3, docs[3][1]), (3, docs[3][1])]
    more = [(None, 1), (1, None), (2, 0), (2, 1), (2, 1), (7, 5), (99999, 0)]
    d, x = frames(spark, docs + odd, labels + more)
    found = quality.classify(d, x).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(k) for k, _ in docs + odd)
    by_text = {r.doc_id: r.score for r in found}
    assert by_text[1000] == by_text[1001] and not next(r for r in found if r.doc_id is None).held_out
    assert quality.classify(d.limit(0), x).collect() == []
    for none in (x.limit(0), x.filter("quality = 1")):
        only = quality.classify(d, none).collect()
        assert len({r.score for r in only}) == 1 and {r.predicted for r in only} == {1}


@pytest.mark.parametrize("name,least", [("sf0.01", 0.95)])
def test_held_out_accuracy_on_the_tables(spark, name, least):
    folder = f"/root/testdata/{name}"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = quality.classify(spark.read.parquet(f"{folder}/documents.parquet"), labels).filter("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in found) / len(found) >= least
