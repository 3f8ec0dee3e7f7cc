"""Ranked search against scoring every document, and its cases with a defined result."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from clientele.llm import lexical_search as lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=20):
    own = [(d, Counter(terms(t))) for d, t in docs]
    n, total = sum(bool(c) for _, c in own), sum(c.total() for _, c in own)
    df = Counter(t for _, c in own for t in c)
    found = []
    for item in {i for i, _ in items}:
        asked = Counter(x for t in {t for i, t in items if i == item and t is not None} for x in terms(t))
        scored = []
        for doc, c in own:
            score = 0
            for t, r in asked.items():
                if c[t]:
                    m = 100 - 25 + (25 * c.total() * n) // total
                    score += r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc is not None, doc or 0))
        found += [(item, r, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(found, key=str)


def test_terms_are_the_pattern():
    rng = random.Random(1)
    for _ in range(2000):
        text = "".join(rng.choice("aZ09 .-_\x00\x7f\néÉ 漢\U0001f600@[`{") for _ in range(rng.randrange(30)))
        assert [t.decode() for t in lexical.terms_of(text.encode())] == terms(text), repr(text)


def corpus(rng, n):
    """Documents from a skewed vocabulary, with copies, ties and odd texts."""
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 300}"
    docs = [(k, " ".join(word() for _ in range(rng.randrange(1, 80)))) for k in range(n)]
    docs += [(n + k, docs[3][1]) for k in range(50)]  # copies tie
    docs += [(5, docs[5][1]), (5, docs[5][1]), (None, docs[3][1]), (9000, None), (9001, ""), (9002, " .,!"), (9003, "W1 w2 Été " * 9000), (9004, "zzz")]
    items = [(k, " ".join(word() for _ in range(rng.randrange(1, 40)))) for k in range(12)]
    items += [(50, None), (51, ""), (52, "nowhere at all"), (53, "w1 w1 W1, w2"), (54, docs[3][1]), (None, "w7 été Été"), (55, "w3"), (55, "w4 w5"), (55, "w3")]
    return docs, items


def frames(spark, docs, items):
    full = [(*d, "x", 1, 2) for d in docs]
    return spark.createDataFrame(full, "doc_id long, text string, item_id string, n int, score int").repartition(3), spark.createDataFrame([(*i, 7) for i in items], "item_id long, text string, rank int")


@pytest.mark.parametrize("settings", [{}, {"block_postings": 40, "query_bytes": 300}, {"k": 3, "block_postings": 500}])
def test_search_equals_brute_force(spark, settings):
    docs, items = corpus(random.Random(5), 400)
    found = lexical.search(*frames(spark, docs, items), **settings)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute(docs, items, settings.get("k", 20))


def test_intervals_score_few_documents():
    """Every document that reaches the limit is found, and most others are never scored."""
    rng = np.random.default_rng(3)
    n, queries = 4000, lexical.Queries(["q"], [{k: 1 for k in range(30)}], np.arange(1000, 1030), 4000, 400_000)
    sizes = rng.integers(0, 12, n)
    sizes[:25] = 30
    codes = np.concatenate([rng.choice(30, s, replace=False) for s in sizes])
    tf = rng.integers(1, 4, len(codes))
    lengths = rng.integers(50, 150, n)
    block = lexical.Block(sizes, codes, tf, lengths, queries)
    value = lexical.impacts(queries.weights[codes], tf, lengths[np.repeat(np.arange(n), sizes)], 4000, 400_000)
    whole = np.bincount(np.repeat(np.arange(n), sizes), value, n).astype(np.int64)
    best = np.zeros((1, 20), np.int64)
    scored = []
    bounds = block.bounds
    block.bounds = lambda *a: scored.append(len(a[0])) or bounds(*a)
    [(some, own, repeats)] = queries.groups(n)
    its, rows, score = block.search(own, repeats, best)
    order = np.argsort(-whole, kind="stable")[:20]
    assert set(order) <= set(rows) and (whole[rows] == score).all() and sorted(whole[order]) == list(best[0])
    assert sum(scored) < n / 2


def test_empty_tables(spark):
    docs, items = frames(spark, *corpus(random.Random(6), 30))
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.filter("doc_id = 9002"), items)):
        found = lexical.search(d, i)
        assert found.collect() == [] and found.columns == ["item_id", "rank", "doc_id", "score"]
