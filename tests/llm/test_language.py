"""Many languages, and the labels of the words of code-switched texts."""

from __future__ import annotations

import random

import numpy as np

from clientele.llm import language


def tongues(n, seed=3):
    """Made-up languages: each has syllables of its own."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzàéîõüçñ"
    return {f"l{k:03}": ["".join(rng.choice(letters) for _ in range(3)) for _ in range(6)] for k in range(n)}


def words(rng, syllables, n):
    return ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n)]


def test_every_one_of_many_languages_can_be_predicted(spark):
    rng, known = random.Random(4), tongues(250)
    rows = [(k, " ".join(words(rng, known[lang], rng.randrange(30, 60))), lang) for k, lang in enumerate(sorted(known) * 6)]
    found = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    held = [(found[k].lang_pred, lang) for k, _, lang in rows if found[k].held_out]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert len({p for p, _ in held}) >= 0.97 * len({lang for _, lang in held})


def test_words_of_switched_texts(spark):
    rng, known = random.Random(5), tongues(4)
    field = language.learn([(lang, " ".join(words(rng, known[lang], 60))) for lang in sorted(known) * 30])
    rows, truth = [], {}
    for k in range(40):
        own = []
        while len(own) < 200:
            lang = rng.choice(sorted(known))
            own += [(w, lang) for w in words(rng, known[lang], rng.randrange(3, 20))]
        rows.append((k, ", ".join(w.upper() for w, _ in own), "x"))
        truth.update({(k, p): x for p, x in enumerate(own)})
    rows += [(100, None, "x"), (101, "", "x"), (102, "12 !", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {(r.doc_id, r.place): r for r in language.label_words(df, field).collect()}
    assert set(found) == set(truth) and all(found[k].word == w for k, (w, _) in truth.items())
    assert sum(found[k].lang == lang for k, (_, lang) in truth.items()) >= 0.97 * len(truth)
    assert all(0.25 <= r.probability <= 1 for r in found.values())
    shares = {r.doc_id: r.score for r in language.identify(df, field).collect()}
    of_words = np.mean([found[k].lang == max(sorted(known), key=lambda x: sum(found[0, p].lang == x for d, p in truth if d == 0)) for k in truth if k[0] == 0])
    assert abs(shares[0] - of_words) < 0.05
    assert language.label_words(df.limit(0), field).collect() == []
