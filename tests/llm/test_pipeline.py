"""Every stage of the pipeline, and all of them, against plain Python on planted cases."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COMMON = "the of and to in a is that it for".split()


def line(rng, n=20):
    return " ".join(rng.choice(COMMON) if k % 2 else "".join(map(rng.choice, ("bcdfg", "aeiou", "l", "aeiou", "r", "dknt"))) for k in range(n)) + "."


def planted():
    rng = random.Random(41)
    items = [(k, line(rng)) for k in range(4)] + [(8, None), (9, "")]
    clean = lambda: [line(rng) for _ in range(6)]
    docs = [(k, clean()) for k in range(120)]
    docs += [(120 + k, docs[k][1]) for k in range(5)]
    for k in range(5, 10):
        near = docs[k][1][:]
        near[1], near[4] = (" ".join([*x.split()[:9], "other", *x.split()[10:]]) for x in (near[1], near[4]))
        docs.append((125 + k, near))
    passage = [line(rng) for _ in range(4)]
    docs += [(140 + k, [*clean()[:k], *passage, *clean()]) for k in range(4)]
    docs += [(150 + k, [*clean(), items[k][1], *clean()]) for k in range(3)]
    docs += [(None, clean()), (None, clean()), (None, [*clean(), items[0][1]]), (None, docs[10][1])]
    docs += [(170, again := clean()), (170, again), (171, clean()), (171, [*clean(), items[1][1]])]
    junk = [(160, "too short"), (161, "spam ham eggs and more " * 30), (162, None), (163, ""), (None, None)]
    texts = [(k, "\n".join(x)) for k, x in docs] + junk
    return [(k, t, "en" if (k or 0) % 7 else None, None, len(t) if t else None) for k, t in texts], items


def without_lines(rows):
    seen, out = set(), {}
    for key in sorted({r[:2] for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        lines, gone = key[1].split("\n"), set()
        for p in range(len(lines) - 2):
            if (window := tuple(lines[p : p + 3])) in seen:
                gone.update(range(p, p + 3))
            seen.add(window)
        out[key] = "\n".join(x for p, x in enumerate(lines) if p not in gone)
    return [(r[0], out[r[:2]], *r[2:4], len(out[r[:2]])) for r in rows if out[r[:2]]]


def one_of_each(rows):
    sets = {r[:2]: frozenset(zip(*(r[1].lower().split()[k:] for k in range(5)))) for r in rows if r[0] is not None}
    group = {key: key[0] for key in sets}
    links = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in links:
            group[a] = group[b] = min(group[a], group[b])
    return [r for r in rows if r[0] is None or group[r[:2]] == r[0]]


def uncontaminated(rows, items):
    words = lambda text: re.findall(r"[^\W_]+", (text or "").lower())
    shingles = lambda w: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    wanted = [(len(w), shingles(w)) for _, text in items if (w := words(text))]

    def dirty(text):
        own = words(text)
        return any((both := shingles(own[s : s + n])) and (both & x).total() >= 0.8 * (both | x).total() for n, x in wanted for s in range(max(1, len(own) - n + 1)))

    return [r for r in rows if not dirty(r[1])]


def plain(rows):
    return sorted(map(str, map(tuple, rows)))


def test_stages_and_run_equal_plain_python(spark, tmp_path):
    rows, items = planted()
    folder = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    bad = {160, 161, 162, 163}
    expected = {
        "quality_rules": lambda r: [x for x in r if x[0] not in bad and x[1]],
        "line_dedup": without_lines,
        "minhash": one_of_each,
        "decontamination": lambda r: uncontaminated(r, items),
    }
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    now, lost = rows, {}
    for name, function in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(now, SCHEMA)
        found = function(spark, docs, folder)
        if name == "bpe":
            got = sorted((str(r.doc_id), r.n_tokens, list(r.ids), r.ids_sha256) for r in found.collect())
            want = []
            for key, text, *_ in now:
                ids = library.encode(text, add_special_tokens=False).ids
                want.append((str(key), len(ids), ids, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
            assert got == sorted(want)
            assert sorted((str(r.doc_id), r.n_tokens, list(r.ids), r.ids_sha256) for r in corpus_pipeline.run(spark, folder).collect()) == got
            break
        assert found.schema.simpleString() == docs.schema.simpleString(), name
        want, after = expected[name](now), [tuple(r) for r in found.collect()]
        assert plain(after) == plain(want), name
        lost[name] = len(now) - len(after)
        now = after
    assert lost == {"quality_rules": 5, "line_dedup": 6, "minhash": 5, "decontamination": 5}
    assert sum(r[0] == 171 for r in now) == 1 and sum(r[0] is None for r in now) == 3


def test_empty_documents_pass_every_stage(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
