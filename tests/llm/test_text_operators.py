"""The operators against brute force on small tables, and their cases with a defined result."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from clientele.llm import bpe, decontaminate, html_text, language, line_dedup, minhash, pii, quality, sharding, training_order

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SPACES = re.compile("[^\x20\x09-\x0d]+")
#: Columns that operators use inside, to see that a frame may have them too.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, _gone string, _lines int, bucket int, n int, h long, _contaminated int, _id int, _hash int"


def documents(spark, rows):
    """A frame of (id, text[, lang]) with columns whose names clash."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, None, None, "x", 1, 2, 3, 4, 5, 6, 7) for r in rows]
    return spark.createDataFrame(full, CLASH)


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def odd_rows(rng):
    """Nulls, empty and blank texts, a long one, ties, repeated rows, a null id."""
    text = "\n".join(sentence(rng, 12) for _ in range(8))
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, text), (5, text), (5, text), (None, text), (7, "one"), (8, "a b c"),
        (9, sentence(rng, 30000, 9000)), (10, text.upper(), None), (11, "!!! 123 ###"), (12, "\n".join(["same line"] * 40)), (13, "x" * 200000),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, odd_rows(random.Random(1)))


@pytest.fixture(scope="module")
def benchmark(spark):
    rng = random.Random(2)
    rows = [(k, sentence(rng, rng.randrange(14, 60))) for k in range(20)] + [(50, None), (51, ""), (52, "two words")]
    return spark.createDataFrame(rows + [(60, rows[0][1])], "item_id long, text string")


OPERATORS = {
    "pii": lambda d, b: pii.find_pii(d, pii.Field()),
    "decontaminate": lambda d, b: decontaminate.contaminated(d, b),
    "decontaminated": lambda d, b: decontaminate.decontaminate(d, b),
    "shards": lambda d, b: sharding.shard_rows(d, 3),
    "quality": lambda d, b: quality.assess(d),
    "good": lambda d, b: quality.good_texts(d),
    "bpe": lambda d, b: bpe.encode(d, VOCABULARY, with_ids=True),
    "minhash": lambda d, b: minhash.near_duplicates(d),
    "one_of_each": lambda d, b: minhash.one_of_each(d),
    "order": lambda d, b: training_order.in_order(d, VOCABULARY),
    "language": lambda d, b: language.identify(d),
    "lines": lambda d, b: line_dedup.dedup_lines(d, counts=("c1", "c2")),
}
PER_ROW = {"pii", "shards", "quality", "bpe", "minhash", "language", "lines"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(odd, benchmark, name):
    found = OPERATORS[name](odd, benchmark).collect()
    if name in PER_ROW:
        assert sorted(str(r[0]) for r in found) == sorted(str(r.doc_id) for r in odd.collect())
    empty = OPERATORS[name](odd.limit(0), benchmark)
    assert empty.collect() == []
    assert empty.columns == OPERATORS[name](odd, benchmark).columns
    if name == "decontaminate":
        assert decontaminate.contaminated(odd, benchmark.limit(0)).collect() == []


def test_columns_stay_as_they_are(odd, benchmark):
    for name in ("decontaminated", "good", "one_of_each"):
        assert OPERATORS[name](odd, benchmark).columns == odd.columns


# --- personal data


def brute_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 12 <= len(digits(m[0])) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(digits(m[0])[::-1])) % 10 == 0]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2]))


def test_pattern_spans_equal_the_plain_patterns():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice("0123456789..@@ab-+() é%_") for _ in range(rng.randrange(50)))
        assert pii.base_spans(text) == brute_spans(text), text


def test_field_adds_what_greedy_patterns_lose():
    field = pii.learn([])
    base, spans = pii.find("call +1 (974) 555-3436 4111111111111111 now", field)
    assert base == [] and spans == [("phone", 5, 22), ("card", 23, 39)]
    base, spans = pii.find("x@y.example.com 10.0.0.1 and 4111 1111 1111 1111 12", field)
    assert set(base) <= set(spans) and ("card", 29, 48) in spans
    for clean in ("no numbers here", "version 1.2.3 of 2023-01-02", "order 1234567890123456 is late", "License, Version 2.0."):
        assert pii.find(clean, field) == ([], [])


def test_field_segmentation_is_the_best_of_all():
    field = pii.learn([])
    run = pii.Run("12 +1 (974) 555-3436 9", 0, 22)
    spans, plain = field.scores(run)

    def score(chosen):
        total, at, before = 0.0, 0, pii.OUT
        for s in sorted(chosen, key=lambda s: run.segments[s]):
            i, j, k = run.segments[s]
            if i < at:
                return -np.inf
            for t in range(at, i):
                total, before = total + plain[t] + field.step[before, pii.OUT], pii.OUT
            total, at, before = total + spans[s] + field.step[before, k], j, k
        for t in range(at, len(run.starts)):
            total, before = total + plain[t] + field.step[before, pii.OUT], pii.OUT
        return total

    options = [c for n in range(3) for c in combinations(range(len(run.segments)), n)]
    best = max(options, key=score)
    assert field.best(run, set()) == sorted(run.segments[s] for s in best)


# --- web pages


def test_main_text_of_pages(spark):
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1><p>line</p></header><nav><a>Home</a> <a>News</a></nav>"
        "<div class='cookie-notice'><p>A long notice about cookies that nobody reads to its end, ever.</p></div><main><article><header><h1>Title</h1>"
        "<p>By somebody</p></header><p><b>First&nbsp;&amp; second<br>line\n of it<p>Ti.</p><script>var a='</p>';</script><ul><li>one<li>two</ul>"
        "<aside>more</aside><form><input><label>Name</label></form><section class='comments'><article><p>A comment of a reader, long enough to look like content.</p></article></section>"
        "</article></main><footer>foot</footer></body></html>"
    )
    rows = [(1, "u", page), (2, None, None), (3, "", ""), (None, "v", "<article><p>cut off &am"), (5, "w", "<article></article><footer>only a footer</footer>")]
    found = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[1].text == "Title\nFirst & second line of it\nTi.\none\ntwo" and found[1].n_chars == len(found[1].text)
    assert [found[k].text for k in (2, 3, 5)] == ["", "", ""] and found[None].text == "cut off &am"
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_page_without_landmarks_keeps_the_dense_region():
    text = "word " * 60
    page = f"<div><a>home</a><a>about</a><a>more</a></div><p>{text}</p><p>short.</p><p>{text}</p><div><a>x</a><a>y</a></div>"
    assert html_text.main_text(page) == f"{text.strip()}\nshort.\n{text.strip()}"


# --- benchmark passages


def test_contaminated_equals_all_windows(spark, benchmark):
    rng = random.Random(4)
    items = {r.item_id: decontaminated_words(r.text) for r in benchmark.collect()}
    rows = []
    for k in range(60):
        words = sentence(rng, 80).split()
        item = items[k % 20][:]
        if k % 3 == 1:
            item[0] = "changed"
        if k % 6 == 2:
            item.insert(len(item) // 2, "put in")
        if k % 4 < 3:
            words[40:40] = item if k % 5 else [w.upper() + "," for w in item]
        rows.append((k, " ".join(words)))
    want = {}
    for k, text in rows:
        own = decontaminated_words(text)
        for i, item in items.items():
            if best := max((similarity(own[s : s + len(item)], item) for s in range(max(1, len(own) - len(item) + 1))), default=0) if item else 0:
                if best >= 0.8:
                    want.setdefault(k, set()).add(i)
    found = {r.doc_id: set(r.item_ids) for r in decontaminate.contaminated(documents(spark, rows), benchmark).collect()}
    assert found == want and any(v > {min(v)} for v in want.values())
    left = {r.doc_id for r in decontaminate.decontaminate(documents(spark, rows), benchmark).collect()}
    assert left == {k for k, _ in rows} - set(want)


def decontaminated_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def similarity(a, b):
    from collections import Counter

    shingles = lambda w: Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))
    x, y = shingles(a), shingles(b)
    return (x & y).total() / (x | y).total()


def test_multi_index_finds_every_fingerprint_within_the_radius(spark):
    rng = random.Random(5)
    pairs = []
    for k in range(300):
        fp = rng.getrandbits(64)
        other = fp
        for bit in rng.sample(range(64), k % (decontaminate.RADIUS + 1)):
            other ^= 1 << bit
        pairs.append((k, fp - (1 << 63), other - (1 << 63)))
    frame = spark.createDataFrame(pairs, "k int, x long, y long")
    items = decontaminate._blocks(frame.select("k", F.col("x").alias("fp")), decontaminate.ITEM_BITS)
    looked_up = decontaminate._blocks(frame.select("k", F.col("y").alias("fp")), decontaminate.WINDOW_BITS)
    assert items.join(looked_up, ["k", "block", "value"]).select("k").distinct().count() == 300


# --- shards


def test_shards_obey_their_law(spark, tmp_path):
    rows = [(k % 70, None if k % 9 == 0 else f"text é {k % 50}") for k in range(500)] + [(None, "same")] * 300
    frame = documents(spark, rows)
    placed = sharding.shard_rows(frame, 7, bucket_rows=64).collect()
    assert len(placed) == 800
    by_shard = {}
    for r in placed:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert sorted(by_shard) == list(range(7)) and all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    assert max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in placed) == want
    again = sharding.shard_rows(frame.repartition(5), 7, bucket_rows=64).collect()
    assert sorted(map(str, again)) == sorted(map(str, placed))
    order = [str(r.doc_id) for r in sorted(placed, key=lambda r: (r.shard, r.slot))]
    assert order != sorted(order)
    sharding.write_shards(frame, str(tmp_path / "s"), 7, bucket_rows=64)
    written = spark.read.parquet(str(tmp_path / "s"))
    assert written.count() == 800 and written.select("shard", "slot").distinct().count() == 800


def test_shards_hold_every_record_whatever_its_copies(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK", 7)
    # both texts have the checksum 1306201125, the same length and the same id
    twins = [(1, "plumless"), (1, "buckeroo"), (None, "plumless"), (None, "buckeroo")]
    assert len({zlib.crc32(t.encode()) for _, t in twins}) == 1
    rows = twins + [(2, "again")] * 50 + [(None, None)] * 60 + [(k, f"text {k}") for k in range(10, 40)] + [(3, ""), (3, None), (4, "y" * 300000)]
    for limit in (sharding.BROADCAST_ROWS, 0):
        monkeypatch.setattr(sharding, "BROADCAST_ROWS", limit)
        path = str(tmp_path / f"whole{limit}")
        sharding.write_shards(documents(spark, rows), path, 5, bucket_rows=10)
        written = spark.read.parquet(path).collect()
        assert sorted(map(str, ((r.doc_id, r.text) for r in written))) == sorted(map(str, rows))
        slots = {k: sorted(r.slot for r in written if r.shard == k) for k in range(5)}
        assert all(v == list(range(len(v))) and len(v) in (len(rows) // 5, -(-len(rows) // 5)) for v in slots.values())
    placed = sharding.shard_rows(documents(spark, rows), 5, bucket_rows=10).collect()
    assert sorted(str((r.doc_id, r.size, r.text_crc32)) for r in placed) == sorted(str((k, len(t or "") + 16, zlib.crc32((t or "").encode()))) for k, t in rows)
    again = [r.shard for r in placed if r.doc_id == 2]
    assert len(set(again)) == 5


# --- quality


def test_quality_features_and_verdicts(spark):
    rng = random.Random(6)
    common = "the of and to in a is that it for".split()
    good = lambda n: " ".join(rng.choice(common) if k % 2 else f"{rng.choice('bcdfg')}{rng.choice('aeiou')}l{rng.choice('aeiou')}r{rng.choice('dknt')}" for k in range(n)) + "."
    rows = [(k, "\n".join(good(20) for _ in range(6)), "en" if k % 3 else None) for k in range(200)]
    rows += [(300, good(100).upper() + "!!" * 50, "en"), (301, " ".join(f"{w}%%%" for w in good(200).split()), "en"), (302, "spam ham eggs and more " * 30, "en"), (303, "too short", "en"), (304, None, "en")]
    found = {r.doc_id: r for r in quality.assess(documents(spark, rows)).collect()}
    for k, text, _ in rows:
        r, words = found[k], SPACES.findall(text or "")
        lines = [x for x in (text or "").split("\n") if SPACES.search(x)]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        covered = {p for i, w in enumerate(windows) if windows.count(w) > 1 for p in range(i, i + 5)}
        base = (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 10 or 100 * base[4] > 20 * base[0])
        assert r.kept == (k < 300), (k, r)
    assert found[302].base_failed and found[303].base_failed and not found[300].base_failed and not found[301].base_failed
    assert {r.doc_id for r in quality.good_texts(documents(spark, rows)).collect()} == set(range(200))


def test_rare_languages_have_their_own_reference(spark):
    rng = random.Random(33)
    greek = ["".join(chr(0x3B1 + (k * 7 + j * 5) % 24) for j in range(6)) for k in range(20)]
    latin = lambda: " ".join(f"word{rng.randrange(20)}" for _ in range(120))
    rows = [(k, latin(), "en") for k in range(20000)]
    rows += [(30000 + k, " ".join(rng.choice(greek) for _ in range(120)), "el") for k in range(12)]
    rows += [(40000, " ".join(rng.choice(greek) for _ in range(120)), None), (40001, latin(), None), (40002, "# $ % " * 200, None)]
    rows += [(50000, " ".join(f"\u4e2d{chr(0x4E00 + rng.randrange(999))}" for _ in range(60)), "zh")]
    found = {r.doc_id: r for r in quality.assess(documents(spark, rows)).filter("doc_id >= 30000").collect()}
    assert all(found[30000 + k].kept for k in range(12)) and found[40000].kept and found[40001].kept
    assert not found[40002].kept and found[50000].kept and found[50000].char_distance is None


def test_divergence_by_hand():
    p, q = np.array([1.0, 1, 0]), np.array([1.0, 0, 3])
    m = (p / 2 + q / 4) / 2
    want = sum(x * np.log2(x / y) for a in (p / 2, q / 4) for x, y in zip(a, m) if x) / 2
    assert quality.divergence(p, q) == pytest.approx(want**0.5)
    assert quality.divergence(p, 5 * p) == 0 and quality.divergence(np.array([1.0, 0]), np.array([0, 1.0])) == 1


def test_summary_keeps_every_frequent_word():
    from collections import Counter

    rng, counts, full = random.Random(7), Counter(), Counter()
    for _ in range(50):
        words = [f"rare{rng.randrange(100000)}" for _ in range(900)] + ["often"] * 12
        full.update(words)
        counts.update(words)
        counts = quality.summarise(counts)
    assert len(counts) <= quality.KEPT and counts["often"] >= full["often"] - full.total() / quality.KEPT


# --- byte pairs


def test_ids_and_text_equal_the_library(spark):
    library, own, rng = Tokenizer.from_file(VOCABULARY), bpe.encoder(bpe.read_vocabulary(VOCABULARY)), random.Random(8)
    texts = ["".join(rng.choice("aabbcdeinrstht  \n'’.,!<|>éßÉ123日ñ😀İΣ\x1c\x85\xa0") for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["a<|endoftext|> b <|EndOfText|>c<|startoftext|>", "don't we'll", "aaaaaaaaaaaaaaaaaaaaaaaa", "h" * 500]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    rows = [(k, t) for k, t in enumerate(texts[:40])] + [(99, None)]
    for r in bpe.encode(documents(spark, rows), VOCABULARY, with_ids=True).collect():
        ids = library.encode(dict(rows)[r.doc_id] or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_tokens, r.ids, r.ids_sha256, r.decoded_sha256) == (len(ids), ids, digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))


def test_cache_stays_bounded():
    seen = bpe.Recent(lambda k: k * 2, size=10)
    assert [seen[k] for k in [*range(100), 99, 5]] == [2 * k for k in [*range(100), 99, 5]]
    assert len(seen) <= 10 and len(seen.old) <= 10


# --- near copies


def test_components_equal_all_pairs(spark):
    rng, rows = random.Random(9), []
    for _ in range(12):
        words = sentence(rng, rng.randrange(3, 90), 5000).split()
        for _ in range(rng.randrange(1, 9)):
            copy = words[:]
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(999)}"
            rows.append((len(rows), " ".join(copy).title() if rng.random() < 0.3 else " ".join(copy)))
    rows += [(900, None), (901, ""), (902, " "), (None, rows[0][1]), (903, "tiny text"), (904, "TINY  text"), (905, rows[0][1]), (905, rows[0][1])]
    sets = {}
    for k, text in rows:
        words = SPACES.findall((text or "").lower())
        sets[k] = {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()
    smallest = {k: k for k in sets if k is not None}
    links = [(a, b) for a, b in combinations(smallest, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while any(smallest[a] != smallest[b] for a, b in links):
        for a, b in links:
            smallest[a] = smallest[b] = min(smallest[a], smallest[b])
    found = minhash.near_duplicates(documents(spark, rows), words=4).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.n_shingles == len(sets[r.doc_id]) and r.component_id == smallest.get(r.doc_id)
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    left = {r.doc_id for r in minhash.one_of_each(documents(spark, rows), words=4).collect()}
    assert left == {k for k in smallest if smallest[k] == k} | {None}


def test_pairs_inside_a_template_family(spark):
    rng, rows = random.Random(21), []
    template = [f"t{k}" for k in range(870)]
    for family in range(1200):
        # siblings at 0.77; every third has a true partner at 0.82
        inner = [f"f{family}x{k}" for k in range(31)]
        for _ in range(2 if family % 3 == 0 else 1):
            own = [f"r{len(rows)}x{k}" for k in range(99)]
            words = template + inner + own
            rng.shuffle(words)
            rows.append((len(rows), " ".join(words)))
    sets = [frozenset(t.split()) for _, t in rows]
    whole = np.array([len(x) for x in sets])
    numbers = {w: k for k, w in enumerate(sorted(set().union(*sets)))}
    lists: dict[int, list[int]] = {}
    for k, x in enumerate(sets):
        for w in x:
            lists.setdefault(numbers[w], []).append(k)
    shared = np.zeros((len(rows), len(rows)), np.int32)
    for at in lists.values():
        if len(at) == len(rows):
            shared += 1
        else:
            shared[np.ix_(at, at)] += 1
    a, b = np.nonzero(np.triu(100 * shared >= 80 * (whole[:, None] + whole[None, :] - shared), 1))
    links = list(zip(a.tolist(), b.tolist()))
    assert len(links) == 400
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, rows), words=1).collect()}
    assert sum(found[x] != found[y] for x, y in links) == 0
    assert len(set(found.values())) == len(rows) - len(links)


def test_meetings_grow_with_the_family(spark):
    rng = random.Random(23)
    meetings = []
    for family in (150, 300):
        rows = []
        for k in range(family):
            # siblings at 0.77 of different sizes, every tenth with a partner at 0.82 or more
            inner = [f"f{k}x{i}" for i in range(31)]
            for _ in range(2 if k % 10 == 0 else 1):
                words = [f"t{i}" for i in range(870)] + inner + [f"r{len(rows)}x{i}" for i in range(99 + rng.randrange(6))]
                rows.append((len(rows), " ".join(words)))
        sets = minhash.full_sets(spark.createDataFrame(rows, "doc_id long, text string"), 1).cache()
        left = sets.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("component"), F.lit(True).alias("stray"))
        found = {(min(r.a, r.b), max(r.a, r.b)) for r in minhash.prefix_pairs(left, sets, 80).collect()}
        twins = {(k, k + 1) for k in range(len(rows) - 1) if len(set(rows[k][1].split()) & set(rows[k + 1][1].split())) > 870}
        assert len(twins) == family // 10 and twins <= found
        meetings.append(minhash.prefix_meetings(left, sets, 80).count())
    assert meetings[0] < 40 * 150 and meetings[1] < 2.2 * meetings[0]


def test_prefixes_find_every_similar_pair_of_mixed_sizes(spark):
    rng, rows = random.Random(29), []
    for k in range(100):
        base = [f"b{k % 12}x{i}" for i in range(rng.randrange(3, 9) * (1 + k % 12))]
        rows.append((k, " ".join(base + [f"o{k}x{i}" for i in range(rng.randrange(0, 8))])))
    own = [set(t.split()) for _, t in rows]
    want = {(a, b) for a, b in combinations(range(100), 2) if 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b])}
    sets = minhash.full_sets(spark.createDataFrame(rows, "doc_id long, text string"), 1).cache()
    for stray in ("true", "node % 100 <> 7"):
        left = sets.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("component")).withColumn("stray", F.expr(stray))
        found = {(min(r.a, r.b), max(r.a, r.b)) for r in minhash.prefix_pairs(left, sets, 80).collect()}
        assert want <= found and len(want) > 20


def test_texts_under_one_id_stay_or_go_on_their_own(spark):
    rng = random.Random(31)
    one, two, three = (sentence(rng, 60, 9000) for _ in range(3))
    rows = [(1, one), (5, one), (5, two), (6, two + " more"), (7, three), (7, three), (None, one)]
    left = minhash.one_of_each(documents(spark, rows)).collect()
    assert sorted(str((r.doc_id, r.text)) for r in left) == sorted(map(str, [(1, one), (5, two), (7, three), (7, three), (None, one)]))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(10)
    agree = []
    for _ in range(300):
        pool = np.unique(rng.integers(0, 2**63, 12, np.uint64))
        agree.append((minhash.signature(pool[:10]) == minhash.signature(pool[2:])).mean())
    assert np.mean(agree) == pytest.approx(8 / 12, abs=0.06)


def test_components_of_long_paths(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (7, 103)]
    found = {r.node: r.component for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(61)}, 100: 100, 101: 100, 103: 0}


# --- training order


def test_feistel_permutes_every_size():
    for n in (1, 2, 3, 5, 16, 17, 255, 1000, 4097):
        assert sorted(training_order.feistel(np.arange(n), n).tolist()) == list(range(n))
    assert (training_order.feistel(np.arange(1000), 1000, 1) != training_order.feistel(np.arange(1000), 1000, 2)).any()


def test_shard_files_give_back_every_sequence(spark, tmp_path):
    rng = random.Random(11)
    rows = [(k, sentence(rng, rng.randrange(0, 200))) for k in range(120)] + [(7, "again"), (7, "again"), (None, "none"), (500, None)]
    ordered = training_order.in_order(documents(spark, rows), VOCABULARY, length=32, shard_sequences=50).cache()
    path = str(tmp_path / "order")
    training_order.write_shards(ordered, path)
    slots = {r.slot: r for r in ordered.collect()}
    assert sorted(slots) == list(range(len(slots)))
    read = {r.slot: r.ids for r in training_order.read_slots(spark, path, 0, len(slots), 32, 50).collect()}
    assert {k: list(np.frombuffer(r.ids, "<u2")) for k, r in slots.items()} == read
    part = training_order.read_slots(spark, path, 40, 130, 32, 50)
    assert sorted(r.slot for r in part.collect()) == list(range(40, 130))
    own = bpe.encoder(bpe.read_vocabulary(VOCABULARY))
    for k in (3, 60):
        mine = sorted((r.part, r.n_tokens, read[r.slot]) for r in slots.values() if r.doc_id == k)
        assert [i for _, n, ids in mine for i in ids[:n]] == own.encode(dict(rows[:120])[k])
    again = own.encode("again")
    assert sum(list(ids[: slots[k].n_tokens]) == again for k, ids in read.items() if slots[k].doc_id == 7) == 2


def test_registered_order_comes_from_written_files(spark, tmp_path, monkeypatch):
    rng = random.Random(31)
    folder, path = str(tmp_path / "in"), str(tmp_path / "shards")
    documents(spark, [(k, sentence(rng, rng.randrange(0, 900))) for k in range(40)] + odd_rows(rng)).write.parquet(f"{folder}/documents.parquet")
    from clientele.llm import jobs

    monkeypatch.setattr(jobs, "new_path", lambda spark, name: path)
    found = jobs.QUERIES["op8_training_order"](spark, folder).collect()
    files = {int(x.parent.name.split("=")[1]): x.read_bytes() for x in (tmp_path / "shards").glob("shard=*/part-*")}
    size = training_order.stride(training_order.LENGTH)
    assert sorted(r.slot for r in found) == list(range(len(found))) and sum(map(len, files.values())) == len(found) * size
    assert all(r.byte_offset == r.slot % training_order.SHARD_SEQUENCES * size for r in found)
    assert all(zlib.crc32(files[r.shard][r.byte_offset : r.byte_offset + size - 1]) == r.ids_crc32 for r in found)
    nothing = training_order.written(documents(spark, [(1, "")]), VOCABULARY, str(tmp_path / "none"))
    assert nothing.collect() == []


def test_ids_of_many_texts_equal_the_library(monkeypatch):
    from tokenizers import Tokenizer

    library, own, rng = Tokenizer.from_file(VOCABULARY), bpe.Encoder(bpe.read_vocabulary(VOCABULARY)), random.Random(41)
    monkeypatch.setattr(bpe, "TOGETHER", 500)
    monkeypatch.setattr(bpe, "PACKED", 900)
    usual = "abst'mdrevl '' \n\t\r\x0b\x1c\x85\xa0\x0012½²İıſÀéñ!|<>"
    texts = ["", " ", "\n", "it's", "'s's", "a''s 'll've'r 're 'd", "x" * 300 + " " + "ab" * 40 + " y " + "!" * 70, "é" * 64 + " ok"]
    texts += ["".join(rng.choice(usual) for _ in range(rng.randrange(60))) for _ in range(2000)] + [sentence(rng, 40, 10**6) for _ in range(100)]
    mixed = texts + ["<|endoftext|>'s x", "x<|startoftext|>"] + ["".join(rng.choice(usual + "中ß́’") for _ in range(40)) for _ in range(200)]
    plain = bpe.Vocabulary.tokens
    for some in ([], [""], texts, mixed, texts[::-1]):
        ids, counts = own.packed_all(some)
        want = [library.encode(t, add_special_tokens=False).ids for t in some]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    seen = []
    monkeypatch.setattr(bpe.Vocabulary, "tokens", lambda self, word: seen.append(word) or plain(self, word))
    fresh = bpe.Encoder(bpe.read_vocabulary(VOCABULARY))
    fresh.packed_all([t for t in texts if len(t) < 64])
    assert seen == []  # usual words are not looked up one by one


def test_long_and_unknown_pairs_of_tokens(monkeypatch):
    from clientele.llm import bpe_words

    # a table of four places: every pair soon loses its place to another
    monkeypatch.setattr(bpe_words, "PAIRS", 4)
    own, rng = bpe.Encoder(bpe.read_vocabulary(VOCABULARY)), random.Random(43)
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    for _ in range(2):
        ids, sizes = own.together.ids(np.frombuffer("".join(words).encode(), np.uint8), np.cumsum([0, *map(len, words)]))
        assert sizes.tolist() == [len(own._packed_letters(w)) // 2 for w in words]
        assert ids.tobytes() == b"".join(own._packed_letters(w) for w in words)


def test_shards_are_written_part_by_part(spark, tmp_path, monkeypatch):
    rng, parts, write = random.Random(37), [], training_order.write_shards

    def watched(ordered, *args):
        parts.append({r.shard for r in ordered.select("shard").distinct().collect()})
        plan = ordered._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1  # a filter on the shard computes no slot again
        write(ordered, *args)

    monkeypatch.setattr(training_order, "write_shards", watched)
    rows = [(k, sentence(rng, rng.randrange(1, 200))) for k in range(120)]
    found = training_order.written(documents(spark, rows), VOCABULARY, str(tmp_path / "order"), length=32, shard_sequences=20).collect()
    shards = {r.shard for r in found}
    assert len(parts) == training_order.PASSES and set().union(*parts) == shards and sum(map(len, parts)) == len(shards)
    assert max(map(len, parts)) <= len(shards) // len(parts) + 1
    assert sorted(r.slot for r in found) == list(range(len(found)))
    files = {int(x.parent.name.split("=")[1]): x.read_bytes() for x in (tmp_path / "order").glob("shard=*/part-*")}
    assert all(zlib.crc32(files[r.shard][r.byte_offset : r.byte_offset + 64]) == r.ids_crc32 for r in found)


# --- language


def test_held_out_accuracy_and_privacy_of_the_test_rows(spark):
    rng = random.Random(12)
    syllables = {"aa": ["tion", "the", "ing", "er"], "bb": ["sch", "ung", "ein", "keit"], "cc": ["ção", "ão", "nho", "mente"]}
    text = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    rows = [(k, text(lang := rng.choice(sorted(syllables)), rng.randrange(3, 300)), lang) for k in range(600)]
    found = {r.doc_id: r for r in language.identify(documents(spark, rows + [(900, text("aa", 60) + " " + text("bb", 20), None), (901, None), (902, "12 !")])).collect()}
    for k, _, lang in rows:
        assert found[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2)
    held = [(found[k].lang_pred, lang) for k, _, lang in rows if found[k].held_out]
    assert len(held) > 100 and sum(a == b for a, b in held) >= 0.98 * len(held)
    assert found[900].lang_pred == "aa" and 0.6 < found[900].score < 0.9
    assert (found[901].lang_pred, found[902].lang_pred) == ("und", "und") and all(0 <= r.score <= 1 for r in found.values())
    swapped = [(k, t, "cc" if found[k].held_out else lang) for k, t, lang in rows]
    again = {r.doc_id: r.lang_pred for r in language.identify(documents(spark, swapped)).collect()}
    assert all(again[k] == found[k].lang_pred for k, _, _ in rows)


def test_marginals_equal_all_paths():
    rng = np.random.default_rng(13)
    field = language.Chain(["a", "b", "c"], np.zeros((1, 3)), np.empty(0, np.uint64), np.zeros((0, 3)), rng.normal(size=(3, 3)))
    scores = rng.normal(size=(1, 4, 3))
    from itertools import product

    total = np.zeros((4, 3))
    for path in product(range(3), repeat=4):
        p = np.exp(sum(scores[0, t, k] for t, k in enumerate(path)) + sum(field.steps[a, b] for a, b in zip(path, path[1:])))
        for t, k in enumerate(path):
            total[t, k] += p
    found, _ = field.marginals(scores, np.array([4]))
    assert np.allclose(found[0], total / total.sum(axis=1, keepdims=True))


# --- lines


def test_line_windows_by_brute_force(spark):
    rng, rows = random.Random(14), []
    shared = [f"shared line {k}" for k in range(12)]
    for k in range(60):
        lines = [rng.choice(["", "  ", f"own {rng.randrange(10**6)}"]) for _ in range(rng.randrange(6))]
        if rng.random() < 0.7:
            a = rng.randrange(9)
            lines[2:2] = shared[a : a + rng.randrange(2, 7)]
        rows.append((k, "\n".join(lines)))
    seen, want = set(), {}
    for k, text in rows:
        lines = text.split("\n")
        full = [(p, x.strip()) for p, x in enumerate(lines) if x.strip()]
        gone = set()
        for w in zip(full, full[1:], full[2:]):
            key = tuple(x for _, x in w)
            if key in seen:
                gone.update(range(w[0][0], w[-1][0] + 1))
            seen.add(key)
        want[k] = ("\n".join(x for p, x in enumerate(lines) if p not in gone), len(lines), len(gone))
    found = line_dedup.dedup_lines(documents(spark, rows), counts=("c1", "c2")).collect()
    assert {r.doc_id: (r.text, r.c1, r.c2) for r in found} == want
