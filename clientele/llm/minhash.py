"""Near-duplicate detection by one-permutation MinHash with optimal densification.

A text's set holds its distinct shingles of ``words`` words (A to Z in lower case); a text with
fewer words has its whole sequence as one shingle. Texts link if their sets' Jaccard similarity is
at least ``percent`` in a hundred.

1. One pass over the texts hashes every set once and cuts the hash range into ``BANDS * ROWS`` bins;
   a bin's value is its smallest hash. An empty bin copies the first non-empty one in a random order
   of its own (optimal densification), so agreement stays an unbiased estimate for small sets.
2. Equal sets (128-bit fingerprint and size) are one class; groups of copies end here.
3. Classes that agree on a whole band share a bucket. A bucket gives no pairs of its own but two
   stars: every member with the bucket's smallest id and with a random member, drawn anew for each
   band, so that two similar members are not always behind the same third one.
4. Links are confirmed on the full sets, in three rounds: each class with its first centre, then with
   four more, then with all others. What the rounds before have connected is not compared again, so
   a group of n near copies costs about n comparisons.
5. Components of the confirmed links by alternating large and small stars.
6. What the stars leave: members of a bucket, centres aside, that are still in different components. They
   meet by exact prefix filtering on their full sets: in any order of the hashes, two similar sets share
   one among the first few of each, fewer for the smaller set, and with the rarest first a template's hashes
   come last, so its siblings do not meet by them. No pair of a bucket is left out.

Two texts at the limit of 0.8 share no bucket at all with probability
``(1 - 0.8 ** ROWS) ** BANDS`` (3e-6); texts that are more alike, less.

Cases with a defined result: null, empty and blank texts have an empty set, link with nothing and are
kept; rows with the same id and text are one document; texts under one id that are not similar are labelled
each on its own, and dropped or kept so; very long texts give long sets, hashed in one pass; rows with a null id link with nothing and are kept, with
a null component; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegralType, LongType, StructField, StructType

from clientele.llm.bpe import Recent
from clientele.llm.inputs import pieces, texts, unused
from clientele.session import stage

BANDS, ROWS = 24, 4
BINS = BANDS * ROWS
#: A to Z in lower case, all other bytes as they are.
LOWER = bytes(range(256)).lower()
#: Ids or pairs of ids are sent to every executor up to this many rows (about 64 MB); beyond, they are joined by shuffle.
BROADCAST_ROWS = 2_000_000
#: Sizes of sets that meet by prefixes are classed in steps of this factor's logarithm.
SIZE_STEP = math.log(1.05)
#: Centres compared in the first and the second round.
FIRST, SECOND = 1, 5

_random = np.random.default_rng(7)
_ODD = _random.integers(0, 2**63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_ORDERS = np.array([_random.permutation(BINS) for _ in range(BINS)])
_EDGES = np.array([(k << 64) // BINS for k in range(BINS)], np.uint64)
_word_hash = Recent(xxhash.xxh3_64_intdigest, 50_000)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    own = text.translate(LOWER).split()
    if not own:
        return np.empty(0, np.uint64)
    word_hash = _word_hash
    hashed = np.fromiter([word_hash[w] for w in own], np.uint64, len(own))
    width = min(words, len(own))
    total = np.full(len(own) - width + 1, width, np.uint64)
    for k in range(width):
        total += hashed[k : len(own) - width + 1 + k] * _ODD[k]
    return np.unique(_mix(total))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash of each bin, empty bins densified; ``hashes`` sorted and not empty."""
    at = np.searchsorted(hashes, _EDGES)
    after = np.append(at[1:], len(hashes))
    full = after > at
    donor = np.arange(BINS)
    if not full.all():
        empty = np.flatnonzero(~full)
        orders = _ORDERS[empty]
        donor[empty] = orders[np.arange(len(empty)), full[orders].argmax(axis=1)]
    return hashes[at[donor]]


def bands(hashes: np.ndarray) -> np.ndarray:
    """One hash per band of ``ROWS`` bins."""
    rows = signature(hashes).reshape(BANDS, ROWS)
    return _mix((_mix(rows) * _ODD[8 : 8 + ROWS]).sum(axis=1, dtype=np.uint64))


def fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """Two order-free sums over the scrambled hashes, as signed numbers."""
    sums = np.array([_mix(hashes ^ _ODD[20]).sum(dtype=np.uint64), _mix(hashes * _ODD[21]).sum(dtype=np.uint64)]).view(np.int64)
    return int(sums[0]), int(sums[1])


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[np.ndarray]:
    for text in pc.cast(batch.column("text"), pa.binary()):
        yield shingle_set(text.as_py() or b"", words)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, t, n_shingles, f1, f2`` and ``bands`` (empty for an empty set)."""
    fields = [docs.schema["doc_id"], StructField("t", LongType()), StructField("n_shingles", LongType()), StructField("f1", LongType()), StructField("f2", LongType()), StructField("bands", ArrayType(LongType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            counts, prints, rows = [], [], []
            for hashes in _sets(batch, words):
                counts.append(len(hashes))
                prints.append(fingerprint(hashes))
                rows.append(bands(hashes).view(np.int64) if len(hashes) else None)
            ends = np.cumsum([0, *(BANDS * (r is not None) for r in rows)])
            values = np.concatenate([r for r in rows if r is not None] or [np.empty(0, np.int64)])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "t": batch.column("t"), "n_shingles": pa.array(counts, pa.int64()),
                "f1": pa.array([p[0] for p in prints], pa.int64()), "f2": pa.array([p[1] for p in prints], pa.int64()),
                "bands": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64())),
            })

    return docs.mapInArrow(run, StructType(fields))


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, n, s``: size and hashes of each set."""
    fields = [docs.schema["doc_id"], StructField("n", LongType()), StructField("s", ArrayType(LongType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = list(_sets(batch, words))
            ends = np.cumsum([0, *map(len, found)])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n": pa.array([len(x) for x in found], pa.int64()),
                "s": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found).view(np.int64), pa.int64())),
            })

    return docs.mapInArrow(run, StructType(fields))


def bucket_members(classes: DataFrame) -> DataFrame:
    """``node, n, bucket, least, drawn, members``: the classes of each bucket of two or more, with its two centres.

    A bucket's key holds its band. The random member is the smallest id after a scrambling that the
    key decides, which for integer ids a plain minimum finds, so only numbers are shuffled.
    """
    keys = F.transform("bands", lambda x, band: F.xxhash64(band, x))
    members = classes.select("node", "n", F.explode_outer(keys).alias("bucket"))
    if isinstance(classes.schema["node"].dataType, IntegralType):
        low, drawn = F.min(F.col("node").bitwiseXOR(F.xxhash64("bucket"))), F.col("low").bitwiseXOR(F.xxhash64("bucket"))
    else:
        low, drawn = F.min_by("node", F.xxhash64("bucket", "node")), F.col("low")
    buckets = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min("node").alias("least"), low.alias("low"))
    centres = buckets.filter("members > 1").select("bucket", "members", "least", drawn.alias("drawn"))
    return members.join(centres, "bucket")


def star_candidates(members: DataFrame) -> DataFrame:
    """``node, n, centres``: each class with the centres of its buckets, the smallest first (at most two per band)."""
    edges = members.select("node", "n", F.explode(F.array("least", "drawn")).alias("centre")).filter("node <> centre")
    return edges.groupBy("node", "n").agg(F.array_sort(F.collect_set("centre")).alias("centres"))


def unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``node, component, stray``: classes of buckets whose members, centres aside, lie in several components.

    ``stray`` if in one of them the class is not in the largest component: of any two that have not
    been compared at least one is.
    """
    others = members.filter("members > 2 AND node <> least AND node <> drawn").select("bucket", "node")
    named = others.join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    sizes = named.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("size"))
    several = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.max_by("component", F.struct("size", "component")).alias("largest")).filter("parts > 1")
    left = named.join(several, "bucket")
    return left.groupBy("node", "component").agg(F.max(F.col("component") != F.col("largest")).alias("stray"))


def prefix_meetings(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The meetings of ``left`` on a shared hash: ``node, component, n, rest`` of the smaller and the larger set.

    If the first hash two sets share has ``i`` and ``j`` before it, they share at most the smaller of ``n - i``
    and ``m - j``, and similar ones share ``percent / (100 + percent)`` of ``n + m``. As ``m >= n``, the smaller set
    shows only the hashes with ``n - i >= 2 * percent / (100 + percent) * n``: siblings from a template that
    are not similar have more hashes of their own than that leaves out, so none shows a hash of the template.
    The larger set may show more, since ``n >= percent / 100 * m``. A size class in the key keeps sets
    apart that the place of the hash forbids to be similar, before they meet.
    """
    own = sets.join(bounded(left), F.col("doc_id") == F.col("node")).select("node", "component", "stray", "n", F.explode("s").alias("h"))
    often = own.groupBy("h").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    # hashes that no other set has come first; only their number matters
    shared = own.join(often, "h").groupBy("node", "component", "stray", "n").agg(F.sort_array(F.collect_list(F.struct("often", "h"))).alias("shared"))
    first = shared.select("node", "component", "stray", "n", F.posexplode("shared").alias("place", "x"), (F.col("n") - F.size("shared")).alias("alone"))
    first = first.select("node", "component", "stray", "n", (F.col("n") - F.col("alone") - F.col("place")).alias("rest"), F.col("x.h").alias("h")).filter(100 * F.col("rest") >= percent * F.col("n"))
    first = stage(first, "prefixes")

    def side(rows: DataFrame, end: str) -> DataFrame:
        return rows.select("class", *(F.col(c).alias(f"{c}_{end}") for c in ("h", "node", "component", "stray", "n", "rest")))

    size_class = lambda n: F.floor(F.log(n) / SIZE_STEP)
    largest = F.expr(f"(rest * {100 + percent}) div {percent} - n")
    small = side(first.filter(largest >= F.col("n")).withColumn("class", F.explode(F.sequence(size_class(F.col("n")), size_class(largest)))), "a")
    large = side(first.withColumn("class", size_class(F.col("n"))), "b")
    same = (F.col("h_a") == F.col("h_b")) & (small["class"] == large["class"])
    larger = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("node_a") < F.col("node_b")))
    # of two that have not been compared one is stray
    wanted = [f"{c}_{end}" for end in "ab" for c in ("node", "component", "n", "rest")]
    strays = small.filter("stray_a").join(large, same & larger).select(*wanted)
    return strays.union(small.filter("NOT stray_a").join(large.filter("stray_b"), same & larger).select(*wanted))


def prefix_pairs(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` of ``left`` from different components that may be similar: all that are, and few others."""
    close = ((100 + percent) * F.least("rest_a", "rest_b") >= percent * (F.col("n_a") + F.col("n_b"))) & (F.col("component_a") != F.col("component_b"))
    return prefix_meetings(left, sets, percent).filter(close).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of the undirected ``a, b``."""
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    while True:
        edges = stage(edges, "links")
        # done when every node either points to one other or is pointed to
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("points")), F.struct(F.col("b").alias("node"), F.lit(0).alias("points")))).alias("e")).select("e.*")
        mixed = ends.groupBy("node").agg(F.sum("points").alias("out"), F.min("points").alias("low")).filter("out > 1 OR (out = 1 AND low = 0)")
        if mixed.isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        # large star: larger neighbours of a node move to the smallest of it and its neighbours
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: smaller neighbours of a node, and the node, move to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = large.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (ids only, staged) with a hint to send it to all executors, if it has few enough rows."""
    return F.broadcast(df) if df.count() <= most else df


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets are similar enough.

    Both sets go to the pair, so no task gathers the partners of a class that has many.
    """
    pairs = bounded(stage(pairs, "pairs"))
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa")), "a")
    right = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb")), "b")
    both = left.join(right, ["a", "b"]).filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.filter(100 * shared >= percent * (F.col("na") + F.col("nb") - shared)).select("a", "b").distinct()


def _labelled(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``near_duplicates`` of ``doc_id, text``, with the hash ``t`` of each row's text."""
    signed = stage(signatures(docs.withColumn("t", F.xxhash64("text")), words), "signatures")
    linkable = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = stage(linkable.groupBy("f1", "f2", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("node"), F.min_by("bands", "doc_id").alias("bands")), "classes")
    members = stage(bucket_members(classes), "members")
    candidates = stage(star_candidates(members), "stars")
    wanted = stage(candidates.select(F.explode(F.array_append("centres", F.col("node"))).alias("doc_id")).distinct(), "wanted")
    sets = stage(full_sets(docs.join(bounded(wanted), "doc_id", "left_semi"), words), "sets")

    pairs = candidates.select(F.col("node").alias("a"), F.posexplode("centres").alias("rank", "b"))
    labels = components(confirmed(pairs.filter(F.col("rank") < FIRST).select("a", "b"), sets, percent))
    rest = pairs.filter(F.col("rank") >= FIRST)
    for last in (SECOND, 2 * BANDS):
        of = lambda end: labels.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        apart = rest.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
        rest = stage(apart.select("a", "rank", "b"), "pairs_apart")
        if rest.isEmpty():
            break
        links = confirmed(rest.filter(F.col("rank") < last).select("a", "b"), sets, percent)
        labels = components(links.union(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        rest = rest.filter(F.col("rank") >= last)

    left = stage(unsettled(members, labels), "unsettled")
    if not left.isEmpty():
        links = confirmed(prefix_pairs(left, sets, percent), sets, percent)
        labels = components(links.union(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    named = classes.select("f1", "f2", "n", "node").join(labels, "node", "left").select("f1", "f2", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))
    found = signed.drop("bands").join(named, ["f1", "f2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", "t", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id, n_shingles, component_id`` (the smallest id reachable) and ``kept``."""
    return _labelled(texts(df, id_col, text_col), words, percent).drop("t")


def one_of_each(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one document of each component; columns stay. A row goes by its id and text, so another text under its id stays."""
    gone, gone_text = unused(df, "_gone"), unused(df, "_gone_text")
    dropped = _labelled(texts(df, id_col, text_col), words, percent).filter("NOT kept").select(F.col("doc_id").alias(gone), F.col("t").alias(gone_text)).distinct()
    return df.join(dropped, (F.col(f"`{id_col}`") == F.col(gone)) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col(gone_text)), "left_anti")
