"""Benchmark decontamination by fingerprints of item-sized windows (DataFrame functions only).

Texts and items are words (letters and digits, lower case) and shingles of five words. For an item
of n words, the windows of n words of a text are compared with it:

1. A window can be similar enough only if it holds one of the item's *anchors*: its rarest
   shingles, as many as weigh more than ``1 - threshold`` of the item. Positions of anchors in the
   text say where the item would start; windows start there, give or take ``slack`` words. (Where
   words are put in or left out between two anchors, the window at either place loses as many.)
2. Every distinct window gets a 64-bit SimHash of its weighted shingles, as every item has one.
3. A multi-index finds the fingerprints within ``RADIUS`` bits: both are cut into four blocks of 16
   bits, and if 15 bits differ at most, one block differs in three at most. Items are filed under
   every value within two bits of a block and windows look up every value within one bit.
4. The weighted Jaccard similarity of the shingles, computed exactly, decides.

A shingle weighs by rarity among the items (integers, so sums are exact): ``1 + floor(log2(items /
items with it))``, at most ``MAX_WEIGHT``; shingles that no item has weigh like those of one item.
An item shorter than a shingle is one shingle of all its words and matches only a text equal to it.

Cases with a defined result: null and empty texts are not contaminated; items without words match
nothing; equal items share one entry, and a result lists all their ids; in the report rows with the same id
are one document, and null ids are one too, but only rows whose own text is contaminated are dropped; very long
texts are cut into windows like others; other columns are not read; an empty benchmark or empty documents
give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.llm.inputs import texts, unused, whole
from clientele.session import stage

SHINGLE = 5
RADIUS = 15
BLOCKS, BLOCK_BITS = 4, 16
#: Bits by which an item's and a window's block may differ from the value both are filed under.
ITEM_BITS, WINDOW_BITS = 2, 1
MAX_WEIGHT = 16
SLACK = 0
#: Anchors are sent to every executor up to this many rows (about 100 MB); beyond, they are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def _masks(bits: int) -> list[int]:
    """All block values with at most so many bits set."""
    return [m for m in range(1 << BLOCK_BITS) if m.bit_count() <= bits]


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(whole(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _hashed(df: DataFrame, key: str) -> DataFrame:
    """``key, n`` (words) and ``h``: hashes of the shingles in order."""
    hashed = df.select(key, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))
    shingles = F.transform(F.sequence(F.lit(0), F.size("w") - SHINGLE), lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(SHINGLE))))
    short = F.array(F.aggregate("w", F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x)))
    # a filter on w would be computed a second time below the projection; a text without words has no shingles
    return hashed.select(key, F.size("w").alias("n"), F.when(F.size("w") >= SHINGLE, shingles).when(F.size("w") > 0, short).otherwise(F.array().cast("array<bigint>")).alias("h"))


def _weigh(df: DataFrame, shingles: DataFrame, most: Column) -> DataFrame:
    """``df`` (column ``h``) with ``s``: distinct shingles sorted, each with its count and weight."""
    keys = [c for c in df.columns if c != "h"]
    counted = df.select(*keys, F.explode("h").alias("x")).groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("count"))
    weighed = counted.join(shingles, "x", "left").withColumn("weight", F.col("count") * F.coalesce("w", most))
    return weighed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("x", "weight"))).alias("s"))


def _fingerprint(s: str) -> Column:
    """SimHash of the weighted shingles in column ``s``."""
    votes = f"transform(sequence(0, 63), b -> aggregate({s}, 0L, (a, v) -> a + if((shiftright(v.x, b) & 1L) = 1L, v.weight, -v.weight)))"
    return F.expr(f"aggregate(transform({votes}, (v, b) -> if(v > 0, shiftleft(1L, b), 0L)), 0L, (a, v) -> a | v)")


def _blocks(df: DataFrame, bits: int) -> DataFrame:
    """``df`` filed under every value within ``bits`` bits of each block of ``fp``."""
    masks = F.array(*(F.lit(m) for m in _masks(bits)))
    cut = df.withColumn("block", F.explode(F.array(*(F.lit(k) for k in range(BLOCKS)))))
    value = F.expr(f"cast(shiftright(fp, block * {BLOCK_BITS}) & {(1 << BLOCK_BITS) - 1} as int)")
    return cut.withColumn("value", value).withColumn("value", F.explode(F.transform(masks, lambda m: F.col("value").bitwiseXOR(m))))


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct items: ``item`` (the smallest id), ``ids``, ``n`` words, ``h`` shingle hashes."""
    hashed = _hashed(benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")
    grouped = hashed.filter("n > 0").groupBy("n", "h").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    return grouped.select(F.xxhash64("n", "h").alias("item"), "ids", "n", "h")


def contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    threshold: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    slack: int = SLACK,
) -> DataFrame:
    """Per contaminated document ``doc_id, item_ids`` (sorted) and ``similarity`` (the best).

    The items are staged with weights and fingerprints. The texts are read once, in one stage that
    ends with the few anchors found; from there on only windows around anchors are shuffled, and
    equal windows (copies of a passage) are one.
    """
    items = stage(_items(benchmark, item_id_col, item_text_col), "items")
    spread = items.select("item", F.posexplode("h").alias("at", "x"))
    holders = spread.groupBy("x").agg(F.countDistinct("item").alias("items"))
    total = items.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).first()[0]
    weight = lambda having: F.least(F.lit(MAX_WEIGHT), 1 + F.floor(F.log2(F.lit(total) / having) + 1e-9)).cast("long")
    shingles = stage(holders.select("x", weight(F.col("items")).alias("w")), "shingle_weights")
    most = weight(F.lit(1))
    known = stage(_weigh(items.select("item", "n", "h"), shingles, most).withColumn("fp", _fingerprint("s")), "item_fingerprints")

    # rarest shingles first, until those left out weigh no more than the threshold allows
    ranked = F.reverse(F.array_sort(F.transform("s", lambda v: F.struct(v.weight.alias("weight"), v.x.alias("x")))))
    sums = "transform(sequence(1, size(r)), i -> aggregate(slice(r, 1, i - 1), 0L, (a, v) -> a + v.weight))"
    chosen = known.withColumn("r", ranked).selectExpr("item", "n", "r", f"{sums} AS before", "aggregate(r, 0L, (a, v) -> a + v.weight) AS full")
    kept = chosen.select("item", "n", F.explode(F.expr(f"filter(transform(r, (v, i) -> struct(v.x AS x, before[i] AS before)), v -> v.before <= {1 - threshold} * full + 1e-9)")).alias("v"), "full")
    anchors = stage(kept.select("item", "n", F.col("v.x").alias("x")).join(spread, ["item", "x"]).select("x", "item", "n", "at"), "anchors")
    if anchors.count() <= BROADCAST_ROWS:
        anchors = F.broadcast(anchors)

    size = F.greatest(F.col("n") - (SHINGLE - 1), F.lit(1))
    # the outer form: for the inner one Spark would add a filter that hashes every text again; the join drops what it adds
    positions = _hashed(texts(documents, id_col, text_col), "doc_id").select("doc_id", "h", F.posexplode_outer("h").alias("pos", "x"))
    begin = F.col("pos") - F.col("at") + F.col("shift")
    hits = positions.join(anchors, "x").withColumn("shift", F.explode(F.array(*(F.lit(k) for k in range(-slack, slack + 1)))))
    # a text that ends or starts inside the window gives a shorter one
    first = F.greatest(begin, F.lit(0))
    length = F.least(begin + size, F.size("h")) - first
    windows = hits.filter(length > 0).select("doc_id", "item", "n", F.slice("h", first + 1, length).alias("h"))
    found = stage(windows.select("doc_id", "n", "h").withColumn("window", F.xxhash64("n", "h")).dropDuplicates(["doc_id", "n", "window"]), "windows")

    distinct = found.groupBy("n", "window").agg(F.first("h").alias("h"))
    prints = stage(_weigh(distinct, shingles, most).withColumn("fp", _fingerprint("s")), "window_fingerprints")
    filed = _blocks(known.select("item", "n", "fp"), ITEM_BITS).select("item", "n", "block", "value", F.col("fp").alias("item_fp"))
    looked_up = _blocks(prints.select("window", "n", "fp"), WINDOW_BITS)
    near = looked_up.join(filed, ["n", "block", "value"]).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    pairs = near.select("window", "item", "n").distinct()

    left, right = prints.select("window", "n", F.col("s").alias("a")), known.select("item", "n", F.col("s").alias("b"))
    # the smaller weight of what both have, over the larger weight of what either has
    both = pairs.join(left, ["window", "n"]).join(right, ["item", "n"]).withColumn("m", F.expr("map_from_entries(b)"))
    shared = F.expr("aggregate(a, 0L, (t, v) -> t + least(v.weight, coalesce(m[v.x], 0L)))")
    either = F.expr("aggregate(a, 0L, (t, v) -> t + v.weight) + aggregate(b, 0L, (t, v) -> t + v.weight)") - F.col("shared")
    scored = both.withColumn("shared", shared).withColumn("similarity", F.col("shared") / either).filter(F.col("similarity") >= threshold - 1e-12)
    passages = scored.select("window", "n", "item", "similarity")
    hits = found.select("doc_id", "n", "window").join(passages, ["n", "window"]).join(items.select("item", "ids"), "item")
    return hits.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("item_ids"), F.max("similarity").alias("similarity"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``documents`` without the contaminated ones; columns stay. A row goes by its id and text, so a clean text under the same or no id stays."""
    key, text = unused(documents, "_key"), F.col(f"`{text_col}`")
    keyed = documents.select(F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("t")).alias(key), text.alias("text"))
    bad = contaminated(keyed, benchmark, id_col=key, text_col="text", **options).select(F.col("doc_id.id").alias("_bad_id"), F.col("doc_id.t").alias("_bad_text"))
    return documents.join(bad, F.col(f"`{id_col}`").eqNullSafe(bad._bad_id) & (F.xxhash64(text) == bad._bad_text), "left_anti")
