"""Ranked lexical search with range-maximum sparse tables over posting lists, best document intervals first.

1. One pass over the texts writes, for every document, its number of terms and how often it has each term
   of the queries. Counts over all documents (documents, terms, documents of each term) come from that table.
2. A task reads its documents in blocks of a bounded number of postings. A block's documents are numbered, those
   with much impact together; a term's posting list has them in that order with their impact on a score,
   and a sparse table that gives the largest impact of any range of the list.
3. For every query a block is one interval of documents, bounded by the sum of its terms' largest impacts. The
   intervals with the highest bounds go first: such an interval is split at the document that has its
   largest single impact, which is scored in full; what lies to its left and right are two new intervals with bounds
   of their own. Intervals whose bound is below the ``k``-th best score so far (of all blocks the task has read)
   are dropped, so nothing that belongs to the answer is.
4. The tasks' best ``k`` of each query meet in two rounds, the first in parts of the documents.

Queries are read in blocks of about ``QUERY_BYTES``, each searched on its own.

A score sums, over a query's terms with repeats, ``w * ((1e9 * tf) div (1000 * tf + 12 * m))`` in whole numbers, where ``w`` is
``floor(1000 * ln((2N + 2) / (2 df + 1)))`` and ``m`` is ``75 + (25 * n * N) div L``.

Cases with a defined result: null and empty texts have no terms; every row of the documents is a document, so repeated rows take ranks
of their own; a null document id comes before all others on a tie; rows of one query id, null included, are one
query with the terms of its distinct texts; a query without terms, or without a document that has one, has no rows; empty tables
give an empty table; very long texts are read whole, their postings are as many as the queries' terms at most; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from clientele.llm.inputs import pieces, texts
from clientele.session import stage

QUERY_BYTES = 8 << 20
BLOCK_POSTINGS = 300_000
#: Numbers held for the intervals of a group of queries: documents x terms x queries at most.
HELD = 8 << 20
PARTS = 64
#: Digits, A to Z in lower case and everything beyond ASCII; all other bytes separate terms.
TERM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(TERM_BYTES).split()


@dataclass
class Queries:
    """Terms of some queries: their codes, how often each query has them, and the weights."""

    ids: list
    terms: list[dict[int, int]]
    weights: np.ndarray
    documents: int
    all_terms: int

    def groups(self, documents: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Queries of like length together: their places, codes and repeats; filled up with a code that no list has."""
        order = sorted(range(len(self.ids)), key=lambda q: len(self.terms[q]))
        begin = 0
        while begin < len(order):
            end, width = begin, 0
            while end < len(order):
                wider = len(self.terms[order[end]])
                if end > begin and ((end - begin + 1) * wider * documents > HELD or wider > 2 * len(self.terms[order[begin]])):
                    break
                end, width = end + 1, wider
            some = order[begin:end]
            codes, repeats = np.full((len(some), width), len(self.weights), np.int64), np.zeros((len(some), width), np.int64)
            for row, q in enumerate(some):
                own = self.terms[q]
                codes[row, : len(own)], repeats[row, : len(own)] = list(own.keys()), list(own.values())
            yield np.array(some), codes, repeats
            begin = end


def impacts(weights: np.ndarray, tf: np.ndarray, n: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """What postings with the term's weight, its occurrences and the document's number of terms add to a score."""
    if 25 * int(n.max(initial=0)) * documents < 1 << 63:
        m = 75 + (25 * n * documents) // all_terms
    else:
        m = 75 + np.array([25 * x * documents // all_terms for x in n.tolist()], np.int64)
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))


class Block:
    """Posting lists of some documents, one behind the other, with their sparse tables."""

    def __init__(self, sizes: np.ndarray, codes: np.ndarray, tf: np.ndarray, n: np.ndarray, queries: Queries) -> None:
        self.documents = len(sizes)
        owner = np.repeat(np.arange(self.documents), sizes)
        value = impacts(queries.weights[codes], tf, n[owner], queries.documents, queries.all_terms)
        self.order = np.argsort(-np.bincount(owner, value, self.documents), kind="stable")  # place to row
        place = np.empty(self.documents, np.int64)
        place[self.order] = np.arange(self.documents)
        keys = codes * self.documents + place[owner]
        sort = np.argsort(keys)
        self.keys, self.value, self.place = keys[sort], value[sort], place[owner][sort]
        self.starts = np.searchsorted(self.keys, np.arange(len(queries.weights) + 2) * self.documents)
        longest = int(np.diff(self.starts).max(initial=1))
        # the place of the largest value among 2 ** level postings; ranges asked for never cross the end of a list
        self.largest = np.zeros((max(1, longest.bit_length()), len(keys)), np.int32)
        self.largest[0] = np.arange(len(keys))
        for level in range(1, len(self.largest)):
            half, count = 1 << (level - 1), len(keys) - (1 << level) + 1
            a, b = self.largest[level - 1][:count], self.largest[level - 1][half : half + count]
            self.largest[level][:count] = np.where(self.value[a] >= self.value[b], a, b)
        self.level = np.zeros(longest + 1, np.int64)
        for level in range(1, len(self.largest)):
            self.level[1 << level :] = level

    def bounds(self, begin: np.ndarray, end: np.ndarray, repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of intervals (rows) given by a range of each term's list: the bound, and the place of the document with the largest impact."""
        length = end - begin
        level = self.level[length]
        a = self.largest[level, np.minimum(begin, len(self.keys) - 1)]
        b = self.largest[level, np.maximum(end - (1 << level), 0)]
        best = np.where(self.value[a] >= self.value[b], a, b)
        most = np.where(length > 0, repeats * self.value[best], 0)
        column = most.argmax(axis=1)
        return most.sum(axis=1), self.place[best[np.arange(len(best)), column]]

    def search(self, codes: np.ndarray, repeats: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, row and score of all documents that reach a query's ``k``-th best score; ``best`` (queries, k) is brought up to date."""
        k = best.shape[1]
        item = np.arange(len(codes))
        begin, end = self.starts[codes], self.starts[codes + 1]
        bound, split = self.bounds(begin, end, repeats)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        most = 4
        while True:
            live = (bound > 0) & (bound >= best[item, 0])  # best is in rising order
            if not live.all():
                item, begin, end, bound, split = item[live], begin[live], end[live], bound[live], split[live]
            if not len(item):
                break
            order = np.lexsort((-bound, item))
            first = np.searchsorted(item[order], item[order])
            nth = np.arange(len(order)) - first
            now = order[nth < most]
            later = order[nth >= most]
            its = item[now]
            wanted = codes[its] * self.documents + split[now][:, None]
            at = np.searchsorted(self.keys, wanted)
            there = self.keys[np.minimum(at, len(self.keys) - 1)] == wanted
            score = np.where(there, repeats[its] * self.value[np.minimum(at, len(self.keys) - 1)], 0).sum(axis=1)
            found.append((its, self.order[split[now]], score))
            scores = np.zeros((len(codes), min(most, int(nth.max()) + 1)), np.int64)
            scores[its, nth[nth < most]] = score
            best[:] = np.sort(np.concatenate([best, scores], axis=1), axis=1)[:, -k:]
            # the two sides of each split
            sides = np.concatenate([its, its])
            new_begin, new_end = np.concatenate([begin[now], at + there]), np.concatenate([at, end[now]])
            new_bound, new_split = self.bounds(new_begin, new_end, repeats[sides])
            hope = (new_bound > 0) & (new_bound >= best[sides, 0])
            item, bound, split = np.concatenate([item[later], sides[hope]]), np.concatenate([bound[later], new_bound[hope]]), np.concatenate([split[later], new_split[hope]])
            begin, end = np.concatenate([begin[later], new_begin[hope]]), np.concatenate([end[later], new_end[hope]])
            most = min(2 * most, 64)
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        its, rows, score = (np.concatenate(c) for c in zip(*found))
        kept = (score > 0) & (score >= best[its, 0])
        return its[kept], rows[kept], score[kept]


def counted_terms(docs: DataFrame, codes: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, codes, tfs``: number of terms of each document, and its occurrences of the coded terms."""
    shared = docs.sparkSession.sparkContext.broadcast(codes)
    fields = [docs.schema["doc_id"], StructField("n", LongType()), StructField("codes", ArrayType(IntegerType())), StructField("tfs", ArrayType(IntegerType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in pieces(batches):
            counts, ends, found, often = [], [0], [], []
            for text in pc.cast(batch.column("text"), pa.binary()):
                terms = Counter(terms_of(text.as_py() or b""))
                counts.append(terms.total())
                for term in terms.keys() & known.keys():
                    found.append(known[term])
                    often.append(terms[term])
                ends.append(len(found))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (found, often)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), *lists], names=["doc_id", "n", "codes", "tfs"])

    return docs.mapInArrow(run, StructType(fields))


def best_of_tasks(index: DataFrame, queries: Queries, item_field: StructField, k: int, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """``item_id, doc_id, score``: each task's ``k`` best documents of every query."""
    shared = index.sparkSession.sparkContext.broadcast(queries)
    widest = max(map(len, queries.terms))
    most_documents = max(16, HELD // widest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        best = np.zeros((len(own.ids), k), np.int64)
        kept: pa.Table | None = None

        def searched(rows: pa.Table, kept: pa.Table | None) -> pa.Table | None:
            """The best of the documents kept and those of one block."""
            codes, tf = (rows[c].combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("codes", "tfs"))
            if not len(codes):
                return kept
            sizes = pc.list_value_length(rows["codes"]).to_numpy().astype(np.int64)
            block = Block(sizes, codes, tf, rows["n"].to_numpy().astype(np.int64), own)
            parts = [kept] if kept is not None else []
            for some, own_codes, repeats in own.groups(block.documents):
                limits = best[some]
                its, at, score = block.search(own_codes, repeats, limits)
                best[some] = limits
                parts.append(pa.table({"item": pa.array(some[its]), "score": pa.array(score), "doc_id": rows["doc_id"].take(pa.array(at))}))
            every = pa.concat_tables(parts)
            order = pc.sort_indices(every, [("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")], null_placement="at_start")
            every = every.take(order)
            item = every["item"].to_numpy()
            return every.filter(pa.array(np.arange(len(item)) - np.searchsorted(item, item) < k))

        waiting: list[pa.RecordBatch] = []
        postings = documents = 0
        for batch in batches:
            sizes = np.cumsum(pc.list_value_length(batch.column("codes")).to_numpy(zero_copy_only=False))
            begin = 0
            while begin < batch.num_rows:
                before = int(sizes[begin - 1]) if begin else 0
                room = int(np.searchsorted(sizes, before + block_postings - postings, "right")) - begin
                take = min(batch.num_rows - begin, max(room, 0 if waiting else 1), most_documents - documents)
                if take:
                    waiting.append(batch.slice(begin, take))
                    postings, documents = postings + int(sizes[begin + take - 1]) - before, documents + take
                    begin += take
                if begin < batch.num_rows:  # the block is full
                    kept = searched(pa.Table.from_batches(waiting), kept)
                    waiting, postings, documents = [], 0, 0
        if waiting:
            kept = searched(pa.Table.from_batches(waiting), kept)
        if kept is not None and kept.num_rows:
            items = pa.array([own.ids[i] for i in kept["item"].to_pylist()], to_arrow_type(item_field.dataType))
            yield from pa.table({"item_id": items, "doc_id": kept["doc_id"], "score": kept["score"]}).combine_chunks().to_batches()

    return index.mapInArrow(run, StructType([item_field, index.schema["doc_id"], StructField("score", LongType())]))


def _ranked(found: DataFrame, keys: str, k: int) -> DataFrame:
    order = F.expr(f"row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, doc_id ASC NULLS FIRST)")
    return found.withColumn("rank", order.cast("int")).filter(F.col("rank") <= k)


def search(df: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", query_bytes: int = QUERY_BYTES, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents with the highest scores above 0 for each item."""
    docs = texts(df, id_col, text_col)
    asked = texts(items, item_col, item_text_col).withColumnRenamed("doc_id", "item_id").filter("text IS NOT NULL").distinct()
    total = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // query_bytes))
    field = asked.schema["item_id"]
    parts = [_searched(docs, asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), field, k, block_postings) for b in range(blocks)]
    parts = [p for p in parts if p is not None]
    if not parts:
        return df.sparkSession.createDataFrame([], StructType([field, StructField("rank", IntegerType()), docs.schema["doc_id"], StructField("score", LongType())]))
    found = reduce(DataFrame.union, parts)
    few = _ranked(found, f"item_id, pmod(xxhash64(doc_id), {PARTS})", k).drop("rank")
    return _ranked(few, "item_id", k).select("item_id", "rank", "doc_id", "score")


def _searched(docs: DataFrame, asked: DataFrame, field: StructField, k: int, block_postings: int) -> DataFrame | None:
    """The tasks' best documents for one block of queries, whose texts have a bounded size."""
    terms: dict[object, Counter] = {}
    for item, text in asked.collect():
        terms.setdefault(item, Counter()).update(terms_of(text.encode()))
    terms = {item: c for item, c in terms.items() if c}
    if not terms:
        return None
    codes: dict[bytes, int] = {}
    coded = [{codes.setdefault(t, len(codes)): n for t, n in c.items()} for c in terms.values()]
    index = stage(counted_terms(docs, codes), "postings")
    sizes = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not sizes[1]:
        return None
    # one row per term of the block's queries
    held = index.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("df")).collect()
    weights = np.zeros(len(codes), np.int64)
    for code, df in held:
        weights[code] = math.floor(1000 * math.log((2 * sizes[0] + 2) / (2 * df + 1)))
    return best_of_tasks(index, Queries(list(terms), coded, weights, sizes[0], sizes[1]), field, k, block_postings)
