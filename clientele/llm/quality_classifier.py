"""Quality classifier: a linear support vector machine on n-gram indicators scaled by naive Bayes log-count ratios.

1. Features are indicators: has the text a given n-gram? N-grams are of bytes (one to three) and of word shapes (one to three; a
   shape says how a word begins, goes on and ends, and whether it repeats the word before), hashed into ``BUCKETS``.
2. The naive Bayes part: ``r = log((p / |p|) / (q / |q|))``, where ``p`` and ``q`` count the learning texts of either class that have the
   n-gram, plus one. An indicator's value is its ``r``; a text's values are scaled to length one, so that long
   and short texts compare.
3. The support vector part: hinge loss with a quadratic penalty, by dual coordinate descent (Hsieh et al., "A Dual Coordinate Descent
   Method for Large-scale Linear SVM", ICML 2008). The weights are folded with ``r`` into one number per bucket.
4. The margin becomes a probability by a logistic curve fitted on every ``HELD``-th learning text, which the machine has not seen.

The model is learned from a bounded sample: about ``TRAIN_ROWS`` labelled ids (all of them, if there are no more), drawn by a hash of the
id; of an id with several texts the smallest one. Ids with ``crc32(id) mod 5 = 0`` are never learned from. Scores read nothing but the text.

Cases with a defined result: null and empty texts have no features and the score of the model's intercept; so has every text if there
is nothing to learn from, or only one class (then all scores are that class's); a null id is not held out and never learned
from; null labels are left out, and an id with both labels is learned from with both; rows repeat as often as they come; very long texts
are read whole, in slices (of a word longer than ``SLICE`` bytes the first one tells its shape); an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from clientele.llm.inputs import pieces, texts, unused

BUCKETS = 1 << 16
BYTES, SHAPES = (1, 2, 3), (1, 2, 3)
TRAIN_ROWS = 6000
HELD = 5
PENALTY, ROUNDS = 1.0, 20
LIMIT = 0.3
SLICE = 1 << 18
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def _kinds() -> np.ndarray:
    """Kind of each byte: other, small letter, capital, digit, mark of a sentence, symbol, beyond ASCII."""
    kinds = np.zeros(256, np.uint64)
    for b in range(256):
        c = chr(b)
        kinds[b] = 6 if b >= 128 else 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c in ".,;:?!'\"()-" else 5 if c.isprintable() and b != 32 else 0
    return kinds


KIND = _kinds()


def _buckets(values: np.ndarray, salt: int) -> np.ndarray:
    mixed = (values + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(48)).astype(np.int64)


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a run of bytes begin and end."""
    inside = np.concatenate([[False], ~BLANK[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def _slice_features(data: np.ndarray, known: int, into: np.ndarray) -> np.ndarray:
    """Mark the buckets of a run of bytes whose first ``known`` words are only there as those before the others; where its words begin."""
    wide = data.astype(np.uint64)
    value = np.zeros(len(wide), np.uint64)
    for n in range(1, max(BYTES) + 1):
        value = value[: len(wide) - n + 1] * np.uint64(256) + wide[n - 1 :]
        if n in BYTES and len(value):
            into[_buckets(value, n)] = True
    begin, end = _words(data)
    if not len(begin):
        return begin
    length = end - begin
    weights = np.multiply.accumulate(np.full(int(length.max()), 6364136223846793005, np.uint64))
    place = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    letters = wide[np.repeat(begin, length) + place]
    word = np.add.reduceat((letters + np.uint64(7)) * weights[place], np.cumsum(length) - length)
    again = np.concatenate([[False], word[1:] == word[:-1]])
    second = np.where(length > 1, KIND[data[np.minimum(begin + 1, end - 1)]], np.uint64(7))
    shape = ((KIND[data[begin]] * np.uint64(8) + second) * np.uint64(8) + KIND[data[end - 1]]) * np.uint64(2) + again
    value = np.zeros(len(shape), np.uint64)
    for n in range(1, max(SHAPES) + 1):
        value = value[: len(shape) - n + 1] * np.uint64(1024) + shape[n - 1 :]
        if n in SHAPES and len(value):
            into[_buckets(value[max(0, known - n + 1) :], 100 + n)] = True
    return begin


def features(text: bytes, size: int = SLICE) -> np.ndarray:
    """The buckets of a text's n-grams, rising; the text is read in slices, each with the three words before it."""
    found = np.zeros(BUCKETS, bool)
    data = np.frombuffer(text, np.uint8)
    begin = before = 0
    while begin < len(data):
        end = min(begin + size, len(data))
        if end < len(data) and len(blanks := np.flatnonzero(BLANK[data[begin:end]])):
            end = begin + int(blanks[-1]) + 1
        starts = _slice_features(data[before:end], len(_words(data[before:begin])[0]), found)
        begin, before = end, max(end - 8 * size, before + int(starts[-3:][0]) if len(starts) else end - 2, 0)
    return np.flatnonzero(found)


@dataclass
class Model:
    """Weights of the buckets (naive Bayes ratio times support vector weight), ratios, and the logistic curve."""

    weights: np.ndarray
    ratios: np.ndarray
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        length = float(np.sqrt((self.ratios[found] ** 2).sum()))
        return float(self.weights[found].sum()) / length if length > 0 else 0.0

    def score(self, text: bytes) -> float:
        return 1.0 / (1.0 + float(np.exp(-np.clip(self.slope * self.margin(features(text)) + self.offset, -500.0, 500.0))))


def descend(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, size: int, seed: int = 11) -> np.ndarray:
    """Weights of the hinge-loss machine over sparse ``rows`` (places, values) by dual coordinate descent; the last place is the bias."""
    weights, dual = np.zeros(size + 1), np.zeros(len(rows))
    norms = [float((v * v).sum()) + 1.0 for _, v in rows]
    # the rarer class weighs as much as the other
    share = {s: max(1, int((signs == s).sum())) for s in (1, -1)}
    most = [PENALTY * len(rows) / (2 * share[int(s)]) for s in signs]
    rng = np.random.default_rng(seed)
    for _ in range(ROUNDS):
        moved = 0.0
        for k in rng.permutation(len(rows)):
            at, values = rows[k]
            slope = signs[k] * (float(weights[at] @ values) + weights[-1]) - 1.0
            new = min(max(dual[k] - slope / norms[k], 0.0), most[k])
            step = new - dual[k]
            if step:
                dual[k] = new
                weights[at] += step * signs[k] * values
                weights[-1] += step * signs[k]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weights


def curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve of the labels over the margins, by Newton's method on smoothed targets."""
    good, bad = int(labels.sum()), int((1 - labels).sum())
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    found = np.array([0.0, np.log((good + 1) / (bad + 1))])
    loss = lambda w: float(np.sum(np.logaddexp(0, x @ w) - target * (x @ w)))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ found, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), x.T @ (target - p))
        scale = 1.0
        while scale > 1e-6 and loss(found + scale * step) > loss(found):
            scale /= 2
        found = found + scale * step
        if np.abs(scale * step).max() < 1e-9:
            break
    return float(found[0]), float(found[1])


def learn(examples: list[tuple[np.ndarray, int]]) -> Model:
    """A model from (buckets, label) pairs; every ``HELD``-th pair fits the curve only."""
    labels = np.array([y for _, y in examples], np.int64)
    if not len(examples) or labels.min() == labels.max():
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0 if not len(examples) else 50.0 * (2 * int(labels[0]) - 1))
    for_curve = np.arange(len(examples)) % HELD == 0
    if len(set(labels[for_curve])) < 2 or len(set(labels[~for_curve])) < 2:  # too few to hold any back
        for_curve[:] = False
    counts = np.ones((2, BUCKETS))
    for k in np.flatnonzero(~for_curve):
        counts[labels[k], examples[k][0]] += 1
    ratios = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    rows = []
    for found, _ in examples:
        values = ratios[found]
        length = np.sqrt((values * values).sum())
        rows.append((found, values / length if length > 0 else values))
    used = np.flatnonzero(~for_curve)
    weights = descend([rows[k] for k in used], 2 * labels[used] - 1, BUCKETS)
    margins = np.array([float(weights[at] @ values) for at, values in rows])
    fitted = for_curve if for_curve.any() else np.ones(len(rows), bool)
    return Model(weights[:-1] * ratios, ratios, *curve(margins[fitted], labels[fitted]))


def held_out(id_col: Column) -> Column:
    """Whether a row is for testing: the checksum of its id as text leaves 0 on division by 5."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """A model from the bounded sample the module describes; ``labels`` has ``id_col`` and ``label_col``."""
    known = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"))).distinct()
    scale = 1 << 30
    share = min(scale, int(scale * rows / max(1, known.count())))
    # about ``rows`` ids and their labels: small enough for every executor
    drawn = F.broadcast(known.filter(F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(scale)) < share))
    # copies of an id are combined before the shuffle, so an id that many rows have stays one row a task
    chosen = texts(df, id_col, text_col).join(drawn, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [features(t.as_py() or b"").astype(np.uint16).tobytes() for t in pc.cast(batch.column("text"), pa.binary())]
            yield pa.RecordBatch.from_arrays([pc.cast(batch.column("doc_id"), pa.string()), batch.column("label"), pa.array(found, pa.binary())], names=["id", "label", "found"])

    examples = chosen.mapInArrow(run, "id string, label int, found binary").collect()
    examples.sort(key=lambda r: (r.id, r.label))
    return learn([(np.frombuffer(r.found, np.uint16).astype(np.int64), r.label) for r in examples])


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", limit: float = LIMIT) -> DataFrame:
    """Per text ``doc_id, held_out, score, predicted``."""
    identity, flag = F.col(f"`{id_col}`"), unused(df, "_held_out")
    docs = df.select(identity.alias("doc_id"), F.col(f"`{text_col}`").alias("text"), held_out(identity).alias(flag))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in pieces(batches):
            found = np.array([own.score(t.as_py() or b"") for t in pc.cast(batch.column("text"), pa.binary())])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "held_out": batch.column(flag),
                "score": pa.array(found, pa.float64()), "predicted": pa.array((found >= limit).astype(np.int32)),
            })

    return docs.mapInArrow(run, StructType([docs.schema["doc_id"], StructField("held_out", BooleanType()), StructField("score", DoubleType()), StructField("predicted", IntegerType())]))


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> DataFrame:
    """``train`` and ``score``."""
    return score(df, train(df, labels, id_col, text_col, label_col, rows), id_col, text_col)
