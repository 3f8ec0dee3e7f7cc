"""Quality rules by distribution divergence.

A text's histograms of character classes and of common words are compared with the reference of its
language by the Jensen-Shannon distance (base 2, so between 0 and 1). References are counts over all
texts of ``MIN_WORDS`` words or more:

* every language whose texts have ``MIN_REFERENCE`` words has one, whatever its share of the rows, of at
  most ``1 / COMMON`` words; texts of other languages are not compared, and never with a mixture. A
  text without a language is compared with the reference whose limits it keeps best;
* a language's common words are all those that make up at least ``COMMON`` of its words. Each task
  keeps a frequent-words summary of bounded size; the summed counts miss a word by at most half that
  share, so at most ``2 / COMMON`` words per language stay candidates, among them all common ones,
  and a second pass counts the candidates exactly.

A text is compared only if it has ``MIN_COMPARED`` words. A text that fails a base rule, or lies further from its reference than the
limits, is rejected.

Cases with a defined result: null, empty and blank texts have no words and fail the base rules; rows
repeat as often as they come; an empty table gives an empty table; an empty language is a null one;
without any text of ``MIN_WORDS`` words nothing is compared; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clientele.llm.inputs import pieces, unused
from clientele.session import stage

BLANKS = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
COMMON = 0.01
KEPT = round(2 / COMMON)
MIN_WORDS = 10
MIN_COMPARED = 30
MIN_REFERENCE = 1000
#: Languages a task counts before it hands on what it has.
HELD = 1000
REST = ""
#: A to Z in lower case, ASCII punctuation and white space as blanks.
BARE = bytes(ord(chr(b).lower()) if chr(b).isalnum() and b < 128 else 32 if b < 128 else b for b in range(256))


def _classes() -> tuple[list[str], np.ndarray]:
    """Character classes, and the class of each byte: of ASCII by kind, of other characters by their first byte."""
    names = ["vowel", "consonant", "upper", "digit", "blank", "line", "stop", "mark", "symbol", "control", "latin", "two", "three", "four", "inside"]
    of = np.zeros(256, np.int64)
    for b in range(128):
        c = chr(b)
        kind = (
            "vowel" if c in "aeiou" else "consonant" if c.islower() else "upper" if c.isupper() else "digit" if c.isdigit()
            else "line" if c in "\n\r" else "blank" if c in " \t\x0b\x0c" else "stop" if c in ".,;:?" else "symbol" if c in "#*$%&|<>+=@^_~\\`{}[]/"
            else "mark" if c.isprintable() else "control"
        )
        of[b] = names.index(kind)
    for b in range(128, 256):
        of[b] = names.index("inside" if b < 0xC0 else "latin" if b < 0xC4 else "two" if b < 0xE0 else "three" if b < 0xF0 else "four")
    return names, of


CLASS_NAMES, CLASS_OF = _classes()
CLASSES = len(CLASS_NAMES) - 1  # bytes inside a character do not count


def class_counts(text: bytes) -> np.ndarray:
    """Characters of each class."""
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    return np.bincount(CLASS_OF, weights=seen, minlength=CLASSES + 1)[:CLASSES]


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of five that the text has at least twice, the first one included."""
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    covered, end = 0, 0
    for at, window in enumerate(windows):
        if often[window] > 1:
            covered += at + WINDOW - max(at, end)
            end = at + WINDOW
    return covered


def base_features(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of a text in UTF-8."""
    letters = b"".join(words)
    characters = len(letters) if letters.isascii() else len(letters.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip(BLANKS)]
    return len(words), characters, symbols, len(lines) - len(set(lines)), repeated_words(words)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > 20 * n_words


def divergence(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms: the root of the divergence in bits."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    a, b = p > 0, q > 0
    return float(np.sqrt(max(0.0, (p[a] * np.log2(p[a] / m[a])).sum() / 2 + (q[b] * np.log2(q[b] / m[b])).sum() / 2)))


@dataclass
class Reference:
    """One language: counts of the character classes, its common words and their counts, all others at the end."""

    classes: np.ndarray
    words: dict[bytes, int]
    counts: np.ndarray

    def word_counts(self, words: list[bytes]) -> np.ndarray:
        found = Counter(words)
        out = np.zeros(len(self.counts))
        for w in self.words.keys() & found.keys():
            out[self.words[w]] = found[w]
        out[-1] = len(words) - out[:-1].sum()
        return out

    def distances(self, text: bytes) -> tuple[float, float | None]:
        words = bare_words(text)
        chars = divergence(class_counts(text), self.classes)
        enough = words and self.counts.sum() >= MIN_REFERENCE and len(self.counts) > 1
        return chars, divergence(self.word_counts(words), self.counts) if enough else None


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """Language and text in UTF-8 of every row; no text counts as empty."""
    binary = pc.cast(batch.column("text"), pa.binary())
    for lang, text in zip(batch.column("lang").to_pylist(), binary):
        yield lang or REST, text.as_py() or b""


def bare_words(text: bytes) -> list[bytes]:
    """Words as histograms count them: A to Z in lower case, without punctuation."""
    return text.translate(BARE).split()


def summarise(counts: Counter) -> Counter:
    """At most ``KEPT`` words; every count falls by the same amount, by less than the sum / ``KEPT``."""
    if len(counts) <= KEPT:
        return counts
    less = int(np.partition(np.fromiter(counts.values(), np.int64, len(counts)), -KEPT - 1)[-KEPT - 1])
    return Counter({w: n - less for w, n in counts.items() if n > less})


def candidates(df: DataFrame) -> dict[str, set[bytes]]:
    """Per language the words that may be common: all that are, and at most ``2 / COMMON``."""

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        totals: Counter = Counter()

        def counted() -> pa.RecordBatch:
            out = [(lang, w, n) for lang, c in words.items() for w, n in c.items()] + [(lang, None, n) for lang, n in totals.items()]
            return pa.RecordBatch.from_pydict({"lang": pa.array([x[0] for x in out], pa.string()), "word": pa.array([x[1] for x in out], pa.binary()), "n": pa.array([x[2] for x in out], pa.int64())})

        for batch in pieces(batches):
            for lang, text in _rows(batch):
                if lang and len(text.split(None, MIN_WORDS)) >= MIN_WORDS:
                    own = bare_words(text)
                    totals[lang] += len(own)
                    words.setdefault(lang, Counter()).update(own)
            words = {lang: summarise(c) for lang, c in words.items()}
            if len(words) > HELD:
                yield counted()
                words, totals = {}, Counter()
        yield counted()

    counted = df.mapInArrow(frequent, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = stage(counted, "frequent_words")
    totals = counted.filter("word IS NULL").select("lang", F.col("n").alias("total")).filter(F.col("total") >= MIN_REFERENCE)
    found: dict[str, set[bytes]] = {r.lang: set() for r in totals.collect()}
    for lang, word in counted.filter("word IS NOT NULL").join(totals, "lang").filter(F.col("n") >= F.col("total") * (COMMON / 2)).select("lang", "word").collect():
        found[lang].add(bytes(word))
    return found


def references(df: DataFrame) -> dict[str, Reference]:
    """The references of all languages of ``MIN_REFERENCE`` words; ``df`` has ``lang`` and ``text``."""
    spark = df.sparkSession
    named = candidates(df)
    shared = spark.sparkContext.broadcast(named)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict[str, np.ndarray] = {}
        words: dict[str, Counter] = {}
        for batch in pieces(batches):
            for lang, text in _rows(batch):
                if lang not in shared.value or len(text.split(None, MIN_WORDS)) < MIN_WORDS:
                    continue
                classes[lang] = classes.get(lang, 0) + class_counts(text)
                known, into = shared.value[lang], words.setdefault(lang, Counter())
                own = bare_words(text)
                mine = [w for w in own if w in known]
                into.update(mine)
                into[None] += len(own) - len(mine)
        out = [(lang, None, int(n), k) for lang, c in classes.items() for k, n in enumerate(c)]
        out += [(lang, w, n, -1) for lang, c in words.items() for w, n in c.items()]
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array([x[0] for x in out], pa.string()), "word": pa.array([x[1] for x in out], pa.binary()),
            "n": pa.array([x[2] for x in out], pa.int64()), "class": pa.array([x[3] for x in out], pa.int32()),
        })

    totals = df.mapInArrow(count, "lang string, word binary, n long, class int").groupBy("lang", "word", "class").agg(F.sum("n").alias("n"))
    found: dict[str, tuple[np.ndarray, dict[bytes | None, int]]] = {}
    for lang, word, kind, n in totals.collect():
        chars, words = found.setdefault(lang, (np.zeros(CLASSES), {}))
        if kind >= 0:
            chars[kind] = n
        else:
            words[None if word is None else bytes(word)] = n
    out = {}
    for lang, (chars, words) in found.items():
        total = sum(words.values())
        common = sorted(w for w, n in words.items() if w is not None and n >= COMMON * total)
        rest = total - sum(words[w] for w in common)
        out[lang] = Reference(chars, {w: k for k, w in enumerate(common)}, np.array([*(words[w] for w in common), rest], float))
    return out


@dataclass(frozen=True)
class Limits:
    """Largest distances of a text of n words: ``chars + chars_short / n`` and ``words + words_short / sqrt(n)``.

    Short texts scatter more around their reference, so their limits are wider; texts of fewer than
    ``compared`` words are not compared.
    """

    chars: float = 0.15
    chars_short: float = 12.0
    words: float = 0.12
    words_short: float = 2.2
    compared: int = MIN_COMPARED

    def used(self, n_words: int, chars: float, words: float | None) -> float:
        """The larger of the distances as shares of their limits."""
        return max(chars / (self.chars + self.chars_short / n_words), 0.0 if words is None else words / (self.words + self.words_short / n_words**0.5))

    def exceeded(self, n_words: int, chars: float, words: float | None) -> bool:
        return chars > self.chars + self.chars_short / n_words or (words is not None and words > self.words + self.words_short / n_words**0.5)


def judge(lang: str, text: bytes, known: dict[str, Reference], limits: Limits) -> tuple:
    """Base features, ``base_failed``, ``kept`` and the two distances of one text."""
    words = text.split()
    base = base_features(text, words)
    failed = base_failed(base[0], base[-1])
    own = known.values() if lang == REST else [known[lang]] if lang in known else []
    if len(words) < limits.compared or not own:
        return *base, failed, not failed, None, None
    # a text without a language may be of any: the reference whose limits it keeps best decides
    chars, common = min((x.distances(text) for x in own), key=lambda d: limits.used(len(words), *d))
    return *base, failed, not (failed or limits.exceeded(len(words), chars, common)), chars, common


def assess(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """Per text the base features, ``base_failed``, ``kept`` and the distances (null if not compared)."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    known = references(rows.select("lang", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance"]
    kinds = ["long"] * 5 + ["boolean"] * 2 + ["double"] * 2
    types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            columns = zip(*(judge(lang, text, known, limits) for lang, text in _rows(batch)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {n: pa.array(c, t) for n, c, t in zip(names, columns, types)})

    schema = StructType([rows.schema["doc_id"]])
    for name, kind in zip(names, kinds):
        schema = schema.add(name, kind)
    return rows.mapInArrow(run, schema)


def good_texts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", limits: Limits = Limits()) -> DataFrame:
    """The rows of ``df`` whose text is kept, all columns as they are."""
    lang = F.col(f"`{lang_col}`").cast("string")
    known = references(df.select(lang.alias("lang"), F.col(f"`{text_col}`").alias("text")))
    extra = unused(df, "_lang")
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            named = pa.RecordBatch.from_arrays([batch.column(extra), batch.column(text_col)], names=["lang", "text"])
            kept = [judge(lang, text, known, limits)[6] for lang, text in _rows(named)]
            yield batch.select(columns).filter(pa.array(kept, pa.bool_()))

    return df.withColumn(extra, lang).mapInArrow(run, df.schema)
