"""Language identification by a linear-chain conditional random field over words.

Every word of a text gets a language: its score sums learned weights of its byte n-grams (those with
the word's border are its prefixes and suffixes) and of the word itself if it is in the lexicon, and
learned transitions say how a language follows another inside code-switched text. Forward-backward
gives each word's probabilities; the text's language is the one with the largest expected share of
its words, and that share is the score.

A chain is ``CHAIN`` consecutive words; a longer text is several chains one behind the other, all of
them read, so a text of any length takes bounded memory per step.

The field is learned from a bounded sample of rows with a language: about ``TRAIN_DOCS`` documents,
evenly over all languages and at least ``LEAST_DOCS`` of each, and of each up to ``TRAIN_BLOCKS``
chains spread over its whole text. The n-gram table has at most ``WEIGHTS`` numbers: beyond 256 languages n-grams share more
of its buckets, no language is left out. More than ``MOST_LANGS`` distinct values are no languages, and an error. Pieces of several documents are put together, so the field sees
switches. Rows with ``crc32(id) mod 4 = 2`` are never learned from.

Cases with a defined result: a null text, or one without a letter, is ``und`` with score 0; so is every
text if there is nothing to learn from; ties go to the first language by name; a null id is not held
out; rows repeat as often as they come; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from clientele.llm.inputs import pieces, texts, unused

WORD = re.compile(r"[^\W\d_]+")
CHAIN = 64
SIZES = (1, 2, 3, 4)
BUCKETS = 1 << 16
WEIGHTS = 1 << 24
TRAIN_DOCS, LEAST_DOCS, TRAIN_BLOCKS, MOST_LANGS = 2000, 10, 8, 4096
SEQUENCES, BATCH, ROUNDS, RATE = 6000, 128, 3, 0.3
#: Chains of a learning step, times languages, beyond 64 languages.
STEP = 1 << 13
#: Chains that are read at once, times languages.
AT_ONCE = 1 << 14
LEXICON = 3
UNDECIDED = "und"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def ngrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all words, where each word's begin, and a hash of each word."""
    data = [b"^" + w.encode("utf-8", "replace") + b"$" for w in words]
    lengths = np.fromiter(map(len, data), np.int64, len(data))
    letters = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(data)), lengths)
    grams, owners = [], []
    value = np.zeros(len(letters), np.uint64)
    for n in range(1, max(SIZES) + 1):
        # the n-gram that begins at each letter, if it ends in the same word
        value = value[: len(letters) - n + 1] * np.uint64(1099511628211) + letters[n - 1 :] + np.uint64(1)
        if n in SIZES:
            inside = word[: len(value)] == word[n - 1 :]
            mixed = (value[inside] ^ (value[inside] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
            grams.append((mixed >> np.uint64(48)).astype(np.int64))  # below BUCKETS
            owners.append(word[: len(value)][inside])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    starts = np.searchsorted(owner[order], np.arange(len(data)))
    # whole words: letters weighted by their place, summed
    place = np.arange(len(letters)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    weighted = (letters + np.uint64(3)) * _powers(int(lengths.max()))[place]
    hashes = np.add.reduceat(weighted, np.cumsum(lengths) - lengths)
    return np.concatenate(grams)[order], starts, hashes


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n, 6364136223846793005, np.uint64))


def _sums(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of runs of rows."""
    return np.add.reduceat(rows, starts, axis=0)


@dataclass
class Chain:
    """The learned field: languages, n-gram weights, lexicon with weights, transitions."""

    langs: list[str]
    grams: np.ndarray  # (buckets, languages); a power of two of buckets, BUCKETS at most
    lexicon: np.ndarray
    lexicon_weights: np.ndarray
    steps: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        ids, starts, hashes = ngrams(words)
        scores = _sums(self.grams[ids & (len(self.grams) - 1)], starts)
        at, known = self.look_up(hashes)
        scores[known] += self.lexicon_weights[at[known]]
        return scores

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.lexicon):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
        return at, self.lexicon[at] == hashes

    def marginals(self, scores: np.ndarray, lengths: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Word marginals of chains (chain, word, language) by forward-backward; ``pairs`` adds expected transitions."""
        n, t, k = scores.shape
        emit = np.exp(scores - scores.max(axis=2, keepdims=True))
        step = np.exp(self.steps - self.steps.max())
        real = np.arange(t)[None, :] < lengths[:, None]
        fore, rear = np.empty((t, n, k)), np.empty((t, n, k))
        for i in range(t):
            now = emit[:, i] * (fore[i - 1] @ step if i else 1.0)
            fore[i] = now / now.sum(axis=1, keepdims=True)
        rear[t - 1] = 1.0
        for i in range(t - 2, -1, -1):
            now = (emit[:, i + 1] * rear[i + 1]) @ step.T
            rear[i] = np.where(real[:, i + 1, None], now / now.sum(axis=1, keepdims=True), 1.0)
        both = fore * rear
        both /= both.sum(axis=2, keepdims=True)
        expected = None
        if pairs:
            expected = np.zeros((k, k))
            for i in range(1, t):
                after = emit[:, i] * rear[i]
                whole = ((fore[i - 1] @ step) * after).sum(axis=1, keepdims=True)
                expected += step * (fore[i - 1].T @ (after / whole))
        return both.transpose(1, 0, 2), expected

    def _marginals_of(self, texts: list[list[str]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For some chains at a time: their texts, the places of their words in all texts, which of those are real, and their marginals."""
        index: dict[str, int] = {}
        flat = np.array([index.setdefault(w, len(index)) for own in texts for w in own], np.int64)
        counts = np.array([len(own) for own in texts])
        if not len(flat):
            return
        word_scores = self.word_scores(list(index))
        chains = -(-counts // CHAIN)
        lengths = np.full(chains.sum(), CHAIN)
        lasts = np.cumsum(chains)[counts > 0] - 1
        lengths[lasts] = (counts[counts > 0] - 1) % CHAIN + 1
        starts = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(texts)), chains)
        # chains of like length together, so that little is padded
        order = np.argsort(lengths, kind="stable")
        step = max(16, AT_ONCE // len(self.langs))
        for k in range(0, len(order), step):
            some = order[k : k + step]
            width = int(lengths[some].max())
            places = starts[some][:, None] + np.arange(width)[None, :]
            found, _ = self.marginals(word_scores[flat[np.minimum(places, len(flat) - 1)]], lengths[some])
            real = np.arange(width)[None, :] < lengths[some][:, None]
            found[~real] = 0.0
            yield owner[some], places, real, found

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its expected share of the words, for each text."""
        words = [words_of(text) if text and self.langs else [] for text in texts]
        shares = np.zeros((len(texts), max(1, len(self.langs))))
        for owner, _, _, found in self._marginals_of(words):
            np.add.at(shares, owner, found.sum(axis=1))
        best = shares.argmax(axis=1)
        return [(self.langs[b], min(1.0, float(shares[i, b] / len(own)))) if own else (UNDECIDED, 0.0) for i, (b, own) in enumerate(zip(best, words))]

    def label(self, text: str | None) -> list[tuple[str, str, float]]:
        """Every word of a text, in lower case and order, with its most likely language and that one's probability."""
        own = words_of(text) if text and self.langs else []
        best, sure = np.zeros(len(own), np.int64), np.zeros(len(own))
        for _, places, real, found in self._marginals_of([own]):
            best[places[real]], sure[places[real]] = found[real].argmax(axis=1), found[real].max(axis=1)
        return [(w, self.langs[b], float(p)) for w, b, p in zip(own, best, sure)]


def learn(blocks: list[tuple[str, str]], seed: int = 5) -> Chain:
    """A field from (language, text) pieces, by stochastic gradient ascent on the chains' likelihood."""
    langs = sorted({lang for lang, _ in blocks})
    empty = np.zeros((0, max(len(langs), 1)))
    own: list[list[list[str]]] = [[] for _ in langs]
    for lang, text in blocks:
        if found := words_of(text):
            own[langs.index(lang)].append(found)
    langs, own = [x for x, o in zip(langs, own) if o], [o for o in own if o]
    if not langs:
        return Chain([], np.zeros((BUCKETS, 1)), np.empty(0, np.uint64), empty, np.zeros((1, 1)))
    rng = np.random.default_rng(seed)
    index: dict[str, int] = {}
    coded = [[np.array([index.setdefault(w, len(index)) for w in piece]) for piece in o] for o in own]
    buckets = max(1 << 10, min(BUCKETS, 1 << ((WEIGHTS // len(langs)).bit_length() - 1)))
    grams, starts, hashes = ngrams(list(index))
    grams &= buckets - 1
    ends = np.append(starts[1:], len(grams))
    often = np.bincount(np.concatenate([p for o in coded for p in o]), minlength=len(index))
    lexicon = np.unique(hashes[often >= LEXICON])
    field = Chain(langs, np.zeros((buckets, len(langs)), np.float32), lexicon, np.zeros((len(lexicon), len(langs))), np.zeros((len(langs), len(langs))))
    at, known = field.look_up(hashes)
    sums = [np.full(p.shape, 1e-4, p.dtype) for p in (field.grams, field.lexicon_weights, field.steps)]
    chains = min(BATCH, max(16, STEP // len(langs)))
    for _ in range(ROUNDS * SEQUENCES // BATCH):
        words, truth = _switched(coded, rng, chains)
        distinct, place = np.unique(words, return_inverse=True)
        place = place.reshape(words.shape)
        flat = np.concatenate([grams[starts[w] : ends[w]] for w in distinct])
        counts = ends[distinct] - starts[distinct]
        scores = _sums(field.grams[flat], np.cumsum(counts) - counts)
        in_lexicon = known[distinct]
        scores[in_lexicon] += field.lexicon_weights[at[distinct][in_lexicon]]
        found, expected = field.marginals(scores[place], np.full(chains, CHAIN), pairs=True)
        error = np.eye(len(langs))[truth] - found
        order = np.argsort(place.ravel(), kind="stable")
        by_word = _sums(error.reshape(-1, len(langs))[order].astype(np.float32), np.searchsorted(place.ravel()[order], np.arange(len(distinct))))
        owner = np.repeat(np.arange(len(distinct)), counts)
        order = np.argsort(flat, kind="stable")
        used, first = np.unique(flat[order], return_index=True)
        by_gram = _sums(by_word[owner[order]], first)
        by_entry = np.zeros_like(field.lexicon_weights)
        np.add.at(by_entry, at[distinct][in_lexicon], by_word[in_lexicon])
        observed = np.zeros_like(field.steps)
        np.add.at(observed, (truth[:, :-1].ravel(), truth[:, 1:].ravel()), 1.0)
        for p, g, s in zip((field.lexicon_weights, field.steps), (by_entry, observed - expected), sums[1:]):
            g /= chains
            s += g * g
            p += RATE * g / np.sqrt(s) - 1e-6 * p
        # only the buckets of this batch's words move
        by_gram /= chains
        sums[0][used] += by_gram * by_gram
        field.grams[used] += RATE * by_gram / np.sqrt(sums[0][used]) - 1e-6 * field.grams[used]
    return field


def _switched(coded: list[list[np.ndarray]], rng: np.random.Generator, chains: int) -> tuple[np.ndarray, np.ndarray]:
    """Chains put together from pieces: half of one language, half switching every few words."""
    words, truth = np.empty((chains, CHAIN), np.int64), np.empty((chains, CHAIN), np.int64)
    for row in range(chains):
        filled, lang = 0, int(rng.integers(len(coded)))
        switching = row % 2 == 1
        while filled < CHAIN:
            if switching:
                lang = int(rng.integers(len(coded)))
            piece = coded[lang][int(rng.integers(len(coded[lang])))]
            n = int(min(len(piece), CHAIN - filled, rng.integers(4, 24) if switching else CHAIN))
            begin = int(rng.integers(len(piece) - n + 1))
            words[row, filled : filled + n], truth[row, filled : filled + n] = piece[begin : begin + n], lang
            filled += n
    return words, truth


def held_out(id_col: Column) -> Column:
    """Whether a row is for testing: the checksum of its id as text leaves 2 on division by 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Chain:
    """A field from the bounded sample the module describes."""
    identity = F.col(f"`{id_col}`")
    rows = df.select(identity.cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"), held_out(identity).alias("test"))
    rows = rows.filter("NOT test AND lang IS NOT NULL AND text IS NOT NULL").drop("test")
    counted = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGS + 1).collect()
    if not counted:
        return learn([])
    if len(counted) > MOST_LANGS:
        raise ValueError(f"{lang_col} has more than {MOST_LANGS} values: not languages")
    each = max(LEAST_DOCS, TRAIN_DOCS // len(counted))
    scale = 1 << 20
    parts = F.create_map(*(F.lit(x) for r in counted for x in (r.lang, min(scale, 3 * each * scale // (2 * r.n) + 1))))
    sampled = rows.filter(F.pmod(F.xxhash64("id"), F.lit(scale)) < F.coalesce(parts[F.col("lang")], F.lit(0)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out = []
            for key, text, lang in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "lang"))):
                own = words_of(text)
                chains = -(-len(own) // CHAIN)
                for k in sorted({round(x) for x in np.linspace(0, chains - 1, min(chains, TRAIN_BLOCKS))} if chains else ()):
                    out.append((key, k, lang, " ".join(own[k * CHAIN : (k + 1) * CHAIN])))
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(("id", "at", "lang", "block"), columns, (pa.string(), pa.int32(), pa.string(), pa.string()))})

    blocks = sampled.mapInArrow(cut, "id string, at int, lang string, block string")
    found = sorted({(r.id or "", r.at, r.lang, r.block) for r in blocks.collect()})
    return learn([(lang, block) for _, _, lang, block in found])


def identify(df: DataFrame, field: Chain | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per text ``doc_id, held_out, lang_pred, score``; predictions read nothing but the text."""
    field = field or train(df, id_col, text_col, lang_col)
    identity, flag = F.col(f"`{id_col}`"), unused(df, "_held_out")
    docs = df.select(identity.alias("doc_id"), F.col(f"`{text_col}`").alias("text"), held_out(identity).alias(flag))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4 << 20):
            found = field.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "held_out": batch.column(flag),
                "lang_pred": pa.array([x[0] for x in found], pa.string()), "score": pa.array([x[1] for x in found], pa.float64()),
            })

    return docs.mapInArrow(run, StructType([docs.schema["doc_id"], StructField("held_out", BooleanType()), StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def label_words(df: DataFrame, field: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, place, word, lang, probability`` of every word (place from 0, words in lower case); texts without letters have none."""
    docs = texts(df, id_col, text_col)
    schema = StructType([docs.schema["doc_id"], StructField("place", LongType()), StructField("word", StringType()), StructField("lang", StringType()), StructField("probability", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4 << 20):
            for row, text in enumerate(batch.column("text").to_pylist()):
                found = field.label(text)
                if found:
                    words, langs, sure = zip(*found)
                    ids = batch.column("doc_id").take(pa.array(np.full(len(found), row)))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.arange(len(found))), pa.array(words), pa.array(langs), pa.array(sure)], names=schema.names)

    return docs.mapInArrow(run, schema)
