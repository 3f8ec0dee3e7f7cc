"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is exactly one token in which its encoding ends. A suffix
automaton over the vocabulary lists, position by position, the tokens that end there; the one that
is compatible with the last token of the prefix before it is stored, and back-pointers from the end
of the word give the ids. Two neighbouring tokens are compatible if no merge ever joins symbols
across their border: each symbol on the right edge of the left token and on the left edge of the
right token lives until its own merge, so a cross merge happens only while both are alive.

Texts are split as the vocabulary file says (special tokens, lower case, words), whole texts at a
time. Cases with a defined result: null and empty texts and texts of white space have no ids and
decode to the empty text; rows repeat as often as they come; an empty table gives an empty table;
other columns are not read. Caches are bounded, so a worker's memory does not follow the corpus.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from typing import TYPE_CHECKING

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from clientele.llm.bpe_words import Pieces
from clientele.llm.inputs import pieces, texts

if TYPE_CHECKING:
    from tokenizers import Tokenizer

#: Stands for the end of a word inside a token; no byte is written with it.
END = ""
#: Texts of these characters alone are lower-cased and split here; the tokenizers library does it for others.
UNUSUAL = re.compile("[^\x00-ſ]")
CACHED = 120_000
#: Words whose packed ids are remembered; such an entry takes less than half the room.
PACKED = 250_000
#: Longer words are looked up one by one; the others together, so many bytes at once.
LONG, TOGETHER = 64, 1 << 17
#: The words of ``Encoder.cut``: a contraction, letters, one number, or what is neither of them nor white space.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE, LETTER, NUMBER, OTHER = range(4)


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: printable ones stand for themselves."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Recent(dict):
    """What ``make`` returns, by key; holds at most twice ``size`` entries, the newer and the older half."""

    def __init__(self, make: Callable, size: int = CACHED) -> None:
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found


class Vocabulary:
    """A word-level BPE vocabulary: ids, merges, and the encoding of one word."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        inner = lambda t: t[: -len(self.suffix)] + END if t.endswith(self.suffix) else t
        self.ids = {inner(t): i for t, i in model["vocab"].items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {(inner(a), inner(b)): r for r, (a, b) in enumerate(pairs)}
        self.made_of: dict[str, tuple[int, str, str]] = {}
        for (a, b), r in self.ranks.items():
            self.made_of.setdefault(a + b, (r, a, b))
        self.right_edge = lru_cache(CACHED)(lambda t: self._edge(t, 2))
        self.left_edge = lru_cache(CACHED)(lambda t: self._edge(t, 1))
        self.fits = lru_cache(2 * CACHED)(self._fits)
        self.names = {i: t for t, i in model["vocab"].items()} | {a["id"]: a["content"] for a in spec["added_tokens"]}

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        made = ahocorasick.Automaton()
        for t in self.ids:
            if self._reachable(t):
                made.add_word(t, (t, len(t)))
        made.make_automaton()
        return made

    def _edge(self, token: str, side: int) -> list[tuple[str, float]]:
        """The symbols on one edge of a token, with the rank of the merge that ends each."""
        edge, ends = [], float("inf")
        while True:
            edge.append((token, ends))
            if token not in self.made_of:
                return edge
            ends, token = self.made_of[token][0], self.made_of[token][side]

    def _cross(self, left: str, right: str) -> list[tuple[int, str, str]]:
        """The merges across the border that happen; among equal merges the leftmost goes first."""
        return [
            (r, a, b)
            for a, a_ends in self.right_edge(left)
            for b, b_ends in self.left_edge(right)
            if (r := self.ranks.get((a, b))) is not None and r < a_ends and r <= b_ends
        ]

    def _fits(self, left: str, right: str) -> bool:
        return not self._cross(left, right)

    def _reachable(self, token: str) -> bool:
        """Whether the merges turn the token's own symbols into the token."""
        if token not in self.made_of:
            return len(token) - token.endswith(END) == 1
        _, a, b = self.made_of[token]
        first = min(self._cross(a, b), default=None)
        return first is not None and first[1:] == (a, b)

    def tokens(self, word: str) -> list[str]:
        """The tokens of one word in byte letters, by its prefixes."""
        marked, inside, fits = word + END, len(word), self.fits
        last: list[str | None] = [None] * (inside + 2)
        for at, (token, length) in self.automaton.iter(marked):
            end = at + 1
            if last[end] is None and end != inside:
                before = last[end - length]
                if end == length or (before is not None and fits(before, token)):
                    last[end] = token
        out, end = [], inside + 1
        while end > 0:
            token = last[end]
            if token is None:
                raise ValueError(f"the vocabulary cannot write {word!r}")
            out.append(token)
            end -= len(token)
        out.reverse()
        return out


class Encoder:
    """Texts to ids and ids to text, as the vocabulary file describes them."""

    def __init__(self, data: bytes) -> None:
        spec = json.loads(data)
        if any(a["normalized"] or a["single_word"] or a["lstrip"] or a["rstrip"] for a in spec["added_tokens"]):
            raise ValueError("only plain special tokens are supported")
        self.vocabulary = Vocabulary(spec)
        self.data = data
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = byte_letters()
        self.of_word = Recent(self._word)
        self.of_letters = Recent(self._letters)
        self.two_bytes = {t: i.to_bytes(2, "little") for t, i in self.vocabulary.ids.items() if i < 1 << 16}
        self.packed_word = Recent(self._packed_word, PACKED)
        self.packed_letters = Recent(self._packed_letters)
        self.seen, self.seen_ids, self.seen_sizes = pa.array([], pa.binary()), np.empty(0, "<u2"), np.empty(0, np.int64)
        kinds = [(LETTER, regex.compile(r"\p{L}")), (NUMBER, regex.compile(r"\p{N}")), (SPACE, regex.compile(r"\s"))]
        # of the characters that UTF-8 writes in one or two bytes
        self.kinds = np.array([next((k for k, r in kinds if r.match(chr(c))), OTHER) for c in range(0x800)], np.uint8)

    @cached_property
    def library(self) -> Tokenizer:
        """Only unusual texts need it, to be normalised and split."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.data.decode())

    def _letters(self, word: str) -> tuple[int, str, str]:
        """For a word in byte letters: how many tokens, their ids and their names as text."""
        tokens = self.vocabulary.tokens(word)
        ids = [self.vocabulary.ids[t] for t in tokens]
        return len(ids), " ".join(map(str, ids)), " ".join([self.vocabulary.names[i] for i in ids])

    def _word(self, word: str) -> tuple[int, str, str]:
        return self._letters(word if word.isalpha() and word.isascii() else word.encode().decode("latin-1").translate(self.letters))

    def _packed_letters(self, word: str) -> bytes:
        return b"".join([self.two_bytes[t] for t in self.vocabulary.tokens(word)])

    def _packed_word(self, word: str) -> bytes:
        return self._packed_letters(word if word.isalpha() and word.isascii() else word.encode().decode("latin-1").translate(self.letters))

    def _walk(self, text: str, of_word: Recent, of_letters: Recent, of_special: Callable) -> list:
        """What the caches give for every word and special token of a whole text, in order."""
        if self.specials and "<" in text and (cut := self.specials.split(text))[1:]:
            out = []
            for k, part in enumerate(cut):
                out += [of_special(part)] if k % 2 else self._walk(part, of_word, of_letters, of_special)
            return out
        if not UNUSUAL.search(text):
            return [of_word[w] for w in self.word.findall(text.lower())]
        out, normalise, split = [], self.library.normalizer.normalize_str, self.library.pre_tokenizer.pre_tokenize_str
        for line in text.split("\n"):
            if UNUSUAL.search(line):
                out += [of_letters[w] for w, _ in split(normalise(line))]
            else:
                out += self._walk(line, of_word, of_letters, of_special)
        return out

    def parts(self, text: str) -> list[tuple[int, str, str]]:
        """What ``_letters`` gives for every word and special token of a whole text, in order."""
        return self._walk(text, self.of_word, self.of_letters, lambda part: (1, str(self.special[part]), part))

    def packed(self, text: str) -> bytes:
        """The ids of a whole text as 16-bit numbers, little endian."""
        if len(self.two_bytes) < len(self.vocabulary.ids):
            raise ValueError("ids do not fit into 16 bits")
        return b"".join(self._walk(text, self.packed_word, self.packed_letters, lambda part: self.special[part].to_bytes(2, "little")))

    def cut(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where the words of lower-cased usual text start, and which bytes belong to words.

        ``data`` is UTF-8 of one or two bytes a character and ends in four line feeds.
        """
        code = np.frombuffer(data, np.uint8)
        kind = self.kinds[code]
        two = np.flatnonzero(code >= 0xC0)
        kind[two] = kind[two + 1] = self.kinds[(code[two] & 0x1F).astype(np.uint16) << 6 | code[two + 1] & 0x3F]
        start = kind == NUMBER
        start[0] = True
        start[1:] |= kind[1:] != kind[:-1]
        start[two + 1] = False
        start &= kind != SPACE
        # an apostrophe by itself takes the letters of a contraction along; those behind them are the next word
        mark = np.flatnonzero(code == ord("'"))
        mark = mark[start[mark] & (kind[mark + 1] == LETTER)]
        first, second = code[mark + 1], code[mark + 2]
        one = np.isin(first, np.frombuffer(b"stmd", np.uint8))
        pair = (np.isin(first, np.frombuffer(b"rv", np.uint8)) & (second == ord("e"))) | ((first == ord("l")) & (second == ord("l")))
        for at, n in ((mark[one], 2), (mark[pair], 3)):
            start[at + 1] = False
            start[at + n] |= kind[at + n] == LETTER
        return start, kind != SPACE

    def packed_usual(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``packed_all`` of usual texts without special tokens: every different word is looked up once."""
        lower = [t.lower().encode() for t in texts]
        data = b"\n".join([*lower, b"\n\n\n"])
        start, inside = self.cut(data)
        ends = np.cumsum([len(t) + 1 for t in lower])
        first = np.searchsorted(np.flatnonzero(start), ends)
        letters = np.frombuffer(data, np.uint8)[inside]
        borders = np.append(np.flatnonzero(start[inside]), len(letters)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(borders) - 1, [None, pa.py_buffer(borders), pa.py_buffer(letters)]).dictionary_encode()
        known, known_sizes, place = self._looked_up(words.dictionary)
        which = place[words.indices.to_numpy()]
        sizes, begins = known_sizes[which], (np.cumsum(known_sizes) - known_sizes)[which]
        sums = np.concatenate([[0], np.cumsum(sizes)])
        ids = known[np.repeat(begins - sums[:-1], sizes) + np.arange(sums[-1])]
        return ids, np.diff(sums[first], prepend=0)

    def _looked_up(self, words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all words seen of late, how many each has, and the place of these different words among them."""
        if len(self.seen) > PACKED:
            self.seen, self.seen_ids, self.seen_sizes = self.seen[:0], self.seen_ids[:0], self.seen_sizes[:0]
        at = pc.index_in(words, value_set=self.seen)
        new = words.filter(at.is_null())
        if len(new):
            at = pc.coalesce(at, pc.add(pc.cumulative_sum(at.is_null().cast(pa.int32())), pa.scalar(len(self.seen) - 1, pa.int32())))
            ids, sizes = self._new_words(new)
            self.seen = pa.concat_arrays([self.seen, new])
            self.seen_ids, self.seen_sizes = np.append(self.seen_ids, ids), np.append(self.seen_sizes, sizes)
        return self.seen_ids, self.seen_sizes, at.to_numpy()

    def _new_words(self, words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, and how many each has."""
        _, borders, letters = words.buffers()
        borders, letters = np.frombuffer(borders, np.int32)[words.offset :][: len(words) + 1].astype(np.int64), np.frombuffer(letters, np.uint8)
        found, first, long = [], 0, [*np.flatnonzero(np.diff(borders) > LONG).tolist(), len(words)]
        for at in long:
            while first < at:
                last = min(at, max(first + 1, int(np.searchsorted(borders, borders[first] + TOGETHER))))
                found.append(self.together.ids(letters[borders[first] : borders[last]], borders[first : last + 1] - borders[first]))
                first = last
            if at < len(words):
                ids = np.frombuffer(self._packed_word(letters[borders[at] : borders[at + 1]].tobytes().decode()), "<u2")
                found.append((ids, np.array([len(ids)])))
                first = at + 1
        ids, sizes = zip(*found)
        return np.concatenate(ids), np.concatenate(sizes)

    @cached_property
    def together(self) -> Pieces:
        return Pieces(self.vocabulary, self.letters, END)

    def packed_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of whole texts in a row as 16-bit numbers, and how many each text has."""
        if len(self.two_bytes) < len(self.vocabulary.ids):
            raise ValueError("ids do not fit into 16 bits")
        usual = [self.word.pattern == WORD and (t.isascii() or not UNUSUAL.search(t)) and not (self.specials and "<" in t and self.specials.search(t)) for t in texts]
        ids, counts = self.packed_usual([t for t, u in zip(texts, usual) if u])
        if all(usual):
            return ids, counts
        of_usual = iter(np.split(ids, np.cumsum(counts)))
        parts = [next(of_usual) if u else np.frombuffer(self.packed(t), "<u2") for t, u in zip(texts, usual)]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def encode(self, text: str) -> list[int]:
        return [int(i) for p in self.parts(text) for i in p[1].split()]

    def decode(self, ids: list[int]) -> str:
        """The tokens' names joined by blanks; the vocabulary names no other decoder."""
        return " ".join(self.vocabulary.names[i] for i in ids)


_encoders: dict[str, Encoder] = {}


def encoder(data: bytes) -> Encoder:
    """The encoder for a vocabulary file's content, made once per worker."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _encoders:
        _encoders[key] = Encoder(data)
    return _encoders[key]


def read_vocabulary(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per text ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids``.

    ``vocabulary`` is the file's path on the driver; its content (one or two MB) goes to the workers.
    """
    docs = texts(df, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    fields = [docs.schema["doc_id"], StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    if with_ids:
        fields.append(StructField("ids", ArrayType(IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(shared.value)
        for batch in pieces(batches, 2 << 20):
            counts, ids_sha, decoded_sha, ids = [], [], [], []
            for text in batch.column("text").to_pylist():
                found = own.parts(text or "")
                counts.append(sum([p[0] for p in found]))
                ids_sha.append(sha256(" ".join([p[1] for p in found])))
                decoded_sha.append(sha256(" ".join([p[2] for p in found])))
                if with_ids:
                    ids.append(np.array(" ".join([p[1] for p in found]).split(), np.int32))
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(decoded_sha, pa.string())}
            if with_ids:
                columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(run, StructType(fields))
