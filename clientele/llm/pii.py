"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

The patterns find emails, IP addresses, card and phone numbers, leftmost first and without retries, so
a greedy match that runs into its neighbour is lost (a phone number in front of a card number). The
field reads the same places, cuts them into tokens (digit groups, letter groups, single marks) and
scores whole candidate segments by features of the span: validity, grouping, marks inside, what
touches its ends. Dynamic programming over segments of at most ``LONGEST`` tokens chooses boundaries
and kinds together; the pattern spans are fixed points, and only segments that pass the kind's own
checks (checksum, ranges, digit counts) are added.

Places are maximal runs of digits and marks, or of non-blank characters around an at sign. No
candidate crosses the border of a run, so decoding run by run is exact; runs have at most
``LONGEST`` open segments per token, so a run of any length is read whole in linear time.

The weights are learned by maximum likelihood from the runs of at most ``SAMPLE_ROWS`` documents (by
hash of the id, about that many of the table), where the pattern spans are the truth, from the same
spans put side by side, and from a fixed number of generated numbers that keep rare kinds in sight.

Cases with a defined result: null and empty texts have no spans; rows repeat as often as they come;
an empty table gives an empty table (and a field learned from generated numbers only); null ids are
ordinary; other columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clientele.llm.inputs import pieces, texts

KINDS = ("email", "ip", "card", "phone")
SAMPLE_ROWS = 2000
GENERATED = 400
LONGEST = 24
Span = tuple[str, int, int]

# The patterns that the results are defined by.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

RUN = re.compile(r"[+(]{0,3}[0-9](?:[\x20().-]{0,3}[+(]?[0-9])*+|(?<![^\s@<>,;:\"'])[^\s@<>,;:\"']++@[^\s@<>,;:\"']++")
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w]|_|\w")
DIGITS = re.compile(r"[0-9]+")
NATIONAL = re.compile(r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}")
STRICT_EMAIL = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _octets(match: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.split("."))


def _digits(match: str) -> str:
    return "".join(DIGITS.findall(match))


def _emails(text: str) -> Iterator[Span]:
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """The pattern spans, by start and then by kind as listed."""
    found = list(_emails(text)) if "@" in text else []
    if DIGITS.search(text):
        found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if _octets(m[0])]
        found += [("card", m.start(), m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def valid(kind: str, part: str) -> bool:
    """The kind's own checks on a whole segment."""
    if kind == "email":
        return STRICT_EMAIL.fullmatch(part) is not None
    if kind == "ip":
        return part.count(".") == 3 and IP.fullmatch(part) is not None and _octets(part)
    if kind == "card":
        return CARD.fullmatch(part) is not None and 12 <= len(d := _digits(part)) <= 19 and luhn(d)
    return (PHONE.fullmatch(part) is not None and part.count("(") == part.count(")") and 9 <= len(_digits(part)) <= 15) or NATIONAL.fullmatch(part) is not None


FEATURES = 9
CARD_GROUPS = ({4}, {4, 3}, {4, 6, 5}, {4, 2}, {4, 1})


def features(kind: str, part: str, before: str, after: str) -> list[float]:
    """Whole-span features: one, validity, size, grouping, marks inside, both neighbours, digit groups, mixed marks."""
    groups = DIGITS.findall(part)
    sizes = [len(g) for g in groups]
    digits = sum(sizes)
    marks = {c for c in part if not c.isalnum()}
    if kind == "email":
        usual, regular, odd = 6 <= len(part) <= 64, part.count("@") == 1, bool(marks - set("@._%+-"))
    elif kind == "ip":
        usual, regular, odd = digits >= 6, len(groups) == 4, marks != {"."}
    elif kind == "card":
        usual, regular, odd = digits in (15, 16), len(groups) == 1 or (set(sizes) in CARD_GROUPS and sizes[0] == 4), bool(marks - set(" -"))
    else:
        usual, regular, odd = 10 <= digits <= 13, 3 <= len(groups) <= 5 and sizes[-1] in (3, 4), part.count("(") != part.count(")")
    inner = len(marks & set(" -.")) > 1
    return [1.0, valid(kind, part), usual, regular, odd, before.isalnum(), after.isalnum(), min(len(groups), 8) / 4, inner]


def plausible(kind: str, part: str, digits: int) -> bool:
    """Which segments (of a run without letters, or with an at sign) are scored at all."""
    if kind == "email" or "@" in part:
        return kind == "email" and "@" in part and "." in part
    return (kind == "ip" and digits >= 4 and part.count(".") >= 3) or (kind == "card" and 12 <= digits <= 19) or (kind == "phone" and 9 <= digits <= 15)


class Run:
    """A place cut into tokens, with its candidate segments (token range, kind) and their features."""

    def __init__(self, text: str, start: int, end: int) -> None:
        tokens = [(start + m.start(), start + m.end()) for m in TOKEN.finditer(text[start:end])]
        self.starts, self.ends = [t[0] for t in tokens], [t[1] for t in tokens]
        self.segments: list[tuple[int, int, int]] = []
        rows = []
        sign = text.find("@", start, end)
        numbers = [(b - a) * ("0" <= text[a] <= "9") for a, b in tokens]
        for i, a in enumerate(self.starts):
            if not (numbers[i] or text[a] in "+(" or text[a].isalnum()):
                continue
            digits = 0
            for j in range(i, min(i + LONGEST, len(tokens))):
                digits += numbers[j]
                b = self.ends[j]
                # without an at sign only digit groups can end a segment, after four digits at least
                if sign < 0 and digits > 19:
                    break
                if sign < 0 and (not numbers[j] or digits < 4) or sign >= 0 and not (a < sign < b and text[b - 1].isalnum()):
                    continue
                part = text[a:b]
                for k, kind in enumerate(KINDS):
                    if plausible(kind, part, digits):
                        self.segments.append((i, j + 1, k))
                        rows.append(features(kind, part, text[a - 1 : a], text[b : b + 1]))
        self.features = np.array(rows, float).reshape(-1, FEATURES)
        #: Of single tokens outside segments: one, digits, many digits.
        self.plain = np.array([[1.0, text[a].isdigit(), (b - a) * text[a].isdigit() / 8] for a, b in tokens], float).reshape(-1, 3)


OUT = len(KINDS)


class Field:
    """Weights of the spans (per kind), of plain tokens, and of what follows what."""

    def __init__(self) -> None:
        self.span = np.zeros((len(KINDS), FEATURES))
        self.plain = np.zeros(3)
        self.step = np.zeros((OUT + 1, OUT + 1))

    def scores(self, run: Run) -> tuple[np.ndarray, np.ndarray]:
        kinds = [s[2] for s in run.segments]
        return (run.features * self.span[kinds]).sum(axis=1), run.plain @ self.plain

    def best(self, run: Run, blocked: set[int]) -> list[tuple[int, int, int]]:
        """The best segmentation whose segments keep off the blocked tokens."""
        spans, plain = self.scores(run)
        n = len(run.starts)
        by_end: list[list[int]] = [[] for _ in range(n + 1)]
        for s, (i, j, _) in enumerate(run.segments):
            if not any(t in blocked for t in range(i, j)):
                by_end[j].append(s)
        value = np.full((n + 1, OUT + 1), -np.inf)
        value[0, OUT] = 0
        back: list[dict] = [{} for _ in range(n + 1)]
        for j in range(1, n + 1):
            came = value[j - 1] + self.step[:, OUT]
            value[j, OUT], back[j][OUT] = came.max() + plain[j - 1], (j - 1, int(came.argmax()))
            for s in by_end[j]:
                i, _, k = run.segments[s]
                came = value[i] + self.step[:, k]
                if came.max() + spans[s] > value[j, k]:
                    value[j, k], back[j][k] = came.max() + spans[s], (i, int(came.argmax()))
        out, j, label = [], n, int(value[n].argmax())
        while j > 0:
            i, before = back[j][label]
            if label != OUT:
                out.append((i, j, label))
            j, label = i, before
        return out[::-1]

    def learn(self, data: list[tuple[Run, set[tuple[int, int, int]]]], rounds: int = 12, rate: float = 0.5, decay: float = 1e-3) -> Field:
        """Gradient ascent (with Adagrad steps) on the likelihood of the true segmentations."""
        params = [self.span, self.plain, self.step]
        sums = [np.full_like(p, 1e-6) for p in params]
        for _ in range(rounds):
            for k in range(0, len(data), 32):
                grads = [-decay * p for p in params]
                for run, truth in data[k : k + 32]:
                    for g, more in zip(grads, self._gradient(run, truth)):
                        g += more / 32
                for p, g, s in zip(params, grads, sums):
                    s += g * g
                    p += rate * g / np.sqrt(s)
        return self

    def _gradient(self, run: Run, truth: set[tuple[int, int, int]]) -> list[np.ndarray]:
        """Observed less expected counts of all features."""
        spans, plain = self.scores(run)
        n = len(run.starts)
        arcs = [(t, t + 1, OUT, None) for t in range(n)] + [(i, j, k, s) for s, (i, j, k) in enumerate(run.segments)]
        arcs.sort(key=lambda a: a[1])
        score = lambda a: plain[a[0]] if a[3] is None else spans[a[3]]
        fore = np.full((n + 1, OUT + 1), -np.inf)
        fore[0, OUT] = 0
        for a in arcs:
            fore[a[1], a[2]] = np.logaddexp(fore[a[1], a[2]], np.logaddexp.reduce(fore[a[0]] + self.step[:, a[2]]) + score(a))
        rear = np.full((n + 1, OUT + 1), -np.inf)
        rear[n] = 0
        for a in sorted(arcs, key=lambda a: -a[0]):
            rear[a[0]] = np.logaddexp(rear[a[0]], self.step[:, a[2]] + score(a) + rear[a[1], a[2]])
        total = np.logaddexp.reduce(fore[n])
        span, flat, step = np.zeros_like(self.span), np.zeros_like(self.plain), np.zeros_like(self.step)
        for a in arcs:
            each = np.exp(fore[a[0]] + self.step[:, a[2]] + score(a) + rear[a[1], a[2]] - total)
            p = each.sum()
            step[:, a[2]] -= each
            if a[3] is None:
                flat -= p * run.plain[a[0]]
            else:
                span[a[2]] -= p * run.features[a[3]]
        at, before = 0, OUT
        ends = {i: (i, j, k) for i, j, k in truth}
        where = {s: r for r, s in enumerate(run.segments)}
        while at < n:
            if at in ends and ends[at] in where:
                _, j, k = ends[at]
                span[k] += run.features[where[ends[at]]]
            else:
                j, k = at + 1, OUT
                flat += run.plain[at]
            step[before, k] += 1
            at, before = j, k
        return [span, flat, step]


def _generated(rng: random.Random) -> list[Span | str]:
    """A valid value of some kind, or a number that is none, as (kind, text)."""
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    kind = rng.choice([*KINDS, "none", "none"])
    if kind == "email":
        return kind, f"{rng.choice('abcdefgh')}{number(2)}.{rng.choice(['info', 'sales', 'me'])}@{rng.choice(['mail', 'post'])}{number(1)}.example.{rng.choice(['com', 'org'])}"
    if kind == "ip":
        return kind, ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        body = rng.choice("3456") + number(14)
        digits = next(body + c for c in "0123456789" if luhn(body + c))
        mark = rng.choice(["", "", " ", "-"])
        return kind, mark.join(digits[k : k + 4] for k in range(0, 16, 4))
    if kind == "phone":
        return kind, rng.choice(["+{a} ({b}) {c}-{d}", "+{a} {b} {c} {d}", "+{a}-{b}-{c}-{d}", "({b}) {c}-{d}", "{b}-{c}-{d}"]).format(a=rng.randint(1, 99), b=number(3), c=number(3), d=number(4))
    return kind, rng.choice([number(rng.randint(1, 11)), number(16), f"{number(1)}.{number(1)}", f"{number(4)}-{number(2)}-{number(2)}", f"{number(3)}.{number(3)}.{number(3)}"])


def learn(lines: list[str], seed: int = 11) -> Field:
    """A field from texts (their runs, the pattern spans as truth) and generated values alone and in pairs."""
    rng = random.Random(seed)
    data, values = [], []
    for text in lines:
        found = base_spans(text)
        values += [(k, text[a:b]) for k, a, b in found]
        data += _examples(text, found)
    values = values[:GENERATED] + [_generated(rng) for _ in range(GENERATED)]
    for k, value in enumerate(values):
        other = values[rng.randrange(len(values))] if k % 2 else None
        text, truth = "of ", []
        for kind, part in [(k, v) for k, v in (value, other or ("none", "")) if v]:
            truth += [(kind, len(text), len(text) + len(part))] if kind in KINDS and valid(kind, part) else []
            text += part + " "
        data += _examples(text + "and", truth)
    rng.shuffle(data)
    return Field().learn(data)


def _examples(text: str, spans: list[Span]) -> list[tuple[Run, set[tuple[int, int, int]]]]:
    out = []
    for m in RUN.finditer(text):
        if m.end() - m.start() > 200:
            continue
        run = Run(text, m.start(), m.end())
        if run.segments:
            truth = {(i, j, KINDS.index(k)) for k, a, b in spans if a in run.starts and b in run.ends for i in [run.starts.index(a)] for j in [run.ends.index(b) + 1]}
            inside = sorted(truth)
            if all(x[1] <= y[0] for x, y in zip(inside, inside[1:])) and truth <= set(run.segments):
                out.append((run, truth))
    return out


def added_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """What the field finds beside the pattern spans, each valid and apart from them."""
    out = []
    digits = DIGITS.search(text)
    if not digits and "@" not in text:
        return out
    first = 0
    for m in RUN.finditer(text):
        a, b = m.start(), m.end()
        while first < len(base) and base[first][2] <= a:
            first += 1
        inside, at = [], first
        while at < len(base) and base[at][1] < b:
            inside.append(base[at])
            at += 1
        # nothing can be added to a run that one span covers but for marks, or that is too short
        if b - a < 7 or any(s[1] <= a + 1 and s[2] >= b - 1 for s in inside):
            continue
        run = Run(text, a, b)
        blocked: set[int] = set()
        for _, x, y in inside:
            blocked.update(range(bisect_right(run.ends, x), bisect_left(run.starts, y)))
        for i, j, k in field.best(run, blocked):
            start, end = run.starts[i], run.ends[j - 1]
            if valid(KINDS[k], text[start:end]) and not text[start - 1 : start].isalnum() and not text[end : end + 1].isalnum():
                out.append((KINDS[k], start, end))
    return out


def find(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """The pattern spans, and all spans."""
    base = base_spans(text)
    return base, sorted(base + added_spans(text, base, field), key=_order)


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """A field from a sample of the table: rows by hash of the id, at most ``SAMPLE_ROWS`` with something to read."""
    docs = texts(df, id_col, text_col)
    every = max(1, docs.count() // (10 * SAMPLE_ROWS))
    sampled = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).filter(F.col("text").rlike("[0-9@]"))
    # only the surroundings of digits and at signs come to the driver
    around = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"(.{0,60}[0-9@].{0,100})"), 1), 1, 20), "\n")
    rows = sampled.select(F.xxhash64("doc_id").alias("h"), around.alias("around")).orderBy("h", "around").limit(SAMPLE_ROWS).collect()
    return learn([r.around for r in rows if r.around])


def find_pii(df: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text ``doc_id``, pattern counts, ``base_sha256``, ``spans`` (all) and ``n_added``."""
    docs = texts(df, id_col, text_col)
    field = field or train(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in pieces(batches):
            counts: list[list[int]] = []
            sha, spans, added = [], [], []
            for text in batch.column("text").to_pylist():
                base, full = find(text or "", field)
                counts.append([sum(s[0] == k for s in base) for k in KINDS] if base else [0] * len(KINDS))
                sha.append(hashlib.sha256(written(base).encode()).hexdigest() if base else nothing)
                spans.append(written(full) if full else "")
                added.append(len(full) - len(base))
            columns = {f"n_{k}": pa.array([c[i] for c in counts], pa.int64()) for i, k in enumerate(KINDS)}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | columns | {"base_sha256": pa.array(sha, pa.string()), "spans": pa.array(spans, pa.string()), "n_added": pa.array(added, pa.int64())})

    schema = StructType([docs.schema["doc_id"]])
    for k in KINDS:
        schema = schema.add(f"n_{k}", "long")
    return docs.mapInArrow(run, schema.add("base_sha256", "string").add("spans", "string").add("n_added", "long"))
