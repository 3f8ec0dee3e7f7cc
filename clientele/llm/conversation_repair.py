"""Repair of conversations to the role grammar ``(s?(ua)+)?`` by a suffix-shared automaton.

1. Every row becomes a symbol: its role's initial (``s``, ``u``, ``a``, ``o`` for any other), in upper case if the
   text is truncated, or ``x`` if the row is blank or a duplicate and must go. A conversation is the
   string of its symbols, its signature; texts stay behind.
2. Signatures are minimised from the end: two conversations that end alike share the automaton's nodes for what
   they share. Sorted by the reversed signature, a signature differs from the one before it in the nodes
   above their common ending, so a task holds one path and makes each node once. The range
   partitions cut between conversations, not between signatures, so a signature that a third
   of all conversations have is several tasks; only the path at a cut is made twice.
3. A node has, for each of the grammar's four states, the cost to the end and the first edits of the best audit,
   with the state they lead to in the next node. From one state each edit leads to one state, so of audits of equal
   cost the one with the smaller first letter is the smaller one, and no audits are compared.
4. The audits go back to the rows, sorted by conversation and order, and are applied in a stream.

Edits: K(eep) costs 0, R(erole) 2, D(elete) 3, I(nsert) 2; a truncated row that stays costs 1 more.

Cases with a defined result: null roles and texts are one blank; a null id is one conversation like any other; null turns come
first; rows of one turn come in the order of role and md5 of the text, so copies are neighbours; an empty role has no initial;
a conversation of any length is read in a stream, only its signature and audit (one letter a row or edit) are held at once; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from clientele.llm.inputs import pieces
from clientele.session import stage

BLANK = " "
# Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: The grammar's states; a conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a user's or an assistant's row, whichever may come next.
NEXT = (USER, USER, ASSISTANT, USER)
#: The state after a kept row of each role.
KEEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NAMES = {USER: "user", ASSISTANT: "assistant"}
ENDLESS = float("inf")


class Node:
    """What follows a signature's suffix: per state the cost to the end, the edits up to the next node, and the state there."""

    __slots__ = ("costs", "edits", "states")

    def __init__(self, symbol: str | None, below: Node | None) -> None:
        best = [self._own(symbol, below, state) for state in range(4)]
        # an insertion leads to another state of the same node; two of them between two rows lead back, but from START and SYSTEM
        user, assistant = self._better(best[USER], best[ASSISTANT]), self._better(best[ASSISTANT], best[USER])
        best = [self._better(best[START], user), self._better(best[SYSTEM], user), user, assistant]
        self.costs, self.edits, self.states = zip(*best)

    @staticmethod
    def _better(own: tuple[float, str, int], inserted: tuple[float, str, int]) -> tuple[float, str, int]:
        """A state's best edits, or an insertion and the best ones of the state it leads to."""
        cost, edits, after = inserted
        return min(own, (cost + INSERT, "I" + edits, after), key=lambda x: (x[0], x[1][:1]))

    @staticmethod
    def _own(symbol: str | None, below: Node | None, state: int) -> tuple[float, str, int]:
        """The best of the edits that take the row."""
        if symbol is None:
            return (0 if state in (START, ASSISTANT) else ENDLESS), "", state
        options = [(DELETE + below.costs[state], "D", state)]
        if symbol != "x":
            extra, role = TRUNCATED * symbol.isupper(), symbol.lower()
            options.append((REROLE + extra + below.costs[NEXT[state]], "R", NEXT[state]))
            if (after := KEEP[state].get(role)) is not None:
                options.append((extra + below.costs[after], "K", after))
        return min(options)


class Suffixes:
    """The automaton along one signature; signatures should come sorted by their reverse."""

    def __init__(self) -> None:
        self.signature = ""
        self.path = [Node(None, None)]  # of the suffixes, the shortest first
        self.made = 0

    def audit(self, signature: str) -> tuple[int, str]:
        """Cost and edits of the cheapest repair; nodes of an ending shared with the last signature are reused."""
        reverse, before = signature[::-1], self.signature[::-1]
        shared = 0
        for a, b in zip(reverse, before):
            if a != b:
                break
            shared += 1
        del self.path[shared + 1 :]
        for symbol in reverse[shared:]:
            self.path.append(Node(symbol, self.path[-1]))
        self.made += len(reverse) - shared
        self.signature = signature
        state, edits = START, []
        for node in reversed(self.path):
            edits.append(node.edits[state])
            state = node.states[state]
        return int(self.path[-1].costs[START]), "".join(edits)


def damage(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, text`` with faults that the checksum of id and turn decides (20 classes, 0 to 4 are faults)."""
    rows = conversations(df, conv_col, turn_col, role_col, text_col)
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(BLANK)), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(BLANK)))
    fault = F.crc32(key.cast("binary")) % 20
    rows = rows.withColumn("_fault", fault)
    role = F.when(F.col("_fault") == 4, F.lit("user")).otherwise(F.col("role"))
    text = F.when(F.col("_fault") == 1, F.lit("")).when(F.col("_fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_fault") == 0, 0).when(F.col("_fault") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies))).drop("col")


def conversations(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    filled = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(BLANK)).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))]
    return df.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), *filled)


def signatures(rows: DataFrame) -> DataFrame:
    """Per conversation ``gaps, blank, duplicate, truncated, illegal`` and its ``signature``; one shuffle, without the texts."""
    text = F.col("text")
    blank = ~text.rlike(r"[^\x20\x09-\x0D]")
    short = rows.select(
        "conv_id", "turn", "role", F.md5(text.cast("binary")).alias("digest"), blank.alias("blank"), (~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("cut")
    ).repartition("conv_id")
    folded = short.groupBy("conv_id", "turn", "role", "digest", "blank", "cut").agg(F.count(F.lit(1)).cast("int").alias("n"))
    earlier = F.expr("row_number() OVER (PARTITION BY conv_id, role, digest ORDER BY turn ASC NULLS FIRST) > 1")
    initial = F.substring("role", 1, 1)
    kind = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    marked = folded.withColumn("fresh", F.when(F.col("blank") | earlier, 0).otherwise(1)).withColumn("kind", kind)
    symbol = F.when(F.col("fresh") == 0, F.lit("")).otherwise(F.when(F.col("cut"), F.upper("kind")).otherwise(F.col("kind")))
    marked = marked.withColumn("symbols", F.concat(symbol, F.repeat(F.lit("x"), F.col("n") - F.col("fresh")))).withColumn("kinds", F.repeat("kind", F.col("n")))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "role", "digest", "symbols", "kinds")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    found = marked.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.size(F.collect_set("turn")), F.lit(0)).cast("long").alias("gaps"),
        total(F.when(F.col("blank"), F.col("n"))).alias("blank"),
        total(F.when(~F.col("blank"), F.col("n") - F.col("fresh"))).alias("duplicate"),
        total(F.when(F.col("cut"), F.col("fresh"))).alias("truncated"),
        F.array_sort(F.collect_list(place)).alias("places"),
    )
    found = found.withColumn("kinds", F.array_join("places.kinds", "")).withColumn("signature", F.array_join("places.symbols", ""))
    legal = F.regexp_count("kinds", F.lit("s(?=u)|u(?=a)|a(?=u)"))
    illegal = F.greatest(F.char_length("kinds") - 1, F.lit(0)) - legal
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", illegal.cast("long").alias("illegal"), "signature")


def audits(rows: DataFrame) -> DataFrame:
    """``signatures`` with the cheapest repair: ``cost`` and ``audit``."""
    signed = stage(signatures(rows), "signatures")
    order = [F.reverse("signature"), F.col("conv_id")]
    schema = StructType([*signed.schema.fields, StructField("cost", LongType()), StructField("audit", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = Suffixes()
        last, found = None, (0, "")
        for batch in pieces(batches):
            out = []
            for signature in batch.column("signature").to_pylist():
                if signature != last:
                    last, found = signature, shared.audit(signature)
                out.append(found)
            new = [pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "cost", "audit"])

    return signed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def repaired(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """The conversations after the edits: ``conv_id, place, edit, role, text``; a conversation's rows come together and in order.

    A deleted row is left out, so ``edit`` is K, R or I; a conversation without rows has none.
    """
    first = audited.select("conv_id", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).alias("kind"))
    every = first.unionByName(rows.select("conv_id", "turn", "role", "text", F.lit(1).alias("kind")))
    order = ["conv_id", "kind", F.col("turn").asc_nulls_first(), "role", F.md5(F.col("text").cast("binary"))]
    every = every.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "kind", "role", "text")
    schema = StructType([rows.schema["conv_id"], StructField("place", LongType()), StructField("edit", StringType()), StructField("role", StringType()), StructField("text", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, state, place = None, "", 0, START, 0
        out: list[tuple] = []

        def insert() -> None:
            """Apply the insertions before the next row, or at the end."""
            nonlocal at, state, place
            while audit[at : at + 1] == "I":
                state = NEXT[state]
                out.append((conv, place, "I", NAMES[state], ""))
                at, place = at + 1, place + 1

        for batch in pieces(batches, 4 << 20):
            for key, kind, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 0:
                    insert()
                    conv, audit, at, state, place = key, text, 0, START, 0
                    continue
                insert()
                edit = audit[at]
                at += 1
                if edit == "D":
                    continue
                state = KEEP[state][role[:1]] if edit == "K" else NEXT[state]
                out.append((conv, place, edit, role if edit == "K" else NAMES[state], text))
                place += 1
            yield _batch(out, batch.schema.field("conv_id").type)
            out.clear()
        insert()
        if out:
            yield _batch(out, batch.schema.field("conv_id").type)

    return every.mapInArrow(run, schema)


def _batch(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 5
    types = (key, pa.int64(), pa.string(), pa.string(), pa.string())
    return pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(("conv_id", "place", "edit", "role", "text"), columns, types)})


def digests(ordered: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of the direct result of ``repaired``, whose rows come in order: of ``role:text``, joined by line feeds."""
    schema = StructType([ordered.schema["conv_id"], StructField("repaired_sha256", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, running, kind = None, None, pa.int64()
        for batch in batches:
            kind, done = batch.schema.field("conv_id").type, []
            for key, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text"))):
                if place == 0:
                    if running is not None:
                        done.append((conv, running.hexdigest()))
                    conv, running = key, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    running.update(f"\n{role}:{text}".encode())
            if done:
                yield _pairs(done, kind)
        if running is not None:
            yield _pairs([(conv, running.hexdigest())], kind)

    return ordered.mapInArrow(run, schema)


def _pairs(rows: list[tuple], key: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"conv_id": pa.array([r[0] for r in rows], key), "repaired_sha256": pa.array([r[1] for r in rows], pa.string())})


def repair_report(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per id in ``ids`` (one column): faults, cost, audit and the digest of the repaired conversation.

    ``rows`` has ``conv_id, turn, role, text``; an id without rows has zeros, an empty audit and the digest of nothing.
    """
    audited = stage(audits(rows), "audits")
    sums = digests(repaired(rows, audited))
    known = ids.toDF("conv_id").distinct()
    found = audited.drop("signature").withColumnRenamed("conv_id", "_audited")
    sums = sums.withColumnRenamed("conv_id", "_repaired")
    joined = known.join(found, F.col("conv_id").eqNullSafe(F.col("_audited")), "left").join(sums, F.col("conv_id").eqNullSafe(F.col("_repaired")), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
