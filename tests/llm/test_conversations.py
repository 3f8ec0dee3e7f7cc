"""Conversation repair against a search over all edits, and its cases with a defined result."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from clientele.llm import conversation_repair as repair

GRAMMAR = re.compile("(s?(ua)+)?")
NOTHING = hashlib.sha256(b"").hexdigest()


def cheapest(signature):
    """Cost and audit by searching all edit strings, the cheapest and then the smallest first."""
    seen, queue = set(), [(0, "", 0, "")]  # cost, audit, rows taken, the last two roles as they matter to the grammar
    while queue:
        cost, audit, at, roles = heapq.heappop(queue)
        if (at, roles) in seen:
            continue
        seen.add((at, roles))
        if at == len(signature) and roles in ("", "a"):
            return cost, audit
        wanted = "a" if roles == "u" else "u"
        if at < len(signature):
            c = signature[at]
            heapq.heappush(queue, (cost + 3, audit + "D", at + 1, roles))
            if c != "x":
                extra = c.isupper()
                heapq.heappush(queue, (cost + 2 + extra, audit + "R", at + 1, wanted))
                if c.lower() == wanted or (c.lower() == "s" and roles == ""):
                    heapq.heappush(queue, (cost + extra, audit + "K", at + 1, c.lower()))
        heapq.heappush(queue, (cost + 2, audit + "I", at, wanted))


def test_automaton_finds_the_cheapest_and_smallest_audit():
    rng = random.Random(4)
    signatures = {"".join(rng.choice("suaoSUAOx") for _ in range(rng.randrange(8))) for _ in range(1500)}
    shared = repair.Suffixes()
    for signature in sorted(signatures, key=lambda s: s[::-1]):
        assert shared.audit(signature) == cheapest(signature), signature
    suffixes = {s[k:] for s in signatures for k in range(len(s))}
    assert shared.made == len(suffixes)  # one node for each distinct suffix


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out


def brute(rows):
    """What ``repair_report`` gives, by conversation."""
    found = {}
    changed = damaged(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in changed if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        seen, signature, faults = set(), "", []
        for _, role, text in own:
            kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
            fault = "blank" if not text.strip("\x20\t\n\r\x0b\x0c") else "duplicate" if (role, text) in seen else "truncated" if text.rstrip("\x20\t\n\r\x0b\x0c")[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            signature += "x" if fault in ("blank", "duplicate") else kind.upper() if fault else kind
        kinds = [r[1][:1] if r[1][:1] in ("s", "u", "a") else "o" for r in own]
        turns = {r[0] for r in own} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit = cheapest(signature)
        out, at, roles = [], 0, ""
        for edit in audit:
            wanted = "a" if roles[-1:] == "u" else "u"
            if edit == "I":
                out.append(("user" if wanted == "u" else "assistant", ""))
            elif edit != "D":
                out.append((own[at][1] if edit == "K" else "user" if wanted == "u" else "assistant", own[at][2]))
            at += edit != "I"
            if edit != "D":
                roles += out[-1][0][:1]
        assert GRAMMAR.fullmatch(roles)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:]))
        text = "\n".join(f"{r}:{t}" for r, t in out)
        found[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return found


def report(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, place int, kind string, audit string")
    return {r[0]: tuple(r)[1:] for r in repair.repair_report(repair.damage(df), df.select("conv_id")).collect()}


def test_report_equals_brute_force(spark):
    rng = random.Random(8)
    texts = ["", " \t", None, "a.", "b", "c!\n", "d? ", "e ", "long " * 20000 + ".", "x.y"]
    roles = ["user", "assistant", "system", "tool", "", None, "User"]
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randrange(1, 9)):
            for _ in range(1 + (rng.random() < 0.1)):  # turns may repeat, with the same row or another
                rows.append((conv, turn if rng.random() < 0.9 else None, rng.choice(roles[:2] if rng.random() < 0.7 else roles), rng.choice(texts)))
    rows += rows[:5]
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "only row."))
    found = report(spark, rows)
    assert found == brute(rows)
    assert found[gone] == (0, 0, 0, 0, 0, 0, "", NOTHING)


def test_long_conversations_and_hot_signatures(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"text {t}.") for t in range(3000)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"text {t}.") for c in range(2, 400) for t in range(2)]
    assert report(spark, rows) == brute(rows)


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "hi."), (1, 1, "user", "hi."), (1, 2, "tool", "cut"), (2, 0, "assistant", "hello.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = repair.repaired(df, repair.audits(df))
    assert sorted(tuple(r) for r in found.collect()) == [
        (1, 0, "K", "user", "hi."), (1, 1, "R", "assistant", "cut"), (2, 0, "I", "user", ""), (2, 1, "K", "assistant", "hello."),
    ]
    audit = {r.conv_id: (r.cost, r.audit) for r in repair.audits(df).collect()}
    assert audit == {1: (6, "KDR"), 2: (2, "IK")}


@pytest.mark.parametrize("name", ["conv_id", "kind"])
def test_empty_table(spark, name):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string, kind string")
    found = repair.repair_report(repair.damage(df), df.select("conv_id"))
    assert found.collect() == [] and name in [*found.columns, "kind"]
    assert repair.repaired(df, repair.audits(df)).collect() == []


def test_plan_has_no_pairs(spark):
    df = spark.createDataFrame([(1, 0, "user", "a.")], "conv_id long, turn long, role string, text string")
    plan = repair.signatures(df.withColumn("text", F.upper("text")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Cartesian" not in plan
