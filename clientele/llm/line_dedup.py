"""Line deduplication over overlapping windows of three lines (DataFrame functions only).

Every three consecutive lines that have text form a window. A window whose three lines occur more
than once in the corpus is kept where it comes first and removed everywhere else: the positions
that later occurrences cover are merged, and the lines at those positions go.

Cases with a defined result:

* lines compare after trimming blanks, tabs and carriage returns; case and inner blanks count;
* lines without text are no part of a window, but go when they lie inside a removed one;
* a text with fewer than three lines with text (null and empty ones too) stays as it is;
* "first" is by id (null first), then by a hash of the text, then by position, so repeated rows
  with one id and one text all get the same result;
* an occurrence may overlap its own later copy inside one text; the later one goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clientele.llm.inputs import texts, unused, whole
from clientele.session import stage

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(whole(text), "\n", -1)


def _windows(docs: DataFrame) -> DataFrame:
    """One row per window: document, first and last position, 128-bit hash of its lines."""
    numbered = F.transform(_lines(F.col("text")), lambda x, i: F.struct(i.alias("pos"), F.btrim(x, F.lit(" \t\r\f\x0b")).alias("line")))
    full = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.filter(numbered, lambda x: x.line != "").alias("e"))

    def window(i: Column) -> Column:
        at = [F.get("e", i + k) for k in range(WINDOW)]
        return F.struct(
            at[0].pos.alias("first"),
            at[-1].pos.alias("last"),
            F.xxhash64(*(a.line for a in at)).alias("h1"),
            F.xxhash64(F.lit("second"), *(a.line for a in at)).alias("h2"),
        )

    found = F.transform(F.sequence(F.lit(0), F.size("e") - WINDOW), window)
    # the outer form and a filter behind it: in front of an inner explode Spark would split every text again
    exploded = full.select("doc_id", "text_hash", F.explode_outer(F.when(F.size("e") >= WINDOW, found)).alias("w"))
    return exploded.filter("w IS NOT NULL").select("doc_id", "text_hash", "w.*")


def covered_positions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text with something to remove: ``doc_id, text_hash, gone`` (sorted line positions from 0).

    The windows are staged, so texts are split once; counting a window is combined before the
    shuffle, and the join back is a plain equi join whose hot keys adaptive execution can split.
    """
    windows = stage(_windows(texts(df, id_col, text_col)), "line_windows")
    place = F.struct("doc_id", "text_hash", "first")
    repeated = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("kept")).filter("n > 1").drop("n")
    later = windows.join(repeated, ["h1", "h2"]).filter(place > F.col("kept"))
    spans = later.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    positions = F.flatten(F.transform("spans", lambda s: F.sequence(s.first, s.last)))
    return spans.select("doc_id", "text_hash", F.array_sort(F.array_distinct(positions)).alias("gone"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] | None = None) -> DataFrame:
    """``df`` with the repeated lines taken out of ``text_col``; rows and other columns stay.

    ``counts`` names two more columns: lines in the text, lines removed.
    """
    spare = {name: unused(df, name) for name in ("_id", "_hash", "_gone", "_lines")}
    gone = covered_positions(df, id_col, text_col).select(F.col("doc_id").alias(spare["_id"]), F.col("text_hash").alias(spare["_hash"]), F.col("gone").alias(spare["_gone"]))
    text, lines = F.col(f"`{text_col}`"), F.col(spare["_lines"])
    joined = df.join(gone, F.col(f"`{id_col}`").eqNullSafe(gone[spare["_id"]]) & (F.xxhash64(text) == gone[spare["_hash"]]), "left")
    split = joined.withColumn(spare["_lines"], _lines(text))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(spare["_gone"]))
    cleaned = F.when(F.col(spare["_gone"]).isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    kept = [cleaned.alias(text_col) if c == text_col else F.col(f"`{c}`") for c in df.columns]
    if counts:
        removed = F.coalesce(F.size(spare["_gone"]), F.lit(0))
        kept += [F.when(text.isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias(counts[0]), removed.cast("long").alias(counts[1])]
    return split.select(*kept)
