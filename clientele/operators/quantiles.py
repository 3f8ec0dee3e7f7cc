"""Exact interpolated quantiles without shuffling the values, or gathering them in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Ranges that the sketch cuts the values of a column into; a wanted rank's range holds about that share of them.
RANGES = 128
ACCURACY = 8 * RANGES


def _interpolate(low: float, high: float, position: float) -> float:
    """Linear interpolation between two neighbouring ranks, in the order of Spark's ``percentile``."""
    below = math.floor(position)
    return low if position == below or low == high else (below + 1 - position) * low + (position - below) * high


def _literal(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A few rows as literals."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(r, names)]) for r in rows])))


def _ranged(df: DataFrame, cols: Sequence[str], ranges: int) -> DataFrame:
    """``feature, value, range, w``: every value that is not null with the range it falls into, ranges in rising order.

    The cuts come from mergeable sketches, one pass for all columns. They need not be exact: they only say where
    values are counted.
    """
    probs = [k / ranges for k in range(1, ranges)]
    sketches = df.agg(*[F.percentile_approx(c, probs, max(ACCURACY, 8 * ranges)).alias(c) for c in cols]).first() if probs else {}
    splits = []
    for c in cols:
        cuts = {x + 0.0 for x in (sketches[c] if probs else None) or () if math.isfinite(x)}
        splits.append([-math.inf, *sorted(cuts or {0.0}), math.inf])
    names = [f"_range{k}" for k in range(len(cols))]
    placed = Bucketizer(inputCols=list(cols), outputCols=names, splitsArray=splits, handleInvalid="keep").transform(df)
    each = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"), F.col(n).cast("int").alias("range")) for c, n in zip(cols, names)]
    return placed.select(F.inline(F.array(*each)), "w").filter(F.col("value").isNotNull())


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], weight: str | None = None, ranges: int | None = None
) -> DataFrame:
    """One row with an array of quantiles per column, nulls ignored; to the last bit those of ``percentile``.

    ``weight`` repeats a row that many times without writing it out. One way for every
    size: sketches cut each column into ranges, one exact pass counts the rows of every range (a
    hundred numbers a column), and only the values of the ranges that hold a wanted rank are
    counted by value, equal ones combined before their shuffle, and numbered. ``df`` is read three times and should be staged.
    """
    spark = df.sparkSession
    w: Column = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    values = df.select(*[F.col(c).cast("double").alias(c) for c in cols], w.alias("w"))
    ranged = _ranged(values, cols, ranges or RANGES)

    sizes: dict[str, dict[int, int]] = {c: {} for c in cols}
    for r in ranged.groupBy("feature", "range").agg(F.sum("w").alias("n")).collect():
        sizes[r.feature][r.range] = r.n
    positions: dict[str, list[float]] = {}
    wanted: list[tuple[str, int, int, int]] = []  # feature, range, rank in it, rank among all
    for c in cols:
        n = sum(sizes[c].values())
        positions[c] = [p * (n - 1) for p in probs] if n else []
        for rank in sorted({min(math.floor(p) + end, n - 1) for p in positions[c] for end in (0, 1)}):
            before = 0
            for part in sorted(sizes[c]):
                if rank < before + sizes[c][part]:
                    wanted.append((c, part, rank - before, rank))
                    break
                before += sizes[c][part]

    found: dict[tuple[str, int], float] = {}
    if wanted:
        parts = F.broadcast(_literal(spark, sorted({x[:2] for x in wanted}), ["feature", "range"]))
        counts = ranged.join(parts, ["feature", "range"]).groupBy("feature", "range", "value").agg(F.sum("w").alias("size"))
        running = F.sum("size").over(Window.partitionBy("feature", "range").orderBy("value"))
        numbered = counts.withColumn("upto", running).withColumn("from", F.col("upto") - F.col("size"))
        ranks = F.broadcast(_literal(spark, wanted, ["feature", "range", "place", "rank"]))
        at = numbered.join(ranks, ["feature", "range"]).filter((F.col("place") >= F.col("from")) & (F.col("place") < F.col("upto")))
        found = {(r.feature, r.rank): r.value for r in at.select("feature", "rank", "value").collect()}

    def quantile(c: str, position: float) -> float:
        low = math.floor(position)
        return _interpolate(found[c, low], found[c, min(low + 1, sum(sizes[c].values()) - 1)], position)

    arrays = [F.array(*[F.lit(quantile(c, p)) for p in positions[c]]) if positions[c] else F.lit(None).cast("array<double>") for c in cols]
    return spark.range(1).select(*[a.alias(c) for a, c in zip(arrays, cols)])
