"""Quantiles against NumPy and, to the last bit, Spark's percentile, however the values are laid out."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from pyspark.sql import functions as F

from clientele.operators import quantiles
from clientele.operators.quantiles import exact_quantiles

PROBS = [0.2, 0.4, 0.6, 0.8]


def check(spark, columns, parts, weight=None):
    df = spark.createDataFrame(pd.DataFrame(columns).astype(object).where(lambda d: d.notna(), None), ", ".join(f"{c} double" for c in columns))
    names = [c for c in columns if c != weight]
    row = exact_quantiles(df, names, PROBS, weight, parts).first()
    wanted = F.array(*[F.lit(p) for p in PROBS])
    frequency = F.col(weight).cast("bigint") if weight else F.lit(1)
    exact = df.agg(*[F.percentile(c, wanted, frequency).alias(c) for c in names]).first()
    for name in names:
        assert row[name] == exact[name]
        x = np.array(columns[name], dtype=float)
        w = np.array(columns[weight], dtype=int) if weight else np.ones(len(x), dtype=int)
        full = np.repeat(x, w)
        want = np.percentile(full[~np.isnan(full)], [100 * p for p in PROBS])
        assert np.allclose(row[name], want, rtol=1e-12, atol=0), (name, row[name], want)


@pytest.mark.parametrize("parts", [None, 1, 2, 7, 50])
def test_continuous_tied_and_missing_values(spark, parts):
    rng = np.random.default_rng(1)
    n = 500
    amounts = np.round(rng.lognormal(3, 2, n), 2)
    visits = rng.integers(1, 6, n).astype(float)
    gaps = np.where(rng.random(n) < 0.2, np.nan, rng.integers(0, 400, n))
    check(spark, {"a": amounts, "b": visits, "c": gaps}, parts)


@pytest.mark.parametrize("parts", [None, 1, 5, 40])
def test_weights_repeat_rows(spark, parts):
    rng = np.random.default_rng(2)
    n = 300
    weights = np.where(rng.random(n) < 0.01, 500, rng.integers(1, 4, n)).astype(float)
    check(spark, {"a": np.round(rng.gamma(2, 50, n), 2), "w": weights}, parts, weight="w")


@pytest.mark.parametrize("parts", [None, 1, 4])
@pytest.mark.parametrize("n", [1, 2, 3, 6])
def test_few_rows(spark, n, parts):
    check(spark, {"a": [float(i * i) for i in range(n)]}, parts)


def test_one_value_holds_most_rows(spark):
    check(spark, {"a": [5.0] * 400 + list(np.arange(100.0))}, 20)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=60), st.integers(2, 12))
def test_any_integers(spark, data, parts):
    check(spark, {"a": [float(x) for x in data]}, parts)


def test_only_a_small_share_of_the_values_is_shuffled(spark, tmp_path):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame(pd.DataFrame({"a": rng.normal(size=100_000), "b": rng.normal(size=100_000)}))
    ranged = quantiles._ranged(df.withColumn("w", F.lit(1)), ["a", "b"], quantiles.RANGES)
    sizes = ranged.groupBy("feature", "range").count().collect()
    assert sum(r["count"] for r in sizes) == 200_000
    # at most two ranges a rank
    assert max(r["count"] for r in sizes) <= 3 * 100_000 / quantiles.RANGES
