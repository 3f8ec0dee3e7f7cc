"""Column expressions: edges, ties, nulls and rounding."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from clientele.functions import dates, numbers, scoring, text


def values(spark, data, expr, schema="x string"):
    df = spark.createDataFrame([(d,) for d in data], schema)
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_safe_bigint(spark):
    got = values(spark, ["12", " 7 ", "12.0", "12.5", "Closed", "", None, "9007199254740993"], numbers.safe_bigint)
    assert got == [12, 7, 12, None, None, None, None, 9007199254740993]


def test_half_even_and_percent(spark):
    assert values(spark, [0.25, 12.34], numbers.percent_text, "x double") == ["0.2%", "12.3%"]
    assert values(spark, [0.125, -0.5, 1.0], numbers.ratio_text, "x double") == ["12%", "-50%", "100%"]


@pytest.mark.parametrize("x", [0.25, 0.35, 0.45, 2.25, 230452.65000000002, 1234.55, -0.75])
def test_half_even_is_the_numpy_rule(spark, x):
    import numpy as np

    assert values(spark, [x], numbers.half_even, "x double") == [float(np.round(x, 1))]


def test_money_and_counts(spark):
    assert values(spark, [1234567.891, 0.0], numbers.money_text, "x double") == ["₹1,234,567.89", "₹0.00"]
    assert values(spark, [1234567], numbers.count_text, "x bigint") == ["1,234,567"]


def test_exact_sum_does_not_depend_on_order(spark):
    amounts = [0.1, 0.2, 0.3, 1e9, -1e9, 0.7] * 50
    sums = {
        spark.createDataFrame([(a,) for a in order], "x double").agg(numbers.exact_sum(F.col("x"))).first()[0]
        for order in (amounts, amounts[::-1], sorted(amounts))
    }
    assert sums == {65.0}


def test_exact_mean_with_weight_and_nulls(spark):
    df = spark.createDataFrame([(1.0, 3), (None, 100), (5.0, 1)], "x double, w bigint")
    row = df.agg(numbers.exact_mean(F.col("x")).alias("a"), numbers.exact_mean(F.col("x"), F.col("w")).alias("b")).first()
    assert (row["a"], row["b"]) == (3.0, 2.0)


def test_parse_datetime(spark):
    got = values(spark, ["04-07-2023 18:30", "bad", None], lambda c: dates.parse_datetime(c, "dd-MM-yyyy HH:mm"))
    assert got == [dt.datetime(2023, 7, 4, 18, 30), None, None]


def test_elapsed_days_counts_whole_days(spark):
    data = [(dt.datetime(2023, 1, 1, 23), dt.datetime(2023, 1, 3, 1)), (dt.datetime(2023, 1, 1), dt.datetime(2023, 1, 3))]
    df = spark.createDataFrame(data, "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(dates.elapsed_days(F.col("a"), F.col("b"))).collect()] == [1, 2]


def test_in_year_is_half_open(spark):
    data = [dt.datetime(1996, 12, 31, 23, 59, 59), dt.datetime(1997, 1, 1), dt.datetime(1997, 12, 31, 23), dt.datetime(1998, 1, 1)]
    assert values(spark, data, lambda c: dates.in_year(c, 1997), "x timestamp_ntz") == [False, True, True, False]


def test_date_texts(spark):
    day = [dt.datetime(2023, 11, 4, 9, 5, 7)]
    assert values(spark, day, dates.long_date, "x timestamp_ntz") == ["November 04, 2023"]
    assert values(spark, day, dates.month_name, "x timestamp_ntz") == ["November"]
    assert values(spark, day, dates.time_of_day, "x timestamp_ntz") == ["09:05:07"]


def test_upper_or_null(spark):
    assert values(spark, ["f", "nan", "NaN", None, "M"], text.upper_or_null) == ["F", None, None, None, "M"]


def test_unknown_label_is_null(spark):
    assert values(spark, ["F", "X", None], lambda c: text.label(c, {"F": "Female", "M": "Male"})) == ["Female", None, None]


def test_list_texts(spark):
    df = spark.createDataFrame([(["a", "b"], [1, 2])], "n array<string>, v array<int>")
    assert tuple(df.select(text.quoted_list(F.col("n")), text.bracket_list(F.col("v"))).first()) == ("'a', 'b'", "[1, 2]")


CUTS = [10.0, 20.0, 30.0, 40.0]


def test_bands_on_the_cuts(spark):
    data = [None, 0.0, 10.0, 10.5, 20.0, 30.0, 40.0, 40.5]
    assert values(spark, data, lambda c: scoring.band(c, CUTS), "x double") == [5, 1, 1, 2, 2, 3, 4, 5]
    assert values(spark, data, lambda c: scoring.band(c, CUTS, highest_first=True), "x double") == [1, 5, 5, 4, 4, 3, 2, 1]


EXPECTED_SEGMENTS = {
    "Hibernating": ["11", "12", "21", "22"],
    "At risk": ["13", "14", "23", "24"],
    "Can't lose them": ["15", "25"],
    "About to sleep": ["31", "32"],
    "Need attention": ["33"],
    "Loyal customers": ["34", "35", "44", "45"],
    "Promising": ["41"],
    "New customers": ["51"],
    "Potential loyalists": ["42", "43", "52", "53"],
    "Champions": ["54", "55"],
}


def test_every_code_has_one_segment(spark):
    codes = [(r, f) for r in range(1, 6) for f in range(1, 6)]
    df = spark.createDataFrame(codes, "r int, f int")
    named = df.select("r", "f", scoring.segment(F.col("r"), F.col("f")).alias("s")).collect()
    got = {}
    for row in named:
        got.setdefault(row["s"], []).append(f"{row['r']}{row['f']}")
    assert got == EXPECTED_SEGMENTS
    described = spark.createDataFrame([(s,) for s in got], "x string").select(scoring.segment_description(F.col("x"))).collect()
    assert all(r[0] for r in described)


def test_tier_edges(spark):
    scores = [3, 5, 6, 7, 8, 9, 10, 11, 15]
    want = ["Green", "Green", "Bronze", "Bronze", "Silver", "Silver", "Gold", "Platinum", "Platinum"]
    assert values(spark, scores, scoring.tier, "x int") == want
    assert all(values(spark, want, scoring.tier_description))
