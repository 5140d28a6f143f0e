"""Column helpers and the silent-semantics traps."""

import datetime as dt

import pytest

from supplyscope.functions import (clip, days_between, exact_sum, format_currency, matches,
                                   round1, safe_ratio, shorten, weekday0, year_month)


def one(spark, expr, schema="x double", rows=((None,),)):
    return spark.createDataFrame(list(rows), schema).select(expr.alias("r")).collect()


def test_clip_keeps_missing(spark):  # T1
    rows = one(spark, clip("x", 0, 100), rows=[(None,), (-5.0,), (50.0,), (150.0,)])
    assert [r.r for r in rows] == [None, 0.0, 50.0, 100.0]


def test_safe_ratio_guards_zero_and_missing(spark):  # T3
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (1.0, 4.0), (None, 2.0)], "n double, d double")
    got = [r.r for r in df.select(safe_ratio("n", "d", 100.0).alias("r")).collect()]
    assert got == [0.0, 0.0, 25.0, None]


def test_round1_ties_to_even(spark):  # T4
    rows = one(spark, round1("x"), rows=[(67.85,), (67.95,), (0.25,), (None,)])
    assert [r.r for r in rows] == [67.8, 68.0, 0.2, None]


def test_calendar_helpers(spark):  # T6, T7, F3
    df = spark.createDataFrame([(dt.date(2024, 6, 2), dt.date(2024, 6, 12))], "a date, b date")
    r = df.select(weekday0("a").alias("w"), days_between("a", "b").alias("d"),
                  year_month("a").alias("ym")).first()
    assert (r.w, r.d, r.ym) == (0, 10, "2024-06")


def test_exact_sum_independent_of_order(spark):  # T22
    vals = [(0.1,), (0.2,), (0.3,), (1e6 + 0.01,), (-2.5,), (None,)]
    a = spark.createDataFrame(vals, "x double").repartition(1).agg(exact_sum("x").alias("s")).first().s
    b = spark.createDataFrame(vals[::-1], "x double").repartition(3).agg(exact_sum("x").alias("s")).first().s
    assert a == b == 999998.11
    assert spark.createDataFrame([(None,)], "x double").agg(exact_sum("x").alias("s")).first().s is None


def test_format_currency(spark):  # F12
    rows = one(spark, format_currency("x"),
               rows=[(None,), (0.0,), (1234567.0,), (12345.0,), (999.994,), (-5.0,)])
    assert [r.r for r in rows] == ["$0.00", "$0.00", "$1.23M", "$12.3K", "$999.99", "$-5.00"]


def test_shorten(spark):  # F13
    rows = one(spark, shorten("x", 18), "x string",
               rows=[("short",), ("exactly eighteen!!",), ("a name longer than eighteen",), (None,)])
    assert [r.r for r in rows] == ["short", "exactly eighteen!!", "a name longer than...", None]


def test_matches_regex_literal_and_missing(spark):  # T12
    df = spark.createDataFrame([("Acme (North)",), (None,)], "x string")
    lit = [r.r for r in df.select(matches("x", "(", literal=True).alias("r")).collect()]
    assert lit == [True, False]
    rx = [r.r for r in df.select(matches("x", "acme.*north").alias("r")).collect()]
    assert rx == [True, False]
    with pytest.raises(Exception):
        df.select(matches("x", "(").alias("r")).collect()
