"""Dates in several layouts, against dates written out by hand."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siltmark.functions import canon
from siltmark.operators import dates
from siltmark.operators.histogram import value_histogram
from siltmark.operators.rules import Rule, compile_rule

READ = [
    ("2024-02-29", datetime(2024, 2, 29)),
    ("2023-02-29", None),
    (" 2024/3/5 ", datetime(2024, 3, 5)),
    ("2024.3.5", datetime(2024, 3, 5)),
    ("20240305", datetime(2024, 3, 5)),
    ("20241305", None),
    ("2024-03-05T07:08:09.25", datetime(2024, 3, 5, 7, 8, 9, 250000)),
    ("2024-03-05 12:01 AM", datetime(2024, 3, 5, 0, 1)),
    ("2024-03-05 12:01 pm", datetime(2024, 3, 5, 12, 1)),
    ("2024-03-05 13:01 pm", None),
    ("2024-03-05 24:00", None),
    ("2024-03-05 23:59:60", None),
    ("2024-03-05T01:30:00+02:00", datetime(2024, 3, 4, 23, 30)),
    ("2024-03-05T01:30:00Z", datetime(2024, 3, 5, 1, 30)),
    ("3/5/2024", datetime(2024, 3, 5)),
    ("31/5/2024", datetime(2024, 5, 31)),
    ("31/31/2024", None),
    ("March 5th, 2024", datetime(2024, 3, 5)),
    ("Tue, Mar 5, 2024", datetime(2024, 3, 5)),
    ("5-Sept-2024 6:07", datetime(2024, 9, 5, 6, 7)),
    ("5 Marble 2024", None),
    ("a|b|c|d|e|f|g|h|i", None),
    ("12", None),
    ("", None),
    (None, None),
    ("9" * 100_000, None),
]


@pytest.fixture
def utc(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    yield spark
    spark.conf.set("spark.sql.session.timeZone", zone)


def test_values_are_read_by_their_layout(utc):
    df = utc.createDataFrame([(i, v) for i, (v, _) in enumerate(READ)], "i int, v string")
    got = {r.i: r.at for r in df.select("i", F.date_format(dates.parse(F.col("v")), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at")).collect()}
    assert got == {i: at and at.strftime("%Y-%m-%d %H:%M:%S.%f") for i, (_, at) in enumerate(READ)}


def test_a_column_tells_the_order_of_its_days(utc):
    rows = [("01/02/2024", "01/02/2024", "01/02/2024", "x"), ("25/02/2024", "02/25/2024", "25/02/2024", None), ("03/04/2024", "03/04/2024", "02/25/2024", "n/a")]
    df = utc.createDataFrame(rows, "a string, b string, c string, d string")
    got = {r.column: r for r in dates.layouts(value_histogram(df, "t")).collect()}
    assert [(k, got[k].left, got[k].days_lead, got[k].mixed, got[k].dates) for k in "abcd"] == [("a", "day_month_year", True, False, 3), ("b", "month_day_year", False, False, 3), ("c", "", False, True, 3), ("d", "", False, False, 0)]
    # read with the month first, 01/02 would be before 15 January
    other = df.withColumn("e", F.lit("15 Jan 2024"))
    late = lambda c: [r[0] for r in other.select(compile_rule(other, Rule("1", "date_ordering", "", {"col_a": c, "col_b": "e"}))).collect()]
    assert late("a") == [True, True, True] and late("b") == [False, True, True]
    assert dates.layouts(value_histogram(df.limit(0), "t")).count() == 0


def test_fixed_formats_come_first(utc):
    df = utc.createDataFrame([("2024-03-05 10:00:00",), ("March 5, 2024",), ("5 March 2024",), ("no date",)], "v string")
    got = df.select(canon.try_date(F.col("v")).isNotNull().alias("fixed"), dates.parse(F.col("v"), formats=("yyyy-MM-dd HH:mm:ss", "MMMM d, yyyy")).isNotNull().alias("mixed")).collect()
    assert [tuple(r) for r in got] == [(True, True), (True, True), (False, True), (False, False)]
