"""What a run reads again, and how many pairs it looks at."""

import datetime
from itertools import combinations

from siltmark.operators import detectors, facts, inspection, quantiles
from siltmark.operators.histogram import columnar_histogram, plain_columns, value_histogram
from siltmark.operators.rules import Clear, Rule, masks, results_and_totals
from siltmark.plans import pipeline


def test_a_kept_histogram_stays_kept(spark):
    vh = value_histogram(spark.createDataFrame([("a", 1), ("b", 2), (None, 2)], "x string, y long"), "t").persist()
    try:
        assert facts.column_facts(vh)["t", "x"]["n_distinct"] == 2
        assert vh.storageLevel.useMemory
    finally:
        vh.unpersist()


def test_near_duplicates_against_all_pairs(spark):
    names = [f"Customer#{k:09}" for k in range(0, 300, 3)] + ["cold widget", "old widget", "gold widget", "ab", "abc", "x"]
    grams = lambda s, k: {s[i : i + k] for i in range(max(len(s) - k + 1, 1))}
    vh = value_histogram(spark.createDataFrame([(n,) for n in names], "x string"), "t")
    for k in (2, 3):
        want = {tuple(sorted(p)) for p in combinations(names, 2) for a, b in [[grams(s, k) for s in p]] if len(a & b) / len(a | b) >= 0.88}
        got = [(r["value_a"], r["value_b"]) for r in detectors.near_duplicate_values(vh, k=k).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_columns_counted_one_by_one(spark):
    rows = [(k % 3, k / 4 if k % 5 else None, f" v{k % 7} ", datetime.datetime(2024, 1, 1 + k % 4), [k % 2], -0.0 if k % 2 else 0.0) for k in range(40)]
    df = spark.createDataFrame(rows, "k int, x double, `s.t` string, d timestamp, a array<int>, z double")
    names = df.toDF("k", "x", "s", "d", "a", "z")
    want = value_histogram(names, "t")
    assert sorted(map(str, columnar_histogram(names, "t").collect())) == sorted(map(str, want.collect()))
    # no column is read with another one: each has an aggregation on its own values
    assert {r["column"]: r["n"] for r in columnar_histogram(df, "t").groupBy("column").count().withColumnRenamed("count", "n").collect()}["s.t"] == 7


def test_fences_and_sentinels_from_a_histogram(spark, monkeypatch):
    df = spark.createDataFrame([(float(k % 37), k, None if k % 3 else 9999.0 if k % 60 == 0 else k % 11 / 2) for k in range(600)], "x double, y long, z double")
    vh, columns = value_histogram(df, "t"), {("t", "x"): 37, ("t", "y"): 600, ("t", "z"): 12}
    want = {("t", c): f for c, f in detectors.fences(df, ["x", "y", "z"]).items()}
    assert detectors.histogram_fences(vh, columns) == want and len(want) == 3
    bounds = {c: (f.lower, f.upper) for c, f in want.items()}
    odd = [(r["column"], r["side"], r["value"], r["cnt"], r["share"]) for r in detectors.histogram_sentinels(vh, bounds).collect()]
    assert odd == [tuple(r) for r in detectors.all_sentinels(df, {c: b for (_, c), b in bounds.items()}).collect()] and odd
    monkeypatch.setattr(detectors, "AT_ONCE", 100)
    monkeypatch.setattr(quantiles, "SMALL_BYTES", 0)
    assert detectors.histogram_fences(vh, columns) == want


def test_rules_that_values_show_to_hold_read_no_other_table(spark):
    parent, child = spark.range(50).toDF("parent_id"), spark.range(200).selectExpr("id AS child_id", "id % 50 AS parent_id")
    for lost, bad in ((0, 0), (1, 4)):
        tables = {"parent": parent.where(f"parent_id >= {lost}"), "child": child}
        paths = [{"table_a": "child", "column_a": "parent_id", "table_b": "parent", "column_b": "parent_id", "overlap": 50 - lost, "distinct_a": 50, "distinct_b": 50 - lost}]
        clear = pipeline._clear_references(paths, plain_columns(tables))
        rule = pipeline._cleared(Rule("1", "referential_cross_table", "parent_id", {"parent_table": "parent", "parent_column": "parent_id"}), "child", clear, set())
        assert isinstance(rule, Clear) == (not lost)
        results, totals = results_and_totals(child, [rule], tables=tables)
        assert (results[0]["violations"], totals["failing_rows"], totals["n_rows"]) == (bad, bad, 200)
        marked = masks(child, [rule], tables=tables)[0]
        assert ("Join" in marked._jdf.queryExecution().optimizedPlan().toString()) == bool(lost)


def test_repeated_keys_of_plain_columns(spark):
    df = spark.createDataFrame([(k if k != 7 else 6, f" A{k if k != 9 else 8} ", None if k % 9 == 0 else k % 13) for k in range(200)], "acct_id long, user_id string, age int")
    vh, declared = value_histogram(df, "t"), inspection.declared_types({"t": df})
    faults = ("null", "duplicate_key")
    got = [[(r["column"], r["fault"], r["n"], r["examples"]) for r in inspection.column_errors(vh, declared, faults=faults, plain=p).orderBy("column", "fault").collect()] for p in ((), plain_columns({"t": df}))]
    assert got[0] == got[1] == [("acct_id", "duplicate_key", 2, ["6"]), ("age", "null", 23, []), ("user_id", "duplicate_key", 2, ["A8"])]
