"""Queries of rules that fail alone, with their SQL: counts of the good ones beside errors of the bad ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.operators.rules import Rule, masks, rule_results

Query = Callable[[SparkSession, str], DataFrame]


def _custom(rule_id: str, logic: str) -> Rule:
    return Rule(rule_id, "custom", "o_orderpriority", {"logic": logic})


#: Ten rules of `orders`: a pattern that does not compile, a clash of types on every row, and eight that can be checked, with the SQL of what they mark.
RULES = (
    (Rule("r01", "format", "o_orderstatus", {"regex": "([A-Z"}), None),
    (_custom("r02", "row['o_orderstatus'] > 5"), None),
    (Rule("r03", "format", "o_orderpriority", {"regex": r"(?P<rank_no>[1-3])-[A-Z ]+\Z"}), "NOT regexp_matches(o_orderpriority, '^[1-3]-[A-Z ]+$')"),
    (_custom("r04", "row['o_orderstatus'] + row['o_orderpriority'] == 'F5-LOW'"), "o_orderstatus || o_orderpriority = 'F5-LOW'"),
    (_custom("r05", "re.match('[0-9]-', row['o_orderpriority']) and int(row['o_orderpriority'][0]) > 3"), "regexp_matches(o_orderpriority, '^[0-9]-') AND CAST(o_orderpriority[1] AS INT) > 3"),
    (_custom("r06", "row['o_totalprice'] > 100000 and row['o_orderstatus'] in ['F', 3]"), "o_totalprice > 100000 AND o_orderstatus = 'F'"),
    (_custom("r07", "pd.to_datetime(row['o_orderdate']).year == 1995"), "year(o_orderdate) = 1995"),
    (_custom("r08", "len(row['o_orderpriority']) > 8 if row['o_orderstatus'] == 'O' else row['o_custkey'] % 2 == 1"), "CASE WHEN o_orderstatus = 'O' THEN length(o_orderpriority) > 8 ELSE o_custkey % 2 = 1 END"),
    (Rule("r09", "range", "o_totalprice", {"min": 5000, "max": 300000}), "o_totalprice < 5000 OR o_totalprice > 300000"),
    (Rule("r10", "uniqueness", "o_custkey"), "o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)"),
)
#: Expressions that pass over what would raise, over `orders`.
GUARDED = (
    ("a", "pd.notna(pd.to_numeric(row['word'], errors='coerce')) and float(row['word']) > 40", "TRY_CAST(word AS DOUBLE) > 40"),
    ("b", "row['word'].isdigit() and int(row['word']) % 7 == 3", "regexp_matches(word, '^[0-9]+$') AND TRY_CAST(word AS INT) % 7 = 3"),
    ("c", "pd.isna(pd.to_numeric(row['word']))", "word IS NOT NULL AND TRY_CAST(word AS DOUBLE) IS NULL"),
    ("d", "row['word'] != row['number'] and row['number'] in [1, '2', 3.0]", "number IN (1, 3)"),
    ("e", "row['word'].strip().upper()[:2] == 'NO' or 0 <= row['number'] < 2", "upper(word[1:2]) = 'NO' OR number IN (0, 1)"),
)


def _words(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return orders.select("o_orderkey", (F.col("o_custkey") % 90).alias("number"), F.when(F.col("o_custkey") % 11 == 0, F.lit("none")).when(F.col("o_custkey") % 13 != 0, (F.col("o_custkey") % 60).cast("string")).alias("word"))


def _guarded(spark: SparkSession, d: str) -> DataFrame:
    rules = [Rule(k, "custom", "word", {"logic": logic}) for k, logic, _ in GUARDED]
    df, _, failed = masks(_words(spark, d), rules)
    if failed:
        raise ValueError(failed)
    raised = [F.lit(False), *[F.col(c) for c in df.columns if c.startswith("_e_")]]
    return df.select("o_orderkey", *[F.col(f"_v_{k}").alias(k) for k, _, _ in GUARDED], F.greatest(*raised, F.lit(False)).alias("raised"))


def catalog() -> dict[str, tuple[Query, str | None]]:
    count = lambda sql: f"count(*) FILTER ({sql})"
    rows = [
        f"SELECT '{r.rule_id}' AS rule_id, '{r.type}' AS type, count(*) AS n_rows, " + (f"{count(sql)} AS violations, round({count(sql)} / count(*), 3) AS rate, {count(sql)} = 0 AS passed, false AS failed" if sql else "CAST(-1 AS BIGINT) AS violations, CAST(-1 AS DOUBLE) AS rate, false AS passed, true AS failed") + " FROM orders"
        for r, sql in RULES
    ]
    words = "WITH w AS (SELECT o_orderkey, o_custkey % 90 AS number, CASE WHEN o_custkey % 11 = 0 THEN 'none' WHEN o_custkey % 13 <> 0 THEN CAST(o_custkey % 60 AS VARCHAR) END AS word FROM orders)"
    return {
        "w4_isolated_errors": (
            lambda s, d: rule_results(s.read.parquet(f"{d}/orders.parquet"), [r for r, _ in RULES]).select("rule_id", "type", "n_rows", F.coalesce("violations", F.lit(-1)).alias("violations"), F.coalesce("rate", F.lit(-1.0)).alias("rate"), F.coalesce("passed", F.lit(False)).alias("passed"), F.col("error").isNotNull().alias("failed")),
            " UNION ALL ".join(rows),
        ),
        "v19_guarded": (_guarded, f"{words} SELECT o_orderkey, {', '.join(f'coalesce({sql}, false) AS {k}' for k, _, sql in GUARDED)}, false AS raised FROM w"),
    }
