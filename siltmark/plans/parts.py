"""Named queries on parts that larger ones are made of, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.operators import casts, detectors, facts, generate, profile, relationships
from siltmark.operators.histogram import value_histogram
from siltmark.operators.rules import rule_summary
from siltmark.plans.extra import TOKENS, _dirty, _dirty_sql, _t
from siltmark.plans.paths import COLUMNS, _merged_sql, _tables, _vh
from siltmark.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
MEASURED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SHARES = [0.001, 0.5, 0.999]
SHOWN = ["email", "code", "city", "num", "age"]


def _extremes(s: SparkSession, d: str) -> DataFrame:
    found = facts.extremes(value_histogram(_dirty(s, d).select(*SHOWN), "fx"))
    return found.withColumns({c: F.col(c).cast("long") for c in ("min_length", "max_length")} | {c: F.round(c, 6) for c in ("numeric_share", "uniqueness")})


def _clean(s: SparkSession, d: str) -> DataFrame:
    raw = _t(s, d, "orders").select(
        F.col("o_orderkey").alias(" o key"), F.concat(F.lit("  "), "o_orderstatus", F.lit("\t")).alias("a-b"), F.col("o_orderpriority").alias("a/b"), F.struct(F.col("o_orderpriority").alias("z"), F.col("o_orderkey").alias("a"), F.when(F.col("o_orderkey") % 2 == 0, 1).alias("m")).alias("n.est"),
    )
    return readers.clean(raw)


def _dates(s: SparkSession, d: str) -> DataFrame:
    rows = _t(s, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("near"), F.when(F.col("o_orderkey") % 100 == 0, F.lit("2900-01-01")).otherwise("2001-02-03").cast("date").alias("far"))
    done = casts.dates_in_bounds(rows)
    return done.select("o_orderkey", F.lit(dict(done.dtypes)["near"]).alias("near_type"), F.lit(dict(done.dtypes)["far"]).alias("far_type"), F.col("near").cast("string").alias("near"), F.col("far").cast("string").alias("far"))


def _without_copies(s: SparkSession, d: str) -> DataFrame:
    df = _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("l_copy"), "l_partkey")
    pairs = relationships.duplicate_paths(value_histogram(df, "lineitem")).where("kind = 'duplicate'").orderBy("place")
    return casts.drop_duplicate_columns(df, [(r["column_a"], r["column_b"]) for r in pairs.collect()])[0]


def _reference_rules(s: SparkSession, d: str) -> DataFrame:
    """Rules that the found relationships ask for, with their checks."""
    tables = _tables(s, d)
    paths = [r.asDict() for r in relationships.merged_paths(_vh(s, d), s, COLUMNS).where("reported").orderBy("place").collect()]
    out = []
    for t, df in tables.items():
        rules = generate.renumber(generate.reference_rules(t, paths, []))
        checks = {r["rule_id"]: r["violations"] for r in rule_summary(df, rules, tables=tables).collect()}
        out += [(t, r.type, r.column, f"{r.params['parent_table']}.{r.params['parent_column']}" if r.params else "", checks[r.rule_id]) for r in rules]
    return s.createDataFrame(out, "table string, type string, column string, parent string, violations long")


def _reference_sql() -> str:
    ends = "SELECT child own, parent other, place, interpretation itp FROM y WHERE interpretation IN ('foreign_key', 'one_to_one_key') UNION ALL SELECT parent, child, place, interpretation FROM y WHERE interpretation = 'one_to_one_key'"
    broken = " ".join(f"WHEN own = '{t}.{c}' AND other = '{u}.{e}' THEN (SELECT count(*) FROM {t} WHERE {c} IS NOT NULL AND CAST({c} AS VARCHAR) NOT IN (SELECT CAST({e} AS VARCHAR) FROM {u}))" for t, c in COLUMNS for u, e in COLUMNS if t != u and c == e == "customer_id")
    repeats = " ".join(f"WHEN own = '{t}.{c}' THEN (SELECT coalesce(sum(n), 0) FROM (SELECT count(*) n FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} HAVING count(*) > 1))" for t, c in COLUMNS if c == "customer_id")
    return f"""{_merged_sql()}, xe AS ({ends}), oe AS (SELECT own, arg_min(other, place) other FROM xe GROUP BY 1),
    re AS (SELECT own, 'referential_cross_table' AS type, other AS parent, CAST(CASE {broken} END AS BIGINT) AS violations FROM oe UNION ALL SELECT DISTINCT own, 'uniqueness', '', CAST(CASE {repeats} END AS BIGINT) FROM xe WHERE itp = 'one_to_one_key')
    SELECT split_part(own, '.', 1) AS "table", type, split_part(own, '.', 2) AS "column", parent, violations FROM re"""


def _sentinel_rules(s: SparkSession, d: str) -> DataFrame:
    df = _t(s, d, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, F.lit(99999.0)).otherwise(F.col("value")).alias("value"), F.col("value").alias("plain"))
    bounds = {c: (f.lower, f.upper) for c, f in detectors.fences(df, ["value", "plain"]).items()}
    rules = generate.renumber(generate.sentinel_rules(df, bounds, []))
    checks = {r["rule_id"]: r["violations"] for r in rule_summary(df, rules).collect()}
    return s.createDataFrame([(r.type, r.column, ", ".join(f"{x:g}" for x in r.params["numbers"]), checks[r.rule_id]) for r in rules], "type string, column string, numbers string, violations long")


def _coercible(s: SparkSession, d: str) -> DataFrame:
    """Format advice on columns: a telephone number in two spellings, a code in two lengths, names."""
    df = _t(s, d, "customer").select(
        F.expr("CASE WHEN c_custkey % 4 = 0 THEN concat('(', 100 + c_custkey % 900, ') 555-', 1000 + c_custkey % 9000) ELSE concat(100 + c_custkey % 900, '-555-', 1000 + c_custkey % 9000) END").alias("phone"),
        F.expr("CASE WHEN c_custkey % 3 = 0 THEN '12' ELSE '345' END").alias("code"), F.lower("c_mktsegment").alias("segment"),
    )
    shapes: dict[str, list[tuple[str, float]]] = {}
    for r in profile.fingerprints(value_histogram(df, "customer")).orderBy("column", "rank").collect():
        shapes.setdefault(r["column"], []).append((r["fingerprint"], round(100 * r["share"], 1)))
    rows = [(c, bool(a["is_coercible"]), a.get("target_format"), facts.uniformity(x)) for c, x in shapes.items() for a in [facts.coercibility(x)]]
    return s.createDataFrame(rows, "column string, is_coercible boolean, target_format string, uniformity double")


def catalog() -> dict[str, tuple[Query, str | None]]:
    fx = _dirty_sql()
    long = " UNION ALL ".join(f"SELECT '{c}' c, CAST({c} AS VARCHAR) v FROM fx" for c in SHOWN)
    value = f"v IS NOT NULL AND trim(v) <> '' AND lower(v) NOT IN ({TOKENS})"
    quartiles = "f AS (SELECT count(*) n, quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3, quantile_cont(value, 0.001) lo, quantile_cont(value, 0.999) hi, avg(value) m, stddev_samp(value) sd, skewness(value) sk FROM events)"
    fences = "g AS (SELECT quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3, CASE WHEN count(value) < 100 THEN 1.5 ELSE 2.0 END m FROM t), o AS (SELECT value FROM t, g WHERE value > q3 + m * (q3 - q1)), w AS (SELECT value, count(*) / (SELECT count(*) FROM o) s FROM o GROUP BY 1)"
    return {
        "a4_extremes": (
            _extremes,
            f"""{fx}, l AS ({long}), v AS (SELECT * FROM l WHERE {value}) SELECT 'fx' AS "table", c AS "column", min(v) AS min_text, max(v) AS max_text, min(TRY_CAST(v AS DOUBLE)) AS min_number, max(TRY_CAST(v AS DOUBLE)) AS max_number, min(length(v)) AS min_length, max(length(v)) AS max_length,
            round(avg(CAST(TRY_CAST(v AS DOUBLE) IS NOT NULL AS DOUBLE)), 6) AS numeric_share, round(count(DISTINCT v) / count(*), 6) AS uniqueness FROM v GROUP BY 2""",
        ),
        "a7_quantiles": (
            lambda s, d: profile.quantile_table(_t(s, d, "lineitem"), MEASURED, SHARES).withColumn("value", F.round("value", 4)),
            " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({q} AS DOUBLE) AS share, round(quantile_cont({c}, {q}), 4) AS value FROM lineitem" for c in MEASURED for q in SHARES),
        ),
        "a19_uniformity": (
            lambda s, d: profile.uniformity(value_histogram(_dirty(s, d).select("email", "code", "start"), "fx")).withColumn("uniformity", F.round("uniformity", 6)),
            f"""{fx}, l AS (SELECT 'email' c, email v FROM fx UNION ALL SELECT 'code', code FROM fx UNION ALL SELECT 'start', start FROM fx), p AS (SELECT c, regexp_replace(regexp_replace(v, '\\p{{L}}', 'a', 'g'), '\\p{{Nd}}', 'X', 'g') f, count(*) n FROM l WHERE {value} GROUP BY 1, 2)
            SELECT 'fx' AS "table", c AS "column", round(max(n) / sum(n), 6) AS uniformity FROM p GROUP BY 2""",
        ),
        "m6_numeric_outliers": (
            lambda s, d: detectors.numeric_outliers(_t(s, d, "events"), "value").withColumn("value", F.round("value", 6)),
            f"WITH {quartiles} SELECT DISTINCT round(value, 6) AS value FROM events, f WHERE CASE WHEN abs(sk) > 1 OR n < 100 THEN value > hi + 2 * (q3 - q1) OR value < lo - 2 * (q3 - q1) ELSE abs(value - m) > 3 * sd END",
        ),
        "m7_m8_coercibility": (
            _coercible,
            "SELECT 'phone' AS \"column\", true AS is_coercible, 'XXX-XXX-XXXX' AS target_format, round(round(100.0 * count(*) FILTER (c_custkey % 4 <> 0) / count(*), 1) / 100, 4) AS uniformity FROM customer UNION ALL SELECT 'code', false, NULL, round(round(100.0 * count(*) FILTER (c_custkey % 3 <> 0) / count(*), 1) / 100, 4) FROM customer UNION ALL SELECT 'segment', false, NULL, (SELECT round(round(100.0 * max(n) / sum(n), 1) / 100, 4) FROM (SELECT count(*) n FROM customer GROUP BY length(c_mktsegment)))",
        ),
        "p1_p4_clean": (
            _clean,
            "SELECT o_orderkey AS o_key, o_orderstatus AS a_b, o_orderpriority AS a_b_1, '{\"a\":' || o_orderkey || ',\"m\":' || CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE 'null' END || ',\"z\":\"' || o_orderpriority || '\"}' AS n_est FROM orders",
        ),
        "p9_dates_in_bounds": (_dates, "SELECT o_orderkey, 'date' AS near_type, CASE WHEN (SELECT count(*) FROM orders WHERE o_orderkey % 100 = 0) > 0 THEN 'string' ELSE 'date' END AS far_type, strftime(o_orderdate, '%Y-%m-%d') AS near, CASE WHEN o_orderkey % 100 = 0 THEN '2900-01-01' ELSE '2001-02-03' END AS far FROM orders"),
        "p16_without_copies": (_without_copies, "SELECT l_linenumber, l_copy, l_partkey FROM (SELECT *, l_orderkey AS l_copy FROM lineitem)"),
        "r3_r5_reference_rules": (_reference_rules, _reference_sql()),
        "r8_sentinel_rules": (
            _sentinel_rules,
            f"WITH t AS (SELECT CASE WHEN event_id % 10 = 0 THEN 99999 ELSE value END AS value FROM events), {fences} SELECT 'sentinel_check' AS type, 'value' AS \"column\", '99999' AS numbers, (SELECT count(*) FROM t WHERE value = 99999) AS violations FROM w WHERE s >= 0.8",
        ),
    }
