"""Named queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark import config as C
from siltmark.operators import detectors as D
from siltmark.operators import profile as P
from siltmark.operators import relations as R
from siltmark.operators.histogram import union, value_histogram
from siltmark.operators.rules import Rule, masks, referential, rule_summary, rule_totals, sibling_lookup, violation_records
from siltmark.plans import columns, dated, extra, files, isolated, parts, paths

Query = Callable[[SparkSession, str], DataFrame]
KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"], "supplier": ["s_suppkey", "s_nationkey"],
    "part": ["p_partkey", "p_size"], "orders": ["o_orderkey", "o_custkey"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"], "labels": ["doc_id"], "documents": ["doc_id"],
}
TEXTS = {"customer": ["c_name", "c_mktsegment"], "part": ["p_name", "p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"]}
TOKENS = ", ".join(f"'{t}'" for t in C.PLACEHOLDERS)
RULES = [
    Rule("r1", "range", "o_totalprice", {"min": 1000, "max": 400000}, "a price in range"),
    Rule("r2", "enumeration", "o_orderstatus", {"values": ["F", "O"]}),
    Rule("r3", "format", "o_orderpriority", {"regex": r"\d-[A-Z ]+$"}),
    Rule("r4", "not_null", "o_custkey"),
    Rule("r5", "custom", "o_totalprice", {"logic": "row['o_totalprice'] > 300000 and row['o_orderstatus'] == 'O'"}),
]
RULE_SQL = {
    "r1": "(o_totalprice < 1000 OR o_totalprice > 400000)", "r2": "o_orderstatus NOT IN ('F', 'O')", "r3": "NOT regexp_matches(o_orderpriority, '^[0-9]-[A-Z ]+$')",
    "r4": "o_custkey IS NULL", "r5": "(o_totalprice > 300000 AND o_orderstatus = 'O')",
}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


SHOWN = {"r1": "o_totalprice", "r2": "o_orderstatus", "r3": "o_orderpriority", "r4": "o_custkey", "r5": "o_totalprice"}
FAILED_SQL = f"""WITH m0 AS (SELECT o_orderkey, list_filter([{", ".join(f"CASE WHEN {q} THEN {{'id': '{r.rule_id}', 'label': '#{r.rule_id}: {r.text}', 'c': '{SHOWN[r.rule_id]}', 'v': coalesce(CAST({SHOWN[r.rule_id]} AS VARCHAR), '—')}} END" for r, q in zip(RULES, RULE_SQL.values(), strict=True))}], lambda x: x IS NOT NULL) l FROM orders),
    m AS (SELECT *, list_filter(list_transform(l, lambda x, i: CASE WHEN list_position(list_transform(l, lambda y: y.c || '=' || y.v), x.c || '=' || x.v) = i THEN {{'c': x.c, 'v': x.v}} END), lambda x: x IS NOT NULL) p FROM m0)"""


def _vh(spark: SparkSession, d: str, columns: dict[str, list[str]]) -> DataFrame:
    return union([value_histogram(_t(spark, d, t), t, cs) for t, cs in columns.items()])


def _sql_vh(columns: dict[str, list[str]]) -> str:
    return " UNION ALL ".join(f'SELECT \'{t}\' AS "table", \'{c}\' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS cnt FROM {t} GROUP BY 3' for t, cs in columns.items() for c in cs)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys and one-to-one keys."""
    vh = union([value_histogram(_t(spark, sf_dir, t), t, cs, keys=True) for t, cs in KEYS.items()])
    found = R.join_paths(vh, spark, [(t, c) for t, cs in KEYS.items() for c in cs], keyed=True)
    return found.select("child", "parent", "interpretation", F.col("overlap").cast("long").alias("overlap"), F.round("coverage_a", 6).alias("coverage_a"), F.round("coverage_b", 6).alias("coverage_b"), F.round("jaccard", 6).alias("jaccard"), F.round("quality", 3).alias("quality"))


def _names_sql(columns: list[tuple[str, str]]) -> str:
    """Names of columns, and the pairs of them that may be compared with their scores, in DuckDB's own terms."""
    quoted = lambda words: ", ".join(f"'{w}'" for w in words)
    any_of = lambda c, words: "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"
    score = """CASE WHEN {p}.f = {c}.f AND {p}.i THEN 1.0 WHEN {p}.i AND ({c}.st = {p}.e OR {c}.st = {p}.st) THEN 0.95 WHEN {c}.i AND {p}.e <> '' AND contains({c}.st, {p}.e) THEN 0.9
      WHEN {p}.e = {c}.e AND ({p}.h OR {c}.h) THEN 0.95 WHEN {p}.pe AND {c}.w THEN 0.85 ELSE 0.0 END"""
    return f"""names(n, t, c) AS (VALUES {", ".join(f"({i}, '{t}', '{c}')" for i, (t, c) in enumerate(columns))}),
    fl AS (SELECT *, regexp_replace(lower(c), '[^a-z0-9]', '', 'g') f, regexp_replace(lower(t), '[^a-z0-9]', '', 'g') ft FROM names),
    nm AS (SELECT *, CASE WHEN ft LIKE '%s' AND length(ft) > 3 THEN ft[:-2] ELSE ft END e, CASE WHEN f LIKE '_%identifier' THEN f[:-11] WHEN f LIKE '_%id' THEN f[:-3] WHEN f LIKE '_%key' THEN f[:-4] ELSE f END st,
      f LIKE '%id' OR f LIKE '%key' OR f LIKE '%identifier%' OR f IN ({quoted(C.OWNER_NAMES)}) OR list_has_any(string_split_regex(lower(c), '[^a-z0-9]+'), [{quoted(C.ID_TOKENS)}]) i,
      regexp_replace(f, '^({"|".join(C.DESCRIPTIVE_PREFIXES)})+(.)', '\\2') ba, {any_of("f", C.HIERARCHY_TERMS)} h, {any_of("f", C.ASSIGNMENT_KEYS)} w FROM fl),
    nn AS (SELECT *, e IN ({quoted(C.ASSIGNMENT_PARENTS)}) pe, ba IN ({quoted(C.DESCRIPTIVE_TERMS)}) de FROM nm),
    pp AS (SELECT a.t ta, a.c ca, b.t tb, b.c cb, {score.format(p="a", c="b")} sa, {score.format(p="b", c="a")} sb, a.i ia, b.i ib, a.ba = b.ba AND a.de sh, a.f = b.f same, a.f fa, b.f fb, a.e = b.e AND (a.h OR b.h) hier FROM nn a JOIN nn b ON a.n < b.n),
    p AS (SELECT * FROM pp WHERE CASE WHEN ta = tb THEN hier ELSE same OR (fa = 'id' AND ib) OR (fb = 'id' AND ia) OR sh OR greatest(sa, sb) >= 0.65 END)"""


def _flagship_sql() -> str:
    columns = [(t, c) for t, cs in KEYS.items() for c in cs]
    return f"""
    WITH vh AS ({_sql_vh(KEYS)}), v AS (SELECT "table" t, "column" c, value k, cnt FROM vh WHERE value IS NOT NULL), {_names_sql(columns)},
    s AS (SELECT t, c, count(*) d, sum(cnt) n FROM v GROUP BY 1, 2),
    o AS (SELECT p.*, x.overlap, a.d da, b.d db, x.overlap / a.d cova, x.overlap / b.d covb, a.d / a.n ua, b.d / b.n ub FROM p
      JOIN (SELECT v1.t ta, v1.c ca, v2.t tb, v2.c cb, count(*) overlap FROM v v1 JOIN v v2 ON v1.k = v2.k GROUP BY 1, 2, 3, 4) x USING (ta, ca, tb, cb)
      JOIN s a ON a.t = ta AND a.c = ca JOIN s b ON b.t = tb AND b.c = cb WHERE a.d >= 2 AND b.d >= 2),
    q AS (SELECT *, 0.25 * greatest(cova, covb) + 0.25 * abs(cova - covb) + 0.2 * greatest(ua, ub) + 0.15 * (1 - least(da, db) / greatest(da, db)) + 0.15 / (1 + exp(-0.005 * (overlap - 1000))) sc,
      ua >= 0.95 AND covb >= 0.95 AND sa >= 0.75 AND ia toa, ub >= 0.95 AND cova >= 0.95 AND sb >= 0.75 AND ib tob,
      ua >= 0.95 AND ub >= 0.95 AND cova >= 0.95 AND covb >= 0.95 AND (same OR (ia AND ib AND greatest(sa, sb) >= 0.75)) one FROM o),
    r AS (SELECT *, CASE WHEN sh THEN 'shared_value_domain' WHEN one THEN 'one_to_one_key' WHEN toa OR tob THEN 'foreign_key' END interpretation FROM q)
    SELECT CASE WHEN interpretation = 'foreign_key' AND toa THEN tb || '.' || cb ELSE ta || '.' || ca END AS child, CASE WHEN interpretation = 'foreign_key' AND toa THEN ta || '.' || ca ELSE tb || '.' || cb END AS parent,
      interpretation, CAST(overlap AS BIGINT) AS overlap, round(cova, 6) AS coverage_a, round(covb, 6) AS coverage_b, round(overlap / (da + db - overlap), 6) AS jaccard,
      round(round(CASE WHEN least(cova, covb) >= 0.9 OR (greatest(cova, covb) >= 0.99 AND least(cova, covb) >= 0.7) THEN greatest(sc, 0.65) ELSE sc END, 4), 3) AS quality
    FROM r WHERE interpretation IN ('foreign_key', 'one_to_one_key') OR (interpretation = 'shared_value_domain' AND greatest(cova, covb) >= 0.9)"""


def _rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def _longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def _numeric(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(P.numeric_summary(_t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]), 4, "min", "max", "q1", "q3", "mean", "std", "skew")


def _numeric_sql() -> str:
    one = "SELECT '{c}' AS \"column\", count({c}) AS n, round(min({c}), 4) AS min, round(max({c}), 4) AS max, round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.75), 4) AS q3, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(skewness({c}), 4) AS skew FROM lineitem"
    return " UNION ALL ".join(one.format(c=c) for c in ("l_quantity", "l_extendedprice", "l_discount"))


VALUE = f"value IS NOT NULL AND regexp_replace(value, '^\\s+|\\s+$', '', 'g') <> '' AND lower(regexp_replace(value, '^\\s+|\\s+$', '', 'g')) NOT IN ({TOKENS})"
VH = f'WITH vh AS ({_sql_vh(TEXTS)}), v AS (SELECT * FROM vh WHERE {VALUE})'
FENCES = "f AS (SELECT count(*) n, quantile_cont(x, 0.25) q1, quantile_cont(x, 0.75) q3 FROM t), g AS (SELECT *, CASE WHEN n < 100 THEN 1.5 ELSE 2.0 END m FROM f WHERE n >= 10 AND q3 > q1)"


def _rule(rule: Rule, table: str, keys: list[str]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        marked = masks(_t(spark, d, table), [rule])[0]
        return marked.where(F.col(f"_v_{rule.rule_id}")).select(*keys)

    return run


def _catalog() -> dict[str, tuple[Query, str | None]]:
    text = lambda s, d: _vh(s, d, TEXTS)
    order = ["o_orderkey"]
    out: dict[str, tuple[Query, str | None]] = {
        "j12_fk_relationships": (flagship, _flagship_sql()),
        "a1_missing_profile": (
            lambda s, d: _longs(P.missing_profile(text(s, d)), "n_total", "n_null", "n_placeholder", "missing_count"),
            f"""WITH vh AS ({_sql_vh(TEXTS)}), m AS (SELECT *, lower(regexp_replace(value, '^\\s+|\\s+$', '', 'g')) s FROM vh) SELECT "table", "column", CAST(sum(cnt) AS BIGINT) AS n_total, CAST(coalesce(sum(cnt) FILTER (value IS NULL), 0) AS BIGINT) AS n_null,
            CAST(coalesce(sum(cnt) FILTER (s IN ({TOKENS})), 0) AS BIGINT) AS n_placeholder, CAST(coalesce(sum(cnt) FILTER (value IS NULL OR s IN ({TOKENS})), 0) AS BIGINT) AS missing_count, count(*) FILTER ({VALUE}) AS n_distinct FROM m GROUP BY 1, 2""",
        ),
        "a3_numeric_summary": (_numeric, _numeric_sql()),
        "a5_top_values": (
            lambda s, d: P.top_values(text(s, d)).select("table", "column", "value", "cnt", F.col("rank").cast("long").alias("rank")),
            f'{VH}, r AS (SELECT *, row_number() OVER (PARTITION BY "table", "column" ORDER BY cnt DESC, value) AS rank FROM v) SELECT "table", "column", value, cnt, rank FROM r WHERE rank <= 20',
        ),
        "a9_length_distribution": (
            lambda s, d: _rounded(_longs(P.length_distribution(text(s, d)), "length", "cnt"), 6, "share"),
            f'{VH}, l AS (SELECT "table", "column", length(value) AS length, CAST(sum(cnt) AS BIGINT) AS cnt FROM v GROUP BY 1, 2, 3) SELECT "table", "column", length, cnt, round(cnt / sum(cnt) OVER (PARTITION BY "table", "column"), 6) AS share FROM l',
        ),
        "a10_length_summary": (
            lambda s, d: _rounded(P.length_summary(text(s, d)), 6, "avg_length", "p95_length"),
            f'{VH} SELECT "table", "column", round(avg(length(value)), 6) AS avg_length, round(quantile_cont(length(value), 0.95), 6) AS p95_length FROM (SELECT *, unnest(range(cnt)) FROM v) v GROUP BY 1, 2',
        ),
        "e3_permissible_values": (lambda s, d: P.permissible_values(text(s, d)), f'{VH} SELECT "table", "column", value FROM v QUALIFY count(*) OVER (PARTITION BY "table", "column") <= 50'),
        "m3_fingerprints": (
            lambda s, d: _rounded(_longs(P.fingerprints(text(s, d)), "cnt", "rank"), 6, "share").withColumn("examples", F.concat_ws(" | ", "examples")),
            f"""{VH}, f AS (SELECT "table", "column", regexp_replace(regexp_replace(value, '\\p{{L}}', 'a', 'g'), '\\p{{Nd}}', 'X', 'g') AS fingerprint, CAST(sum(cnt) AS BIGINT) AS cnt, array_to_string(list_sort(list(value))[1:3], ' | ') AS examples FROM v GROUP BY 1, 2, 3),
            r AS (SELECT *, round(cnt / sum(cnt) OVER (PARTITION BY "table", "column"), 6) AS share, row_number() OVER (PARTITION BY "table", "column" ORDER BY cnt DESC, fingerprint) AS rank FROM f) SELECT * FROM r WHERE rank <= 10""",
        ),
        "m2_known_patterns": (
            lambda s, d: _longs(P.known_patterns(value_histogram(_t(s, d, "pages"), "pages", ["url"])), "cnt"),
            "SELECT 'pages' AS \"table\", 'url' AS \"column\", 'url' AS pattern, count(*) AS cnt FROM pages WHERE regexp_matches(url, '^(?:^https?://[^\\s]+$)', 'i') HAVING count(*) > 0",
        ),
        "p12_column_types": (lambda s, d: P.column_types(text(s, d)), f'{VH} SELECT "table", "column", \'string\' AS storage_type, count(*) AS n_distinct FROM v GROUP BY 1, 2'),
        "d9_candidate_keys": (
            lambda s, d: _rounded(_longs(P.candidate_keys(_vh(s, d, KEYS)), "n"), 6, "uniqueness"),
            f'WITH vh AS ({_sql_vh(KEYS)}) SELECT "table", "column", count(*) AS n_distinct, CAST(sum(cnt) AS BIGINT) AS n, round(count(*) / sum(cnt), 6) AS uniqueness, count(*) / sum(cnt) >= 0.95 AS is_key FROM vh WHERE value IS NOT NULL GROUP BY 1, 2',
        ),
        "d16_iqr_fences": (
            lambda s, d: _rounded(D.iqr_fences(_t(s, d, "lineitem"), "l_extendedprice"), 4, "q1", "q3", "lower_fence", "upper_fence"),
            f"WITH t AS (SELECT l_extendedprice x FROM lineitem), {FENCES} SELECT 'l_extendedprice' AS \"column\", n, round(q1, 4) AS q1, round(q3, 4) AS q3, round(q1 - m * (q3 - q1), 4) AS lower_fence, round(q3 + m * (q3 - q1), 4) AS upper_fence FROM g",
        ),
        "d16_outliers": (
            lambda s, d: D.iqr_outliers(_t(s, d, "events"), "value", ["event_id"]).select("event_id", "side"),
            f"WITH t AS (SELECT event_id, value x FROM events WHERE value IS NOT NULL), {FENCES} SELECT event_id, CASE WHEN x > q3 + m * (q3 - q1) THEN 'high' ELSE 'low' END AS side FROM t, g WHERE x > q3 + m * (q3 - q1) OR x < q1 - m * (q3 - q1)",
        ),
        "d21_sign_anomaly": (
            lambda s, d: _rounded(_longs(D.sign_anomalies(_t(s, d, "customer"), "c_acctbal"), "n_odd"), 6, "positive", "negative"),
            "WITH a AS (SELECT avg(CAST(c_acctbal > 0 AS DOUBLE)) p, avg(CAST(c_acctbal < 0 AS DOUBLE)) q, count(*) FILTER (c_acctbal > 0) np, count(*) FILTER (c_acctbal < 0) nn FROM customer) SELECT 'c_acctbal' AS \"column\", round(p, 6) AS positive, round(q, 6) AS negative, CAST(CASE WHEN p > 0.95 AND nn > 0 THEN nn WHEN q > 0.95 AND np > 0 THEN np ELSE 0 END AS BIGINT) AS n_odd FROM a",
        ),
        "d20_sentinels": (
            lambda s, d: _rounded(D.sentinels(_t(s, d, "events"), "value"), 6, "value", "share"),
            f"WITH t AS (SELECT value x FROM events WHERE value IS NOT NULL), {FENCES}, o AS (SELECT x, CASE WHEN x > q3 + m * (q3 - q1) THEN 'high' ELSE 'low' END side FROM t, g WHERE x > q3 + m * (q3 - q1) OR x < q1 - m * (q3 - q1)), c AS (SELECT side, x AS value, count(*) AS cnt FROM o GROUP BY 1, 2), s AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY side) AS share FROM c) SELECT side, round(value, 6) AS value, cnt, round(share, 6) AS share FROM s WHERE share >= 0.8",
        ),
        "d20_sentinels_coded": (
            lambda s, d: _rounded(D.sentinels(_t(s, d, "events").select(F.when(F.col("event_id") % 10 == 0, F.lit(99999.0)).otherwise(F.col("value")).alias("value")), "value"), 6, "value", "share"),
            f"WITH t AS (SELECT CASE WHEN event_id % 10 = 0 THEN 99999 ELSE value END x FROM events), {FENCES}, o AS (SELECT x, CASE WHEN x > q3 + m * (q3 - q1) THEN 'high' ELSE 'low' END side FROM t, g WHERE x > q3 + m * (q3 - q1) OR x < q1 - m * (q3 - q1)), c AS (SELECT side, x AS value, count(*) AS cnt FROM o GROUP BY 1, 2), s AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY side) AS share FROM c) SELECT side, round(value, 6) AS value, cnt, round(share, 6) AS share FROM s WHERE share >= 0.8",
        ),
        "d17_contaminated": (lambda s, d: _longs(D.contaminated(text(s, d)), "n"), f'{VH} SELECT "table", "column", count(*) AS n_distinct, CAST(sum(cnt) AS BIGINT) AS n FROM v GROUP BY 1, 2 HAVING count(*) > 50 AND count(*) / sum(cnt) < 0.05'),
        "d19_near_duplicates_long": (
            lambda s, d: _rounded(D.near_duplicate_values(value_histogram(_t(s, d, "part").select(F.concat(F.lit("spare part of the kind "), "p_type", F.lit(" "), "p_size").alias("kind")), "part")), 6, "jaccard"),
            f"""WITH vh AS (SELECT 'part' AS "table", 'kind' AS "column", 'spare part of the kind ' || p_type || ' ' || p_size AS value, count(*) AS cnt FROM part GROUP BY 3), v AS (SELECT "table", "column", value FROM vh WHERE {VALUE}), w AS (SELECT * FROM v WHERE ("table", "column") IN (SELECT ("table", "column") FROM v GROUP BY "table", "column" HAVING count(*) BETWEEN 2 AND 2000)),
            g AS (SELECT DISTINCT "table", "column", value, substr(value, CAST(i AS BIGINT), 3) gram FROM (SELECT *, unnest(range(1, greatest(length(value) - 2, 1) + 1)) i FROM w)), n AS (SELECT "table", "column", value, count(*) k FROM g GROUP BY 1, 2, 3),
            b AS (SELECT x."table", x."column", x.value value_a, y.value value_b, count(*) s FROM g x JOIN g y ON x."table" = y."table" AND x."column" = y."column" AND x.gram = y.gram AND x.value < y.value GROUP BY 1, 2, 3, 4)
            SELECT b."table", b."column", value_a, value_b, round(s / (p.k + q.k - s), 6) AS jaccard FROM b JOIN n p ON p."table" = b."table" AND p."column" = b."column" AND p.value = value_a JOIN n q ON q."table" = b."table" AND q."column" = b."column" AND q.value = value_b WHERE s / (p.k + q.k - s) >= 0.88""",
        ),
        "d19_near_duplicates": (
            lambda s, d: _rounded(D.near_duplicate_values(value_histogram(_t(s, d, "part"), "part", ["p_brand", "p_type"])), 6, "jaccard"),
            f"""WITH vh AS ({_sql_vh({"part": ["p_brand", "p_type"]})}), v AS (SELECT "table", "column", value FROM vh WHERE {VALUE}), w AS (SELECT * FROM v WHERE ("table", "column") IN (SELECT ("table", "column") FROM v GROUP BY "table", "column" HAVING count(*) BETWEEN 2 AND 2000)),
            g AS (SELECT DISTINCT "table", "column", value, substr(value, CAST(i AS BIGINT), 3) gram FROM (SELECT *, unnest(range(1, greatest(length(value) - 2, 1) + 1)) i FROM w)), n AS (SELECT "table", "column", value, count(*) k FROM g GROUP BY 1, 2, 3),
            b AS (SELECT x."table", x."column", x.value value_a, y.value value_b, count(*) s FROM g x JOIN g y ON x."table" = y."table" AND x."column" = y."column" AND x.gram = y.gram AND x.value < y.value GROUP BY 1, 2, 3, 4)
            SELECT b."table", b."column", value_a, value_b, round(s / (p.k + q.k - s), 6) AS jaccard FROM b JOIN n p ON p."table" = b."table" AND p."column" = b."column" AND p.value = value_a JOIN n q ON q."table" = b."table" AND q."column" = b."column" AND q.value = value_b WHERE s / (p.k + q.k - s) >= 0.88""",
        ),
        "v11_referential": (
            lambda s, d: referential(_t(s, d, "orders"), "o_custkey", _t(s, d, "customer"), "c_custkey").select("o_orderkey"),
            "SELECT o_orderkey FROM orders WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)",
        ),
        "v11_referential_orphans": (
            lambda s, d: referential(_t(s, d, "orders"), "o_custkey", _t(s, d, "customer").where("c_custkey % 3 <> 0"), "c_custkey").select("o_orderkey"),
            "SELECT o_orderkey FROM orders WHERE o_custkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 3 <> 0)",
        ),
        "v15_uniqueness": (_rule(Rule("u", "uniqueness", "l_orderkey"), "lineitem", ["l_orderkey", "l_linenumber"]), "SELECT l_orderkey, l_linenumber FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) c FROM lineitem) WHERE c > 1"),
        "v19_custom_expr": (
            _rule(Rule("x", "custom", "l_discount", {"logic": "row['l_discount'] > 0.05 and row['l_quantity'] * 2 >= 80 and row['l_returnflag'] not in ['A', 'N']"}), "lineitem", ["l_orderkey", "l_linenumber"]),
            "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0.05 AND l_quantity * 2 >= 80 AND l_returnflag NOT IN ('A', 'N')",
        ),
        "v20_sibling_lookup": (
            lambda s, d: sibling_lookup(_t(s, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", _t(s, d, "nation"), "n_nationkey", ["n_name"]).select("c_custkey", "c_nationkey", "n_name"),
            "SELECT c_custkey, c_nationkey, n_name FROM customer LEFT JOIN (SELECT n_nationkey k, min(n_name) n_name FROM nation GROUP BY 1 HAVING count(*) = 1) ON k = c_nationkey",
        ),
        "w4_rule_summary": (
            lambda s, d: rule_summary(_t(s, d, "orders"), RULES),
            " UNION ALL ".join(f"SELECT '{k}' AS rule_id, count(*) FILTER ({q}) AS violations, round(count(*) FILTER ({q}) / count(*), 3) AS rate FROM orders" for k, q in RULE_SQL.items()),
        ),
        "w6_violation_records": (
            lambda s, d: violation_records(_t(s, d, "orders"), RULES, order),
            f"""{FAILED_SQL} SELECT o_orderkey, array_to_string(list_transform(l, lambda x: x.id), ' | ') AS rules, CAST(len(l) AS BIGINT) AS n_rules, array_to_string(list_transform(p, lambda x: x.c), ', ') AS failed_columns,
            array_to_string(list_transform(p, lambda x: x.v), ' | ') AS failed_values, array_to_string(list_transform(l, lambda x: x.label), ' | ') AS labels FROM m WHERE len(l) > 0""",
        ),
        "a17_rule_totals": (
            lambda s, d: rule_totals(_t(s, d, "orders"), RULES),
            f"SELECT count(*) AS n_rows, CAST({len(RULES)} AS BIGINT) AS n_rules, CAST({' + '.join(f'CAST(coalesce(bool_or({q}), false) AS INT)' for q in RULE_SQL.values())} AS BIGINT) AS rules_violated, count(*) FILTER ({' OR '.join(f'coalesce({q}, false)' for q in RULE_SQL.values())}) AS failing_rows FROM orders",
        ),
        "v19_modulo": (
            _rule(Rule("x", "custom", "c_nationkey", {"logic": "(row['c_nationkey'] - 12) % 5 == 3 and (row['c_nationkey'] - 12) % -7 < -2"}), "customer", ["c_custkey"]),
            "WITH t AS (SELECT c_custkey, c_nationkey - 12 AS k FROM customer) SELECT c_custkey FROM t WHERE ((k % 5) + 5) % 5 = 3 AND -(((-k % 7) + 7) % 7) < -2",
        ),
        "v19_gaps": (
            lambda s, d: masks(_t(s, d, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("kind")), [Rule("a", "custom", "kind", {"logic": "row['kind'] != 'click' and not row['value'] > 50"})])[0].where("_v_a").select("event_id"),
            "SELECT event_id FROM events WHERE coalesce(CASE WHEN event_id % 5 <> 0 THEN event_type END <> 'click', true) AND NOT coalesce(CASE WHEN event_id % 7 <> 0 THEN value END > 50, false)",
        ),
        "j9_duplicate_columns": (
            lambda s, d: _rounded(R.duplicate_columns(value_histogram(_t(s, d, "lineitem").select("l_orderkey", F.col("l_orderkey").alias("l_copy"), "l_partkey"), "lineitem")), 6, "jaccard"),
            "WITH t AS (SELECT DISTINCT l_orderkey k FROM lineitem), n AS (SELECT count(*) d FROM t) SELECT 'lineitem' AS \"table\", 'l_copy' AS column_a, 'l_orderkey' AS column_b, 1.0::DOUBLE AS jaccard, 'duplicate' AS kind FROM n WHERE d > 20",
        ),
        "s3_json_flatten": (lambda s, d: _t(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")), "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"),
    }
    for name, (rule, table, keys, where) in {
        "v1_format": (Rule("a", "format", "o_orderpriority", {"regex": r"[1-3]-[A-Z ]+$"}), "orders", order, "NOT regexp_matches(o_orderpriority, '^[1-3]-[A-Z ]+$')"),
        "v2_enumeration": (Rule("a", "enumeration", "c_mktsegment", {"values": ["BUILDING", "MACHINERY"]}), "customer", ["c_custkey"], "c_mktsegment NOT IN ('BUILDING', 'MACHINERY')"),
        "v5_null_consistency": (Rule("a", "null_consistency", "", {"col_a": "event_id", "col_b": "value"}), "events", ["event_id"], "event_id IS NOT NULL AND value IS NULL"),
        "v7_numeric_parseable": (Rule("a", "numeric_parseable", "event_type"), "events", ["event_id"], "event_type <> '' AND TRY_CAST(event_type AS DOUBLE) IS NULL"),
        "v13_not_null": (Rule("a", "not_null", "value"), "events", ["event_id"], "value IS NULL"),
        "v14_range": (Rule("a", "range", "l_quantity", {"min": 5, "max": 45}), "lineitem", ["l_orderkey", "l_linenumber"], "l_quantity < 5 OR l_quantity > 45"),
    }.items():
        out[name] = (_rule(rule, table, keys), f"SELECT {', '.join(keys)} FROM {table} WHERE {where}")
    gaps = lambda s, d: _t(s, d, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))
    for name, rule in (("v5_null_consistency_gaps", Rule("a", "null_consistency", "", {"col_a": "event_id", "col_b": "value"})), ("v13_not_null_gaps", Rule("a", "not_null", "value"))):
        out[name] = (lambda s, d, rule=rule: masks(gaps(s, d), [rule])[0].where("_v_a").select("event_id"), "SELECT event_id FROM events WHERE event_id % 7 = 0 OR value IS NULL")
    return out | extra.catalog() | columns.catalog() | paths.catalog() | files.catalog() | parts.catalog() | isolated.catalog() | dated.catalog()


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in _catalog().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _catalog().items() if s}
