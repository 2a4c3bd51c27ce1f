"""More named queries with their SQL: similarity of columns, rule candidates, casts, and rules and detectors on a dirty copy of a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark import config as C
from siltmark.operators import casts, detectors, facts, generate, identifier, samples, sketches
from siltmark.operators.histogram import union, value_histogram
from siltmark.operators.rules import Rule, compile_rule, failed_values
from siltmark.plans import pipeline

Query = Callable[[SparkSession, str], DataFrame]
TOKENS = ", ".join(f"'{t}'" for t in C.PLACEHOLDERS)
#: Columns compared by their values and k-grams.
ALIKE = {"customer": ["c_name", "c_mktsegment", "c_nationkey"], "part": ["p_name", "p_brand", "p_type", "p_size"], "orders": ["o_orderpriority"], "nation": ["n_nationkey", "n_name"], "supplier": ["s_nationkey"]}
#: Columns of which one names the rows of each table.
IDENTIFIERS = ALIKE | {"orders": ["o_orderkey", "o_orderpriority"], "documents": ["doc_id", "source", "lang"], "labels": ["quality", "toxic"], "conversations": ["turn", "role", "conv_id"]}
#: A dirty copy of `customer`: each column has values that pass, values that fail, and gaps. Expressions that both engines read alike.
DIRTY = {
    "id": "c_custkey",
    "email": """CASE WHEN c_custkey % 97 = 0 THEN NULL WHEN c_custkey % 89 = 0 THEN 'n/a' WHEN c_custkey % 53 = 0 THEN 'no address' WHEN c_custkey % 41 = 0 THEN 'unknown@mail.com' WHEN c_custkey % 37 = 0 THEN concat('User', c_custkey, '@Mail.com')
      WHEN c_custkey % 13 = 0 THEN concat('user+', c_custkey, '@shop.org') ELSE concat('user', c_custkey, '@mail.com') END""",
    "code": "CASE WHEN c_custkey % 61 = 0 THEN NULL WHEN c_custkey % 31 = 0 THEN concat(10000 + c_custkey % 90000, '') WHEN c_custkey % 29 = 0 THEN concat(100000 + c_custkey % 900000, '.0') ELSE concat(100000 + (c_custkey * 7919) % 900000, '') END",
    "day": """CASE WHEN c_custkey % 59 = 0 THEN NULL WHEN c_custkey % 61 = 0 THEN '' WHEN c_custkey % 43 = 0 THEN '20230230' WHEN c_custkey % 47 = 0 THEN '2023' WHEN c_custkey % 67 = 0 THEN '20991231'
      ELSE concat(2000 + c_custkey % 24, lpad(concat(1 + c_custkey % 12, ''), 2, '0'), lpad(concat(1 + c_custkey % 28, ''), 2, '0')) END""",
    "start": """CASE WHEN c_custkey % 71 = 0 THEN 'n/a' WHEN c_custkey % 73 = 0 THEN '2023-13-01' WHEN c_custkey % 7 = 0 THEN concat('March ', 1 + c_custkey % 28, ', 2023') WHEN c_custkey % 5 = 0 THEN concat('2023/', lpad(concat(1 + c_custkey % 12, ''), 2, '0'), '/15')
      ELSE concat('2023-', lpad(concat(1 + c_custkey % 12, ''), 2, '0'), '-', lpad(concat(1 + c_custkey % 28, ''), 2, '0')) END""",
    "stop": "CASE WHEN c_custkey % 79 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN '2023-02-20' ELSE concat('2024-', lpad(concat(1 + c_custkey % 12, ''), 2, '0'), '-05') END",
    "joined": "CASE WHEN c_custkey % 83 = 0 THEN 'soon' ELSE concat('20', lpad(concat(c_custkey % 24, ''), 2, '0'), '-', lpad(concat(1 + c_custkey % 12, ''), 2, '0'), '-', lpad(concat(1 + c_custkey % 28, ''), 2, '0')) END",
    "flag": "CASE WHEN c_custkey % 23 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'Yes' ELSE 'no' END",
    "amount": "CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 101 = 0 THEN 'x' WHEN c_custkey % 17 = 0 THEN 'n/a' WHEN c_custkey % 11 = 0 THEN '99999' WHEN c_custkey % 29 = 0 THEN '-3' ELSE concat(c_custkey % 90, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '.5' END) END",
    "nric": "CASE WHEN c_custkey % 31 = 0 THEN NULL WHEN c_custkey % 37 = 0 THEN 'bad' ELSE concat(CASE WHEN c_custkey % 10 < 2 THEN 'T' ELSE 'S' END, lpad(concat(c_custkey % 100, ''), 2, '0'), lpad(concat(c_custkey % 100000, ''), 5, '0'), 'A') END",
    "dob": "CASE WHEN c_custkey % 41 = 0 THEN NULL WHEN c_custkey % 43 = 0 THEN '' ELSE concat(CASE WHEN c_custkey % 10 < 2 THEN '20' ELSE '19' END, lpad(concat(c_custkey % 100, ''), 2, '0'), '-02-03') END",
    "phone": "CASE WHEN c_custkey % 47 = 0 THEN NULL WHEN c_custkey % 53 = 0 THEN '' WHEN c_custkey % 59 = 0 THEN '123' WHEN c_custkey % 7 = 0 THEN concat('+65 ', 91000000 + c_custkey) WHEN c_custkey % 5 = 0 THEN concat('65', 91000000 + c_custkey, 'x') ELSE concat('+65', 81000000 + c_custkey) END",
    "num": "CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN '3.5' WHEN c_custkey % 13 = 0 THEN '-2' ELSE concat(c_custkey % 100, '') END",
    "age": "CASE WHEN c_custkey % 37 = 0 THEN 7 ELSE 18 + c_custkey % 60 END",
    "city": "CASE WHEN c_custkey % 97 = 0 THEN 'New Springfields' WHEN c_custkey % 89 = 0 THEN 'New-Springfield' WHEN c_custkey % 3 = 0 THEN 'New Springfield' WHEN c_custkey % 3 = 1 THEN 'Ostbrunn' ELSE 'Varda' END",
    "batch": "concat('b', c_custkey % 60)",
    "account_id": "concat('A', CASE WHEN c_custkey % 149 = 0 THEN c_custkey - 1 ELSE c_custkey END)",
    "price": "concat(c_custkey % 700, '.00')",
    "member": "CASE WHEN c_custkey % 10 = 3 THEN 'y' ELSE 'N' END",
}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _dirty(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").select(*[F.expr(e).alias(c) for c, e in DIRTY.items()])


def _dirty_sql() -> str:
    return f"WITH fx AS (SELECT {', '.join(f'{e} AS {c}' for c, e in DIRTY.items())} FROM customer)"


def _vh(spark: SparkSession, d: str, columns: dict[str, list[str]]) -> DataFrame:
    return union([value_histogram(_t(spark, d, t), t, cs) for t, cs in columns.items()])


def _rows_sql(columns: dict[str, list[str]]) -> str:
    return " UNION ALL ".join(f'SELECT \'{t}\' AS "table", \'{c}\' AS "column", CAST({c} AS VARCHAR) AS value FROM {t} WHERE {c} IS NOT NULL' for t, cs in columns.items() for c in cs)


RANKED_SQL = f"""WITH r AS ({_rows_sql(IDENTIFIERS)}), u AS (SELECT "table", "column", round(count(DISTINCT value) / count(*), 6) AS uniqueness, round(avg(length(value)), 6) AS avg_len FROM r GROUP BY 1, 2),
    k AS (SELECT *, CAST(CASE WHEN list_has_any(string_split_regex(lower("column"), '[^a-z0-9]+'), ['id', 'key', 'identifier', 'uuid', 'ssn']) THEN 100 WHEN regexp_matches(replace("column", '_', ''), '(id|key|identifier|uuid|ssn|socsec)$') THEN 90
      WHEN regexp_matches(replace("column", '_', ''), '(no|number)$|serial') THEN 70 WHEN replace("column", '_', '') IN ('sn', 'seq') THEN 60 ELSE 0 END AS BIGINT) AS rank FROM u)"""


def _alike_sql(k: int) -> str:
    value = f"v AS (SELECT DISTINCT \"table\" t, \"column\" c, trim(regexp_replace(regexp_replace(lower(value), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) x FROM r), w AS (SELECT * FROM v WHERE x <> '' AND x NOT IN ({TOKENS}))"
    tokens = f"g AS (SELECT DISTINCT t, c, substr(x, CAST(i AS BIGINT), {k}) x FROM (SELECT *, unnest(range(1, greatest(length(x) - {k - 1}, 1) + 1)) i FROM w))" if k else "g AS (SELECT * FROM w)"
    return f"""WITH r AS ({_rows_sql(ALIKE)}), {value}, {tokens}, n AS (SELECT t, c, count(*) n FROM g GROUP BY 1, 2),
    b AS (SELECT a.t ta, a.c ca, b.t tb, b.c cb, count(*) s FROM g a JOIN g b ON a.x = b.x AND (a.t < b.t OR (a.t = b.t AND a.c < b.c)) GROUP BY 1, 2, 3, 4)
    SELECT ta AS table_a, ca AS column_a, tb AS table_b, cb AS column_b, s AS shared, round(s / (p.n + q.n - s), 6) AS jaccard FROM b JOIN n p ON p.t = ta AND p.c = ca JOIN n q ON q.t = tb AND q.c = cb"""


def _rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def _rule(rule: Rule) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = _dirty(spark, d)
        return df.select("id", compile_rule(df, rule).alias("_bad")).where("_bad").select("id")

    return run


FULL = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def full_run(spark: SparkSession, d: str) -> DataFrame:
    """Rules that the offline provider and the data ask for, with their violations."""
    found = pipeline.run_tables(spark, {t: _t(spark, d, t) for t in FULL}, columnar=True)
    by = {(t, r.rule_id): r for t, rules in found.rules.items() for r in rules}
    rows = [(t, s["rule_id"], by[t, s["rule_id"]].type, by[t, s["rule_id"]].column, s["violations"], s["rate"]) for t, ss in found.summaries.items() for s in ss]
    return spark.createDataFrame(rows, "table string, rule_id string, type string, column string, violations long, rate double")


def catalog() -> dict[str, tuple[Query, str | None]]:
    fx = _dirty_sql()
    dirty_vh = lambda s, d, *cs: value_histogram(_dirty(s, d), "fx", list(cs))
    longs = lambda df, *cs: df.withColumns({c: F.col(c).cast("long") for c in cs})
    nan = f"(email IS NOT NULL AND lower(email) NOT IN ({TOKENS}))"
    sizes = "n AS (SELECT \"table\", \"column\", count(*) n, count(DISTINCT value) d, avg(length(value)) l, avg(CAST(regexp_matches(value, '^[0-9]+$') AS DOUBLE)) g FROM r GROUP BY 1, 2)"
    ids = "regexp_matches(\"column\", '(^|[^a-z0-9])(id|key|identifier|uuid|ssn)($|[^a-z0-9])')"
    near = {"documents": ["lang", "source", "text"], "pages": ["url"], "part": ["p_name", "p_brand"]}
    codes = {"part": ["p_size", "p_partkey"], "orders": ["o_orderkey"], "customer": ["c_custkey", "c_name"], "nation": ["n_nationkey"]}
    parsed = "coalesce({f})"
    day = lambda c: parsed.format(f=", ".join(f"try_strptime({c}, '{f}')" for f in ("%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d", "%B %d, %Y", "%d/%m/%Y", "%Y%m%d")))
    born = "(CASE WHEN nric[1] = 'T' OR CAST(substr(nric, 2, 2) AS INT) <= year(current_date) % 100 THEN 2000 ELSE 1900 END + CAST(substr(nric, 2, 2) AS INT))"
    out: dict[str, tuple[Query, str | None]] = {
        "h2_exact_resemblance": (lambda s, d: _rounded(sketches.resemblance(sketches.value_tokens(_vh(s, d, ALIKE))), 6, "jaccard"), _alike_sql(0)),
        "h3_shingle_resemblance": (lambda s, d: _rounded(sketches.resemblance(sketches.shingle_tokens(_vh(s, d, ALIKE))), 6, "jaccard"), _alike_sql(3)),
        "h2_sketch_estimate": (lambda s, d: sketches.sketch_resemblance(sketches.minhash(sketches.value_tokens(_vh(s, d, ALIKE)))), None),
        "j8_similar_columns": (
            lambda s, d: _rounded(sketches.similar_columns(value_histogram(_t(s, d, "customer").select("c_mktsegment", F.lower("c_mktsegment").alias("segment"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("some")), "customer")), 6, "exact", "shingle").drop("shingle"),
            "WITH n AS (SELECT count(DISTINCT c_mktsegment) n, count(DISTINCT c_mktsegment) FILTER (c_mktsegment <> 'BUILDING') m FROM customer) SELECT 'customer' AS table_a, a AS column_a, 'customer' AS table_b, b AS column_b, 'categorical' AS kind_a, 'categorical' AS kind_b, round(CASE WHEN b = 'segment' THEN 1.0 ELSE m / n END, 6) AS exact FROM n, (VALUES ('c_mktsegment', 'segment'), ('c_mktsegment', 'some'), ('segment', 'some')) v(a, b)",
        ),
        "p14_column_kinds": (
            lambda s, d: longs(sketches.column_kinds(_vh(s, d, {"customer": ["c_name", "c_mktsegment"], "part": ["p_name", "p_type"], "pages": ["url"], "documents": ["text"]})), "n_distinct"),
            f"""WITH r AS ({_rows_sql({"customer": ["c_name", "c_mktsegment"], "part": ["p_name", "p_type"], "pages": ["url"], "documents": ["text"]})}), s AS (SELECT "table", "column", regexp_replace(value, '^\\s+|\\s+$', '', 'g') AS value FROM r),
            {sizes.replace("FROM r", "FROM s WHERE value <> ''")} SELECT "table", "column", 'string' AS storage_type, CASE WHEN l > 80 THEN 'free_text' WHEN {ids} THEN 'key_like' WHEN d <= 20 OR d / n < 0.2 THEN 'categorical' WHEN d / n < 0.98 THEN 'discrete_code' ELSE 'other' END AS kind, d AS n_distinct FROM n""",
        ),
        "r6_uniqueness_candidates": (
            lambda s, d: _rounded(generate.uniqueness_candidates(_vh(s, d, near)), 6, "ratio"),
            f'WITH r AS ({_rows_sql(near)}), n AS (SELECT "table", "column", count(DISTINCT value) / count(*) q FROM r GROUP BY 1, 2) SELECT "table", "column", round(q, 6) AS ratio FROM n WHERE q >= 0.9 AND q < 1',
        ),
        "r7_code_formats": (
            lambda s, d: _rounded(longs(generate.code_formats(_vh(s, d, codes)), "digits"), 6, "share"),
            f"""WITH r AS ({_rows_sql(codes)}), l AS (SELECT "table", "column", length(value) k, count(*) c, bool_and(regexp_matches(value, '^[0-9]+$')) g FROM r GROUP BY 1, 2, 3), s AS (SELECT *, c / sum(c) OVER (PARTITION BY "table", "column") q FROM l)
            SELECT "table", "column", k AS digits, round(q, 6) AS share FROM s WHERE g AND q >= 0.5""",
        ),
        "w3_identifier_candidates": (
            lambda s, d: _rounded(longs(identifier.identifier_candidates(_vh(s, d, IDENTIFIERS)), "rank"), 6, "uniqueness", "avg_len"),
            f"""{RANKED_SQL} SELECT "table", "column", uniqueness, avg_len, rank FROM k""",
        ),
        "t5_record_identifiers": (
            lambda s, d: identifier.record_identifiers(_vh(s, d, IDENTIFIERS)),
            f"""{RANKED_SQL} SELECT "table", "column" FROM (SELECT *, row_number() OVER (PARTITION BY "table" ORDER BY rank DESC, uniqueness DESC, avg_len, "column") AS place FROM k WHERE rank > 0 OR uniqueness >= 0.9) WHERE place = 1""",
        ),
        "m5_suspicious_values": (
            lambda s, d: facts.suspicious_values(_vh(s, d, {"orders": ["o_orderkey"]})),
            "SELECT 'orders' AS \"table\", 'o_orderkey' AS \"column\", CAST(o_orderkey AS VARCHAR) AS value, count(*) AS cnt FROM orders WHERE regexp_matches(CAST(o_orderkey AS VARCHAR), '^(0{3,}|1{3,}|9{3,})$') GROUP BY 3",
        ),
        "e2_f10_sample_values": (
            lambda s, d: facts.sample_values(dirty_vh(s, d, "email", "num", "city")),
            f"""{fx}, r AS (SELECT 'email' AS "column", email AS value FROM fx UNION ALL SELECT 'num', num FROM fx UNION ALL SELECT 'city', city FROM fx), v AS (SELECT DISTINCT * FROM r WHERE value IS NOT NULL AND lower(value) NOT IN ({TOKENS}) AND ("column" <> 'email' OR regexp_matches(value, '^[^@\\s]+@[^@\\s]+$')))
            SELECT 'fx' AS "table", "column", value FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY md5(value), value) AS k FROM v) WHERE k <= 5""",
        ),
        "p17_row_slice": (
            lambda s, d: casts.row_slice(casts.with_row_id(_t(s, d, "orders").select("o_orderkey"), ["o_orderkey"]), 100, 50),
            "SELECT o_orderkey, i AS _row_id FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i BETWEEN 100 AND 149",
        ),
        "p6_auto_cast": (
            lambda s, d: casts.auto_cast(_dirty(s, d).select("id", "num", "flag"), "fx", casts.decide(dirty_vh(s, d, "num", "flag")), upper=True),
            f"{fx} SELECT id, TRY_CAST(num AS DOUBLE) AS num, upper(flag) AS flag FROM fx",
        ),
        "d3_non_numeric": (lambda s, d: detectors.non_numeric(value_histogram(_t(s, d, "events").select(F.when(F.col("event_id") % 100 == 7, "bad").otherwise(F.col("event_id").cast("string")).alias("v")), "events")), "SELECT 'events' AS \"table\", 'v' AS \"column\", 'bad' AS value, count(*) AS cnt FROM events WHERE event_id % 100 = 7 HAVING count(*) > 0"),
        "d4_d8_email": (
            lambda s, d: longs(detectors.email_issues(dirty_vh(s, d, "email")), "malformed", "mixed_case", "placeholder_local", "plus_tag", "n_domains"),
            f"""{fx} SELECT 'fx' AS "table", 'email' AS "column", count(*) FILTER (NOT regexp_matches(email, '^[^@\\s]+@[^@\\s]+$')) AS malformed, count(*) FILTER (email <> lower(email)) AS mixed_case, count(*) FILTER (split_part(lower(email), '@', 1) IN ({TOKENS})) AS placeholder_local,
            count(*) FILTER (contains(email, '+')) AS plus_tag, count(DISTINCT CASE WHEN contains(email, '@') THEN split_part(lower(email), '@', 2) END) AS n_domains FROM fx WHERE {nan}""",
        ),
        "d7_domain_concentration": (lambda s, d: _rounded(detectors.domain_concentration(value_histogram(_dirty(s, d).where("id % 5 = 0").select("email").union(_dirty(s, d).select("email")), "fx")), 6, "share"), f"{fx}, e AS (SELECT email FROM fx WHERE id % 5 = 0 UNION ALL SELECT email FROM fx), h AS (SELECT split_part(lower(email), '@', 2) AS domain, count(*) c FROM e WHERE contains(email, '@') GROUP BY 1), q AS (SELECT domain, c / sum(c) OVER () AS share, count(*) OVER () n FROM h) SELECT 'fx' AS \"table\", 'email' AS \"column\", domain, round(share, 6) AS share FROM q WHERE share > 0.8 AND n > 1"),
        "d10_d11_codes": (
            lambda s, d: _rounded(longs(detectors.code_issues(dirty_vh(s, d, "code")), "dominant_length", "shorter"), 6, "decimal_share", "digit_share"),
            f"""{fx}, v AS (SELECT code, regexp_replace(code, '\\.0+$', '') k FROM fx WHERE code IS NOT NULL), l AS (SELECT length(k) n, count(*) c FROM v GROUP BY 1), t AS (SELECT n FROM l ORDER BY c DESC, n DESC LIMIT 1)
            SELECT 'fx' AS "table", 'code' AS "column", round(avg(CAST(regexp_matches(code, '^\\d+\\.0+$') AS DOUBLE)), 6) AS decimal_share, round(avg(CAST(regexp_matches(k, '^\\d+$') AS DOUBLE)), 6) AS digit_share, max(t.n) AS dominant_length, count(*) FILTER (length(k) < t.n) AS shorter FROM v, t""",
        ),
        "d12_d14_dates": (
            lambda s, d: _rounded(longs(detectors.date_issues(dirty_vh(s, d, "start", "day")), "unparseable"), 6, "compact_share", "iso_share"),
            f"""{fx}, v AS (SELECT 'start' AS "column", start AS v FROM fx UNION ALL SELECT 'day', day FROM fx) SELECT 'fx' AS "table", "column", round(avg(CAST(regexp_matches(v, '^\\d{{8}}(\\.0+)?$') AS DOUBLE)), 6) AS compact_share, round(avg(CAST(regexp_matches(v, '^\\d{{4}}-\\d{{2}}-\\d{{2}}') AS DOUBLE)), 6) AS iso_share,
            count(*) FILTER ({day("v")} IS NULL) AS unparseable FROM v WHERE v <> '' AND lower(v) NOT IN ({TOKENS}) GROUP BY 2""",
        ),
        "d15_under_age": (lambda s, d: detectors.under_age(_t(s, d, "part").select("p_partkey", F.col("p_size").alias("age")), "age"), "SELECT p_partkey, p_size AS age FROM part WHERE p_size < 13"),
        "d18_booleans": (lambda s, d: detectors.boolean_spellings(dirty_vh(s, d, "flag", "code")), f"{fx} SELECT 'fx' AS \"table\", 'flag' AS \"column\", min(lower(flag)) AS lo, max(lower(flag)) AS hi FROM fx WHERE flag IS NOT NULL HAVING count(DISTINCT lower(flag)) = 2"),
        "w5_failed_values": (
            lambda s, d: failed_values(_dirty(s, d), [Rule("1", "not_null", "email"), Rule("2", "date_ordering", "start", {"col_a": "start", "col_b": "stop"}), Rule("3", "range", "amount", {"min": 0})], ["id"]),
            f"{fx} SELECT id, '1' AS rule_id, 'email' AS \"column\", email AS value FROM fx WHERE email IS NULL UNION ALL SELECT id, '2', 'stop', stop FROM fx WHERE {day('start')} > {day('stop')} UNION ALL SELECT id, '3', 'amount', amount FROM fx WHERE TRY_CAST(amount AS DOUBLE) < 0",
        ),
        "j18_stratified_sample": (
            lambda s, d: samples.stratified_sample(_t(s, d, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice") > 450000, "o_orderkey", 40),
            """WITH b AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 450000 ORDER BY o_orderkey LIMIT 20), g AS (SELECT o_orderkey, o_totalprice FROM orders WHERE NOT o_totalprice > 450000 ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 40)
            SELECT o_orderkey, o_totalprice FROM (SELECT *, 0 AS s, '' AS h FROM b UNION ALL SELECT *, 1, md5('42:' || o_orderkey) FROM g) ORDER BY s, h, o_orderkey LIMIT 40""",
        ),
        "x1_full_run": (full_run, None),
    }
    text = lambda c: f"({c} IS NOT NULL AND trim({c}) <> '')"
    valid = "regexp_matches(nric, '^[STFG][0-9]{7}[A-Z]$')"
    rules = {
        "v4_date_ordering": (Rule("a", "date_ordering", "", {"col_a": "start", "col_b": "stop"}), f"{day('start')} > {day('stop')}"),
        "v6_valid_yyyymmdd": (Rule("a", "valid_yyyymmdd_date", "day"), f"{text('day')} AND (NOT regexp_matches(day, '^[0-9]{{8}}$') OR try_strptime(day, '%Y%m%d') IS NULL)"),
        "v8_integer_parseable": (Rule("a", "integer_parseable", "num"), f"{text('num')} AND (TRY_CAST(num AS DOUBLE) IS NULL OR TRY_CAST(num AS DOUBLE) <> floor(TRY_CAST(num AS DOUBLE)))"),
        "v9_datetime_parseable": (Rule("a", "datetime_parseable", "start"), f"{text('start')} AND {day('start')} IS NULL"),
        "v10_date_not_future": (Rule("a", "date_not_future", "day", {"cutoff": "2024-01-01"}), f"{day('day')} > TIMESTAMP '2024-01-01'"),
        "v12_sentinel": (Rule("a", "sentinel_check", "amount", {"numbers": [99999], "strings": ["x"]}), "amount = 'x' OR TRY_CAST(amount AS DOUBLE) = 99999"),
        "v16_phone": (Rule("a", "phone_validity", "phone", {"country_code": 65}), f"{text('phone')} AND NOT regexp_full_match(phone, '\\+?65[ -]?[0-9]{{8}}')"),
        "v17_nric_age": (Rule("a", "nric_age_consistency", "nric", {"col_b": "amount"}), f"CASE WHEN {valid} THEN abs(year(current_date) - {born} - TRY_CAST(amount AS DOUBLE)) > 2 END"),
        "v18_nric_dob": (Rule("a", "nric_dob_consistency", "nric", {"col_b": "dob", "check_mode": "dob"}), f"CASE WHEN {valid} THEN year({day('dob')}) <> {born} END"),
    }
    for name, (rule, where) in rules.items():
        out[name] = (_rule(rule), f"{fx} SELECT id FROM fx WHERE {where}")
    sums = Rule("a", "numeric_sum", "", {"col_a": "a", "col_b": "b", "col_sum": "c"})

    def numeric_sum(s: SparkSession, d: str) -> DataFrame:
        df = _t(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"), F.col("l_tax").alias("b"), F.when(F.col("l_linenumber") < 4, F.col("l_quantity") + F.col("l_tax")).otherwise(2 * F.col("l_quantity")).alias("c"))
        return df.select("l_orderkey", "l_linenumber", compile_rule(df, sums).alias("_bad")).where("_bad").drop("_bad")

    out["v3_numeric_sum"] = (
        numeric_sum,
        "WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity a, l_tax b, CASE WHEN l_linenumber < 4 THEN l_quantity + l_tax ELSE 2 * l_quantity END c FROM lineitem) SELECT l_orderkey, l_linenumber FROM t, (SELECT avg(abs(c)) m FROM t WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL) WHERE abs(a + b - c) > 0.01 * m",
    )
    return out
