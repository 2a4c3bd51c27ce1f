"""Named queries on relationships for a report, with their SQL, over three tables that are made of `customer` and `orders`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark import config as C
from siltmark.operators import inspection, profile, relationships
from siltmark.operators.histogram import union, value_histogram
from siltmark.plans.columns import WHOLE, _errors_sql, _long_sql
from siltmark.plans.extra import DIRTY, _dirty, _dirty_sql, _t

Query = Callable[[SparkSession, str], DataFrame]
TOKENS = ", ".join(f"'{t}'" for t in C.PLACEHOLDERS)
#: (source, column, expression that both engines read) of each table.
TABLES = {
    "customers": ("customer", {"customer_id": "c_custkey", "segment": "c_mktsegment", "city": "concat('City ', c_nationkey)", "alias": "concat('n', c_custkey % 400)", "nickname": "concat('n', c_custkey % 360)"}),
    "purchases": ("orders", {"purchase_id": "o_orderkey", "customer_id": "o_custkey", "priority": "o_orderpriority"}),
    "leads": ("customer", {"lead_key": "c_custkey + 500", "segment": "lower(c_mktsegment)", "billing_city": "concat('City ', c_nationkey % 24)", "customer_id": "c_custkey"}),
}
COLUMNS = [(t, c) for t, (_, cs) in TABLES.items() for c in cs]


def _tables(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return {t: _t(s, d, source).select(*[F.expr(e).alias(c) for c, e in cs.items()]) for t, (source, cs) in TABLES.items()}


def _vh(s: SparkSession, d: str) -> DataFrame:
    return union([value_histogram(df, t) for t, df in _tables(s, d).items()])


def _merged(s: SparkSession, d: str) -> DataFrame:
    return relationships.merged_paths(_vh(s, d), s, COLUMNS)


def _tables_sql() -> str:
    ctes = ", ".join(f"{t} AS (SELECT {', '.join(f'{e} AS {c}' for c, e in cs.items())} FROM {source})" for t, (source, cs) in TABLES.items())
    values = " UNION ALL ".join(f"SELECT '{t}' t, '{c}' c, CAST({c} AS VARCHAR) k, count(*) cnt FROM {t} GROUP BY 3" for t, c in COLUMNS)
    return f"{ctes}, v AS ({values})"


def _merged_sql() -> str:
    from siltmark.plans.registry import _names_sql

    return f"""WITH {_tables_sql()}, {_names_sql(COLUMNS)},
    s AS (SELECT t, c, count(*) d, sum(cnt) n, bool_and(TRY_CAST(k AS DOUBLE) IS NOT NULL) num, min(TRY_CAST(k AS DOUBLE)) lo, max(TRY_CAST(k AS DOUBLE)) hi, avg(length(k)) l FROM v GROUP BY 1, 2),
    kd AS (SELECT *, num AND lo = 1 AND hi = d ord, CASE WHEN regexp_matches(c, '(^|_)(id|key)($|_)') THEN 'key_like' WHEN NOT num AND (d <= 20 OR d / n < 0.2) THEN 'categorical' WHEN d / n < 0.98 THEN 'discrete_code' ELSE 'other' END kind FROM s),
    o AS (SELECT p.*, x.overlap, a.d da, b.d db, x.overlap / a.d cova, x.overlap / b.d covb, a.d / a.n ua, b.d / b.n ub, a.ord oa, b.ord ob FROM p
      JOIN (SELECT v1.t ta, v1.c ca, v2.t tb, v2.c cb, count(*) overlap FROM v v1 JOIN v v2 ON v1.k = v2.k GROUP BY 1, 2, 3, 4) x USING (ta, ca, tb, cb)
      JOIN kd a ON a.t = ta AND a.c = ca JOIN kd b ON b.t = tb AND b.c = cb WHERE a.d >= 2 AND b.d >= 2),
    q AS (SELECT *, 0.25 * greatest(cova, covb) + 0.25 * abs(cova - covb) + 0.2 * greatest(ua, ub) + 0.15 * (1 - least(da, db) / greatest(da, db)) + 0.15 / (1 + exp(-0.005 * (overlap - 1000))) sc,
      ua >= 0.95 AND covb >= 0.95 AND sa >= 0.75 AND ia toa, ub >= 0.95 AND cova >= 0.95 AND sb >= 0.75 AND ib tob,
      ua >= 0.95 AND ub >= 0.95 AND cova >= 0.95 AND covb >= 0.95 AND (same OR (ia AND ib AND greatest(sa, sb) >= 0.75)) one FROM o),
    r AS (SELECT *, CASE WHEN sh THEN 'shared_value_domain' WHEN ta <> tb AND oa AND ob AND NOT ia AND NOT ib THEN 'unreported_ordinal_domain' WHEN one THEN 'one_to_one_key' WHEN toa OR tob THEN 'foreign_key'
      WHEN ia AND ib AND greatest(cova, covb) >= 0.95 THEN 'unreported_shared_id_domain' ELSE 'many_to_many_or_lookup' END itp,
      round(CASE WHEN least(cova, covb) >= 0.9 OR (greatest(cova, covb) >= 0.99 AND least(cova, covb) >= 0.7) THEN greatest(sc, 0.65) ELSE sc END, 4) ql FROM q),
    tk AS (SELECT DISTINCT t, c, trim(regexp_replace(regexp_replace(lower(k), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) x FROM v), w AS (SELECT * FROM tk JOIN kd USING (t, c) WHERE x <> '' AND x NOT IN ({TOKENS}) AND (kind = 'key_like' OR (NOT num AND kind IN ('categorical', 'discrete_code')) OR (num AND d <= 2000))),
    gr AS (SELECT DISTINCT t, c, kind, num, substr(x, CAST(i AS BIGINT), 3) x FROM (SELECT *, unnest(range(1, greatest(length(x) - 2, 1) + 1)) i FROM w)),
    al AS (SELECT ta, ca, tb, cb, coalesce(e.j, 0) ex, coalesce(g.j, 0) sh3 FROM (SELECT a.t ta, a.c ca, b.t tb, b.c cb, count(*) / ((SELECT count(*) FROM w z WHERE z.t = a.t AND z.c = a.c) + (SELECT count(*) FROM w z WHERE z.t = b.t AND z.c = b.c) - count(*)) j
        FROM w a JOIN w b ON a.x = b.x AND a.t <> b.t GROUP BY 1, 2, 3, 4) e FULL JOIN (SELECT a.t ta, a.c ca, b.t tb, b.c cb, count(*) / ((SELECT count(*) FROM gr z WHERE z.t = a.t AND z.c = a.c) + (SELECT count(*) FROM gr z WHERE z.t = b.t AND z.c = b.c) - count(*)) j
        FROM gr a JOIN gr b ON a.x = b.x AND a.t <> b.t GROUP BY 1, 2, 3, 4) g USING (ta, ca, tb, cb)),
    am AS (SELECT al.* FROM al JOIN kd a ON a.t = ta AND a.c = ca JOIN kd b ON b.t = tb AND b.c = cb WHERE (ex >= 0.5 OR sh3 >= 0.6) AND a.num = b.num AND (NOT a.num OR (a.kind = 'key_like' AND b.kind = 'key_like'))),
    u AS (SELECT r.*, CASE WHEN itp IN ('foreign_key', 'one_to_one_key') OR (itp = 'shared_value_domain' AND greatest(cova, covb) >= 0.9) THEN 'coverage' ELSE 'similar' END mt, ex, sh3, CASE WHEN itp = 'foreign_key' AND toa THEN tb || '.' || cb ELSE ta || '.' || ca END child,
      CASE WHEN itp = 'foreign_key' AND toa THEN ta || '.' || ca ELSE tb || '.' || cb END parent FROM r LEFT JOIN am USING (ta, ca, tb, cb)
      UNION ALL BY NAME SELECT am.*, 'many_to_many_or_lookup' itp, 0.0 ql, 0 overlap, 0.0 cova, 0.0 covb, 1 da, 1 db, 'similar' mt, ta || '.' || ca child, tb || '.' || cb parent FROM am SEMI JOIN p USING (ta, ca, tb, cb) ANTI JOIN r USING (ta, ca, tb, cb)),
    z AS (SELECT *, CASE WHEN mt = 'coverage' THEN overlap / (da + db - overlap) ELSE ex END rs FROM u WHERE mt = 'coverage' OR ex IS NOT NULL),
    y AS (SELECT child, parent, itp interpretation, mt AS method, overlap, cova, covb, ql quality, rs resemblance, sh3, row_number() OVER (ORDER BY CASE itp WHEN 'foreign_key' THEN 0 WHEN 'one_to_one_key' THEN 1 ELSE CASE mt WHEN 'coverage' THEN 2 ELSE 3 END END,
      CASE WHEN itp IN ('foreign_key', 'one_to_one_key') OR mt = 'coverage' THEN -ql ELSE -rs END, CASE WHEN itp IN ('foreign_key', 'one_to_one_key') OR mt = 'coverage' THEN -greatest(cova, covb) ELSE 0 END, child, parent) AS place,
      itp IN ('foreign_key', 'one_to_one_key', 'shared_value_domain') reported, itp NOT IN ('shared_value_domain', 'unreported_ordinal_domain') candidate, ta, ca, tb, cb FROM z)"""


def _shown(s: SparkSession, d: str) -> DataFrame:
    return _merged(s, d).select("child", "parent", "interpretation", "method", F.col("overlap").cast("long").alias("overlap"), F.round("quality", 3).alias("quality"), F.round("resemblance", 6).alias("resemblance"), F.round("resemblance_shingle", 6).alias("resemblance_shingle"), F.col("place").cast("long").alias("place"), "reported", "candidate")


def _duplicates(s: SparkSession, d: str) -> DataFrame:
    return relationships.duplicate_paths(value_histogram(_tables(s, d)["customers"].withColumn("copy", F.col("customer_id")), "customers"))


DUPLICATES_SQL = f"""WITH {_tables_sql()}, w AS (SELECT DISTINCT c, k FROM v WHERE t = 'customers' UNION SELECT 'copy', k FROM v WHERE t = 'customers' AND c = 'customer_id'), n AS (SELECT c, count(*) d FROM w GROUP BY 1),
    j AS (SELECT a.c a, b.c b, count(*) / (p.d + q.d - count(*)) j FROM w a JOIN w b ON a.k = b.k AND a.c < b.c JOIN n p ON p.c = a.c JOIN n q ON q.c = b.c WHERE p.d > 20 OR q.d > 20 GROUP BY 1, 2, p.d, q.d)
    SELECT 'customers' AS "table", a AS column_a, b AS column_b, round(j, 6) AS jaccard, CASE WHEN j >= 0.9 THEN 'duplicate' ELSE 'near_identical' END AS kind, row_number() OVER (ORDER BY j DESC, a, b) AS place FROM j WHERE j >= 0.7"""
PCT = "format('{{:.1f}}%', 100 * ({}))"


def _hints_sql() -> str:
    both = f"{PCT.format('cova')} || ' / ' || {PCT.format('covb')}"
    text = lambda me, other: f"""CASE WHEN interpretation = 'foreign_key' AND {me} = child THEN 'refers to key ' || parent || ', ' || {PCT.format("greatest(cova, covb)")} || ' of its values are there' WHEN interpretation = 'foreign_key' THEN 'key that ' || child || ' refers to, ' || {PCT.format("greatest(cova, covb)")} || ' of the values there are here'
      WHEN interpretation = 'one_to_one_key' THEN 'one-to-one key with ' || {other} || ', coverage ' || {both} WHEN interpretation = 'shared_value_domain' THEN 'same kind of values as ' || {other} || ', coverage ' || {both} || '; no key' ELSE 'values like those of ' || {other} || ', resemblance ' || {PCT.format("resemblance")} END"""  # noqa: E731
    flip = "CASE WHEN (ta, ca) > (tb, cb) THEN {b} ELSE {a} END"
    ordered = f"f AS (SELECT * EXCLUDE (cova, covb), {flip.format(a='cova', b='covb')} cova, {flip.format(a='covb', b='cova')} covb FROM y)"
    side = lambda t, c, o, oc: f"""SELECT {t} AS "table", {c} AS "column", interpretation AS kind, {text(f"{t} || '.' || {c}", f"{o} || '.' || {oc}")} AS hint FROM f"""
    return f"{_merged_sql()}, {ordered} {side('ta', 'ca', 'tb', 'cb')} UNION ALL {side('tb', 'cb', 'ta', 'ca')}"


def _breakdown(s: SparkSession, d: str) -> DataFrame:
    fx = _dirty(s, d)
    vh = value_histogram(fx, "fx")
    declared = inspection.declared_types({"fx": fx})
    return relationships.type_breakdown(inspection.column_types(vh, declared), inspection.column_errors(vh, {("fx", c): k for c, k in WHOLE.items()}, config=C.Config(country_patterns=True), faults=("null", "placeholder", "low_age", "duplicate_key", "unreadable_date")), profile.missing_profile(vh))


def catalog() -> dict[str, tuple[Query, str | None]]:
    merged = _merged_sql()
    rows = [("fx", c, f"CAST({c} AS VARCHAR)", WHOLE.get(c)) for c in DIRTY]
    errors = _errors_sql(_long_sql(rows))
    first = lambda s, d: _vh(s, d)
    base = f"WITH {_tables_sql()}"
    return {
        "j11_merged_paths": (_shown, f"{merged} SELECT child, parent, interpretation, method, overlap, round(quality, 3) AS quality, round(resemblance, 6) AS resemblance, round(sh3, 6) AS resemblance_shingle, place, reported, candidate FROM y"),
        "j15_candidate_paths": (lambda s, d: _shown(s, d).where("candidate").select("child", "parent", "interpretation", "place"), f"{merged} SELECT child, parent, interpretation, place FROM y WHERE candidate"),
        "t1_coverage_order": (
            lambda s, d: relationships.coverage_paths(_vh(s, d), s, COLUMNS).select("child", "parent", F.col("place").cast("long").alias("place")),
            f"{merged} SELECT child, parent, row_number() OVER (ORDER BY CASE interpretation WHEN 'foreign_key' THEN 0 WHEN 'one_to_one_key' THEN 1 ELSE 2 END, -greatest(cova, covb), child, parent) AS place FROM y WHERE method = 'coverage'",
        ),
        "t3_duplicate_order": (lambda s, d: _duplicates(s, d).withColumns({"place": F.col("place").cast("long"), "jaccard": F.round("jaccard", 6)}), DUPLICATES_SQL),
        "j20_join_hints": (lambda s, d: relationships.join_hints(_merged(s, d)), _hints_sql()),
        "j21_roles": (
            lambda s, d: relationships.roles(_merged(s, d)),
            f"""{merged}, e AS (SELECT ta t, ca c, place, CASE WHEN interpretation = 'one_to_one_key' THEN 'join_key' WHEN child = ta || '.' || ca THEN 'foreign_key' ELSE 'primary_key' END r FROM y WHERE interpretation IN ('foreign_key', 'one_to_one_key')
              UNION ALL SELECT tb, cb, place, CASE WHEN interpretation = 'one_to_one_key' THEN 'join_key' WHEN child = tb || '.' || cb THEN 'foreign_key' ELSE 'primary_key' END FROM y WHERE interpretation IN ('foreign_key', 'one_to_one_key')) SELECT t AS "table", c AS "column", arg_max(r, place) AS role FROM e GROUP BY 1, 2""",
        ),
        "j22_errors_without_repeats": (
            lambda s, d: relationships.without_repeats(
                inspection.column_errors(value_histogram(_dirty(s, d), "fx"), {("fx", c): k for c, k in WHOLE.items()}, config=C.Config(country_patterns=True), faults=("duplicate_key", "low_age")),
                s.createDataFrame([("fx.account_id", "other.id", "foreign_key")], "child string, parent string, interpretation string"),
            ).select("table", "column", "fault", F.col("n").cast("long").alias("n")),
            f"""SELECT "table", "column", fault, n FROM ({errors}) WHERE fault IN ('duplicate_key', 'low_age') AND NOT ("column" = 'account_id' AND fault = 'duplicate_key')""",
        ),
        "j23_referenced_keys": (
            lambda s, d: relationships.referenced_keys(_merged(s, d)).withColumn("children", F.concat_ws(", ", "children")),
            f"{merged} SELECT parent AS key, string_agg(DISTINCT child, ', ' ORDER BY child) AS children, count(DISTINCT child) AS n FROM y WHERE interpretation = 'foreign_key' GROUP BY 1",
        ),
        "j23_path_groups": (lambda s, d: relationships.path_groups(_merged(s, d)).withColumn("quality", F.round("quality", 3)), f"{merged} SELECT interpretation AS kind, count(*) AS n, round(avg(quality), 3) AS quality FROM y GROUP BY 1"),
        "j23_unique_columns": (
            lambda s, d: relationships.unique_columns(first(s, d)),
            f"""{base} SELECT t AS "table", c AS "column", CAST(sum(cnt) AS BIGINT) AS n, regexp_matches(c, '(id|key)$') AND contains(replace(c, '_', ''), regexp_replace(t, 's$', '')) AS likely_key FROM v GROUP BY 1, 2 HAVING count(*) = sum(cnt) AND count(*) > 1""",
        ),
        "a15_type_breakdown": (
            _breakdown,
            f"""WITH er AS (SELECT DISTINCT "column" c FROM ({errors}) WHERE fault IN ('null', 'placeholder', 'low_age', 'duplicate_key', 'unreadable_date')), mi AS (SELECT DISTINCT "column" c FROM ({errors}) WHERE fault IN ('null', 'placeholder')),
            ty AS ({{types}}) SELECT 'fx' AS "table", storage_type, count(*) AS n_columns, count(er.c) AS with_errors, count(mi.c) AS with_missing FROM ty LEFT JOIN er ON er.c = ty."column" LEFT JOIN mi ON mi.c = ty."column" GROUP BY 2""".replace("{types}", _types_of_dirty()),
        ),
    }


def _types_of_dirty() -> str:
    from siltmark.plans.columns import _measures_sql

    rows = [("fx", c, f"CAST({c} AS VARCHAR)", WHOLE.get(c)) for c in DIRTY]
    return f'{_dirty_sql()}, {_measures_sql(_long_sql(rows))} SELECT c AS "column", st AS storage_type FROM y'
