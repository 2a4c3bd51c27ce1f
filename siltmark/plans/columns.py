"""Named queries on what columns are meant to hold and what is wrong with them, with their SQL, over a dirty copy of `customer` and the tables themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark import config as C
from siltmark.operators import inspection
from siltmark.operators.histogram import union, value_histogram
from siltmark.plans.extra import DIRTY, _dirty, _dirty_sql, _t

Query = Callable[[SparkSession, str], DataFrame]
TOKENS = ", ".join(f"'{t}'" for t in C.PLACEHOLDERS)
SPELLINGS = ", ".join(f"'{t}'" for t in (*C.TRUE_SPELLINGS, *C.FALSE_SPELLINGS))
CONFIG = C.Config(country_patterns=True)
#: Columns of tables whose types are asked for.
TYPED = {"customer": ["c_custkey", "c_name", "c_acctbal"], "orders": ["o_orderstatus", "o_orderdate", "o_totalprice"], "part": ["p_size", "p_brand"], "events": ["ts", "value", "event_type"], "lineitem": ["l_quantity", "l_discount"]}
WHOLE = {"id": "int64", "age": "int64"}
DATES = ("%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y/%m/%d", "%B %d, %Y", "%d/%m/%Y", "%Y%m%d")
KNOWN = r"^\+\d{1,3}[-.\\s]?\d{1,14}$|^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$|^\d{4}-\d{2}-\d{2}$|^\$\d{1,3}(,\d{3})*(\.\d{2})?$|^https?://[^\s]+$|^[{]?[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}[}]?$|^[689]\d{7}$|^[STFGM]\d{7}[A-Z]$|^\d{6}$"


def _dirty_vh(s: SparkSession, d: str) -> DataFrame:
    return value_histogram(_dirty(s, d), "fx", list(DIRTY))


def _declared(names: dict[str, str]) -> dict[tuple[str, str], str]:
    return {("fx", c): k for c, k in names.items()}


def _long_sql(rows: list[tuple[str, str, str, str | None]]) -> str:
    """Stripped values (t, c, declared type, s, cnt) of (table, column, value, declared type)."""
    one = "SELECT '{t}' t, '{c}' c, {k} k, trim({v}, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') s, count(*) cnt FROM {t} GROUP BY 4"
    return " UNION ALL ".join(one.format(t=t, c=c, v=v, k=f"'{k}'" if k else "CAST(NULL AS VARCHAR)") for t, c, v, k in rows)


def _measures_sql(long: str) -> str:
    day = "coalesce(" + ", ".join(f"try_strptime(s, '{f}')" for f in DATES) + ")"
    total = lambda cond: f"coalesce(sum(cnt) FILTER ({cond}), 0)"
    return f"""v AS ({long}),
    x AS (SELECT *, regexp_replace(s, '\\.0+$', '') code, s IS NOT NULL AND lower(s) IN ({TOKENS}) ph, s IS NOT NULL AND lower(s) NOT IN ({TOKENS}) held, TRY_CAST(s AS DOUBLE) num, {day} d FROM v),
    m AS (SELECT t, c, max(k) k, sum(cnt) n, {total("s IS NULL")} nulls, {total("held")} held, count(*) FILTER (held) dist, {total("num IS NOT NULL")} numbers, {total("held AND num IS NOT NULL")} hnum,
      coalesce(bool_and(num = floor(num)) FILTER (num IS NOT NULL), false) whole, count(DISTINCT lower(s)) FILTER (held) sp, min(lower(s)) FILTER (held) sp1, max(lower(s)) FILTER (held) sp2, coalesce(bool_and(lower(s) IN ({SPELLINGS})) FILTER (held), false) spell,
      count(DISTINCT lower(s)) asp, coalesce(bool_and(lower(s) IN ({SPELLINGS})) FILTER (s IS NOT NULL), false) aspell, {total("d IS NOT NULL")} dates, count(DISTINCT code) codes, {total("regexp_full_match(code, '[0-9]+')")} cdig,
      {total("regexp_full_match(code, '(19|20)[0-9]{6}')")} cday, {total("regexp_full_match(code, '(19|20)[0-9]{12}')")} csec, {total("held AND regexp_full_match(code, '(19|20)[0-9]{6}')")} d8,
      {total("held AND regexp_full_match(s, '[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2})?)?')")} iso, {total("held AND regexp_full_match(s, '[0-9]{8}(\\.0+)?')")} compact, {total("regexp_full_match(s, '[0-9]+\\.0+')")} aart,
      {total("held AND regexp_full_match(s, '[0-9]+\\.0+')")} art, {total("held AND regexp_full_match(s, '[0-9]+\\.[0-9]*[1-9][0-9]*')")} deci, {total("held AND regexp_full_match(s, '[0-9]+(\\.0+)?')")} dig, max(TRY_CAST(code AS DOUBLE)) FILTER (held) greatest,
      {total("held AND contains(s, '+')")} plus, coalesce(sum(cnt * length(s)) FILTER (held), 0) chars, {total(f"regexp_matches(s, '{KNOWN}', 'i')")} known, min(num) lo, max(num) hi, count(DISTINCT num) dnum FROM x GROUP BY 1, 2),
    l AS (SELECT t, c, length(code) len, sum(cnt) cc, {total("held")} hh FROM x WHERE s IS NOT NULL GROUP BY 1, 2, 3),
    lt AS (SELECT t, c, max(cc) acc, arg_max(len, (cc, len)) alen, max(hh) hh, arg_max(len, (hh, len)) len, count(*) FILTER (hh > 0) nlen, max(len) FILTER (hh > 0) longest FROM l GROUP BY 1, 2),
    g AS (SELECT m.*, lt.* EXCLUDE (t, c), n - nulls filled, coalesce(k, CASE WHEN n = nulls THEN 'object' WHEN numbers / n >= 0.95 THEN CASE WHEN whole THEN 'int64' ELSE 'float64' END ELSE 'string' END) st FROM m LEFT JOIN lt USING (t, c)),
    y AS (SELECT *, coalesce(CASE WHEN st IN ('string', 'object') THEN CASE WHEN numbers / n >= 0.9 THEN 'float64' WHEN asp >= 2 AND aspell THEN 'bool' WHEN dates / n >= 0.9 THEN 'datetime64[ns]' END
      WHEN st IN ('int32', 'int64', 'float32', 'float64') AND filled > 0 THEN CASE WHEN greatest(cday, csec) / filled >= 0.8 THEN 'datetime64[ns]' WHEN cdig / filled >= 0.98 AND alen >= 4 AND acc / filled >= 0.9 AND codes / filled >= 0.5 THEN 'string' WHEN st = 'float64' AND aart / filled >= 0.95 THEN 'int64' END END, st) it,
      coalesce(dist / nullif(held, 0), 0) uq, st = 'datetime64[ns]' OR (coalesce(hnum / nullif(held, 0), 0) >= 0.9 AND coalesce(d8 / nullif(held, 0), 0) >= 0.3) OR coalesce(iso / nullif(held, 0), 0) >= 0.8 dl, contains(lower(c), 'email') em,
      lower(c) = 'id' OR lower(c) LIKE '%\\_id' ESCAPE '\\' OR list_has_any(string_split_regex(lower(c), '[^a-z0-9]+'), ['id', 'key', 'identifier', 'uuid', 'ssn', 'soc_sec']) idl,
      dnum >= 2 AND whole AND lo = 1 AND hi = dnum AND NOT regexp_matches(lower(c), 'id|key|code|number|no|num') rk FROM g)"""


def _errors_sql(long: str) -> str:
    faults = {
        "null": "s IS NULL",
        "placeholder": "ph",
        "non_numeric": "st IN ('int32', 'int64', 'float32', 'float64') AND h AND num IS NULL",
        "malformed_email": "em AND h AND s <> '' AND NOT regexp_matches(s, '^[^@\\s]+@[^@\\s]+$')",
        "mixed_case_email": "em AND h AND s <> lower(s)",
        "placeholder_email": f"em AND h AND split_part(lower(s), '@', 1) IN ({TOKENS})",
        "plus_tag": "em AND plus / held >= 0.05 AND h AND contains(s, '+')",
        "duplicate_key": "idl AND uq >= 0.98 AND dist > 20 AND NOT rk AND h AND cnt > 1",
        "decimal_artefact": "art / held >= 0.5 AND deci = 0 AND h AND regexp_matches(s, '^[0-9]+\\.0+$')",
        "code_length": "dig / held >= 0.8 AND hh / held >= 0.9 AND nlen > 1 AND known > 0 AND longest = len AND coalesce(greatest, 0) < pow(10, len) AND h AND length(code) <> len",
        "compact_date": "dl AND compact / held >= 0.3 AND h AND regexp_matches(s, '^[0-9]{8}(\\.0+)?$')",
        "unreadable_date": "dl AND h AND try_strptime(code, '%Y%m%d') IS NULL AND d IS NULL",
        "low_age": "contains(lower(c), 'age') AND st IN ('int64', 'float64') AND h AND num < 13",
        "contaminated": "uq < 0.05 AND dist > 50 AND st IN ('string', 'object') AND it <> 'datetime64[ns]' AND h",
        "boolean_spelling": "sp = 2 AND spell AND NOT (sp1 = 'false' AND sp2 = 'true') AND h",
    }
    hits = ", ".join(f"CASE WHEN {q} THEN '{k}' END" for k, q in faults.items())
    return f"""{_dirty_sql()}, {_measures_sql(long)}, j AS (SELECT x.* EXCLUDE (held, k), x.held h, y.* EXCLUDE (t, c) FROM x JOIN y USING (t, c)),
    e AS (SELECT t, c, s, cnt, n, unnest(list_filter([{hits}], lambda z: z IS NOT NULL)) fault FROM j),
    dm AS (SELECT t, c, regexp_extract(lower(s), '@([^@\\s]+)$', 1) dom, sum(cnt) r, max(n) n FROM j WHERE em AND h GROUP BY 1, 2, 3),
    dt AS (SELECT t, c, sum(r) q, count(*) k FROM dm WHERE dom <> '' GROUP BY 1, 2),
    o AS (SELECT t, c, fault, CAST(sum(cnt) AS BIGINT) rows, max(n) n, list(s ORDER BY s) FILTER (s IS NOT NULL) ex FROM e GROUP BY 1, 2, 3
      UNION ALL SELECT t, c, 'one_domain', CAST(r AS BIGINT), n, [dom] FROM dm JOIN dt USING (t, c) WHERE dom <> '' AND k > 1 AND r > 0.8 * q)
    SELECT t AS "table", c AS "column", fault, rows AS n, round(rows / n, 6) AS share, array_to_string(coalesce(ex, [])[1:5], ' | ') AS examples FROM o"""


def _errors(*faults: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        found = inspection.column_errors(_dirty_vh(s, d), _declared(WHOLE), config=CONFIG, faults=faults)
        return found.withColumns({"n": F.col("n").cast("long"), "share": F.round("share", 6), "examples": F.concat_ws(" | ", "examples")})

    return run


def _types(s: SparkSession, d: str) -> DataFrame:
    tables = {t: _t(s, d, t).select(*cs) for t, cs in TYPED.items()} | {"fx": _dirty(s, d)}
    vh = union([value_histogram(df, t) for t, df in tables.items()])
    return inspection.column_types(vh, inspection.declared_types(tables))


def _types_sql() -> str:
    kinds = {"c_custkey": "int64", "c_acctbal": "float64", "o_orderdate": "datetime64[ns]", "o_totalprice": "float64", "p_size": "int32", "ts": "datetime64[ns]", "value": "float64", "l_quantity": "float64", "l_discount": "float64"}
    rows = [(t, c, f"CAST({c} AS VARCHAR)", kinds.get(c)) for t, cs in TYPED.items() for c in cs] + [("fx", c, f"CAST({c} AS VARCHAR)", WHOLE.get(c)) for c in DIRTY]
    return f'{_dirty_sql()}, {_measures_sql(_long_sql(rows))} SELECT t AS "table", c AS "column", st AS storage_type, it AS intended_type FROM y'


def _storage(s: SparkSession, d: str) -> DataFrame:
    mixed = _t(s, d, "orders").select(
        F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderkey").cast("string")).otherwise("none").alias("mostly_whole"), F.concat("o_orderkey", F.lit(".5")).alias("halves"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey").cast("string")).otherwise("x").alias("mixed"),
        F.lit(None).cast("string").alias("nothing"), F.col("o_orderpriority").alias("words"),
    )
    return inspection.column_types(value_histogram(mixed, "orders")).select("table", "column", "storage_type")


GROUPS_SQL = f"""{_dirty_sql()}, v AS (SELECT city s, count(*) cnt FROM fx GROUP BY 1), q AS (SELECT s, list_distinct(list_transform(range(1, greatest(length(s) - 1, 2)), lambda i: substr(s, CAST(i AS BIGINT), 3))) gr FROM v),
    p AS (SELECT a.s a, b.s b FROM q a JOIN q b ON a.s <> b.s WHERE len(list_intersect(a.gr, b.gr)) / len(list_distinct(list_concat(a.gr, b.gr))) >= 0.88),
    o AS (SELECT a, list(b) o FROM p GROUP BY 1)
    SELECT 'fx' AS "table", 'city' AS "column", array_to_string(list_sort(list_append(o, a)), ' ~ ') AS "values" FROM o WHERE a = (SELECT min(a) FROM o)"""


def catalog() -> dict[str, tuple[Query, str | None]]:
    rows = [("fx", c, f"CAST({c} AS VARCHAR)", WHOLE.get(c)) for c in DIRTY]
    errors = _errors_sql(_long_sql(rows))
    groups = {
        "d1_d2_missing_errors": ("null", "placeholder"),
        "d3_non_numeric_errors": ("non_numeric",),
        "d4_d8_email_errors": ("malformed_email", "mixed_case_email", "placeholder_email", "one_domain", "plus_tag"),
        "d9_key_duplicates": ("duplicate_key",),
        "d10_d11_code_errors": ("decimal_artefact", "code_length"),
        "d12_d14_date_errors": ("compact_date", "unreadable_date"),
        "d15_age_errors": ("low_age",),
        "d17_contaminated_errors": ("contaminated",),
        "d18_boolean_errors": ("boolean_spelling",),
    }
    out: dict[str, tuple[Query, str | None]] = {k: (_errors(*f), f"SELECT * FROM ({errors}) WHERE fault IN ({', '.join(f"'{x}'" for x in f)})") for k, f in groups.items()}
    out["p13_intended_types"] = (_types, _types_sql())
    out["p12_mixed_columns"] = (
        _storage,
        """SELECT 'orders' AS "table", v.c AS "column", CASE v.c WHEN 'halves' THEN 'float64' WHEN 'nothing' THEN 'object' WHEN 'mostly_whole' THEN CASE WHEN (SELECT avg(CAST(o_orderkey % 50 <> 0 AS DOUBLE)) FROM orders) >= 0.95 THEN 'int64' ELSE 'string' END
        ELSE 'string' END AS storage_type FROM (VALUES ('mostly_whole'), ('halves'), ('mixed'), ('nothing'), ('words')) v(c)""",
    )
    out["d19_near_duplicate_groups"] = (lambda s, d: inspection.near_duplicate_groups(value_histogram(_dirty(s, d).select("city"), "fx")).withColumn("values", F.concat_ws(" ~ ", "values")), GROUPS_SQL)
    return out
