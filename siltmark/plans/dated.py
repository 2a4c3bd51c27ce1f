"""Queries of dates in several layouts, with their SQL: order dates written in ways that both engines write alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.operators import dates
from siltmark.operators.histogram import value_histogram
from siltmark.operators.rules import Rule, compile_rule

Query = Callable[[SparkSession, str], DataFrame]
_D, _M = ("lpad(concat(" + part + "(o_orderdate), ''), 2, '0')" for part in ("day", "month"))
_Y = "concat(year(o_orderdate), '')"
_NAME = "substr('" + "".join(m[:3].title() for m in dates.MONTHS) + "', 3 * month(o_orderdate) - 2, 3)"
_OTHER = "concat(1 + o_orderkey % 28, '')"
#: days: the day comes first. months: the month does, without zeros. words: names of months, and clocks, on another day of the month. broken: gaps, no dates, two layouts. open: both orders.
WRITTEN = {
    "days": f"concat({_D}, '/', {_M}, '/', {_Y})",
    "months": f"concat(concat(month(o_orderdate), ''), '-', concat(day(o_orderdate), ''), '-', {_Y})",
    "words": f"CASE WHEN o_orderkey % 3 = 0 THEN concat({_NAME}, ' ', {_OTHER}, ', ', {_Y}) WHEN o_orderkey % 3 = 1 THEN concat({_OTHER}, ' ', {_NAME}, ' ', {_Y}) ELSE concat({_Y}, '-', {_M}, '-', lpad({_OTHER}, 2, '0'), ' 05:07 PM') END",
    "broken": f"CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN concat({_Y}, '-13-', {_D}) WHEN o_orderkey % 13 = 0 THEN concat({_Y}, '/', {_M}, '/', {_D}) ELSE concat({_Y}, {_M}, {_D}) END",
    "open": f"CASE WHEN o_orderkey % 2 = 0 THEN concat({_D}, '/', {_M}, '/', {_Y}) ELSE concat({_M}, '/', {_D}, '/', {_Y}) END",
}


def _written(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", *[F.expr(e).alias(c) for c, e in WRITTEN.items()])


def _rule(rule: Rule) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = _written(spark, d)
        return df.select("o_orderkey", compile_rule(df, rule).alias("_bad")).where("_bad").drop("_bad")

    return run


def catalog() -> dict[str, tuple[Query, str | None]]:
    # a layout's formats in the order of its bit, as the projection writes them
    formats = (("%Y-%m-%d", "%Y/%m/%d", "%Y-%m-%d %I:%M %p"), ("%Y%m%d",), ("%m/%d/%Y", "%m-%d-%Y"), ("%d/%m/%Y", "%d-%m-%Y"), ("%b %d, %Y",), ("%d %b %Y",))
    bits = " + ".join(f"CASE WHEN try_strptime(v, [{', '.join(repr(f) for f in fs)}]) IS NOT NULL THEN {1 << k} ELSE 0 END" for k, fs in enumerate(formats))
    names = lambda of: "concat_ws(',', " + ", ".join(f"CASE WHEN {of} & {bit} <> 0 THEN '{n}' END" for n, bit in dates.BIT.items()) + ")"
    each = " UNION ALL ".join(f"SELECT '{c}' AS c, {e} AS v FROM orders" for c, e in WRITTEN.items())
    only = lambda bit: f"coalesce(bool_or(b & 12 = {bit}), false)"
    layouts_sql = f"""WITH t AS ({each}), x AS (SELECT c, {bits} AS b FROM t WHERE v <> 'n/a'), a AS (SELECT c, count(*) n, count(*) FILTER (b <> 0) d, bit_and(b) FILTER (b <> 0) l, bit_or(b) s, {only(8)} AND NOT {only(4)} AS o FROM x GROUP BY 1)
    SELECT 'orders' AS "table", c AS "column", n AS "values", d AS dates, {names("l")} AS "left", {names("s")} AS seen, o AS days_lead, l = 0 AS mixed FROM a"""
    return {
        "f5_date_layouts": (lambda s, d: dates.layouts(value_histogram(_written(s, d).drop("o_orderkey"), "orders")), layouts_sql),
        "v4_mixed_dates": (_rule(Rule("a", "date_ordering", "", {"col_a": "days", "col_b": "words"})), "SELECT o_orderkey FROM orders WHERE day(o_orderdate) > 1 + o_orderkey % 28"),
        "v9_mixed_dates": (_rule(Rule("a", "datetime_parseable", "broken")), "SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 11 = 0 OR o_orderkey % 7 = 0"),
        "v10_mixed_dates": (_rule(Rule("a", "date_not_future", "months", {"cutoff": "1996-01-01"})), "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1996-01-01'"),
    }
