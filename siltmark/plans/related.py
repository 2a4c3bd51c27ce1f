"""What a run says beside its dictionaries: merged relationships with hints, roles and groups, types with faults, and values that look wrong.

All lists are of metadata size: a row for a column, for a pair of columns, or a few values of a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltmark.config import DEFAULT, Config
from siltmark.functions import canon
from siltmark.operators import detectors, facts, inspection, profile, relationships

#: Filler values that a report names for a column.
FILLERS = 5


def _rows(df: DataFrame, *order: str) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.orderBy(*order).collect()]


def related(spark: SparkSession, vh: DataFrame, columns: list[tuple[str, str]], declared: dict[tuple[str, str], str | None], errors: DataFrame, config: Config = DEFAULT) -> dict[str, list[dict]]:
    """paths (by coverage and by likeness, in order), hints, roles, groups, referenced_keys, duplicates, types and fillers. `errors`: faults of columns (table, column, fault)."""
    local = lambda df: spark.createDataFrame(df.collect(), df.schema)
    merged, copies = local(relationships.merged_paths(vh, spark, columns, config)), local(relationships.duplicate_paths(vh, config))
    few = Window.partitionBy("table", "column").orderBy(F.desc("n"), "value")
    fillers = facts.suspicious_values(vh).groupBy("table", "column", "value").agg(F.sum("cnt").alias("n")).withColumn("_r", F.row_number().over(few)).where(F.col("_r") <= FILLERS).drop("_r")
    return {
        "paths": _rows(merged, "place"),
        "hints": _rows(relationships.join_hints(merged.where("reported OR candidate"), copies), "table", "column", "kind", "hint"),
        "roles": _rows(relationships.roles(merged), "table", "column"),
        "groups": _rows(relationships.path_groups(merged), "kind"),
        "referenced_keys": _rows(relationships.referenced_keys(merged), "key"),
        "duplicates": _rows(copies, "place"),
        "types": _rows(relationships.type_breakdown(inspection.column_types(vh, declared), errors, profile.missing_profile(vh)), "table", "storage_type"),
        "fillers": _rows(fillers, "table", "column", "n", "value"),
    }


def far_numbers(tables: dict[str, DataFrame], numeric: dict[str, list[str]], config: Config = DEFAULT) -> list[dict]:
    """table, column, n, least and most of the distinct outliers of each column of numbers that has some."""
    out = []
    for t, columns in numeric.items():
        for c in columns:
            numbers = tables[t].select(canon.try_number(F.col(f"`{c}`").cast("string")).alias("x"))
            n, least, most = detectors.numeric_outliers(numbers, "x", config).agg(F.count_distinct("value"), F.min("value"), F.max("value")).first()
            if n:
                out.append({"table": t, "column": c, "n": n, "least": least, "most": most})
    return out


def report_lines(found: dict[str, list[dict]]) -> list[str]:
    """The lists as lines of a Markdown report."""
    out = ["## Keys and joins", ""]
    out += [f"- {r['key']} is referred to by {', '.join(r['children'])}" for r in found["referenced_keys"]]
    out += [f"- {r['table']}.{r['column']}: {r['hint']}" for r in found["hints"]]
    out += ["", "| kind of path | paths | mean quality |", "|-|-|-|"] + [f"| {r['kind']} | {r['n']} | {r['quality']:.3f} |" for r in found["groups"]]
    out += ["", "## Types", "", "| table | type | columns | with faults | with gaps |", "|-|-|-|-|-|"] + [f"| {r['table']} | {r['storage_type']} | {r['n_columns']} | {r['with_errors']} | {r['with_missing']} |" for r in found["types"]]
    odd = [f"- {r['table']}.{r['column']}: {r['value']!r} stands in {r['n']} rows" for r in found["fillers"]]
    odd += [f"- {r['table']}.{r['column']}: {r['n']} numbers far from the others, {r['least']:g} to {r['most']:g}" for r in found.get("far", [])]
    return [*out, *(["", "## Odd values", "", *odd] if odd else []), ""]
