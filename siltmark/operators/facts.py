"""What is worth saying about a column: format advice, anomalies, sentences of facts, samples, and the evidence given to a provider."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmark.config import DEFAULT, EMAIL, FALSE_SPELLINGS, SUSPICIOUS, TRUE_SPELLINGS, Config
from siltmark.functions import canon
from siltmark.operators import profile
from siltmark.operators.histogram import is_of

EXAMPLES = 3


def suspicious_values(vh: DataFrame) -> DataFrame:
    """Values that look like fillers (runs of 0, 1, 9 or x, or dummies): table, column, value, cnt."""
    v = F.lower(canon.strip(F.col("value")))
    filler = F.lit(False)
    for p in SUSPICIOUS:
        filler = filler | v.rlike(p)
    return vh.where(canon.is_value(F.col("value")) & filler).select("table", "column", "value", "cnt")


def sample_values(vh: DataFrame, config: Config = DEFAULT, types: DataFrame | None = None) -> DataFrame:
    """A few values of each column, in a fixed order that a hash gives: table, column, value.

    Values that are none of their column are left out: malformed addresses, and what is no number in a column of numbers (by `types`, if they are known).
    """
    v = F.col("value")
    types = (profile.column_types(vh) if types is None else types).select("table", "column", F.col("storage_type").isin("int64", "float64").alias("numeric"))
    # a row for each column
    rows = vh.where(canon.is_value(v)).join(F.broadcast(types), ["table", "column"])
    fits = (~F.lower("column").contains("email") | canon.strip(v).rlike(EMAIL)) & (~F.col("numeric") | canon.try_number(canon.strip(v)).isNotNull())
    w = Window.partitionBy("table", "column").orderBy(F.md5("value"), "value")
    return rows.where(fits).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= config.max_sample_values).select("table", "column", "value")


def coercibility(shapes: list[tuple[str, float]]) -> dict:
    """Whether shapes (pattern, percentage; the dominant one first) are spellings of one format.

    Numbers of several lengths or precisions, and texts of several lengths, are no issue of format.
    Others are coercible if they equal the dominant one without their punctuation.
    """
    if len(shapes) < 2:
        return {"is_coercible": False, "reason": "one format" if shapes else "no data"}
    patterns = [p for p, _ in shapes]
    for allowed, reason in ((r"[X]*", "integers of several lengths"), (r"[X.]*", "numbers of several precisions"), (r"[a\s.'\-/]*", "texts of several lengths")):
        if all(re.fullmatch(allowed, p) for p in patterns):
            return {"is_coercible": False, "reason": reason}
    bones = [re.sub(r"[^Xa]", "", p) for p in patterns]
    digits = re.fullmatch(r"X*", bones[0])
    rest = [(s, b) for s, b in zip(shapes[1:], bones[1:], strict=True) if not (digits and re.fullmatch(r"X*", b) and b != bones[0])]
    same = [s for s, b in rest if b == bones[0]]
    other = [s for s, b in rest if b != bones[0]]
    if not same and shapes[0][1] < 50:
        return {"is_coercible": False, "reason": "no dominant format"}
    out = {"is_coercible": bool(same), "target_format": patterns[0], "coercible": same, "non_coercible": other, "coercible_percentage": round(sum(p for _, p in same), 1)}
    return out | {"recommendation": recommendation(patterns[0], same, other)}


def recommendation(target: str, same: list[tuple[str, float]], other: list[tuple[str, float]]) -> str:
    said = []
    if same:
        said.append(f"rewrite {', '.join(p for p, _ in same)} as {target}")
    if other:
        said.append(f"look into {', '.join(p for p, _ in other)}")
    return "; ".join(said) or f"keep {target}"


def uniformity(shapes: list[tuple[str, float]]) -> float:
    """The share of the dominant shape."""
    return round(max((p for _, p in shapes), default=0.0) / 100, 4)


def _extremes() -> list[Column]:
    """What `extremes` gives, null where a column has no value."""
    held = canon.is_value(F.col("value"))
    v, w = F.when(held, F.col("value")), F.when(held, F.col("cnt"))
    x = canon.try_number(canon.strip(v))
    return [
        F.min(v).alias("min_text"), F.max(v).alias("max_text"), F.min(x).alias("min_number"), F.max(x).alias("max_number"), F.min(F.char_length(v)).alias("min_length"), F.max(F.char_length(v)).alias("max_length"),
        F.try_divide(F.coalesce(F.sum(F.when(x.isNotNull(), w)), F.lit(0)), F.sum(w)).alias("numeric_share"), F.try_divide(F.count(v), F.sum(w)).alias("uniqueness"),
    ]


def _truths() -> Column:
    """Which spellings of truth a column has: a few, in a set."""
    low = F.lower(canon.strip(F.col("value")))
    return F.array_sort(F.collect_set(F.when(low.isin(*TRUE_SPELLINGS, *FALSE_SPELLINGS), low))).alias("truths")


def extremes(vh: DataFrame) -> DataFrame:
    """Least and greatest text, number and length of each column, the share of numbers, and of distinct values."""
    return vh.where(canon.is_value(F.col("value"))).groupBy("table", "column").agg(*_extremes())


def column_facts(vh: DataFrame, config: Config = DEFAULT, shapes: DataFrame | None = None) -> dict[tuple[str, str], dict]:
    """Facts of each column by (table, column): counts, type, extremes, top values, shapes with advice, samples, permissible values and spellings of truth.

    Each part is a few rows for each column, whatever the size of the table. A histogram that the caller keeps is left to it; `shapes`, if they have been read, are taken.
    """
    own = not vh.is_cached
    vh = vh.persist() if own else vh
    try:
        key = lambda r: (r["table"], r["column"])
        # counts, types and extremes in one aggregation
        counted = vh.groupBy("table", "column").agg(*profile.missing_counts(), *profile.type_counts(), *_extremes(), _truths()).withColumn("storage_type", profile.storage_type()).drop("n", "filled", "numeric", "whole")
        bounds = ("min_text", "max_text", "min_number", "max_number", "min_length", "max_length", "numeric_share", "uniqueness")
        facts = {key(r): {k: x for k, x in r.asDict().items() if r["n_distinct"] or k not in bounds} for r in counted.collect()}
        types = vh.sparkSession.createDataFrame([(*k, f["storage_type"]) for k, f in facts.items()], "table string, column string, storage_type string")
        few = [k for k, f in facts.items() if f["n_distinct"] <= config.max_permissible_values]
        lists = {"top_values": (profile.top_values(vh).orderBy("table", "column", "rank"), lambda r: (r["value"], r["cnt"])), "formats": ((profile.shapes(vh) if shapes is None else shapes).orderBy("table", "column", "rank"), lambda r: (r["fingerprint"], round(100 * r["share"], 1)))}
        lists |= {"samples": (sample_values(vh, config, types), lambda r: r["value"]), "permissible": (profile.permissible_values(vh.where(is_of(few)), config).orderBy("table", "column", "value"), lambda r: r["value"])}
        for name, (df, take) in lists.items():
            for f in facts.values():
                f[name] = []
            for r in df.collect():
                facts[key(r)][name].append(take(r))
        for f in facts.values():
            f["coercibility"] = coercibility(f["formats"])
        return facts
    finally:
        if own:
            vh.unpersist()


def sentences(f: dict) -> list[str]:
    """Facts of a column in words."""
    n, out = f["n_total"], []
    out.append(f"{f['missing_count']} of {n} rows have no value" if f["missing_count"] else f"all {n} rows have a value")
    out.append(f"{f['n_distinct']} distinct values, stored as {f['storage_type']}")
    if f["n_distinct"] == 1:
        out.append("the column is constant")
    if f.get("uniqueness") is not None:
        u = f["uniqueness"]
        out.append("every value occurs once" if u == 1 else f"{u:.1%} of values are distinct" + (", so the few repeats are worth a look" if u >= 0.9 else ""))
    if f["storage_type"] in ("int64", "float64") and f.get("min_number") is not None:
        out.append(f"values from {f['min_number']:g} to {f['max_number']:g}")
    elif f.get("min_text") is not None:
        out.append(f"values from {f['min_text']!r} to {f['max_text']!r}, {f['min_length']} to {f['max_length']} characters")
        if 0 < f["numeric_share"] < 1:
            out.append(f"{f['numeric_share']:.1%} of values are numbers")
    if f["permissible"]:
        out.append("values: " + ", ".join(f["permissible"]))
    elif f["samples"]:
        out.append("such as " + ", ".join(f["samples"][:EXAMPLES]))
    if f["coercibility"]["is_coercible"]:
        out.append(f["coercibility"]["recommendation"])
    return out


def evidence(f: dict, config: Config = DEFAULT) -> dict:
    """What a provider is told of a column. Shapes are left out for text with few values, which says more itself."""
    few = f["storage_type"] == "string" and 0 < f["n_distinct"] <= config.categorical_threshold
    return {"column_name": f["column"], "data_type": f["storage_type"], "facts": sentences(f), "sample_values": f["samples"], "permissible_values": f["permissible"]} | ({} if few else {"formats": [p for p, _ in f["formats"]]})
