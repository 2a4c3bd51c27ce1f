"""Casts of text columns by what their values are, for a copy that is profiled. Decisions come from the histogram; the casts are one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltmark.config import DEFAULT, Config
from siltmark.functions import canon

#: Values of a column that is profiled as categorical, whatever its type. Fixed values.
FLAG_VALUES = ("yes", "no", "true", "false", "0", "1")
#: Parts of the names of columns that are profiled as dates where they hold some.
DATE_NAMES = ("date", "time")
#: Least and greatest date of the copy that is profiled; a column with others stays text.
DATE_BOUNDS = ("1677-09-22", "2262-04-11")
UPPER_MAX_VALUES, UPPER_MAX_RATIO = 50, 0.5


@dataclass(frozen=True)
class Decision:
    """What becomes of a column: target is bigint, double, category or None (as it is)."""

    target: str | None
    upper: bool
    schema: str | None


def cast_facts(vh: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """One row for each column: counts of values, of numbers, whole numbers, flags and (where the name says so) dates among the non-null ones."""
    v, w = canon.strip(F.col("value")), F.col("cnt")
    x = canon.try_number(v)
    named = F.lower("column").rlike("|".join(DATE_NAMES))
    return vh.where(F.col("value").isNotNull()).groupBy("table", "column").agg(
        F.sum(w).alias("n"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.bool_and(x.isNotNull()).alias("numeric"),
        F.coalesce(F.bool_and(F.when(x.isNotNull(), x == F.floor(x))), F.lit(False)).alias("whole"),
        F.bool_and(F.lower(v).isin(*FLAG_VALUES)).alias("flags"),
        F.coalesce(F.bool_or(F.when(named, canon.try_date(v, config.date_formats).isNotNull())), F.lit(False)).alias("dated"),
    )


def decide(vh: DataFrame, config: Config = DEFAULT) -> dict[tuple[str, str], Decision]:
    """Decisions by (table, column): a result of metadata size."""
    out = {}
    for r in cast_facts(vh, config).collect():
        target = ("bigint" if r["whole"] else "double") if r["numeric"] else "category" if r["n_distinct"] <= config.categorical_threshold else None
        upper = r["n_distinct"] <= UPPER_MAX_VALUES and r["n_distinct"] / r["n"] < UPPER_MAX_RATIO
        out[r["table"], r["column"]] = Decision(target, upper, "categorical" if r["flags"] else "datetime" if r["dated"] else None)
    return out


def auto_cast(df: DataFrame, table: str, decisions: dict[tuple[str, str], Decision], upper: bool = False) -> DataFrame:
    """Text columns as numbers where all their values are, else upper-cased where they have few values and that is asked for; whole doubles as integers."""
    out = []
    for f in df.schema:
        c, d = F.col(f"`{f.name}`"), decisions.get((table, f.name))
        if d and isinstance(f.dataType, T.StringType):
            if d.target in ("bigint", "double"):
                x = canon.try_number(canon.strip(c))
                c = x.try_cast("bigint") if d.target == "bigint" else x
            elif upper and d.upper:
                c = F.upper(c)
        elif d and d.target == "bigint" and isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = canon.try_number(c.cast("string")).try_cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def dates_in_bounds(df: DataFrame) -> DataFrame:
    """Date columns with a value out of bounds as text; one aggregation over all of them."""
    dated = [f.name for f in df.schema if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    if not dated:
        return df
    inside = lambda c: F.col(f"`{c}`").cast("date").between(*DATE_BOUNDS)
    found = df.agg(*[F.coalesce(F.bool_and(inside(c)), F.lit(True)).alias(str(i)) for i, c in enumerate(dated)]).first()
    return df.withColumns({c: F.col(f"`{c}`").cast("string") for i, c in enumerate(dated) if not found[i]})


def drop_duplicate_columns(df: DataFrame, pairs: list[tuple[str, str]], keep: str = "first", dry_run: bool = False) -> tuple[DataFrame, list[str]]:
    """`df` without one column of each pair (a, b), and the names that go; a column that is kept for one pair can go for another."""
    gone = list(dict.fromkeys(b if keep == "first" else a for a, b in pairs))
    return (df if dry_run else df.drop(*gone)), gone


def with_row_id(df: DataFrame, order: list[str]) -> DataFrame:
    """`_row_id` from 0 without gaps in the order of `order`.

    The rows are range-partitioned and sorted once and kept (until the session drops them), as both uses must see the same partitions; counts per
    partition (one row each) give the offsets, so no task sees all rows. Ties go by a hash of the row, so that equal keys are spread as well.
    """
    keys = [*[F.col(c) for c in order], F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_p", F.spark_partition_id()).persist()
    local = placed.withColumn("_r", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = local.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    offsets = sizes.withColumn("_o", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_o")
    return local.join(F.broadcast(offsets), "_p").withColumn("_row_id", F.col("_o") + F.col("_r")).drop("_p", "_o", "_r")


def row_slice(df: DataFrame, start: int, n: int) -> DataFrame:
    """Rows start to start + n - 1 of a table with `_row_id`."""
    return df.where(F.col("_row_id").between(start, start + n - 1))
