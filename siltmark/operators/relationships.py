"""Relationships for a report: paths that were found by coverage and by likeness, merged and ordered; hints, roles and keys of columns.

All of it is of metadata size (a row for a pair of columns, or for a column), but for the values that are compared on the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltmark.config import DEFAULT, Config
from siltmark.functions import canon
from siltmark.operators import names, relations, sketches

REPORTED = ("foreign_key", "one_to_one_key", "shared_value_domain")
NO_CANDIDATE = ("shared_value_domain", "unreported_ordinal_domain")
PAIR = ["table_a", "column_a", "table_b", "column_b"]


def _in_order(df: DataFrame) -> DataFrame:
    """Each pair with its lesser side first; what belongs to a side goes with it."""
    swap = F.struct("table_a", "column_a") > F.struct("table_b", "column_b")
    sided = [c[:-2] for c in df.columns if c.endswith("_a") and f"{c[:-2]}_b" in df.columns]
    rest = [c for c in df.columns if c[:-2] not in sided]
    return df.select(*[F.when(swap, F.col(f"{c}_{other}")).otherwise(F.col(f"{c}_{s}")).alias(f"{c}_{s}") for c in sided for s, other in (("a", "b"), ("b", "a"))], *rest)


def _local(df: DataFrame) -> DataFrame:
    """A table of metadata size, with its rows in the plan."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def _coverage_rank() -> Column:
    return F.when(F.col("interpretation") == "foreign_key", 0).when(F.col("interpretation") == "one_to_one_key", 1)


def coverage_paths(vh: DataFrame, spark: SparkSession, columns: list[tuple[str, str]], config: Config = DEFAULT, kinds: DataFrame | None = None) -> DataFrame:
    """Paths by coverage with their `place`: foreign keys, one-to-one keys, shared domains, each by coverage."""
    found = relations.join_paths(vh, spark, columns, config, kinds)
    first = F.coalesce(_coverage_rank(), F.lit(2))
    return found.withColumn("place", F.row_number().over(Window.orderBy(first, F.desc(F.greatest("coverage_a", "coverage_b")), "child", "parent")))


def merged_paths(vh: DataFrame, spark: SparkSession, columns: list[tuple[str, str]], config: Config = DEFAULT) -> DataFrame:
    """Paths by coverage and by likeness of values (exact and of k-grams), one row for each pair, with `place`, `reported` and `candidate`.

    What coverage says of a pair wins, likeness adds what it lacks. Pairs that are only alike, of two tables whose names allow it, are
    classified by their values as well. Keys come first, then what coverage found, by quality; then the others by resemblance.
    """
    # a row for each column, and for each pair that names allow: read once, and local from here on
    kinds = _local(sketches.column_kinds(vh))
    pairs = _local(names.pairs(spark, columns, config))
    every = _in_order(relations.classify(relations.overlaps(vh, pairs), config))
    excluded = [kinds.where(F.col("kind").isin(*relations.NOT_COMPARED)).select(F.col("table").alias(f"table_{s}"), F.col("column").alias(f"column_{s}")) for s in "ab"]
    compared = every
    for s, x in zip("ab", excluded, strict=True):
        compared = compared.join(x, [f"table_{s}", f"column_{s}"], "left_anti")
    covered = F.col("interpretation").isin(*REPORTED[:2]) | ((F.col("interpretation") == "shared_value_domain") & (F.greatest("coverage_a", "coverage_b") >= config.join_coverage))
    measured = ["interpretation", "child", "parent", "overlap", "coverage_a", "coverage_b", "jaccard", "quality"]
    paths = compared.where(covered).select(*PAIR, *measured, F.lit("coverage").alias("method"))
    alike = _in_order(sketches.similar_columns(vh, config, kinds).drop("kind_a", "kind_b")).where("table_a <> table_b").join(_in_order(pairs).select(*PAIR), PAIR, "left_semi")
    alike = alike.withColumnRenamed("exact", "alike").withColumnRenamed("shingle", "resemblance_shingle")
    # a pair that is alike in another spelling may share no value at all
    none = {"interpretation": F.lit("many_to_many_or_lookup"), "child": F.concat_ws(".", "table_a", "column_a"), "parent": F.concat_ws(".", "table_b", "column_b"), "overlap": F.lit(0), **{c: F.lit(0.0) for c in measured[4:]}}
    only = alike.select(*PAIR).join(paths.select(*PAIR), PAIR, "left_anti").join(every.select(*PAIR, *measured), PAIR, "left")
    only = only.select(*PAIR, *[F.coalesce(F.col(c), none[c]).alias(c) for c in measured], F.lit("similar").alias("method"))
    both = paths.unionByName(only).join(alike, PAIR, "left")
    both = both.withColumn("resemblance", F.when(F.col("method") == "coverage", F.col("jaccard")).otherwise(F.col("alike"))).drop("alike")
    kind = F.col("interpretation")
    rank = F.coalesce(_coverage_rank(), F.when(F.col("method") == "coverage", 2).otherwise(3))
    by = Window.orderBy(rank, F.when(rank < 3, -F.col("quality")).otherwise(-F.col("resemblance")), F.when(rank < 3, -F.greatest("coverage_a", "coverage_b")).otherwise(F.lit(0.0)), "child", "parent")
    return both.withColumns({"place": F.row_number().over(by), "reported": kind.isin(*REPORTED), "candidate": ~kind.isin(*NO_CANDIDATE)})


def duplicate_paths(vh: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Duplicate and near-identical columns with their `place`, by likeness."""
    found = relations.duplicate_columns(vh, config)
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("jaccard"), "table", "column_a", "column_b")))


def _percent(c: str | Column) -> Column:
    return F.format_string("%.1f%%", F.col(c) * 100 if isinstance(c, str) else c * 100)


def join_hints(paths: DataFrame, duplicates: DataFrame | None = None) -> DataFrame:
    """table, column, kind and hint for both ends of each path (reported ones, and candidates whose values are no numbers), and of duplicates."""
    side = lambda s: F.concat_ws(".", f"table_{s}", f"column_{s}")
    best = _percent(F.greatest("coverage_a", "coverage_b"))
    both = F.concat(_percent("coverage_a"), F.lit(" / "), _percent("coverage_b"))
    shape = lambda end, other: (
        F.when((F.col("interpretation") == "foreign_key") & (end == F.col("child")), F.concat(F.lit("refers to key "), F.col("parent"), F.lit(", "), best, F.lit(" of its values are there")))
        .when(F.col("interpretation") == "foreign_key", F.concat(F.lit("key that "), F.col("child"), F.lit(" refers to, "), best, F.lit(" of the values there are here")))
        .when(F.col("interpretation") == "one_to_one_key", F.concat(F.lit("one-to-one key with "), other, F.lit(", coverage "), both))
        .when(F.col("interpretation") == "shared_value_domain", F.concat(F.lit("same kind of values as "), other, F.lit(", coverage "), both, F.lit("; no key")))
        .otherwise(F.concat(F.lit("values like those of "), other, F.lit(", resemblance "), _percent("resemblance")))
    )
    ends = [paths.select(F.col(f"table_{s}").alias("table"), F.col(f"column_{s}").alias("column"), F.col("interpretation").alias("kind"), shape(side(s), side(o)).alias("hint")) for s, o in (("a", "b"), ("b", "a"))]
    out = ends[0].unionByName(ends[1])
    if duplicates is not None:
        for s, o in (("a", "b"), ("b", "a")):
            said = F.concat(F.lit("nearly the values of "), F.concat_ws(".", "table", f"column_{o}"), F.lit(", resemblance "), _percent("jaccard"))
            out = out.unionByName(duplicates.select("table", F.col(f"column_{s}").alias("column"), F.lit("duplicate_column").alias("kind"), said.alias("hint")))
    return out


def roles(paths: DataFrame) -> DataFrame:
    """table, column, role (primary_key, foreign_key or join_key): of several paths of a column, the last one's."""
    name = lambda s: F.struct(F.col(f"table_{s}").alias("table"), F.col(f"column_{s}").alias("column"))
    is_child = lambda s: F.concat_ws(".", f"table_{s}", f"column_{s}") == F.col("child")
    key = F.col("interpretation") == "foreign_key"
    ends = F.array(*[F.struct(name(s).alias("at"), F.when(key, F.when(is_child(s), "foreign_key").otherwise("primary_key")).otherwise("join_key").alias("role")) for s in "ab"])
    rows = paths.where(F.col("interpretation").isin("foreign_key", "one_to_one_key")).select("place", F.explode(ends).alias("e"))
    return rows.groupBy("e.at.table", "e.at.column").agg(F.max_by("e.role", "place").alias("role"))


def without_repeats(errors: DataFrame, paths: DataFrame) -> DataFrame:
    """`errors` (table, column, fault) without repeated keys in columns that refer to another one: repeats are expected there."""
    foreign = paths.where("interpretation = 'foreign_key'").select(F.substring_index("child", ".", 1).alias("table"), F.regexp_replace("child", r"^[^.]*\.", "").alias("column"), F.lit("duplicate_key").alias("fault")).distinct()
    return errors.join(foreign, ["table", "column", "fault"], "left_anti")


def referenced_keys(paths: DataFrame) -> DataFrame:
    """key, children (in order) and n of each column that others refer to."""
    found = paths.where("interpretation = 'foreign_key'").groupBy(F.col("parent").alias("key")).agg(F.array_sort(F.collect_set("child")).alias("children"))
    return found.withColumn("n", F.size("children").cast("long"))


def path_groups(paths: DataFrame) -> DataFrame:
    """kind, n and mean quality of the paths of each kind."""
    return paths.groupBy(F.col("interpretation").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.avg("quality").alias("quality"))


def unique_columns(vh: DataFrame) -> DataFrame:
    """table, column, n and likely_key of columns without gaps in which no value repeats: likely keys are named as the table's identifier."""
    v = F.col("value")
    a = vh.groupBy("table", "column").agg(F.sum("cnt").alias("n"), F.coalesce(F.sum(F.when(v.isNull() | canon.is_placeholder(v) | canon.is_blank(v), F.col("cnt"))), F.lit(0)).alias("gaps"), F.count_distinct(F.when(canon.is_value(v), canon.strip(v))).alias("distinct"))
    flat, entity = names.flat(F.col("column")), F.regexp_replace(names.flat(F.col("table")), "s$", "")
    named = flat.rlike("(id|key)$") & (((entity != "") & flat.contains(entity)) | (flat == "id"))
    return a.where("gaps = 0 AND distinct > 1 AND distinct = n").select("table", "column", "n", named.alias("likely_key"))


def type_breakdown(types: DataFrame, errors: DataFrame, missing: DataFrame) -> DataFrame:
    """table, storage_type, n_columns, with_errors and with_missing: of `types` (table, column, storage_type), `errors` (table, column) and `missing` (table, column, missing_count)."""
    bad = errors.select("table", "column").distinct().withColumn("bad", F.lit(1))
    gaps = missing.where("missing_count > 0").select("table", "column").distinct().withColumn("gap", F.lit(1))
    rows = types.join(bad, ["table", "column"], "left").join(gaps, ["table", "column"], "left")
    return rows.groupBy("table", "storage_type").agg(F.count(F.lit(1)).alias("n_columns"), F.count("bad").alias("with_errors"), F.count("gap").alias("with_missing"))
