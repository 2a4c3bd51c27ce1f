"""Column profiles from the histogram and from typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmark.config import DEFAULT, KNOWN_PATTERNS, SINGAPORE_PATTERNS, Config
from siltmark.functions import canon
from siltmark.operators.quantiles import quantiles


def missing_counts() -> list[Column]:
    """Rows, nulls, placeholders, both together, and distinct values."""
    v, weight = F.col("value"), F.col("cnt")
    placeholder = canon.is_placeholder(v)
    return [
        F.sum(weight).alias("n_total"),
        F.coalesce(F.sum(F.when(v.isNull(), weight)), F.lit(0)).alias("n_null"),
        F.coalesce(F.sum(F.when(placeholder, weight)), F.lit(0)).alias("n_placeholder"),
        F.coalesce(F.sum(F.when(v.isNull() | placeholder, weight)), F.lit(0)).alias("missing_count"),
        F.count(F.when(canon.is_value(v), 1)).alias("n_distinct"),
    ]


def missing_profile(vh: DataFrame) -> DataFrame:
    """Rows, nulls, placeholders, both together, and distinct values of each column."""
    return vh.groupBy("table", "column").agg(*missing_counts())


def numeric_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact moments and quartiles of numeric columns: passes for the quartiles of all of them, and one wide aggregation; skewness is corrected for bias."""
    quartiles = quantiles(df, {c: F.col(c) for c in columns}, [0.25, 0.75])
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        n = F.count(x)
        skew = F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))
        q1, q3 = (F.lit(q).cast("double") for q in quartiles[c][1])
        aggs.append(F.struct(F.lit(c).alias("column"), n.alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), q1.alias("q1"), q3.alias("q3"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), skew.alias("skew")).alias(f"s_{c}"))
    return df.agg(*aggs).select(F.explode(F.array(*[f"s_{c}" for c in columns])).alias("s")).select("s.*")


def with_share(counts: DataFrame) -> DataFrame:
    """`counts` (table, column, cnt) and the share of each row in its column: totals are summed apart and joined, so that no task holds a whole column."""
    totals = counts.groupBy("table", "column").agg(F.sum("cnt").alias("_total"))
    return counts.join(totals, ["table", "column"]).withColumn("share", F.col("cnt") / F.col("_total")).drop("_total")


def top_values(vh: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent values of each column; ties by value."""
    w = Window.partitionBy("table", "column").orderBy(F.desc("cnt"), "value")
    return vh.where(canon.is_value(F.col("value"))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def length_distribution(vh: DataFrame) -> DataFrame:
    """Lengths of values with their share; the share of the most frequent one decides what a code is."""
    by = vh.where(canon.is_value(F.col("value"))).groupBy("table", "column", F.char_length("value").alias("length")).agg(F.sum("cnt").alias("cnt"))
    return with_share(by)


def length_summary(vh: DataFrame) -> DataFrame:
    """Average length of values and the length that 95 % of them do not exceed (interpolated), over counts by length."""
    by = vh.where(canon.is_value(F.col("value"))).groupBy("table", "column", F.char_length("value").alias("length")).agg(F.sum("cnt").alias("cnt"))
    return by.groupBy("table", "column").agg((F.sum(F.col("length") * F.col("cnt")) / F.sum("cnt")).alias("avg_length"), F.percentile(F.col("length"), 0.95, F.col("cnt")).alias("p95_length"))


def permissible_values(vh: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Values of columns that have few of them."""
    values = vh.where(canon.is_value(F.col("value")))
    few = values.groupBy("table", "column").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= config.max_permissible_values)
    return values.join(few.select("table", "column"), ["table", "column"]).select("table", "column", "value")


def _shaped(vh: DataFrame) -> DataFrame:
    return vh.where(canon.is_value(F.col("value"))).withColumn("fingerprint", canon.fingerprint(F.col("value")))


def shapes(vh: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent character-class shapes of each column, with their share: one aggregation, of which no value is sent."""
    by = _shaped(vh).groupBy("table", "column", "fingerprint").agg(F.sum("cnt").alias("cnt"))
    w = Window.partitionBy("table", "column").orderBy(F.desc("cnt"), "fingerprint")
    # the rank is bounded before the totals are joined, so that each task keeps k rows of a column
    ranked = by.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    totals = by.groupBy("table", "column").agg(F.sum("cnt").alias("_total"))
    return ranked.join(totals, ["table", "column"]).withColumn("share", F.col("cnt") / F.col("_total")).drop("_total")


def fingerprints(vh: DataFrame, k: int = 10, examples: int = 3) -> DataFrame:
    """`shapes` with some examples (the least values) of each."""
    first = _shaped(vh).withColumn("_r", F.row_number().over(Window.partitionBy("table", "column", "fingerprint").orderBy("value"))).where(F.col("_r") <= examples)
    shown = first.groupBy("table", "column", "fingerprint").agg(F.array_sort(F.collect_list("value")).alias("examples"))
    return shapes(vh, k).join(shown, ["table", "column", "fingerprint"]).select("table", "column", "fingerprint", "cnt", "rank", "examples", "share")


def uniformity(vh: DataFrame) -> DataFrame:
    """The share of the most frequent shape of each column."""
    return fingerprints(vh, k=1).select("table", "column", F.col("share").alias("uniformity"))


def quantile_table(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """column, share and value: exact quantiles of numeric columns."""
    found = quantiles(df, {c: F.col(c) for c in columns}, shares)
    rows = [(c, s, q) for c, (_, qs) in found.items() for s, q in zip(shares, qs, strict=True)]
    return df.sparkSession.createDataFrame(rows, "column string, share double, value double")


def known_patterns(vh: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Counts of values that match well-known patterns from their start, in either case."""
    patterns = KNOWN_PATTERNS | (SINGAPORE_PATTERNS if config.country_patterns else {})
    v = F.col("value")
    hits = [F.coalesce(F.sum(F.when(v.rlike(f"(?i)^(?:{p})"), F.col("cnt"))), F.lit(0)).alias(name) for name, p in patterns.items()]
    wide = vh.where(v.isNotNull()).groupBy("table", "column").agg(*hits)
    return wide.unpivot(["table", "column"], list(patterns), "pattern", "cnt").where("cnt > 0")


def type_counts() -> list[Column]:
    """What `storage_type` asks for."""
    v, w = F.col("value"), F.col("cnt")
    x = canon.try_number(canon.strip(v))
    return [
        F.sum(w).alias("n"),
        F.coalesce(F.sum(F.when(v.isNotNull(), w)), F.lit(0)).alias("filled"),
        F.coalesce(F.sum(F.when(x.isNotNull(), w)), F.lit(0)).alias("numeric"),
        F.coalesce(F.bool_and(F.when(x.isNotNull(), x == F.floor(x))), F.lit(False)).alias("whole"),
    ]


def storage_type() -> Column:
    """Storage type by `type_counts`: int64 or float64 from 95 % of all rows on, else string; object where all is null."""
    numeric = F.col("numeric") >= 0.95 * F.col("n")
    return F.when(F.col("filled") == 0, "object").when(numeric & F.col("whole"), "int64").when(numeric, "float64").otherwise("string")


def column_types(vh: DataFrame) -> DataFrame:
    """Storage type of text columns by what parses: int64 or float64 from 95 % of all rows on, else string; object where all is null."""
    a = vh.groupBy("table", "column").agg(*type_counts(), F.count(F.when(canon.is_value(F.col("value")), 1)).alias("n_distinct"))
    return a.select("table", "column", storage_type().alias("storage_type"), "n_distinct")


def candidate_keys(vh: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Uniqueness (distinct values by values) of each column, and whether it is high enough for a key."""
    a = vh.where(canon.is_value(F.col("value"))).groupBy("table", "column").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("cnt").alias("n"))
    return a.withColumn("uniqueness", F.col("n_distinct") / F.col("n")).withColumn("is_key", F.col("uniqueness") >= config.pk_uniqueness)
