"""How alike columns are by their values and by k-grams of their values: exact, and by MinHash sketches for many columns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.config import DEFAULT, ID_TOKENS, PLACEHOLDERS, Config
from siltmark.functions import canon
from siltmark.operators.histogram import is_of
from siltmark.operators.profile import column_types

PERMUTATIONS = 128
#: Bands and rows of a band for a threshold of 0.5 on values and 0.6 on k-grams.
BANDS = {0.5: (25, 5), 0.6: (18, 7)}
EXACT_THRESHOLD, SHINGLE_THRESHOLD = 0.5, 0.6


def column_kinds(vh: DataFrame, plain: Iterable[tuple[str, str]] = (), types: DataFrame | None = None) -> DataFrame:
    """table, column, storage_type and kind (empty, free_text, key_like, categorical, discrete_code, continuous_numeric, other) of each column.

    Values of `plain` columns, which all differ without white space, are counted where they are; `types` (table, column, storage_type), if they are known, are taken.
    """
    same = is_of(plain)
    v, w = canon.strip(F.col("value")), F.col("cnt")
    a = vh.where(F.col("value").isNotNull() & (v != "")).groupBy("table", "column").agg(
        F.sum(w).alias("n"),
        (F.count_distinct(F.when(~same, v)) + F.count_if(same)).alias("d"),
        (F.sum(F.char_length(v) * w) / F.sum(w)).alias("avg_len"),
    )
    named = F.lower(F.regexp_replace("column", "(?<=[a-z])(?=[A-Z])", "_")).rlike(f"(^|[^a-z0-9])({'|'.join(ID_TOKENS)})($|[^a-z0-9])")
    ratio = F.col("d") / F.col("n")
    text = F.when(F.col("avg_len") > 80, "free_text").when(named, "key_like").when((F.col("d") <= 20) | (ratio < 0.2), "categorical").when(ratio < 0.98, "discrete_code").otherwise("other")
    whole = F.when(named, "key_like").when((F.col("d") <= 30) | (ratio < 0.2), "categorical").when(ratio < 0.98, "discrete_code").otherwise("other")
    real = F.when(F.col("d") <= 30, "discrete_code").otherwise("continuous_numeric")
    kind = F.when(F.col("n").isNull(), "empty").when(F.col("storage_type") == "int64", whole).when(F.col("storage_type") == "float64", real).otherwise(text)
    return (column_types(vh) if types is None else types).select("table", "column", "storage_type").join(a, ["table", "column"], "left").select("table", "column", "storage_type", kind.alias("kind"), F.coalesce("d", F.lit(0)).alias("n_distinct"))


def sketchable(kinds: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Columns that are sketched: keys, text that repeats, and numbers with few values."""
    text = F.col("storage_type").isin("string", "object") & F.col("kind").isin("categorical", "discrete_code")
    number = F.col("storage_type").isin("int64", "float64") & F.col("n_distinct").between(1, config.near_dupe_max_values)
    return kinds.where((F.col("kind") == "key_like") | text | number).select("table", "column")


def value_tokens(vh: DataFrame) -> DataFrame:
    """Distinct values of each column in lower case, without anything but letters a-z, digits and single blanks."""
    t = canon.strip(F.regexp_replace(F.regexp_replace(F.lower(canon.strip(F.col("value"))), r"[^a-z0-9\s]", ""), r"\s+", " "))
    return vh.select("table", "column", t.alias("token")).where((F.col("token") != "") & ~F.col("token").isin(*PLACEHOLDERS)).distinct()


def shingle_tokens(vh: DataFrame, k: int = 3) -> DataFrame:
    """Distinct k-grams of those values; shorter values count as one."""
    size = F.greatest(F.char_length("token") - (k - 1), F.lit(1))
    grams = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(F.col("token"), i, F.lit(k)))
    return value_tokens(vh).select("table", "column", F.explode(F.array_distinct(grams)).alias("token")).distinct()


def resemblance(tokens: DataFrame) -> DataFrame:
    """Exact Jaccard similarity of columns that share a token.

    A token meets the columns that hold it in one aggregation; a row of that is as wide as the catalog, not as the data.
    """
    sizes = tokens.groupBy("table", "column").agg(F.count(F.lit(1)).alias("n"))
    held = tokens.groupBy("token").agg(F.array_sort(F.collect_set(F.struct("table", "column"))).alias("c")).where(F.size("c") > 1)
    # pairs come from the few different sets of columns, not from every token
    sets = held.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    pairs = sets.select(F.posexplode("c").alias("i", "a"), "c", "n").select("a", "n", F.explode(F.slice("c", F.col("i") + 2, F.size("c"))).alias("b")).groupBy("a", "b").agg(F.sum("n").alias("shared"))
    out = pairs.select(F.col("a.table").alias("table_a"), F.col("a.column").alias("column_a"), F.col("b.table").alias("table_b"), F.col("b.column").alias("column_b"), "shared")
    for s in "ab":
        out = out.join(sizes.select(F.col("table").alias(f"table_{s}"), F.col("column").alias(f"column_{s}"), F.col("n").alias(f"n_{s}")), [f"table_{s}", f"column_{s}"])
    return out.select("table_a", "column_a", "table_b", "column_b", "shared", (F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("jaccard"))


def minhash(tokens: DataFrame, permutations: int = PERMUTATIONS) -> DataFrame:
    """table, column and sketch (least seeded hash for each of the permutations): one aggregation with map-side minima."""
    least = [F.min(F.xxhash64(F.lit(i), "token")).alias(f"h{i}") for i in range(permutations)]
    return tokens.groupBy("table", "column").agg(*least).select("table", "column", F.array(*[f"h{i}" for i in range(permutations)]).alias("sketch"))


def sketch_resemblance(sketches: DataFrame, threshold: float = EXACT_THRESHOLD) -> DataFrame:
    """Pairs of columns that agree in a band, with the share of registers in which they agree."""
    bands, width = BANDS[threshold]
    keys = F.array(*[F.xxhash64(F.lit(b), F.slice("sketch", b * width + 1, width)) for b in range(bands)])
    rows = sketches.select("table", "column", "sketch", F.explode(keys).alias("band"))
    side = lambda s: rows.select("band", *[F.col(c).alias(f"{c}_{s}") for c in ("table", "column", "sketch")])
    before = F.struct("table_a", "column_a") < F.struct("table_b", "column_b")
    found = side("a").join(side("b"), "band").where(before).drop("band").dropDuplicates(["table_a", "column_a", "table_b", "column_b"])
    same = F.size(F.filter(F.zip_with("sketch_a", "sketch_b", lambda x, y: x == y), lambda x: x))
    return found.select("table_a", "column_a", "table_b", "column_b", (same / F.size("sketch_a")).alias("estimate"))


def similar_columns(vh: DataFrame, config: Config = DEFAULT, kinds: DataFrame | None = None) -> DataFrame:
    """Pairs of columns with compatible kinds whose values or k-grams are alike enough; both similarities are given.

    Numbers are compared where both are keys, or within a table.
    """
    kinds = column_kinds(vh) if kinds is None else kinds
    some = vh.join(F.broadcast(sketchable(kinds, config)), ["table", "column"])
    names = ["table_a", "column_a", "table_b", "column_b"]
    exact = resemblance(value_tokens(some)).withColumnRenamed("jaccard", "exact").drop("shared")
    grams = resemblance(shingle_tokens(some)).withColumnRenamed("jaccard", "shingle").drop("shared")
    out = exact.join(grams, names, "full").fillna(0.0, ["exact", "shingle"]).where((F.col("exact") >= EXACT_THRESHOLD) | (F.col("shingle") >= SHINGLE_THRESHOLD))
    for s in "ab":
        out = out.join(kinds.select(F.col("table").alias(f"table_{s}"), F.col("column").alias(f"column_{s}"), F.col("kind").alias(f"kind_{s}"), F.col("storage_type").isin("int64", "float64").alias(f"number_{s}")), [f"table_{s}", f"column_{s}"])
    numbers = F.col("number_a") & F.col("number_b")
    keys = (F.col("kind_a") == "key_like") & (F.col("kind_b") == "key_like")
    fits = (F.col("number_a") == F.col("number_b")) & (~numbers | keys | (F.col("table_a") == F.col("table_b")))
    return out.where(fits).select(*names, "kind_a", "kind_b", "exact", "shingle")
