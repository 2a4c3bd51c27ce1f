"""Small samples that are the same in every run: rows in the order of a hash of their key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 42


def hash_order(key: Column, seed: int = SEED) -> Column:
    """A text that orders keys at random, but always alike; other engines compute it, too."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")).cast("binary"))


def stratified_sample(df: DataFrame, dirty: Column, key: str, n: int, seed: int = SEED) -> DataFrame:
    """At most n rows, of which at most half are dirty (the first by `key`), and the rest clean ones in hash order.

    Both halves are top-n queries, which keep n rows in each task and never sort the table. A sample is the feature here: it is what a provider is shown.
    """
    flag = F.coalesce(dirty, F.lit(False))
    bad = df.where(flag).orderBy(key).limit(n // 2)
    good = df.where(~flag).orderBy(hash_order(F.col(key), seed), key).limit(n)
    # dirty rows first, then as many clean ones as there is room for
    both = bad.select("*", F.lit(0).alias("_s")).unionByName(good.select("*", F.lit(1).alias("_s")))
    return both.orderBy("_s", F.when(F.col("_s") == 0, F.lit("")).otherwise(hash_order(F.col(key), seed)), key).limit(n).drop("_s")
