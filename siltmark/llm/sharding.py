"""Proportional stratified interleaving of rows into shards, with DataFrame functions only.

Rows of each source are shuffled by a seeded key and ranked; the rank r of n is the fraction
(r - phase) / n, with a phase between 0 and 1 that the seed gives each source. Sorted by fraction, the sources interleave in proportion, so cutting the order
into equal runs of rows gives shards that all match the mixture (each source within one row or so of its share).

No window spans a source: rows are dealt to buckets by the leading bits of their key, buckets are
counted and summed up per source (a small table, in blocks of buckets), and only rows of one bucket are
ranked together. The same is done for the order of all rows, over buckets of the fraction. So a source
that holds a third of all rows is split over as many tasks as it fills buckets. Rows that repeat have one key: they are counted
first, ranked as one, and take that many ranks in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmark.llm.common import has_columns, materialise, unsigned_crc32

#: Rows that a bucket holds on average; a task ranks some buckets at a time.
BUCKET_ROWS = 5_000
#: Bytes that a row costs besides its text.
ROW_BYTES = 16
PHASES = 1024
#: Buckets whose sums are added up in one task.
BLOCK_BUCKETS = 4_096


def _with_before(counts: DataFrame, by: list[str], bucket: str, count: str) -> DataFrame:
    """`counts` with `before`: rows in earlier buckets, by blocks of buckets first, so that no window holds all of them."""
    blocks = counts.withColumn("_block", F.expr(f"{bucket} div {BLOCK_BUCKETS}"))
    earlier = lambda w, order, c: F.coalesce(F.sum(c).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = blocks.groupBy(*by, "_block").agg(F.sum(count).alias("_sum"))
    sums = sums.select(*by, "_block", earlier(Window.partitionBy(*(by or [F.lit(0)])), "_block", "_sum").alias("_base"))
    inside = earlier(Window.partitionBy(*by, "_block"), bucket, count)
    return blocks.join(sums, [*by, "_block"]).withColumn("before", F.col("_base") + inside).drop("_block", "_base")


def bucket_of(above: str, below: str, buckets: int) -> Column:
    """above * buckets div below, where the product does not fit a long: the fraction is below 1, so the result does."""
    return F.expr(f"CAST((CAST({above} AS DECIMAL(20,0)) * CAST({buckets} AS DECIMAL(17,0))) div CAST({below} AS DECIMAL(20,0)) AS BIGINT)")


def interleave(docs: DataFrame, shards: int = 40, seed: int = 17, source: str = "source") -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot and grown_shard of each row of `docs` (doc_id, text, source).

    The law is `rows`: counts of shards are at most one apart. `slot` counts from 0 without gaps inside its
    shard, in the interleaved order; grown_shard is null, as this law moves rows when a shard is
    added. Equal texts are not held together: a group of copies may be larger than a shard. A null text has size 16
    and the checksum of no bytes; a null source is a source of its own; repeated rows take
    neighbouring places, which of them takes which does not matter as they are equal. No rows give none.
    """
    has_columns(docs, "doc_id", "text", source)
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string"))).alias("stratum"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        unsigned_crc32(text).alias("text_crc32"),
    ).withColumn("h", F.xxhash64(F.lit(seed), "stratum", "doc_id", "text_crc32", "size"))
    key = ["doc_id", "stratum", "size", "text_crc32", "h"]
    rows = materialise(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")), "rows")
    total, most = rows.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.max("copies"), F.lit(0))).first()
    buckets = max(1, -(-total // BUCKET_ROWS))
    rows = rows.withColumn("b", F.pmod(F.shiftrightunsigned("h", 33), F.lit(buckets)))
    counts = rows.groupBy("stratum", "b").agg(F.sum("copies").alias("c"))
    sources = counts.groupBy("stratum").agg(F.sum("c").alias("n"))
    counts = _with_before(counts, ["stratum"], "b", "c").join(sources, "stratum").drop("c")
    earlier = F.sum("copies").over(Window.partitionBy("stratum", "b").orderBy("h", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("copies")
    ranked = rows.join(counts, ["stratum", "b"]).withColumn("first", F.col("before") + earlier)
    # copies take ranks in a row; a row of very many is cut into blocks, which are dealt out before they are expanded
    ranked = ranked.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(BUCKET_ROWS).cast("long"))))
    if most > BUCKET_ROWS:
        ranked = ranked.repartition("h", "block")
    ranked = ranked.withColumn("copy", F.explode(F.sequence("block", F.least(F.col("block") + (BUCKET_ROWS - 1), F.col("copies") - 1)))).withColumn("r", F.col("first") + 1 + F.col("copy"))
    # a seeded phase for each source, so that sources of equal size do not come in step
    phase = F.pmod(F.xxhash64(F.lit(seed), "stratum"), F.lit(PHASES - 1)) + 1
    above = F.col("r") * PHASES - phase
    ranked = ranked.withColumns({"above": above, "below": F.col("n") * PHASES})
    ranked = ranked.select("doc_id", "stratum", "size", "text_crc32", "h", (F.col("above") / F.col("below")).alias("f"), bucket_of("above", "below", buckets).alias("g"))
    ranked = materialise(ranked, "ranked")
    heads = _with_before(ranked.groupBy("g").agg(F.count(F.lit(1)).alias("c")), [], "g", "c").select("g", "before")
    order = Window.partitionBy("g").orderBy("f", "stratum", "h", "doc_id", "text_crc32", "size")
    placed = ranked.join(heads, "g").withColumn("place", F.col("before") + F.row_number().over(order) - 1)
    shard = F.expr(f"place * {shards} div {max(total, 1)}")
    return placed.withColumn("shard", shard).select(
        "doc_id",
        F.when(F.col("stratum") != "n", F.substring("stratum", 2, 1 << 30)).alias("source"),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        # the first place of shard k is the least p with p * shards >= k * total
        (F.col("place") - F.expr(f"(shard * {total} + {shards - 1}) div {shards}")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
