"""Which column names a record in a report: by its name, then by uniqueness, then by how short its values are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltmark.operators import names

LEAST_UNIQUENESS = 0.9


def identifier_candidates(vh: DataFrame) -> DataFrame:
    """table, column, rank of the name, uniqueness and avg_len of each column that has values."""
    v = vh.where("value IS NOT NULL")
    found = v.groupBy("table", "column").agg((F.count(F.lit(1)) / F.sum("cnt")).alias("uniqueness"), (F.sum(F.char_length("value") * F.col("cnt")) / F.sum("cnt")).alias("avg_len"))
    return names.record_rank(found)


def record_identifiers(vh: DataFrame) -> DataFrame:
    """table, column: the identifier of each table that has one, by rank, uniqueness and length. Ties go by name. One row for each column is ranked."""
    able = identifier_candidates(vh).where((F.col("rank") > 0) | (F.col("uniqueness") >= LEAST_UNIQUENESS))
    w = Window.partitionBy("table").orderBy(F.desc("rank"), F.desc("uniqueness"), "avg_len", "column")
    return able.withColumn("place", F.row_number().over(w)).where("place = 1").select("table", "column")
