"""Connected components over an edge table, as alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.llm.common import materialise

#: Steps are logarithmic in the longest path; this many would serve a path of 2**60 nodes.
MAX_STEPS = 64


def _stars(e: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v) with u > v."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    # large star: the larger neighbours of a node, and the node, point at the least of its closed neighbourhood
    near = both.where("v > u").join(least, "u").select("v", F.least("m", "u").alias("m"), "u")
    large = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("m < u").select("u", F.col("m").alias("v")))
    # small star: the smaller neighbours of a node, and the node, point at the least of them
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
    return small.select("e.u", "e.v").where("u > v").distinct()


def _state(e: DataFrame) -> tuple:
    row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of `edges` (a, b: long); the label is the least node reachable.

    Each step is written to the shared folder, so its lineage is short. Ends of edges that are
    null are ignored; self links and repeated links are harmless. Nodes with no link are absent.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialise(e, "edges")
    was = _state(e)
    steps = 0
    while was[0]:
        e = materialise(_stars(e), "stars")
        now = _state(e)
        if now == was:
            break
        was, steps = now, steps + 1
        if steps > MAX_STEPS:
            raise RuntimeError(f"components have not settled after {MAX_STEPS} steps")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
