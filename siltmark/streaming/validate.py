"""Row-local rules on a stream: violations of each micro-batch go to a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from siltmark.operators.rules import NEEDS_ROWS, Rule, named, violation_records


def validate_stream(stream: DataFrame, rules: list[Rule], keys: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Append violations to Parquet files under `path`. Rules that need all rows of a table, by any of their names, and rules that do not compile are refused."""
    if bad := [r.rule_id for r in map(named, rules) if r.type in NEEDS_ROWS]:
        raise ValueError(f"rules need the whole table: {bad}")
    out = violation_records(stream, rules, keys)
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
