"""Rules that do not compile: a provider looks at the rows, a batch at a time, on the executors."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.functions import canon
from siltmark.operators.rules import Rule, sibling_lookup

BATCH_ROWS, TRIES = 200, 3
#: Parameters of a rule that name columns of its table.
COLUMN_PARAMETERS = ("col_a", "col_b", "col_c", "col_sum", "join_col")
#: How an expression names a column.
COLUMN_OF_ROW = r"(?:row|df)\[['\"]([^'\"]+)['\"]\]"
Judge = Callable[[list[dict], list[dict]], dict[str, list[str]]]


def needed_columns(df: DataFrame, rules: list[Rule]) -> list[str]:
    """Columns of `df` that some rule names, in their order."""
    named: set[str] = set()
    for r in rules:
        named |= {r.column, *(r.params.get(k) for k in COLUMN_PARAMETERS), *r.params.get("related_cols", ()), *re.findall(COLUMN_OF_ROW, r.params.get("logic") or "")}
    return [c for c in df.columns if c in named]


def with_siblings(df: DataFrame, rules: list[Rule], tables: dict[str, DataFrame]) -> DataFrame:
    """`df` with columns of other tables that rules across tables ask for (parent_table, parent_column, join_col, take), as `table.column`; keys that repeat give none."""
    for r in rules:
        p = r.params
        parent, key, column, take = tables.get(p.get("parent_table")), p.get("parent_column"), p.get("join_col", r.column), p.get("take", ())
        if parent is None or key not in parent.columns or column not in df.columns:
            continue
        new = {c: f"{p['parent_table']}__{c}" for c in take if c in parent.columns and f"{p['parent_table']}__{c}" not in df.columns}
        if new:
            renamed = parent.select(F.col(key).alias(key), *[F.col(c).alias(n) for c, n in new.items()])
            df = sibling_lookup(df, column, renamed, key, list(new.values()))
    return df


def read_judgement(reply: list[dict], rules: list[dict], rows: list[dict]) -> dict[str, list[str]]:
    """A reply of objects with rule_id and failing (keys of rows): every rule once, and only rows of the batch; else ValueError."""
    keys, ids = {r["_key"] for r in rows}, {r["rule_id"] for r in rules}
    out: dict[str, list[str]] = {}
    for x in reply:
        rule, failing = str(x.get("rule_id")), x.get("failing", [])
        if rule not in ids or rule in out or not isinstance(failing, list) or not {str(k) for k in failing} <= keys:
            raise ValueError(f"no judgement of this batch: {x!r}")
        out[rule] = sorted({str(k) for k in failing})
    if set(out) != ids:
        raise ValueError("some rules have no judgement")
    return out


def judged(df: DataFrame, rules: list[Rule], key: str, judge: Judge, tables: dict[str, DataFrame] | None = None, batch: int = BATCH_ROWS) -> DataFrame:
    """rule_id and key of rows that a provider finds in breach of rules that do not compile.

    `judge(rules, rows)` is sent to the executors, so it must be picklable; it is asked again where its answer cannot be read, and a batch without an answer
    ends the query. There is a question for every `batch` rows: its cost is the provider's. Without rules or rows there is no question.
    """
    schema = "rule_id string, key string"
    if not rules:
        return df.sparkSession.createDataFrame([], schema)
    wide = with_siblings(df, rules, tables or {})
    columns = [c for c in wide.columns if c in needed_columns(df, rules) or c not in df.columns]
    said = [{"rule_id": r.rule_id, "type": r.type, "column": r.column, "params": r.params, "text": r.text} for r in rules]
    rows = wide.select(canon.text(wide[key], wide.schema[key].dataType).alias("_key"), *[canon.text(wide[c], wide.schema[c].dataType).alias(c) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b.to_pylist()
            for i in range(0, len(held), batch):
                part = held[i : i + batch]
                for k in range(TRIES):
                    try:
                        found = judge(said, part)
                        break
                    except ValueError:
                        if k == TRIES - 1:
                            raise
                flat = [(rule, x) for rule, failing in found.items() for x in failing]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in flat], pa.string()), pa.array([f[1] for f in flat], pa.string())], ["rule_id", "key"])

    return rows.mapInArrow(run, schema)


def prompting_judge(call: Callable[[str], str]) -> Judge:
    """A judge behind `call(prompt) -> reply`."""
    from siltmark.plans.replies import parse_reply

    def judge(rules: list[dict], rows: list[dict]) -> dict[str, list[str]]:
        prompt = f"Check each row against each rule. Reply with a JSON array of objects with rule_id and failing (the _key of rows in breach), one for each rule.\n{json.dumps(rules, ensure_ascii=False, default=str)}\n{json.dumps(rows, ensure_ascii=False, default=str)}"
        return read_judgement(parse_reply(call(prompt)), rules, rows)

    return judge
