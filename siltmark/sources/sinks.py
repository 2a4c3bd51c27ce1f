"""Writers of results: dictionaries and rules as JSON or CSV (metadata size, on the driver), rows as Parquet, a report, and folders of runs."""

from __future__ import annotations

import csv
import datetime
import html
import json
import math
import os
import shutil
from collections.abc import Iterable
from dataclasses import asdict, is_dataclass
from typing import Any

from pyspark.sql import DataFrame

SEPARATOR = " | "


def plain(x: Any) -> Any:
    """JSON values: numbers that are none become null, dates text, dataclasses and sets plain."""
    if is_dataclass(x) and not isinstance(x, type):
        x = asdict(x)
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if isinstance(x, (set, frozenset)):
        return sorted((plain(v) for v in x), key=str)
    if isinstance(x, float):
        return x if math.isfinite(x) else None
    if isinstance(x, (datetime.datetime, datetime.date)):
        return None if x != x else x.isoformat()
    if x is None or isinstance(x, (bool, int, str)):
        return x
    return str(x)


def write_json(value: Any, path: str) -> str:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(plain(value), f, ensure_ascii=False, indent=2, allow_nan=False)
    return path


def read_json_file(path: str) -> Any:
    """What an earlier run has left, or None."""
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def write_dictionary_csv(rows: list[dict], path: str) -> str:
    """Rows with the columns of all of them in order of appearance; lists are joined."""
    columns = list(dict.fromkeys(k for r in rows for k in r))
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        out = csv.DictWriter(f, columns)
        out.writeheader()
        for r in plain(rows):
            out.writerow({k: SEPARATOR.join(map(str, v)) if isinstance(v, list) else v for k, v in r.items()})
    return path


def write_rows(df: DataFrame, path: str) -> str:
    """Rows of any number, written by the executors."""
    df.write.mode("overwrite").parquet(path)
    return path


def run_folder(base: str, names: Iterable[str], now: datetime.datetime | None = None) -> str:
    """A new folder named by the tables and the time."""
    stamp = (now or datetime.datetime.now()).strftime("%Y-%m-%d_%H-%M-%S")
    path = os.path.join(base, "_".join([*names, stamp]))
    k = 0
    while os.path.exists(out := f"{path}_{k}" if k else path):
        k += 1
    os.makedirs(out)
    return out


def pack(folder: str) -> str:
    """The files of a run's folder as an archive beside it."""
    return shutil.make_archive(folder.rstrip("/"), "zip", folder)


def relationship_lines(paths: list[dict]) -> list[str]:
    """Join paths as text: foreign keys, then one-to-one keys, then shared domains; the best coverage first."""
    order = {"foreign_key": 0, "one_to_one_key": 1, "shared_value_domain": 2}
    ranked = sorted(paths, key=lambda p: (order.get(p["interpretation"], 3), -max(p["coverage_a"], p["coverage_b"]), p["child"], p["parent"]))
    return [f"{p['child']} -> {p['parent']}  {p['interpretation']}  coverage {p['coverage_a']:.3f} / {p['coverage_b']:.3f}  quality {p['quality']:.3f}" for p in ranked]


def report_payload(dictionaries: dict[str, list[dict]], paths: list[dict], summaries: dict[str, list[dict]]) -> dict:
    """What a report shows: for each table its types, columns with gaps, unique columns and likely keys, violations; and the join paths by kind."""
    tables = {}
    for t, rows in dictionaries.items():
        types: dict[str, int] = {}
        for r in rows:
            types[r["storage_type"]] = types.get(r["storage_type"], 0) + 1
        unique = [r["column"] for r in rows if r.get("uniqueness") == 1 and not r["missing_count"]]
        parents = {p["parent"].split(".", 1)[1] for p in paths if p["parent"].split(".", 1)[0] == t}
        tables[t] = {
            "rows": max((r["n_total"] for r in rows), default=0), "columns": len(rows), "types": types, "columns_with_missing": sum(r["missing_count"] > 0 for r in rows),
            "unique_columns": unique, "likely_keys": [c for c in unique if c in parents] or unique[:1], "rules": summaries.get(t, []), "violations": sum(r["violations"] for r in summaries.get(t, [])),
        }
    kinds: dict[str, list[dict]] = {}
    for p in paths:
        kinds.setdefault(p["interpretation"], []).append(p)
    return {"tables": tables, "relationships": kinds}


def report_markdown(payload: dict, dictionaries: dict[str, list[dict]]) -> str:
    cell = lambda x: str("" if x is None else x).replace("|", "\\|").replace("\n", " ")
    out = ["# Data report", ""]
    for t, s in payload["tables"].items():
        out += [f"## {t}", "", f"{s['rows']} rows, {s['columns']} columns, {s['columns_with_missing']} with gaps; likely keys: {', '.join(s['likely_keys']) or 'none'}.", "", "| column | type | missing | facts |", "|-|-|-|-|"]
        out += [f"| {cell(r['column'])} | {r['storage_type']} | {r['missing_count']} | {cell('; '.join(r.get('facts', [])))} |" for r in dictionaries[t]]
        if s["rules"]:
            out += ["", "| rule | violations | rate |", "|-|-|-|"] + [f"| {cell(r.get('text') or r['rule_id'])} | {r['violations']} | {r['rate']} |" for r in s["rules"]]
        out.append("")
    out += ["## Relationships", ""] + [f"- {line}" for line in relationship_lines([p for ps in payload["relationships"].values() for p in ps])]
    return "\n".join(out) + "\n"


def report_html(markdown: str) -> str:
    return f"<!doctype html><meta charset='utf-8'><title>Data report</title><pre>{html.escape(markdown)}</pre>\n"
