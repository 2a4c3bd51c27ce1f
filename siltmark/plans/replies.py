"""Text providers: what they are asked, and how their replies are read and checked. The one that ships works offline."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any, Protocol

from siltmark.operators.generate import offline_rules
from siltmark.operators.rules import Rule
from siltmark.plans.judging import Judge, prompting_judge
from siltmark.plans.ordering import Embed, semantic_chunks, trigram_vectors
from siltmark.sources import sinks

NO_ACTION = "[No Immediate Action]"
REQUIRED = ("column_name", "description", "recommended_actions")
#: A rule that fails on this share of rows is itself suspect.
SUSPECT_RATE = 0.8


class Provider(Protocol):
    def describe(self, table: str, evidence: list[dict]) -> list[dict]:
        """Dictionary rows for columns: column_name, description, recommended_actions."""

    def propose(self, table: str, columns: list[dict], sample: Iterable[dict] = ()) -> list[Rule]:
        """Rules for a table, from facts of its columns and a small sample of its dirty and clean rows."""

    def assess(self, table: str, rules: list[Rule], suspect: list[dict]) -> list[str]:
        """Of the rules that fail nearly everywhere, the ids of those to be inspected."""

    def inspect(self, table: str, rule: Rule, failing: list) -> str:
        """What is wrong with a rule, given some of the values that fail it; empty where the data are at fault."""

    def revise(self, table: str, rules: list[Rule], suspect: list[dict]) -> list[Rule]:
        """Rules after those that fail nearly everywhere have been looked at."""

    def summarise(self, subject: str, facts: list[str]) -> str:
        """A paragraph on a table, the relationships or the whole."""


class Offline:
    """Says what the facts say, proposes rules by a fixed policy, and keeps every rule."""

    def describe(self, table: str, evidence: list[dict]) -> list[dict]:
        return [{"column_name": e["column_name"], "description": "; ".join(e["facts"]), "recommended_actions": [NO_ACTION]} for e in evidence]

    def propose(self, table: str, columns: list[dict], sample: Iterable[dict] = ()) -> list[Rule]:
        return offline_rules(columns)

    def assess(self, table: str, rules: list[Rule], suspect: list[dict]) -> list[str]:
        return [s["rule_id"] for s in suspect]

    def inspect(self, table: str, rule: Rule, failing: list) -> str:
        return ""

    def revise(self, table: str, rules: list[Rule], suspect: list[dict]) -> list[Rule]:
        return rules

    def summarise(self, subject: str, facts: list[str]) -> str:
        return f"{subject}: " + "; ".join(facts) if facts else subject


class Prompting(Offline):
    """A provider behind `call(prompt) -> reply`; what it cannot answer validly in some tries is answered offline."""

    def __init__(self, call: Callable[[str], str], chunk: int = 1, tries: int = 3, embed: Embed = trigram_vectors) -> None:
        self.call, self.chunk, self.tries, self.embed = call, chunk, tries, embed

    def _ask(self, prompt: str, read: Callable[[str], Any]) -> Any:
        """The first reply that `read` takes, or None. Only replies that cannot be read are asked for again."""
        for _ in range(self.tries):
            try:
                return read(self.call(prompt))
            except ValueError:
                continue
        return None

    def describe(self, table: str, evidence: list[dict]) -> list[dict]:
        out = []
        for part in semantic_chunks(evidence, self.chunk, self.embed) if self.chunk > 1 else chunks(evidence, self.chunk):
            rows = self._describe(table, part)
            if rows is None and len(part) > 1:
                rows = [r for e in part for r in self._describe(table, [e]) or super(Prompting, self).describe(table, [e])]
            out += rows or super().describe(table, part)
        by = {r["column_name"]: r for r in out}
        return [by[e["column_name"]] for e in evidence]

    def _describe(self, table: str, part: list[dict]) -> list[dict] | None:
        names = [e["column_name"] for e in part]
        prompt = f"Describe these columns of the table {table}. Reply with a JSON array of objects with {', '.join(REQUIRED)} (a list of texts).\n{json.dumps(part, ensure_ascii=False, default=str)}"
        rows = self._ask(prompt, lambda reply: checked_rows(parse_reply(reply), names))
        return rows and [r | {"recommended_actions": clean_actions(r["recommended_actions"])} for r in rows]

    def propose(self, table: str, columns: list[dict], sample: Iterable[dict] = ()) -> list[Rule]:
        rows = list(sample)
        prompt = f"Propose validation rules for the table {table}. Reply with a JSON array of objects with type, column, params, text.\n{json.dumps(columns, ensure_ascii=False, default=str)}\nSome rows:\n{json.dumps(rows, ensure_ascii=False, default=str)}"
        rules = self._ask(prompt, lambda reply: rules_of(parse_reply(reply)))
        return super().propose(table, columns, rows) if rules is None else rules

    def assess(self, table: str, rules: list[Rule], suspect: list[dict]) -> list[str]:
        ids = {s["rule_id"] for s in suspect}
        prompt = f"These rules of the table {table} fail on most rows. Reply with a JSON array of objects with rule_id, one for each rule whose wording may be at fault.\n{json.dumps(suspect, ensure_ascii=False, default=str)}"
        found = self._ask(prompt, lambda reply: [str(r["rule_id"]) for r in parse_reply(reply) if str(r.get("rule_id")) in ids])
        return sorted(ids) if found is None else found

    def inspect(self, table: str, rule: Rule, failing: list) -> str:
        prompt = f"The rule {rule.type} on {table}.{rule.column} with {json.dumps(rule.params, default=str)} fails on values such as {json.dumps(failing, ensure_ascii=False, default=str)}. Reply with a JSON object with issue: what is wrong with the rule, or an empty text."
        found = self._ask(prompt, lambda reply: [str(r.get("issue") or "") for r in parse_reply(reply)])
        return found[0] if found else ""

    def revise(self, table: str, rules: list[Rule], suspect: list[dict]) -> list[Rule]:
        if not suspect:
            return rules
        rows = [{"rule_id": r.rule_id, "type": r.type, "column": r.column, "params": r.params, "text": r.text} for r in rules]
        prompt = f"These rules of the table {table} fail on most rows: {json.dumps(suspect, default=str)}. Reply with the full corrected JSON array.\n{json.dumps(rows, ensure_ascii=False, default=str)}"
        revised = self._ask(prompt, lambda reply: rules_of(parse_reply(reply)))
        return revised or rules

    def judge(self) -> Judge:
        """What looks at rows for rules that do not compile; it goes to the executors with `call`."""
        return prompting_judge(self.call)

    def summarise(self, subject: str, facts: list[str]) -> str:
        return without_thoughts(self.call(f"Summarise in one paragraph. {subject}\n" + "\n".join(facts))).strip() or super().summarise(subject, facts)


class Remembering:
    """A provider whose answers are kept in a folder, one file for each question, so that a run that was cut off goes on where it was.

    The name of a file holds a digest of the question: an answer is used only for the very same facts.
    """

    def __init__(self, provider: Provider, folder: str) -> None:
        self.provider, self.folder = provider, folder

    def _kept(self, kind: str, table: str, question: Any, ask: Callable[[], Any]) -> Any:
        digest = hashlib.sha256(json.dumps(sinks.plain(question), sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]
        path = os.path.join(self.folder, f"{table}_{kind}_{digest}.json")
        known = sinks.read_json_file(path)
        if known is None:
            known = {"answer": sinks.plain(ask())}
            sinks.write_json(known, path)
        return known["answer"]

    def describe(self, table: str, evidence: list[dict]) -> list[dict]:
        return self._kept("columns", table, evidence, lambda: self.provider.describe(table, evidence))

    def propose(self, table: str, columns: list[dict], sample: Iterable[dict] = ()) -> list[Rule]:
        rows = list(sample)
        return [Rule(**r) for r in self._kept("rules", table, [columns, rows], lambda: self.provider.propose(table, columns, rows))]

    def assess(self, table: str, rules: list[Rule], suspect: list[dict]) -> list[str]:
        return self._kept("assessment", table, [rules, suspect], lambda: self.provider.assess(table, rules, suspect))

    def inspect(self, table: str, rule: Rule, failing: list) -> str:
        return self._kept("inspection", table, [rule, failing], lambda: self.provider.inspect(table, rule, failing))

    def revise(self, table: str, rules: list[Rule], suspect: list[dict]) -> list[Rule]:
        return [Rule(**r) for r in self._kept("revision", table, [rules, suspect], lambda: self.provider.revise(table, rules, suspect))]

    def judge(self) -> Judge | None:
        made = getattr(self.provider, "judge", None)
        return made() if made else None

    def summarise(self, subject: str, facts: list[str]) -> str:
        return self._kept("summary", "", [subject, facts], lambda: self.provider.summarise(subject, facts))


def chunks(rows: list, n: int) -> Iterator[list]:
    for i in range(0, len(rows), max(1, n)):
        yield rows[i : i + max(1, n)]


def without_thoughts(reply: str) -> str:
    return re.sub(r"<think>.*?(</think>|$)", "", reply or "", flags=re.DOTALL | re.IGNORECASE)


def parse_reply(reply: str) -> list:
    """The JSON array of a reply, or its object as an array of one: the whole text, else the first array of objects or object in it."""
    text = re.sub(r"```(?:json)?", "", without_thoughts(reply), flags=re.IGNORECASE).strip()
    decoder = json.JSONDecoder()
    for at in [m.start() for m in re.finditer(r"[\[{]", text)]:
        try:
            value, end = decoder.raw_decode(text, at)
        except json.JSONDecodeError:
            continue
        if isinstance(value, dict):
            return [value]
        if all(isinstance(v, dict) for v in value) or (at == 0 and end == len(text)):
            return value
    raise ValueError(f"no JSON array in the reply: {(reply or '')[:200]!r}")


def checked_rows(rows: list, expected: list[str]) -> list[dict]:
    """Rows in the order of the expected columns, or ValueError."""
    for k, r in enumerate(rows):
        if not isinstance(r, dict) or any(key not in r for key in REQUIRED):
            raise ValueError(f"row {k} is no object with {', '.join(REQUIRED)}")
        if not isinstance(r["recommended_actions"], list) or not all(isinstance(a, str) for a in r["recommended_actions"]):
            raise ValueError(f"row {k}: recommended_actions is no list of texts")
    by = {r["column_name"]: r for r in rows}
    if sorted(map(str, by)) != sorted(expected) or len(rows) != len(expected):
        raise ValueError(f"columns {sorted(map(str, by))} instead of {sorted(expected)}")
    return [by[c] for c in expected]


def clean_actions(actions: Iterable[str]) -> list[str]:
    """Each action once, without renames of a value to itself; a mark where none is left."""
    kept: dict[str, str] = {}
    for a in (a.strip() for a in actions or () if isinstance(a, str)):
        m = re.search(r"'([^']+)'\s*→\s*'([^']+)'", a)
        if a and a != NO_ACTION and not (m and m[1].strip() == m[2].strip()):
            kept.setdefault(a.lower(), a)
    return list(kept.values()) or [NO_ACTION]


def rules_of(rows: list) -> list[Rule]:
    out = []
    for k, r in enumerate(rows, 1):
        if not isinstance(r, dict) or not isinstance(r.get("type"), str):
            raise ValueError(f"rule {k} has no type")
        params = r.get("params", r.get("check_params")) or {}
        if not isinstance(params, dict):
            raise ValueError(f"rule {k}: params is no object")
        out.append(Rule(str(k), r["type"], str(r.get("column") or ""), params, str(r.get("text") or r.get("rule") or "")))
    return out


def with_references(rows: list[dict], paths: list[dict], table: str) -> list[dict]:
    """Dictionary rows with the role of each column and an action for each foreign key."""
    out = []
    for r in rows:
        me = f"{table}.{r['column_name']}"
        parents = [p["parent"] for p in paths if p["child"] == me and p["interpretation"] == "foreign_key"]
        one = any(me in (p["child"], p["parent"]) and p["interpretation"] == "one_to_one_key" for p in paths)
        role = "foreign_key" if parents else "primary_key" if one or any(p["parent"] == me and p["interpretation"] == "foreign_key" for p in paths) else None
        actions = clean_actions([*r["recommended_actions"], *[f"check values against {p}" for p in parents]])
        out.append(r | {"role": role, "recommended_actions": actions})
    return out


def compliance(runs: list[list[dict]], types: Iterable[str]) -> dict[str, float]:
    """Of rules that a provider proposed in several runs: shares with a known type, with a column, and the mean Jaccard of (type, column) between runs."""
    rules, known = [r for run in runs for r in run], set(types)
    share = lambda ok: round(sum(map(ok, rules)) / len(rules), 4) if rules else 0.0
    sets = [{(r.get("type"), r.get("column")) for r in run} for run in runs]
    pairs = [(a, b) for i, a in enumerate(sets) for b in sets[i + 1 :]]
    alike = [len(a & b) / len(a | b) if a | b else 1.0 for a, b in pairs]
    return {"valid_type": share(lambda r: r.get("type") in known), "has_column": share(lambda r: bool(r.get("column"))), "consistency": round(sum(alike) / len(alike), 4) if alike else 0.0, "rules": len(rules)}
