"""Rules from profiles and relationships, and clean-up of rules that a provider proposes.

What reads data is a DataFrame of one row for each finding; what edits rules works on lists of metadata size.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltmark.config import DEFAULT, FALSE_SPELLINGS, TRUE_SPELLINGS, Config
from siltmark.functions import canon
from siltmark.operators import detectors
from siltmark.operators.profile import column_types, shapes
from siltmark.operators.names import is_identifier
from siltmark.operators.rules import Rule

CODE_SHARE = 0.5
PHONE_COUNTRY, PHONE_LENGTH = 65, 8
#: Enumerations are proposed for columns with so many values at most.
ENUMERATION_VALUES = 20


def uniqueness_candidates(vh: DataFrame, config: Config = DEFAULT, types: DataFrame | None = None) -> DataFrame:
    """Text columns that are nearly unique: table, column, ratio. `types` (table, column, storage_type), if they are known, are taken."""
    text = (column_types(vh) if types is None else types).where("storage_type = 'string'").select("table", "column")
    a = vh.where("value IS NOT NULL").groupBy("table", "column").agg((F.count(F.lit(1)) / F.sum("cnt")).alias("ratio"))
    return a.where((F.col("ratio") >= config.uniqueness_rule_min_ratio) & (F.col("ratio") < 1)).join(text, ["table", "column"], "left_semi")


def code_formats(vh: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Columns of which at least half of the values are digits of one length: table, column, digits, share. `known`: the shapes, if they have been read."""
    codes = (shapes(vh) if known is None else known).where(F.col("fingerprint").rlike("^X+$") & (F.col("share") >= CODE_SHARE))
    return codes.groupBy("table", "column").agg(F.min_by(F.char_length("fingerprint"), "rank").alias("digits"), F.min_by("share", "rank").alias("share"))


def truth_spellings(vh: DataFrame) -> DataFrame:
    """The most frequent spelling of true and of false in each column of flags: table, column, truth, value."""
    low = F.lower(canon.strip(F.col("value")))
    truth = F.when(low.isin(*TRUE_SPELLINGS), True).when(low.isin(*FALSE_SPELLINGS), False)
    v = vh.where("value IS NOT NULL").select("table", "column", truth.alias("truth"), canon.strip(F.col("value")).alias("value"), "cnt")
    by = v.where("truth IS NOT NULL").groupBy("table", "column", "truth", "value").agg(F.sum("cnt").alias("cnt"))
    w = Window.partitionBy("table", "column", "truth").orderBy(F.desc("cnt"), "value")
    return by.withColumn("r", F.row_number().over(w)).where("r = 1").select("table", "column", "truth", "value")


def has(rules: list[Rule], type_: str, column: str) -> bool:
    return any(r.type == type_ and r.column == column for r in rules)


def reference_rules(table: str, paths: Iterable[dict], rules: list[Rule]) -> list[Rule]:
    """For rows of join paths (child, parent, interpretation): a check against the parent of each foreign key, both ways and unique for one-to-one keys."""
    out: list[Rule] = []

    def refer(column: str, other: str) -> None:
        t, c = other.split(".", 1)
        if not has([*rules, *out], "referential_cross_table", column):
            out.append(Rule("", "referential_cross_table", column, {"parent_table": t, "parent_column": c}, f"{column} must exist in {other}"))

    for p in paths:
        one = p["interpretation"] == "one_to_one_key"
        for here, there in ((p["child"], p["parent"]), (p["parent"], p["child"])):
            own, column = here.split(".", 1)
            if own != table or (not one and (p["interpretation"] != "foreign_key" or here != p["child"])):
                continue
            refer(column, there)
            if one and not has([*rules, *out], "uniqueness", column):
                out.append(Rule("", "uniqueness", column, {}, f"{column} must be unique"))
    return out


def sentinel_rules(df: DataFrame, bounds: dict[str, tuple[float, float]], rules: list[Rule], sentinels: Iterable[tuple[str, float]] | None = None) -> list[Rule]:
    """A check for each column with bounds (lower, upper) whose outliers are mostly one value; one job for all, unless the `sentinels` (column, value) are known."""
    bounds = {c: b for c, b in bounds.items() if not has(rules, "sentinel_check", c)}
    found: dict[str, list[float]] = {}
    if sentinels is None:
        sentinels = [(r["column"], r["value"]) for r in detectors.all_sentinels(df, bounds).collect()] if bounds else []
    for c, x in sentinels:
        found.setdefault(c, []).append(x)
    return [Rule("", "sentinel_check", c, {"numbers": sorted(found[c])}, f"{c} must not hold placeholder numbers") for c in bounds if c in found]


def supplement(table: str, vh: DataFrame, df: DataFrame, rules: list[Rule], paths: Iterable[dict] = (), bounds: dict[str, tuple[float, float]] | None = None, codes: Iterable[str] = (), config: Config = DEFAULT, unique: list | None = None, formats: list | None = None, sentinels: Iterable[tuple[str, float]] | None = None) -> list[Rule]:
    """`rules` with what the data themselves ask for: references, uniqueness, code formats and sentinels, numbered anew.

    `bounds` are of numeric columns, `codes` such that are meant as text; `unique` and `formats` are the rows of `uniqueness_candidates` and
    `code_formats` of all tables, where they have been read, `sentinels` (column, value) those of this table.
    """
    mine = vh.where(F.col("table") == table)
    out = [*rules]
    out += reference_rules(table, paths, out)
    for r in sorted(uniqueness_candidates(mine, config).collect() if unique is None else unique):
        if r["table"] == table and not has(out, "uniqueness", r["column"]):
            out.append(Rule("", "uniqueness", r["column"], {}, f"{r['column']} must be unique within {table}"))
    codes = set(codes)
    for r in sorted(code_formats(mine).collect() if formats is None else formats):
        if r["table"] == table and r["column"] in codes and not has(out, "format", r["column"]):
            out.append(Rule("", "format", r["column"], {"regex": rf"^\d{{{r['digits']}}}$"}, f"{r['column']} must be a {r['digits']}-digit code"))
    out += sentinel_rules(df, {c: b for c, b in (bounds or {}).items() if c not in codes}, out, sentinels)
    return renumber(out)


def renumber(rules: list[Rule]) -> list[Rule]:
    """Ids 1, 2, ... in order; rules without a type go."""
    return [replace(r, rule_id=str(k)) for k, r in enumerate((r for r in rules if r.type), 1)]


def drop_ranges(rules: list[Rule], keys: Iterable[str], fences: dict[str, tuple[float, float]], config: Config = DEFAULT) -> list[Rule]:
    """Without ranges on keys, and without ranges whose bounds are far beyond the fences (lower, upper) of the data."""
    keys, times = set(keys), config.range_fence_multiplier

    def fits(r: Rule) -> bool:
        if r.type != "range":
            return True
        low, high = fences.get(r.column, (None, None))
        least, most = r.params.get("min"), r.params.get("max")
        wild = (most is not None and high is not None and high > 0 and most > high * times) or (least is not None and low is not None and low < 0 and least < low * times)
        return r.column not in keys and not wild

    return [r for r in rules if fits(r)]


def ranges_to_formats(rules: list[Rule], codes: dict[str, int | None]) -> list[Rule]:
    """Ranges on numeric columns meant as text become formats of their dominant number of digits; where there is none they go."""
    out = []
    for r in rules:
        if r.type != "range" or r.column not in codes:
            out.append(r)
        elif codes[r.column]:
            out.append(replace(r, type="format", params={"regex": rf"^\d{{{codes[r.column]}}}$"}))
    return out


_COLUMN = r"""(?:row|df)\[\s*['"](?P<c>[^'"]+)['"]\s*\]"""
_LENGTH = re.compile(rf"^\s*len\(\s*(?:str\(\s*)?{_COLUMN}\s*\)?\s*\)\s*!=\s*(?P<n>\d+)\s*$")
_COUNTED = re.compile(r"(?:\.count\(|value_counts\(|duplicated\(|\.sum\(\)).*>\s*1|duplicated\(")
_FOLDED = re.compile(rf"{_COLUMN}\)?(?:\.strip\(\))?\.(?:lower|upper)\(\)\s+not\s+in\s*[\[(]")
_EQUAL = re.compile(rf"^\s*{_COLUMN}\s*[!=]=\s*(?:'[^']*'|\"[^\"]*\")\s*$")
_MAPPED = re.compile(r"'([^']+)'\s*→\s*'([^']+)'")


def custom_to_typed(rules: list[Rule], actions: dict[str, list[str]] | None = None) -> list[Rule]:
    """Custom rules that say what a typed rule says become that rule: lengths, repeats, phone numbers, and case-folded membership.

    `actions` holds recommended spellings by column, such as `'x' → 'y'`; a case-folded membership becomes a strict one in those spellings.
    """
    out = []
    for r in rules:
        logic = str(r.params.get("logic", "")) if r.type == "custom" else ""
        if m := _LENGTH.match(logic):
            r = replace(r, type="format", column=m["c"], params={"regex": rf"^.{{{m['n']}}}$", "expected_length": int(m["n"])})
        elif logic and _COUNTED.search(logic):
            r = replace(r, type="uniqueness", params={})
        elif logic and "re." in logic and re.search(r"phone|mobile|contact", r.column, re.IGNORECASE):
            r = replace(r, type="phone_validity", params={"country_code": PHONE_COUNTRY, "length": PHONE_LENGTH})
        elif logic and _FOLDED.search(logic) and (good := sorted({b for a in (actions or {}).get(r.column, []) for _, b in _MAPPED.findall(a)})):
            r = replace(r, type="enumeration", params={"values": good})
        out.append(r)
    listed = {r.column for r in out if r.type == "enumeration"}
    return [r for r in out if not (r.type == "custom" and (m := _EQUAL.match(str(r.params.get("logic", "")))) and m["c"] in listed)]


class _WholeWords(ast.NodeTransformer):
    """`'x' in row['c']`, with or without str() and case folding, and `any(v in row['c'] for v in ['x', 'y'])` become searches for whole words."""

    @staticmethod
    def _of_row(n: ast.AST) -> ast.AST | None:
        """The column under str(), lower() and upper(), or None."""
        while isinstance(n, ast.Call):
            if isinstance(n.func, ast.Attribute) and n.func.attr in ("lower", "upper") and not n.args:
                n = n.func.value
            elif isinstance(n.func, ast.Name) and n.func.id == "str" and len(n.args) == 1:
                n = n.args[0]
            else:
                return None
        return n if isinstance(n, ast.Subscript) and isinstance(n.value, ast.Name) and n.value.id in ("row", "df") else None

    @staticmethod
    def _search(words: list[str], column: ast.AST) -> ast.AST:
        pattern = rf"(?<![a-z0-9])(?:{'|'.join(re.escape(w.casefold()) for w in words)})(?![a-z0-9])"
        return ast.parse(f"re.search({pattern!r}, str({ast.unparse(column)}).lower())", mode="eval").body

    def visit_Compare(self, n: ast.Compare) -> ast.AST:
        text = n.left.value if isinstance(n.left, ast.Constant) else None
        column = self._of_row(n.comparators[0]) if len(n.ops) == 1 and isinstance(n.ops[0], (ast.In, ast.NotIn)) else None
        if not isinstance(text, str) or not text or column is None:
            return self.generic_visit(n)
        found = self._search([text], column)
        return found if isinstance(n.ops[0], ast.In) else ast.UnaryOp(ast.Not(), found)

    def visit_Call(self, n: ast.Call) -> ast.AST:
        g = n.args[0] if isinstance(n.func, ast.Name) and n.func.id == "any" and len(n.args) == 1 else None
        if isinstance(g, ast.GeneratorExp) and len(g.generators) == 1 and not g.generators[0].ifs:
            each, test = g.generators[0], g.elt
            words = [e.value for e in each.iter.elts if isinstance(e, ast.Constant) and isinstance(e.value, str) and e.value] if isinstance(each.iter, (ast.List, ast.Tuple, ast.Set)) else []
            if words and len(words) == len(each.iter.elts) and isinstance(test, ast.Compare) and len(test.ops) == 1 and isinstance(test.ops[0], ast.In) and ast.dump(test.left) == ast.dump(ast.Name(getattr(each.target, "id", ""), ast.Load())):
                if (column := self._of_row(test.comparators[0])) is not None:
                    return self._search(words, column)
        return self.generic_visit(n)


def whole_words(rules: list[Rule]) -> list[Rule]:
    """Custom rules on several columns look for whole words, whatever their case, where they looked for a part of a text: `cat` is not in `category`."""
    out = []
    for r in rules:
        logic = str(r.params.get("logic", "")) if r.type == "custom" else ""
        if " in " in logic and len(set(re.findall(_COLUMN.replace("?P<c>", ""), logic))) > 1:
            try:
                tree = _WholeWords().visit(ast.parse(logic, mode="eval"))
                r = replace(r, params=r.params | {"logic": ast.unparse(ast.fix_missing_locations(tree))})
            except SyntaxError:
                pass
        out.append(r)
    return out


def boolean_enumerations(rules: list[Rule], spellings: dict[str, dict[bool, str]]) -> list[Rule]:
    """Enumerations of truth values keep the most frequent spelling of each (column -> truth -> spelling)."""
    known = {*TRUE_SPELLINGS, *FALSE_SPELLINGS}

    def one(r: Rule) -> Rule:
        values = [str(v).strip().lower() for v in r.params.get("values", [])] if r.type == "enumeration" else []
        best = spellings.get(r.column, {})
        return replace(r, params=r.params | {"values": [best[t] for t in (True, False) if t in best]}) if values and best and set(values) <= known else r

    return [one(r) for r in rules]


def clean_up(rules: list[Rule], keys: Iterable[str] = (), fences: dict[str, tuple[float, float]] | None = None, codes: dict[str, int | None] | None = None, actions: dict[str, list[str]] | None = None, spellings: dict[str, dict[bool, str]] | None = None, config: Config = DEFAULT) -> list[Rule]:
    """All passes over proposed rules, in order."""
    rules = ranges_to_formats(drop_ranges(rules, keys, fences or {}, config), codes or {})
    return renumber(boolean_enumerations(whole_words(custom_to_typed(rules, actions)), spellings or {}))


def offline_rules(columns: Iterable[dict]) -> list[Rule]:
    """A fixed policy that stands in for a provider: ids and columns with gaps must be filled, text with few values is enumerated, dates are not in the future.

    `columns` are rows with column, storage_type, missing_count and permissible (a list or None).
    """
    out = []
    for c in columns:
        name = c["column"]
        if is_identifier(name) or c.get("missing_count"):
            out.append(Rule("", "not_null", name, {}, f"{name} must be filled"))
        values = c.get("permissible")
        if values and c.get("storage_type") == "string" and len(values) <= ENUMERATION_VALUES:
            out.append(Rule("", "enumeration", name, {"values": sorted(values)}, f"{name} must be one of {len(values)} values"))
        if c.get("storage_type") == "datetime":
            out.append(Rule("", "date_not_future", name, {}, f"{name} must not be in the future"))
    return renumber(out)
