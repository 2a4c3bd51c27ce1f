"""The whole way from files to dictionaries, relationships, rules and violations."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltmark.config import DEFAULT, Config
from siltmark.functions import canon
from siltmark.operators import casts, detectors, facts, generate, inspection, profile, relations, samples, sketches
from siltmark.operators.histogram import columnar_histogram, is_of, plain_columns, union, value_histogram
from siltmark.operators.identifier import record_identifiers
from siltmark.operators.rules import Clear, Rule, named, results_and_totals, sample_violations, violation_records
from siltmark.plans import judging, related
from siltmark.plans.replies import SUSPECT_RATE, Offline, Provider, Remembering, with_references
from siltmark.sources import readers, sinks

#: Rounds of revising suspect rules.
MAX_ROUNDS = 2
#: Rows that a provider is shown of a table, and values of those that fail a rule.
SAMPLE_ROWS, FAILING_VALUES = 30, 5


@dataclass
class Result:
    dictionaries: dict[str, list[dict]]
    relationships: list[dict]
    rules: dict[str, list[Rule]]
    summaries: dict[str, list[dict]]
    records: dict[str, DataFrame]
    #: Rules that cannot be checked, and why, by rule_id.
    unsupported: dict[str, list[Rule]] = field(default_factory=dict)
    errors: dict[str, dict[str, str]] = field(default_factory=dict)
    #: Rows (rule_id, key) that the provider finds in breach of rules that do not compile, where it looks at rows.
    judged: dict[str, DataFrame] = field(default_factory=dict)
    totals: dict[str, dict] = field(default_factory=dict)
    #: What the provider says of each table, of the relationships and of the whole.
    texts: dict[str, str] = field(default_factory=dict)
    #: Merged relationships, hints, roles, groups, types and odd values, where a report is asked for.
    related: dict[str, list[dict]] = field(default_factory=dict)
    folder: str | None = None


def _numeric(df: DataFrame, kinds: dict[str, str]) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) or kinds.get(f.name) in ("int64", "float64")]


def _kind(df: DataFrame, column: str, text: str) -> str:
    t = df.schema[column].dataType
    return "datetime" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else text


def run_tables(spark: SparkSession, tables: dict[str, DataFrame], provider: Provider | None = None, config: Config = DEFAULT, report: bool = False, columnar: bool = False) -> Result:
    """Profile, relate, propose rules, check them, and revise those that fail nearly everywhere. With `report`, also what a report says of relationships, types and odd values.

    The histogram is read by all steps and kept while they run; with `columnar`, the tables' columns can be read one by one, and are. What reaches the driver is of metadata size; rows that violate a rule stay a DataFrame.
    """
    provider = provider or Offline()
    vh = union([(columnar_histogram if columnar else value_histogram)(df, t) for t, df in tables.items()])
    # each part holds some values of every column: no task has a long column to itself
    vh = vh.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "value").persist()
    plain = plain_columns(tables)
    try:
        local = lambda df: spark.createDataFrame(df.collect(), df.schema)
        shapes = local(profile.shapes(vh))
        found = facts.column_facts(vh, config, shapes)
        types = spark.createDataFrame([(*k, f["storage_type"]) for k, f in found.items()], "table string, column string, storage_type string")
        flags = [k for k, f in found.items() if f.pop("truths")]
        columns = [(t, c) for t, df in tables.items() for c in df.columns]
        kinds = local(sketches.column_kinds(vh, plain, types))
        paths = [r.asDict() for r in relations.join_paths(vh, spark, columns, config, kinds, plain=plain).collect()]
        formats, unique = generate.code_formats(vh, shapes).collect(), generate.uniqueness_candidates(vh, config, types).collect()
        codes = {(r["table"], r["column"]): r["digits"] for r in formats}
        keys = {(r["table"], r["column"]) for r in kinds.where("kind = 'key_like'").collect()}
        truth: dict[tuple[str, str], dict[bool, str]] = {}
        for r in generate.truth_spellings(vh.where(is_of(flags))).collect():
            truth.setdefault((r["table"], r["column"]), {})[r["truth"]] = r["value"]
        declared = inspection.declared_types(tables)
        known = inspection.known_columns(vh, declared, config, plain)
        intended = {(r["table"], r["column"]): r["intended"] for r in known.select("table", "column", "intended").collect()}
        foreign = [tuple(p["child"].split(".", 1)) for p in paths if p["interpretation"] == "foreign_key"]
        errors: dict[tuple[str, str], list[str]] = {}
        faults = inspection.column_errors(vh, declared, foreign, config, known=known, plain=plain).orderBy("table", "column", "fault").collect()
        for r in faults:
            errors.setdefault((r["table"], r["column"]), []).append(f"{r['n']} rows ({r['share']:.1%}) {r['fault'].replace('_', ' ')}" + (f", such as {', '.join(r['examples'])}" if r["examples"] else ""))
        decisions = casts.decide(vh, config)
        ids = {r["table"]: r["column"] for r in record_identifiers(vh).collect()}
        out = Result({}, paths, {}, {}, {})
        if report:
            wrong_columns = spark.createDataFrame([(r["table"], r["column"], r["fault"]) for r in faults], "table string, column string, fault string")
            out.related = related.related(spark, vh, columns, declared, wrong_columns, config)
            out.related["far"] = []
        numbers = {t: [c for c in _numeric(df, {c: f["storage_type"] for (u, c), f in found.items() if u == t}) if (t, c) not in keys] for t, df in tables.items()}
        all_fences = {k: (f.lower, f.upper) for k, f in detectors.histogram_fences(vh, {(t, c): found[t, c]["n_distinct"] for t, cs in numbers.items() for c in cs if (t, c) in found}).items()}
        sentinels = detectors.histogram_sentinels(vh, all_fences).collect() if all_fences else []
        clear = _clear_references(paths, plain)
        for t, df in tables.items():
            profiled = dict(casts.auto_cast(casts.dates_in_bounds(df), t, decisions, upper=True).dtypes)
            more = lambda c: {"intended_type": intended.get((t, c)), "errors": errors.get((t, c), []), "profile_type": (d.schema if (d := decisions.get((t, c))) else None) or profiled[c]}  # noqa: B023, E731
            rows = [found[t, c] | {"storage_type": _kind(df, c, found[t, c]["storage_type"])} | more(c) for c in df.columns if (t, c) in found]
            numeric = numbers[t]
            if report:
                out.related["far"] += related.far_numbers({t: df}, {t: numeric}, config)
            fences = {c: f for (u, c), f in all_fences.items() if u == t}
            once = {c for c in df.columns if (t, c) in plain and found.get((t, c), {}).get("uniqueness") == 1}
            known_clear = lambda rules: [_cleared(r, t, clear, once) for r in rules]  # noqa: B023, E731
            said = with_references(provider.describe(t, [facts.evidence(r, config) for r in rows]), paths, t)
            out.dictionaries[t] = [r | s | {"facts": facts.sentences(r)} for r, s in zip(rows, said, strict=True)]
            coded = {c: n for (u, c), n in codes.items() if u == t and isinstance(df.schema[c].dataType, T.StringType)}
            key = ids.get(t, df.columns[0]) if df.columns else None
            sample = [r.asDict() for r in samples.stratified_sample(df, _odd(df, rows, fences), key, SAMPLE_ROWS).collect()] if key and type(provider) is not Offline else []
            proposed = generate.clean_up(
                provider.propose(t, rows, sample), [c for u, c in keys if u == t], fences, {c: n for c, n in coded.items() if c in numeric},
                {r["column_name"]: r["recommended_actions"] for r in said}, {c: v for (u, c), v in truth.items() if u == t}, config,
            )
            rules = generate.supplement(t, vh, df, proposed, paths, fences, coded, config, unique, formats, [(r["column"], r["value"]) for r in sentinels if r["table"] == t])
            summary, wrong, totals = _check(df, known_clear(rules), tables, config)
            for _ in range(MAX_ROUNDS):
                suspect = _inspected(provider, t, df, rules, [s for s in summary if (s["rate"] or 0) >= SUSPECT_RATE], key, tables, config)
                revised = generate.renumber(provider.revise(t, rules, suspect)) if suspect else rules
                if revised == rules:
                    break
                rules = revised
                summary, wrong, totals = _check(df, known_clear(rules), tables, config)
            out.rules[t], out.summaries[t], out.errors[t] = rules, summary, wrong
            out.unsupported[t] = [named(r) for r in rules if r.rule_id in wrong]
            able = [r for r in rules if r.rule_id not in wrong]
            judge = getattr(provider, "judge", None)
            if out.unsupported[t] and key and judge and (look := judge()):
                out.judged[t] = judging.judged(df, out.unsupported[t], key, look, tables)
            out.totals[t] = totals
            out.texts[t] = provider.summarise(f"The table {t}", [s for r in rows for s in (*[f"{r['column']}: {x}" for x in facts.sentences(r)], *[f"{r['column']}: {x}" for x in r["errors"]])])
            if summary:
                out.records[t] = violation_records(df, known_clear(able), [ids.get(t, df.columns[0])], config, tables)
        out.texts["relationships"] = provider.summarise("Relationships of the tables", sinks.relationship_lines(paths))
        out.texts["overall"] = provider.summarise("All tables", [f"{t}: {out.totals[t]['failing_rows']} of {out.totals[t]['n_rows']} rows break a rule" for t in tables])
        return out
    finally:
        vh.unpersist()


def _odd(df: DataFrame, rows: list[dict], fences: dict[str, tuple[float, float]]) -> Column:
    """Rows that profiling finds fault with: a gap in a column that is mostly filled, or a number beyond the fences."""
    odd = F.lit(False)
    for r in rows:
        c = F.col(f"`{r['column']}`")
        if 0 < r["missing_count"] < r["n_total"] / 2:
            odd = odd | c.isNull()
        if r["column"] in fences:
            low, high = fences[r["column"]]
            number = canon.try_number(c.cast("string"))
            odd = odd | F.coalesce((number < low) | (number > high), F.lit(False))
    return odd


def _inspected(provider: Provider, table: str, df: DataFrame, rules: list[Rule], suspect: list[dict], key: str | None, tables: dict[str, DataFrame], config: Config) -> list[dict]:
    """Suspect rules that the provider assesses as doubtful, each with what it says of them when it has seen some failing values."""
    if not suspect or not key:
        return suspect
    chosen = set(provider.assess(table, rules, suspect))
    doubtful = [r for r in rules if r.rule_id in chosen]
    failing: dict[str, list] = {}
    for r in sample_violations(df, doubtful, [key], FAILING_VALUES, config, tables, skip=True).collect() if doubtful and type(provider) is not Offline else ():
        failing.setdefault(r["rule_id"], []).append(r["value"])
    issues = {r.rule_id: provider.inspect(table, r, failing.get(r.rule_id, [])) for r in doubtful}
    return [s | {"issue": issues[s["rule_id"]]} for s in suspect if s["rule_id"] in issues]


def _clear_references(paths: list[dict], plain: frozenset[tuple[str, str]]) -> set[tuple[str, str, str, str]]:
    """(table, column, parent table, parent column) of columns of whole numbers of which every value is in the other one, as the paths have counted."""
    out = set()
    for p in paths:
        for here, there in ("ab", "ba"):
            if (own := (p[f"table_{here}"], p[f"column_{here}"])) in plain and p["overlap"] == p[f"distinct_{here}"]:
                out.add((*own, p[f"table_{there}"], p[f"column_{there}"]))
    return out


def _cleared(rule: Rule, table: str, references: set[tuple[str, str, str, str]], once: set[str]) -> Rule:
    """A rule that the values of its columns show to hold is not checked row by row."""
    p = named(rule)
    refers = p.type == "referential_cross_table" and (table, p.column, p.params.get("parent_table"), p.params.get("parent_column")) in references
    return Clear(rule.rule_id, rule.type, rule.column, rule.params, rule.text) if refers or (p.type == "uniqueness" and p.column in once) else rule


def _check(df: DataFrame, rules: list[Rule], tables: dict[str, DataFrame], config: Config) -> tuple[list[dict], dict[str, str], dict]:
    """Counts of the rules that can be checked, the errors of those that cannot, and the totals of the former."""
    text = {r.rule_id: r.text for r in rules}
    found, totals = results_and_totals(df, rules, config, tables)
    done = [{k: r[k] for k in ("rule_id", "violations", "rate")} | {"text": text[r["rule_id"]]} for r in found if r["error"] is None]
    return done, {r["rule_id"]: r["error"] for r in found if r["error"] is not None}, totals


def run(spark: SparkSession, paths: list[str], out: str, provider: Provider | None = None, config: Config = DEFAULT, replies: str | None = None) -> Result:
    """Read files, run, and write dictionaries, rules, violations and a report to a new folder under `out`. A provider's answers are kept in the folder `replies` and used again."""
    if provider and replies:
        provider = Remembering(provider, replies)
    tables = {t: readers.clean(df) for t, df in readers.read_all(spark, paths).items()}
    result = run_tables(spark, tables, provider, config, report=True)
    folder = result.folder = sinks.run_folder(out, tables)
    at = lambda name: os.path.join(folder, name)
    for t in tables:
        sinks.write_json(result.dictionaries[t], at(f"{t}_dictionary.json"))
        sinks.write_dictionary_csv(result.dictionaries[t], at(f"{t}_dictionary.csv"))
        sinks.write_json({"rules": [asdict(r) for r in result.rules[t]], "unsupported": [r.rule_id for r in result.unsupported[t]]}, at(f"{t}_rules.json"))
        text = {r.rule_id: r.text for r in result.rules[t]}
        sinks.write_json(result.summaries[t] + [{"rule_id": k, "text": text[k], "error": e} for k, e in result.errors[t].items()], at(f"{t}_checks.json"))
        if t in result.judged:
            sinks.write_rows(result.judged[t], at(f"{t}_judged"))
        if t in result.records:
            sinks.write_rows(result.records[t], at(f"{t}_violations"))
    sinks.write_json(result.relationships, at("relationships.json"))
    sinks.write_json(result.related, at("related.json"))
    payload = sinks.report_payload(result.dictionaries, result.relationships, result.summaries) | {"totals": result.totals, "texts": result.texts, "related": result.related}
    sinks.write_json(payload, at("report.json"))
    text = sinks.report_markdown(payload, result.dictionaries) + "\n" + "\n".join(related.report_lines(result.related))
    for name, body in (("report.md", text), ("report.html", sinks.report_html(text))):
        with open(at(name), "w", encoding="utf-8") as f:
            f.write(body)
    return result
