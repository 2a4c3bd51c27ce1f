"""Validation rules as Columns: true marks a violation. Unknown or unsafe rules are reported as unsupported, never evaluated."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltmark.config import DEFAULT, Config
from siltmark.functions import canon, patterns
from siltmark.operators import dates
from siltmark.operators.expressions import Compiled, Unsupported, compiled


@dataclass(frozen=True)
class Rule:
    rule_id: str
    type: str
    column: str
    params: dict = field(default_factory=dict)
    text: str = ""


#: What a report shows where there is no value.
NOTHING = "—"


@dataclass(frozen=True)
class Failed(Rule):
    """A rule that cannot be checked, and why."""

    error: str = ""


@dataclass(frozen=True)
class Clear(Rule):
    """A rule that no row violates, as is known from the values of its columns: it is not looked at again."""


#: Rules whose columns are named by parameters.
COLUMNS_OF = {"numeric_sum": ("col_a", "col_b", "col_sum"), "date_ordering": ("col_a", "col_b"), "null_consistency": ("col_a", "col_b")}
#: Rules that need other rows, of the table or of another one.
NEEDS_ROWS = ("uniqueness", "numeric_sum", "referential_cross_table")


def _never() -> Column:
    return F.lit(False)


def _moment(df: DataFrame, column: str, config: Config) -> Column:
    """The dates of a column. Texts in which day and month may change places are read in the order that the column's other values tell; on a stream the month comes first."""
    c = df[column]
    if df.schema[column].dataType.simpleString() in ("date", "timestamp", "timestamp_ntz"):
        return c.cast("timestamp")
    if df.schema[column].dataType.simpleString() != "string":
        return canon.try_date(c.cast("string"), config.date_formats)
    # a subquery of one row, over this column alone
    return dates.parse(c, None if df.isStreaming else df.agg(dates.days_lead(c)).scalar(), config.date_formats)


def compile_rule(df: DataFrame, rule: Rule, config: Config = DEFAULT) -> Column:
    """The violation mask of a rule that needs no other rows; null masks count as no violation. A rule on a column that is not there is Unsupported."""
    p, c = rule.params, rule.column
    kind = lambda name: df.schema[name].dataType
    needed = [p.get(k) for k in COLUMNS_OF[rule.type]] if rule.type in COLUMNS_OF else [] if rule.type == "custom" else [c]
    if rule.type.startswith("nric"):
        needed.append(p.get("col_b"))
    if absent := [x for x in needed if x not in df.columns]:
        raise Unsupported(f"{rule.type} needs columns that are not there: {absent}")
    raw = df[c] if c in df.columns else F.lit(None)
    s = canon.strip(canon.text(df[c], kind(c))) if c in df.columns else F.lit(None).cast("string")
    filled = s.isNotNull() & (s != "")
    number = canon.try_number(s)
    if rule.type == "format":
        bad = filled & ~patterns.matches(s, p["regex"]) if "regex" in p else _never()
        if p.get("pattern_name") == "datetime_string":
            bad = bad | (filled & dates.parse(s, formats=config.date_formats).isNull())
        if "expected_length" in p:
            bad = bad | (filled & (F.char_length(s) != p["expected_length"]))
        mask = bad
    elif rule.type == "enumeration":
        mask = raw.isNotNull() & ~s.isin(*[str(v) for v in p["values"]])
    elif rule.type == "numeric_sum":
        a, b, t = (canon.try_number(canon.text(df[p[k]], kind(p[k]))) for k in ("col_a", "col_b", "col_sum"))
        whole = a.isNotNull() & b.isNotNull() & t.isNotNull()
        # a subquery of one row: it runs with the query that asks for the mask
        scale = df.where(whole).agg(F.avg(F.abs(t))).scalar()
        mask = whole & (F.abs(a + b - t) > F.when(scale > 0, 0.01 * scale).otherwise(0.01))
    elif rule.type == "date_ordering":
        a, b = (_moment(df, p[k], config) for k in ("col_a", "col_b"))
        mask = a > b
    elif rule.type == "null_consistency":
        mask = df[p["col_a"]].isNotNull() & df[p["col_b"]].isNull()
    elif rule.type == "valid_yyyymmdd_date":
        d = canon.key_text(s)
        mask = filled & (~d.rlike(r"^\d{8}$") | canon.try_date(d, ("yyyyMMdd",)).isNull())
    elif rule.type == "numeric_parseable":
        mask = filled & number.isNull()
    elif rule.type == "integer_parseable":
        mask = filled & (number.isNull() | (number != F.floor(number)))
    elif rule.type == "datetime_parseable":
        mask = filled & dates.parse(s, formats=config.date_formats).isNull()
    elif rule.type == "date_not_future":
        cutoff = F.lit(p["cutoff"]).cast("timestamp") if "cutoff" in p else F.date_trunc("day", F.current_timestamp())
        mask = _moment(df, c, config) > cutoff
    elif rule.type == "sentinel_check":
        strings = [str(v) for v in p.get("strings", [])]
        numbers = [float(v) for v in p.get("numbers", [])]
        mask = (s.isin(*strings) if strings else _never()) | (number.isin(*numbers) if numbers else _never())
    elif rule.type == "not_null":
        mask = raw.isNull()
    elif rule.type == "range":
        low = number < float(p["min"]) if p.get("min") is not None else _never()
        high = number > float(p["max"]) if p.get("max") is not None else _never()
        mask = low | high
    elif rule.type == "phone_validity":
        cc, n = p.get("country_code"), int(p.get("length", 8))
        mask = filled & ~canon.matches(s, (rf"\+?{re.escape(str(cc))}[\s-]?" if cc else "") + rf"\d{{{n}}}", full=True)
    elif rule.type in ("nric_age_consistency", "nric_dob_consistency"):
        year = F.year(F.current_date())
        two = F.substring(s, 2, 2).try_cast("int")
        born = F.when(F.substring(s, 1, 1) == "T", 2000 + two).when(two <= year % 100, 2000 + two).otherwise(1900 + two)
        other = canon.text(df[p["col_b"]], kind(p["col_b"]))
        valid = s.rlike(r"^[STFG]\d{7}[A-Z]$")
        mask = valid & (F.year(canon.try_date(other, config.date_formats)) != born if p.get("check_mode") == "dob" or rule.type == "nric_dob_consistency" else F.abs(year - born - canon.try_number(other)) > 2)
    elif rule.type == "custom":
        mask = compile_expression(df, p["logic"], config)
    else:
        raise Unsupported(rule.type)
    return F.coalesce(mask, F.lit(False))


def compile_expression(df: DataFrame, text: str, config: Config = DEFAULT) -> Column:
    """The rows for which an expression holds; see `expressions.compiled`. Rows on which it cannot be evaluated are none of them."""
    return compiled(df, text, config).mask


def compile_checked(df: DataFrame, rule: Rule, config: Config = DEFAULT) -> Compiled:
    """The violation mask of a rule, and the rows on which it cannot be evaluated; analysed by itself, so that what is wrong with it is known here."""
    made = compiled(df, rule.params["logic"], config) if rule.type == "custom" else Compiled(compile_rule(df, rule, config), None)
    df.select(made.mask, *([] if made.raises is None else [made.raises]))
    return made


def referential(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose value is no key of the parent: an anti join, never a collected list of keys."""
    keys = parent.select(canon.key_text(canon.text(parent[key], parent.schema[key].dataType)).alias("_key")).where("_key IS NOT NULL").distinct()
    child = df.withColumn("_key", canon.key_text(canon.text(df[column], df.schema[column].dataType)))
    return child.where(F.col("_key").isNotNull()).join(keys, "_key", "left_anti").select(*df.columns)


def sibling_lookup(df: DataFrame, column: str, parent: DataFrame, key: str, take: list[str]) -> DataFrame:
    """Columns of the parent row with that key; keys that repeat give none."""
    one = parent.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in take]).where("_n = 1").withColumnRenamed(key, column).drop("_n")
    return df.join(one, column, "left")


ALIASES = {"referential": "referential_cross_table"}


def named(rule: Rule) -> Rule:
    """The rule under its usual type and parameter names."""
    p = dict(rule.params)
    for old, new in (("ref_table", "parent_table"), ("ref_column", "parent_column")):
        if old in p:
            p.setdefault(new, p.pop(old))
    for kind, old, new in (("numeric_sum", "col_c", "col_sum"), ("date_not_future", "cutoff_date", "cutoff")):
        if rule.type == kind and old in p:
            p.setdefault(new, p.pop(old))
    if rule.type == "null_consistency":
        p.setdefault("col_a", rule.column)
    if rule.type == "sentinel_check" and "sentinel_values" in p:
        values = p.pop("sentinel_values")
        p.setdefault("strings", [v for v in values if isinstance(v, str)])
        p.setdefault("numbers", [v for v in values if not isinstance(v, str)])
    return replace(rule, type=ALIASES.get(rule.type, rule.type), params=p)


def _orphan(df: DataFrame, rule: Rule, tables: dict[str, DataFrame]) -> tuple[DataFrame, Column]:
    """`df` joined with the distinct keys of the rule's parent, and the mask of rows whose value is none of them."""
    p = rule.params
    if p.get("parent_table") not in tables or p.get("parent_column") not in tables[p["parent_table"]].columns or rule.column not in df.columns:
        raise Unsupported(rule.type)
    parent, key, hit = tables[p["parent_table"]], p["parent_column"], f"_k_{rule.rule_id}"
    # whole numbers meet as such: their texts are equal where they are
    whole = all(isinstance(x, T.IntegralType) for x in (parent.schema[key].dataType, df.schema[rule.column].dataType))
    read = lambda of, c: of[c].cast("long") if whole else canon.key_text(canon.text(of[c], of.schema[c].dataType))
    keys = parent.select(read(parent, key).alias(hit)).where(f"`{hit}` IS NOT NULL").distinct()
    value = read(df, rule.column)
    return df.join(keys, value == keys[hit], "left"), value.isNotNull() & F.col(hit).isNull()


def _repeated(df: DataFrame, rule: Rule) -> tuple[DataFrame, Column]:
    """`df` joined with the values that repeat, and the mask of their rows.

    Only values are shuffled, after map-side counts; few values repeat in a column that should be unique, so that AQE can broadcast them once it
    has measured them. A window would bring all rows of a frequent value, or all gaps, to one task.
    """
    if rule.column not in df.columns:
        raise Unsupported(rule.type)
    hit = f"_u_{rule.rule_id}"
    repeats = df.select(df[rule.column].alias(hit)).where(F.col(hit).isNotNull()).groupBy(hit).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(hit)
    return df.join(repeats, df[rule.column] == repeats[hit], "left"), F.col(hit).isNotNull()


def masks(df: DataFrame, rules: list[Rule], config: Config = DEFAULT, tables: dict[str, DataFrame] | None = None) -> tuple[DataFrame, list[Rule], list[Rule]]:
    """`df` with one boolean column `_v_<id>` for each rule, in one projection; and the rules that compiled and those that did not, each with its error.

    A rule that some rows may raise on also has `_e_<id>`, which is true for those. Each rule is compiled and analysed by itself, so that one that is wrong
    costs no other. Rules on another table join its distinct keys, one join for each such rule; they need `tables`. Uniqueness joins the values that repeat.
    """
    done, out, failed = [], [], []
    for r in map(named, rules):
        try:
            if isinstance(r, Clear):
                made = Compiled(F.lit(False), None)
            elif r.type in ("referential_cross_table", "uniqueness"):
                df, bad = _orphan(df, r, tables or {}) if r.type == "referential_cross_table" else _repeated(df, r)
                made = Compiled(F.coalesce(bad, F.lit(False)), None)
            else:
                made = compile_checked(df, r, config)
        except PySparkException as e:
            failed.append(Failed(**vars(r), error=str(e).splitlines()[0]))
        except KeyError as e:
            failed.append(Failed(**vars(r), error=f"no parameter {e}"))
        except (ValueError, TypeError, AttributeError) as e:
            failed.append(Failed(**vars(r), error=str(e)))
        else:
            out.append(made.mask.alias(f"_v_{r.rule_id}"))
            if made.raises is not None:
                out.append(made.raises.alias(f"_e_{r.rule_id}"))
            done.append(r)
    return df.select("*", *out), done, failed


def rule_results(df: DataFrame, rules: list[Rule], config: Config = DEFAULT, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Each rule with rule_id, type, column, n_rows, violations, rate, passed and error, in one aggregation.

    A rule that does not compile, or that cannot be evaluated on some row, has an error and no counts; the others are not touched by it.
    """
    marked, done, failed = masks(df, rules, config, tables)
    found = _results(marked, rules, done, failed)
    if not found:
        return df.sparkSession.createDataFrame([], "rule_id string, type string, column string, n_rows long, violations long, rate double, passed boolean, error string")
    return marked.agg(F.array(*found).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def results_and_totals(df: DataFrame, rules: list[Rule], config: Config = DEFAULT, tables: dict[str, DataFrame] | None = None) -> tuple[list[dict], dict]:
    """The rows of `rule_results`, and `rule_totals` of the rules without an error, in one pass, or two where rules cannot be evaluated on some row."""
    marked, done, failed = masks(df, rules, config, tables)
    found = _results(marked, rules, done, failed)
    results = F.array(*found) if found else F.array().cast("array<struct<error:string>>")
    row = marked.agg(results.alias("_results"), *_totals(done)).first().asDict(recursive=True)
    out = row.pop("_results")
    if len(able := {r["rule_id"] for r in out if r["error"] is None}) < len(done):
        row = rule_totals(df, [r for r in rules if r.rule_id in able], config, tables).first().asDict()
    return out, row


def _results(marked: DataFrame, rules: list[Rule], done: list[Rule], failed: list[Rule]) -> list[Column]:
    total, parts = F.count(F.lit(1)), []
    for r in done:
        e = f"_e_{r.rule_id}"
        wrong = F.count_if(F.col(f"`{e}`")) if e in marked.columns else F.lit(0).cast("long")
        n = F.when(wrong == 0, F.count_if(F.col(f"`_v_{r.rule_id}`")))
        error = F.when(wrong > 0, F.concat(F.lit("cannot be evaluated on "), wrong.cast("string"), F.lit(" rows")))
        parts.append((r, n, error))
    parts += [(r, F.lit(None).cast("long"), F.lit(r.error)) for r in failed]
    order = {r.rule_id: k for k, r in enumerate(rules)}
    parts.sort(key=lambda p: order[p[0].rule_id])
    return [F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.type).alias("type"), F.lit(r.column).alias("column"), total.alias("n_rows"), n.alias("violations"), F.round(F.try_divide(n, total), 3).alias("rate"), (n == 0).alias("passed"), error.alias("error")) for r, n, error in parts]


def _marked(df: DataFrame, rules: list[Rule], config: Config, tables: dict[str, DataFrame] | None, skip: bool) -> tuple[DataFrame, list[Rule]]:
    """`df` with masks and the rules that they are of. Rules that do not compile end this, or are passed over where the caller lists them itself."""
    marked, done, failed = masks(df, rules, config, tables)
    if failed and not skip:
        raise Unsupported(f"rules that cannot be checked: {[(r.rule_id, r.type, r.error) for r in failed]}")
    return marked, done


def rule_summary(df: DataFrame, rules: list[Rule], config: Config = DEFAULT, tables: dict[str, DataFrame] | None = None, skip: bool = False) -> DataFrame:
    """Violations and their rate for each rule, in one pass. Unsupported rules raise, or are passed over with `skip`."""
    marked, done = _marked(df, rules, config, tables, skip)
    total = F.count(F.lit(1))
    parts = [F.struct(F.lit(r.rule_id).alias("rule_id"), F.count_if(F.col(f"_v_{r.rule_id}")).alias("violations"), F.round(F.try_divide(F.count_if(F.col(f"_v_{r.rule_id}")), total), 3).alias("rate")) for r in done]
    if not parts:
        return df.sparkSession.createDataFrame([], "rule_id string, violations long, rate double")
    return marked.agg(F.array(*parts).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def rule_totals(df: DataFrame, rules: list[Rule], config: Config = DEFAULT, tables: dict[str, DataFrame] | None = None, skip: bool = False) -> DataFrame:
    """One row: rows that were checked, rules, rules that some row violates, and rows that violate some rule, each counted once."""
    marked, done = _marked(df, rules, config, tables, skip)
    return marked.agg(*_totals(done))


def _totals(done: list[Rule]) -> list[Column]:
    each = [F.coalesce(F.bool_or(F.col(f"_v_{r.rule_id}")), F.lit(False)).cast("long") for r in done]
    some = reduce(lambda a, b: a | b, [F.col(f"_v_{r.rule_id}") for r in done], F.lit(False))
    return [F.count(F.lit(1)).alias("n_rows"), F.lit(len(done)).cast("long").alias("n_rules"), sum(each, F.lit(0)).cast("long").alias("rules_violated"), F.count_if(some).alias("failing_rows")]


def _failures(df: DataFrame, done: list[Rule]) -> Column:
    """The violations of a row: rule_id, label (`#id: text`), column, and the value that failed (that of `col_b` where the rule names a second column)."""
    parts = []
    for r in done:
        second = r.params.get("col_b")
        column = second if second in df.columns and second != r.column else r.column if r.column in df.columns else next((c for c in (r.params.get("col_a"), *r.params.get("related_cols", ())) if c in df.columns), None)
        value = canon.text(F.col(f"`{column}`"), df.schema[column].dataType) if column else F.lit(NOTHING)
        shown = F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(f"#{r.rule_id}: {r.text}").alias("label"), F.lit(column or NOTHING).alias("column"), value.alias("value"))
        parts.append(F.when(F.col(f"_v_{r.rule_id}"), shown))
    empty = F.array().cast("array<struct<rule_id:string,label:string,column:string,value:string>>")
    return F.array_compact(F.array(*parts)) if parts else empty


def violation_records(df: DataFrame, rules: list[Rule], keys: list[str], config: Config = DEFAULT, tables: dict[str, DataFrame] | None = None, skip: bool = False) -> DataFrame:
    """Rows that violate some rule, without a shuffle where no rule needs one: keys, rules (ids), n_rules, and for a report failed_columns and failed_values
    (each pair of them once, in the order of rules; a gap is shown as `—`) and labels."""
    marked, done = _marked(df, rules, config, tables, skip)
    rows = marked.withColumn("_f", _failures(df, done)).where(F.size("_f") > 0)
    pairs = F.array_distinct(F.transform("_f", lambda f: F.struct(f["column"].alias("c"), F.coalesce(f["value"], F.lit(NOTHING)).alias("v"))))
    joined = lambda sep, a, get: F.array_join(F.transform(a, get), sep)
    return rows.select(
        *keys,
        joined(" | ", "_f", lambda f: f["rule_id"]).alias("rules"),
        F.size("_f").cast("long").alias("n_rules"),
        joined(", ", pairs, lambda x: x["c"]).alias("failed_columns"),
        joined(" | ", pairs, lambda x: x["v"]).alias("failed_values"),
        joined(" | ", "_f", lambda f: f["label"]).alias("labels"),
    )


def failed_values(df: DataFrame, rules: list[Rule], keys: list[str], config: Config = DEFAULT, tables: dict[str, DataFrame] | None = None, skip: bool = False) -> DataFrame:
    """One row for each violation: keys, rule_id, column and the value that failed."""
    marked, done = _marked(df, rules, config, tables, skip)
    return marked.select(*keys, F.explode(_failures(df, done)).alias("_f")).select(*keys, "_f.rule_id", "_f.column", "_f.value")


def sample_violations(df: DataFrame, rules: list[Rule], keys: list[str], k: int = 5, config: Config = DEFAULT, tables: dict[str, DataFrame] | None = None, skip: bool = False) -> DataFrame:
    """The first k violations of each rule by the keys, which is what a report shows."""
    w = Window.partitionBy("rule_id").orderBy(*keys)
    return failed_values(df, rules, keys, config, tables, skip).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
