"""Rules that fail alone: patterns and expressions against Python itself, and bad rules beside good ones."""

import re

import pytest
from pyspark.sql import functions as F

from siltmark.functions.patterns import BadPattern, matches, to_java
from siltmark.operators.expressions import compiled
from siltmark.operators.rules import Rule, Unsupported, masks, rule_results, rule_summary, violation_records
from siltmark.plans import pipeline
from siltmark.plans.replies import Offline

PATTERNS = [
    r"[A-Z]+\Z", r"^\d{3}$", r"(?P<a_b>x)-(?P=a_b)", r"[[]a", r"[]a]+", r"[^]a]+", r"a&&b|[a&&b]", r"x{,2}y", r"a{x}", r"{a}", r"a{2}", r"(?i)ÄB", r"\w+\s\w+", r"a.b", r"a$", r"(?s)a.b",
    r"(?m)^b", r"\.\-/", r"(?:a|b)+?c", r"(a)\1", r"(?=a)a", r"(?<!x)b", r"\u0041", r"\U0001F600", r"\x41", r"\0", r"a|", r"", r"[\]x]", r"[a\-z]", r"[\w.]+@", r"é", r"[+--]", r"\$\{x\}", r"}",
]
TEXTS = ["", "ABC", "ABC\n", "123", "١٢٣", "x-x", "x-y", "[a", "]a", "b", "a&&b", "&", "xxy", "xy", "a{x}", "{a}", "aa", "äb", "ÄB", "é è", "a\nb", "a\rb", "a\u0085b", "a", "a\n", "a\r\n", "b\nb", ".-/", "abc", "ab", "xb", "A", "😀", "\0", "]x", "a-z", "-", "w.@", "${x}", "}", "+"]


@pytest.mark.parametrize("mode", ["match", "search", "fullmatch"])
def test_patterns_mean_the_same(spark, mode):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string")
    row = df.agg(*[F.array_sort(F.collect_list(F.when(matches(F.col("t"), p, full=mode == "fullmatch", search=mode == "search"), F.col("k")))).alias(f"p{i}") for i, p in enumerate(PATTERNS)]).first()
    for i, p in enumerate(PATTERNS):
        assert row[f"p{i}"] == [k for k, t in enumerate(TEXTS) if getattr(re, mode)(p, t)], p


@pytest.mark.parametrize("pattern", ["([A-Z", "(?P<1>a)", "*", r"\q", "(?(1)a|b)", "(?a)x", r"\N{DIGIT ONE}", "a{99999999999}", None, 3])
def test_patterns_that_are_refused(spark, pattern):
    with pytest.raises(BadPattern):
        matches(F.col("t"), pattern)


def test_names_and_ends_of_patterns():
    assert to_java(r"(?P<a_1>x)(?P=a_1)\Z") == r"(?d)(x)(?:\1)\z"


EXPRESSIONS = [
    "row['n'] > 3", "row['t'] > 5", "row['t'] == 5", "row['t'] != 5", "row['t'] + row['u'] == 'ab1'", "row['t'] + row['n'] > 1", "len(row['t']) > 1", "len(row['n']) > 1", "row['t'][0] == 'a'", "row['t'][-1] == '1'",
    "row['t'][1:3] == 'bc'", "row['t'][:-1] == 'ab'", "float(row['t']) > 2", "int(row['t']) == 12", "int(row['x']) == -1", "row['t'].isdigit() and int(row['t']) > 3", "not row['t']", "row['n'] and row['t']", "row['b'] == 1",
    "row['b'] + 1 == 2", "row['n'] in [1, '2', 3.0]", "row['t'] in ['a', 1]", "'b' in row['t']", "'b' in row['n']", "row['t'].upper().startswith('A')", "row['n'].upper() == 'A'", "re.search('[0-9]', row['t'])", "re.match('a', row['n'])",
    "1 < row['n'] < 7", "row['t'] < row['n'] < 2", "row['n'] > 5 or float(row['t']) > 1", "row['t'] if row['n'] > 3 else row['u']", "isinstance(row['t'], str) and row['n'] % -4 == -1", "abs(row['x']) > 1.4", "-row['n'] < -3", "str(row['n']) == '4'",
    "row['t'].replace('a', 'b') == 'bb'", "row['t'].isalpha()", "row['t'].isupper()", "bool(row['t']) == row['b']", "row['n'] * 9223372036854775807 > 0",
]
ROWS = [(0, 4, "ab", "1", 1.5, True), (1, -3, "", "x", -1.9, False), (2, 0, "12", "ab1", 0.0, True), (3, 7, "abc", "", 2.25, False), (4, 3, "A1", "b", -0.5, True), (5, 1, "3.5", "ab", 1e300, False)]


@pytest.mark.parametrize("text", EXPRESSIONS)
def test_expressions_are_those_of_python(spark, text):
    df = spark.createDataFrame(ROWS, "k int, n long, t string, u string, x double, b boolean")
    made = compiled(df, text)
    got = {r[0]: (r[1], r[2]) for r in df.select("k", made.mask, F.lit(False) if made.raises is None else made.raises).collect()}
    for row in ROWS:
        try:
            want = (bool(eval(text, {"row": dict(zip("kntuxb", row, strict=True)), "re": re})), False)
        except (TypeError, ValueError, AttributeError, IndexError):
            want = (False, True)
        if "9223372036854775807" in text and abs(row[1]) > 1:
            want = (False, True)  # no number of 64 bits
        assert got[row[0]] == want, (text, row)


def test_gaps_and_what_is_refused(spark):
    df = spark.createDataFrame([(1, None, None), (2, "a", 1)], "k int, t string, n int")
    held = lambda text: [r[0] for r in df.where(compiled(df, text).mask).select("k").orderBy("k").collect()]
    assert held("row['t'] != 'a'") == [1] and held("row['n'] > 0") == [2] and held("pd.isna(row['t'])") == [1] and held("row['t'] + 'b' == 'ab'") == [2]
    assert held("pd.isna(pd.to_numeric(row['t']))") == [2] and held("row['t'] == row['n']") == [1, 2]
    for text in ("eval('1')", "row['absent'] > 1", "row['t'] * 2 == 'aa'", "[x for x in row]", "row['t'].__class__", "open('x')", "row['t'] is None", "((", "1" * 5000):
        with pytest.raises(Unsupported):
            compiled(df, text)


def test_one_bad_rule_among_ten(spark):
    df = spark.createDataFrame([(k, f"v{k}", float(k)) for k in range(20)], "id long, t string, x double")
    good = [Rule(f"g{k}", "range", "x", {"max": k}) for k in range(9)]
    for bad, why in ((Rule("b", "format", "t", {"regex": "(["}), "pattern"), (Rule("b", "custom", "t", {"logic": "row['t'] > 5"}), "20 rows"), (Rule("b", "custom", "t", {"logic": "row['x'].strip() == ''"}), "20 rows"), (Rule("b", "range", "x", {"min": "low"}), "float"), (Rule("b", "no such type", "t"), "no such type"), (Rule("b", "custom", "t", {}), "logic")):
        found = {r.rule_id: r for r in rule_results(df, [*good[:4], bad, *good[4:]]).collect()}
        assert [found[f"g{k}"].violations for k in range(9)] == [19 - k for k in range(9)] and not any(found[f"g{k}"].error for k in range(9))
        assert found["b"].violations is None and why in found["b"].error
    assert rule_results(df, []).collect() == [] and rule_results(df.limit(0), good[:1]).first().violations == 0
    with pytest.raises(Unsupported):
        rule_summary(df, [*good, Rule("b", "format", "t", {"regex": "(["})])
    assert violation_records(df, [Rule("c", "custom", "t", {"logic": "int(row['t'][1:]) > 17"})], ["id"]).count() == 2


def test_parameters_by_other_names(spark):
    df = spark.createDataFrame([(1, 2, 3, "2020-01-01"), (1, 2, 9, "2031-01-01")], "a int, b int, c int, d string")
    found = masks(df, [Rule("s", "numeric_sum", "c", {"col_a": "a", "col_b": "b", "col_c": "c"}), Rule("f", "date_not_future", "d", {"cutoff_date": "2025-01-01"}), Rule("n", "null_consistency", "a", {"col_b": "b"})])
    assert [tuple(r) for r in found[0].orderBy("c").select("_v_s", "_v_f", "_v_n").collect()] == [(False, False, False), (True, True, False)] and not found[2]


class Proposing(Offline):
    def propose(self, table, rows, sample=()):
        return [Rule("1", "range", "x", {"max": 4}, "small"), Rule("2", "custom", "t", {"logic": "row['t'] > 5"}, "clash"), Rule("3", "format", "t", {"regex": "(["}, "broken")]


def test_the_run_lists_what_cannot_be_checked(spark):
    df = spark.createDataFrame([(k, f"v{k}", float(k)) for k in range(20)], "id long, t string, x double")
    found = pipeline.run_tables(spark, {"t": df}, Proposing())
    wrong = {r.text: found.errors["t"][r.rule_id] for r in found.rules["t"] if r.rule_id in found.errors["t"]}
    assert "20 rows" in wrong["clash"] and "pattern" in wrong["broken"] and len(found.unsupported["t"]) == 2
    assert {s["text"]: s["violations"] for s in found.summaries["t"]}["small"] == 15 and found.records["t"].count() == found.totals["t"]["failing_rows"]
