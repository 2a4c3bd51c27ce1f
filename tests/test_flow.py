import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from siltmark.operators import casts, facts, generate, identifier, samples, sketches
from siltmark.operators.histogram import union, value_histogram
from siltmark.operators.rules import Rule, compile_expression, rule_summary
from siltmark.plans import ordering, pipeline, replies
from siltmark.sources import sinks
from siltmark.streaming.validate import validate_stream


def vh(spark, table="t", **columns):
    names = list(columns)
    rows = list(zip(*columns.values(), strict=True))
    return value_histogram(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)), table)


def test_casts(spark):
    df = spark.createDataFrame([("1", "a", "yes", "2020-01-01", "1.5"), ("2.0", "A", "No", None, " 2 "), (None, "a", "yes", "x", "3"), ("4", "a", None, "", "4")], "i string, s string, f string, my_date string, d string")
    got = casts.decide(value_histogram(df, "t"))
    assert {c: got["t", c].target for c in df.columns} == {"i": "bigint", "s": "category", "f": "category", "my_date": "category", "d": "double"}
    assert got["t", "f"].schema == "categorical" and got["t", "my_date"].schema == "datetime" and got["t", "i"].schema is None
    out = casts.auto_cast(df, "t", got, upper=True)
    assert dict(out.dtypes) == {"i": "bigint", "s": "string", "f": "string", "my_date": "string", "d": "double"}
    assert [r.i for r in out.collect()] == [1, 2, None, 4]
    dates = spark.createDataFrame([(datetime.date(2020, 1, 1), datetime.date(1, 1, 1))], "a date, b date")
    assert dict(casts.dates_in_bounds(dates).dtypes) == {"a": "date", "b": "string"}
    assert casts.drop_duplicate_columns(df, [("i", "d")], dry_run=True) == (df, ["d"])
    ids = casts.with_row_id(spark.range(1000).withColumn("x", -F.col("id")), ["x"])
    assert [r.id for r in casts.row_slice(ids, 10, 3).orderBy("_row_id").collect()] == [989, 988, 987]


def test_sketches(spark):
    a, b = [f"Value {i}" for i in range(400)], [f"value-{i}" for i in range(100, 500)]
    tokens = sketches.value_tokens(union([vh(spark, "a", v=a), vh(spark, "b", v=[f"VALUE  {x[6:]}" for x in b])]))
    exact = sketches.resemblance(tokens).first()
    assert (exact.shared, round(exact.jaccard, 3)) == (300, 0.6)
    estimate = sketches.sketch_resemblance(sketches.minhash(tokens)).first().estimate
    assert abs(estimate - 0.6) < 0.2
    kinds = {r.column: r.kind for r in sketches.column_kinds(vh(spark, my_id=["x1", "x2"], free=["a" * 90, "b" * 99], none=[None, None], c=["p", "p"])).collect()}
    assert kinds == {"my_id": "key_like", "free": "free_text", "none": "empty", "c": "categorical"}


def test_identifier(spark):
    named = lambda **columns: {r.table: r.column for r in identifier.record_identifiers(vh(spark, **columns)).collect()}
    assert named(city=["a", "a"], order_id=["1", "2"], note=["x", "y"]) == {"t": "order_id"}
    assert named(city=["a", "a"]) == {}
    assert named(soc_sec=["1", "1"], other=["p", "q"]) == {"t": "soc_sec"}


def test_coercibility():
    assert facts.coercibility([("XXX-XXXX", 60.0), ("XXX XXXX", 30.0), ("aXX", 10.0)])["coercible"] == [("XXX XXXX", 30.0)]
    for shapes in ([("XX", 60.0), ("XXX", 40.0)], [("X.XX", 60.0), ("X.X", 40.0)], [("aaa aa", 60.0), ("aa-a", 40.0)], [("XX", 100.0)], []):
        assert not facts.coercibility(shapes)["is_coercible"]


def test_generated_rules(spark):
    codes = [str(100000 + i) for i in range(18)] + ["100000", "12"]
    h = vh(spark, code=codes, name=[f"n{i}" for i in range(19)] + ["n0"], flag=["Y"] * 11 + ["n"] * 5 + ["y"] * 4)
    assert [(r.column, r.digits) for r in generate.code_formats(h).collect()] == [("code", 6)]
    assert [r.column for r in generate.uniqueness_candidates(h).collect()] == ["name"]
    assert {(r.truth, r.value) for r in generate.truth_spellings(h).where("column = 'flag'").collect()} == {(True, "Y"), (False, "n")}
    df = spark.createDataFrame([(c, float(i)) for i, c in enumerate(codes)] + [(None, 99999.0)], "code string, x double")
    paths = [{"child": "t.code", "parent": "p.k", "interpretation": "foreign_key"}, {"child": "t.name", "parent": "q.k", "interpretation": "one_to_one_key"}]
    rules = generate.supplement("t", h, df, [], paths, {"x": (-100.0, 200.0)}, ["code"])
    assert [(r.rule_id, r.type, r.column) for r in rules] == [("1", "referential_cross_table", "code"), ("2", "referential_cross_table", "name"), ("3", "uniqueness", "name"), ("4", "format", "code"), ("5", "sentinel_check", "x")]


def test_clean_up():
    rules = [
        Rule("9", "range", "k_id", {"min": 0}), Rule("9", "range", "x", {"max": 5000}), Rule("9", "range", "y", {"max": 20}), Rule("9", "range", "code", {"min": 1}), Rule("9", "", "x"),
        Rule("9", "custom", "c", {"logic": "len(str(row['c'])) != 6"}), Rule("9", "custom", "u", {"logic": "df['u'].duplicated(keep=False)"}), Rule("9", "custom", "phone", {"logic": "not re.match('x', row['phone'])"}),
        Rule("9", "custom", "city", {"logic": "row['city'].lower() not in ['a']"}), Rule("9", "custom", "city", {"logic": "row['city'] == 'b'"}), Rule("9", "enumeration", "flag", {"values": ["yes", "NO"]}),
    ]
    got = generate.clean_up(rules, ["k_id"], {"x": (0.0, 10.0), "y": (0.0, 10.0)}, {"code": 6}, {"city": ["map 'a' → 'A'"]}, {"flag": {True: "Y", False: "N"}})
    assert [(r.rule_id, r.type, r.column) for r in got] == [("1", "range", "y"), ("2", "format", "code"), ("3", "format", "c"), ("4", "uniqueness", "u"), ("5", "phone_validity", "phone"), ("6", "enumeration", "city"), ("7", "enumeration", "flag")]
    assert got[5].params == {"values": ["A"]} and got[6].params == {"values": ["Y", "N"]}


def test_rules_on_other_tables(spark):
    child = spark.createDataFrame([(1, "a"), (2, "z"), (3, None)], "id int, k string")
    tables = {"p": spark.createDataFrame([("a",), ("b",), ("a",)], "k string"), "child": child}
    rules = [Rule("1", "referential", "k", {"ref_table": "p", "ref_column": "k"}), Rule("2", "referential_cross_table", "id", {"parent_table": "child", "parent_column": "id"}), Rule("3", "referential_cross_table", "k", {"parent_table": "no", "parent_column": "k"}), Rule("4", "not_null", "k")]
    assert {r.rule_id: r.violations for r in rule_summary(child, rules, tables=tables, skip=True).collect()} == {"1": 1, "2": 0, "4": 1}


def test_replies():
    row = {"column_name": "a", "description": "d", "recommended_actions": ["'x' → 'x'", "fix", "Fix"]}
    for reply in (json.dumps([row]), f"<think>[1]</think>```json\n{json.dumps([row])}\n```", f"Here: {json.dumps([row])} done", json.dumps(row), f"see {json.dumps(row)}!"):
        assert replies.parse_reply(reply) == [row]
    with pytest.raises(ValueError):
        replies.parse_reply("none")
    with pytest.raises(ValueError):
        replies.checked_rows([row], ["b"])
    assert replies.clean_actions(row["recommended_actions"]) == ["fix"] and replies.clean_actions([]) == [replies.NO_ACTION]
    said = iter(["garbage", json.dumps([row])])
    evidence = [{"column_name": "a", "facts": ["f"]}]
    assert replies.Prompting(lambda p: next(said)).describe("t", evidence)[0]["description"] == "d"
    assert replies.Prompting(lambda p: "garbage").describe("t", evidence)[0]["description"] == "f"
    assert replies.compliance([[{"type": "range", "column": "a"}], [{"type": "odd", "column": "a"}]], ["range"]) == {"valid_type": 0.5, "has_column": 1.0, "consistency": 0.0, "rules": 2}


def test_sinks(tmp_path):
    assert sinks.plain({"a": float("nan"), "b": {2, 1}, "c": datetime.date(2020, 1, 2)}) == {"a": None, "b": [1, 2], "c": "2020-01-02"}
    sinks.write_dictionary_csv([{"a": 1, "l": ["x", "y"]}, {"a": 2, "z": None}], str(tmp_path / "d.csv"))
    assert (tmp_path / "d.csv").read_text().splitlines() == ["a,l,z", "1,x | y,", "2,,"]
    now = datetime.datetime(2024, 1, 2, 3, 4, 5)
    first, second = sinks.run_folder(str(tmp_path), ["a", "b"], now), sinks.run_folder(str(tmp_path), ["a", "b"], now)
    assert os.path.basename(first) == "a_b_2024-01-02_03-04-05" and first != second
    assert sinks.read_json_file(str(tmp_path / "none.json")) is None


def test_whole_run(spark, tmp_path):
    (tmp_path / "departments.csv").write_text("department_id,name\n" + "".join(f"{i},dept {i}\n" for i in range(1, 22)))
    (tmp_path / "staff.csv").write_text("staff_id,department_id,Start Date,grade\n" + "".join(f"{i},{i % 21 + 1 if i % 10 else 99},2020-01-{i % 28 + 1:02},{'AB'[i % 2]}\n" for i in range(1, 61)))
    got = pipeline.run(spark, [str(tmp_path / f"{t}.csv") for t in ("departments", "staff")], str(tmp_path / "out"))
    assert {r["child"] for r in got.relationships} == {"staff.department_id"}
    assert {"relationships.json", "report.md", "report.html", "report.json", "staff_dictionary.csv", "staff_rules.json"} <= set(os.listdir(got.folder))
    by = {(r.type, r.column): s for r, s in zip(got.rules["staff"], got.summaries["staff"], strict=True)}
    assert by["not_null", "staff_id"]["violations"] == 0 and ("enumeration", "grade") in by
    assert {d["column"]: d["role"] for d in got.dictionaries["staff"]}["department_id"] == "foreign_key"
    found = sinks.read_json_file(os.path.join(got.folder, "related.json"))
    assert {(r["table"], r["column"]): r["role"] for r in found["roles"]} == {("departments", "department_id"): "primary_key", ("staff", "department_id"): "foreign_key"}
    assert found["referenced_keys"] == [{"key": "departments.department_id", "children": ["staff.department_id"], "n": 1}]
    assert any(r["table"] == "staff" and "refers to key departments.department_id" in r["hint"] for r in found["hints"])
    assert {g["kind"]: g["n"] for g in found["groups"]}["foreign_key"] == 1 and {r["value"] for r in found["fillers"]} <= {"99", "11", "1", "9"}
    assert sum(r["n_columns"] for r in found["types"]) == 6
    text = open(os.path.join(got.folder, "report.md")).read()
    assert "departments.department_id is referred to by staff.department_id" in text and "## Types" in text


def test_far_numbers(spark):
    from siltmark.plans import related

    df = spark.createDataFrame([(str(k % 20), "x") for k in range(200)] + [("9000", "x"), ("n/a", "x")], "`n` string, t string")
    assert related.far_numbers({"t": df}, {"t": ["n"]}) == [{"table": "t", "column": "n", "n": 1, "least": 9000.0, "most": 9000.0}]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, 5), (2, 50)], "id int, v int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, v int").parquet(str(tmp_path / "in"))
    validate_stream(stream, [Rule("1", "range", "v", {"max": 10})], ["id"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert [r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [2]
    with pytest.raises(ValueError):
        validate_stream(stream, [Rule("1", "uniqueness", "v")], ["id"], "x", "y")


def test_ordinal_domains(spark):
    from siltmark.operators import relations

    rank, other = [str(i) for i in range(1, 8)], [f"{i}.0" for i in range(1, 8)]
    h = union([vh(spark, "a", rank=rank), vh(spark, "b", rank=other)])
    got = relations.classify(relations.overlaps(h, relations.pair_catalog(spark, [("a", "rank"), ("b", "rank")]))).first()
    assert (got.interpretation, got.overlap) == ("unreported_ordinal_domain", 7)


def test_whole_words(spark):
    df = spark.createDataFrame([("Cat food", "x"), ("category", "x"), ("dog", "y"), (None, "x")], "a string, b string")
    cases = {
        "'cat' in str(row['a']).lower() and row['b'] == 'x'": ["Cat food"], "'cat' not in row['a'] and row['b'] == 'x'": ["category"],
        "any(v in str(row['a']).lower() for v in ['cat', 'dog']) and row['b'] != 'x'": ["dog"],
    }
    for logic, want in cases.items():
        (rule,) = generate.whole_words([Rule("1", "custom", "a", {"logic": logic})])
        assert [r.a for r in df.where(compile_expression(df, rule.params["logic"])).collect()] == want
    same = [Rule("1", "custom", "a", {"logic": "'cat' in row['a']"}), Rule("2", "custom", "a", {"logic": "row['b'] in ['x'] and row['a'] == 'y'"}), Rule("3", "custom", "a", {"logic": "row['a'] in ("})]
    assert generate.whole_words(same) == same


def test_stratified_sample(spark):
    df = spark.range(100).withColumn("x", F.when(F.col("id") % 10 != 0, F.col("id")))
    got = [r.id for r in samples.stratified_sample(df, F.col("x").isNull(), "id", 8).collect()]
    assert got[:4] == [0, 10, 20, 30] and len(got) == 8 and all(i % 10 for i in got[4:])
    assert samples.stratified_sample(df, F.lit(None).cast("boolean"), "id", 8).count() == 8
    assert samples.stratified_sample(df.limit(0), F.lit(True), "id", 8).count() == 0
    assert [r.id for r in samples.stratified_sample(df.where("id < 3"), F.col("id") == 1, "id", 8).collect()][0] == 1


def test_ordering():
    names = ["weight", "billing_city", "height", "billing_street", "weight_unit"]
    got = ordering.semantic_chunks([{"column_name": n, "data_type": "string"} for n in names], 3)
    flat = [e["column_name"] for part in got for e in part]
    assert sorted(flat) == sorted(names) and flat[0] == "weight" and max(map(len, got)) <= 3
    assert flat.index("weight_unit") == flat.index("weight") + 1 and abs(flat.index("billing_city") - flat.index("billing_street")) == 1
    assert ordering.semantic_chunks([], 3) == [] and len(ordering.semantic_chunks([{"column_name": "a"}], 3)) == 1
    assert ordering.units_after_values([1, 0], ["LengthUnit", "Length"]) == [1, 0]


class Scripted(replies.Offline):
    """Proposes a rule that fails everywhere, and drops it when it is told so."""

    def __init__(self):
        self.asked, self.sample = [], []

    def propose(self, table, columns, sample=()):
        self.asked.append("propose")
        self.sample = list(sample)
        return [Rule("1", "enumeration", "grade", {"values": ["never"]}), Rule("2", "not_null", "grade")]

    def inspect(self, table, rule, failing):
        self.asked.append(("inspect", rule.rule_id, tuple(failing)))
        return "no value is allowed"

    def revise(self, table, rules, suspect):
        self.asked.append(("revise", tuple((s["rule_id"], s["issue"]) for s in suspect)))
        return [r for r in rules if r.rule_id not in {s["rule_id"] for s in suspect}]


def test_inspection_and_memory(spark, tmp_path):
    (tmp_path / "marks.csv").write_text("mark_id,grade\n" + "".join(f"{i},{'AB'[i % 2] if i % 9 else ''}\n" for i in range(1, 41)))
    provider, kept = Scripted(), str(tmp_path / "replies")
    got = pipeline.run(spark, [str(tmp_path / "marks.csv")], str(tmp_path / "out"), provider, replies=kept)
    assert "enumeration" not in [r.type for r in got.rules["marks"]] and "not_null" in [r.type for r in got.rules["marks"]]
    assert provider.asked[1][:2] == ("inspect", "1") and set(provider.asked[1][2]) <= {"A", "B"} and provider.asked[2] == ("revise", (("1", "no value is allowed"),))
    assert any(r["grade"] is None for r in provider.sample) and len(provider.sample) == pipeline.SAMPLE_ROWS
    again = Scripted()
    assert pipeline.run(spark, [str(tmp_path / "marks.csv")], str(tmp_path / "out"), again, replies=kept).rules == got.rules and again.asked == []


def test_repeats(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "k string")
    assert rule_summary(df, [Rule("1", "uniqueness", "k"), Rule("2", "not_null", "k")]).collect()[0].violations == 2


def test_rows_are_judged_in_batches(spark):
    from siltmark.plans import judging

    df = spark.createDataFrame([(i, f"k{i % 3}", f"v{i}") for i in range(25)], "id int, k string, v string")
    parent = spark.createDataFrame([("k0", "zero"), ("k1", "one"), ("k2", "two"), ("k2", "again")], "k string, name string")
    rules = [Rule("7", "cross_table_semantic", "k", {"parent_table": "p", "parent_column": "k", "join_col": "k", "take": ["name"], "logic": "row['v'] fits"}, "a name of one")]

    def judge(said, rows):
        assert len(rows) <= 4 and set(rows[0]) == {"_key", "k", "v", "p__name"} and said[0]["rule_id"] == "7"
        return judging.read_judgement([{"rule_id": "7", "failing": [r["_key"] for r in rows if r["p__name"] == "one"]}], said, rows)

    got = judging.judged(df, rules, "id", judge, {"p": parent}, batch=4).collect()
    assert {(r.rule_id, r.key) for r in got} == {("7", str(i)) for i in range(25) if i % 3 == 1}
    assert judging.judged(df, [], "id", judge).count() == 0
    for reply in ([], [{"rule_id": "8", "failing": []}], [{"rule_id": "7", "failing": ["99"]}], [{"rule_id": "7", "failing": "1"}]):
        with pytest.raises(ValueError):
            judging.read_judgement(reply, [{"rule_id": "7"}], [{"_key": "1"}])
    call = judging.prompting_judge(lambda prompt: 'so: [{"rule_id": "7", "failing": ["1"]}]')
    assert call([{"rule_id": "7"}], [{"_key": "1"}]) == {"7": ["1"]}


def test_run_lists_types_faults_totals_and_texts(spark):
    df = spark.createDataFrame([(i, f"u{i}@x.com" if i % 9 else "bad", "yes" if i % 2 else "no", str(20230101 + i % 28)) for i in range(60)], "account_id int, email string, member string, day string")
    got = pipeline.run_tables(spark, {"accounts": df})
    rows = {r["column"]: r for r in got.dictionaries["accounts"]}
    assert rows["day"]["intended_type"] == "datetime64[ns]" and rows["member"]["intended_type"] == "bool" and rows["member"]["profile_type"] == "categorical"
    assert any("malformed email" in e and "bad" in e for e in rows["email"]["errors"]) and any("compact date" in e for e in rows["day"]["errors"])
    assert "bad" not in rows["email"]["samples"] and got.totals["accounts"]["n_rows"] == 60
    assert set(got.texts) == {"accounts", "relationships", "overall"} and "break a rule" in got.texts["overall"]
