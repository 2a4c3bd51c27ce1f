import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siltmark.functions import canon
from siltmark.operators import detectors, names, profile, relations
from siltmark.operators.histogram import value_histogram
from siltmark.operators.rules import Rule, Unsupported, compile_expression, masks, referential, rule_summary, rule_totals, sibling_lookup, violation_records
from siltmark.plans import registry
from siltmark.sources import readers

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got, want = registry.queries()[name](spark, DATA).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(map(str, d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries())


def bad(spark, rows, schema, rule):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in masks(df, [rule])[0].where(f"`_v_{rule.rule_id}`").select(df.columns[0]).orderBy(df.columns[0]).collect()]


@pytest.mark.parametrize(
    ("rule", "values", "want"),
    [
        (Rule("a", "format", "v", {"regex": r"\d+$"}), ["12", "x", None, "", "1x"], [1, 4]),
        (Rule("a", "enumeration", "v", {"values": ["a", "b"]}), ["a", "A", None, "b "], [1]),
        (Rule("a", "valid_yyyymmdd_date", "v"), ["20230101", "20230230", "2023", None, "20230101.0"], [1, 2]),
        (Rule("a", "numeric_parseable", "v"), ["1", "x", "nan", None, " 2 "], [1, 2]),
        (Rule("a", "integer_parseable", "v"), ["1", "1.0", "1.5", "x", None], [2, 3]),
        (Rule("a", "datetime_parseable", "v"), ["2023-01-01", "2023/02/15", "March 1, 2023", "2023-13-01", None], [3]),
        (Rule("a", "date_not_future", "v", {"cutoff": "2023-06-01"}), ["2023-01-01", "2024-01-01", "x"], [1]),
        (Rule("a", "sentinel_check", "v", {"numbers": [99999]}), ["99999", "1", "99999.0", None], [0, 2]),
        (Rule("a", "not_null", "v"), ["x", None, "n/a"], [1]),
        (Rule("a", "range", "v", {"min": 0, "max": 10}), ["0", "10", "-1", "11", "x", None], [2, 3]),
        (Rule("a", "uniqueness", "v"), ["a", "b", "a", None, None], [0, 2]),
        (Rule("a", "phone_validity", "v", {"country_code": 65}), ["+65 91234567", "6591234567", "123", None], [2]),
    ],
)
def test_rules(spark, rule, values, want):
    assert bad(spark, list(enumerate(values)), "id int, v string", rule) == want


def test_pair_rules(spark):
    rows = [(0, "2023-01-02", "2023-01-01"), (1, "2023-01-01", "2023-01-02"), (2, "2023-01-01", None)]
    assert bad(spark, rows, "id int, a string, b string", Rule("r", "date_ordering", "", {"col_a": "a", "col_b": "b"})) == [0]
    assert bad(spark, rows, "id int, a string, b string", Rule("r", "null_consistency", "", {"col_a": "a", "col_b": "b"})) == [2]
    sums = [(0, 1.0, 2.0, 3.0), (1, 1.0, 2.0, 4.0), (2, None, 2.0, 9.0)]
    assert bad(spark, sums, "id int, a double, b double, c double", Rule("r", "numeric_sum", "", {"col_a": "a", "col_b": "b", "col_sum": "c"})) == [1]
    assert bad(spark, [(0, "S9012345A", "1990-05-01"), (1, "S9012345A", "1985-05-01")], "id int, n string, dob string", Rule("r", "nric_dob_consistency", "n", {"col_b": "dob", "check_mode": "dob"})) == [1]


def test_expressions(spark):
    df = spark.createDataFrame([(1.0, 2.0, "ab")], "a double, b double, s string")
    for text, want in (("row['a'] + row['b'] == 3", True), ("len(row['s']) > 2", False), ("row['s'].upper() in ['AB']", True), ("re.match('a.', row['s']) and not pd.isna(row['a'])", True), ("1 < row['b'] < 3", True)):
        assert df.select(compile_expression(df, text)).first()[0] is want
    for text in ("__import__('os')", "row['a'].__class__", "[x for x in row]", "row['zz'] > 1", "open('x')"):
        with pytest.raises(Unsupported):
            compile_expression(df, text)
    assert [r.rule_id for r in masks(df, [Rule("x", "custom", "a", {"logic": "eval('1')"}), Rule("y", "cross_table_semantic", "a")])[2]] == ["x", "y"]


def test_rules_that_cannot_be_checked(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, v string")
    for rule in (Rule("1", "not_null", "absent"), Rule("1", "format", "absent", {"regex": "x"}), Rule("1", "date_ordering", "v", {"col_a": "v", "col_b": "absent"}), Rule("1", "custom", "v", {"logic": "row['absent'] > 1"}), Rule("1", "referential", "v", {"ref_table": "t", "ref_column": "k"})):
        assert masks(df, [rule])[2]
        for checked in (rule_summary, rule_totals):
            with pytest.raises(Unsupported):
                checked(df, [rule])
            assert checked(df, [rule], skip=True).columns
        with pytest.raises(Unsupported):
            violation_records(df, [rule], ["id"])
        assert violation_records(df, [rule], ["id"], skip=True).count() == 0


def test_expressions_read_gaps_and_remainders_as_python_does(spark):
    df = spark.createDataFrame([(1, -7, "x"), (2, 7, None), (3, None, "y"), (4, 0, "x")], "id int, n int, v string")
    hits = lambda logic: [r.id for r in df.where(compile_expression(df, logic)).orderBy("id").collect()]
    assert hits("row['n'] % 3 == 2") == [1] and hits("row['n'] % -3 == -2") == [2] and hits("row['n'] % 0 == 0") == []
    assert hits("row['v'] != 'x'") == [2, 3] and hits("row['v'] == 'x'") == [1, 4] and hits("not row['n'] > 0") == [1, 3, 4]
    assert hits("row['v'] not in ['x']") == [2, 3] and hits("row['v'] in ['x']") == [1, 4]


def test_referential_and_sibling(spark):
    child = spark.createDataFrame([(1, "10.05"), (2, "7"), (3, None), (4, "1.0")], "id int, k string")
    parent = spark.createDataFrame([("10.05", "x"), ("1", "y"), ("2", "p"), ("2", "q")], "k string, v string")
    assert [r.id for r in referential(child, "k", parent, "k").collect()] == [2]
    got = sibling_lookup(spark.createDataFrame([("1",), ("2",), ("9",)], "k string"), "k", parent, "k", ["v"])
    assert {r.k: r.v for r in got.collect()} == {"1": "y", "2": None, "9": None}


def test_detectors(spark):
    def vh(values):
        return value_histogram(spark.createDataFrame([(v,) for v in values], "c string"), "t")

    e = detectors.email_issues(vh(["a@x.com", "bad", "A@x.com", "unknown@y.com", "a+b@x.com", None, "n/a"])).first()
    assert (e.malformed, e.mixed_case, e.placeholder_local, e.plus_tag, e.n_domains) == (1, 1, 1, 1, 2)
    assert detectors.boolean_spellings(vh(["Yes", "no", None])).count() == 1
    assert detectors.boolean_spellings(vh(["True", "False"])).count() == 0
    assert detectors.date_issues(vh(["2023-01-01", "20230101", "2023-13-01"])).first().unparseable == 1
    c = detectors.code_issues(vh(["123456", "223456", "323456", "12345"])).first()
    assert (c.dominant_length, c.shorter, c.digit_share) == (6, 1, 1.0)
    pairs = detectors.near_duplicate_values(vh(["springfield avenue north", "springfield avenue northe", "elsewhere"])).collect()
    assert len(pairs) == 1
    rows = spark.createDataFrame([(float(i % 50),) for i in range(200)] + [(99999.0,)] * 5 + [(-1.0,)], "x double")
    assert [r.value for r in detectors.sentinels(rows, "x").collect()] == [99999.0]
    assert detectors.sign_anomalies(rows, "x").first().n_odd == 1
    # five of 206 are the sentinel, so the 99.9 % quantile is the sentinel itself and nothing lies beyond it
    assert detectors.numeric_outliers(rows, "x").count() == 0
    even = spark.createDataFrame([(float(i % 101 - 50),) for i in range(303)] + [(500.0,), (-500.0,)], "x double")
    assert {r.value for r in detectors.numeric_outliers(even, "x").collect()} == {500.0, -500.0}
    m = profile.missing_profile(vh(["a", None, " N/A ", "", "b"])).first()
    assert (m.n_null, m.n_placeholder, m.missing_count, m.n_distinct) == (1, 1, 2, 2)
    assert profile.column_types(vh(["1", "2.0"])).first().storage_type == "int64"


def test_names(spark):
    cols = [("orders", "customer_id"), ("customers", "id"), ("orders", "o_custkey"), ("customer", "c_custkey"), ("invoice", "BillingCity"), ("address", "City"), ("employees", "reports_to"), ("employees", "employee_id"), ("employees", "staff_rep"), ("staffing", "code"), ("staff", "nr"), ("id_card", "soc_sec_id")]
    got = {(r.column_a, r.column_b): r for r in names.pairs(spark, cols).collect()}
    assert ("customer_id", "id") in got and ("o_custkey", "c_custkey") not in got
    assert got["BillingCity", "City"].shared and not got["customer_id", "id"].shared
    assert got["reports_to", "employee_id"].score_b == 0.95 and ("customer_id", "o_custkey") not in got
    assert got["staff_rep", "nr"].score_b == 0.85 and ("staff_rep", "code") not in got  # the whole table's name, not a part of it
    assert ("id", "soc_sec_id") in got and names.is_identifier("ID_No") and names.is_identifier("paid") and not names.is_identifier("amount")
    ranked = names.record_rank(spark.createDataFrame([(c,) for c in ("soc_sec", "userId", "grid", "PhoneNo", "SerialCode", "S_N", "amount")], "column string"))
    assert {r.column: r["rank"] for r in ranked.collect()} == {"soc_sec": 90, "userId": 100, "grid": 90, "PhoneNo": 10, "SerialCode": 70, "S_N": 60, "amount": 0}


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Na me,x/y,x/y\ncafé “x” €,NA,1\n".encode("cp1252"))
    (tmp_path / "b.json").write_text('{"v": 1, "rows": [{"a": 1, "b": {"c": 2}}, {"a": 3, "b": {"c": 4}}]}')
    (tmp_path / "c.geojson").write_text('{"features": [{"properties": {"n": "p"}, "geometry": {"type": "Point"}}]}')
    (tmp_path / "d.txt").write_text("p;q\n1;x,y\n")
    (tmp_path / "lines.json").write_text('{"a": {"z": 1, "b": null}}\n{"a": {"z": 2, "b": "x"}}\n')
    found = readers.discover(spark, str(tmp_path))
    assert [f.rsplit("/", 1)[1] for f in found] == ["a.csv", "b.json", "c.geojson", "d.txt", "lines.json"]
    got = readers.read_all(spark, found)
    assert [tuple(r) for r in got["b"].select("a", "`b.c`", "v").orderBy("a").collect()] == [(1, 2, 1), (3, 4, 1)]
    assert got["c"].first()["_geometry_type"] == "Point" and got["d"].first().asDict() == {"p": "1", "q": "x,y"}
    assert got["lines"].columns == ["a.b", "a.z"] and got["lines"].count() == 2
    row = readers.clean(got["a"]).first().asDict()
    assert "café “x” €" in row.values() and None in row.values()
    assert readers.clean_names([" a b", "a/b", "a-b"]) == ["a_b", "a_b_1", "a_b_2"]
    nested = spark.createDataFrame([((1, [("q", None)]), {"y": 1, "a": 2})], "n struct<z:int,b:array<struct<t:string,c:string>>>, m map<string,int>")
    assert tuple(readers.clean(nested).first()) == ('{"b":[{"c":null,"t":"q"}],"z":1}', '{"a":2,"y":1}')
    with pytest.raises(ValueError):
        readers.read_file(spark, "x.doc")


def test_encodings(spark, tmp_path):
    for name, text, code in (("utf8", "é,ß", "utf-8"), ("mark", "é,ß", "utf-8-sig"), ("wide", "é,ß", "utf-16"), ("latin", "é,ß", "iso-8859-1"), ("windows", "é“,€", "cp1252")):
        path = tmp_path / f"{name}.csv"
        path.write_bytes(f"k,v\n{text}\n".encode(code))
        df = readers.read_csv(spark, str(path))
        assert df.columns == ["k", "v"] and tuple(df.first()) == tuple(text.split(",")), name
    (tmp_path / "two.csv").write_text('k,v\n1,"a\nb ""c"""\n2,x\n')
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "two.csv")).collect()] == [("1", 'a\nb "c"'), ("2", "x")]
    assert readers.head_of(spark, str(tmp_path / "two.csv"))[:3] == b"k,v"


def test_canon(spark):
    df = spark.createDataFrame([(12345678.0, "\t Ab-12 ")], "d double, s string")
    assert df.select(canon.text(df.d, df.schema["d"].dataType), canon.fingerprint(canon.strip(F.col("s")))).first()[:] == ("12345678.0", "aa-XX")
