"""What a column is meant to hold, and what is wrong with it: types, gates, counts and examples, from the histogram.

One aggregation of the histogram gives a row of measures for each column. Gates are conditions on that row; it is of metadata size and joined back to
the values, of which each says which faults it has. Counts and the first examples of a fault are then two aggregations.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltmark.config import DEFAULT, EMAIL, FALSE_SPELLINGS, ID_PHRASES, ID_TOKENS, KNOWN_PATTERNS, PLACEHOLDERS, SINGAPORE_PATTERNS, TRUE_SPELLINGS, Config
from siltmark.functions import canon
from siltmark.operators.detectors import near_duplicate_values
from siltmark.operators.histogram import is_of

NUMERIC = ("int32", "int64", "float32", "float64")
TEXT = ("string", "object")
EXAMPLES = 5
#: Names that say that a sequence of numbers is no mere ranking.
NO_RANK = "id|key|code|number|no|num"
AGE = 13


def declared_types(tables: dict[str, DataFrame]) -> dict[tuple[str, str], str]:
    """Storage types of columns that are not text."""
    out = {}
    for t, df in tables.items():
        for f in df.schema:
            k = f.dataType
            name = "int64" if isinstance(k, T.LongType) else "int32" if isinstance(k, T.IntegerType) else "float32" if isinstance(k, T.FloatType) else "float64" if isinstance(k, (T.DoubleType, T.DecimalType)) else None
            name = name or ("bool" if isinstance(k, T.BooleanType) else "datetime64[ns]" if isinstance(k, (T.DateType, T.TimestampType, T.TimestampNTZType)) else None)
            if name:
                out[t, f.name] = name
    return out


def _storage(declared: dict[tuple[str, str], str], inferred: Column) -> Column:
    out = inferred
    for (t, c), kind in declared.items():
        out = F.when((F.col("table") == t) & (F.col("column") == c), kind).otherwise(out)
    return out


def stripped(vh: DataFrame, plain: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """The histogram of values without white space at their ends: table, column, s, cnt. Those of `plain` columns have none, and stay where they are."""
    out = vh.where(~is_of(plain)).groupBy("table", "column", canon.strip(F.col("value")).alias("s")).agg(F.sum("cnt").alias("cnt"))
    return vh.where(is_of(plain)).select("table", "column", F.col("value").alias("s"), "cnt").unionByName(out) if plain else out


def _code(s: Column) -> Column:
    return F.regexp_replace(s, r"\.0+$", "")


def measures(values: DataFrame, declared: dict[tuple[str, str], str] | None = None, config: Config = DEFAULT, plain: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """A row of measures for each column of a stripped histogram, with `storage` and `intended` types and what the gates ask for. `plain`: columns of whole numbers."""
    same = is_of(plain)
    s, w = F.col("s"), F.col("cnt")
    held = s.isNotNull() & ~canon.is_placeholder(s)
    number = canon.try_number(s)
    code = _code(s)
    patterns = KNOWN_PATTERNS | (SINGAPORE_PATTERNS if config.country_patterns else {})
    total = lambda cond, of=w: F.coalesce(F.sum(F.when(cond, of)), F.lit(0))
    full = lambda p, of=s: of.rlike(f"^(?:{p})$")
    spelled = F.lower(s).isin(*TRUE_SPELLINGS, *FALSE_SPELLINGS)
    # sets of the few spellings that there are
    spellings = lambda cond: F.size(F.collect_set(F.when(cond & spelled, F.lower(s))))
    # dates are looked for among texts
    date = F.when(~is_of(declared or {}), canon.try_date(s, config.date_formats)).isNotNull()
    a = values.groupBy("table", "column").agg(
        F.sum(w).alias("n"),
        total(s.isNull()).alias("nulls"),
        total(canon.is_placeholder(s)).alias("placeholders"),
        total(held).alias("held"),
        F.count(F.when(held, 1)).alias("distinct"),
        F.count(F.when(held & ~canon.is_blank(s), 1)).alias("n_values"),
        total(number.isNotNull()).alias("numbers"),
        total(held & number.isNotNull()).alias("held_numbers"),
        F.coalesce(F.bool_and(F.when(number.isNotNull(), number == F.floor(number))), F.lit(False)).alias("whole"),
        spellings(held).alias("spellings"),
        F.min(F.when(held, F.lower(s))).alias("first_spelling"),
        F.max(F.when(held, F.lower(s))).alias("last_spelling"),
        F.coalesce(F.bool_and(F.when(held, spelled)), F.lit(False)).alias("spelled"),
        F.coalesce(F.bool_and(F.when(s.isNotNull(), spelled)), F.lit(False)).alias("all_spelled"),
        spellings(s.isNotNull()).alias("all_spellings"),
        total(date).alias("dates"),
        F.count_if(number.isNotNull() & same).alias("plain_codes"),
        F.count(F.when(s.isNotNull() & number.isNull(), 1)).alias("other_codes"),
        total(s.isNotNull() & full(r"\d+", code)).alias("code_digits"),
        total(s.isNotNull() & full(r"(19|20)\d{6}", code)).alias("code_days"),
        total(s.isNotNull() & full(r"(19|20)\d{12}", code)).alias("code_seconds"),
        total(held & full(r"(19|20)\d{6}", code)).alias("days"),
        total(held & full(r"\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2})?)?")).alias("iso_dates"),
        total(held & full(r"\d{8}(\.0+)?")).alias("compact"),
        total(s.isNotNull() & full(r"\d+\.0+")).alias("all_artefacts"),
        total(held & full(r"\d+\.0+")).alias("artefacts"),
        total(held & full(r"\d+\.\d*[1-9]\d*")).alias("decimals"),
        total(held & full(r"\d+(\.0+)?")).alias("digits"),
        F.max(F.when(held, canon.try_number(code))).alias("greatest"),
        total(held & s.contains("+")).alias("plus"),
        total(held, w * F.char_length(s)).alias("chars"),
        total(s.isNotNull() & s.rlike("(?i)" + "|".join(f"^(?:{p})" for p in patterns.values()))).alias("known"),
        F.min(number).alias("least"),
        F.max(number).alias("most"),
    )
    # the one distinct count, apart from the others, which it would send with every value: of numbers without their `.0`
    codes = values.where(~same & number.isNotNull()).groupBy("table", "column").agg(F.count_distinct(code).alias("_codes"))
    a = a.join(codes, ["table", "column"], "left").withColumn("number_codes", F.col("plain_codes") + F.coalesce("_codes", F.lit(0))).drop("plain_codes", "_codes")
    a = a.withColumn("codes", F.col("number_codes") + F.col("other_codes"))
    # lengths of codes: the most frequent one, of equals the longest
    by = values.where(s.isNotNull()).groupBy("table", "column", F.char_length(code).alias("length")).agg(F.sum(w).alias("c"), total(held).alias("h"))
    lengths = by.groupBy("table", "column").agg(
        F.max(F.struct("c", "length")).alias("all_top"), F.max(F.struct("h", "length")).alias("top"), F.count(F.when(F.col("h") > 0, 1)).alias("n_lengths"), F.max(F.when(F.col("h") > 0, F.col("length"))).alias("longest")
    )
    a = a.join(lengths, ["table", "column"], "left")
    filled = F.col("n") - F.col("nulls")
    share = lambda x, of: F.coalesce(F.try_divide(F.col(x) if isinstance(x, str) else x, of), F.lit(0.0))
    inferred = F.when(filled == 0, "object").when(share("numbers", F.col("n")) >= 0.95, F.when(F.col("whole"), "int64").otherwise("float64")).otherwise("string")
    a = a.withColumn("storage", _storage(declared or {}, inferred))
    fixed = (share("code_digits", filled) >= 0.98) & (F.col("all_top.length") >= 4) & (share("all_top.c", filled) >= 0.90) & (share("codes", filled) >= 0.5)
    text = F.col("storage").isin(*TEXT)
    numeric = F.col("storage").isin(*NUMERIC)
    meant_text = F.when(share("numbers", F.col("n")) >= 0.9, "float64").when((F.col("all_spellings") >= 2) & F.col("all_spelled"), "bool").when(share("dates", F.col("n")) >= 0.9, "datetime64[ns]")
    meant_number = (
        F.when((share("code_days", filled) >= 0.8) | (share("code_seconds", filled) >= 0.8), "datetime64[ns]").when(fixed, "string").when((F.col("storage") == "float64") & (share("all_artefacts", filled) >= 0.95), "int64")
    )
    a = a.withColumn("intended", F.coalesce(F.when(text, meant_text), F.when(numeric & (filled > 0), meant_number), F.col("storage")))
    name = F.lower("column")
    tokens = F.split(name, r"[^a-z0-9]+")
    identifier = (name == "id") | name.endswith("_id") | F.arrays_overlap(tokens, F.array(*map(F.lit, (*ID_TOKENS, *ID_PHRASES))))
    looks_numeric = share("held_numbers", F.col("held")) >= 0.9
    return a.withColumns(
        {
            "uniqueness": share("distinct", F.col("held")),
            "date_like": (F.col("storage") == "datetime64[ns]") | (looks_numeric & (share("days", F.col("held")) >= 0.3)) | (share("iso_dates", F.col("held")) >= 0.8),
            "email": name.contains("email"),
            "ranking": F.coalesce((F.col("number_codes") >= 2) & F.col("whole") & (F.col("least") == 1) & (F.col("most") == F.col("number_codes")), F.lit(False)) & ~name.rlike(NO_RANK),
            "identifier": identifier,
            "is_text": text,
            "is_numeric": numeric,
        }
    )


def known_columns(vh: DataFrame, declared: dict[tuple[str, str], str] | None = None, config: Config = DEFAULT, plain: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """The measures of all columns, read once: a row for each column, which the plans that use them hold as a table."""
    found = measures(stripped(vh, plain), declared, config, plain)
    return vh.sparkSession.createDataFrame(found.collect(), found.schema)


def column_types(vh: DataFrame, declared: dict[tuple[str, str], str] | None = None, config: Config = DEFAULT) -> DataFrame:
    """table, column, storage_type and intended_type of each column."""
    return measures(stripped(vh), declared, config).select("table", "column", F.col("storage").alias("storage_type"), F.col("intended").alias("intended_type"))


def _faults(config: Config) -> dict[str, tuple[Column, Column]]:
    """For each fault: the gate on a column's measures, and the condition on its values."""
    s = F.col("s")
    held = s.isNotNull() & ~canon.is_placeholder(s)
    number = canon.try_number(s)
    share = lambda x: F.col(x) / F.col("held")
    code = _code(s)
    some = F.col("held") > 0
    key = F.col("identifier") & (F.col("uniqueness") >= 0.98) & (F.col("distinct") > 20) & ~F.col("ranking")
    codes = (share("digits") >= 0.8) & (F.try_divide(F.col("top.h"), F.col("held")) >= 0.9) & (F.col("n_lengths") > 1) & (F.col("known") > 0) & (F.col("longest") == F.col("top.length")) & (F.coalesce(F.col("greatest"), F.lit(0.0)) < F.pow(F.lit(10.0), F.col("top.length")))
    unread = canon.try_date(code, ("yyyyMMdd",)).isNull() & canon.try_date(s, config.date_formats).isNull()
    flags = (F.col("spellings") == 2) & F.col("spelled") & ~((F.col("first_spelling") == "false") & (F.col("last_spelling") == "true"))
    contaminated = (F.col("uniqueness") < 0.05) & (F.col("distinct") > 50) & F.col("is_text") & (F.col("intended") != "datetime64[ns]")
    return {
        "null": (F.lit(True), s.isNull()),
        "placeholder": (F.lit(True), canon.is_placeholder(s)),
        "non_numeric": (some & F.col("is_numeric"), held & number.isNull()),
        "malformed_email": (some & F.col("email"), held & ~canon.is_blank(s) & ~s.rlike(EMAIL)),
        "mixed_case_email": (some & F.col("email"), held & (s != F.lower(s))),
        "placeholder_email": (some & F.col("email"), held & F.substring_index(F.lower(s), "@", 1).isin(*PLACEHOLDERS)),
        "plus_tag": (some & F.col("email") & (share("plus") >= 0.05), held & s.contains("+")),
        "duplicate_key": (some & key, held & (F.col("cnt") > 1)),
        "decimal_artefact": (some & (share("artefacts") >= 0.5) & (F.col("decimals") == 0), held & s.rlike(r"^\d+\.0+$")),
        "code_length": (some & codes, held & (F.char_length(code) != F.col("top.length"))),
        "compact_date": (some & F.col("date_like") & (share("compact") >= 0.3), held & s.rlike(r"^\d{8}(\.0+)?$")),
        "unreadable_date": (some & F.col("date_like"), held & unread),
        "low_age": (some & F.lower("column").contains("age") & F.col("storage").isin("int64", "float64"), held & (number < AGE)),
        "contaminated": (some & contaminated, held),
        "boolean_spelling": (some & flags, held),
    }


def column_errors(vh: DataFrame, declared: dict[tuple[str, str], str] | None = None, foreign_keys: list[tuple[str, str]] = (), config: Config = DEFAULT, faults: tuple[str, ...] = (), known: DataFrame | None = None, plain: Iterable[tuple[str, str]] = ()) -> DataFrame:
    """table, column, fault, n (rows), share (of all rows) and examples (the five least values) of each fault that a column has.

    All faults are looked for, or those of `faults`; `known` are the columns' measures, if they have been read. Repeated keys are no fault of `foreign_keys`. Near-duplicate values are grouped: `examples` are then the least groups, `n` their rows.
    """
    values = stripped(vh, plain)
    known = known_columns(vh, declared, config, plain) if known is None else known
    looked = {name: f for name, f in _faults(config).items() if not faults or name in faults}
    # gates are read on the columns, a table of metadata size; most values then have none to pass
    opens = lambda name, gate: gate & (~is_of(foreign_keys) if name == "duplicate_key" else F.lit(True))
    anywhere = ("null", "placeholder")
    open_ = F.array_compact(F.array(*[F.when(opens(name, gate), F.lit(name)) for name, (gate, _) in looked.items() if name not in anywhere], F.lit(None).cast("string")))
    gated = known.drop("chars").withColumn("open", open_)
    # a key that is there once is no repeated one
    some = F.exists("open", lambda name: (name != "duplicate_key") | (F.col("cnt") > 1))
    rows = values.join(F.broadcast(gated), ["table", "column"]).where(some | F.col("s").isNull() | (~is_of(plain) & canon.is_placeholder(F.col("s"))))
    hits = [F.when(F.coalesce((F.lit(True) if name in anywhere else F.array_contains("open", name)) & fault, F.lit(False)), F.lit(name)) for name, (_, fault) in looked.items()]
    found = rows.select("table", "column", "s", "cnt", "n", F.explode(F.array_compact(F.array(*hits))).alias("fault"))
    counts = found.groupBy("table", "column", "fault").agg(F.sum("cnt").alias("rows"), F.max("n").alias("total"))
    w = Window.partitionBy("table", "column", "fault").orderBy("s")
    first = found.where("s IS NOT NULL").withColumn("r", F.row_number().over(w)).where(F.col("r") <= EXAMPLES)
    examples = first.groupBy("table", "column", "fault").agg(F.array_sort(F.collect_list("s")).alias("examples"))
    out = counts.join(examples, ["table", "column", "fault"], "left")
    out = out.select("table", "column", "fault", F.col("rows").alias("n"), (F.col("rows") / F.col("total")).alias("share"), F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))
    for name, more in (("one_domain", _concentrated), ("near_duplicate", _variants)):
        out = out.unionByName(more(values, known, config)) if not faults or name in faults else out
    return out


def _concentrated(values: DataFrame, known: DataFrame, config: Config) -> DataFrame:
    """Address columns of which one domain of several has over 80 %."""
    mail = values.join(F.broadcast(known.where("email").select("table", "column", "n")), ["table", "column"]).where(F.col("s").isNotNull() & ~canon.is_placeholder(F.col("s")))
    domain = F.lower(F.regexp_extract("s", r"@([^@\s]+)$", 1))
    by = mail.withColumn("domain", domain).where("domain <> ''").groupBy("table", "column", "domain").agg(F.sum("cnt").alias("rows"), F.max("n").alias("total"))
    of = by.groupBy("table", "column").agg(F.sum("rows").alias("mails"), F.count(F.lit(1)).alias("domains"))
    top = by.join(of, ["table", "column"]).where("domains > 1 AND rows > 0.8 * mails")
    return top.select("table", "column", F.lit("one_domain").alias("fault"), F.col("rows").alias("n"), (F.col("rows") / F.col("total")).alias("share"), F.array("domain").alias("examples"))


def near_duplicate_groups(vh: DataFrame, declared: dict[tuple[str, str], str] | None = None, config: Config = DEFAULT) -> DataFrame:
    """table, column, values (in order): groups of values that are spellings of each other, in text columns that are no dates, numbers or long texts.

    A group is a value and its near duplicates that are in no earlier group, from the least value on.
    """
    values = stripped(vh)
    return _groups(values, measures(values, declared, config), config)


def _groups(values: DataFrame, known: DataFrame, config: Config) -> DataFrame:
    gate = F.col("is_text") & ~F.col("date_like") & (F.col("held_numbers") <= 0.7 * F.col("held")) & (F.col("chars") <= 30 * F.col("held")) & F.col("n_values").between(2, config.near_dupe_max_values)
    # columns have few values here (`near_dupe_max_values`); all that follows reads them, and not the histogram anew
    able = values.join(F.broadcast(known.where(gate).select("table", "column")), ["table", "column"], "left_semi").where(canon.is_value(F.col("s"))).localCheckpoint()
    short = able.groupBy("table", "column").agg(F.avg(F.char_length("s")).alias("mean")).where("mean <= 4").select("table", "column")
    renamed = able.select("table", "column", F.col("s").alias("value"), "cnt")
    two = near_duplicate_values(renamed.join(F.broadcast(short), ["table", "column"], "left_semi"), config, k=2)
    three = near_duplicate_values(renamed.join(F.broadcast(short), ["table", "column"], "left_anti"), config, k=3)
    near = two.unionByName(three)
    ends = F.array(F.struct(F.col("value_a").alias("v"), F.col("value_b").alias("o")), F.struct(F.col("value_b").alias("v"), F.col("value_a").alias("o")))
    around = near.select("table", "column", F.inline(ends)).groupBy("table", "column", "v").agg(F.array_sort(F.collect_set("o")).alias("others"))
    # a column's list of neighbourhoods is bounded as its values are
    lists = around.groupBy("table", "column").agg(F.array_sort(F.collect_list(F.struct("v", "others"))).alias("all"))
    zero = F.struct(F.array().cast("array<array<string>>").alias("groups"), F.array().cast("array<string>").alias("seen"))

    def step(acc: Column, x: Column) -> Column:
        group = F.array_sort(F.concat(F.array(x["v"]), x["others"]))
        more = F.struct(F.concat(acc["groups"], F.array(group)).alias("groups"), F.array_union(acc["seen"], group).alias("seen"))
        return F.when(F.array_contains(acc["seen"], x["v"]), acc).otherwise(more)

    return lists.select("table", "column", F.explode(F.aggregate("all", zero, step, lambda acc: acc["groups"])).alias("values"))


def _variants(values: DataFrame, known: DataFrame, config: Config) -> DataFrame:
    groups = _groups(values, known, config).localCheckpoint()
    rows = groups.select("table", "column", F.explode("values").alias("s")).distinct().join(values, ["table", "column", "s"])
    n = rows.groupBy("table", "column").agg(F.sum("cnt").alias("rows")).join(known.select("table", "column", F.col("n").alias("total")), ["table", "column"])
    w = Window.partitionBy("table", "column").orderBy("values")
    shown = groups.withColumn("r", F.row_number().over(w)).where("r <= 3").groupBy("table", "column").agg(F.array_sort(F.collect_list(F.concat_ws(" ~ ", "values"))).alias("examples"))
    return n.join(shown, ["table", "column"]).select("table", "column", F.lit("near_duplicate").alias("fault"), F.col("rows").alias("n"), (F.col("rows") / F.col("total")).alias("share"), "examples")
