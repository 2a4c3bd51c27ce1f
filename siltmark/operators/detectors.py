"""Quality detectors of columns. All work on values that are neither null nor placeholders."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.config import DEFAULT, EMAIL, FALSE_SPELLINGS, PLACEHOLDERS, TRUE_SPELLINGS, Config
from siltmark.functions import canon
from siltmark.operators import dates
from siltmark.operators.histogram import is_of
from siltmark.operators.quantiles import quantiles

#: Values that fences need, and below how many they are tighter.
LEAST_VALUES, FEW_VALUES, FEW_MULTIPLIER = 10, 100, 1.5

#: Different values of columns whose quartiles are taken in one aggregation, which holds them all.
AT_ONCE = 1_000_000


@dataclass(frozen=True)
class Fences:
    """Quartiles of n values, and the bounds of what is expected."""

    n: int
    q1: float
    q3: float

    @property
    def multiplier(self) -> float:
        return FEW_MULTIPLIER if self.n < FEW_VALUES else DEFAULT.outlier_multiplier

    @property
    def lower(self) -> float:
        return self.q1 - self.multiplier * (self.q3 - self.q1)

    @property
    def upper(self) -> float:
        return self.q3 + self.multiplier * (self.q3 - self.q1)


def fences(df: DataFrame, columns: list[str]) -> dict[str, Fences]:
    """2 IQR beyond the quartiles, 1.5 below 100 values, of all columns together; none below 10 values or without spread."""
    read = {c: canon.try_number(canon.text(df[c], df.schema[c].dataType)) for c in columns}
    found = quantiles(df, read, [0.25, 0.75]) if columns else {}
    return {c: Fences(n, *q) for c, (n, q) in found.items() if n >= LEAST_VALUES and q[1] > q[0]}


def histogram_fences(vh: DataFrame, columns: dict[tuple[str, str], int]) -> dict[tuple[str, str], Fences]:
    """`fences` of columns of any tables, from their histogram: a value is read once, however many rows it stands for.

    `columns` have the number of their different values: as many columns as have few together take one aggregation, the others the passes of `quantiles`.
    """
    held, few = 0, []
    for c in sorted(columns, key=lambda c: columns[c]):
        held += columns[c]
        if held <= AT_ONCE:
            few.append(c)
    rows = vh.where(is_of(few)).select("table", "column", canon.try_number(F.col("value")).alias("x"), "cnt").where("x IS NOT NULL")
    got = rows.groupBy("table", "column").agg(F.sum("cnt").alias("n"), F.percentile("x", F.lit([0.25, 0.75]), F.col("cnt")).alias("q")).collect() if few else []
    out = {(r["table"], r["column"]): Fences(r["n"], *r["q"]) for r in got if r["n"] >= LEAST_VALUES and r["q"][1] > r["q"][0]}
    return out | _long_fences(vh, [c for c in columns if c not in few])


def _long_fences(vh: DataFrame, columns: list[tuple[str, str]]) -> dict[tuple[str, str], Fences]:
    at = {str(k): c for k, c in enumerate(columns)}
    read = {k: F.when((F.col("table") == t) & (F.col("column") == c), F.col("x")) for k, (t, c) in at.items()}
    numbers = vh.where(is_of(columns)).select("table", "column", canon.try_number(F.col("value")).alias("x"), "cnt").where("x IS NOT NULL")
    found = quantiles(numbers, read, [0.25, 0.75], F.col("cnt")) if columns else {}
    return {at[k]: Fences(n, *q) for k, (n, q) in found.items() if n >= LEAST_VALUES and q[1] > q[0]}


def iqr_fences(df: DataFrame, column: str) -> DataFrame:
    """The fences of a column as a row: column, n, q1, q3, lower_fence, upper_fence; no row where there are none."""
    rows = [(c, f.n, f.q1, f.q3, f.lower, f.upper) for c, f in fences(df, [column]).items()]
    return df.sparkSession.createDataFrame(rows, "column string, n long, q1 double, q3 double, lower_fence double, upper_fence double")


def iqr_outliers(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Rows beyond the fences: a filter against two numbers."""
    f = fences(df, [column]).get(column)
    x = F.col(column).cast("double")
    side = F.when(x > f.upper, "high").when(x < f.lower, "low") if f else F.lit(None).cast("string")
    return df.withColumn("side", side).where(F.col("side").isNotNull()).select(*keys, column, "side")


def all_sentinels(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """column, side, value, cnt, share: values that make up 80 % or more of a column's outliers on one side, of all columns with bounds (lower, upper) in one aggregation."""
    parts = []
    for c, (low, high) in bounds.items():
        x = canon.try_number(canon.text(df[c], df.schema[c].dataType))
        side = F.when(x > high, "high").when(x < low, "low")
        parts.append(F.when(side.isNotNull(), F.struct(F.lit(c).alias("column"), side.alias("side"), x.alias("value"))))
    empty = F.array().cast("array<struct<column:string,side:string,value:double>>")
    by = df.select(F.explode(F.array_compact(F.array(*parts)) if parts else empty).alias("o")).groupBy("o.column", "o.side", "o.value").agg(F.count(F.lit(1)).alias("cnt"))
    sides = by.groupBy("column", "side").agg(F.sum("cnt").alias("total"))
    return by.join(sides, ["column", "side"]).withColumn("share", F.col("cnt") / F.col("total")).where("share >= 0.8").drop("total")


def histogram_sentinels(vh: DataFrame, bounds: dict[tuple[str, str], tuple[float, float]]) -> DataFrame:
    """`all_sentinels` of columns of any tables, from their histogram: table, column, side, value, cnt, share."""
    # a row for each column
    known = vh.sparkSession.createDataFrame([(*k, *b) for k, b in bounds.items()], "table string, column string, low double, high double")
    numbers = vh.where(is_of(bounds)).select("table", "column", canon.try_number(F.col("value")).alias("value"), "cnt").join(F.broadcast(known), ["table", "column"])
    rows = numbers.withColumn("side", F.when(F.col("value") > F.col("high"), "high").when(F.col("value") < F.col("low"), "low")).where("side IS NOT NULL")
    by = rows.groupBy("table", "column", "side", "value").agg(F.sum("cnt").alias("cnt"))
    sides = by.groupBy("table", "column", "side").agg(F.sum("cnt").alias("total"))
    return by.join(sides, ["table", "column", "side"]).withColumn("share", F.col("cnt") / F.col("total")).where("share >= 0.8").drop("total")


def sentinels(df: DataFrame, column: str) -> DataFrame:
    """Values that make up 80 % or more of the outliers on one side."""
    return all_sentinels(df, {c: (f.lower, f.upper) for c, f in fences(df, [column]).items()}).drop("column")


def sign_anomalies(df: DataFrame, column: str) -> DataFrame:
    """Shares of signs, and how many values have the rare one where over 95 % have the other."""
    x = F.col(column).cast("double")
    a = df.where(x.isNotNull()).agg(F.avg((x > 0).cast("double")).alias("positive"), F.avg((x < 0).cast("double")).alias("negative"), F.count_if(x > 0).alias("n_pos"), F.count_if(x < 0).alias("n_neg"))
    odd = F.when((F.col("positive") > 0.95) & (F.col("n_neg") > 0), F.col("n_neg")).when((F.col("negative") > 0.95) & (F.col("n_pos") > 0), F.col("n_pos")).otherwise(0)
    return a.select(F.lit(column).alias("column"), "positive", "negative", odd.alias("n_odd"))


def numeric_outliers(df: DataFrame, column: str, config: Config = DEFAULT) -> DataFrame:
    """Distinct outliers: by extreme quantiles where values are skewed or few, by z-score else."""
    x = F.col(column).cast("double")
    rows = df.select(x.alias("value")).where("value IS NOT NULL")
    n, q = quantiles(df, {column: x}, [0.001, 0.25, 0.75, 0.999])[column]
    if not n:
        return rows.limit(0)
    count = F.count(F.lit(1))
    mean, std, skew = rows.agg(F.avg("value"), F.stddev_samp("value"), F.when(count > 2, F.skewness("value") * F.sqrt(count * (count - 1)) / (count - 2))).first()
    if n < FEW_VALUES or abs(skew or 0.0) > 1:
        reach = config.outlier_multiplier * (q[2] - q[1])
        far = (F.col("value") > q[3] + reach) | (F.col("value") < q[0] - reach)
    else:
        far = F.abs(F.col("value") - mean) > config.outlier_z * std
    return rows.where(far).distinct()


def email_issues(vh: DataFrame) -> DataFrame:
    """Counts of malformed, mixed-case, placeholder and plus-tagged addresses, and of domains."""
    v, w = F.col("value"), F.col("cnt")
    total = lambda cond, name: F.coalesce(F.sum(F.when(cond, w)), F.lit(0)).alias(name)
    local = F.substring_index(F.lower(v), "@", 1)
    return vh.where(canon.is_value(v)).groupBy("table", "column").agg(
        total(~v.rlike(EMAIL), "malformed"), total(v != F.lower(v), "mixed_case"), total(local.isin(*PLACEHOLDERS), "placeholder_local"), total(v.contains("+"), "plus_tag"), F.count_distinct(F.when(v.rlike(EMAIL), F.substring_index(F.lower(v), "@", -1))).alias("n_domains")
    )


def code_issues(vh: DataFrame) -> DataFrame:
    """Decimal artefacts, shares of digits, and codes shorter than the dominant length."""
    v, w = F.col("value"), F.col("cnt")
    values = vh.where(canon.is_value(v)).withColumn("code", F.regexp_replace(v, r"\.0+$", "")).withColumn("len", F.char_length("code"))
    lengths = values.groupBy("table", "column", "len").agg(F.sum("cnt").alias("c")).groupBy("table", "column").agg(F.max(F.struct("c", "len")).alias("top"))
    return values.join(lengths, ["table", "column"]).groupBy("table", "column").agg(
        (F.sum(F.when(v.rlike(r"^\d+\.0+$"), w).otherwise(0)) / F.sum(w)).alias("decimal_share"),
        (F.sum(F.when(F.col("code").rlike(r"^\d+$"), w).otherwise(0)) / F.sum(w)).alias("digit_share"),
        F.max("top.len").alias("dominant_length"),
        F.sum(F.when(F.col("len") < F.col("top.len"), w).otherwise(0)).alias("shorter"),
    )


def date_issues(vh: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Shares of compact and ISO dates, and values that no known format or layout reads."""
    v, w = F.col("value"), F.col("cnt")
    return vh.where(canon.is_value(v)).groupBy("table", "column").agg(
        (F.sum(F.when(v.rlike(r"^\d{8}(\.0+)?$"), w).otherwise(0)) / F.sum(w)).alias("compact_share"),
        (F.sum(F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}"), w).otherwise(0)) / F.sum(w)).alias("iso_share"),
        F.coalesce(F.sum(F.when(dates.parse(v, formats=config.date_formats).isNull(), w)), F.lit(0)).alias("unparseable"),
    )


def boolean_spellings(vh: DataFrame) -> DataFrame:
    """Columns with exactly two values, both spellings of truth, other than true and false."""
    known = F.lit([*TRUE_SPELLINGS, *FALSE_SPELLINGS])
    a = vh.where(canon.is_value(F.col("value"))).groupBy("table", "column", F.lower(canon.strip(F.col("value"))).alias("v")).agg(F.sum("cnt").alias("c"))
    few = a.groupBy("table", "column").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("n = 2")
    ok = F.array_contains(known, F.col("lo")) & F.array_contains(known, F.col("hi")) & ~((F.col("lo") == "false") & (F.col("hi") == "true"))
    return few.where(ok).select("table", "column", "lo", "hi")


def contaminated(vh: DataFrame) -> DataFrame:
    """Text columns with over 50 values that are under 5 % of the rows."""
    a = vh.where(canon.is_value(F.col("value"))).groupBy("table", "column").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("cnt").alias("n"))
    return a.where((F.col("n_distinct") > 50) & (F.col("n_distinct") / F.col("n") < 0.05))


def near_duplicate_values(vh: DataFrame, config: Config = DEFAULT, k: int = 3) -> DataFrame:
    """Pairs of values of a column whose k-gram sets have a Jaccard similarity of 0.88 or more.

    Candidates have sizes that allow the similarity and share one of their rarest k-grams: of two sets that are alike, each holds so much of the other that
    the few it may lack are fewer than those. Columns with more values than the limit are left out, as is the rule.
    """
    v = vh.where(canon.is_value(F.col("value"))).select("table", "column", canon.strip(F.col("value")).alias("value")).distinct()
    few = v.groupBy("table", "column").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, config.near_dupe_max_values))
    size = F.greatest(F.char_length("value") - (k - 1), F.lit(1))
    one = v.join(few.select("table", "column"), ["table", "column"]).select("table", "column", "value", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(F.col("value"), i, F.lit(k))))).alias("gram"))
    held = one.groupBy("table", "column", "gram").agg(F.count(F.lit(1)).alias("n"))
    sets = one.join(held, ["table", "column", "gram"]).groupBy("table", "column", "value").agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("sorted"))
    sets = sets.select("table", "column", "value", F.transform("sorted", lambda g: g["gram"]).alias("grams"), F.size("sorted").alias("size"))
    # a little less than the threshold, so that rounding leaves no gram out
    least = F.ceil(F.col("size") * F.lit(config.near_dupe_threshold) - 1e-9).cast("int")
    rare = sets.withColumn("gram", F.explode(F.slice("grams", F.lit(1), F.col("size") - least + 1)))
    x, y = rare.alias("x"), rare.alias("y")
    near = (F.col("x.value") < F.col("y.value")) & (F.least("x.size", "y.size") >= config.near_dupe_threshold * F.greatest("x.size", "y.size"))
    both = x.join(y, (F.col("x.table") == F.col("y.table")) & (F.col("x.column") == F.col("y.column")) & (F.col("x.gram") == F.col("y.gram")) & near)
    shared = F.size(F.array_intersect("x.grams", "y.grams"))
    pairs = both.select(F.col("x.table").alias("table"), F.col("x.column").alias("column"), F.col("x.value").alias("value_a"), F.col("y.value").alias("value_b"), (shared / (F.col("x.size") + F.col("y.size") - shared)).alias("jaccard"))
    return pairs.where(F.col("jaccard") >= config.near_dupe_threshold).distinct()


def non_numeric(vh: DataFrame) -> DataFrame:
    """Values that are no numbers in columns whose values are numbers nearly everywhere (95 % of rows): table, column, value, cnt."""
    v = F.col("value")
    number = canon.try_number(canon.strip(v)).isNotNull()
    share = vh.groupBy("table", "column").agg((F.sum(F.when(number, F.col("cnt")).otherwise(0)) / F.sum("cnt")).alias("share")).where("share >= 0.95")
    return vh.where(canon.is_value(v) & ~number).join(share, ["table", "column"], "left_semi").select("table", "column", "value", "cnt")


def domain_concentration(vh: DataFrame) -> DataFrame:
    """Address columns of which one domain of several has over 80 %: table, column, domain, share."""
    v = F.col("value")
    by = vh.where(canon.is_value(v) & v.rlike(EMAIL)).groupBy("table", "column", F.substring_index(F.lower(v), "@", -1).alias("domain")).agg(F.sum("cnt").alias("cnt"))
    totals = by.groupBy("table", "column").agg(F.sum("cnt").alias("total"), F.count(F.lit(1)).alias("n"))
    return by.join(totals, ["table", "column"]).withColumn("share", F.col("cnt") / F.col("total")).where("share > 0.8 AND n > 1").select("table", "column", "domain", "share")


def under_age(df: DataFrame, column: str, least: int = 13) -> DataFrame:
    """Rows of an age column below the least age; columns not named so give none."""
    return df.where((canon.try_number(df[column].cast("string")) < least) if "age" in column.lower() else F.lit(False))
