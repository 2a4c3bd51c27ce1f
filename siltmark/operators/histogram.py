"""The value histogram: (table, column, value, cnt), from which most statistics follow."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltmark.functions import canon


def value_histogram(df: DataFrame, table: str, columns: list[str] | None = None, keys: bool = False) -> DataFrame:
    """Counts of each value of each column, as text; nulls are a row of their own. One unpivot and one aggregation with map-side sums.

    With `keys`, values are brought to the form in which those of two columns are matched before they are counted, which spares a second shuffle of them.
    """
    columns = columns or df.columns
    text = lambda c: canon.text(df[c], df.schema[c].dataType)
    rendered = df.select(*[(canon.key_text(text(c)) if keys else text(c)).alias(c) for c in columns])
    long = rendered.unpivot([], columns, "column", "value")
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt")).select(F.lit(table).alias("table"), "column", "value", "cnt")


#: Types of which different values have different texts.
TOLD_APART = (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType, T.DecimalType, T.BooleanType, T.DateType)


def columnar_histogram(df: DataFrame, table: str) -> DataFrame:
    """`value_histogram` of a table whose columns can be read one by one, as those of Parquet files.

    Each column is counted by itself and as what it is; texts are made of its distinct values alone. Where two values may have one text, as times in a zone
    that changes its clocks, texts are counted once more.
    """
    parts = []
    for f in df.schema:
        c = df[f"`{f.name}`"]
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
            parts.append(value_histogram(df.select(c), table))
            continue
        by = df.groupBy(c.alias("_v")).agg(F.count(F.lit(1)).alias("cnt"))
        by = by.select(canon.text(F.col("_v"), f.dataType).alias("value"), "cnt")
        if not isinstance(f.dataType, TOLD_APART) and f.dataType != T.StringType():
            by = by.groupBy("value").agg(F.sum("cnt").alias("cnt"))
        parts.append(by.select(F.lit(table).alias("table"), F.lit(f.name).alias("column"), "value", "cnt"))
    return union(parts)


def plain_columns(tables: dict[str, DataFrame]) -> frozenset[tuple[str, str]]:
    """Columns of whole numbers: their texts are all different, without white space, placeholders or a trailing `.0`, so that nothing is to be brought to another form."""
    return frozenset((t, f.name) for t, df in tables.items() for f in df.schema if isinstance(f.dataType, T.IntegralType))


def is_of(columns: Iterable[tuple[str, str]]) -> Column:
    """Whether a row of a histogram is of one of the columns."""
    by: dict[str, list[str]] = {}
    for t, c in sorted(columns):
        by.setdefault(t, []).append(c)
    out = F.lit(False)
    for t, cs in by.items():
        out = out | ((F.col("table") == t) & F.col("column").isin(*cs))
    return out


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
