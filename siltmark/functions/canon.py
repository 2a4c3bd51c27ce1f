"""One place for how values are read: stripping, placeholders, numbers, dates, text of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltmark.config import DEFAULT, PLACEHOLDERS


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_placeholder(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)).isin(*PLACEHOLDERS), F.lit(False))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c) == "", F.lit(False))


def is_value(c: Column) -> Column:
    """Neither null nor blank nor a placeholder."""
    return c.isNotNull() & ~is_blank(c) & ~is_placeholder(c)


def try_number(c: Column) -> Column:
    """A double, or null; NaN counts as null."""
    v = c.try_cast("double")
    return F.when(~F.isnan(v), v)


def try_date(c: Column, formats: tuple[str, ...] = DEFAULT.date_formats) -> Column:
    """A timestamp by the first format that fits, or null. Years have four digits: signs and long runs of digits are no dates, and would overflow the reader of a format."""
    s = strip(c)
    able = F.when(~s.rlike(r"^[+-]|\d{5}") | s.rlike(r"^\d{8}$"), s)
    return F.coalesce(*[F.try_to_timestamp(able, F.lit(f)) for f in formats])


def text(c: Column, kind: T.DataType) -> Column:
    """Text of a value of any type; whole doubles as `12.0` without an exponent, nested values as JSON."""
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(c)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return F.when(whole, F.concat(c.cast("bigint").cast("string"), F.lit(".0"))).otherwise(c.cast("string"))
    return c.cast("string")


def key_text(c: Column) -> Column:
    """Text by which values of two columns are matched: stripped, without a trailing `.0`."""
    return F.regexp_replace(strip(c), r"\.0+$", "")


def fingerprint(c: Column) -> Column:
    """Letters as `a`, digits as `X`, all else as it is."""
    return F.regexp_replace(F.regexp_replace(c, r"\p{L}", "a"), r"\p{Nd}", "X")


def matches(c: Column, pattern: str, full: bool = False) -> Column:
    """A match from the start of the text, or of all of it."""
    return c.rlike(f"^(?:{pattern})$" if full else f"^(?:{pattern})")
