"""Layouts of dates, found by elimination: which layouts read every value of a column, and whether its days or its months come first.

Each value says which layouts read it, as bits. The bits of a column's values are put together in one aggregation (`bit_and`) over its histogram, so that a
column of any size costs one pass and its rows one parser. What is left decides how values are meant that may be read in two ways.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.functions import canon

# Names of months, and how dates are written.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WEEKDAY = r"(?:[A-Za-z]{3,9},? +)?"
#: The first three letters of a name that is a month's, in full or short.
NAME = r"(?i:(?=(?:" + "|".join(f"{m}|{m[:3]}" for m in MONTHS) + r"|sept)\b)([a-z]{3})[a-z]*)\.?"
NTH = r"(\d{1,2})(?:st|nd|rd|th)?"
#: Numbers of one or two digits before a year: the day or the month comes first.
ORDERED = r"(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})"


@dataclass(frozen=True)
class Layout:
    """One way to write a date: a pattern, and which of its groups are year, month and day."""

    name: str
    pattern: str
    year: int
    month: int
    day: int
    named: bool = False


#: Bits are given in this order.
LAYOUTS = (
    Layout("year_month_day", r"(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", 1, 2, 3),
    Layout("compact", r"(\d{4})(\d{2})(\d{2})", 1, 2, 3),
    Layout("month_day_year", ORDERED, 3, 1, 2),
    Layout("day_month_year", ORDERED, 3, 2, 1),
    Layout("name_day_year", rf"{WEEKDAY}{NAME} +{NTH},? +(\d{{4}})", 3, 1, 2, named=True),
    Layout("day_name_year", rf"{WEEKDAY}{NTH}[- ]+{NAME},?[- ]+(\d{{4}})", 3, 2, 1, named=True),
)
BIT = {x.name: 1 << k for k, x in enumerate(LAYOUTS)}


def read(c: Column, layout: Layout) -> Column:
    """A timestamp by one layout, or null. Halves of the day and offsets are taken into account; without an offset, the clock is the session's."""
    # what the pattern reads is put in one order behind a mark, so that a single format reads it and nothing else
    plain = F.regexp_replace(canon.strip(c), rf"^{layout.pattern}(?:(?:T| +)([0-9].*))?$", f"\u0001${layout.year}-${layout.month}-${layout.day} $4")
    return F.try_to_timestamp(plain, F.lit(f"'\u0001'yyyy-{'MMM' if layout.named else 'M'}-d [h:mm[:ss][ ]a][H:mm[:ss[.SSSSSSSSS]][XXX][XX]]"))


def bits(c: Column) -> Column:
    """Which layouts read a value: 0 for one that is no date, null for null."""
    total = F.lit(0)
    for x in LAYOUTS:
        total = total.bitwiseOR(F.when(read(c, x).isNotNull(), BIT[x.name]).otherwise(0))
    return F.when(c.isNotNull(), total)


def _days_lead(b: Column) -> Column:
    """Aggregate over bits: some value is read with the day first only, and none with the month first only."""
    day, month = BIT["day_month_year"], BIT["month_day_year"]
    only = lambda bit: F.coalesce(F.bool_or(b.bitwiseAND(day | month) == bit), F.lit(False))
    return only(day) & ~only(month)


def days_lead(c: Column) -> Column:
    """The same over a column's values, which reads those alone whose order is open."""
    both = [x for x in LAYOUTS if x.pattern == ORDERED]
    b = F.lit(0)
    for x in both:
        b = b.bitwiseOR(F.when(read(c, x).isNotNull(), BIT[x.name]).otherwise(0))
    return _days_lead(b)


def layouts(vh: DataFrame) -> DataFrame:
    """table, column, values, dates, left, seen, days_lead, mixed for each column of a histogram (table, column, value, cnt).

    left: the layouts that read every date of the column; seen: those that read one at least, both in order and joined by commas. mixed: there are dates and none is left.
    Nulls, blanks and placeholders are no values; a column without values has no row, one without dates empty lists.
    """
    w, b = F.col("cnt"), F.col("bits")
    # at most one row for each set of layouts
    held = vh.where(canon.is_value(F.col("value"))).groupBy("table", "column", bits(F.col("value")).alias("bits")).agg(F.sum("cnt").alias("cnt"))
    dated = F.when(b != 0, b)
    a = held.groupBy("table", "column").agg(
        F.sum(w).alias("values"),
        F.sum(F.when(b != 0, w).otherwise(0)).alias("dates"),
        F.coalesce(F.bit_and(dated), F.lit(0)).alias("l"),
        F.coalesce(F.bit_or(dated), F.lit(0)).alias("s"),
        _days_lead(b).alias("days_lead"),
    )
    names = lambda of: F.concat_ws(",", *[F.when(F.col(of).bitwiseAND(bit) != 0, F.lit(n)) for n, bit in BIT.items()])
    return a.select("table", "column", "values", "dates", names("l").alias("left"), names("s").alias("seen"), "days_lead", ((F.col("dates") > 0) & (F.col("l") == 0)).alias("mixed"))


def parse(c: Column, days_first: Column | None = None, formats: tuple[str, ...] = ()) -> Column:
    """A timestamp by the first of some fixed formats that fits, else by a layout that reads the value, or null.

    Where day and month may change places, layouts alone decide: by `days_first`, else the month first; what only the other order reads is read by it.
    """
    by = {x.name: read(c, x) for x in LAYOUTS}
    first, second = by.pop("month_day_year"), by.pop("day_month_year")
    ordered = F.coalesce(first, second) if days_first is None else F.when(days_first, F.coalesce(second, first)).otherwise(F.coalesce(first, second))
    fixed = [canon.try_date(c, formats)] if formats else []
    return F.when(canon.strip(c).rlike(f"^{ORDERED}"), ordered).otherwise(F.coalesce(*fixed, *by.values()))
