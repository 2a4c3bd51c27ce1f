"""Exact quantiles of any number of rows: ranks are narrowed down by histograms, so that no task and no map holds all values.

A first pass counts rows in buckets of the signed logarithm, a monotone function. Each further pass splits the
buckets that hold a wanted rank, evenly between their least and greatest value, until few rows are left in them, which are
counted by value. What comes back from a pass is bounded by the number of buckets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of the logarithm in each factor of e, and of an even split.
LOG_BUCKETS, BUCKETS = 1_000, 4_096
#: Estimated bytes of the columns up to which one aggregation holds all their values.
SMALL_BYTES = 64 << 20
#: Rows of a bucket that are counted by value.
FEW_ROWS = 20_000


@dataclass(frozen=True)
class Interval:
    """Values from low to high, of `rows` rows, with `below` rows under them."""

    low: float
    high: float
    rows: int
    below: int


def _log_bucket(x: Column) -> Column:
    return (F.signum(x) * F.floor(F.log1p(F.abs(x)) * LOG_BUCKETS)).cast("long")


def _split(x: Column, i: Interval) -> Column:
    # halves, as the width may be beyond the largest double
    width = i.high / 2 - i.low / 2
    return F.floor((x / 2 - F.lit(i.low / 2)) / F.lit(width) * BUCKETS).cast("long")


def _counted(df: DataFrame, keys: list[tuple[int, Column, Column]], weight: Column) -> dict[int, list]:
    """For each (number, value, bucket or null): bucket, rows, least and greatest value, in order."""
    found = F.array_compact(F.array(*[F.when(b.isNotNull(), F.struct(F.lit(k).alias("k"), b.alias("b"), x.alias("x"))) for k, x, b in keys]))
    rows = df.select(F.explode(found).alias("f"), weight.alias("w")).groupBy("f.k", "f.b").agg(F.sum("w").alias("n"), F.min("f.x").alias("low"), F.max("f.x").alias("high")).collect()
    out: dict[int, list] = {k: [] for k, _, _ in keys}
    for r in sorted(rows, key=lambda r: (r["k"], r["low"])):
        out[r["k"]].append(r)
    return out


def _holding(buckets: list, below: int, rank: int) -> Interval:
    for r in buckets:
        if rank < below + r["n"]:
            return Interval(r["low"], r["high"], r["n"], below)
        below += r["n"]
    raise ValueError("the table has changed between two passes over it")


def _estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _at_once(df: DataFrame, columns: dict[str, Column], shares: list[float], weight: Column) -> dict[str, tuple[int, list[float | None]]]:
    value = {c: F.when(~F.isnan(x), x) for c, x in ((c, columns[c].cast("double")) for c in columns)}
    row = df.agg(*[f.alias(f"{k}{i}") for i, x in enumerate(value.values()) for k, f in (("n", F.coalesce(F.sum(F.when(x.isNotNull(), weight)), F.lit(0))), ("q", F.percentile(x, F.lit(shares), weight)))]).first()
    return {c: (row[f"n{i}"], list(row[f"q{i}"]) if row[f"n{i}"] else [None] * len(shares)) for i, c in enumerate(columns)}


def quantiles(df: DataFrame, columns: dict[str, Column], shares: list[float], weight: Column | None = None) -> dict[str, tuple[int, list[float | None]]]:
    """For each named double: how many values it has (nulls and NaN are none), and its quantiles by linear interpolation, None without values.

    Infinite values are values. The passes are made here; `df` should give the same rows each time that it is read. Tables that are small by the
    optimizer's estimate, which is from above, take one aggregation with the same result. With `weight`, a row stands for so many (a whole number).
    """
    weight = F.lit(1) if weight is None else weight
    names = list(columns)
    if columns and shares and _estimated_bytes(df.select(*[x.alias(str(k)) for k, x in enumerate(columns.values())])) <= SMALL_BYTES:
        return _at_once(df, columns, shares, weight)
    value = {c: F.when(~F.isnan(x), x) for c, x in ((c, columns[c].cast("double")) for c in names)}
    end = lambda x: F.when(x.isin(float("inf"), float("-inf")), F.when(x > 0, F.lit(1 << 40)).otherwise(F.lit(-(1 << 40)))).otherwise(_log_bucket(x))
    first = _counted(df, [(k, value[c], F.when(value[c].isNotNull(), end(value[c]))) for k, c in enumerate(names)], weight)
    total = {c: sum(r["n"] for r in first[k]) for k, c in enumerate(names)}
    wanted = {(c, r) for c in names if total[c] for s in shares for at in [(total[c] - 1) * s] for r in (math.floor(at), math.ceil(at))}
    at = {(c, r): _holding(first[names.index(c)], 0, r) for c, r in wanted}
    known: dict[tuple[str, int], float] = {}
    while True:
        known |= {w: i.low for w, i in at.items() if i.low == i.high}
        at = {w: i for w, i in at.items() if i.low != i.high}
        if not at:
            break
        parts = sorted({(w[0], i) for w, i in at.items()}, key=lambda p: (p[0], p[1].low))
        inside = lambda c, i: (value[c] >= i.low) & (value[c] <= i.high)
        few = all(i.rows <= FEW_ROWS for _, i in parts)
        # few rows: each value is a bucket of its own
        got = _by_value(df, [(k, value[c], inside(c, i)) for k, (c, i) in enumerate(parts)], weight) if few else _counted(df, [(k, value[c], F.when(inside(c, i), _split(value[c], i))) for k, (c, i) in enumerate(parts)], weight)
        place = {p: k for k, p in enumerate(parts)}
        at = {(c, r): _holding(got[place[c, i]], i.below, r) for (c, r), i in at.items()}
    out: dict[str, tuple[int, list[float | None]]] = {}
    for c in names:
        found: list[float | None] = []
        for s in shares:
            where = (total[c] - 1) * s
            low, high = (known.get((c, r)) for r in (math.floor(where), math.ceil(where)))
            found.append(None if low is None else low if low == high else low + (high - low) * (where - math.floor(where)))
        out[c] = total[c], found
    return out


def _by_value(df: DataFrame, keys: list[tuple[int, Column, Column]], weight: Column) -> dict[int, list]:
    found = F.array_compact(F.array(*[F.when(inside, F.struct(F.lit(k).alias("k"), x.alias("low"))) for k, x, inside in keys]))
    rows = df.select(F.explode(found).alias("f"), weight.alias("w")).groupBy("f.k", "f.low").agg(F.sum("w").alias("n")).withColumn("high", F.col("low")).collect()
    out: dict[int, list] = {k: [] for k, _, _ in keys}
    for r in sorted(rows, key=lambda r: (r["k"], r["low"])):
        out[r["k"]].append(r)
    return out
