"""Helpers that the operators of this subpackage share: input tables, shared scratch tables, word hashing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in one Arrow batch: bound what a Python worker holds, as texts may be very long. A row above the bytes is a batch of its own.
ARROW_ROWS = 512
ARROW_BYTES = 4 << 20
#: Words whose hash a Python worker remembers (some 150 bytes each), and words that are hashed at a time.
WORD_CACHE = 100_000
WORD_SLICE = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return F.col("`" + column.replace("`", "``") + "`")


def numbered(df: DataFrame, columns: list[str]) -> DataFrame:
    """These columns by place (c0, c1, ...), as what goes to Python workers is named without quotes."""
    return df.select(*[named(c) for c in columns]).toDF(*[f"c{k}" for k in range(len(columns))])


def tune(spark: SparkSession) -> None:
    """Bound the batches that go to Python workers. A session's own bounds stay where they are tighter."""
    for key, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        text = str(spark.conf.get(key)).removesuffix("b")
        now = int(text) if text.isdigit() else 0
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


#: What operators remember in a Python worker from task to task, by operator, and how it is dropped.
_HELD: dict[str, Callable[[], None]] = {}


def hold(owner: str, drop: Callable[[], None]) -> None:
    _HELD[owner] = drop


def make_room(owner: str) -> None:
    """At the beginning of a task: drop what other operators remember in this worker, as workers serve one after another, and give freed memory back."""
    for name, drop in _HELD.items():
        if name != owner:
            drop()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # of this C library only
        pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where that is unset, one of our own on this machine, which only a local master shares with its executors: any other is refused.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        where = getattr(spark.sparkContext, "_siltmark_shared", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="siltmark-")
        spark.sparkContext._siltmark_shared = where
        spark.sparkContext.setCheckpointDir(where)
    return f"{where.rstrip('/')}/siltmark-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again.

    This cuts the lineage: a lost executor costs only the files that are read again, and
    the columns stay prunable. `release` removes the tables of an application.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    if (made := _MADE.get()) is not None:
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


#: Paths of the shared tables that the function at work has written.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)


@contextmanager
def scratch(spark: SparkSession, *kept: list[DataFrame]) -> Iterator[None]:
    """Shared tables that are written in this block go at its end, but for those that `kept` lists by then: what is returned may read those alone."""
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
        stay = {df.table_path for dfs in kept for df in dfs}
        for path in made:
            if path not in stay:
                _delete(spark, path)
    finally:
        _MADE.reset(token)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Remove every shared table that this application has written."""
    _delete(spark, shared_dir(spark))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words, cut at ASCII white space, as UTF-8."""
    return [] if not text else text.encode("utf-8", "surrogatepass").lower().split()


class WordHasher:
    """64-bit hashes of words, remembered up to WORD_CACHE words; long texts are hashed in slices."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        parts = []
        for at in range(0, len(words), WORD_SLICE):
            part = words[at : at + WORD_SLICE] if len(words) > WORD_SLICE else words
            new = set(part).difference(known)
            if new:
                if len(known) + len(new) > WORD_CACHE:
                    known.clear()
                    new = set(part)
                for w in new:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            parts.append(np.fromiter(map(known.__getitem__, part), np.uint64, len(part)))
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of k-word shingles; fewer words make one shingle, none make none."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    width = min(k, n)
    acc = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - width + 1 + i])
    return np.unique(acc)


def has_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail early with a clear message when a column is missing."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def unsigned_crc32(text: str | Column) -> Column:
    return F.crc32(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary"))
