"""Near-duplicate documents by HyperMinHash registers, banding, and verification on full shingle sets.

A register keeps, of the least hash in its bucket, the number of leading zeros and the first bits
after them (a 16-bit float). Registers of empty buckets are taken from another bucket by a fixed
random probe order, which keeps the chance that two documents agree in a register at their Jaccard
similarity. Four registers make a band; documents that agree in a whole band are candidates. An
estimate of the similarity, corrected for registers that agree by accident, throws out candidates far below
the threshold; the rest is verified on the full sets.

Groups of copies stay linear: documents with the same shingle set are one node, and in a bucket
of candidates every member is first compared with the bucket's pivot only. After the links found are
closed, only members that are still in different components need comparing. Of these, nodes that share
too few shingles with all others together to link to any are set aside, and the rest is
compared across components, so a linked group is never expanded into its pairs.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.llm.common import WordHasher, has_columns, make_room, materialise, scratch, shingles, tune, words_of
from siltmark.llm.components import connected_components

REGISTERS = 128
ROWS_PER_BAND = 4
BANDS = REGISTERS // ROWS_PER_BAND
MANTISSA_BITS = 10
#: Cells of the counts that bound what two small sets can share.
CELLS = 128
#: Link when 100 * intersection >= PERCENT * union.
PERCENT = 75
#: The estimate must be below the threshold by so many standard deviations to drop a candidate...
SIGMAS = 5.0
#: ...and applies to sets with so many shingles at least; smaller ones fill registers from few hashes.
ESTIMATE_FROM = 2 * REGISTERS
#: Ids of candidates that may be broadcast to read their texts (8 bytes each); more are joined by shuffling.
BROADCAST_IDS = 500_000
#: Shingle hashes that a worker remembers while it verifies (8 bytes each).
KNOWN_SHINGLES = 2_000_000

_TOP = np.uint64(64 - 7)
_REST = np.uint64((1 << 57) - 1)


def _probes() -> np.ndarray:
    rng = np.random.default_rng(20240607)
    return np.stack([rng.permutation(REGISTERS) for _ in range(REGISTERS)])


_PROBES = _probes()


def registers(hashes: np.ndarray) -> np.ndarray:
    """128 registers of a set of sorted distinct 64-bit hashes: (leading zeros + 1) << 10 | mantissa."""
    out = np.zeros(REGISTERS, np.uint16)
    if len(hashes) == 0:
        return out
    bucket = (hashes >> _TOP).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))  # sorted: the first in a bucket is its least
    rest = ((hashes[first] & _REST) >> np.uint64(4)).astype(np.float64)  # 53 bits, exact in a float
    frac, exp = np.frexp(rest)
    zeros = np.where(rest > 0, 53 - exp, 53)
    mantissa = np.where(rest > 0, np.floor((frac * 2 - 1) * (1 << MANTISSA_BITS)), 0)
    out[bucket[first]] = ((zeros + 1).astype(np.int64) << MANTISSA_BITS) | mantissa.astype(np.int64)
    empty = np.flatnonzero(out == 0)
    if len(empty):
        filled = out != 0
        order = _PROBES[empty]
        out[empty] = out[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make_room("near_dedup")
    hasher = WordHasher()
    for batch in batches:
        n, high, low, packed, cells = [], [], [], [], []
        for text in batch.column(1).to_pylist():
            s = shingles(hasher(words_of(text)))
            d = xxhash.xxh3_128_digest(s.tobytes())
            n.append(len(s))
            high.append(int.from_bytes(d[:8], "little", signed=True))
            low.append(int.from_bytes(d[8:], "little", signed=True))
            c = np.bincount(s.astype(np.int64) & (CELLS - 1), minlength=CELLS)
            cells.append(c.tolist() if len(s) and c.max() < 128 else None)
            packed.append(registers(s).view(np.int64) if len(s) else np.empty(0, np.int64))
        lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, packed)], dtype=np.int32), pa.array(np.concatenate(packed) if packed else np.empty(0, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), lists, pa.array(cells, pa.list_(pa.int8()))], ["doc_id", "n", "fp1", "fp2", "regs", "cells"])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the shingle set), fp1 and fp2 (128-bit digest of the set), regs (packed registers), cells.

    cells counts the set's shingles by 7 bits of their hash; null where a count needs more than a byte.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_sketch, "doc_id long, n long, fp1 long, fp2 long, regs array<long>, cells array<byte>")


def estimate(a: Column, b: Column, n: Column, m: Column) -> Column:
    """Jaccard similarity from packed registers, corrected for registers that agree by accident.

    Two unrelated sets of sizes n and m agree in a register with a chance of
    0.68 * n * m / (n + m)^2 / 2^mantissa bits: the share of buckets in which both
    leasts fall into one cell of the register's 16-bit float.
    """
    # a field of the xor that is zero is a register that agrees
    same = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)),
        F.lit(0),
        lambda acc, x: acc + sum((F.when(F.shiftrightunsigned(x, 16 * i).bitwiseAND(F.lit(0xFFFF)) == 0, 1).otherwise(0) for i in range(4)), F.lit(0)),
    )
    chance = F.lit(0.68 / (1 << MANTISSA_BITS)) * n * m / ((n + m) * (n + m))
    return (same / F.lit(float(REGISTERS)) - chance) / (F.lit(1.0) - chance)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make_room("near_dedup")
    hasher, known = WordHasher(), OrderedDict()
    held = 0

    def of(doc: int, text: str) -> np.ndarray:
        nonlocal held
        key = (doc, len(text), hash(text))
        if key in known:
            known.move_to_end(key)
            return known[key]
        made = known[key] = shingles(hasher(words_of(text)))
        held += len(made)
        while held > KNOWN_SHINGLES and len(known) > 1:
            held -= len(known.popitem(last=False)[1])
        return made

    for batch in batches:
        a_ids, b_ids, a_text, b_text = (batch.column(i).to_pylist() for i in range(4))
        keep = []
        for i, (a, b, s, t) in enumerate(zip(a_ids, b_ids, a_text, b_text, strict=True)):
            x, y = of(a, s), of(b, t)
            least, most = sorted((len(x), len(y)))
            if 100 * least < PERCENT * most:
                continue
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both and 100 * both >= PERCENT * (least + most - both):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])


def _near(n: Column, m: Column, r: Column, t: Column) -> Column:
    """Whether the estimate allows a link."""
    j = PERCENT / 100
    slack = SIGMAS * (j * (1 - j) / REGISTERS) ** 0.5
    return (F.least(n, m) < ESTIMATE_FROM) | (estimate(r, t, n, m) >= F.lit(j - slack))


def _may_link(shared: Column, n: Column, m: Column) -> Column:
    """A link of sets of sizes n and m needs 7 * intersection >= 3 * (n + m), at 75 %."""
    return F.lit(100 + PERCENT) * shared >= F.lit(PERCENT) * (n + m)


def _cells_allow(n: Column, m: Column, x: Column, y: Column) -> Column:
    """Two sets share at most the sum of the lesser counts of their cells; this is exact, and sharp for small sets."""
    most = F.aggregate(F.zip_with(x, y, lambda p, q: F.least(p, q)), F.lit(0), lambda acc, v: acc + v.cast("int"))
    return x.isNull() | y.isNull() | _may_link(most, n, m)


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those that link by their full sets."""
    with_b = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long")


def _pivot_pairs(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each member of a bucket with the bucket's pivot, where sizes and estimate allow a link."""
    pairs = members.where("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    side = lambda x: nodes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"r_{x}"), F.col("cells").alias(f"k_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    return both.where(_may_link(F.least("n_a", "n_b"), F.col("n_a"), F.col("n_b")) & _near(F.col("n_a"), F.col("n_b"), F.col("r_a"), F.col("r_b")) & _cells_allow(F.col("n_a"), F.col("n_b"), F.col("k_a"), F.col("k_b"))).select("a", "b")


def _unresolved(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (key, band, id, label) of buckets that hold more than one label, without the pivot, which has been compared with all."""
    m = members.join(labels.select(F.col("node").alias("id"), "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    # a table, so that the join reads two shuffles, of which adaptive execution can split a hot bucket
    mixed = materialise(m.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key"), "mixed")
    return m.where("id <> pivot").join(mixed, "key", "left_semi").select("key", "band", "id", "label")


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make_room("near_dedup")
    hasher = WordHasher()
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            s = shingles(hasher(words_of(text)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), doc, np.int64)), pa.array(s.view(np.int64))], ["id", "shingle"])


def _shareable(ids: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, c, n) of nodes that may link to one of `ids`: c leaves out shingles that occur in no other of these sets.

    A set of size n can link to none if 7 c < 3 (n + 3/4 n).
    """
    rows = texts.join(ids, "id", "left_semi").select("id", "text").mapInArrow(_shingle_rows, "id long, shingle long")
    alone = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).where("c = 1").groupBy("id").agg(F.count(F.lit(1)).alias("alone"))
    sized = nodes.select("id", "n").join(ids, "id", "left_semi").join(alone, "id", "left").withColumn("c", F.col("n") - F.coalesce("alone", F.lit(0)))
    return sized.where(F.lit(100) * F.col("c") >= F.lit(PERCENT) * F.col("n")).select("id", "c", "n")


def _able(left: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows of `left` with c, n and regs of nodes that may link to another one; twice, as what is set aside takes its shingles with it."""
    able = _shareable(left.select("id").distinct(), nodes, texts)
    rows = materialise(left.join(able, "id"), "able")
    least = materialise(rows.groupBy("key").agg(F.min("n").alias("least")), "least")
    ids = rows.join(least, "key").where(_may_link(F.col("c"), F.col("n"), F.col("least"))).select("id").distinct()
    able = materialise(_shareable(ids, nodes, texts), "able")
    return left.join(able.join(nodes.select("id", "regs", "cells"), "id"), "id")


def _rest_pairs(able: DataFrame) -> DataFrame:
    """Pairs (a, b) with two labels that share a bucket and may link, each in the first bucket that both are in.

    In each bucket, members without its most frequent label are compared with all members, so a
    large group that is linked already is not compared within itself. The conditions are part of the join.
    """
    rows = materialise(able, "rest")
    most = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("key").agg(F.max(F.struct("k", "label")).alias("x"))
    # tables, so that both joins read two shuffles, of which adaptive execution can split a hot bucket
    most = materialise(most.select("key", F.col("x.label").alias("most")), "most")
    minor = materialise(rows.join(most, "key").where("label <> most"), "minor")
    x = minor.select("key", *[F.col(c).alias(f"{c}_x") for c in ("band", "id", "label", "c", "n", "regs", "cells", "most")])
    y = rows.select("key", *[F.col(c).alias(f"{c}_y") for c in ("id", "label", "c", "n", "regs", "cells")])
    once = (F.col("label_y") == F.col("most_x")) | (F.col("id_x") < F.col("id_y"))
    first = F.array_position(F.zip_with("regs_x", "regs_y", lambda p, q: p == q), F.lit(True)) == F.col("band_x") + 1
    on = (F.col("label_x") != F.col("label_y")) & once & _may_link(F.least("c_x", "c_y"), F.col("n_x"), F.col("n_y")) & first & _near(F.col("n_x"), F.col("n_y"), F.col("regs_x"), F.col("regs_y")) & _cells_allow(F.col("n_x"), F.col("n_y"), F.col("cells_x"), F.col("cells_y"))
    pairs = x.alias("x").join(y.alias("y"), (F.col("x.key") == F.col("y.key")) & on)
    return pairs.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b"))


def _components(docs: DataFrame, some: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets (fp1, fp2, id, ...) of sketched documents, and the labels (node, label) of those that link."""
    classes = materialise(some.groupBy("fp1", "fp2").agg(F.min(F.struct("doc_id", "n", "regs", "cells")).alias("x")).select("fp1", "fp2", F.col("x.doc_id").alias("id"), "x.n", "x.regs", "x.cells"), "classes")
    nodes = classes.select("id", "n", "regs", "cells")
    banded = nodes.select("id", F.posexplode("regs").alias("band", "four")).select(F.xxhash64("band", "four").alias("key"), "band", "id")
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("pivot")).where("c > 1").select("key", "pivot")
    # a table, so that the join reads two shuffles, of which adaptive execution can split a hot bucket
    members = materialise(banded.join(materialise(shared, "shared"), "key"), "members")
    nodes = materialise(nodes.join(members.select("id").distinct(), "id", "left_semi"), "nodes")
    ids = nodes.select("id")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    texts = materialise(texts.join(F.broadcast(ids) if nodes.count() <= BROADCAST_IDS else ids, "id", "left_semi"), "texts")
    links = materialise(_links(materialise(_pivot_pairs(members, nodes), "pairs"), texts), "links")
    labels = materialise(connected_components(links), "labels")
    left = materialise(_unresolved(members, labels), "unresolved")
    more = materialise(_links(materialise(_rest_pairs(_able(left, nodes, texts)), "pairs"), texts), "links")
    if not more.isEmpty():
        labels = materialise(connected_components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more)), "labels")
    return classes, labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of `docs` (doc_id, text; others are ignored).

    Words are cut at ASCII white space and lower-cased in A-Z; the set of a document is its
    distinct 5-word shingles, its whole sequence if it has fewer words, and empty without words
    or with a null text. Documents with 100 * intersection >= 75 * union are linked;
    component_id is the least doc_id reachable. Defined cases: a document with an empty set is
    its own component; a row without a doc_id has a null component and is kept, and links
    nothing; repeated rows come back repeated; rows that share a doc_id but not a text count as
    one vertex where that doc_id stands for both; an empty table gives an empty result. Sets
    are of 64-bit shingle hashes and equal sets are found by a 128-bit digest.
    """
    spark = docs.sparkSession
    tune(spark)
    has_columns(docs, "doc_id", "text")
    rows = materialise(sketches(docs), "sketches")
    some = rows.where("n > 0 AND doc_id IS NOT NULL")
    kept: list[DataFrame] = []
    with scratch(spark, kept):  # of the tables of this block, the result reads two
        classes, labels = _components(docs, some)
        kept += [classes, labels]
    named = classes.select("fp1", "fp2", "id")
    named = named.join(labels.select(F.col("node").alias("id"), "label"), "id", "left").select("fp1", "fp2", F.coalesce("label", "id").alias("component"))
    inside = some.select("doc_id", "n", "fp1", "fp2").join(named, ["fp1", "fp2"]).select("doc_id", "n", "component")
    outside = rows.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component"))
    return inside.unionByName(outside).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))
