"""Benchmark decontamination by latent semantic retrieval, then longest common subsequences and answer checks.

Benchmark passages are TF-IDF vectors (document frequencies are counted over all documents). A distributed randomised
SVD gives latent spaces, of a rank well below their passages, in which every window of every document is compared with all passages: by the cosine with a
passage's latent direction, with the window's length taken as that of a copy, and of the window's words those that point away from the passage left out. So whatever else a window holds only adds, and a copy is found at any rank.
Passages of which a space keeps too little go to a further one, which keeps more of fewer. Candidates are verified on the words: the longest common subsequence of the passage and a stretch of
the document of about its length, and for weaker matches, as paraphrases are, whether the passage's last sentence (the answer) is there as well.

Passages are the query set. They are taken in blocks of a bounded size, each block, with its spaces, against all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.llm.common import has_columns, make_room, materialise, named, tune

#: Passages in a block, and bytes of its spaces: bound what goes to every worker.
BLOCK_ITEMS = 4_000
BLOCK_BYTES = 64 << 20
#: Rank of a space, passages in it at most, and its bytes.
RANK = 64
SPACE_ITEMS = 256
SPACE_BYTES = 16 << 20
#: The share of its energy that each passage keeps in its space at least.
ENERGY_SHARE = 0.25
OVERSAMPLE = 16
POWER_STEPS = 2
#: Words in half a window; windows overlap by half.
HALF = 32
#: A candidate window's projection on a passage is this share of what one window at least has where the passage is copied word by word:
#: a cosine whose norm is not the window's, which would take in whatever else it holds.
CONTAINED_SHARE = 0.25
#: Words of a text that are compared at a time, and the characters that are cut into words at a time: bound what a text of any length needs.
SECTION_WORDS = 16_384
SECTION_CHARS = 1 << 20
#: A leak: this share of the passage in order within about its length, or the lesser share with its answer.
LCS_SHARE = 0.6
PARAPHRASE_SHARE = 0.5
ANSWER_SHARE = 0.8
#: Length of the stretch that is compared, in passages.
STRETCH = 1.25

_SPACED = bytes(32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" or b < 32 else b for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words without ASCII punctuation."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACED).split()


def word_parts(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, some at a time: it is cut at blanks."""
    text, at = text or "", 0
    while len(text) - at > SECTION_CHARS and (cut := text.find(" ", at + SECTION_CHARS)) >= 0:
        yield tokens(text[at:cut])
        at = cut
    yield tokens(text[at:] if at else text)


def sections(text: str | None, margin: int) -> Iterator[tuple[int, list[bytes], int, int]]:
    """(first word, words, first and last window start + 1) of overlapping sections of a text.

    Each window belongs to one section, which has `margin` words at least on both sides of it, or all that there are.
    So what is found does not depend on the sections. Window starts are multiples of HALF in the text.
    """
    core = max(SECTION_WORDS, 4 * margin) // HALF * HALF
    margin = -(-margin // HALF) * HALF
    held: list[bytes] = []
    first, start = 0, 0  # of what is held; of the windows that are still to come
    for part in word_parts(text):
        held = held + part if held else part
        while first + len(held) >= start + core + margin:
            yield first, held[: start + core + margin - first], start, start + core
            start += core
            drop = max(0, start - margin - first)
            held, first = held[drop:], first + drop
    if first + len(held) > start or not start:
        yield first, held, start, first + len(held)


def answer_of(text: str) -> list[bytes]:
    """Words of the last sentence."""
    parts = [p for p in re.split(r"[.?!:\n]+", text) if p.strip()]
    return tokens(parts[-1]) if parts else []


def lcs(masks: dict[bytes, int], length: int, words: list[bytes]) -> int:
    """Length of the longest common subsequence, bit-parallel over the passage given as masks of positions."""
    v = (1 << length) - 1
    full = v
    for w in words:
        m = masks.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


def masks_of(words: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | (1 << i)
    return out


def least_held(size: int) -> float:
    """The share of the weight of a copied passage of `size` words that the best window holds at least: windows overlap by half, and every other one tiles the text."""
    return 1.0 if size <= HALF + 1 else 1 / (math.ceil((size - 1) / (2 * HALF)) + 1)


class Block:
    """A block of passages with their weights: what workers hold."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids = [i for i, _ in items]
        self.words = [tokens(t) for _, t in items]
        self.answers = [answer_of(t) for _, t in items]
        self.vocab = {w: k for k, w in enumerate(sorted({w for ws in self.words for w in ws}))}
        self.idf = np.ones(len(self.vocab) + 1)
        self.spaces: list[Space] = []
        #: Words around a window that verification may read.
        self.margin = max(len(ws) + math.ceil(len(ws) * STRETCH) for ws in self.words) + 4 * HALF

    def row(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of a passage, their counts and their weights."""
        c = Counter(self.vocab[w] for w in self.words[k])
        cols = np.fromiter(c, np.int64, len(c))
        counts = np.fromiter(c.values(), np.int64, len(c))
        return cols, counts, counts * self.idf[cols]


class Space:
    """The latent space of some passages of a block."""

    def __init__(self, block: Block, members: list[int]) -> None:
        self.members = np.array(members)
        rows = [block.row(k) for k in members]
        terms = np.unique(np.concatenate([c for c, _, _ in rows]))
        self.local = np.full(len(block.vocab) + 1, -1, np.int32)
        self.local[terms] = np.arange(len(terms))
        norms = np.array([np.linalg.norm(x) for _, _, x in rows])
        self.rows = [(self.local[c], x / norm) for (c, _, x), norm in zip(rows, norms, strict=True)]
        self.counts = np.zeros((len(terms), len(members)), np.int32)
        for i, (c, counts, _) in enumerate(rows):
            self.counts[self.local[c], i] = counts
        sizes = np.array([len(block.words[k]) for k in members])
        #: Words of the passage that a text must have, and its weight that a window must hold.
        self.least_words = PARAPHRASE_SHARE * sizes
        self.least_weight = (CONTAINED_SHARE * norms * [least_held(int(n)) for n in sizes]).astype(np.float32)
        #: The basis times the passages in it, where positive: what a word adds to a window's projection on each passage.
        self.projection = np.zeros((len(terms), len(members)), np.float32)

    def fit(self, spark: SparkSession, rank: int) -> np.ndarray:
        """The projection, with passages at length 1 in the latent space; the share of its energy that each of them has kept."""
        table = spark.createDataFrame([(c.tolist(), x.tolist()) for c, x in self.rows], "cols array<long>, vals array<double>").coalesce(4)
        basis = randomised_svd(table, len(self.counts), min(rank, len(self.rows)))
        latent = np.stack([x.astype(np.float32) @ basis[c] for c, x in self.rows])
        kept = np.linalg.norm(latent, axis=1)
        # a passage's own words sum up to `kept` at least, as those below zero are left out
        self.projection = np.maximum(basis @ (latent / np.maximum(kept, 1e-9)[:, None]).T, 0)
        self.least_weight *= kept
        return kept**2

    def only(self, chosen: np.ndarray) -> Space:
        """The space with some of its passages."""
        self.members, self.least_words, self.least_weight = self.members[chosen], self.least_words[chosen], self.least_weight[chosen]
        self.counts, self.projection, self.rows = self.counts[:, chosen], self.projection[:, chosen], []
        return self


def document_frequencies(docs: DataFrame, vocab: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """How many documents hold each word of the vocabulary, and how many there are: one count for each task and word, summed up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("decontam")
        counts, n = np.zeros(len(vocab) + 1, np.int64), 0
        known = vocab.keys()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                for w in set().union(*(known & set(part) for part in word_parts(text))):
                    counts[vocab[w]] += 1
        counts[-1] = n
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["word", "docs"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "word long, docs long").groupBy("word").agg(F.sum("docs").alias("docs")).collect()
    out = np.zeros(len(vocab) + 1, np.int64)
    for r in rows:  # as many as the block has words
        out[r["word"]] = r["docs"]
    return out[:-1], int(out[-1])


def randomised_svd(rows: DataFrame, terms: int, rank: int, seed: int = 11) -> np.ndarray:
    """Right singular vectors (terms x rank) of sparse rows (cols array<long>, vals array<double>).

    The rows stay distributed: each product with the matrix is a pass in which a task adds up its rows' share. What
    comes back is one terms x rank matrix for each of few tasks, bounded by the block; QR and the small SVD are done here.
    """
    width = min(rank + OVERSAMPLE, terms)

    def gram(basis: np.ndarray) -> np.ndarray:
        basis = basis.astype(np.float32)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((terms, basis.shape[1]))
            for batch in batches:
                for cols, vals in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    out[cols] += np.outer(vals, np.asarray(vals) @ basis[cols])
            yield pa.RecordBatch.from_arrays([pa.array([out.astype(np.float32).tobytes()], pa.binary())], ["part"])

        total = np.zeros((terms, basis.shape[1]))
        for r in rows.mapInArrow(run, "part binary").toLocalIterator():
            total += np.frombuffer(r["part"], np.float32).reshape(total.shape)
        return total

    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, width)))[0]
    for _ in range(POWER_STEPS):
        q = np.linalg.qr(gram(q))[0]
    small = q.T @ gram(q)  # of A'A in the subspace
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(values)[::-1][:rank]
    best = best[values[best] > 1e-9]
    return (q @ vectors[:, best]).astype(np.float32)


def fit_block(docs: DataFrame, items: list[tuple[int, str]], rank: int = RANK) -> Block:
    """Weights and latent spaces of a block of passages, of which none is empty."""
    block = Block(items)
    df, n = document_frequencies(docs, block.vocab)
    block.idf = np.append(np.log((n + 1) / (df + 1)) + 0.05, 0.0)  # other words have no weight: what they weigh would grow with the number of documents
    work, members, terms = [], [], set()
    for k, words in enumerate(block.words):
        terms.update(words)
        members.append(k)
        if len(members) == SPACE_ITEMS or 8 * len(members) * len(terms) >= SPACE_BYTES:
            work.append(members)
            members, terms = [], set()
    work = [m for m in (*work, members) if m][::-1]
    while work:
        members = work.pop()
        space = Space(block, members)
        good = space.fit(docs.sparkSession, rank) >= ENERGY_SHARE
        if len(members) <= rank:
            good[:] = True  # nothing is left out of such a space
        if 2 * good.sum() < len(members):
            half = len(members) // 2
            work += [members[half:], members[:half]]
            continue
        if rest := [m for m, g in zip(members, good, strict=True) if not g]:
            work.append(rest)
        block.spaces.append(space.only(good))
    return block


def candidates(block: Block, words: list[bytes], first: int = 0, begin: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    """(first word of the window in `words`, passage) of windows near a passage in its latent space.

    `words` begin at word `first` of the text; of their windows, those that begin at `begin` to `end` of the text are asked for.
    """
    n = len(words)
    if not n:
        return []
    other = len(block.vocab)
    col = np.fromiter(map(block.vocab.get, words, repeat(other)), np.int64, n)
    weight = block.idf[col].astype(np.float32)
    halves = -(-n // HALF)
    lo, hi = (begin - first) // HALF, halves if end is None else min(halves, -(-(end - first) // HALF))
    out: list[tuple[int, int]] = []
    for space in block.spaces:
        term = space.local[col]
        inside = np.flatnonzero(term >= 0)
        term = term[inside]
        # words of a passage that the section has anywhere bound the subsequence
        live = np.flatnonzero(space.counts[np.unique(term)].sum(axis=0) >= space.least_words)
        if not len(live):
            continue
        half = inside // HALF
        heads = np.flatnonzero(np.diff(half, prepend=-1))
        part = np.zeros((halves + 1, len(live)), np.float32)
        part[half[heads]] = np.add.reduceat(space.projection[term[:, None], live[None, :]] * weight[inside, None], heads, axis=0)
        held = part[lo:hi] + part[lo + 1 : hi + 1]
        at, item = np.nonzero(held >= space.least_weight[live])
        out += [((lo + int(a)) * HALF, int(space.members[live[i]])) for a, i in zip(at, item, strict=True)]
    return out


def cosine_of(block: Block, k: int, part: list[bytes]) -> float:
    """Cosine of a passage and a stretch of text over the words of the passage."""
    cols, _, x = block.row(k)
    said = Counter(block.vocab[w] for w in part if w in block.vocab)
    y = np.array([said.get(int(c), 0) for c in cols]) * block.idf[cols]
    return float(x @ y / max(np.linalg.norm(x) * np.linalg.norm(y), 1e-12))


def verify(block: Block, words: list[bytes], found: list[tuple[int, int]], cache: dict, first: int = 0) -> dict[int, tuple[float, float, float, int]]:
    """Of the candidates, leaks: passage -> (cosine, share in order, share of the answer, first word in the text)."""
    best: dict[int, tuple[float, float, int]] = {}
    for start, k in found:
        item = block.words[k]
        size = len(item)
        if k not in cache:
            cache[k] = masks_of(item), masks_of(block.answers[k])
        masks, answer_masks = cache[k]
        stretch = max(size, math.ceil(size * STRETCH))
        step = max(1, size // 4)
        # where less than half of a passage of up to a window's length begins in this window, the next one holds more of it
        reach = size // 2 if size <= 2 * HALF else 0
        begin, end = max(0, start - size), max(1, min(len(words) - size // 2, start + 2 * HALF - reach))
        there = 0
        for w in set(words[begin : end + stretch]).intersection(masks):
            there |= masks[w]
        if there.bit_count() < PARAPHRASE_SHARE * size:  # words of the passage that occur at all bound the subsequence
            continue
        for a in range(begin, end, step):
            part = words[a : a + stretch]
            share = lcs(masks, size, part) / size
            if share < PARAPHRASE_SHARE or (k in best and best[k][0] >= share):
                continue
            answer = block.answers[k]
            said = lcs(answer_masks, len(answer), part) / len(answer) if answer else 0.0
            if share >= LCS_SHARE or said >= ANSWER_SHARE:
                best[k] = (share, said, a)
    return {k: (cosine_of(block, k, words[a : a + max(len(block.words[k]), math.ceil(len(block.words[k]) * STRETCH))]), share, said, first + a) for k, (share, said, a) in best.items()}


def matches(block: Block, text: str | None, cache: dict) -> dict[int, tuple[float, float, float, int]]:
    """Leaks of a text: passage -> (cosine, share in order, share of the answer, first word)."""
    out: dict[int, tuple[float, float, float, int]] = {}
    for first, words, begin, end in sections(text, block.margin):
        for k, got in verify(block, words, candidates(block, words, first, begin, end), cache, first).items():
            if k not in out or got[1] > out[k][1]:
                out[k] = got
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_share and first_word of each passage of `benchmark` (item_id, text) that a row of `docs` (doc_id, text) holds.

    Null and empty passages and texts match nothing. Repeated rows of documents give repeated rows; repeated passages are each reported.
    Without passages the result is empty. Passages of any number are read in blocks by item_id, so none is dropped.
    """
    spark = docs.sparkSession
    has_columns(docs, "doc_id", "text")
    has_columns(benchmark, "item_id", "text")
    tune(spark)
    schema = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double, first_word long"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    items: list[tuple[int, str]] = []
    space, terms = 0, set()  # bytes of the spaces at most, and words of the last one

    def search(items: list[tuple[int, str]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(fit_block(texts, items))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            make_room("decontam")
            block, cache = sent.value, {}
            for batch in batches:
                rows = []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for k, (cosine, share, said, a) in matches(block, text, cache).items():
                        rows.append((doc, block.ids[k], cosine, share, said, a))
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], pa.schema(list(zip(names, [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()], strict=True))))

        return texts.mapInArrow(run, schema)

    names = [f.split()[0] for f in schema.split(", ")]
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).orderBy("item_id").toLocalIterator():
        if words := tokens(r["text"]):
            if len(items) % SPACE_ITEMS == 0:
                terms.clear()
            space += 8 * SPACE_ITEMS * len(set(words) - terms)
            terms.update(words)
            items.append((r["item_id"], r["text"]))
        if len(items) == BLOCK_ITEMS or space >= BLOCK_BYTES:
            part = materialise(search(items), "leaks")
            out, items, space = (part if out is None else out.unionByName(part)), [], 0
            terms.clear()
    if items:
        part = search(items)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no passage, with their columns. Rows are matched by doc_id; rows without one are kept."""
    bad = materialise(leaks(docs, benchmark).select("doc_id").distinct(), "leaking")
    return docs.join(bad, "doc_id", "left_anti").select(*[named(c) for c in docs.columns])
