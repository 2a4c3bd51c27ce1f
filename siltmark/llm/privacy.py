"""Information-theoretic sanitisation: personal data by patterns, and terms that give it away by how the corpus uses them.

A protected entity is a value that a pattern finds (an address, a number). Corpus counts say what a term tells about it: of the documents
that hold term t, the share p in which entity c stands near t leaves -log2 p bits of doubt about c, and t adds log2(p N / N_c) bits
to what one knows without it. A term that leaves at most GENERALISE_BITS is replaced by its kind, one that leaves at most REMOVE_BITS is removed, wherever it
stands, with the entity or without. Terms need SUPPORT different surroundings of the entity on either side, and one for each COPIES documents, so that
copies of one text, near ones too, are no evidence; and they must add GAIN_BITS, so that an entity that is everywhere gives nothing away.

Counts cover all documents: contexts of entities in one pass, frequencies of the terms in them in a second one, documents that hold a disclosing term in
a third. Which terms count is told by bit maps of fixed size; what passes them is joined exactly.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltmark.llm.common import has_columns, make_room, materialise, mix64, named, scratch, tune

KINDS = ("email", "ip", "card", "phone")
#: From the at sign on; what stands before it is read backwards, so that a long run of letters is read once.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: At the beginning of a run of digits only: where that fails, its other places fail too.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]+")
#: A term is a run of letters, digits and anything beyond ASCII but the marks of TYPOGRAPHY. A-Z count as a-z.
TYPOGRAPHY = "\u00a0\u00ab\u00bb\u2010\u2013\u2014\u2018\u2019\u201c\u201d\u201e\u2026\u3000\u3001\u3002"
TERM = re.compile(r"[A-Za-z0-9_\u0080-\U0010ffff]+")

_TO_SPACES = bytes(b if b >= 128 or chr(b) in "_0123456789abcdefghijklmnopqrstuvwxyz" else 97 + b - 65 if 65 <= b <= 90 else 32 for b in range(256))
_DIGITS = bytes(100 if 48 <= b <= 57 else 46 if b == 46 else 32 for b in range(256))

#: Terms on either side of an entity that count as near it.
NEAR = 8
#: Different surroundings that a term needs on either side, and documents for each of them at most.
SUPPORT, COPIES = 3, 2
#: Bits of doubt about an entity under which a term is generalised or removed, and bits that it must add.
GENERALISE_BITS, REMOVE_BITS, GAIN_BITS = 1.0, 0.5, 3.0
#: Bits of a map of terms, and places that a term takes in it. A full map only lets more terms through to the exact join.
MAP_BITS, MAP_PLACES = 1 << 23, 3
#: Rows of contexts that a task holds before it hands them on.
HELD_ROWS = 50_000

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the four kinds, leftmost and without overlap inside a kind, by kind and start. Every pattern reads a text once, whatever is in it."""
    out: list[Span] = []
    if "@" in text:
        end = 0
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                end = m.end()
                out.append(("email", start, end))
    digits = text.encode("utf-8", "surrogatepass").translate(_DIGITS)
    if b"d" not in digits:
        return out
    if b"d.d" in digits:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(x := p.lstrip("0")) < 4 and int(x or "0") < 256 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := NOT_DIGITS.sub("", m[0])) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGITS.sub("", m[0])) <= 15]
    return out


def entity(kind: str, value: str) -> int:
    """What a found value stands for: addresses in any case, numbers in any spelling."""
    value = value.lower() if kind == "email" else value if kind == "ip" else NOT_DIGITS.sub("", value)
    return _signed(f"{kind}:{value}".encode())


def _signed(data: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(data)
    return h - (1 << 64) if h >> 63 else h


def _folded(term: str) -> bytes:
    return term.encode("utf-8", "surrogatepass").lower()


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def masked(text: str, spans: list[Span]) -> str:
    """The text with blanks for its spans and for marks beyond ASCII, as long as before."""
    if not text.isascii():
        for mark in TYPOGRAPHY:
            text = text.replace(mark, " ")
    out, at = [], 0
    for a, b in _merged((a, b) for _, a, b in spans):
        out += [text[at:a], " " * (b - a)]
        at = b
    return "".join([*out, text[at:]]) if out else text


def contexts(text: str) -> Iterator[tuple[int, int | None, int, int, int]]:
    """(entity, term, hashes of the terms before and after, 1 where this is the first such pair of the text) for each term near an entity.

    One row with a null term stands for the entity itself, once a text.
    """
    spans = base_spans(text)
    if not spans:
        return
    found = list(TERM.finditer(masked(text, spans)))
    starts, ends = [m.start() for m in found], [m.end() for m in found]
    seen: set[tuple[int, int | None]] = set()
    for kind, a, b in spans:
        who = entity(kind, text[a:b])
        if (who, None) not in seen:
            seen.add((who, None))
            yield who, None, 0, 0, 1
        to, since = bisect_right(ends, a), bisect_left(starts, b)
        before = [_folded(m[0]) for m in found[max(0, to - NEAR) : to]]
        after = [_folded(m[0]) for m in found[since : since + NEAR]]
        left, right = (_signed(b"\n".join(x)) for x in (before, after))
        for term in dict.fromkeys(before + after):
            t = _signed(term)
            yield who, t, left, right, int((who, t) not in seen)
            seen.add((who, t))


def _places(terms: np.ndarray) -> list[np.ndarray]:
    x, out = terms.astype(np.uint64), []
    for _ in range(MAP_PLACES):
        x = mix64(x + np.uint64(0x9E3779B97F4A7C15))
        out.append((x % np.uint64(MAP_BITS)).astype(np.int64))
    return out


def term_map(terms: DataFrame) -> np.ndarray:
    """A bit map of the column `term`, MAP_BITS long whatever there is; put together on the executors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(MAP_BITS, bool)
        for batch in batches:
            for at in _places(batch.column(0).to_numpy(zero_copy_only=False)):
                bits[at] = True
        words = np.packbits(bits, bitorder="little").view("<i8")
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(words[at], pa.int64())], ["at", "word"])

    words = terms.select("term").where("term IS NOT NULL").mapInArrow(run, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word"))
    out = np.zeros(MAP_BITS // 64, "<i8")
    for row in words.toLocalIterator():  # MAP_BITS / 64 rows at most
        out[row["at"]] = row["word"]
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _in_map(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    first, *rest = _places(hashes)
    hit = bits[first]
    for at in rest:
        hit &= bits[at]
    return hit


def _terms(text: str | None) -> set[bytes]:
    """The distinct terms of a text outside of personal data, as TERM finds them."""
    return set(masked(text, base_spans(text)).encode("utf-8", "surrogatepass").translate(_TO_SPACES).split()) if text else set()


def _let_through(bits: np.ndarray, terms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms, and which of them are in the map."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms))
    return hashes.view(np.int64), _in_map(bits, hashes)


def _text_only(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(named(text).cast("string").alias("text"))


def cooccurrence(docs: DataFrame, text: str = "text") -> DataFrame:
    """entity, term (hashes; a null term counts documents with the entity), n (documents), support: least number of different surroundings on a side."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("privacy")
        held: list[tuple] = []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], ["entity", "term", "before", "after", "first"])
        for batch in batches:
            for value in batch.column(0):
                for row in contexts(value.as_py() or ""):
                    held.append(row)
                    if len(held) >= HELD_ROWS:
                        yield pack()
                        held = []
        if held:
            yield pack()

    tune(docs.sparkSession)
    rows = _text_only(docs, text).mapInArrow(run, "entity long, term long, before long, after long, first long")
    counts = rows.groupBy("entity", "term").agg(F.sum("first").alias("n"), F.count_distinct("before").alias("_b"), F.count_distinct("after").alias("_a"))
    return counts.select("entity", "term", "n", F.least("_a", "_b").alias("support")).where(f"term IS NULL OR (support >= {SUPPORT} AND n <= {COPIES} * support)")


def document_frequencies(docs: DataFrame, bits: np.ndarray, text: str = "text") -> DataFrame:
    """term, n: documents that hold it outside of personal data, for terms that the map lets through. Counted for each batch before the shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("privacy")
        wanted = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            counts: Counter[bytes] = Counter()
            for value in batch.column(0):
                counts.update(_terms(value.as_py()))
            hashes, hit = _let_through(wanted, list(counts))
            yield pa.RecordBatch.from_arrays([pa.array(hashes[hit]), pa.array(np.fromiter(counts.values(), np.int64, len(counts))[hit])], ["term", "n"])

    tune(docs.sparkSession)
    return _text_only(docs, text).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def disclosing(docs: DataFrame, text: str = "text") -> DataFrame:
    """term, doubt (bits left about the entity that it gives away most) and gain (bits added) of terms beyond the thresholds."""
    pairs = materialise(cooccurrence(docs, text), "pairs")
    frequencies = document_frequencies(docs, term_map(pairs), text)
    total = _text_only(docs, text).count()
    entities = pairs.where("term IS NULL").select("entity", F.col("n").alias("n_entity"))
    scored = pairs.where("term IS NOT NULL").select("entity", "term", "n").join(frequencies.withColumnRenamed("n", "n_term"), "term").join(entities, "entity")
    scored = scored.select("term", F.log2(F.col("n_term") / F.col("n")).alias("doubt"), F.log2(F.col("n") * F.lit(total) / (F.col("n_term") * F.col("n_entity"))).alias("gain"))
    scored = scored.where(f"doubt <= {GENERALISE_BITS} AND gain >= {GAIN_BITS}")
    return scored.groupBy("term").agg(F.min("doubt").alias("doubt"), F.max("gain").alias("gain"))


def _holding(docs: DataFrame, bits: np.ndarray, text: str) -> DataFrame:
    """h1, h2 (of the text), term: distinct terms of each text that the map lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("privacy")
        wanted = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            held = [_terms(value.as_py()) for value in batch.column(2)]
            terms = list(set().union(*held))
            hashes, hit = _let_through(wanted, terms)
            known = {terms[k]: int(hashes[k]) for k in np.flatnonzero(hit)}
            found = [(h1, h2, known[t]) for h1, h2, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), held, strict=True) for t in own & known.keys()] if known else []
            yield pa.RecordBatch.from_arrays([pa.array([row[k] for row in found], pa.int64()) for k in range(3)], ["h1", "h2", "term"])

    tune(docs.sparkSession)
    t = named(text).cast("string")
    return docs.select(F.xxhash64(t).alias("h1"), F.xxhash64(F.lit("2"), t).alias("h2"), t.alias("text")).mapInArrow(run, "h1 long, h2 long, term long").distinct()


def generalised(term: str) -> str:
    return "[NUMBER]" if term.isdigit() else "[NAME]" if term[:1].isupper() else "[TERM]"


def sanitise_text(text: str, terms: dict[int, bool]) -> tuple[list[Span], list[Span], str]:
    """Base spans, those and the spans of disclosing terms (kind `term`), and the sanitised text. `terms`: by hash, whether it is removed."""
    base = base_spans(text)
    extra: list[Span] = []
    edits = [(a, b, f"[{kind.upper()}]") for kind, a, b in base]
    if terms:
        for m in TERM.finditer(masked(text, base)):
            gone = terms.get(_signed(_folded(m[0])))
            if gone is not None:
                extra.append(("term", *m.span()))
                edits.append((*m.span(), "" if gone else generalised(m[0])))
    out, at = [], 0
    for a, b, new in sorted(edits):
        if a >= at:
            out += [text[at:a], new]
        at = max(at, b)
    return base, base + extra, "".join([*out, text[at:]]) if edits else text


_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with base_spans, all_spans (arrays of kind, start, end in code points) and sanitised; columns of those names are replaced.

    Defined cases: a null text has no spans and a null sanitised text, an empty one stays empty; repeated rows come back repeated, and copies of a
    text count as documents but as one surrounding; terms with equal doubt are treated alike; an empty table gives an empty result. A very long text
    is read once by each pattern, and its contexts are handed on in parts.
    """
    spark = has_columns(docs, text).sparkSession
    made = ("base_spans", "all_spans", "sanitised")
    rest = [c for c in docs.columns if c not in made]
    kept: list[DataFrame] = []
    with scratch(spark, kept):
        terms = materialise(disclosing(docs, text).select("term", (F.col("doubt") <= REMOVE_BITS).alias("gone")), "terms")
        found = _holding(docs, term_map(terms), text).join(terms, "term")
        # of terms that a text holds itself; read from a table, so that its size decides on the join
        plan = materialise(found.groupBy("h1", "h2").agg(F.collect_list("term").alias("terms"), F.collect_list("gone").alias("gone")), "plan")
        kept.append(plan)
    t = named(text).cast("string")
    rows = docs.select(*[named(c) for c in rest])
    keyed = rows.select(F.struct(*[named(c) for c in rest]).alias("row"), t.alias("text"), F.xxhash64(t).alias("h1"), F.xxhash64(F.lit("2"), t).alias("h2"))
    joined = keyed.join(plan, ["h1", "h2"], "left").select("text", "terms", "gone", "row")
    schema = T.StructType([T.StructField("row", rows.schema), T.StructField("base_spans", _SPAN), T.StructField("all_spans", _SPAN), T.StructField("sanitised", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("privacy")
        pack = lambda spans: pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in spans], _SPANS)
        for batch in batches:
            values, terms, gone = (batch.column(k) for k in range(3))
            done = [sanitise_text(v.as_py() or "", dict(zip(t.as_py() or (), g.as_py() or (), strict=True))) for v, t, g in zip(values, terms, gone, strict=True)]
            clean = pa.array([None if not v.is_valid else d[2] for v, d in zip(values, done, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(3), pack(d[0] for d in done), pack(d[1] for d in done), clean], ["row", "base_spans", "all_spans", "sanitised"])

    return joined.mapInArrow(run, schema).select(*[F.col("row").getField(c).alias(c) for c in rest], *made)


def privacy_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the base), base_sha256, spans and sanitised_sha256 for each row of `docs` (doc_id, text).

    Cases as for `sanitise`; a null text has the digests of no bytes, a null doc_id stays null, other columns are ignored.
    """
    rows = sanitise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("all_spans").alias("spans"), F.sha2(F.coalesce("sanitised", F.lit("")), 256).alias("sanitised_sha256"))
