"""Secret scanning with a worklist of decoded layers.

Each text is scanned for three kinds of secrets. Parts that look encoded (percent escapes,
\\u, \\U and \\x escapes, base64, and what zlib, gzip or zstd give back) are decoded into layers, which are scanned
and searched for further encoded parts until nothing new turns up. A layer keeps, for each of its
characters, where it comes from in the text, so every finding has a span there. A layer equal to one seen before ends its chain.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.llm.common import has_columns, make_room, numbered, tune

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
PERCENT = re.compile(r"[^\s%]*%[0-9A-Fa-f]{2}(?:[^\s%]|%[0-9A-Fa-f]{2})*")
ESCAPED = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2})+")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Between two lines of wrapped base64, and a last line that is short.
LINE_END = re.compile(r"\r?\n[ \t]*")
LAST_LINE = re.compile(r"[A-Za-z0-9+/_-]{1,15}={0,2}(?=[ \t]*(?:[\r\n]|\Z))")
#: How gzip, zstd and zlib begin in base64.
PACKED = re.compile(r"H4sI|KLUv|e[AFJN]")
#: ASCII text, or UTF-8 beyond it, in decoded bytes.
READABLE = re.compile(rb"(?:[\t\n\r\x20-\x7E]|[\xC2-\xDF][\x80-\xBF]|[\xE0-\xEF][\x80-\xBF]{2}|[\xF0-\xF4][\x80-\xBF]{3}){12,}")
#: What a compressed part gives back is one layer up to so many bytes; beyond, it is read as a stream, in layers that are cut at white space.
LAYER_BYTES = 8 << 20
#: A run without white space in such a stream is cut at so many bytes, with an overlap; such cuts are counted in `oversized`.
RUN_BYTES = 16 << 20
OVERLAP = 1 << 16
PIECE = 1 << 20
SPACES = (b" ", b"\n", b"\t", b"\r")
NOT_WHITE = re.compile(rb"[^ \t\r\n]")
#: Keys of assignments, which a cut must not part from their values.
KEYS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
REDACTED = "[SECRET]"

_HEX_MAP = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_B64_MAP = bytes(98 if re.match(r"[A-Za-z0-9+/_-]", chr(b)) else 32 for b in range(256))
_HEX_RUN, _B64_RUN = b"h" * 32, b"b" * 16

Span = tuple[str, int, int]


def base_spans(text: str, raw: bytes | None = None) -> list[Span]:
    """Spans of the three kinds in `text`, leftmost and without overlap inside a kind, sorted by start and kind."""
    raw = text.encode("utf-8", "surrogatepass") if raw is None else raw
    out: list[Span] = []
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if _HEX_RUN in raw.translate(_HEX_MAP):
        out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sort_spans(out)


def sort_spans(spans: list[Span]) -> list[Span]:
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def join_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


class Layer:
    """A decoded text with the span in the original that each character comes from."""

    __slots__ = ("ends", "starts", "text")

    def __init__(self, text: str, starts: np.ndarray | None, ends: np.ndarray | None) -> None:
        self.text, self.starts, self.ends = text, starts, ends

    def origin(self, a: int, b: int) -> tuple[int, int]:
        if self.starts is None or self.ends is None:
            return a, b
        return int(self.starts[a:b].min()), int(self.ends[a:b].max())

    def whole(self, a: int, b: int, text: str) -> Layer:
        """A layer all of which comes from characters a to b of this one."""
        s, e = self.origin(a, b)
        return Layer(text, np.broadcast_to(np.int64(s), len(text)), np.broadcast_to(np.int64(e), len(text)))


class _Source:
    """A readable file over chunks of bytes."""

    def __init__(self, chunks: Iterator[bytes]) -> None:
        self.chunks, self.held = chunks, b""

    def read(self, size: int = -1) -> bytes:
        while not self.held:
            got = next(self.chunks, None)
            if got is None:
                return b""
            self.held = got
        size = len(self.held) if size < 0 else size
        out, self.held = self.held[:size], self.held[size:]
        return out


def _kind(head: bytes) -> str | None:
    if head[:2] == b"\x1f\x8b" or (len(head) > 2 and head[0] == 0x78 and int.from_bytes(head[:2], "big") % 31 == 0):
        return "zlib"
    return "zstd" if head[:4] == b"\x28\xb5\x2f\xfd" else None


def _inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """What zlib, gzip or zstd gives back, some bytes at a time: all members, and what follows the last one as it is. Nothing where it is not compressed.

    A stream that breaks off gives what came before.
    """
    pending = next(chunks, b"")
    kind = _kind(pending)
    try:
        if kind == "zstd":
            with zstandard.ZstdDecompressor().stream_reader(_Source(chain([pending], chunks)), read_across_frames=True) as r:
                while got := r.read(PIECE):
                    yield got
        elif kind == "zlib":
            d = zlib.decompressobj(47)
            while pending:
                if got := d.decompress(pending, PIECE):
                    yield got
                pending = d.unconsumed_tail
                if d.eof:
                    pending = d.unused_data or next(chunks, b"")
                    if _kind(pending) != "zlib":
                        yield pending
                        yield from chunks
                        return
                    d = zlib.decompressobj(47)
                elif not pending:
                    pending = next(chunks, b"")
    except (zlib.error, zstandard.ZstdError):
        return


def _readable(data: bytes) -> str | None:
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    good = sum(c.isprintable() or c in "\t\r\n" for c in text)
    return text if text and good == len(text) else None


def _opened(data: bytes) -> tuple[Iterator[tuple[str, int]], bool]:
    """The texts in decoded bytes, after all layers of compression, each with the number of runs that were cut; and whether all of the bytes are text.

    Inflated bytes of which some are readable are a text with replacements: its secrets are ASCII, whatever stands next to them.
    """
    inflated, seen = False, set()
    while (key := hashlib.sha1(data).digest()) not in seen:  # a stream may hold itself
        seen.add(key)
        more, got = bytearray(), _inflated(iter([data]))
        for piece in got:
            more += piece
            if len(more) > LAYER_BYTES:
                return _blocks(chain([bytes(more)], got)), False
        if not more:
            break
        data, inflated = bytes(more), True
    text = _readable(data)
    whole = text is not None
    if text is None and inflated and READABLE.search(data):
        text = data.decode("utf-8", "replace")
    return iter([] if text is None else [(text, 0)]), whole


def _begun(held: bytearray, cut: int) -> int:
    """Where the next text begins after a cut at white space: at the cut, or at the key of an assignment whose value may stand behind it."""
    if held[cut] != 32:
        return cut
    end = len(held[:cut].rstrip(b" "))
    if end and held[end - 1] in b":=":
        end = len(held[: end - 1].rstrip(b" "))
    end -= bool(end and held[end - 1] in b"\"'")
    key = next((k for k in KEYS if bytes(held[max(0, end - len(k)) : end]).lower() == k), b"")
    return end - len(key) if key else cut


def _wraps(held: bytearray, cut: int) -> bool:
    """Whether a cut at white space may part two lines of wrapped base64."""
    stop = len(held[:cut].rstrip(b" \t\r\n"))
    m = NOT_WHITE.search(held, cut)
    after = m.start() if m else len(held)
    return held.find(b"\n", stop, after) >= 0 and held[max(0, stop - 16) : stop].translate(_B64_MAP) == _B64_RUN and (m is None or held[after : after + 1].translate(_B64_MAP) == b"b")


def _cut_at(held: bytearray) -> tuple[int, int]:
    """The last white space at which nothing is parted, and where the next text begins; 0, 0 where there is none."""
    cut = len(held)
    while (cut := max(held.rfind(c, 0, cut) for c in SPACES)) > 0:
        if not _wraps(held, cut):
            begin = _begun(held, cut)
            return (cut, begin) if begin > 0 else (0, 0)
    return 0, 0


def _blocks(chunks: Iterator[bytes]) -> Iterator[tuple[str, int]]:
    """Texts of a long stream, itself inflated as long as it is compressed, cut at white space; a run that is too long is cut with an overlap.

    Lines of wrapped base64 stay together as a run does. A key before the cut is repeated in the next text, so that its value is found there.
    """
    seen: set[bytes] = set()
    while _kind(head := next(chunks, b"")) and (key := hashlib.sha1(head).digest()) not in seen:
        seen.add(key)
        first = next(inner := _inflated(chain([head], chunks)), b"")
        if not first:  # it only looks compressed
            break
        head, chunks = b"", chain([first], inner)
    held = bytearray(head)
    for piece in chunks:
        held += piece
        if len(held) < LAYER_BYTES:
            continue
        cut, begin = _cut_at(held)
        if not cut and len(held) < RUN_BYTES:
            continue
        yield (held[:cut] if cut else held).decode("utf-8", "replace"), int(not cut)
        held = held[begin:] if cut else held[-OVERLAP:]
    if held:
        yield held.decode("utf-8", "replace"), 0


def _decoded(body: str) -> bytes:
    """Base64 without its padding; a last character too many goes."""
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def _unwrapped(run: str) -> Iterator[tuple[int, int, str, int]]:
    """Texts in a base64 run: (start, end, text, runs cut).

    The run as a whole comes first. Where it does not decode to text, other characters of the alphabet may be glued
    to it, as those of a path are: each of the four alignments is decoded once, and readable stretches of it are texts.
    Compressed parts are tried at each place where their first characters stand.
    """
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    whole, tried = False, len(body) % 4 != 1
    if tried:
        texts, whole = _opened(_decoded(body))
        for text, cut in texts:
            yield 0, len(run), text, cut
        if whole and not PACKED.match(body):
            return
    for m in PACKED.finditer(body):
        if tried and not m.start():
            continue
        # the header is tried on short pieces first: most places only look like one
        if not all(_starts_packed(_decoded(body[m.start() : m.start() + n])) for n in (64, 4096)):
            continue
        for text, cut in _opened(_decoded(body[m.start() :]))[0]:
            yield m.start(), len(run), text, cut
    if whole:
        return
    for phase in range(4):
        for m in READABLE.finditer(_decoded(body[phase:])):
            text = m[0].decode("utf-8", "ignore")
            if text:
                yield phase + m.start() // 3 * 4, min(phase + -(-m.end() // 3) * 4, len(run)), text, 0


def _wrapped(text: str, runs: list[re.Match]) -> Iterator[list[tuple[int, int]]]:
    """Base64 that is wrapped at a width: spans of its lines in `text`, two at least, of which the last may be shorter.

    The first may stand behind other characters of its line, and is then of any length.
    """
    k = 0
    while k < len(runs):
        lines = [runs[k].span()]
        k += 1
        begin, stop = lines[0]
        if not LINE_END.match(text, stop):
            continue
        glued = bool(text[text.rfind("\n", 0, begin) + 1 : begin].strip(" \t"))
        while text[lines[-1][1] - 1] != "=" and (gap := LINE_END.match(text, lines[-1][1])):
            width = lines[-1][1] - lines[-1][0]
            free = glued and len(lines) == 1
            if more := k < len(runs) and runs[k].start() == gap.end():
                line = runs[k].span()
            elif last := LAST_LINE.match(text, gap.end()):
                line = last.span()
            else:
                break
            size = line[1] - line[0]
            if not free and (width % 4 or size > width):
                break
            lines.append(line)
            k += more
            if not more or (not free and size < width):
                break
        if len(lines) > 1:
            yield lines


def _starts_packed(head: bytes) -> bool:
    try:
        if head[:4] == b"\x28\xb5\x2f\xfd":
            zstandard.ZstdDecompressor().stream_reader(head).read(16 * len(head))
        else:
            zlib.decompressobj(47).decompress(head, 16 * len(head))
        return True
    except (zlib.error, zstandard.ZstdError):
        return False


def _percent(layer: Layer, m: re.Match) -> Layer:
    part = m[0]
    chars: list[str] = []
    spans: list[tuple[int, int]] = []
    for x in re.finditer(r"((?:%[0-9A-Fa-f]{2})+)|[\s\S]", part):
        at = m.start() + x.start()
        if not x[1]:
            chars.append(x[0])
            spans.append((at, at + 1))
            continue
        got = bytes.fromhex(x[1].replace("%", "")).decode("utf-8", "replace")
        k = at
        for c in got:
            width = 3 * (len(c.encode()) if c != "�" else 1)
            chars.append(c)
            spans.append((k, min(k + width, m.end())))
            k = min(k + width, m.start() + x.end() - 3)
    return _mapped(layer, chars, spans)


def _escaped(layer: Layer, m: re.Match) -> Layer:
    units = [(int(x[0][2:], 16), m.start() + x.start(), m.start() + x.end()) for x in re.finditer(r"\\[uUx][0-9A-Fa-f]+?(?=\\|$)", m[0])]
    chars, spans, i = [], [], 0
    while i < len(units):
        c, start, end = units[i]
        if 0xD800 <= c < 0xDC00 and i + 1 < len(units) and 0xDC00 <= units[i + 1][0] < 0xE000:
            i += 1
            c, end = 0x10000 + ((c - 0xD800) << 10) + units[i][0] - 0xDC00, units[i][2]
        chars.append("�" if 0xD800 <= c < 0xE000 or c > 0x10FFFF else chr(c))
        spans.append((start, end))
        i += 1
    return _mapped(layer, chars, spans)


def _mapped(layer: Layer, chars: list[str], spans: list[tuple[int, int]]) -> Layer:
    origins = [layer.origin(a, b) for a, b in spans]
    return Layer("".join(chars), np.array([o[0] for o in origins]), np.array([o[1] for o in origins]))


def _with_escapes(layer: Layer, parts: list[tuple[re.Match, Layer]]) -> Layer:
    """The layer's text with its escaped runs replaced, so that a secret half of which was escaped is found."""
    text, starts, ends, at = [], [], [], 0
    for m, got in parts:
        for a, b, piece in ((at, m.start(), None), (m.start(), m.end(), got)):
            if piece is not None:
                text.append(piece.text)
                starts.append(piece.starts)
                ends.append(piece.ends)
            elif b > a:
                text.append(layer.text[a:b])
                starts.append(np.arange(a, b) if layer.starts is None else layer.starts[a:b])
                ends.append(np.arange(a, b) + 1 if layer.ends is None else layer.ends[a:b])
        at = m.end()
    b = len(layer.text)
    text.append(layer.text[at:])
    starts.append(np.arange(at, b) if layer.starts is None else layer.starts[at:])
    ends.append(np.arange(at, b) + 1 if layer.ends is None else layer.ends[at:])
    return Layer("".join(text), np.concatenate(starts), np.concatenate(ends))


def _unwrap_layer(layer: Layer, raw: bytes) -> Iterator[tuple[Layer, int]]:
    """The layers that stand encoded in one, each with the number of runs that were cut to get it."""
    if "%" in layer.text and (parts := [(m, _percent(layer, m)) for m in PERCENT.finditer(layer.text)]):
        yield _with_escapes(layer, parts), 0
    if "\\" in layer.text and (parts := [(m, _escaped(layer, m)) for m in ESCAPED.finditer(layer.text)]):
        yield _with_escapes(layer, parts), 0
    if _B64_RUN not in raw.translate(_B64_MAP):
        return
    runs = list(BASE64.finditer(layer.text))
    for m in runs:
        for a, b, got, cut in _unwrapped(m[0]):
            yield layer.whole(m.start() + a, m.start() + b, got), cut
    for lines in _wrapped(layer.text, runs):
        places = [i for a, b in lines for i in range(a, b)]
        for a, b, got, cut in _unwrapped("".join(layer.text[x:y] for x, y in lines)):
            yield layer.whole(places[a], places[b - 1] + 1, got), cut


def scan(text: str | None) -> dict:
    """base (spans in the text itself), spans (those and what decoding adds), layers, oversized (runs that were cut).

    The worklist is a stack of iterators over the layers of a layer, so that one path of layers is held at a time.
    """
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    base = base_spans(text, raw)
    spans, seen, layers, oversized = set(base), {hashlib.sha1(raw).digest()}, 0, 0
    work = [_unwrap_layer(Layer(text, None, None), raw)]
    while work:
        got, cut = next(work[-1], (None, 0))
        oversized += cut
        if got is None:
            work.pop()
            continue
        if not got.text:
            continue
        raw = got.text.encode("utf-8", "surrogatepass")
        key = hashlib.sha1(raw + b"@%d" % int(got.starts.min())).digest()
        if key in seen:
            continue
        seen.add(key)
        layers += 1
        spans.update((k, *got.origin(a, b)) for k, a, b in base_spans(got.text, raw))
        work.append(_unwrap_layer(got, raw))
    return {"base": base, "spans": sort_spans(list(spans)) if layers else base, "layers": layers, "oversized": oversized}


def redact(text: str, spans: list[Span]) -> str:
    """The text with the union of the spans replaced."""
    out, at = [], 0
    merged: list[list[int]] = []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], REDACTED]
        at = b
    return "".join([*out, text[at:]])


SPAN_TYPE = "array<struct<kind:string,start:long,`end`:long>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with base_spans, all_spans (arrays of kind, start, end), redacted, layers and oversized.

    Spans count code points, ends are exclusive. A null text has no spans and a null redacted text; columns of those names are replaced.
    Repeated rows come back repeated.
    """
    has_columns(docs, text)
    tune(docs.sparkSession)
    new = ("base_spans", "all_spans", "redacted", "layers", "oversized")
    rest = [c for c in docs.columns if c not in new]
    inputs, names, at = numbered(docs, rest), rest, rest.index(text)
    rest = inputs.columns
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in inputs.schema) + f", base_spans {SPAN_TYPE}, all_spans {SPAN_TYPE}, redacted string, layers long, oversized long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("secrets")
        tuples = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for batch in batches:
            texts = batch.column(at).to_pylist()
            got = [scan(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([tuples(g["base"]) for g in got], _SPANS),
                    pa.array([tuples(g["spans"]) for g in got], _SPANS),
                    pa.array([t if t is None or not g["spans"] else redact(t, g["spans"]) for t, g in zip(texts, got, strict=True)], pa.string()),
                    pa.array([g["layers"] for g in got], pa.int64()),
                    pa.array([g["oversized"] for g in got], pa.int64()),
                ],
                [*rest, *new],
            )

    return inputs.mapInArrow(run, schema).toDF(*names, *new)


def secret_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex (of the base), base_sha256, spans, n_layers and n_oversized for each row of `docs` (doc_id, text).

    Defined cases: a null or empty text has no spans, counts of 0 and the digest of no bytes; a null doc_id stays null; repeated rows come back
    repeated; equal spans found in several layers count once; other columns are ignored; an empty table gives an empty result.
    """
    rows = scan_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))).drop("text", "redacted")
    text = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", *[count(k) for k in KINDS], F.sha2(text("base_spans"), 256).alias("base_sha256"), text("all_spans").alias("spans"), F.col("layers").alias("n_layers"), F.col("oversized").alias("n_oversized"))
