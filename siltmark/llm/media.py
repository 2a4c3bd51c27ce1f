"""Media columns as MPEG transport streams (ISO/IEC 13818-1): multiplexing, parsing, timestamps, random-access points.

A payload is cut into access units of 576 bytes. Each is one elementary-stream packet with a presentation time,
in four transport packets; every tenth unit carries a clock reference and the random-access mark.
Program tables come first and are repeated. Both ways work on arrays of packets, not on single ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.llm.common import has_columns, make_room, materialise, numbered, tune

PACKET = 188
SYNC = 0x47
UNIT = 576
PMT_PID, DATA_PID, PROGRAM = 0x1000, 0x0100, 1
STREAM_TYPE, STREAM_ID = 0x06, 0xBD  # private data in elementary packets
CLOCK = 90_000
#: Ticks between units: 576 samples at 48 kHz.
UNIT_TICKS = CLOCK * UNIT // 48_000
#: Units between random-access points, and between repeats of the tables.
ACCESS_EVERY = 10
TABLES_EVERY = 1000
PES_HEADER = 14


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    raw = bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section
    return np.frombuffer(raw.ljust(PACKET, b"\xff"), np.uint8).copy()


_PAT = _table_packet(0, _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
_PMT = _table_packet(PMT_PID, _section(2, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"))


def padded(data: bytes) -> bytes:
    """Bytes 255 appended up to a positive multiple of 576."""
    return data + b"\xff" * (UNIT - len(data) % UNIT if not data or len(data) % UNIT else 0)


def mux(payload: bytes) -> bytes:
    """A transport stream that holds `payload`, whose length is a positive multiple of 576."""
    n = len(payload) // UNIT
    unit = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    k = np.arange(n, dtype=np.int64)
    pts = (k * UNIT_TICKS) % (1 << 33)
    head = np.zeros((n, PES_HEADER), np.uint8)
    head[:, :9] = np.frombuffer(bytes([0, 0, 1, STREAM_ID]) + (UNIT + 8).to_bytes(2, "big") + b"\x84\x80\x05", np.uint8)
    head[:, 9] = 0x21 | ((pts >> 29) & 0x0E)
    head[:, 10] = (pts >> 22) & 0xFF
    head[:, 11] = ((pts >> 14) & 0xFE) | 1
    head[:, 12] = (pts >> 7) & 0xFF
    head[:, 13] = ((pts << 1) & 0xFE) | 1
    pes = np.concatenate([head, unit], axis=1)  # 590 bytes
    out = np.full((n, 4, PACKET), 0xFF, np.uint8)
    out[:, :, 0] = SYNC
    out[:, :, 1] = DATA_PID >> 8
    out[:, 0, 1] |= 0x40
    out[:, :, 2] = DATA_PID & 0xFF
    counter = (np.arange(4 * n) % 16).astype(np.uint8).reshape(n, 4)
    out[:, :, 3] = 0x10 | counter
    access = k % ACCESS_EVERY == 0
    pcr = pts[access]
    for rows, first in ((np.flatnonzero(access), 176), (np.flatnonzero(~access), 184)):
        x = out[rows]
        if first == 176:
            x[:, 0, 3] |= 0x20
            x[:, 0, 4], x[:, 0, 5] = 7, 0x50
            x[:, 0, 6], x[:, 0, 7], x[:, 0, 8] = (pcr >> 25) & 0xFF, (pcr >> 17) & 0xFF, (pcr >> 9) & 0xFF
            x[:, 0, 9], x[:, 0, 10], x[:, 0, 11] = (pcr >> 1) & 0xFF, ((pcr << 7) & 0x80) | 0x7E, 0
        cuts = np.cumsum([0, first, 184, 184, PES_HEADER + UNIT - first - 368])
        for i in range(4):
            size = cuts[i + 1] - cuts[i]
            if i == 3:  # stuffing in an adaptation field
                x[:, 3, 3] |= 0x20
                x[:, 3, 4], x[:, 3, 5] = 183 - size, 0
            x[:, i, PACKET - size :] = pes[rows, cuts[i] : cuts[i + 1]]
        out[rows] = x
    parts, tables = [], 0
    for at in range(0, n, TABLES_EVERY):
        pat, pmt = _PAT.copy(), _PMT.copy()
        pat[3] |= tables % 16
        pmt[3] |= tables % 16
        tables += 1
        parts += [pat.tobytes(), pmt.tobytes(), out[at : at + TABLES_EVERY].tobytes()]
    return b"".join(parts)


def _packets(stream: bytes) -> tuple[np.ndarray, int]:
    """Packets as rows of 188 bytes, and the bytes skipped to find the sync byte again."""
    raw = np.frombuffer(stream, np.uint8)
    if len(raw) % PACKET == 0 and (raw.reshape(-1, PACKET)[:, 0] == SYNC).all():
        return raw.reshape(-1, PACKET), 0
    rows, at, skipped = [], 0, 0
    while at + PACKET <= len(raw):
        if raw[at] == SYNC and (at + PACKET == len(raw) or at + PACKET < len(raw) and raw[at + PACKET] == SYNC):
            rows.append(raw[at : at + PACKET])
            at += PACKET
        else:
            at += 1
            skipped += 1
    skipped += len(raw) - at
    return (np.stack(rows) if rows else np.empty((0, PACKET), np.uint8)), skipped


def _payloads(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packets that carry data, and where it begins in each."""
    data = q[(q[:, 3] & 0x10) > 0]
    with_field = (data[:, 3] & 0x20) > 0
    return data, np.where(with_field, 5 + data[:, 4].astype(np.int64), 4)


def _sections(p: np.ndarray, pid: int, pids: np.ndarray, table: int) -> list[bytes]:
    """Sections of a table whose checksum holds, each once; they may go on over packets and begin behind one another."""
    out: dict[bytes, None] = {}
    open_part: bytearray | None = None
    last, runs = -1, set()

    def take(buffer: bytearray) -> bytearray | None:
        while len(buffer) >= 3 and buffer[0] != 0xFF:
            size = 3 + (int.from_bytes(buffer[1:3], "big") & 0x0FFF)
            if len(buffer) < size:
                return buffer
            raw = bytes(buffer[:size])
            if raw not in out and raw[0] == table and size >= 12 and crc32_mpeg(raw) == 0:
                out[raw] = None
            del buffer[:size]
        return buffer if buffer and buffer[0] != 0xFF else None

    data, start = _payloads(p[pids == pid])
    for row, at in zip(data, start.tolist(), strict=True):
        counter, begins = int(row[3]) & 0x0F, bool(row[1] & 0x40)
        raw = row[at:].tobytes()
        if begins and open_part is None and raw in runs:  # a repeat of tables that have been read
            last = counter
            continue
        if counter == last:
            continue
        if open_part is not None and counter != (last + 1) % 16:
            open_part = None
        last = counter
        if begins:
            pointer = raw[0] if raw else 0
            if open_part is not None:
                take(open_part + raw[1 : 1 + pointer])
            open_part = take(bytearray(raw[1 + pointer :]))
            if open_part is None:
                runs.add(raw)
        elif open_part is not None:
            open_part = take(open_part + raw)
    return [raw[8:-4] for raw in out]


def _stream(q: np.ndarray) -> dict:
    """The elementary packets of one stream, with their timestamps, and what is wrong with them."""
    has_data, has_field = (q[:, 3] & 0x10) > 0, (q[:, 3] & 0x20) > 0
    data = q[has_data]
    flags = np.where(has_field[has_data] & (data[:, 4] > 0), data[:, 5], 0)
    step = np.diff((data[:, 3] & 0x0F).astype(np.int64)) % 16
    repeat = np.concatenate([[False], (step == 0) & (data[1:] == data[:-1]).all(axis=1)]) if len(data) else np.empty(0, bool)
    # the discontinuity flag announces a break
    gap = np.concatenate([[False], (step != 1) & ~repeat[1:] & ((flags[1:] & 0x80) == 0)]) if len(data) else np.empty(0, bool)
    field = q[has_field & (q[:, 4] > 0)]
    clock = field[(field[:, 5] & 0x10) > 0].astype(np.int64)
    pcr = (clock[:, 6] << 25) | (clock[:, 7] << 17) | (clock[:, 8] << 9) | (clock[:, 9] << 1) | (clock[:, 10] >> 7)
    data, flags, gap = data[~repeat], flags[~repeat], gap[~repeat]
    data, start = _payloads(data)
    body = data[np.arange(PACKET)[None, :] >= start[:, None]]
    begins = (data[:, 1] & 0x40) > 0
    offset = np.concatenate([[0], np.cumsum(np.maximum(PACKET - start, 0))])
    at = offset[:-1][begins]
    mark = ((flags & 0x40) > 0)[begins]
    # a break inside an elementary packet: at a packet that does not begin one
    hurt = np.bincount(np.maximum(np.cumsum(begins)[gap & ~begins] - 1, 0), minlength=len(at)) > 0 if len(at) else np.empty(0, bool)
    upto = np.append(at[1:], len(body)) if len(at) else at
    out, pts, kept, damaged = [], [], [], []
    for i, (a, b) in enumerate(zip(at.tolist(), upto.tolist(), strict=True)):
        h = body[a : min(b, a + 19)].tobytes()
        if len(h) < 9 or h[:3] != b"\x00\x00\x01":
            continue
        size = int.from_bytes(h[4:6], "big")
        if hurt[i] or (size and b - a < 6 + size):
            damaged.append(len(kept))
        kept.append(i)
        pts.append(((h[9] >> 1 & 7) << 30) | (h[10] << 22) | (h[11] >> 1 << 15) | (h[12] << 7) | (h[13] >> 1) if h[7] & 0x80 and len(h) >= 14 else -1)
        out.append(body[a + 9 + h[8] : min(b, a + 6 + size) if size else b])
    return {
        "payload": np.concatenate(out).tobytes() if out else b"",
        "pts": np.array(pts, np.int64),
        "access": np.flatnonzero(mark[kept]) if kept else np.empty(0, np.int64),
        "pcr": pcr,
        "gaps": int(gap.sum()),
        "repeats": int(repeat.sum()),
        "damaged": damaged,
    }


def demux(stream: bytes) -> dict:
    """Program tables, elementary streams, timestamps and errors of a transport stream.

    `streams` has one entry for each elementary stream of the tables, in their order; the first one's fields stand in the result as well.
    payload: of its elementary packets; pts: one for each (-1: none); access: indices of those at random-access points; pcr: clock bases;
    gaps: breaks of the continuity counter that no flag announces (a repeated packet is not one, and counts once); damaged: indices of
    elementary packets that lack a part, which are passed on as far as they are there; skipped: bytes without sync.
    """
    p, skipped = _packets(stream)
    pids = ((p[:, 1] & 0x1F).astype(np.int64) << 8) | p[:, 2]
    whole = {"skipped": skipped, "packets": len(p)}
    streams = []
    programs = [(int.from_bytes(s[i : i + 2], "big"), int.from_bytes(s[i + 2 : i + 4], "big") & 0x1FFF) for s in _sections(p, 0, pids, 0) for i in range(0, len(s) - 3, 4)]
    for number, table in programs:
        for s in _sections(p, table, pids, 2) if number else []:
            at = 4 + (int.from_bytes(s[2:4], "big") & 0x0FFF)
            while at + 5 <= len(s):
                pid = int.from_bytes(s[at + 1 : at + 3], "big") & 0x1FFF
                if pid not in {x["pid"] for x in streams}:
                    streams.append({"program": number, "pid": pid, "stream_type": s[at]} | _stream(p[(pids == pid) & ((p[:, 1] & 0x80) == 0)]))
                at += 5 + (int.from_bytes(s[at + 3 : at + 5], "big") & 0x0FFF)
    none = {"pid": None, "stream_type": None} | _stream(np.empty((0, PACKET), np.uint8))
    return whole | (streams[0] if streams else none) | {"streams": streams}


def features(got: dict) -> str:
    """What the stored stream says: units, random-access points, times, and level and spread of its 8-bit samples."""
    samples = np.frombuffer(got["payload"], np.uint8)
    pts = got["pts"]
    return (
        f"units={len(pts)};access={len(got['access'])};first_pts={pts[0] if len(pts) else -1};last_pts={pts[-1] if len(pts) else -1};"
        f"pcr={len(got['pcr'])};gaps={got['gaps']};mean={samples.mean() if len(samples) else 0:.4f};std={samples.std() if len(samples) else 0:.4f};"
        f"flips={int((np.diff((samples >= 128).astype(np.int8)) != 0).sum())}"
    )


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `media`: the text's UTF-8 bytes, padded, as a transport stream. A null text counts as empty; a column of that name is replaced."""
    has_columns(docs, text)
    tune(docs.sparkSession)
    rest = [c for c in docs.columns if c != "media"]
    inputs, names, at = numbered(docs, rest), rest, rest.index(text)
    rest = inputs.columns
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in inputs.schema) + ", media binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("media")
        for batch in batches:
            made = [mux(padded((t or "").encode("utf-8", "surrogatepass"))) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.binary())], [*rest, "media"])

    return inputs.mapInArrow(run, schema).toDF(*names, "media")


def parse(media: DataFrame, column: str = "media") -> DataFrame:
    """`media` with payload, pts and access_points (arrays), gaps, damaged, skipped, n_streams and feature read from the stored bytes.

    They are those of the first elementary stream; `demux` gives all. A null stream gives an empty payload; columns of these names are replaced.
    """
    has_columns(media, column)
    tune(media.sparkSession)
    new = ("payload", "pts", "access_points", "gaps", "damaged", "skipped", "n_streams", "feature")
    rest = [c for c in media.columns if c not in new]
    inputs, names, at = numbered(media, rest), rest, rest.index(column)
    rest = inputs.columns
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in inputs.schema) + ", payload binary, pts array<long>, access_points array<long>, gaps long, damaged array<long>, skipped long, n_streams long, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("media")
        for batch in batches:
            got = [demux(m or b"") for m in batch.column(at).to_pylist()]
            arrays = [
                pa.array([g["payload"] for g in got], pa.binary()),
                pa.array([g["pts"].tolist() for g in got], pa.list_(pa.int64())),
                pa.array([g["access"].tolist() for g in got], pa.list_(pa.int64())),
                pa.array([g["gaps"] for g in got], pa.int64()),
                pa.array([g["damaged"] for g in got], pa.list_(pa.int64())),
                pa.array([g["skipped"] for g in got], pa.int64()),
                pa.array([len(g["streams"]) for g in got], pa.int64()),
                pa.array([features(g) for g in got], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*rest, *new])

    return inputs.mapInArrow(run, schema).toDF(*names, *new)


def media_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, gaps and points of each row of `docs` (doc_id, text).

    Media are stored as a table in the shared folder and read back from it. Defined cases: a null or empty text is one unit of padding; a null
    doc_id stays null; equal texts have equal values; repeated rows come back repeated; other columns are ignored; an empty table gives an empty result.
    """
    has_columns(docs, "doc_id", "text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stored = store(rows).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "media")
    got = parse(materialise(stored, "media"))
    last = F.substring("payload", -32, 32)
    return got.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(last).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "gaps",
        F.size("access_points").cast("long").alias("points"),
    )
