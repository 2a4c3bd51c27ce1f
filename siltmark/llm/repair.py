"""Repair of conversation structure: the cheapest edits that make roles alternate, by dynamic programming over time-major arrays.

Rows of a conversation are kept, given another role or deleted, and empty turns are inserted, so that the initials of its roles read
`(s?(ua)+)?`. Four states say what may come next (0 nothing yet, 1 after s, 2 after u, 3 after a); an insertion or a new role has one possible
symbol in each. Costs are computed backwards for many conversations at once, one row of all of them at a time, and kept; edits are then traced forwards,
again for all at once, taking the ASCII-least letter of those that are as cheap.

Rows are range-sorted, so that a long conversation is spread over tasks, and cut into blocks of bounded size. A block's costs between any entry and
any exit state are a 4 x 4 table; tables of a conversation's blocks are joined, which gives the costs after each block, and blocks
are traced apart. Most conversations are one block, which needs none of that.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltmark.llm.common import ARROW_BYTES, ARROW_ROWS, has_columns, make_room, materialise, scratch, tune

BLANK = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: The state after each symbol (s, u, a, other) in states 0 to 3; 4 is none.
KEEP_TO = np.array([[1, 4, 4, 4], [2, 2, 4, 2], [4, 4, 3, 4], [4, 4, 4, 4]])
#: The state after an inserted or renamed row: user, or assistant after a user.
NEXT = np.array([2, 2, 3, 2])
SYMBOL = ("user", "user", "assistant", "user")
LEGAL = {"su", "ua", "au"}
#: Costs after the last row, of what must still be inserted.
AT_END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 40
#: Kinds of entries: a row, a truncated row, a run of rows that must go, padding.
ROW, CUT, RUN, PAD = range(4)
#: Entries and bytes of a block, and entries of conversations that are computed at once.
BLOCK_ROWS, BLOCK_BYTES, TENSOR = 1_024, 4 << 20, 1 << 17


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and `copies` (0 for a dropped row) of conversations that are damaged by a checksum of id and turn. Nulls are one space."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    text = F.when(k == 1, F.lit("")).when(k == 2, F.regexp_replace(word("text"), "[.!?]", "")).otherwise(word("text"))
    return rows.select("conv_id", "turn", F.when(k == 4, F.lit("user")).otherwise(word("role")).alias("role"), text.alias("text"), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).cast("long").alias("copies"))


def _faults(rows: DataFrame) -> DataFrame:
    """Different rows with `copies`, `known` (whether there is a turn), `blank`, `cut` and `fresh`: no equal role and text stands earlier in the conversation."""
    key = F.md5(F.concat_ws("\n", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.char_length("role"), F.concat("role", "text")).cast("binary"))
    rows = rows.withColumns({"known": F.col("turn").isNotNull(), "seen": F.unhex(key)})
    place = F.struct("known", F.coalesce("turn", F.lit(0)).alias("turn"))
    # only what repeats is joined; its table is read, so that its size decides how
    repeated = rows.where("copies > 0").groupBy("seen").agg(F.min(place).alias("first"), F.sum("copies").alias("_n")).where("_n > 1").select("seen", "first")
    repeated = materialise(repeated, "repeated")
    # rows that are equal are counted before they are dealt out
    one = rows.groupBy("conv_id", "known", "turn", "role", "text", "seen").agg(F.sum("copies").alias("copies"))
    met = one.join(repeated, "seen", "left")
    fresh = F.col("first").isNull() | (F.col("first") == place)
    blank, cut = ~F.col("text").rlike(BLANK), ~F.col("text").rlike(ENDED)
    return met.select("conv_id", "known", "turn", "role", "text", "copies", blank.alias("blank"), fresh.alias("fresh"), cut.alias("cut"))


def _padded(sizes: list[int], columns: list[list], fill: int) -> np.ndarray:
    """Time-major: one row for each step, one column for each conversation."""
    out = np.full((max(sizes, default=0), len(sizes)), fill, np.int64)
    for k, values in enumerate(columns):
        out[: sizes[k], k] = values
    return out


class Tensor:
    """Entries of many blocks of like length: initials, kinds and weights by time."""

    def __init__(self, blocks: list[dict]) -> None:
        sizes = [len(b["kinds"]) for b in blocks]
        self.steps, self.n = max(sizes, default=0), len(blocks)
        self.codes, self.kinds, self.weights = (_padded(sizes, [b[c] for b in blocks], f) for c, f in (("codes", 3), ("kinds", PAD), ("weights", 0)))

    def back(self, after: np.ndarray, keep: bool) -> list[np.ndarray]:
        """Costs from each state (axis 1) to what `after` ends in (axis 2), before each step if `keep`, else before the first one only."""
        every, now = np.arange(self.n)[:, None], after
        out = [now]
        for t in range(self.steps - 1, -1, -1):
            kind = self.kinds[t][:, None, None]
            extra = TRUNCATED * (kind == CUT)
            beyond = np.concatenate([now, np.full_like(now[:, :1], FAR)], axis=1)
            best = np.minimum(beyond[every, KEEP_TO[self.codes[t]]], now[:, NEXT] + REROLE) + extra
            best = np.minimum(np.where(kind == RUN, FAR, best), now + DELETE * self.weights[t][:, None, None])
            for _ in range(2):
                best = np.minimum(best, best[:, NEXT] + INSERT)
            now = np.where(kind == PAD, now, np.minimum(best, FAR))
            if keep:
                out.append(now)
        return out[::-1] if keep else [now]

    def trace(self, costs: list[np.ndarray], start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each step: states before it, insertions before it, and its letter; and the states at the end."""
        every, state = np.arange(self.n), start.copy()
        before, inserted, letters = np.zeros((self.steps, self.n), np.int8), np.zeros((self.steps, self.n), np.int8), np.zeros((self.steps, self.n), np.uint8)
        for t in range(self.steps):
            here, ahead = costs[t][:, :, 0], costs[t + 1][:, :, 0]
            live, run = self.kinds[t] != PAD, self.kinds[t] == RUN
            extra = TRUNCATED * (self.kinds[t] == CUT)
            before[t] = state
            for _ in range(2):
                gone = ahead[every, state] + DELETE * self.weights[t] == here[every, state]
                add = live & ~gone & (here[every, NEXT[state]] + INSERT == here[every, state])
                inserted[t] += add
                state = np.where(add, NEXT[state], state)
            gone = live & (ahead[every, state] + DELETE * self.weights[t] == here[every, state])
            to = KEEP_TO[self.codes[t], state]
            stay = live & ~gone & ~run & (to < 4) & (ahead[every, np.minimum(to, 3)] + extra == here[every, state])
            letters[t] = np.where(gone, ord("D"), np.where(stay, ord("K"), ord("R")))
            state = np.where(live & ~gone, np.where(stay, to, NEXT[state]), state)
        return before, inserted, letters, state


def tensors(blocks: list[dict]) -> Iterator[tuple[list[int], Tensor]]:
    """Places in `blocks`, bucketed by length up to a power of two, TENSOR entries at most at once."""
    buckets: dict[int, list[int]] = {}
    for k, b in enumerate(blocks):
        buckets.setdefault(len(b["kinds"]).bit_length(), []).append(k)
    for width, places in buckets.items():
        step = max(1, TENSOR >> width)
        for at in range(0, len(places), step):
            some = places[at : at + step]
            yield some, Tensor([blocks[k] for k in some])


def block_costs(blocks: list[dict]) -> list[list[int]]:
    """The 16 costs of each block, by entry and exit state."""
    out: list[list[int]] = [[] for _ in blocks]
    unit = np.where(np.eye(4, dtype=bool), 0, FAR).astype(np.int64)
    for places, x in tensors(blocks):
        for k, table in zip(places, x.back(np.broadcast_to(unit, (x.n, 4, 4)), False)[0], strict=True):
            out[k] = table.ravel().tolist()
    return out


def block_exits(blocks: list[dict]) -> list[list[int]]:
    """The state at the end of each block, for each state at its beginning, when its edits are the cheapest to the end of the conversation."""
    out: list[list[int]] = [[] for _ in blocks]
    for places, x in tensors(blocks):
        costs = x.back(np.array([blocks[k]["after"] for k in places], np.int64)[:, :, None], True)
        exits = np.stack([x.trace(costs, np.full(x.n, s))[3] for s in range(4)], axis=1)
        for k, row in zip(places, exits, strict=True):
            out[k] = row.tolist()
    return out


def block_edits(blocks: list[dict]) -> list[tuple[str, list[dict]]]:
    """Letters of the edits of each block, and the turns that it leaves. Blocks have `after`, `entry` and `last`."""
    out: list[tuple[str, list[dict]]] = [("", [])] * len(blocks)
    for places, x in tensors(blocks):
        costs = x.back(np.array([blocks[k]["after"] for k in places], np.int64)[:, :, None], True)
        before, inserted, letters, end = x.trace(costs, np.array([blocks[k]["entry"] for k in places]))
        for j, k in enumerate(places):
            b, audit, turns = blocks[k], [], []

            def add(state: int, n: int, audit: list = audit, turns: list = turns) -> int:
                for _ in range(n):
                    audit.append("I")
                    turns.append({"role": SYMBOL[state], "text": ""})
                    state = int(NEXT[state])
                return state

            steps = zip(b["roles"], b["texts"], b["weights"], before[:, j].tolist(), inserted[:, j].tolist(), letters[:, j].tobytes().decode(), strict=False)
            for role, text, weight, state, n, letter in steps:
                state = add(state, n)
                audit.append(letter * weight)
                if letter != "D":
                    turns.append({"role": role if letter == "K" else SYMBOL[state], "text": text})
            if b["last"]:
                add(int(end[j]), AT_END[int(end[j])] // INSERT)
            out[k] = "".join(audit), turns
    return out


_STATS = ("blank", "duplicate", "truncated", "illegal", "turns")
_INTS, _LONGS, _TEXTS = pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string())
_FIELDS = {"part": pa.int32(), "seq": pa.int64(), "roles": _TEXTS, "texts": _TEXTS, "codes": _INTS, "kinds": _INTS, "weights": _LONGS, "costs": _LONGS, **dict.fromkeys((*_STATS, "least", "most"), pa.int64()), "head": pa.string(), "tail": pa.string()}
_BLOCK = "part int, seq long, roles array<string>, texts array<string>, codes array<int>, kinds array<int>, weights array<long>, costs array<long>, blank long, duplicate long, truncated long, illegal long, turns long, least long, most long, head string, tail string"


class _Builder:
    """A block that rows are added to."""

    def __init__(self, conv: object, part: int, seq: int) -> None:
        self.conv, self.bytes = conv, 0
        self.row: dict = {"conv_id": conv, "part": part, "seq": seq, **{c: [] for c in ("roles", "texts", "codes", "kinds", "weights")}, **dict.fromkeys(_STATS, 0), "least": None, "most": None, "head": None, "tail": None}

    def full(self, most: int) -> bool:
        return len(self.row["kinds"]) >= most or self.bytes >= BLOCK_BYTES

    def _entry(self, role: str, text: str, code: int, kind: int, weight: int) -> None:
        for c, v in zip(("roles", "texts", "codes", "kinds", "weights"), (role, text, code, kind, weight), strict=True):
            self.row[c].append(v)
        self.bytes += 64 + 2 * len(text)

    def add(self, turn: int | None, role: str, text: str, copies: int, blank: bool, fresh: bool, cut: bool) -> None:
        r = self.row
        initial = role[:1]
        r["illegal"] += copies - 1 + (r["tail"] is not None and r["tail"] + initial not in LEGAL)
        r["head"], r["tail"] = initial if r["head"] is None else r["head"], initial
        if turn is not None:
            r["turns"] += turn != r["most"]
            r["least"], r["most"] = turn if r["least"] is None else r["least"], turn
        code = "sua".find(initial) if initial else -1
        more = copies
        if blank:
            r["blank"] += copies
        else:
            r["duplicate"] += copies - fresh
            r["truncated"] += fresh and cut
            if fresh:
                self._entry(role, text, code if code >= 0 else 3, CUT if cut else ROW, 1)
                more -= 1
        if more:
            self._entry("", "", 3, RUN, more)


def _blocks(batches: Iterator[pa.RecordBatch], conv_type: pa.DataType, most: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows to blocks. Each conversation has one at least, rows or none."""
    make_room("repair")
    fields, part, seq = {"conv_id": conv_type, **_FIELDS}, TaskContext.get().partitionId(), 0
    done: list[dict] = []
    size, b = 0, None

    def pack() -> pa.RecordBatch:
        for row, costs in zip(done, block_costs(done), strict=True):
            row["costs"] = costs
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in done], kind) for c, kind in fields.items()], list(fields))

    for batch in batches:
        for conv, turn, role, text, copies, blank, fresh, cut in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b is None or conv != b.conv or b.full(most):
                if b is not None:
                    done.append(b.row)
                    size += b.bytes
                    if size >= ARROW_BYTES or len(done) >= ARROW_ROWS:
                        yield pack()
                        done, size = [], 0
                b, seq = _Builder(conv, part, seq), seq + 1
            if copies:
                b.add(turn, role, text, copies, blank, fresh, cut)
    if b is not None:
        done.append(b.row)
        yield pack()


def joined_blocks(blocks: list[dict]) -> dict:
    """Blocks of one conversation, in order: its totals, its cost, and the costs after each block."""
    total = {c: sum(b[c] for b in blocks) for c in _STATS}
    heard = [b for b in blocks if b["head"] is not None]
    total["illegal"] += sum(a["tail"] + b["head"] not in LEGAL for a, b in pairwise(heard))
    timed = [b for b in blocks if b["least"] is not None]
    total["turns"] -= sum(a["most"] == b["least"] for a, b in pairwise(timed))
    after = [np.array(AT_END, np.int64)]
    for b in reversed(blocks):
        after.append(np.minimum((np.array(b["costs"], np.int64).reshape(4, 4) + after[-1]).min(axis=1), FAR))
    after.reverse()
    return total | {"least": min((b["least"] for b in timed), default=None), "most": max((b["most"] for b in timed), default=None), "cost": int(after[0][0]), "after": [x.tolist() for x in after[1:]]}


def _rows_of(batch: pa.RecordBatch) -> list[dict]:
    return batch.to_pylist()


def _in_order(blocks: DataFrame, *columns: str) -> DataFrame:
    """One row for each conversation, with its blocks in order: tables of a few numbers for each BLOCK_ROWS rows."""
    return blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "seq", *columns))).alias("blocks"))


_TURNS = "array<struct<role:string,text:string>>"
_TURNS_PA = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _edited(blocks: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` of each block, with `audit` and `repaired`."""
    wanted = ["roles", "texts", "codes", "kinds", "weights", "after", "entry", "last"]
    head = blocks.select(*keep)
    at = len(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("repair")
        for batch in batches:
            done = block_edits(_rows_of(batch.select(wanted)))
            yield pa.RecordBatch.from_arrays([*batch.columns[at:], pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], _TURNS_PA)], [*keep, "audit", "repaired"])

    schema = T.StructType([*head.schema.fields, T.StructField("audit", T.StringType()), *blocks.sparkSession.createDataFrame([], f"repaired {_TURNS}").schema.fields])
    return blocks.select(*wanted, *keep).mapInArrow(run, schema)


def _gaps() -> Column:
    return F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps")


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit (K, R, D, I) and repaired (role, text) of each conversation.

    `rows`: conv_id, turn, role, text, and `copies` where a row stands for several (or, with 0, only names its conversation).
    Defined cases: a null role or text is one space; null turns come first, all null have no gaps; rows of one turn are taken by role and text; repeated
    rows are duplicates; a null conv_id is a conversation; other columns are ignored; an empty table gives an empty result. A conversation of any
    length is worked on in blocks, and its result is one row; a very long text is one cell.
    """
    spark = has_columns(rows, "conv_id", "turn", "role", "text").sparkSession
    tune(spark)
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    gone = lambda c: F.when(copies > 0, word(c)).otherwise(F.lit("")).alias(c)
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), gone("role"), gone("text"), copies.alias("copies"))
    kept: list[DataFrame] = []
    with scratch(spark, kept):
        order = ["conv_id", "known", "turn", "role"]
        ordered = _faults(rows).repartitionByRange(*order).sortWithinPartitions(*order, "text").select("conv_id", "turn", "role", "text", "copies", "blank", "fresh", "cut")
        kind = rows.schema["conv_id"].dataType
        arrow = pa.string() if isinstance(kind, T.StringType) else pa.int32() if isinstance(kind, T.IntegerType) else pa.int64()
        blocks = materialise(ordered.mapInArrow(lambda b: _blocks(b, arrow, block_rows), f"conv_id {kind.simpleString()}, {_BLOCK}"), "blocks")
        kept.append(blocks)
        stats = ["least", "most", *_STATS]
        # conversations of several blocks: their costs, joined, and the states between blocks
        several = _in_order(blocks, "costs", "head", "tail", *stats).where(F.size("blocks") > 1)
        long_type = "array<array<bigint>>"
        more = "least long, most long, blank long, duplicate long, truncated long, illegal long, turns long, cost long"

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = [x.split()[0] for x in more.split(", ")]
            for batch in batches:
                got = [joined_blocks(b.as_py()) for b in batch.column(1)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([g[c] for g in got], pa.int64()) for c in names], pa.array([g["after"] for g in got], pa.list_(_LONGS))], [*batch.schema.names, *names, "after"])

        places = "array<struct<part:int,seq:bigint>>"
        shorter = several.schema["blocks"].dataType.simpleString()
        wholes = materialise(several.mapInArrow(join, f"conv_id {kind.simpleString()}, blocks {shorter}, {more}, after {long_type}").withColumn("blocks", F.transform("blocks", lambda b: F.struct(b["part"], b["seq"])).cast(places)), "wholes")
        kept.append(wholes)
        zipped = F.posexplode(F.arrays_zip("blocks", "after"))
        ahead = wholes.select("conv_id", F.size("blocks").alias("n"), zipped.alias("pos", "b")).select(F.col("b.blocks.part").alias("part"), F.col("b.blocks.seq").alias("seq"), F.col("b.after").alias("after"), (F.col("pos") == F.col("n") - 1).alias("last"))
        ahead = materialise(ahead, "ahead")
        kept.append(ahead)

        def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(block_exits(_rows_of(batch)), _INTS)], ["conv_id", "part", "seq", "exits"])

        ended = blocks.select("conv_id", "part", "seq", "codes", "kinds", "weights").join(ahead.drop("last"), ["part", "seq"]).select("conv_id", "part", "seq", "codes", "kinds", "weights", "after")
        chained = _in_order(ended.mapInArrow(exits, f"conv_id {kind.simpleString()}, part int, seq long, exits array<int>"), "exits")
        chain = F.aggregate("blocks", F.array(F.lit(0)), lambda states, b: F.concat(states, F.array(F.element_at(b["exits"], F.element_at(states, -1) + 1))))
        entries = chained.select(F.posexplode("blocks").alias("pos", "b"), chain.alias("states")).select("b.part", "b.seq", F.element_at("states", F.col("pos") + 1).alias("entry"))
        entries = materialise(entries, "entries")
        kept.append(entries)
    whole = blocks.join(ahead, ["part", "seq"], "left_anti").withColumns({"after": F.array(*[F.lit(x).cast("long") for x in AT_END]), "entry": F.lit(0), "last": F.lit(True)})
    whole = whole.withColumn("cost", F.array_min(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda e: F.element_at("costs", e) + F.element_at("after", e))))
    result = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired"]
    short = _edited(whole, ["conv_id", *stats, "cost"]).withColumn("gaps", _gaps()).select(*result)
    parts = _edited(blocks.join(ahead, ["part", "seq"]).join(entries, ["part", "seq"]), ["conv_id", "part", "seq"])
    parts = _in_order(parts, "audit", "repaired").select("conv_id", F.concat_ws("", F.transform("blocks", lambda b: b["audit"])).alias("audit"), F.flatten(F.transform("blocks", lambda b: b["repaired"])).alias("repaired"))
    totals = wholes.drop("blocks", "after").withColumnRenamed("conv_id", "_c")
    long = parts.join(totals, F.col("conv_id").eqNullSafe(F.col("_c"))).withColumn("gaps", _gaps()).select(*result)
    return short.unionByName(long)


def repair_digests(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`repair` of damaged rows, with a digest of the repaired turns (role:text, joined by line ends) in place of them. Cases as there; a conversation
    without rows after the damage has zeros, no edits and the digest of no bytes."""
    done = repair(damage(has_columns(rows, "conv_id", "turn", "role", "text").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")), block_rows)
    text = F.concat_ws("\n", F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])))
    return done.withColumn("repaired_sha256", F.sha2(text, 256)).drop("repaired")
