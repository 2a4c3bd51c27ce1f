"""Byte-pair encoding by speculation and verification, and decoding.

Text is cut into pieces by the pattern of byte-level tokenizers. For a piece, a greedy
longest match over the vocabulary proposes tokens. The proposal is the exact encoding if no merge
across any border of two adjacent tokens could come before the merges inside them, which is a
property of the pair alone: it is tested for all adjacent pairs of all new pieces at once, on arrays.
Only pieces with a failing pair, or with a token that its own merges do not produce, go through
exact merging. That is done for many words at once, on arrays of their parts. Encoded chunks are remembered in two generations of a bounded size.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.llm.common import has_columns, hold, make_room, numbered, tune

#: White space of the Unicode standard.
SPACE = r"\p{White_Space}"
#: The published pattern of byte-level tokenizers.
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: A piece always starts at a blank that something visible follows: chunks of text that can be encoded apart.
ODD_BLANK = regex.compile(rf" (?=[{SPACE}]|$)")
CHUNK_START = regex.compile(rf"(?= [^{SPACE}])")
BLANK = regex.compile(rf" (?=[^{SPACE}])")
#: Chunks in one generation of what a worker remembers, and the longest it does (some 200 bytes each).
CHUNK_CACHE = 120_000
CHUNK_CHARS = 64
#: Marks that are a piece of their own behind a word: what stands before one is looked up without it.
MARKS = frozenset(",.;:!?")
#: Characters that are cut and encoded at a time: bounds what a very long text needs besides itself.
SLICE_CHARS = 4 << 20
NEVER = (1 << 31) - 1
#: A character that stands for no byte.
SEPARATOR = "\u0100"


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, by its published rule."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges, and for each token the pieces along its left and right edge with the merges that use them up."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        self.bytes = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*self.bytes, *self.special.values()])
        self.table = [self.bytes.get(i, b"") for i in range(self.size)]
        for text, i in self.special.items():
            self.table[i] = text.encode()
        self.ids = {b: i for i, b in self.bytes.items()}
        vocab = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in reversed(list(enumerate(pairs)))}
        made: dict[int, tuple[int, int, int]] = {}
        for (a, b), (r, t) in self.rank.items():
            if t not in made or r < made[t][0]:
                made[t] = (r, a, b)
        if odd := [t["content"] for t in spec["added_tokens"] if any(t.get(k) for k in ("lstrip", "rstrip", "single_word", "normalized"))]:
            raise ValueError(f"added tokens with options that this encoder does not have: {odd}")
        self.greedy = ahocorasick.Automaton()
        for b, i in self.ids.items():
            self.greedy.add_word(b.decode("latin-1"), i)
        self.greedy.make_automaton()
        #: Tokens that exact merging of their own bytes does not give: a proposal that has one fails.
        self.odd = np.zeros(self.size, bool)
        for i, b in self.bytes.items():
            if len(b) > 1:
                self.odd[i] = self.merge(b) != [i]
        self.right, self.right_used = self._edge(made, 2)
        self.left, self.left_used = self._edge(made, 1)
        keys = np.array([a * self.size + b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array([r for r, _ in self.rank.values()], np.int64)[order]
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        self.result = np.zeros(len(pairs), np.int32)
        for r, t in self.rank.values():
            self.result[r] = t
        self.first_ranks = self.rank_of(*(x.ravel() for x in np.meshgrid(self.byte_ids, self.byte_ids, indexing="ij"))).reshape(256, 256)
        self.splitter = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None

    def _edge(self, made: dict, side: int) -> tuple[np.ndarray, np.ndarray]:
        """For each token: the pieces at one edge from the token inward, and the rank of the merge that uses each up."""
        chains = []
        for t in range(self.size):
            chain, used = [t], [NEVER]
            while chain[-1] in made:
                used.append(made[chain[-1]][0])
                chain.append(made[chain[-1]][side])
            chains.append((chain, used))
        depth = max(len(c) for c, _ in chains)
        pieces, used = np.full((self.size, depth), -1, np.int32), np.full((self.size, depth), -1, np.int32)
        for t, (c, u) in enumerate(chains):
            pieces[t, : len(c)], used[t, : len(u)] = c, u
        return pieces, used

    def merge(self, piece: bytes) -> list[int]:
        """Exact merging: the pair of least rank first, the leftmost of equals."""
        parts = [self.ids[piece[i : i + 1]] for i in range(len(piece))]
        none = (1 << 40, -1)
        ranks = [self.rank.get(p, none)[0] for p in zip(parts, parts[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == none[0]:
                break
            i = ranks.index(least)
            parts[i : i + 2] = [self.rank[parts[i], parts[i + 1]][1]]
            del ranks[i]
            if i:
                ranks[i - 1] = self.rank.get((parts[i - 1], parts[i]), none)[0]
            if i < len(ranks):
                ranks[i] = self.rank.get((parts[i], parts[i + 1]), none)[0]
        return parts

    def merge_long(self, piece: bytes) -> list[int]:
        """Exact merging of a long piece, with a heap over linked parts."""
        import heapq

        ids = [self.ids[piece[i : i + 1]] for i in range(len(piece))]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.rank[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = self.rank[pair][1], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if 0 <= k and after[k] < n and (p := (ids[k], ids[after[k]])) in self.rank:
                    heapq.heappush(heap, (self.rank[p][0], k, p))
        return [t for t in ids if t >= 0]

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of the merges of pairs; NEVER where there is none."""
        key = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER).astype(np.int32)

    def _merge_block(self, pieces: list[bytes], width: int) -> list[list[int]]:
        """Exact merging of pieces of at most `width` bytes: in each round, each of them has its first pair of least rank merged."""
        n = len(pieces)
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(n, width)
        size = np.fromiter(map(len, pieces), np.int64, n)
        part, rank = self.byte_ids[raw], self.first_ranks[raw[:, :-1], raw[:, 1:]]
        column = np.arange(width)
        rank[column[None, :-1] >= size[:, None] - 1] = NEVER
        who, out = np.arange(n), [[]] * n
        while len(who):
            at = rank.argmin(axis=1)
            least = np.take_along_axis(rank, at[:, None], 1)[:, 0]
            live = least < NEVER
            if not live.all():
                for k, row, m in zip(who[~live].tolist(), part[~live].tolist(), size[~live].tolist(), strict=True):
                    out[k] = row[:m]
                who, at, least, size, part, rank = who[live], at[live], least[live], size[live], part[live], rank[live]
                if not len(who):
                    break
            row = np.arange(len(who))
            part[row, at] = self.result[least]
            size -= 1
            # what stands right of the pair moves one to the left
            step = column[None, :-1] + (column[None, :-1] > at[:, None])
            part[:, :-1] = np.take_along_axis(part, step, 1)
            step = column[None, :-2] + (column[None, :-2] >= at[:, None])
            rank[:, :-1] = np.take_along_axis(rank, step, 1)
            rank[:, -1] = NEVER
            for side, has in ((at - 1, at > 0), (at, at < size - 1)):
                r, c = row[has], side[has]
                rank[r, c] = self.rank_of(part[r, c], part[r, c + 1])
            ended = row[at >= size - 1]
            rank[ended, np.minimum(at[ended], width - 2)] = NEVER
        return out

    def exact(self, pieces: list[bytes]) -> list[list[int]]:
        """Exact merging, of pieces of about the same length together."""
        out: list[list[int]] = [[]] * len(pieces)
        blocks: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            blocks.setdefault(max(3, (len(p) - 1).bit_length()), []).append(k)
        for bits, members in blocks.items():
            if bits > 6:
                done = [self.merge_long(pieces[k]) for k in members]
            elif len(members) < 8:
                done = [self.merge(pieces[k]) for k in members]
            else:
                done = self._merge_block([pieces[k] for k in members], 1 << bits)
            for k, ids in zip(members, done, strict=True):
                out[k] = ids
        return out

    def propose(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match: tokens of all pieces, and the piece that each belongs to. Every byte is a token, so matches leave no gaps."""
        joined = SEPARATOR.join([p.decode("latin-1") for p in pieces])
        found = np.fromiter(chain.from_iterable(self.greedy.iter_long(joined)), np.int64).reshape(-1, 2)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1)
        return found[:, 1], np.searchsorted(ends, found[:, 0], side="right")

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of adjacent tokens stands: no merge across the border comes before those inside."""
        bad = np.zeros(len(a), bool)
        for i in range(self.right.shape[1]):
            x, x_used = self.right[a, i], self.right_used[a, i]
            live = np.flatnonzero((x >= 0) & ~bad)
            if not len(live):
                break
            for j in range(self.left.shape[1]):
                y, y_used = self.left[b[live], j], self.left_used[b[live], j]
                live, y, y_used = live[y >= 0], y[y >= 0], y_used[y >= 0]
                if not len(live):
                    break
                key = x[live].astype(np.int64) * self.size + y
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                # the leftmost of equal merges goes first, so a tie is lost on the left and won on the right
                bad[live] |= (self.keys[at] == key) & (self.ranks[at] < x_used[live]) & (self.ranks[at] <= y_used)
        return ~bad

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian 32-bit integers."""
        if not pieces:
            return []
        flat, owner = self.propose(pieces)
        fails = np.zeros(len(pieces), bool)
        fails[owner[self.odd[flat]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[inner] * self.size + flat[inner + 1], return_inverse=True)
        good = self.compatible(pairs // self.size, pairs % self.size)[back] if len(pairs) else np.empty(0, bool)
        fails[owner[inner[~good]]] = True
        ids = flat.astype("<u4").tobytes()
        cuts = (4 * np.searchsorted(owner, np.arange(len(pieces) + 1))).tolist()
        out = [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        failing = np.flatnonzero(fails).tolist()
        for k, exact in zip(failing, self.exact([pieces[k] for k in failing]), strict=True):
            out[k] = array("I", exact).tobytes()
        return out


class Encoder:
    """Encodes texts to little-endian 32-bit ids, remembering chunks."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.mark_ids = {m: array("I", [vocabulary.ids[m.encode()]]).tobytes() for m in MARKS}

    @staticmethod
    def slices(text: str) -> Iterator[str]:
        """The text in parts of about SLICE_CHARS that can be encoded apart."""
        at = 0
        while len(text) - at > SLICE_CHARS and (m := CHUNK_START.search(text, at + SLICE_CHARS)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:] if at else text

    @staticmethod
    def chunks(text: str) -> list[str]:
        """The text at the blanks that start a chunk, without them: the first chunk has none, the others have one each."""
        return BLANK.split(text) if ODD_BLANK.search(text) else text.split(" ")

    def _learn(self, new: list[str]) -> list[bytes]:
        """The ids of chunks that have their blank."""
        cut = [[p.encode("utf-8", "surrogatepass") for p in PIECE.findall(c)] for c in new]
        fresh = list({p for c in cut for p in c})
        known = dict(zip(fresh, self.v.encode_pieces(fresh), strict=True))
        return [known[ps[0]] if len(ps) == 1 else b"".join([known[p] for p in ps]) for ps in cut]

    def _encode_lists(self, lists: list[list[str]]) -> list[bytes]:
        """The ids of lists of chunks: what they have is moved to the young generation, which becomes the old one when it is full."""
        heads = [c[0] for c in lists]
        lists = [c[1:] for c in lists]
        new: set[str] = set().union(*lists).difference(self.young)
        known, old = self.young, self.old
        if old:
            kept = new.intersection(old)
            known.update(zip(kept, map(old.__getitem__, kept), strict=True))
            new -= kept
        marked = [c for c in new if c[-1] in MARKS and c[:-1].isalpha()]
        bare = {c[:-1] for c in marked}.difference(known)
        for c in bare.intersection(old):
            known[c] = old[c]
        fresh = [*new.difference(marked).union(bare.difference(known))]
        learnt = self._learn([*heads, *[f" {c}" for c in fresh]])
        known.update(zip(fresh, learnt[len(heads) :], strict=True))
        mark_ids = self.mark_ids
        for c in marked:
            known[c] = known[c[:-1]] + mark_ids[c[-1]]
        out = [h + b"".join(map(known.__getitem__, c)) for h, c in zip(learnt, lists, strict=False)]
        for c in (*fresh, *marked):
            if len(c) > CHUNK_CHARS:
                del known[c]
        if len(known) > CHUNK_CACHE:
            self.young, self.old = {}, known
        return out

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        split = self.v.splitter
        out: list[list[bytes]] = [[] for _ in texts]
        lists: list[list[str]] = []
        places: list[tuple[int, int]] = []
        held = 0

        def flush() -> None:
            for (k, i), ids in zip(places, self._encode_lists(lists), strict=True):
                out[k][i] = ids
            lists.clear()
            places.clear()

        for k, text in enumerate(texts):
            at, parts = 0, []
            if split is not None and any(s in text for s in self.v.special):
                for m in split.finditer(text):
                    parts += [text[at : m.start()], array("I", [self.v.special[m[0]]]).tobytes()]
                    at = m.end()
            parts.append(text[at:] if at else text)
            for part in parts:
                if isinstance(part, bytes):
                    out[k].append(part)
                    continue
                for piece in self.slices(part):
                    places.append((k, len(out[k])))
                    out[k].append(b"")
                    lists.append(self.chunks(piece))
                    held += len(piece)
                    if held >= SLICE_CHARS:
                        flush()
                        held = 0
        flush()
        return [b"".join(p) for p in out]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.v.table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_LOADED: dict[str, Encoder] = {}
hold("bpe", _LOADED.clear)


def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary in a worker."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(Vocabulary(path))
    return _LOADED[path]


def _local(path: str, shipped: str | None) -> str:
    return SparkFiles.get(shipped) if shipped else path


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _shipped(docs: DataFrame, vocabulary: str, ship: bool) -> str | None:
    if ship:
        docs.sparkSession.sparkContext.addFile(vocabulary)
    return vocabulary.rsplit("/", 1)[-1] if ship else None


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ship: bool = False, decode: bool = True) -> DataFrame:
    """`docs` with `tokens` (array of ints) and, if asked for, `decoded` (the text that they give back).

    The ids are those that byte-level tokenizers give for the vocabulary file, strings of added
    tokens included, without truncation or padding. Defined cases: a null text counts as empty, with no tokens and an
    empty decoded text; long texts are encoded in parts and whole; repeated rows come back repeated; an empty table gives an
    empty result; columns named `tokens` or `decoded` are replaced and others pass through. `ship` sends the file to the
    executors where they do not have it at that path.
    """
    has_columns(docs, text)
    tune(docs.sparkSession)
    shipped = _shipped(docs, vocabulary, ship)
    rest = [c for c in docs.columns if c not in ("tokens", "decoded")]
    inputs, names, at = numbered(docs, rest), rest, rest.index(text)
    rest = inputs.columns
    new = ["tokens", "decoded"] if decode else ["tokens"]
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in inputs.schema) + ", tokens array<int>" + ", decoded string" * decode

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("bpe")
        enc = encoder(_local(vocabulary, shipped))
        for batch in batches:
            coded = enc.encode_batch(_texts(batch.column(at)))
            offsets = np.cumsum([0, *(len(c) // 4 for c in coded)], dtype=np.int32)
            made = [pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(coded), "<u4").astype(np.int32)))]
            if decode:
                made.append(pa.array([enc.decode(c) for c in coded], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*rest, *new])

    return inputs.mapInArrow(run, schema).toDF(*names, *new)


def encode_digests(docs: DataFrame, vocabulary: str, ship: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row of `docs` (doc_id, text): `encode` with digests in the worker, so that tokens stay there.

    Defined cases as for `encode`: a null or empty text has no tokens and the digests of no bytes; a null doc_id stays null; other columns are ignored.
    """
    has_columns(docs, "doc_id", "text")
    tune(docs.sparkSession)
    shipped = _shipped(docs, vocabulary, ship)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("bpe")
        enc = encoder(_local(vocabulary, shipped))
        for batch in batches:
            coded = enc.encode_batch(_texts(batch.column(1)))
            columns = [
                batch.column(0),
                pa.array([len(c) // 4 for c in coded], pa.int64()),
                pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()),
                pa.array([hashlib.sha256(enc.decode(c).encode("utf-8", "surrogatepass")).hexdigest() for c in coded], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
