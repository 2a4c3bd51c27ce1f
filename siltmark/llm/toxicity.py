"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, negation, report, other). Four small transducers, one each for
negation, reported speech, targets, and the hits themselves, are composed into one
automaton that reads the symbols of a clause and adds up weights; clauses are scored, not words alone. A hit waits in its state for a
target or a verb of speech that comes after it.
Insult words, threat words and word beginnings are learned from labelled rows, with a test that holds over all candidates; a learned word is a
threat where it follows words of intent. Target, negation and report words and the stems of some threats are fixed short lists. A logistic layer,
fitted on the same rows, turns the clause scores of a text into a probability. Texts stay on the executors: the fit gathers counts,
sketches and features.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.llm.common import WordHasher, has_columns, make_room, materialise, shingles, tune, words_of

#: Labelled rows that the fit reads at most, by a hash of their id.
FIT_ROWS = 20_000
#: Word beginnings that may enter the lexicon.
PREFIX_LENGTHS = (4, 5, 6, 7)
#: Least hashes that tell copies among the labelled rows, and the similarity from which they are.
SKETCH = 32
COPY_SIMILARITY = 0.75
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

#: Short word lists of the grammar's classes in four languages.
TARGETS = "you your yours u he she they them him her tu vous toi te ton ta vos il elle ils du dich dir dein sie ihr er usted ustedes ti él ella ellos".split()
NEGATIONS = "not no never cannot ne pas jamais nicht kein keine nie nunca jamás".split()
REPORTS = "said says wrote claimed called quoted dit écrit sagte schrieb dijo escribió".split()
INTENTS = "will shall gonna going i'll we'll werde werden vais allons voy vamos".split()
#: Stems of threats; their inflections end in one of the endings.
THREATS = "kill hurt destroy murder shoot shot stab stabb burn töt umbring tuer tuerai matar mataré".split()
ENDINGS = ("", "s", "d", "ed", "ing", "er", "e", "en", "et", "t", "é", "ez")

WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
CLAUSE = re.compile(r"[.!?;:\n]+")


def lowered(text: str | None) -> str:
    """Lower case, with one kind of apostrophe."""
    return (text or "").lower().replace("\u2019", "'")


@dataclass
class Transducer:
    """States are numbers; step(state, symbol) gives (state, symbol out, weight). No entry: stay, copy, 0."""

    states: int
    arcs: dict[tuple[int, int], tuple[int, int, float]] = field(default_factory=dict)

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        return self.arcs.get((state, symbol), (state, symbol, 0.0))

    def then(self, other: Transducer) -> Transducer:
        """Composition: the other one reads what this one writes; weights add up."""
        out = Transducer(self.states * other.states)
        for a in range(self.states):
            for b in range(other.states):
                for s in range(6):
                    a2, mid, w = self.step(a, s)
                    b2, end, v = other.step(b, mid)
                    out.arcs[a * other.states + b, s] = (a2 * other.states + b2, end, w + v)
        return out


def negation(reach: int = 3, discount: float = 0.5) -> Transducer:
    """A hit within `reach` words after a negation costs."""
    t = Transducer(reach + 1)
    for s in range(reach + 1):
        t.arcs[s, NEGATION] = (reach, OTHER, 0.0)
        for x in (OTHER, TARGET, REPORT):
            t.arcs[s, x] = (max(0, s - 1), x, 0.0)
        for x in (INSULT, THREAT):
            t.arcs[s, x] = (0, x, -discount if s else 0.0)
    return t


def reported(discount: float = 0.25) -> Transducer:
    """Hits after a verb of speech, to the end of the clause, cost; so does the last one before it. The verb is passed on."""
    plain, said, waiting = range(3)
    t = Transducer(3)
    for s in (plain, said):
        t.arcs[s, REPORT] = (said, REPORT, 0.0)
    t.arcs[waiting, REPORT] = (said, REPORT, -discount)
    for x in (INSULT, THREAT):
        t.arcs[plain, x] = t.arcs[waiting, x] = (waiting, x, 0.0)
        t.arcs[said, x] = (said, x, -discount)
    return t


def targeted(insult: float = 0.25, threat: float = 0.5) -> Transducer:
    """A hit weighs more in a clause that names a target before it, or after it. Who speaks, right before a verb of speech, is no target."""
    plain, aimed, insulted, threatened, late_insult, late_threat = range(6)
    bonus = {INSULT: insult, THREAT: threat}
    t = Transducer(6)
    for s in range(6):
        t.arcs[s, TARGET] = (aimed, OTHER, 0.0)
        t.arcs[s, REPORT] = (plain, OTHER, 0.0)
        for x, waits in ((INSULT, insulted), (THREAT, threatened)):
            t.arcs[s, x] = (aimed, x, bonus[x]) if s in (aimed, late_insult, late_threat) else (waits, x, 0.0)
    for waits, late, w in ((insulted, late_insult, insult), (threatened, late_threat, threat)):
        t.arcs[waits, TARGET] = (late, OTHER, w)
        t.arcs[late, REPORT] = (plain, OTHER, -w)
        t.arcs[late, OTHER] = (aimed, OTHER, 0.0)
    return t


def hits(insult: float = 1.0, threat: float = 0.5) -> Transducer:
    """The hits themselves; a threat counts in full once a target is near, which `targeted` adds."""
    t = Transducer(1)
    t.arcs[0, INSULT] = (0, INSULT, insult)
    t.arcs[0, THREAT] = (0, THREAT, threat)
    return t


def grammar() -> Transducer:
    return negation().then(reported()).then(targeted()).then(hits())


Entry = tuple[str, bool, float, bool]


class Scorer:
    """Clause scores of texts under a lexicon."""

    def __init__(self, lexicon: list[Entry]) -> None:
        """lexicon: (word or beginning, whether it must be the whole word, weight, whether it is a threat)."""
        g = grammar()
        self.next = [[g.step(s, x)[0] for x in range(6)] for s in range(g.states)]
        self.add = [[g.step(s, x)[2] for x in range(6)] for s in range(g.states)]
        self.words = {w: TARGET for w in TARGETS} | {w: NEGATION for w in NEGATIONS} | {w: REPORT for w in REPORTS} | {w + e: THREAT for w in THREATS for e in ENDINGS}
        self.whole = {w: (x, THREAT if threat else INSULT) for w, full, x, threat in lexicon if full}
        self.starts = {w: (x, THREAT if threat else INSULT) for w, full, x, threat in lexicon if not full}
        self.lengths = sorted({len(w) for w in self.starts}, reverse=True)
        self.find = ahocorasick.Automaton()
        for w in {*self.whole, *self.starts, *THREATS}:
            self.find.add_word(w, w)
        self.find.make_automaton()

    def symbol(self, word: str) -> tuple[int, float]:
        """The symbol of a word and its scale: the heaviest entry that it has or begins with."""
        best = self.whole.get(word, (0.0, OTHER))
        for n in self.lengths:
            best = max(best, self.starts.get(word[:n], (0.0, OTHER)))
        if best[0] > 0:
            return best[1], best[0]
        return NEGATION if word.endswith("n't") else self.words.get(word, OTHER), 1.0

    def clauses(self, text: str | None) -> list[float]:
        """Scores of the clauses that have a hit."""
        low = lowered(text)
        marks = [end + 1 - len(w) for end, w in self.find.iter(low)] if low else []
        marks = [a for a in marks if a == 0 or not low[a - 1].isalnum()]
        if not marks:
            return []
        cuts = [m.end() for m in CLAUSE.finditer(low)]
        out = []
        for k in sorted(set(np.searchsorted(cuts, marks, side="right").tolist())):
            clause = low[cuts[k - 1] if k else 0 : cuts[k] if k < len(cuts) else len(low)]
            state, score, found = 0, 0.0, False
            for w in WORD.findall(clause):
                symbol, scale = self.symbol(w)
                found |= symbol in (INSULT, THREAT)
                score += self.add[state][symbol] * scale
                state = self.next[state][symbol]
            if found:
                out.append(score)
        return out

    def features(self, text: str | None) -> tuple[float, float, float]:
        return features_of(self.clauses(text))


def features_of(clauses: list[float]) -> tuple[float, float, float]:
    return (max(clauses, default=0.0), math.log1p(max(0.0, sum(clauses))), math.log1p(sum(x > 0.5 for x in clauses)))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def _gain(pos: int, neg: int, base: float) -> float:
    """Log-likelihood ratio of the rate in pos + neg documents against the base rate; 0 where it is not above it."""
    n = pos + neg
    if pos / n <= base:
        return 0.0
    out = pos * math.log(pos / n / base)
    return out + (neg * math.log(neg / n / (1 - base)) if neg else 0.0)


def parts_of(text: str | None) -> set[tuple[str, bool]]:
    """Candidates for the lexicon: (word, True) and (beginning, False)."""
    words = set(WORD.findall(lowered(text)))
    return {(w, True) for w in words} | {(w[:n], False) for w in words for n in PREFIX_LENGTHS if len(w) >= n}


def distinct_ids(sketched: list[tuple[int, int, list[int]]]) -> set[int]:
    """Of rows (doc_id, y, least shingle hashes in order), the ids that stay when copies of an earlier row with the same label go: copies are no further evidence."""
    kept: dict[tuple[int, int], list[int]] = {}
    by_hash: dict[tuple[int, int], list[int]] = defaultdict(list)
    for doc, y, least in sorted(sketched):
        mine = set(least)
        shared = Counter(other for h in least for other in by_hash[y, h])
        near = [other for other, n in shared.items() if n >= COPY_SIMILARITY * min(SKETCH, len(least))]
        # the least hashes of the union are a sample of it
        if any(len(mine.intersection(kept[y, o]).intersection(union)) >= COPY_SIMILARITY * len(union) for o in near for union in [sorted(mine.union(kept[y, o]))[:SKETCH]]):
            continue
        kept[y, doc] = least
        for h in least:
            by_hash[y, h].append(doc)
    return {doc for _, doc in kept}


def _counted(rows: DataFrame, wanted: int, among: frozenset | None = None) -> DataFrame:
    """part, full, n: in how many rows with the label a candidate is; only those of `among`, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if y == wanted:
                    counts.update(parts_of(text) if among is None else parts_of(text) & among)
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([counts[k] for k in keys], pa.int64())], ["part", "full", "n"])

    return rows.select("text", "y").mapInArrow(run, "part string, full boolean, n long").groupBy("part", "full").agg(F.sum("n").alias("n"))


def _intended(rows: DataFrame, lexicon: list[Entry]) -> dict[tuple[str, bool], tuple[int, int]]:
    """For each entry, how often it stands in toxic rows, and how often within three words after one of intent."""
    scorer, intents = Scorer(lexicon), set(INTENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, meant = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = WORD.findall(lowered(text)) if y else []
                for i, w in enumerate(words):
                    if scorer.symbol(w)[0] != INSULT:
                        continue
                    for key in [(w, True), *((w[:n], False) for n in scorer.lengths)]:
                        if key[0] in (scorer.whole if key[1] else scorer.starts):
                            seen[key] += 1
                            meant[key] += bool(intents.intersection(words[max(0, i - 3) : i]))
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([seen[k] for k in keys], pa.int64()), pa.array([meant[k] for k in keys], pa.int64())], ["part", "full", "n", "m"])

    out = rows.select("text", "y").mapInArrow(run, "part string, full boolean, n long, m long").groupBy("part", "full").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    return {(r["part"], r["full"]): (r["n"], r["m"]) for r in out.collect()}


def learn_lexicon(rows: DataFrame) -> list[Entry]:
    """Words and word beginnings that toxic rows (text, y) have and others have not.

    A candidate stays if its likelihood ratio beats the number of candidates (a union bound, with a margin),
    and a longer one only if no shorter one that it starts with does as well. It is a threat if half of its uses follow a word of intent.
    """
    total, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not toxic or toxic == total:
        return []
    base = toxic / total
    pos = {(r["part"], r["full"]): r["n"] for r in _counted(rows, 1).where("n >= 3").collect()}
    neg = {(r["part"], r["full"]): r["n"] for r in _counted(rows, 0, frozenset(pos)).collect()}
    bar = math.log(max(2, len(pos))) + 2.0
    good = {k: g for k, c in pos.items() if (g := _gain(c, neg.get(k, 0), base)) > bar and c / (c + neg.get(k, 0)) >= 0.8}
    out: list[Entry] = []
    for (w, full), g in sorted(good.items(), key=lambda x: (-x[1], x[0])):
        starts = [(w[:n], False) for n in PREFIX_LENGTHS if n < len(w) or (full and n == len(w))]
        if any(good.get(s, 0.0) >= g for s in starts):
            continue
        c = pos[w, full]
        out.append((w, full, min(1.0, c / (c + neg.get((w, full), 0))), False))
    if not out:
        return out
    meant = _intended(rows, out)
    return [(w, full, x, (use := meant.get((w, full), (0, 0)))[0] >= 3 and 2 * use[1] >= use[0]) for w, full, x, _ in out]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Newton steps for a ridge logistic regression; the first weight is the intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * max(1.0, len(y) ** 0.5))
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    lexicon: list[Entry]
    weights: list[float]

    def score(self, clauses: list[float]) -> float:
        z = self.weights[0] + sum(w * f for w, f in zip(self.weights[1:], features_of(clauses), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def training_rows(docs: DataFrame, labels: DataFrame, target: str, limit: int = FIT_ROWS) -> DataFrame:
    """Labelled rows outside the held-out fold (text, y), at most about `limit`, chosen by a hash of doc_id."""
    marks = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y"))
    share = min(1.0, limit / max(1, marks.count()))
    marks = marks.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # the marks are at most the bound of the fit, so they may be broadcast
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(marks), "doc_id").select("doc_id", "text", "y")


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = WordHasher()
    for batch in batches:
        least = [(shingles(hasher(words_of(t)))[:SKETCH] >> np.uint64(1)).view(np.int64) for t in batch.column(1).to_pylist()]
        offsets = np.cumsum([0, *map(len, least)], dtype=np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(least) if least else np.empty(0, np.int64)))], ["doc_id", "y", "least"])


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> Model:
    """Learn the lexicon and the logistic layer from labelled rows (labels: doc_id, toxic), at most about `limit` of them. Without rows of both kinds, scores are the base rate."""
    tune(docs.sparkSession)
    rows = materialise(training_rows(docs, labels, "toxic", limit), "labelled")
    sketched = [(r["doc_id"], r["y"], r["least"]) for r in rows.mapInArrow(_sketched, "doc_id long, y int, least array<long>").collect()]
    ids = docs.sparkSession.createDataFrame([(i,) for i in sorted(distinct_ids(sketched))], "doc_id long")
    # as many ids as the fit has rows at most, so they may be broadcast
    lexicon = learn_lexicon(rows.join(F.broadcast(ids), "doc_id", "left_semi"))
    if not lexicon:
        y = [r[1] for r in sketched]
        base = (sum(y) + 0.5) / (len(y) + 1) if y else 0.1
        return Model([], [math.log(base / (1 - base)), 0.0, 0.0, 0.0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in batches:
            got = [scorer.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array([g[i] for g in got], pa.float64()) for i in range(3))], ["y", "a", "b", "c"])

    table = rows.select("text", "y").mapInArrow(run, "y int, a double, b double, c double").collect()
    table.sort()  # as many rows as the fit has: in one order, whatever the order of tasks
    return Model(lexicon, fit_logistic(np.array([r[1:] for r in table]), np.array([r[0] for r in table], float)).tolist())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, clauses (matched) and worst (score of the worst clause) of each row of `docs` (doc_id, text).

    Defined cases: null and empty texts get the score of a text without matches; a null doc_id is not held out; repeated rows and equal texts
    get equal scores and all come back; other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    has_columns(docs, "doc_id", "text")
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("toxicity")
        scorer = Scorer(model.lexicon)
        for batch in batches:
            found = [scorer.clauses(t) for t in batch.column(1).to_pylist()]
            scores = [model.score(c) for c in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([len(c) for c in found], pa.int64()), pa.array([max(c, default=0.0) for c in found], pa.float64())], ["doc_id", "score", "clauses", "worst"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, clauses long, worst double")
    return rows.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "clauses", "worst")
