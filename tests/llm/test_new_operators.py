"""Repair, sanitisation and fill-in-middle against plain versions, on rows of odd kinds."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from siltmark.llm import infill, privacy, queries, repair

from tests.llm.test_llm import DOCS, doc

SPACE = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# conversation repair


def plain_repair(rows):
    """By the contract: damage, faults, and the cheapest edits by a search forwards over (state, cost, letters)."""
    found, out = defaultdict(list), {}
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        found[conv] += [(turn, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)
    add = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
    keep = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}

    def put(into, state, value):
        new = state not in into or value[:2] < into[state][:2]
        if new:
            into[state] = value
        return new

    def filled(best):
        todo = list(best)
        while todo:
            state = todo.pop()
            cost, audit, lines = best[state]
            role, to = add[state]
            if put(best, to, (cost + 2, audit + "I", (*lines, f"{role}:"))):
                todo.append(to)
        return best

    for conv, kept in found.items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns, seen, faults, best = {r[0] for r in kept if r[0] is not None}, set(), Counter(), filled({0: (0, "", ())})
        for _, role, text in kept:
            body = text.strip(SPACE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            faults[fault] += 1
            seen.add((role, text))
            now = {}
            for state, (cost, audit, lines) in best.items():
                put(now, state, (cost + 3, audit + "D", lines))
                if fault in ("blank", "duplicate"):
                    continue
                extra = fault == "truncated"
                if (role[:1], state) in keep:
                    put(now, keep[role[:1], state], (cost + extra, audit + "K", (*lines, f"{role}:{text}")))
                put(now, add[state][1], (cost + extra + 2, audit + "R", (*lines, f"{add[state][0]}:{text}")))
            best = filled(now)
        cost, audit, lines = min((best[s] for s in (0, 3) if s in best), key=lambda v: v[:2])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha("\n".join(lines)))
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def odd_conversations(spark):
    rng, rows = random.Random(5), []
    for conv in [None, *range(60), -7]:
        for _ in range(rng.choice([1, 2, 5, 40])):
            role = rng.choice([None, "user", "assistant", "system", "", "tool", "Assistant", "u"])
            rows.append((conv, rng.choice([None, -3, 0, 1, 2, 3, 4, 5, 6, 7, 8, 20]), role, rng.choice([None, "", " ", "a.", "b", "a. ", "c?\n", "d!x", " ", "a..b.", "e! " * 2000])))
    rows += rng.choices(rows, k=100)
    return rows + [(99, 1, "user", "ok.")] * 300


@pytest.mark.parametrize("size", [3, 1024])
def test_repair_query_is_the_plain_version(spark, odd_conversations, size):
    rows = spark.createDataFrame([(*r, "clash") for r in odd_conversations], CONVERSATIONS + ", `a.b` string").repartition(5)
    got = {r[0]: tuple(r)[1:] for r in repair.repair_digests(rows, size).collect()}
    assert got == plain_repair(odd_conversations)


def test_repair_query_on_its_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r[0]: tuple(r)[1:] for r in queries.op11_repair(spark, sf).collect()} == plain_repair(rows)


def test_repair_gives_turns_and_takes_no_rows(spark):
    rows = [("c", 0, "system", "Be kind."), ("c", 2, "user", "Hi"), ("c", 2, "user", "Hi"), ("c", 5, "tool", "Yes.")]
    row = repair.repair(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).first()
    assert (row.gaps, row.duplicate, row.truncated, row.illegal, row.cost, row.audit) == (3, 1, 1, 2, 6, "KKDR")
    assert [tuple(t) for t in row.repaired] == [("system", "Be kind."), ("user", "Hi"), ("assistant", "Yes.")]
    assert repair.repair_digests(spark.createDataFrame([], CONVERSATIONS)).collect() == []


def test_blocks_join_to_the_costs_of_the_whole():
    rng = random.Random(2)
    for _ in range(50):
        n = rng.randrange(1, 30)
        entries = [(rng.randrange(4), rng.choice([0, 0, 1, 2]), rng.randrange(1, 4)) for _ in range(n)]
        entries = [(c, k, w if k == repair.RUN else 1) for c, k, w in entries]
        stats = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0) | {"head": None, "tail": None, "least": None, "most": None}
        made = lambda part: {"codes": [e[0] for e in part], "kinds": [e[1] for e in part], "weights": [e[2] for e in part]}
        at = sorted(rng.choices(range(n + 1), k=3))
        parts = [made(entries[a:b]) for a, b in zip([0, *at], [*at, n], strict=True)]
        cost = lambda blocks: repair.joined_blocks([b | stats | {"costs": c} for b, c in zip(blocks, repair.block_costs(blocks), strict=True)])["cost"]
        assert cost(parts) == cost([made(entries)])


# sanitisation

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))) or (kind == "card" and 13 <= len(digits) <= 19 and luhn(digits)) or (kind == "phone" and 9 <= len(digits) <= 15)
            if good:
                out.append((kind, *m.span()))
    return out


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    bits = ["a", "B.", "@", "x.y", ".", "-", "+", "%", " ", "1", "25", "256", "0255", ".1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-2030", "(", ")", "é", "😀", "\n", "192.168.0.1", "+49", "00"]
    for _ in range(4000):
        text = "".join(rng.choices(bits, k=rng.randrange(25)))
        assert privacy.base_spans(text) == plain_base(text), text
    assert privacy.base_spans("a" * 300_000 + " " + "9" * 5000 + ".1.1.1 " + "+1" + ")" * 100_000) == []


def plain_disclosing(texts):
    """Terms and whether they go, by counts over lists."""
    near, frequency, entities = defaultdict(list), Counter(), Counter()
    for k, text in enumerate(texts):
        base = plain_base(text)
        chars = list(text)
        for _, a, b in base:
            chars[a:b] = " " * (b - a)
        words = [(m.start(), m.end(), re.sub("[A-Z]", lambda c: c[0].lower(), m[0])) for m in re.finditer(r"[A-Za-z0-9_\u0080-\U0010ffff]+", re.sub(f"[{privacy.TYPOGRAPHY}]", " ", "".join(chars)))]
        frequency.update({w[2] for w in words})
        who = {(kind, text[a:b].lower() if kind == "email" else text[a:b] if kind == "ip" else re.sub("[^0-9]", "", text[a:b])) for kind, a, b in base}
        entities.update(who)
        for kind, a, b in base:
            key = (kind, text[a:b].lower() if kind == "email" else text[a:b] if kind == "ip" else re.sub("[^0-9]", "", text[a:b]))
            before = tuple(w[2] for w in words if w[1] <= a)[-privacy.NEAR :]
            after = tuple(w[2] for w in words if w[0] >= b)[: privacy.NEAR]
            for t in {*before, *after}:
                near[key, t].append((k, before, after))
    out = {}
    for (who, term), seen in near.items():
        n, support = len({s[0] for s in seen}), min(len({s[1] for s in seen}), len({s[2] for s in seen}))
        doubt, gain = math.log2(frequency[term] / n), math.log2(n * len(texts) / (frequency[term] * entities[who]))
        if support >= privacy.SUPPORT and n <= privacy.COPIES * support and doubt <= privacy.GENERALISE_BITS and gain >= privacy.GAIN_BITS:
            out[term] = out.get(term, False) or doubt <= privacy.REMOVE_BITS
    return out


def plain_sanitised(text, terms):
    base = plain_base(text)
    chars = list(text)
    for _, a, b in base:
        chars[a:b] = " " * (b - a)
    hidden = re.sub(f"[{privacy.TYPOGRAPHY}]", " ", "".join(chars))
    hits = [m for m in re.finditer(r"[A-Za-z0-9_\u0080-\U0010ffff]+", hidden) if re.sub("[A-Z]", lambda c: c[0].lower(), m[0]) in terms]
    return base, base + [("term", *m.span()) for m in hits]


@pytest.fixture(scope="module")
def private(spark):
    rng = random.Random(7)
    words = "over under into from with about after before near past round through while since until".split()
    some = lambda k: " ".join(rng.choices(words, k=k))
    texts = [f"{some(9)} Zebulon {some(2)} zeb@mail.example.org {some(9)}" for _ in range(8)]
    texts += [f"{some(9)} call +44 (20) 7946-0958 {some(3)} Quillfeather, {some(9)}" for _ in range(4)] + [f"{some(5)} Quillfeather {some(5)}" for _ in range(3)]
    texts += [f"a note by Zebulon {some(4)}", "Zebulonia is a land"]
    texts += ["copied Hapax words hap@mail.example.org and more"] * 30
    texts += [f"{some(12)} office@all.example.com {some(12)}" for _ in range(60)]
    texts += [some(rng.randrange(1, 40)) for _ in range(60)] + [None, "", " \n", "x" * 20_000 + " Zebulon", "“Zebulon” 4111 1111 1111 1111"]
    rows = [doc(k, t) for k, t in enumerate(texts)]
    return rows + [rows[0], doc(None, "Zebulon zeb@mail.example.org")]


def test_privacy_query_is_the_plain_version(spark, private):
    docs = spark.createDataFrame([(*r, "clash") for r in private], f"{DOCS}, `a.b` string").repartition(4)
    terms = plain_disclosing([r[1] or "" for r in private])
    assert terms["zebulon"] and not terms["quillfeather"] and "hapax" not in terms and "office" not in terms
    want = Counter()
    for r in private:
        base, all_spans = plain_sanitised(r[1] or "", terms)
        joined = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        counts = Counter(k for k, _, _ in base)
        want[r[0], *(counts[k] for k in PLAIN), sha(joined(base)), joined(all_spans)] += 1
    assert Counter(tuple(r)[:7] for r in privacy.privacy_digests(docs).collect()) == want
    done = privacy.sanitise(docs)
    assert done.columns == [*docs.columns, "base_spans", "all_spans", "sanitised"]
    texts = {r.doc_id: r.sanitised for r in done.collect()}
    assert "[EMAIL]" in texts[0] and "Zebulon" not in texts[0] and "[NAME]" in texts[8] and texts[16] == "Zebulonia is a land"
    assert texts[len(private) - 7] is None and "[EMAIL]" in texts[40]


def test_privacy_takes_no_rows(spark):
    assert privacy.privacy_digests(spark.createDataFrame([], DOCS)).collect() == []


# fill in the middle


def plain_infill(doc_id, text):
    text = text or ""
    found = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest = sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted(x % (len(found) + 1) for x in h[:2])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return doc_id, len(found), "plain", None, None, sha(text), sha(text)
    x, y, z = ("".join(p) for p in (found[:a], found[a:b], found[b:]))
    form = "spm" if h[3] % 100 < 80 else "psm"
    return doc_id, len(found), form, len(x), len(y), sha(f"<S>{z}<P>{x}<M>{y}" if form == "spm" else f"<P>{x}<S>{z}<M>{y}"), sha(text)


def test_infill_query_is_the_plain_version(spark):
    rng = random.Random(9)
    bits = ["a", "bc ", " ", "\n\n", "é", "😀", "<", "<P", "P>", "S>", "<M", " ", "word ", "\x0b", "\x1f", "<S"]
    rows = [doc(k, "".join(rng.choices(bits, k=rng.randrange(12)))) for k in range(400)]
    rows += [doc(500, None), doc(501, ""), doc(502, " \n"), doc(503, "x <M> y"), doc(None, "no id at all"), doc(None, None), doc(504, "long text " * 40_000), doc(505, "a"), doc(505, "b")] + [doc(506, "many times over")] * 200
    rows += [doc(600 + k, "copies of one text are many") for k in range(50)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], f"{DOCS}, `a.b` string").repartition(4)
    want = Counter(plain_infill(r[0], r[1]) for r in rows)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    assert Counter(map(tuple, infill.infill_digests(docs).collect())) == want
    assert infill.infill_digests(docs.limit(0)).collect() == []


def test_infill_deals_documents_out_once(spark):
    plan = queries.op13_infill(spark, "/root/testdata/sf0.001")
    plan.collect()
    final = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count(" Exchange hashpartitioning") - final.count("ReusedExchange") == 1
