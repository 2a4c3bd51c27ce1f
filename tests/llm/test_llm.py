import base64
import gzip
import hashlib
import json
import os
import random
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo
from tokenizers import Tokenizer

import corpus_pipeline
from siltmark.llm import bpe, chat, decontam, media, near_dedup, quality, queries, secrets, sharding, toxicity, warc
from siltmark.llm.common import words_of
from siltmark.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tokens string, media string, kept string"


def doc(i, text, source="s", lang="en"):
    return (i, text, lang, source, len(text or ""), "x", "y", "z")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, blanks, a very long text, repeated rows, and columns with clashing names."""
    rows = [doc(1, None), doc(2, ""), doc(3, "  \n"), doc(4, "one two"), doc(5, "a b c d e f " * 20000), doc(4, "one two"), doc(None, "no id here"), doc(7, "x", None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_odd_and_empty_tables(spark, odd, empty):
    bench = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    path = queries.vocabulary_path()
    for n, table in ((8, odd), (0, empty)):
        assert near_dedup.near_duplicates(table).count() == n
        assert sharding.interleave(table).count() == n
        assert secrets.secret_digests(table).count() == n
        assert media.media_digests(table).count() == n
        assert bpe.encode_digests(table, path).count() == n
        assert bpe.encode(table, path).select("doc_id", "tokens", "decoded").count() == n
        assert toxicity.score(table, toxicity.fit(table, no_labels(spark))).count() == n
        assert quality.score(table, quality.fit(table, no_labels(spark))).count() == n
        assert decontam.leaks(table, bench).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert chat.chat_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert warc.plan_records(pages).count() == 0 and warc.warc_round_trip(pages).count() == 0


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = words_of(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    return label


def test_near_dedup_is_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 8, 40, 200]))]
        for _ in range(rng.choice([1, 2, 5])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(words)))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (5, 5)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100}


def test_bpe_is_the_library():
    path = queries.vocabulary_path()
    enc, lib = bpe.encoder(path), Tokenizer.from_file(path)
    rng = random.Random(1)
    bits = ["a", "aaaa", " ", "  ", "\n", "\t", " the", "'s", "'", "é", "中文", "😀", "\xa0", "\x1c", "12", "$$$", "<|endoftext|>", "<|endo", "\x00", "ING", "\r\n", "_"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + ["ab" * 3000, ""]
    ours = enc.encode_batch(texts)
    for t, a, b in zip(texts, ours, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(a, "<u4").tolist() == b.ids, t
        assert enc.decode(a) == lib.decode(b.ids, skip_special_tokens=False)


def test_sharding(spark):
    rows = [(i, f"t{i % 50}", "hot" if i % 3 else f"s{i % 7}") for i in range(1003)]
    df = sharding.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = df.toPandas()
    sizes = got.groupby("shard").size()
    assert len(sizes) == 40 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard").slot)
    hot = got[got.source == "hot"].groupby("shard").size()
    assert hot.max() - hot.min() <= 6  # seven other sources, each within one row of its share
    assert "Python" not in df._jdf.queryExecution().toString()
    one = got.iloc[0]
    text = dict((r[0], r[1]) for r in rows)[one.doc_id]
    assert one["size"] == len(text) + 16 and one.text_crc32 == zlib.crc32(text.encode())


def test_secret_layers():
    secret = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'
    base = secrets.scan(secret)["base"]
    assert [k for k, _, _ in base] == ["assign", "hex"]
    nested = base64.b64encode(gzip.compress(base64.b64encode(secret.encode()))).decode()
    escaped = "".join(f"\\u{ord(c):04x}" for c in secret)
    for text in (base64.b64encode(secret.encode()).decode(), nested, escaped, secret.replace(" ", "%20").replace("=", "%3D")):
        got = secrets.scan(f"é {text} end")
        assert got["layers"] and any(k == "assign" and a == 2 for k, a, _ in got["spans"])
        assert "24be64439e3e49cf46" not in secrets.redact(f"é {text} end", got["spans"])
    # half of the secret escaped, one way or both, with its name outside the escaped run
    for text in ("é token = 24be%36439e3e49", "é token = 24be\\u0036439e3e49", "é token = 24be%36439e3\\u00654%39"):
        assert ("assign", 2, len(text)) in secrets.scan(text)["spans"], text
    # base64 glued to a path, plain or compressed, and two-digit escapes
    glued = base64.b64encode(secret.encode()).decode().rstrip("=")
    for head in ("/a", "/ab/", "https://h/abc/", "x_"):
        assert any(k == "assign" for k, _, _ in secrets.scan(f"{head}{glued} end")["spans"]), head
        packed = base64.b64encode(zlib.compress(secret.encode())).decode()
        assert any(k == "assign" for k, _, _ in secrets.scan(f"{head}{packed} end")["spans"]), head
    assert ("assign", 0, 26) in secrets.scan("token=\\x61\\U00000062cdefgh")["spans"]
    assert secrets.scan("password: short7")["base"] == [] and secrets.scan("ſecret=abcdefgh")["base"] == []
    assert secrets.scan("AKIA" + "A" * 12)["base"] == [("access", 0, 16)]


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, zstandard.compress, lambda b: gzip.compress(zlib.compress(b))])
def test_secret_in_packed_bytes_that_are_not_all_text(pack):
    secret = b'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'
    for near in ("\xa0".encode(), "\ufeff".encode(), "\u202f\u3000\u200b".encode(), b"\x00", b"\x0c", b"\xff\xfe\x80", "é".encode("latin-1"), os.urandom(512)):
        for data in (near + secret, secret + near, b"un texte\n" + near + secret + near):
            packed = base64.b64encode(pack(data)).decode()
            for head in ("", "/ab/"):
                got = secrets.scan(f"é {head}{packed} end")
                assert {k for k, _, _ in got["spans"]} >= {"assign", "hex"}, (near, head)
                assert packed[8:] not in secrets.redact(f"é {head}{packed} end", got["spans"])


def test_secrets_packed_deep_or_one_after_another():
    first, second = b'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', b"password = hunter2hunter2"
    data = first
    for _ in range(30):
        data = gzip.compress(data)
    assert {k for k, _, _ in secrets.scan(base64.b64encode(data).decode())["spans"]} >= {"assign", "hex"}
    code = [base64.b64encode(gzip.compress(x)).decode().rstrip("=") for x in (first, second)]
    for head in ("", "/ab/"):
        text = f"{head}{code[0]}/{code[1]}"
        starts = {a for _, a, _ in secrets.scan(text)["spans"]}
        assert starts >= {len(head), text.index(code[1])}


@pytest.mark.parametrize("width", [20, 64, 76])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\n  "])
def test_secret_in_wrapped_base64(width, end):
    secret = b'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'
    for data in (b"x" * 40 + secret, secret, gzip.compress(os.urandom(300) + secret), zlib.compress(b"un texte " * 9 + secret)):
        for pad in range(3):
            code = base64.b64encode(data + b" " * pad).decode()
            lines = end.join(code[k : k + width] for k in range(0, len(code), width))
            for text in (f"é\n{lines}\nend of it", f"{lines}", f"-----BEGIN CERTIFICATE-----\n{lines}\n-----END CERTIFICATE-----\n", f"data: {lines}\n"):
                got = secrets.scan(text)
                assert {k for k, _, _ in got["spans"]} >= {"assign", "hex"}, text
                assert "end of it" not in text or secrets.redact(text, got["spans"]).endswith("\nend of it")
    assert secrets.scan(base64.b64encode(b"nothing to be found").decode() + "\nThen it ends")["layers"] == 1


@pytest.mark.parametrize("n", [0, 1, 576, 577, 57600, 700_001])
def test_media_round_trip(n):
    payload = media.padded(os.urandom(n))
    got = media.demux(media.mux(payload))
    assert got["payload"] == payload and got["gaps"] == 0 and len(payload) % 576 == 0 and payload
    assert got["pts"].tolist() == [k * media.UNIT_TICKS for k in range(len(payload) // 576)]
    assert got["access"].tolist() == list(range(0, len(payload) // 576, 10))


def test_media_errors():
    stream = media.mux(media.padded(b"x" * 5000))
    lost = stream[: 5 * 188] + stream[6 * 188 :]
    assert media.demux(lost)["gaps"] == 1
    assert media.demux(stream[: 5 * 188] + stream[4 * 188 :])["repeats"] == 1
    assert media.demux(b"junk" + stream)["skipped"] == 4
    assert media.demux(b"")["payload"] == b""


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/", "<p>x</p>"), (2, "http://b/ c", "<p>x</p>"), (3, None, None), (4, "http://d/", "é\r\n\r\nWARC/1.1"), (5, "http://e/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = "file://" + str(tmp_path / "w")
    warc.write_warc(pages, path)
    got = {r.page_id: r for r in warc.read_warc(spark, path).collect()}
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert {k: (r.record_type, r.refers_to, r.payload_bytes) for k, r in got.items()} == {1: ("revisit", 2, 8), 2: ("response", None, 8), 3: ("revisit", 5, 0), 4: ("response", None, 14), 5: ("response", None, 0)}
    assert all(r.payload_digest == sha(rows[k - 1][2] or "") for k, r in got.items()) and got[4].payload == rows[3][2]
    only = warc.read_warc(spark, path).where("record_type = 'response' AND page_id = 4")
    assert [r.page_id for r in only.collect()] == [4]
    reader = warc.WarcReader({"path": path})
    assert list(reader.pushFilters([EqualTo(("record_type",), "response"), EqualTo(("source_file",), "x")])) == [EqualTo(("source_file",), "x")]


def test_chat(spark):
    turn = {"messages": [{"role": "human", "content": "a <|turn|> <||x| <"}, {"role": "gpt", "content": None}]}
    rows = [json.dumps(x) for x in ({"prompt": "p", "response": "r"}, {"instruction": "i", "input": "n", "output": "o"}, turn, {"zz": 1})] + [None, "{"]
    got = chat.format_records(spark.createDataFrame([(r,) for r in rows], "record string"))
    assert "Python" not in got._jdf.queryExecution().toString()
    got = got.collect()
    assert [r.layout for r in got] == ["prompt", "instruction", "messages", None, None, None]
    assert got[1].turns[0].text == "i\n\nn" and got[2].turns[1].role == "assistant"
    s = got[0].loss_spans[0]
    assert got[0].formatted[s.start : s.start + s.length] == "r"
    back = spark.createDataFrame([(got[2].formatted,)], "f string").select(chat.parse_turns(F.col("f")).alias("t")).first().t
    assert [(t.role, t.text) for t in back] == [("user", "a <|turn|> <||x| <"), ("assistant", "")]


def test_chat_digests(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"é <|end|> {k}") for k in range(3001)]
    rows += [(2, 0, None, None), (2, 1, "assistant", ""), (2, 1, "assistant", ""), (None, 0, "assistant", "x<|turn|>"), (3, 0, "human", "a")]
    got = {r.conv_id: r for r in chat.chat_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for key in (1, 2, 3, None):
        mine = [(r[2] or "", r[3] or "") for r in rows if r[0] == key]
        loss = "".join(t for r, t in mine if r == "assistant")
        assert (got[key].n_turns, got[key].turns_sha256) == (len(mine), sha("".join(f"{r}\n{t}\n" for r, t in mine)))
        assert (got[key].loss_chars, got[key].loss_sha256) == (len(loss), sha(loss))
    assert [got[k].layout for k in (1, 2, 3, None)] == ["utterance", "speech", "message", "message"]
    starts = spark.createDataFrame([([],), ([5],), (list(range(50)),)], "x array<int>").select(chat._running(F.col("x"))).collect()
    assert [r[0] for r in starts] == [[], [0], [sum(range(k)) for k in range(50)]]


def test_toxicity_clauses():
    s = toxicity.Scorer([("idiot", False, 1.0, False), ("splat", True, 1.0, True)])
    score = lambda t: s.clauses(t)[0]
    plain = score("an idiot came")
    assert score("not an idiot") < plain and score("one said idiot") < plain < score("you idiot")
    assert score("idiot, you came") == score("you idiot") and score("he said idiot") < plain and score('"idiot" he said') < plain
    assert score("you aren't an idiot") == score("you aren\u2019t an idiot") < score("you idiot")
    assert score("kill the cat") < score("I will kill you") == score("you will be killed") == score("he kills you")
    assert score("I will splat you") == 1.0 and score("splat the cat") == 0.5
    assert s.clauses("preidiot. fine") == [] and s.clauses(None) == []


def plain_score(scorer, text):
    """The grammar clause by clause, as rules that look at all of a clause's symbols."""
    out = []
    for clause in toxicity.CLAUSE.split(toxicity.lowered(text)):
        line = [scorer.symbol(w) for w in toxicity.WORD.findall(clause)]
        kinds = [k for k, _ in line]
        total = 0.0
        for i, (k, x) in enumerate(line):
            if k not in (toxicity.INSULT, toxicity.THREAT):
                continue
            w = 1.0 if k == toxicity.INSULT else 0.5
            since = max([j for j in range(i) if kinds[j] in (toxicity.INSULT, toxicity.THREAT)], default=-1)
            if any(kinds[j] == toxicity.NEGATION for j in range(max(since + 1, i - 3), i)):
                w -= 0.5
            if toxicity.REPORT in kinds[:i]:
                w -= 0.25
            last_report = max([j for j in range(i) if kinds[j] == toxicity.REPORT], default=-1)
            if toxicity.TARGET in kinds[last_report + 1 : i]:
                w += 0.25 if k == toxicity.INSULT else 0.5
            total += w * x
        # what comes after a hit: a target or a verb of speech, before the next hit
        for i, (k, _) in enumerate(line):
            if k not in (toxicity.INSULT, toxicity.THREAT):
                continue
            after = [j for j in range(i + 1, len(line)) if kinds[j] in (toxicity.INSULT, toxicity.THREAT, toxicity.REPORT)]
            end = after[0] if after else len(line)
            if end < len(line) and kinds[end] == toxicity.REPORT and toxicity.REPORT not in kinds[:i]:
                total -= 0.25
            last_report = max([j for j in range(i) if kinds[j] == toxicity.REPORT], default=-1)
            if toxicity.TARGET not in kinds[last_report + 1 : i] and toxicity.TARGET in kinds[i:end]:
                j = kinds.index(toxicity.TARGET, i)
                speaker = kinds[j + 1 : j + 2] == [toxicity.REPORT]
                total += 0.0 if speaker else 0.25 if k == toxicity.INSULT else 0.5
        if set(kinds) & {toxicity.INSULT, toxicity.THREAT}:
            out.append(total)
    return out


def test_composed_grammar_is_the_rules():
    rng = random.Random(9)
    scorer = toxicity.Scorer([("idiot", False, 1.0, False), ("zapp", False, 0.5, False)])
    words = ["you", "he", "idiot", "idiotic", "zapper", "kill", "killed", "not", "isn’t", "said", "wrote", "a", "cat", "came", "."]
    for _ in range(3000):
        text = " ".join(rng.choices(words, k=rng.randrange(1, 14)))
        assert scorer.clauses(text) == pytest.approx(plain_score(scorer, text)), text


def test_held_out_accuracy(spark):
    got = queries.op1_toxicity(spark, "/root/testdata/sf0.1").toPandas().merge(spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas(), on="doc_id")
    test = got[got.held_out]
    assert (test[test.toxic == 0].predicted == 0).mean() > 0.98 and (test[test.toxic == 1].predicted == 1).mean() > 0.8
    q = queries.op7_quality(spark, "/root/testdata/sf0.1").toPandas().merge(got[["doc_id", "quality", "held_out"]], on="doc_id")
    q = q[q.held_out]
    assert q[q.quality == 1].kept.mean() > 0.98 and q[q.quality == 0].kept.mean() < 0.1


def test_leaks(spark):
    rng = random.Random(5)
    word = lambda: f"v{rng.randrange(3000)}"
    items = [(k, " ".join(word() for _ in range(30)) + ". " + " ".join(word() for _ in range(6))) for k in range(20)]
    rows = []
    for i in range(60):
        text = [word() for _ in range(rng.randrange(20, 300))]
        if i < 20:
            passage = items[i][1].split()
            if i % 2:  # a paraphrase: a fifth of its words are others
                passage = [word() if rng.random() < 0.2 else w for w in passage]
            at = rng.randrange(len(text))
            text[at:at] = passage
        rows.append((i, " ".join(text)))
    got = decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(i, i) for i in range(20)}


def test_leaks_among_words_of_no_passage(spark):
    common = [f"c{k}" for k in range(30)]
    items = [(0, " ".join(common[:15])), (1, " ".join(common[15:]))]
    rows = [(i, " ".join(common[::-1]) if i % 2 else "x") for i in range(4000)]
    rows += [(-1 - k, " ".join([*(f"a{j}" for j in range(100)), *items[k][1].split(), *(f"b{j}" for j in range(100))])) for k in range(2)]
    got = decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(-1, 0), (-2, 1)}


def test_lcs():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([bytes([rng.randrange(4)]) for _ in range(rng.randrange(1, 20))] for _ in range(2))
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        assert decontam.lcs(decontam.masks_of(a), len(a), b) == d[-1][-1]


def test_pipeline_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        docs = corpus_pipeline.materialise(out, name)
    assert all(secrets.scan(r.text)["base"] == [] for r in docs.select("text").collect())
    assert corpus_pipeline.run(spark, d).count() == docs.count()
