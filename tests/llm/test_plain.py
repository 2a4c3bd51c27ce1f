"""Queries against plain versions: whole results by value, on tables with nulls, blanks, long texts, repeats, ties and clashing columns."""

import base64
import gzip
import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from siltmark.llm import bpe, decontam, media, near_dedup, quality, queries, secrets, sharding, toxicity, warc
from siltmark.llm.common import words_of

from tests.llm.test_llm import DOCS, brute_components, doc

SMALL = "/root/testdata/sf0.001"
SECRET = b'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'


@pytest.fixture(scope="module")
def rows(spark):
    """Rows of odd kinds, as tuples: nulls, blanks, long texts, repeats, ties, and columns that results have too."""
    odd = [doc(1, None), doc(2, ""), doc(3, " \n"), doc(4, "one two"), doc(5, "a b c d e f " * 3000), doc(4, "one two"), doc(None, "no id"), doc(7, "one two", None, None)]
    odd += [doc(8, base64.b64encode(SECRET).decode()), doc(9, "é " + SECRET.decode()), doc(10, "<|endoftext|> x'll 中文 😀")]
    taken = [doc(r.doc_id, r.text, r.source, r.lang) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    return odd + [(r[0] + 1000, *r[1:]) for r in taken]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def test_bpe_query_is_the_library(docs, rows):
    lib = Tokenizer.from_file(queries.vocabulary_path())
    want = Counter()
    for r in rows:
        ids = lib.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(lib.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(map(tuple, bpe.encode_digests(docs, queries.vocabulary_path(), ship=True).collect())) == want


def test_bpe_in_slices_and_generations(monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_CHARS", 40)
    monkeypatch.setattr(bpe, "CHUNK_CACHE", 50)
    path = queries.vocabulary_path()
    enc, lib, rng = bpe.Encoder(bpe.Vocabulary(path)), Tokenizer.from_file(path), random.Random(4)
    bits = ["a", "of", " ", "  ", "\n", " the", "'s", "é", "中", "12", "<|endoftext|>", "ing", ",", " xq", "zzz" * 30]
    for _ in range(40):
        texts = ["".join(rng.choices(bits, k=rng.randrange(150))) for _ in range(10)]
        for t, a in zip(texts, enc.encode_batch(texts), strict=True):
            assert np.frombuffer(a, "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


def spark_hash(seed, *values):
    """The hash function of the rank, by its definition: each value in turn, seeded with the hash so far; nulls are passed over."""
    h = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), h)
    return h - (1 << 64) if h >> 63 else h


def plain_shards(rows, shards=40, seed=17):
    made = []
    for doc_id, text, _, source in ((r[0], r[1], r[2], r[3]) for r in rows):
        raw = (text or "").encode()
        stratum = "n" if source is None else "s" + source
        size, crc = len(raw) + 16, zlib.crc32(raw)
        made.append((stratum, doc_id, size, crc, spark_hash(seed, stratum, doc_id, crc, size)))
    low = lambda v: (v is not None, v)
    by = defaultdict(list)
    for m in made:
        by[m[0]].append(m)
    order = []
    for stratum, members in by.items():
        # buckets are by the leading bits of the key, and there is one here
        members.sort(key=lambda m: (m[4], low(m[1]), m[3], m[2]))
        phase = spark_hash(seed, stratum) % 1023 + 1
        order += [((k * 1024 - phase) / (len(members) * 1024), stratum, m[4], low(m[1]), m[3], m[2], m) for k, m in enumerate(members, 1)]
    order.sort(key=lambda x: x[:6])
    out, n = Counter(), len(order)
    for place, x in enumerate(order):
        stratum, doc_id, size, crc, _ = x[-1]
        shard = place * shards // n
        out[doc_id, None if stratum == "n" else stratum[1:], size, crc, "rows", shard, place - (shard * n + shards - 1) // shards, None] += 1
    return out


def test_shards_are_the_plain_ones(docs, rows):
    assert len(rows) < sharding.BUCKET_ROWS
    assert Counter(map(tuple, sharding.interleave(docs).collect())) == plain_shards(rows)


def test_shards_of_many_buckets_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 20)
    monkeypatch.setattr(sharding, "BLOCK_BUCKETS", 4)
    rows = [(i, f"t{i % 50}", "en", "hot" if i % 3 else f"s{i % 7}") for i in range(1500)] + [(7, "again", "en", "hot")] * 700 + [(None, None, None, None)] * 3
    got = sharding.interleave(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == len(rows) and len(sizes) == 40 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard").slot)
    assert Counter(got.doc_id.dropna().astype(int)) == Counter(r[0] for r in rows if r[0] is not None)
    share = got[got.source == "hot"].groupby("shard").size()
    assert share.max() - share.min() <= 8


def plain_base(text):
    """The base spans as the contract words them."""
    import re

    kinds = (r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", r"AKIA[A-Z0-9]+", r"[0-9a-f]+")
    fits = (lambda m: len(m[2]) >= 8, lambda m: len(m[0]) >= 16, lambda m: len(m[0]) >= 32)
    return sorted((m.start(), k, m.end()) for k, (p, fit) in enumerate(zip(kinds, fits, strict=True)) for m in re.finditer(p, text, re.A) if fit(m))


def test_secret_query_is_the_plain_scan(docs, rows):
    got = defaultdict(list)
    for r in secrets.secret_digests(docs).collect():
        got[r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256].append(r)
    want = Counter()
    for r in rows:
        base = plain_base(r[1] or "")
        counts = [sum(k == x for _, k, _ in base) for x in range(3)]
        want[r[0], *counts, sha(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base))] += 1
    assert {k: len(v) for k, v in got.items()} == want
    hidden = next(r for rs in got.values() for r in rs if r.doc_id == 8)
    assert hidden.n_layers == 1 and "assign:0:" in hidden.spans and hidden.n_assign == 0


@pytest.mark.parametrize("pack", [gzip.compress, zstandard.compress, lambda b: gzip.compress(gzip.compress(b)), lambda b: b"".join(gzip.compress(b[i : i + 3_000_000]) for i in range(0, len(b), 3_000_000))])
def test_secrets_in_large_parts(pack):
    fill = b"x y " * 3_000_000
    for data in (SECRET + b"\n" + fill, fill + SECRET, fill[:6_000_000] + SECRET + fill[6_000_000:]):
        assert {k for k, _, _ in secrets.scan(base64.b64encode(pack(data)).decode())["spans"]} >= {"assign", "hex"}
    members = pack(b"nothing here") + pack(SECRET)
    assert {k for k, _, _ in secrets.scan(base64.b64encode(members).decode())["spans"]} >= {"assign", "hex"}
    run = secrets.scan(base64.b64encode(pack(b"x" * (20 << 20) + b" " + SECRET)).decode())
    assert run["oversized"] and {k for k, _, _ in run["spans"]} >= {"assign", "hex"}


def passages(n, rng, words):
    return [(k, " ".join(rng.choices(words, k=15 + k % 45)) + ". " + " ".join(rng.choices(words, k=5))) for k in range(n)]


@pytest.mark.parametrize("n", [200, 1000, 4000])
def test_recall_of_leaks(spark, n):
    rng = random.Random(n)
    words = [f"v{k}" for k in range(3000)]
    items = passages(n, rng, words)
    rows, planted = [], rng.sample(range(n), 200)
    for i, k in enumerate(planted):
        text = rng.choices([*words, *(f"u{j}" for j in range(3000))], k=300)
        copy = [rng.choice(words) if i % 2 and rng.random() < 0.2 else w for w in items[k][1].split()]
        at = rng.randrange(len(text))
        text[at:at] = copy
        rows.append((i, " ".join(text)))
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set(enumerate(planted))
    exact = {x for x in want if not x[0] % 2}
    assert exact <= found and len(want & found) - len(exact) >= 0.9 * (len(want) - len(exact))


def plain_leaks(block, text):
    """Every stretch of the text against every passage, on the words, without a search."""
    words, out = decontam.tokens(text), set()
    for k, item in enumerate(block.words):
        size, answer = len(item), block.answers[k]
        stretch = max(size, -(-size * 5 // 4))
        for a in range(max(1, len(words))):
            part = words[a : a + stretch]
            share = decontam.lcs(decontam.masks_of(item), size, part) / size
            said = decontam.lcs(decontam.masks_of(answer), len(answer), part) / len(answer) if answer else 0.0
            if share >= decontam.LCS_SHARE or (share >= decontam.PARAPHRASE_SHARE and said >= decontam.ANSWER_SHARE):
                out.add(k)
    return out


def test_leaks_are_those_of_all_stretches(spark):
    rng = random.Random(8)
    words = [f"v{k}" for k in range(400)]
    items = passages(12, rng, words)
    rows = [(None, items[0][1]), (100, None), (101, ""), (102, items[1][1]), (102, items[1][1])]
    for i in range(40):
        text = rng.choices(words, k=rng.randrange(5, 200))
        if i % 2:
            at = rng.randrange(len(text))
            text[at:at] = [rng.choice(words) if rng.random() < 0.15 else w for w in items[i % 12][1].split()]
        rows.append((i, " ".join(text)))
    bench = spark.createDataFrame([*items, (50, None), (51, " ")], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontam.leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect())
    block = decontam.Block(items)
    assert got == Counter((d, items[k][0]) for d, t in rows for k in plain_leaks(block, t))


def test_leaks_do_not_depend_on_sections_or_blocks(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"v{k}" for k in range(2000)]
    items = passages(60, rng, words)
    rows = []
    for i in range(6):  # long texts of many sections, with passages at their borders
        text = rng.choices(words, k=3000)
        for k in rng.sample(range(60), 8):
            at = rng.randrange(len(text))
            text[at:at] = [rng.choice(words) if rng.random() < 0.1 else w for w in items[k][1].split()]
        rows.append((i, " ".join(text)))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = Counter(map(tuple, decontam.leaks(docs, bench).drop("cosine").collect()))
    assert len(whole) >= 45
    monkeypatch.setattr(decontam, "SECTION_CHARS", 700)
    block = decontam.Block(items)
    monkeypatch.setattr(decontam, "SECTION_WORDS", 64)
    for _, text in rows:
        at = -1
        for first, held, begin, end in decontam.sections(text, block.margin):
            assert begin == max(at, 0) and decontam.tokens(text)[first : first + len(held)] == held
            at = end
    assert decontam.BLOCK_ITEMS
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 25)
    assert Counter(map(tuple, decontam.leaks(docs, bench).drop("cosine").collect())) == whole


def test_media_query_reads_back_the_texts(docs, rows):
    want = Counter()
    for r in rows:
        raw = (r[1] or "").encode()
        payload = raw + b"\xff" * (576 - len(raw) % 576 if not raw or len(raw) % 576 else 0)
        units = len(payload) // 576
        size = 188 * (4 * units + 2 * -(-units // media.TABLES_EVERY))
        want[r[0], len(raw), len(payload), sha(payload), zlib.crc32(payload[-32:]), size, sha(media.mux(payload)), 0, -(-units // 10)] += 1
    got = media.media_digests(docs).drop("feature").collect()
    assert Counter(map(tuple, got)) == want
    by_text = defaultdict(set)
    for r, t in ((r, next(x[1] for x in rows if x[0] == r.doc_id)) for r in media.media_digests(docs).collect() if r.doc_id is not None):
        by_text[t].add(r.feature)
    assert all(len(f) == 1 for f in by_text.values())


def packets(pid, section, counter=0):
    """A section over as many packets as it takes."""
    body, out = b"\x00" + section, []
    while body:
        out.append(bytes([0x47]) + ((0x4000 if not out else 0) | pid).to_bytes(2, "big") + bytes([0x10 | (counter + len(out)) % 16]) + body[:184].ljust(184, b"\xff"))
        body = body[184:]
    return out


def test_media_tables_over_packets_and_all_streams(spark):
    one, two = media.mux(media.padded(b"x" * 2000)), media.mux(media.padded(b"y" * 3000))
    moved = [bytearray(two[i : i + 188]) for i in range(0, len(two), 188)][2:]
    for p in moved:
        p[1], p[2] = (p[1] & 0xE0) | 0x02, 0x22
    info = b"".join(bytes([0x05, 250]) + bytes(250) for _ in range(2))
    entry = lambda pid, d=b"": bytes([6]) + (0xE000 | pid).to_bytes(2, "big") + (0xF000 | len(d)).to_bytes(2, "big") + d
    table = media._section(2, 1, (0xE000 | media.DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + entry(media.DATA_PID, info) + entry(0x222, info[:40]))
    assert len(table) > 500
    stream = one[:188] + b"".join(packets(media.PMT_PID, table)) + one[376:] + b"".join(map(bytes, moved))
    got = media.demux(stream)
    assert [s["pid"] for s in got["streams"]] == [media.DATA_PID, 0x222]
    assert [s["payload"] for s in got["streams"]] == [media.padded(b"x" * 2000), media.padded(b"y" * 3000)]
    lost = one[: 7 * 188] + one[8 * 188 :]
    assert media.demux(lost)["gaps"] == 1 and media.demux(lost)["damaged"] == [1]
    flagged = bytearray(one)
    for at in range(10 * 188, len(one), 188):  # counters jump at a unit's first packet, which says so
        flagged[at + 3] = (flagged[at + 3] & 0xF0) | ((flagged[at + 3] + 5) & 0x0F)
    assert media.demux(bytes(flagged))["gaps"] == 1
    stored = media.parse(media.store(spark.createDataFrame([doc(1, "héllo"), doc(2, None)], DOCS)))
    r = {x.doc_id: x for x in stored.collect()}
    assert bytes(r[1].payload) == media.padded("héllo".encode()) and r[1].kept == "z" and r[2].n_streams == 1 and r[2].pts == [0] and r[1].damaged == []


def plain_quality(scored, sites):
    """Posteriors by plain sums over (host, path) of the documents' evidence."""
    p = {i: s for i, s in scored}
    by_path, by_host = defaultdict(list), defaultdict(list)
    for i, (host, path) in sites.items():
        by_path[host, path].append(p[i])
        by_host[host].append(p[i])
    n, total = len(p), sum(p.values())
    mean = total / n
    k_host = quality._prior_rows(len(by_host), n, sum(len(v) ** 2 for v in by_host.values()), mean, sum(sum(v) ** 2 / len(v) for v in by_host.values()) - n * mean * mean)
    inner = sum(len(v) * (np.mean(v) - np.mean(by_host[h])) ** 2 for (h, _), v in by_path.items())
    k_path = quality._prior_rows(len(by_path), n, sum(len(v) ** 2 for v in by_path.values()), mean, inner)
    out = {}
    for i, (h, path) in sites.items():
        host_rate = (sum(by_host[h]) + k_host * mean) / (len(by_host[h]) + k_host)
        rate = (sum(by_path[h, path]) + k_path * host_rate) / (len(by_path[h, path]) + k_path)
        z = np.log(p[i] / (1 - p[i])) - np.log(mean / (1 - mean)) + np.log(rate / (1 - rate))
        out[i] = (host_rate, rate, 1 / (1 + np.exp(-z)))
    return out


def test_sites_change_decisions_and_small_ones_shrink(spark):
    good, bad, middling = "Plain words in a line.", "$$$ ### %%%", "a line of words with a $$$ mark in it"
    urls = [("https://good.org/news/a", good)] * 200 + [("https://bad.org/spam/a", bad)] * 200 + [("https://bad.org/docs/a", good)] * 200 + [("https://tiny.org/x/a", bad)] * 2
    urls += [(u, middling) for u in ("https://GOOD.org/news/z", "https://bad.org/spam/z", "https://bad.org/docs/z", "https://tiny.org/x/z")]
    df = quality.with_sites(spark.createDataFrame([(i, t, u) for i, (u, t) in enumerate(urls)], "doc_id long, text string, url string"))
    weights = [2.5] + [0.0] * (len(quality.shape(F.lit(""))))
    weights[4] = -9.0  # of words that are marks alone
    got = {r.doc_id: r for r in quality.score(df, quality.Model(weights, 0.7), "host", "path").collect()}
    want = plain_quality([(i, r.doc_score) for i, r in got.items()], {r.doc_id: (r.host, r.path) for r in df.collect()})
    for i, r in got.items():
        assert (r.host_rate, r.path_rate, r.score) == pytest.approx(want[i], rel=1e-6)
    last = [got[len(urls) - 4 + k] for k in range(4)]
    assert len({round(r.doc_score, 9) for r in last}) == 1
    assert [r.kept for r in last] == [True, False, True, True]  # two bad rows of a small site do not condemn it
    assert last[1].path_rate < last[3].path_rate < last[2].path_rate and last[1].host_rate < last[0].host_rate
    odd = quality.with_sites(spark.createDataFrame([(None,), ("no url",), ("http://h.org",), ("http://h.org/a/b/c?d",)], "url string"))
    assert [(r.host, r.path) for r in odd.collect()] == [(None, None), (None, None), ("h.org", ""), ("h.org", "a")]


def test_quality_query_is_the_plain_posterior(docs, rows):
    got = quality.score(docs.where("doc_id IS NOT NULL"), quality.Model([0.5] + [1.0] * len(quality.shape(F.lit(""))), 0.9)).collect()
    first = {r[0]: r for r in rows}
    twice = Counter(r.doc_id for r in got)
    assert twice[4] == 2 and len(got) == len(rows) - 1
    keyed, sites = [], {}
    for n, r in enumerate(got):
        keyed.append((n, r.doc_score))
        source, lang = next(x for x in [(first[r.doc_id][3], first[r.doc_id][2])])
        sites[n] = (source, lang)
    want = plain_quality(keyed, sites)
    for n, r in enumerate(got):
        assert (r.host_rate, r.path_rate, r.score) == pytest.approx(want[n], rel=1e-6) and r.kept == (r.score >= 0.5)


def test_toxicity_learns_and_scores_like_the_plain_version(spark):
    rng = random.Random(3)
    common = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        text = rng.choices(common, k=30)
        if toxic:
            text[5:5] = ["grubble" + rng.choice(["", "s", "r"])] if i % 8 else ["will", "smorf", "you"]
        rows.append(doc(i, " ".join(text)))
        labels.append((i, int(toxic)))
    rows += [doc(5000 + k, rows[0][1]) for k in range(50)]  # copies, which are no evidence for the words around
    labels += [(5000 + k, 1) for k in range(50)]
    df, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(df, marks)
    words = {w: threat for w, _, _, threat in model.lexicon}
    assert any("grubble".startswith(w) for w in words) and any("smorf".startswith(w) and t for w, t in words.items())
    assert not any(t for w, t in words.items() if "grubble".startswith(w)) and not any(w in common for w in words)
    got = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    scorer = toxicity.Scorer(model.lexicon)
    from tests.llm.test_llm import plain_score

    for r in rows:
        c = plain_score(scorer, r[1])
        assert got[r[0]].score == pytest.approx(model.score(c)) and got[r[0]].clauses == len(c)
        assert got[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 5 == 0)
    y = dict(labels)
    assert np.mean([got[i].predicted == y[i] for i in y]) > 0.99


def test_copies_are_told_by_their_shingles():
    a, b = list(range(0, 64, 2)), list(range(1, 64, 2))
    near = a[:30] + [101, 103]
    assert toxicity.distinct_ids([(1, 1, a), (2, 1, b), (3, 1, near), (4, 0, a), (5, 1, []), (6, 1, [])]) == {1, 2, 4, 5, 6}


def test_pages_of_frequent_payloads(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    rows = [(i, f"http://h/{i}", "" if i % 3 else f"<p>{i // 9}</p>") for i in range(60)] + [(None, None, None), (3, "http://again/", "<p>0</p>"), (59, "http://again/", "")]
    got = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.payload_digest) for r in warc.warc_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    want = Counter()
    for i, _, h in rows:
        other = None if best[h or ""] == i else best[h or ""]
        want[i, len(h or ""), "revisit" if other is not None else "response", other, base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()] += 1
    assert got == want


def test_pipeline_is_the_plain_one(spark, rows, tmp_path):
    """All stages against plain versions of what each decides, on a table with odd rows."""
    import shutil

    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    long = " ".join(["Here is a plain line of words, and it goes on."] * 3 + [f"word{k} and more of it," for k in range(80)] + ["The end."])
    own = [(1, None, "en", "s", 0), (3, long, "en", "s", 0), (2, long, None, None, None), (2, long, None, None, None), (4, long.replace("word7", "thing7"), "en", "s", 5)]
    own += [(5, f"Some lines that stand here before. {bench[0][1]} And some lines that stand behind it.", "en", "s", 1), (6, f"My words hold a {SECRET.decode()} and nothing else of note here.", "en", "s", 1), (None, "A row that has no id is here, as it may be.", "en", "s", 1)]
    for name in ("documents", "labels", "benchmark"):
        shutil.copy(f"{SMALL}/{name}.parquet", tmp_path / f"{name}.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    taken = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    both = taken.withColumn("doc_id", F.col("doc_id") + 0).unionByName(spark.createDataFrame([(None if r[0] is None else r[0] + 100_000, *r[1:]) for r in own], schema))
    shutil.rmtree(tmp_path / "documents.parquet", ignore_errors=True)
    (tmp_path / "documents.parquet").unlink(missing_ok=True)
    both.withColumns({"kept": F.lit("x"), "tokens": F.lit("y")}).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((r.doc_id, r.lang, r.source, r.n_tokens, tuple(r.tokens)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    docs = [tuple(r) for r in both.collect()]
    labels = spark.read.parquet(str(tmp_path / "labels.parquet"))
    scored = quality.score(both, quality.fit(both, labels)).collect()
    good = {r.doc_id for r in scored if r.kept}
    docs = [r for r in docs if r[0] is None or r[0] in good]
    texts = {}
    for r in docs:
        texts.setdefault(r[0], r[1])
    texts.pop(None, None)
    sets = brute_components(sorted(texts.items()))
    docs = [r for r in docs if r[0] is None or sets[r[0]] == r[0]]
    block = decontam.Block([b for b in bench if decontam.tokens(b[1])])
    need = [max(1, -(-len(w) // 2)) for w in block.words]

    def leaks(text):
        have = set(decontam.tokens(text))
        near = [k for k, w in enumerate(block.words) if sum(x in have for x in w) >= need[k]]
        one = decontam.Block([(block.ids[k], bench_text[block.ids[k]]) for k in near]) if near else None
        return bool(one and plain_leaks(one, text))

    bench_text = dict(bench)
    docs = [r for r in docs if r[0] is None or not leaks(r[1])]
    lib = Tokenizer.from_file(queries.vocabulary_path())
    want = Counter()
    for doc_id, text, lang, source, _ in docs:
        spans = secrets.scan(text)["spans"]
        clean = secrets.redact(text, spans) if spans else text
        assert not plain_base(clean or "")
        ids = lib.encode(clean or "", add_special_tokens=False).ids
        want[doc_id, lang, source, len(ids), tuple(ids)] += 1
    assert got == want
    ids = Counter(k[0] for k in got.elements())
    assert ids[100_002] == 2 and ids[100_001] == ids[100_006] == ids[None] == 1 and not ids[100_003] and not ids[100_004] and not ids[100_005]


def test_links_are_found_at_the_threshold(spark):
    """Pairs whose similarity is just at 0.75 or above, beside such just below: all of the first are found, none of the others."""
    rng = random.Random(12)
    rows, want = [], 0
    for g in range(300):
        base = [f"g{g}x{k}" for k in range(rng.choice([60, 120, 300]))]
        other = list(base)
        n = len(base) - 4
        # a changed word takes five shingles: similarity (n - 5c) / (n + 5c)
        most = int(n / 35)
        c = most if g % 2 else most + 1
        for k in range(c):
            other[5 + k * (len(base) - 10) // max(c, 1)] = f"z{g}y{k}"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [words_of(t)]}
    want = {2 * g for g in range(300) if 100 * len(sets[2 * g] & sets[2 * g + 1]) >= 75 * len(sets[2 * g] | sets[2 * g + 1])}
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).where("NOT kept").collect()
    assert {r.component_id for r in got} == want and 100 <= len(want) <= 200


def test_randomised_svd_finds_the_leading_space(spark):
    rng = np.random.default_rng(4)
    rows = (rng.normal(size=(60, 8)) * [50, 40, 30, 20, 10, 0.1, 0.1, 0.1]) @ rng.normal(size=(8, 30))
    table = spark.createDataFrame([(list(range(30)), r.tolist()) for r in rows], "cols array<long>, vals array<double>")
    want = np.linalg.svd(rows)[2][:5]
    got = decontam.randomised_svd(table, 30, 5)
    assert np.allclose(np.linalg.svd(want @ got)[1], 1, atol=1e-4)


def test_latent_spaces_compress_and_a_copy_reaches_its_bound(spark):
    """Spaces hold more passages than their rank; whatever stands around a copy, its projection is what the passage keeps at least."""
    rng = random.Random(21)
    topics = [[f"t{j}w{i}" for i in range(60)] for j in range(40)]
    words = [w for t in topics for w in t]
    items = [(k, " ".join(rng.choices(topics[k % 40], k=25))) for k in range(240)]
    block = decontam.fit_block(spark.createDataFrame([(i, t) for i, t in items], "doc_id long, text string"), items, rank=48)
    assert sorted(int(m) for s in block.spaces for m in s.members) == list(range(240))
    assert len(block.spaces[0].members) > 2 * 48
    for space in block.spaces:
        full = space.least_weight / decontam.CONTAINED_SHARE
        assert space.projection.min() >= 0 and full.min() > 0
        for at, k in enumerate(space.members):
            cut = decontam.tokens(" ".join([*rng.choices(words, k=20), items[k][1], *rng.choices(words, k=18)]))
            cols = np.array([block.vocab.get(w, len(block.vocab)) for w in cut])
            local = space.local[cols]
            held = (space.projection[local[local >= 0], at] * block.idf[cols[local >= 0]]).sum()
            assert held >= full[at] * (1 - 1e-3)
