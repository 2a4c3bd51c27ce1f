"""Secrets at the cuts of long streams, wherever the cut falls; ranks of very many rows; columns whose names hold dots."""

import base64
import gzip
import random

import pytest
from pyspark.sql import functions as F

from siltmark.llm import bpe, decontam, media, queries, secrets, sharding

SECRET = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
FORMS = {
    "spaces around": b"password = hunter2hunter2x",
    "quote and colon": b'"Token" :   "hunter2hunter2x"',
    "key alone": b"api_key  =hunter2hunter2x",
    "wrapped": b"\n".join(x.strip() for x in base64.encodebytes(b"note: password=hunter2hunter2x, and some more words after that, and more").splitlines()),
    "wrapped and indented": b"\r\n  ".join(base64.b64encode(b"secret: hunter2hunter2x and more words that follow it for long")[i : i + 24] for i in range(0, 84, 24)),
}


@pytest.mark.parametrize("form", list(FORMS))
def test_no_secret_is_lost_at_a_cut(monkeypatch, form):
    monkeypatch.setattr(secrets, "LAYER_BYTES", 400)
    monkeypatch.setattr(secrets, "RUN_BYTES", 4000)
    monkeypatch.setattr(secrets, "PIECE", 50)
    rng = random.Random(1)
    words = b" ".join(bytes(rng.choices(b"abcdefgh", k=rng.randrange(1, 9))) for _ in range(400))
    for at in range(300, 520):
        data = words[:at] + b"\n\n" + FORMS[form] + b"\n\n" + words[at:]
        run = base64.b64encode(gzip.compress(data)).decode()
        found = secrets.scan(f"x {run} y")
        assert ("assign", 2, 2 + len(run)) in found["spans"], (form, at)
        assert not found["oversized"]


def test_cuts_leave_nothing_out(monkeypatch):
    monkeypatch.setattr(secrets, "LAYER_BYTES", 100)
    monkeypatch.setattr(secrets, "RUN_BYTES", 300)
    rng = random.Random(4)
    for _ in range(300):
        data = b"".join(rng.choices([b" ", b"\n", b"password", b"=", b":", b"abc", b"A" * 20, b"\t", b"  ", b"token ="], k=300))
        texts = [t for t, _ in secrets._blocks(iter([data[i : i + 30] for i in range(0, len(data), 30)]))]
        at = 0
        for t in texts:
            k = data.rfind(t.encode(), 0, at + len(t))  # the last place that leaves nothing out
            assert k >= 0
            at = max(at, k + len(t))
        assert at == len(data)


def test_places_of_very_many_rows(spark):
    n, buckets, phases = 10**10, 2 * 10**6, sharding.PHASES
    rows = spark.createDataFrame([(r, p) for r in (1, n // 3, n - 1, n) for p in (1, 500, phases - 1)], "r long, phase long").withColumn("n", F.lit(n).cast("long"))
    got = rows.withColumns({"above": F.col("r") * phases - F.col("phase"), "below": F.col("n") * phases}).select("r", "phase", sharding.bucket_of("above", "below", buckets).alias("g"))
    assert {(r.r, r.phase): r.g for r in got.collect()} == {(r, p): (r * phases - p) * buckets // (n * phases) for r in (1, n // 3, n - 1, n) for p in (1, 500, phases - 1)}


def test_columns_with_dots_pass(spark):
    df = spark.createDataFrame([(1, f"token = '{SECRET}'", "x")], "doc_id long, text string, `a.b` string")
    done = secrets.scan_documents(df)
    assert done.columns[:3] == ["doc_id", "text", "a.b"] and done.first()["a.b"] == "x" and done.first()["redacted"].count("[SECRET]") == 1
    coded = bpe.encode(df, queries.vocabulary_path())
    assert coded.columns == ["doc_id", "text", "a.b", "tokens", "decoded"] and coded.first()["decoded"] == df.first()["text"]
    parsed = media.parse(media.store(df))
    assert parsed.columns[:4] == ["doc_id", "text", "a.b", "media"] and bytes(parsed.first()["payload"]).startswith(b"token")
    assert decontam.clean(df, spark.createDataFrame([(1, "another passage that is not in there at all")], "item_id long, text string")).columns == df.columns
