"""Queries of this subpackage for the driver: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltmark.llm import bpe, chat, decontam, infill, media, near_dedup, privacy, quality, repair, secrets, sharding, toxicity, warc
from siltmark.llm.common import table

#: Where the vocabulary file is; every function takes another path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def vocabulary_path() -> str:
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.json")
    except ImportError:
        return VOCABULARY


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(table(spark, sf_dir, "documents"))


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(table(spark, sf_dir, "pages"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.chat_digests(rows.unionByName(extra))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_digests(table(spark, sf_dir, "conversations"))


def op12_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.privacy_digests(table(spark, sf_dir, "documents"))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.infill_digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_sharding, op3_secrets, op4_decontam, op5_media, op6_near_dedup, op7_quality, op8_warc, op9_chat, op10_bpe, op11_repair, op12_privacy, op13_infill)}


#: 100 * intersection >= 75 * union over sets of 5-word shingles; components by closure of the links.
NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END sh FROM w),
n AS (SELECT doc_id, len(sh) n FROM s), f AS MATERIALIZED (SELECT doc_id, len(sh) n, hash(unnest(sh)) x FROM s),
e AS MATERIALIZED (SELECT f.* FROM f SEMI JOIN (SELECT x FROM f GROUP BY 1 HAVING count(*) > 1) y USING (x)),
h AS (SELECT a.doc_id a, b.doc_id b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
l AS MATERIALIZED (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) b FROM r GROUP BY 1)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, least(n.doc_id, coalesce(c.b, n.doc_id)) AS component_id, n.doc_id <= coalesce(c.b, n.doc_id) AS kept FROM n LEFT JOIN c ON c.a = n.doc_id"""

WARC_SQL = """
WITH d AS (SELECT page_id, coalesce(html, '') html, sha1(coalesce(html, '')) h FROM pages),
g AS (SELECT h, max(page_id) r FROM d GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform(range(0, 4), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(d.h, CAST(1 + 5 * i AS BIGINT), 5) AS INT) >> CAST(15 - 5 * j AS INT)) & 31) AS BIGINT), 1)), '')), '') AS payload_digest,
  CASE WHEN r <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN r <> page_id THEN r END AS refers_to, CASE WHEN r <> page_id THEN NULL ELSE true END AS digest_ok
FROM d LEFT JOIN g USING (h)"""

CHAT_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(role, '<(\|+)', '<\1|', 'g')) + length(regexp_replace(text, '<(\|+)', '<\1|', 'g')) + length('<|turn|><|text|><|end|>') k FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(k) AS BIGINT) AS formatted_chars, ['message', 'utterance', 'speech'][((conv_id % 3) + 3) % 3 + 1] AS layout FROM e GROUP BY 1"""


INFILL_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(d, i, 8) AS BIGINT)) AS h FROM t),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b, t = '' OR regexp_matches(t, '<[PSM]>') OR h[3] % 100 >= 50 AS plain FROM h),
f AS (SELECT *, CASE WHEN plain THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS y, array_to_string(u[b + 1:n], '') AS z FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN plain THEN NULL ELSE CAST(length(x) AS BIGINT) END AS prefix_chars, CASE WHEN plain THEN NULL ELSE CAST(length(y) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256 FROM f"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express: the others fit a model, search a latent space, decode, tokenize or hash by functions that it lacks, and are tested against plain versions."""
    return {"op6_near_dedup": NEAR_SQL, "op8_warc": WARC_SQL, "op9_chat": CHAT_SQL, "op13_infill": INFILL_SQL}
