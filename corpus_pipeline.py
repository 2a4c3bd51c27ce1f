"""A corpus pipeline of five stages; each reads what the one before it has written.

quality: documents that the classifier rejects go. near_dedup: one document of each group stays.
decontamination: documents that hold a benchmark passage go. secrets: found spans are replaced in the text.
bpe: what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.llm import bpe, decontam, near_dedup, quality, secrets
from siltmark.llm.common import materialise, table
from siltmark.llm.queries import vocabulary_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps. Null and empty texts are judged as such, rows without a doc_id stay, repeated rows go or stay together; no rows give none."""
    return quality.keep(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group. Null and empty texts and rows without a doc_id stay; rows that repeat one doc_id go or stay together."""
    gone = near_dedup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage. Null and empty texts and rows without a doc_id stay; ties and repeated rows go or stay together."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the spans that hold secrets replaced and n_chars counted anew (0 for a null text, which stays null)."""
    done = secrets.scan_documents(docs.select(*COLUMNS))
    text = F.col("redacted")
    return done.select("doc_id", text.alias("text"), "lang", "source", F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("n_chars"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and tokens of every document; what the tokens decode to is not computed here. Cases as for `bpe.encode`."""
    done = bpe.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary_path(), decode=False)
    return done.select("doc_id", "lang", "source", F.size("tokens").cast("long").alias("n_tokens"), "tokens")


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("bpe", bpe_stage),
]

#: The stages are a fitted classifier, sketches and tokenizers, which SQL does not express; a test holds `run` against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
