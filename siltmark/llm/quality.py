"""Quality by hierarchical empirical Bayes over document, path and host.

A document classifier gives evidence from the shape of the text. Its mean over a path (a section of a host) and over a
host are shrunk, by weights estimated from the spread between sites, toward the host and toward the global rate;
sparse sites stay near the prior. The posterior rate of the path replaces the base rate in the document's odds.
All of it is DataFrame expressions and grouped sums; only the classifier is fitted on the driver, on a bounded sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.llm.common import has_columns, materialise, named
from siltmark.llm.toxicity import FIT_ROWS, fit_logistic, training_rows

#: Documents are kept from this probability of good quality on.
KEEP_FROM = 0.5
#: Pseudo-counts of a site's prior: least and most.
PRIOR_ROWS = (8.0, 1e6)


def shape(text: Column) -> list[Column]:
    """Features of a text, bounded: shares of kinds of characters and of words, and lengths on a log scale."""
    t = F.coalesce(text, F.lit(""))
    n = F.char_length(t)
    words = F.regexp_count(t, F.lit(r"\S+"))
    per_char = lambda p: F.regexp_count(t, F.lit(p)) / F.greatest(n, F.lit(1))
    per_word = lambda p: F.regexp_count(t, F.lit(p)) / F.greatest(words, F.lit(1))
    return [
        per_char(r"\p{Lu}"),
        per_char(r"[^\p{L}\p{N}\s]"),
        per_char(r"\p{N}"),
        per_word(r"[#$%&*!|+=~^]+(?=\s|$)"),
        per_word(r"(?<!\S)\|(?!\S)"),
        per_word(r"!!"),
        per_word(r"[.?](?=\s|$)"),
        per_word(r"(?<!\S)\p{Ll}+(?!\S)"),
        per_word(r"\n"),
        per_word(r"(?<!\S)(\S+)(?=\s+\1(?!\S))"),
        F.log1p(words) / 10,
        F.least(n / F.greatest(words, F.lit(1)), F.lit(40)) / 40,
    ]


@dataclass
class Model:
    weights: list[float]
    base: float

    def logit(self, features: list[Column]) -> Column:
        return sum((F.lit(w) * f for w, f in zip(self.weights[1:], features, strict=True)), F.lit(self.weights[0]))


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> Model:
    """Fit the document classifier on at most about `limit` labelled rows (labels: doc_id, quality) outside the held-out fold; only features reach the driver."""
    rows = training_rows(docs, labels, "quality", limit).select("y", *[f.alias(f"f{i}") for i, f in enumerate(shape(F.col("text")))]).collect()
    y = np.array([r[0] for r in rows], float)
    k = len(shape(F.lit("")))
    if not len(y) or y.min() == y.max():
        return Model([3.0] + [0.0] * k, 0.95)
    x = np.array([r[1:] for r in rows], float)
    return Model(fit_logistic(x, y, ridge=1e-3).tolist(), float(y.mean()))


def _sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _logit(p: Column) -> Column:
    return F.log(p / (F.lit(1.0) - p))


def _prior_rows(n_sites: float, rows: float, squares: float, mean: float, spread: float) -> float:
    """Pseudo-counts of a beta prior by moments: what of the spread between sites is more than sampling explains."""
    within = mean * (1 - mean)
    if n_sites < 2 or rows <= 0 or within <= 0:
        return PRIOR_ROWS[1]
    typical = (rows - squares / rows) / (n_sites - 1)
    between = (spread - (n_sites - 1) * within) / max(typical * (n_sites - 1), 1e-9)
    return float(np.clip(within / between - 1 if between > 1e-9 else PRIOR_ROWS[1], *PRIOR_ROWS))


def with_sites(docs: DataFrame, url: str = "url") -> DataFrame:
    """`docs` with `host` (in lower case) and `path` (the first section of the path, empty at the root) of a URL; both null where it is none. Columns of these names are replaced."""
    u = F.col(url).cast("string")
    section = F.regexp_extract(F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit("")), r"^/*([^/]*)/", 1)
    host = F.lower(F.try_parse_url(u, F.lit("HOST")))
    return docs.withColumns({"host": host, "path": F.when(host.isNotNull(), section)})


def score(docs: DataFrame, model: Model, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, doc_score, host_rate, path_rate, score and kept of each row of `docs` (doc_id, text, host and path columns).

    `with_sites` makes the columns from URLs; documents without one have the source as host and the language as its section.
    Defined cases: null hosts and paths are sites of their own; null and empty texts have features of 0; a null doc_id stays null; repeated rows
    come back repeated and count as often in their site; other columns are ignored; an empty table gives an empty result.
    """
    has_columns(docs, "doc_id", "text", host, path)
    site = [F.col(c).cast("string") for c in (host, path)]
    key = lambda c, name: F.coalesce(F.concat(F.lit("="), c), F.lit("")).alias(name)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key(site[0], "host"), key(site[1], "path"), model.logit(shape(F.col("text").cast("string"))).alias("z"))
    rows = materialise(rows.withColumn("p", _sigmoid(F.col("z"))), "evidence")
    paths = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"))
    paths = materialise(paths, "sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    total = hosts.agg(F.count(F.lit(1)), F.sum("hn"), F.sum(F.col("hn") * F.col("hn")), F.sum("hs"), F.sum(F.col("hs") * F.col("hs") / F.col("hn"))).first()
    n_hosts, n, squares, s, spread = (float(v or 0) for v in total)
    mean = min(max(s / n, 1e-6), 1 - 1e-6) if n else model.base
    k_host = _prior_rows(n_hosts, n, squares, mean, spread - n * mean * mean)
    inner = paths.join(hosts, "host").agg(F.count(F.lit(1)), F.sum(F.col("n") * F.col("n")), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("hs") / F.col("hn"), 2))).first()
    k_path = _prior_rows(float(inner[0] or 0), n, float(inner[1] or 0), mean, float(inner[2] or 0))
    bound = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    rates = paths.join(hosts, "host").withColumn("host_rate", bound((F.col("hs") + k_host * mean) / (F.col("hn") + k_host)))
    rates = rates.withColumn("path_rate", bound((F.col("s") + k_path * F.col("host_rate")) / (F.col("n") + k_path))).select("host", "path", "host_rate", "path_rate")
    out = rows.join(rates, ["host", "path"])
    z = F.col("z") - F.lit(float(np.log(mean / (1 - mean)))) + _logit(F.col("path_rate"))
    return out.withColumn("score", _sigmoid(z)).select("doc_id", F.col("p").alias("doc_score"), "host_rate", "path_rate", "score", (F.col("score") >= KEEP_FROM).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """The rows of `docs` that are kept, with their columns. Rows are matched to their scores by doc_id; a doc_id that stands for several texts is kept if one of them is. Rows without doc_id are kept."""
    scored = score(docs, fit(docs, labels), host, path)
    gone = scored.groupBy("doc_id").agg(F.max("kept").alias("kept")).where("NOT kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*[named(c) for c in docs.columns])
