"""What the names of tables and columns say: a catalog of columns with what their names hold, and rules over pairs of them.

The catalog has a row for each column, so all of this is of metadata size. Rules are SQL conditions over the two sides of a pair.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark import config as C

#: Parts of a name between separators, and at a step from lower to upper case.
CAMEL = r"(?<=[a-z])(?=[A-Z])"
SEPARATORS = r"[^a-z0-9]+"
#: Names without separators that stand for an identifier.
IDENTIFIER = rf"(?:id|key)$|identifier|^(?:{'|'.join(C.OWNER_NAMES)})$"
#: (what the rule says, score, condition) of a pair in which `c` may refer to `p`; the first that holds gives the score.
REFERENCE_RULES = (
    ("one identifier in two places", 1.00, "p.flat = c.flat AND p.identifier"),
    ("the parent's table or identifier, without its ending", 0.95, "p.identifier AND c.stem IN (p.entity, p.stem)"),
    ("the parent's table inside of an identifier", 0.90, "c.identifier AND p.entity <> '' AND contains(c.stem, p.entity)"),
    ("a level of one table's hierarchy", 0.95, "p.entity = c.entity AND (p.level OR c.level)"),
    ("somebody to whom work is assigned", 0.85, "p.people AND c.assigned"),
)
#: Conditions of a pair that allow it to be compared, whatever its scores.
SHARED_DOMAIN = "a.bare = b.bare AND a.describes"
SAME_NAME = "a.table <> b.table AND a.flat = b.flat"
PLAIN_ID = "a.table <> b.table AND ((a.flat = 'id' AND b.identifier) OR (b.flat = 'id' AND a.identifier))"
HIERARCHY = "a.entity = b.entity AND (a.level OR b.level)"
#: (score, condition on `tokens`, `flat`): how well a name names a record; the first that holds.
RECORD_RULES = (
    (100, "arrays_overlap(tokens, array({hints}))"),
    (90, "flat RLIKE '({ends})$'"),
    (10, "flat RLIKE '(no|number)$|serial' AND flat RLIKE '{describing}'"),
    (70, "flat RLIKE '(no|number)$|serial'"),
    (60, "flat IN ('sn', 'sno', 'seq', 'sequence', 'rowno', 'recordno')"),
)


def flat(name: Column) -> Column:
    """Letters and digits in lower case."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def is_identifier(name: str) -> bool:
    """Whether a name is one of an identifier."""
    low = name.lower()
    return bool(re.search(IDENTIFIER, re.sub(r"[\W_]", "", low))) or not set(re.split(SEPARATORS, low)).isdisjoint(C.ID_TOKENS)


def catalog(spark: SparkSession, columns: list[tuple[str, str]]) -> DataFrame:
    """A row for each (table, column), in their order, with what the names hold."""
    rows = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(t).alias("table"), F.lit(c).alias("column")) for i, (t, c) in enumerate(columns)])
    df = spark.range(0, 1, 1, 1).select(F.inline(rows if columns else F.array().cast("array<struct<at:int,table:string,column:string>>")))
    one_of = lambda c, words: F.col(c).rlike("|".join(words))
    tokens = lambda c: F.split(F.lower(c), SEPARATORS)
    df = df.withColumns({"flat": flat(F.col("column")), "entity": F.regexp_replace(flat(F.col("table")), r"^(.{3,})s$", "$1"), "tokens": tokens(F.regexp_replace("column", CAMEL, "_"))})
    return df.withColumns(
        {
            "stem": F.regexp_replace("flat", r"^(.+?)(?:identifier|id|key)$", "$1"),
            "identifier": F.col("flat").rlike(IDENTIFIER) | F.arrays_overlap(tokens("column"), F.array(*map(F.lit, C.ID_TOKENS))),
            "bare": F.regexp_replace("flat", rf"^(?:{'|'.join(C.DESCRIPTIVE_PREFIXES)})+(?=.)", ""),
            "level": one_of("flat", C.HIERARCHY_TERMS),
            "people": F.col("entity").isin(*C.ASSIGNMENT_PARENTS),
            "assigned": one_of("flat", C.ASSIGNMENT_KEYS),
        }
    ).withColumn("describes", F.col("bare").isin(*C.DESCRIPTIVE_TERMS))


def reference_score(parent: str, child: str) -> Column:
    """How well the name of a column says that it refers to another one, of two sides of a pair."""
    score = F.lit(0.0)
    for _, value, condition in reversed(REFERENCE_RULES):
        score = F.when(F.expr(condition.replace("p.", f"{parent}.").replace("c.", f"{child}.")), value).otherwise(score)
    return score


def pairs(spark: SparkSession, columns: list[tuple[str, str]], config: C.Config = C.DEFAULT) -> DataFrame:
    """Pairs of columns whose names allow them to be compared, with their scores: a table of metadata size.

    Two columns of one table are compared only where one is a level of a hierarchy.
    """
    known = catalog(spark, columns)
    later = known.withColumn("to", F.explode(F.expr(f"slice(sequence(0, {max(len(columns), 1)}), at + 2, {len(columns)})")))
    both = later.alias("a").join(known.alias("b"), F.col("a.to") == F.col("b.at"))
    both = both.where("(a.table <> b.table OR a.column <> b.column)").where(f"a.table <> b.table OR ({HIERARCHY})")
    both = both.select("a.*", F.struct("b.*").alias("other"), F.struct("a.*").alias("own"))
    score = lambda parent, child: reference_score(parent, child)
    shared = F.expr(SHARED_DOMAIN.replace("a.", "own.").replace("b.", "other."))
    out = both.select(
        *[F.col(f"{side}.{c}").alias(f"{c}_{s}") for s, side in (("a", "own"), ("b", "other")) for c in ("table", "column")],
        score("own", "other").alias("score_a"),
        score("other", "own").alias("score_b"),
        F.col("own.identifier").alias("id_a"),
        F.col("other.identifier").alias("id_b"),
        shared.alias("shared"),
        (F.col("own.flat") == F.col("other.flat")).alias("same"),
        F.expr(f"({SAME_NAME}) OR ({PLAIN_ID})".replace("a.", "own.").replace("b.", "other.")).alias("_named"),
    )
    return out.where(F.col("_named") | F.col("shared") | (F.greatest("score_a", "score_b") >= config.name_score)).drop("_named")


def record_rank(df: DataFrame) -> DataFrame:
    """`df` (with `column`) and `rank`: how well the name names a record, 0 where it does not."""
    hints = [h.replace("_", "") for h in (*C.ID_TOKENS, *C.ID_PHRASES)]
    words = {"hints": ", ".join(f"'{h}'" for h in hints), "ends": "|".join(hints), "describing": "|".join((*C.DESCRIPTIVE_TERMS, *C.DESCRIPTIVE_PREFIXES))}
    rank = F.lit(0)
    for value, condition in reversed(RECORD_RULES):
        rank = F.when(F.expr(condition.format(**words)), value).otherwise(rank)
    named = df.withColumns({"flat": flat(F.col("column")), "tokens": F.split(F.lower(F.regexp_replace("column", CAMEL, "_")), SEPARATORS)})
    return named.withColumn("rank", rank).drop("flat", "tokens")
