"""Fill-in-middle transformation with DataFrame functions: units as rows, running sums of their lengths, cuts joined by ordinal.

A text is cut into units (a word with the white space before it, or white space at its end). Units are rows (document, ordinal,
running sum of lengths); a document's cut requests name ordinals, and the join of both gives the offsets at which the text
is taken apart. Documents are dealt out once, by their key; units, cuts and texts then meet without another shuffle, and rows that
repeat are counted before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltmark.llm.common import has_columns

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINEL = "<[PSM]>"
#: Shares, in percent, of documents that are rearranged, and of those that begin with the suffix.
RATE, SPM_RATE = 50, 80
SEED = 42
#: A document: its id (0 for none, told apart by `named`) and a hash of its text.
KEY = ["id", "named", "h"]


def _draw(k: int, seed: int) -> Column:
    """The k-th of the numbers that a document draws: 8 hex digits of a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.when(F.col("named"), F.col("id").cast("string")).otherwise(F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def _keyed(docs: DataFrame) -> DataFrame:
    """Each different document once, with `copies`, dealt out by its key. Rows that repeat meet on the side of the reader first."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("doc_id").isNotNull().alias("named"), F.xxhash64("text").alias("h"), "text")
    # all that read this ask for all columns, so that it is shuffled once
    return rows.groupBy(*KEY).agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")).where("copies > 0")


def units(keyed: DataFrame) -> DataFrame:
    """KEY, ordinal and stop (code points up to the end of the unit) of each unit. Ordinal 0 is an empty unit before the first one."""
    matches = F.concat(F.array(F.lit("")), F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)))
    rows = keyed.select(*KEY, F.posexplode(matches).alias("ordinal", "unit"))
    rows = rows.select(*KEY, "ordinal", F.char_length("unit").cast("long").alias("size"))
    before = Window.partitionBy(*KEY).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(*KEY, "ordinal", F.sum("size").over(before).alias("stop"))


def requests(keyed: DataFrame, seed: int = SEED) -> DataFrame:
    """KEY, n (units), and the ordinals of the last units of prefix and middle; 0 for none."""
    rows = keyed.select(*KEY, F.size(F.regexp_extract_all("text", F.lit(UNIT), F.lit(0))).cast("long").alias("n"))
    one, two = (F.pmod(_draw(k, seed), F.col("n") + 1) for k in (1, 2))
    return rows.select(*KEY, "n", F.least(one, two).alias("first_cut"), F.greatest(one, two).alias("last_cut"))


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n, form (plain, spm or psm), prefix_chars, middle_chars and output of each row of `docs` (doc_id, text).

    Defined cases: a null or empty text has no units and stays plain; so does a text that holds a sentinel. A null doc_id draws as
    an empty one and stays null. Repeated rows come back repeated. Two equal cuts give an empty middle. Other columns are
    ignored. An empty table gives an empty result. A very long text is one row of many units, of which a task sums and spills some at a time; its
    units stand in memory once while they are matched.
    """
    keyed = _keyed(has_columns(docs, "doc_id", "text"))
    # by ordinal, as one condition on both cuts: an equality would deal out all units once more
    cut = (F.col("ordinal") == F.col("first_cut")) | (F.col("ordinal") == F.col("last_cut"))
    wanted = requests(keyed, seed)
    u, q = units(keyed).alias("u"), wanted.alias("q")
    on = [F.col(f"u.{c}") == F.col(f"q.{c}") for c in KEY]
    # units stand on the left, as the join holds the rows of a key on the right: one request
    met = u.join(q, [*on, cut])
    stop_at = lambda c: F.max(F.when(F.col("ordinal") == F.col(c), F.col("stop")))
    offsets = met.groupBy(*[F.col(f"q.{c}").alias(c) for c in KEY], "n", "first_cut", "last_cut").agg(stop_at("first_cut").alias("a"), stop_at("last_cut").alias("b"))
    rows = keyed.join(offsets, KEY)
    text, a, b = F.col("text"), F.col("a").cast("int"), F.col("b").cast("int")
    plain = (text == "") | text.rlike(SENTINEL) | (_draw(3, seed) % 100 >= rate)
    form = F.when(plain, F.lit("plain")).when(_draw(4, seed) % 100 < spm_rate, F.lit("spm")).otherwise(F.lit("psm"))
    prefix, middle, suffix = text.substr(F.lit(1), a), text.substr(a + 1, b - a), text.substr(b + 1, F.char_length(text))
    rows = rows.withColumn("form", form)
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
    output = output.otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    cutting = F.col("form") != "plain"
    return rows.select(
        F.when(F.col("named"), F.col("id")).alias("doc_id"),
        "n",
        "form",
        F.when(cutting, F.col("a")).alias("prefix_chars"),
        F.when(cutting, F.col("b") - F.col("a")).alias("middle_chars"),
        output.alias("output"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"),
    ).drop("_copy")


def restore(output: Column, form: Column) -> Column:
    """The text from what `transform` made of it. No sentinel can arise where pieces meet, so the three that were put in are the only ones."""
    part = F.split(output, SENTINEL)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))


def infill_digests(docs: DataFrame) -> DataFrame:
    """`transform` with digests of the output and of the text rebuilt from it, in place of the output. Cases as there."""
    done = transform(docs)
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
