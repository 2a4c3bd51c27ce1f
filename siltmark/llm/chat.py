"""Chat formatting with DataFrame functions only: schema fingerprints select declarative mappings to canonical turns.

A record is JSON text of any known layout. Its fingerprint is a hash of its nested field paths, scalar
types left out; a registry of mappings says which fingerprint's paths hold the turns. Turns are
written into one template whose control strings are escaped inside texts, and read back from it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, MIDDLE, END = "<|turn|>", "<|text|>", "<|end|>"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """How records of one layout become turns.

    `fields`: (role, path) pairs for flat layouts, in order; a second path is joined to the first by a blank line.
    `turns`: (path of the array, role field, text field) for lists of messages.
    `turn`: (path of the role, path of the text) for a single message, whose role is kept as it is.
    """

    name: str
    examples: tuple[dict, ...]
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    turns: tuple[str, str, str] | None = None
    turn: tuple[str, str] | None = None


#: Role names of other layouts, and ours.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

MAPPINGS = (
    Mapping("prompt", ({"prompt": "a", "response": "b"}, {"system": "s", "prompt": "a", "response": "b"}), fields=(("system", ("$.system",)), ("user", ("$.prompt",)), ("assistant", ("$.response",)))),
    Mapping("completion", ({"prompt": "a", "completion": "b"},), fields=(("user", ("$.prompt",)), ("assistant", ("$.completion",)))),
    Mapping("instruction", ({"instruction": "a", "input": "i", "output": "b"}, {"instruction": "a", "output": "b"}), fields=(("user", ("$.instruction", "$.input")), ("assistant", ("$.output",)))),
    Mapping("question", ({"question": "a", "answer": "b"},), fields=(("user", ("$.question",)), ("assistant", ("$.answer",)))),
    Mapping("messages", ({"messages": [{"role": "r", "content": "c"}]}, {"id": 1, "messages": [{"role": "r", "content": "c"}]}), turns=("$.messages", "role", "content")),
    Mapping("conversations", ({"conversations": [{"from": "r", "value": "c"}]}, {"id": 1, "conversations": [{"from": "r", "value": "c"}]}), turns=("$.conversations", "from", "value")),
    Mapping("message", ({"role": "r", "content": "c"},), turn=("$.role", "$.content")),
    Mapping("utterance", ({"from": "r", "value": "c"},), turn=("$.from", "$.value")),
    Mapping("speech", ({"speaker": {"name": "r"}, "said": {"text": "c"}},), turn=("$.speaker.name", "$.said.text")),
)


def paths_of(value: object) -> str:
    """The field paths of an example, as `field_paths` writes them."""
    if isinstance(value, dict):
        return "OBJECT<" + ", ".join(f"{k}: {paths_of(v)}" for k, v in sorted(value.items())) + ">"
    if isinstance(value, list):
        return f"ARRAY<{paths_of(value[0]) if value else '_'}>"
    return "_"


def field_paths(record: Column) -> Column:
    """The nested field paths of JSON text, without scalar types; null where it is no JSON."""
    schema = F.schema_of_variant(F.try_parse_json(record))
    return F.regexp_replace(schema, r"(?<=: |ARRAY<|^)(?:STRING|BIGINT|DOUBLE|BOOLEAN|VOID|VARIANT|DECIMAL\(\d+,\d+\))(?=[,>]|$)", "_")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(field_paths(record))


def canonical_turns(df: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """`df` with `fingerprint`, `layout` (null where no mapping fits) and `turns` (role, text).

    Records that are null, not JSON, or of an unknown layout have a null layout and no turns. Null
    texts are empty; absent optional fields make no turn. Columns of those names are replaced.
    """
    v = F.try_parse_json(F.col(record))
    get = lambda path: F.try_variant_get(v, path, "string")
    layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    df = df.withColumn("_paths", field_paths(F.col(record))).withColumn("fingerprint", F.xxhash64("_paths"))
    for m in reversed(mappings):
        known = [paths_of(e) for e in m.examples]
        # by the fingerprint; on a hit, the paths rule out that two layouts share one
        hit = F.col("fingerprint").isin(*[F.xxhash64(F.lit(p)) for p in known]) & F.col("_paths").isin(known)
        if m.turns:
            path, role, text = m.turns
            got = F.transform(F.try_variant_get(v, path, f"array<struct<`{role}`:string,`{text}`:string>>"), _turn(role, text))
        elif m.turn:
            role, text = (F.coalesce(get(p), F.lit("")) for p in m.turn)
            got = F.array(F.struct(role.alias("role"), text.alias("text")))
        else:
            parts = [
                F.when(
                    F.coalesce(*[get(p) for p in paths]).isNotNull(),
                    F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *[F.when(get(p) != "", get(p)) for p in paths]).alias("text")),
                )
                for role, paths in m.fields
            ]
            got = F.filter(F.array(*parts), lambda x: x.isNotNull())
        layout = F.when(hit, F.lit(m.name)).otherwise(layout)
        turns = F.when(hit, got).otherwise(turns)
    return df.withColumn("layout", layout).withColumn("turns", F.coalesce(turns, F.array().cast(TURNS))).drop("_paths")


def _turn(role: str, text: str) -> Callable[[Column], Column]:
    return lambda x: F.struct(_role(F.coalesce(x[role], F.lit(""))).alias("role"), F.coalesce(x[text], F.lit("")).alias("text"))


def _role(role: Column) -> Column:
    pairs = [x for k, v in ROLES.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), role), role)


def escape(text: Column) -> Column:
    """One bar more after each `<` that bars follow; controls have exactly one, then a letter."""
    return F.regexp_replace(text, r"<(\|+)", r"<$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\|+)\|", r"<$1")


def format_turns(turns: Column) -> Column:
    """The template: `<|turn|>role<|text|>text<|end|>` for each turn, escaped."""
    one = lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(MIDDLE), escape(t["text"]), F.lit(END))
    return F.concat_ws("", F.transform(turns, one))


def _running(lengths: Column) -> Column:
    """The sum of all lengths before each, by blocks of about sqrt(n): an accumulator that copied the whole array at each step would take n^2."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def within(block: Column) -> Column:
        return F.aggregate(block, zero, step, lambda acc: acc["out"])

    side = F.ceil(F.sqrt(F.size(lengths))).cast("int")
    whole = F.struct(lengths.alias("all"), side.alias("side"))
    # an array of one struct: what the lambda below refers to is then evaluated once
    blocks = F.flatten(F.transform(F.array(whole), lambda w: F.transform(F.sequence(F.lit(0), F.greatest(w["side"] - 1, F.lit(0))), lambda i: F.slice(w["all"], i * w["side"] + 1, w["side"]))))
    parts = F.transform(blocks, lambda b: F.struct(within(b).alias("starts"), F.aggregate(b, F.lit(0), lambda x, y: x + y).alias("total")))

    def joined(p: Column) -> Column:
        return F.flatten(F.zip_with(p["parts"], p["bases"], lambda one, base: F.transform(one["starts"], lambda x: x + base)))

    both = F.transform(F.array(parts), lambda ps: F.struct(ps.alias("parts"), within(F.transform(ps, lambda one: one["total"])).alias("bases")))
    return F.transform(both, joined)[0]


def segments_of(formatted: Column) -> Column:
    """The turns of a formatted text, each without its first control."""
    return F.filter(F.split(formatted, r"<\|turn\|>"), lambda s: s != "")


def parse_turns(formatted: Column) -> Column:
    """Turns read back from the template, with the offset of each escaped text in it: role, text, start, length."""

    def piece(s: Column) -> Column:
        cut = F.split(s, r"<\|text\|>", 2)
        raw = F.regexp_replace(cut[1], r"<\|end\|>$", "")
        return F.struct(unescape(cut[0]).alias("role"), unescape(raw).alias("text"), F.char_length(s).alias("all"), F.char_length(cut[0]).alias("head"), F.char_length(raw).alias("length"))

    def placed(x: Column, at: Column) -> Column:
        return F.struct(x["role"].alias("role"), x["text"].alias("text"), (at + len(START) + x["head"] + len(MIDDLE)).cast("int").alias("start"), x["length"].alias("length"))

    pieces = F.array(F.transform(segments_of(formatted), piece))
    return F.transform(pieces, lambda ps: F.zip_with(ps, _running(F.transform(ps, lambda x: x["all"] + len(START))), placed))[0]


def format_turn_arrays(df: DataFrame) -> DataFrame:
    """`df` (with `turns`) and `formatted`, `parsed` (the turns read back from it) and `loss_spans`: (start, length) of assistant texts in it, in code points."""
    df = df.withColumn("formatted", format_turns(F.col("turns"))).withColumn("parsed", parse_turns(F.col("formatted")))
    spans = F.transform(F.filter("parsed", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return df.withColumn("loss_spans", spans)


def format_records(df: DataFrame, record: str = "record") -> DataFrame:
    """`df` with fingerprint, layout, turns, `formatted`, and `loss_spans`: (start, length) of assistant texts in it, in code points."""
    return format_turn_arrays(canonical_turns(df, record)).drop("parsed")


#: Layouts that `records` writes, in turn by conv_id.
WRITTEN = ("message", "utterance", "speech")


def records(conversations: DataFrame) -> DataFrame:
    """conv_id, turn and one JSON record for each row (conv_id, turn, role, text), of one of three layouts by conv_id, as from three sources; null roles and texts are empty."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    conv = F.col("conv_id").cast("long")
    layouts = (
        F.to_json(F.struct(role.alias("role"), text.alias("content"))),
        F.to_json(F.struct(role.alias("from"), text.alias("value"))),
        F.to_json(F.struct(F.struct(role.alias("name")).alias("speaker"), F.struct(text.alias("text")).alias("said"))),
    )
    at = F.pmod(conv, F.lit(len(WRITTEN)))
    return conversations.select(conv.alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(at == 1, layouts[1]).when(at == 2, layouts[2]).otherwise(layouts[0]).alias("record"))


def conversations_of(rows: DataFrame) -> DataFrame:
    """conv_id, layout and turns from rows (conv_id, turn, record): each record is mapped where it is read, then its turns are gathered.

    Turns are in the order of `turn`, ties in that of role and text. One conversation becomes one row, whatever its length: its output
    is one sequence. A record of no known layout (a text beyond the size that a variant can hold, too) ends the query; nothing is lost silently.
    """
    one = canonical_turns(rows, "record").withColumn("layout", F.coalesce("layout", F.raise_error(F.lit("a record has no known layout")).cast("string")))
    turns = F.col("turns")[0]
    kept = one.select("conv_id", "layout", F.struct("turn", turns["role"].alias("role"), turns["text"].alias("text")).alias("t"))
    return kept.groupBy("conv_id").agg(F.min("layout").alias("layout"), F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def chat_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, layout, read back from the template, of each conversation of rows (conv_id, turn, role, text).

    Defined cases: null roles and texts are empty; rows without a conv_id are one conversation; rows of one turn go by role and text, repeated rows are
    repeated turns; a conversation without assistant texts has no characters under the mask; other columns are ignored; no rows give none.
    """
    done = format_turn_arrays(conversations_of(records(conversations))).drop("turns")
    # texts under the mask, cut from the turn that each span lies in: an offset into the whole text is found by walking it
    turn = lambda s, t: F.struct(s.alias("segment"), t["role"].alias("role"), (t["start"] - F.char_length(F.split(s, r"<\|text\|>", 2)[0]) - len(MIDDLE)).alias("at"))
    learned = F.filter(F.zip_with(segments_of(F.col("formatted")), F.col("parsed"), turn), lambda x: x["role"] == "assistant")
    loss = F.concat_ws("", F.zip_with(learned, F.col("loss_spans"), lambda x, s: unescape(F.substring(x["segment"], s["start"] - x["at"] + 1, s["length"]))))
    return done.withColumn("loss", loss).select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )
