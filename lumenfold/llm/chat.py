r"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is a run of turns, with nothing between them::

    user       [INST] text [/INST]
    assistant  <s> text </s>
    any other  [TURN role] text [/TURN]        (null role: [TURN] ...)

A role other than letters, digits, ``_.-`` is written as = and its UTF-8 in hex. The parser takes
turns from left to right, refuses a control string inside a text, and drops the backslash of each
escape. Each turn is rendered as it is and parsed again; where the turn that comes back differs,
its ``\``, ``[`` and ``<`` get a backslash. The whole conversation is then parsed and compared; if
it differed, all its texts would be escaped, and it is an error if even that isn't identical.

Nulls: a null text is empty, a null role is kept (as "" in digests), null conversation ids form one
conversation, null turns come first. Equal turn numbers: by role, then text. Empty table: empty
result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"\[/?INST\]|</?s>|\[TURN|\[/TURN\]"
TURN = r"(?s)\[INST\] .*? \[/INST\]|<s> .*? </s>|\[TURN(?:| [A-Za-z0-9_.=-]*)\] .*? \[/TURN\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\\[<])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render_turn(role: Column, text: Column) -> Column:
    name = F.when(role.rlike(r"\A[A-Za-z0-9_.-]+\z"), role).otherwise(F.concat(F.lit("="), F.hex(F.encode(role, "UTF-8"))))
    return (
        F.when(role == "user", F.concat(F.lit("[INST] "), text, F.lit(" [/INST]")))
        .when(role == "assistant", F.concat(F.lit("<s> "), text, F.lit(" </s>")))
        .otherwise(F.concat(F.lit("[TURN"), F.coalesce(F.concat(F.lit(" "), name), F.lit("")), F.lit("] "), text, F.lit(" [/TURN]")))
    )


def _parse_turn(turn: Column) -> Column:
    """role, text, and where in the turn the body stands (from, chars); a null text if the body holds a control string."""
    user, assistant = turn.startswith("[INST] "), turn.startswith("<s> ")
    name = F.regexp_extract(turn, r"\A\[TURN(?: ([A-Za-z0-9_.=-]*))?\] ", 1)
    named = F.when(name.startswith("="), F.decode(F.unhex(F.substring(name, 2, 1 << 30)), "UTF-8")).otherwise(name)
    role = F.when(user, "user").when(assistant, "assistant").when(~turn.startswith("[TURN] "), named)
    head = F.when(user, 7).when(assistant, 4).otherwise(F.length(F.regexp_extract(turn, r"\A\[TURN[^\]]*\] ", 0)))
    tail = F.when(assistant, 5).otherwise(8)
    body = F.substring(turn, head + 1, F.length(turn) - head - tail)
    plain = F.when(~F.regexp_replace(body, r"(?s)\\.", "").rlike(CONTROL), unescape(body))
    return F.struct(role.alias("role"), plain.alias("text"), head.alias("from"), F.length(body).alias("chars"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation; null if it isn't a run of turns."""
    turns = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0))
    return F.when(F.array_join(turns, "") == formatted, F.transform(turns, lambda t: F.struct(_parse_turn(t).alias("turn"), F.length(t).alias("length"))))


def _same(parsed: Column, turns: Column) -> Column:
    back = F.transform(parsed, lambda p: F.struct(p["turn"]["role"].alias("role"), p["turn"]["text"].alias("text")))
    return back.eqNullSafe(turns)


def format_chat(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv, formatted, turns (as parsed), loss_spans (from, chars; in code points of formatted)."""
    t = rows.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    own = F.array(F.struct("role", "text"))
    t = t.withColumn("raw", render_turn(F.col("role"), F.col("text")))
    t = t.withColumn("back", parse(F.col("raw")))
    t = t.withColumn("sure", render_turn(F.col("role"), escape(F.col("text"))))
    t = t.withColumn("shown", F.when(_same(F.col("back"), own), F.col("raw")).otherwise(F.col("sure")))
    # "sure" is kept only where it differs, for the case that a whole conversation must be escaped
    item = F.struct("turn", "role", "text", "shown", F.when(F.col("sure") != F.col("shown"), F.col("sure")).alias("sure"))
    c = t.groupBy("conv").agg(F.array_sort(F.collect_list(item)).alias("items"))
    source = F.transform("items", lambda i: F.struct(i["role"].alias("role"), i["text"].alias("text")))
    c = c.select("conv", "items", source.alias("source"), F.array_join(F.transform("items", lambda i: i["shown"]), "").alias("first"))
    c = c.withColumn("first_back", parse(F.col("first")))
    all_sure = F.array_join(F.transform("items", lambda i: F.coalesce(i["sure"], i["shown"])), "")
    c = c.withColumn("formatted", F.when(_same(F.col("first_back"), F.col("source")), F.col("first")).otherwise(all_sure))
    c = c.select("conv", "formatted", "source", parse(F.col("formatted")).alias("parsed"))
    wrong = F.raise_error(F.concat(F.lit("chat formatting: no round trip for conversation "), F.coalesce(F.col("conv").cast("string"), F.lit("null"))))
    c = c.withColumn("parsed", F.when(_same(F.col("parsed"), F.col("source")), F.col("parsed")).otherwise(F.lit(None).cast(c.schema["parsed"].dataType)))
    c = c.withColumn("parsed", F.when(F.col("parsed").isNotNull(), F.col("parsed")).otherwise(F.array(F.struct(F.struct(wrong.cast("string").alias("role"), F.lit("").alias("text"), F.lit(0).alias("from"), F.lit(0).alias("chars")).alias("turn"), F.lit(0).alias("length")))))
    spans = F.aggregate(
        "parsed", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,chars:int>>").alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + p["length"]).alias("at"),
            F.when(p["turn"]["role"] == "assistant", F.concat(s["spans"], F.array(F.struct((s["at"] + p["turn"]["from"]).alias("from"), p["turn"]["chars"].alias("chars"))))).otherwise(s["spans"]).alias("spans"),
        ),
    )["spans"]
    turns = F.transform("parsed", lambda p: F.struct(p["turn"]["role"].alias("role"), p["turn"]["text"].alias("text")))
    return c.select("conv", "formatted", turns.alias("turns"), spans.alias("loss_spans"))


def loss_text(formatted: Column, spans: Column) -> Column:
    """What stands under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["from"] + 1, s["chars"]))), "")
