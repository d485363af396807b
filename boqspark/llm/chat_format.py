r"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn is rendered as ``### <role>: <text>`` and closed by a line ``</turn>``. Grammar: a conversation is a run of
blocks that end in ``\n</turn>\n``; a block is ``### ``, a role without an open colon, ``: `` and the text. A
text is first rendered as it is and reparsed; where the parser recovers something else (a control string inside the
text, or a backslash before one), the text is escaped by one more backslash before each control string, which the
parser takes away again. A whole run of three or more ``#`` is one control string. A text whose escaped form is not
read back as it was is an error.

Defined results: null role or text = empty; turns in the order of turn (null first), role, text; repeated rows are
turns of their own; null conversation ids form one conversation; an empty table gives no rows; extra columns are
ignored. Loss mask: the text of every turn of role `assistant`, as spans in code points of `formatted`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

CLOSE = "\n</turn>\n"
_CONTROL = r"(?:#{3,}|</turn>)"
_OPEN = r"(?<!\\)(?:(?<!#)#{3}|</turn>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*{_CONTROL})", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*{_CONTROL})", "$1")


def _role_out(role: Column) -> Column:
    return F.regexp_replace(role, r"([\\:#<])", r"\\$1")


def _head(role: Column) -> Column:
    return F.concat(F.lit("### "), _role_out(role), F.lit(": "))


_HEAD = r"(?s)^### ((?:[^\\:]++|\\.)*+): "


def parse_role(block: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(block, _HEAD, 1), r"(?s)\\(.)", "$1")


def parse_text(block: Column) -> Column:
    """The text of a block; null if the block breaks the grammar: an open control string in the text."""
    body = F.regexp_replace(block, _HEAD, "")
    return F.when(~body.rlike(_OPEN), unescape(body))


def _rendered(role: Column, text: Column) -> Column:
    """Raw where the parser recovers the source from it, else escaped; an error where it recovers it from neither."""

    def same(body: Column) -> Column:
        back = F.split(F.concat(_head(role), body, F.lit(CLOSE)), CLOSE, -1)
        return (F.size(back) == 2) & parse_role(back[0]).eqNullSafe(role) & parse_text(back[0]).eqNullSafe(text)

    failed = F.raise_error(F.concat(F.lit("turn is not read back as it was, role: "), role))
    return F.when(same(text), text).when(same(escape(text)), escape(text)).otherwise(failed)


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """A row per conversation: `conv_id`, `formatted`, `loss_spans` (block from 0, start, length, in code points), `round_trip`."""
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("body", _rendered(F.col("role"), F.col("text")))
    rows = rows.withColumn("block", F.concat(_head(F.col("role")), "body", F.lit(CLOSE)))
    at = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = at.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select(
        "conv_id",
        F.struct(
            F.row_number().over(at).alias("n"),
            "role",
            "text",
            "block",
            (F.coalesce(F.sum(F.length("block").cast("long")).over(before), F.lit(0)) + F.length("block") - F.length("body") - len(CLOSE)).alias("start"),
            F.length("body").cast("long").alias("size"),
        ).alias("t"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    whole = whole.withColumn("formatted", F.array_join(F.transform("turns", lambda t: t["block"]), ""))
    spans = F.transform(
        F.filter("turns", lambda t: t["role"] == learn),
        lambda t: F.struct((t["n"] - 1).alias("block"), t["start"].alias("start"), t["size"].alias("length")),
    )
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return whole.select("conv_id", "formatted", spans.alias("loss_spans"), source.eqNullSafe(parse_chat(F.col("formatted"))).alias("round_trip"))


def blocks(formatted: Column) -> Column:
    parts = F.split(formatted, CLOSE, -1)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def parse_chat(formatted: Column) -> Column:
    """Array of (role, text) read back from rendered text."""
    return F.transform(blocks(formatted), lambda b: F.struct(parse_role(b).alias("role"), parse_text(b).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order: a span's last `length` code points of its block."""
    parts = blocks(formatted)
    return F.array_join(F.transform(spans, lambda s: unescape(F.right(F.get(parts, s["block"]), s["length"].cast("int")))), "")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(r"\### Assistant: </turn> ok").alias("text"),
    )
    chats = format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted))
    read = chats.withColumn("read", parse_chat(F.col("formatted"))).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    turns = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )
