"""Conversations as training text, with DataFrame functions only.

A turn's content is a list of typed parts.  A visitor flattens them in order: a text is
escaped, any other part becomes a placeholder, and its reference, place and number of tokens
after expansion are recorded.  A part of an unknown or null kind becomes ``<other>``, one token a unit.  Turns are written as::

    <turn ROLE>BODY</turn>\\n

Within texts ``\\`` is written ``\\b`` and ``<`` is written ``\\l``; in roles ``>`` is also written
``\\g``.  So no text can hold a control string, and ``unescaped`` gets every text back.  The loss
mask lists the places of the assistant bodies.

Turns are ordered by turn, then role, then content.  Null text and null role are empty; a null id is
a conversation of its own.  Repeated rows are turns of their own.  Columns other than those
named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens that one unit of a part takes up: a tile of an image, a second of audio, a page of a document.
TOKENS = {"image": 256, "audio": 25, "document": 500}
OTHER = "other"
PART = "struct<kind: string, text: string, ref: string, units: bigint>"
OPEN, CLOSE = "<turn ", "</turn>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    plain = F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<"))
    return F.replace(plain, F.lit("\\b"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """Content of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"),
                            F.lit(0).cast("long").alias("units")))


def visit(part: Column) -> Column:
    """What a part becomes in the body."""
    out = F.when(part["kind"] == "text", escaped(F.coalesce(part["text"], F.lit(""))))
    for kind in TOKENS:
        out = out.when(part["kind"] == kind, F.lit(f"<{kind}>"))
    return out.otherwise(f"<{OTHER}>")


def expanded(part: Column) -> Column:
    units = F.coalesce(part["units"], F.lit(1).cast("long"))
    out = F.when(part["kind"] == "text", F.lit(0).cast("long"))
    for kind, tokens in TOKENS.items():
        out = out.when(part["kind"] == kind, units * tokens)
    return out.otherwise(units)


def format_conversations(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content: Column | None = None,
) -> DataFrame:
    """``(conv_id, n_turns, formatted, loss, attachments, n_attachment_tokens)`` for each conversation.

    ``content``: array of parts (``PART``); by default the column ``text``.  ``loss``: places (start from 0, length) of
    assistant bodies, in characters.  ``attachments``: kind, reference, tokens, and place of each placeholder.
    """
    parts = content if content is not None else text_part(F.col("text"))
    turns = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"),
                        F.coalesce(parts, F.array().cast(f"array<{PART}>")).alias("parts"))
    turns = turns.withColumn("shown", F.transform("parts", visit))
    turns = turns.select("conv_id", "turn", "role", "parts", "shown", F.array_join("shown", "").alias("body"))
    turns = turns.withColumn("head", F.concat(F.lit(OPEN), F.replace(escaped(F.col("role")), F.lit(">"), F.lit("\\g")), F.lit(">")))
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumns({
        "at": F.row_number().over(order), "start": F.coalesce(F.sum(F.char_length("piece")).over(before), F.lit(0).cast("long"))})
    body_at = F.col("start") + F.char_length("head")
    sizes = F.transform("shown", lambda s: F.char_length(s).cast("long"))
    zero = F.array(F.lit(0).cast("long"))
    starts = F.aggregate(sizes, zero, lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    marks = F.filter(
        F.transform(F.arrays_zip("parts", F.slice(starts, F.lit(1), F.size("parts")).alias("starts")), lambda z: F.struct(
            F.coalesce(z["parts"]["kind"], F.lit(OTHER)).alias("kind"), z["parts"]["ref"].alias("ref"), expanded(z["parts"]).alias("tokens"),
            (body_at + z["starts"]).alias("start"))),
        lambda a: a["kind"] != "text")
    turn = F.struct("at", "piece", body_at.alias("start"), F.char_length("body").cast("long").alias("length"), "role", marks.alias("marks"))
    gathered = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    spoken = F.filter("t", lambda t: t["role"] == "assistant")
    attached = F.flatten(F.transform("t", lambda t: t["marks"]))
    return gathered.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda t: t["piece"]), "").alias("formatted"),
        F.transform(spoken, lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss"),
        attached.alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("n_attachment_tokens"))


def read_back(formatted: Column) -> Column:
    """Turns ``(role, text)`` of a formatted conversation."""
    pieces = F.filter(F.split(formatted, CLOSE, -1), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        unescaped(F.substring_index(F.substring(p, len(OPEN) + 1, 1 << 30), ">", 1)).alias("role"),
        unescaped(F.substring(p, F.instr(p, ">") + 1, F.lit(1 << 30))).alias("text")))


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescaped(
        F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
