"""Chat formatting: logs of chat events folded into final messages, then rendered. Column functions only.

Events: conv_id, seq, event ('message' opens a message, 'delta' appends to it, 'edit' replaces its text, 'regenerate'
drops its text so far), message_id, role, text. An event goes to the message last opened under its message_id in
its conversation; events of a message that was never opened are dropped. Events of equal seq are taken in the order
message, regenerate, edit, delta, then by role and text. A null text or role is empty, a null seq comes first, a null
conversation or message id is an id of its own; rows of other events are dropped; repeated rows each count. An empty table
gives none. Extra columns are dropped, texts of any length are kept whole.

Messages of a conversation are rendered in blocks of seq, so that a conversation of any length spreads over tasks; a
block is a piece of the final text and join_blocks() puts the pieces together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|newline|>"
#: Values of seq that fall in one block.
BLOCK = 512


def escape(text: Column) -> Column:
    """No result holds '<|': a backslash goes behind the '<' of each '<|', '<\\|', '<\\\\|' and so on."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, seq (of the opening event), role, text."""
    rank = F.array_position(F.array(*map(F.lit, ("message", "regenerate", "edit", "delta"))), F.col("event"))
    e = events.select("conv_id", "seq", "event", "message_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), rank.alias("_rank")).where("_rank > 0")
    order = ["seq", "_rank", "role", "text"]
    upto = lambda *keys: W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    message = ["conv_id", "message_id", "_opened"]
    e = e.withColumn("_opened", F.sum((F.col("event") == "message").cast("int")).over(upto("conv_id", "message_id"))).where("_opened > 0")
    e = e.withColumn("_version", F.sum((F.col("event") != "delta").cast("int")).over(upto(*message)))
    e = e.withColumn("_last", F.max("_version").over(W.partitionBy(*message)))
    return e.groupBy(*message).agg(
        F.min(F.when(F.col("event") == "message", F.col("seq"))).alias("seq"),
        F.max(F.when(F.col("event") == "message", F.col("role"))).alias("role"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_version") == F.col("_last"), F.struct(*order)))), lambda x: x["text"]), "").alias("text"),
    ).select("conv_id", "seq", "role", "text")


def render(messages: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each conversation and block: conv_id, block, n_turns, formatted, loss_mask (start from 0, length).

    The mask covers the escaped texts of assistant messages, in code points of the block's formatted text.
    """
    m = messages.withColumn("block", F.floor(F.coalesce("seq", F.lit(0)) / block))
    turns = m.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("seq", "role", "text"))).alias("_turns"))
    header = lambda t: F.concat(F.lit(START), F.replace(escape(t["role"]), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
    pieces = F.transform(
        "_turns",
        lambda t: F.struct(header(t).alias("header"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")),
    )
    body = lambda p: F.length(p["body"])
    ends = F.aggregate(  # start of each turn in the block
        "_pieces",
        F.array(F.lit(0)),
        lambda a, p: F.array_append(a, F.element_at(a, -1) + F.length(p["header"]) + body(p) + F.lit(len(END) + 1)),
    )
    spans = F.filter(
        F.transform("_pieces", lambda p, i: F.when(p["loss"] & (body(p) > 0), F.struct((F.get("_starts", i) + F.length(p["header"])).alias("start"), body(p).alias("length")))),
        lambda s: s.isNotNull(),
    )
    text = F.array_join(F.transform("_pieces", lambda p: F.concat(p["header"], p["body"], F.lit(f"{END}\n"))), "")
    return (
        turns.withColumn("_pieces", pieces)
        .withColumn("_starts", ends)
        .select("conv_id", "block", F.size("_turns").cast("bigint").alias("n_turns"), text.alias("formatted"), spans.alias("loss_mask"))
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted text says."""
    split = F.split(formatted, r"<\|im_start\|>")
    pieces = F.slice(split, F.lit(2), F.size(split))
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.replace(F.substring_index(p, "\n", 1), F.lit(NEWLINE), F.lit("\n"))).alias("role"),
            unescape(F.substring(p, F.locate("\n", p) + 1, F.length(p) - F.locate("\n", p) - len(END) - 1)).alias("text"),
        ),
    )


def under_mask(formatted: Column, mask: Column) -> Column:
    """The unescaped texts that the mask covers, in order."""
    return F.transform(mask, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"])))


def join_blocks(rendered: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, n_turns, formatted, and loss_mask over the whole text."""
    after = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("formatted")).over(after), F.lit(0))
    moved = rendered.withColumn("_at", at).withColumn("loss_mask", F.transform("loss_mask", lambda s: F.struct((s["start"] + F.col("_at")).alias("start"), s["length"].alias("length"))))
    blocks = F.sort_array(F.collect_list(F.struct("block", "formatted", "loss_mask")))
    return moved.groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"),
        F.array_join(F.transform(blocks, lambda b: b["formatted"]), "").alias("formatted"),
        F.flatten(F.transform(blocks, lambda b: b["loss_mask"])).alias("loss_mask"),
    )
