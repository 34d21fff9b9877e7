"""Chat formatting with DataFrame functions only.

A conversation's turns are sorted as structs, adjacent turns of one role become one message, and messages are
concatenated: ``START role NEWLINE text [SEPARATOR text]... END NEWLINE``. Texts and roles are escaped, so that
no control string survives inside them, and the escape is reversible:

* every backslash is doubled, then ``<|`` becomes ``<\\|`` (one backslash, which a doubled original never leaves there);
* in roles a line feed becomes ``<\\n|``, by the same argument.

Cases: null text and null role count as empty; turns sort by turn (nulls first), role, text, so ties and repeated rows
have one order and every row stays a turn; a null conv_id is a conversation of its own; an empty table gives no rows;
other columns of the input are not read. A conversation is one value of its result row, so it must fit a row; work is linear in its turns
but for their sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("<\\n|"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("<\\n|"), F.lit("\n")))


def format_conversations(df: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv_id, formatted, loss_spans array<struct<at, len, byte_at, byte_len>>): places in formatted from 0, in code points and
    in bytes, one a turn of loss_role. A turn's place is a running sum over its conversation, which is dealt and sorted once."""
    given = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    placed = given.select("conv_id", F.row_number().over(ordered).alias("k"), "role", F.lag("role").over(ordered).alias("prior"), escaped(F.col("text")).alias("body"))
    opening = F.concat(F.when(F.col("k") > 1, F.lit(END + "\n")).otherwise(F.lit("")), F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    # adjacent turns of one role are one message
    headed = placed.withColumn("head", F.when(F.col("prior") == F.col("role"), F.lit(SEPARATOR)).otherwise(opening))
    before = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def places(at: str, size: str, length) -> tuple[Column, Column]:
        upto = F.sum(length("head").cast("long") + length("body")).over(before)
        return (upto - length("body")).alias(at), length("body").cast("long").alias(size)

    pieces = headed.select("conv_id", F.struct("k", "head", "body", (F.col("role") == loss_role).alias("loss"), *places("at", "len", F.length), *places("byte_at", "byte_len", F.octet_length)).alias("x"))
    grouped = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("pieces"))
    joined = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), ""), F.lit(END + "\n"))
    spans = F.transform(F.filter("pieces", lambda p: p["loss"]), lambda p: F.struct(p["at"], p["len"], p["byte_at"], p["byte_len"]))
    return grouped.select("conv_id", joined.alias("formatted"), spans.alias("loss_spans"))


def parse_conversations(df: DataFrame) -> DataFrame:
    """Adds turns array<struct<role, text>> and loss_text, both read from formatted and loss_spans alone."""

    def texts(message: Column) -> Column:
        role = unescaped_role(F.substring_index(message, "\n", 1))
        body = F.substring(message, F.length(F.substring_index(message, "\n", 1)) + F.lit(2), F.length(message))
        return F.transform(F.split(body, r"<\|im_sep\|>", -1), lambda t: F.struct(role.alias("role"), unescaped(t).alias("text")))

    # what stands after the last end of a message is empty
    messages = F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda m: m != "")
    inner = F.transform(messages, lambda m: F.substring(m, F.lit(len(START) + 1), F.length(m)))
    # bytes are cut without counting code points from the start; the transform over one element takes them once
    cut = lambda raw: F.transform("loss_spans", lambda s: unescaped(F.substring(raw, s["byte_at"].cast("int") + 1, s["byte_len"].cast("int")).cast("string")))
    loss = F.transform(F.array(F.col("formatted").cast("binary")), cut)[0]
    return df.withColumns({"turns": F.flatten(F.transform(inner, texts)), "loss_text": F.array_join(loss, "")})


def digests(df: DataFrame) -> DataFrame:
    """What parse_conversations read back, a digest row a conversation."""
    turn_text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return df.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turn_text.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
