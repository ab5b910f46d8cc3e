"""Operator 2, chat formatting with prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context, and only that reply is trainable.
A conversation that does not end with an assistant gets one more example without a trainable part, so that no turn is
lost. A turn is written ``<|turn|>role<|text|>text<|end|>``. Control strings inside roles and texts are escaped: where
``<`` or ``[`` and any number of backslashes stand before the rest of one, one backslash more is put between; reading
back takes it away. So no control string, of this template or of the usual others, is ever part of a text, and nothing
is ambiguous.

Rows: a null text or role counts as empty; turns go by ``turn`` (nulls first), repeated rows and ties of a turn all stay,
ordered by role and text; a null conv_id is a conversation of its own; an empty table gives an empty result; other input
columns are not read. A conversation is put together in one task, as its last example needs all of it; examples are made
row by row from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: The rests of control strings behind their first character: this template's and other templates'.
_RESTS = r"\||/?s>|/?SYS>|unk>|pad>|bos>|eos>|mask>|/?INST\]|/?AVAILABLE_TOOLS\]|/?TOOL_|start_of_turn>|end_of_turn>|\x{FF5C}"
_ESCAPE = rf"([<\[])(\\*)(?={_RESTS})"
_UNESCAPE = rf"([<\[])\\(\\*)(?={_RESTS})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1$2\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2")


def format_examples(turns: DataFrame, trainable_role: str = "assistant") -> DataFrame:
    """(conv_id, example, n_turns, formatted, loss_start, loss_end): places are code points, the trainable part may be empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(F.col("turn"), role.alias("role"), text.alias("text"))
    talk = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    # what stands before the text, the text, and whether it is to be learned
    parts = F.transform("turns", lambda t: F.struct(F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)).alias("head"), escape(t["text"]).alias("text"), (t["role"] == trainable_role).alias("learn")))
    talk = talk.select("conv_id", parts.alias("parts"))
    last = F.size("parts")
    ends = F.filter(F.sequence(F.lit(1), last), lambda i: (i == last) | F.element_at("parts", i)["learn"])
    examples = talk.select("conv_id", "parts", F.posexplode(ends).alias("example", "n_turns"))
    whole = F.array_join(F.transform(F.slice("parts", F.lit(1), F.col("n_turns")), lambda p: F.concat(p["head"], p["text"], F.lit(END))), "")
    final = F.element_at("parts", F.col("n_turns"))
    examples = examples.select("conv_id", "example", "n_turns", whole.alias("formatted"), final["learn"].alias("learn"), F.length(final["text"]).alias("size"))
    end = F.length("formatted") - len(END)
    return examples.select("conv_id", "example", "n_turns", "formatted", F.when(F.col("learn"), end - F.col("size")).otherwise(0).cast("long").alias("loss_start"), F.when(F.col("learn"), end).otherwise(0).cast("long").alias("loss_end"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted example, array<struct<role, text>>, unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>", -1), lambda x: x != "")
    return F.transform(pieces, lambda x: F.struct(unescape(F.substring_index(F.substring_index(x, TEXT, 1), TURN, -1)).alias("role"), unescape(F.substring_index(x, TEXT, -1)).alias("text")))


def read_loss(formatted: Column, start: Column, end: Column) -> Column:
    """The trainable text of an example, unescaped."""
    return unescape(F.substring(formatted, start.cast("int") + 1, (end - start).cast("int")))


def digest(examples: DataFrame) -> DataFrame:
    """One row a conversation, read back from its examples: turns from the longest, trainable texts from each."""
    loss = F.struct("example", read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"))
    read = examples.select("conv_id", "n_turns", "formatted", loss.alias("loss"), F.length("formatted").cast("long").alias("chars"))
    one = read.groupBy("conv_id").agg(F.max_by("formatted", "n_turns").alias("formatted"), F.array_sort(F.collect_list("loss")).alias("loss"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_examples"))
    turns = read_turns(F.col("formatted"))
    one = one.select("conv_id", turns.alias("turns"), F.array_join(F.transform("loss", lambda x: x["loss"]), "").alias("loss"), "formatted_chars", "n_examples")
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return one.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")
