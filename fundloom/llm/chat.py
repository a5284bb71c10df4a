"""Chat formatting by prefix-target expansion.

Each assistant turn becomes an example of its own: all turns before it are context, only its text is under the loss
mask. A conversation that does not end in an assistant turn also gives one example without a target, so that no turn
is lost. Turns are marked as ``<|turn|>role\\n`` text ``<|end|>\\n``; the backslash, ``<`` and (in roles) the newline are
escaped inside texts, so control strings found there stay text and come back unchanged. Native expressions throughout.

Nulls and edge cases: a null text or role is empty; turns with equal numbers go by role, then text; repeated rows are
turns of their own; null turn numbers come first; rows with a null ``conv_id`` form one conversation; a conversation
without assistant turns has an empty loss; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TURN, END = "<|turn|>", "<|end|>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def chat_examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example (the number of its last turn, from 1), text, loss_start and loss_end (code points of ``text``)."""
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("body"))
    head = F.concat(F.lit(TURN), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    turns = turns.withColumn("head", head).withColumn("segment", F.concat("head", escaped(F.col("body")), F.lit(END)))
    by = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = turns.select(
        "conv_id", "role", "head", "segment",
        F.row_number().over(by).alias("example"),
        F.lead(F.lit(1)).over(by).isNull().alias("last"),
        F.sum(F.char_length("segment")).over(upto).alias("end"),
        F.collect_list("segment").over(upto).alias("segments"),
    ).where((F.col("role") == "assistant") | F.col("last"))
    start = F.col("end") - F.char_length("segment") + F.char_length("head")
    target = F.col("role") == "assistant"
    return seen.select(
        "conv_id", "example", F.array_join("segments", "").alias("text"),
        F.when(target, start).otherwise(F.col("end")).alias("loss_start"),
        F.when(target, F.col("end") - len(END)).otherwise(F.col("end")).alias("loss_end"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation what the examples hold: turns from the longest one, loss text from all of them in order."""
    loss = unescaped(F.expr("substring(text, cast(loss_start as int) + 1, cast(loss_end - loss_start as int))"))
    held = examples.select("conv_id", "example", "text", loss.alias("loss"), F.char_length("text").alias("chars"))
    whole = held.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("text"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    turn = r"(?s)<\|turn\|>([^\n]*)\n([^<]*)<\|end\|>\n"
    parsed = whole.withColumn("turns", F.arrays_zip(F.regexp_extract_all("text", F.lit(turn), F.lit(1)).alias("role"), F.regexp_extract_all("text", F.lit(turn), F.lit(2)).alias("body")))
    told = F.array_join(F.transform("turns", lambda x: F.concat(unescaped(x["role"]), F.lit("\n"), unescaped(x["body"]), F.lit("\n"))), "")
    return parsed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
