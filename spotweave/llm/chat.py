"""Conversations as training examples: each assistant turn with all turns before it, only that reply trainable.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a backslash is doubled and ``<|`` becomes
``<\\|`` (in roles a line feed becomes ``\\n``), so no control string can occur there, and reading back undoes it.

Turns are ordered by ``turn``, then role and text (nulls first); null roles and texts are empty. Repeated rows are repeated
turns. A conversation that does not end with an assistant turn gets one more example with all its turns and nothing
trainable, so that every turn is in the output. A conversation is one row, as each of its examples has to be one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    """Pairs of backslashes are taken from the left, so that a doubled one never joins the next escape."""
    plain = F.transform(F.split(text, r"\\\\", -1), lambda part: F.replace(F.replace(part, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|")))
    return F.array_join(plain, "\\")


def format_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``target`` (place of the last turn, from 1), ``formatted``, ``loss_start`` (from 1) and ``loss_chars``.

    The mask is the span of the reply inside ``formatted``; ``loss_chars`` is 0 and ``loss_start`` null where nothing is trained.
    """
    clean = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("said"))
    whole = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    role = lambda x: F.replace(_escaped(x["role"]), F.lit("\n"), F.lit("\\n"))
    parts = F.transform("said", lambda x: F.struct(
        F.concat(F.lit(START), role(x), F.lit("\n")).alias("head"), _escaped(x["text"]).alias("text"), (x["role"] == TRAINED_ROLE).alias("trained")))
    targets = F.filter(F.sequence(F.lit(1), F.size("parts")), lambda i: F.element_at("parts", i)["trained"] | (i == F.size("parts")))
    examples = whole.select("conv_id", parts.alias("parts")).select("conv_id", "parts", F.explode(targets).alias("target"))
    own = F.element_at("parts", F.col("target"))
    before = F.transform(F.slice("parts", 1, F.col("target") - 1), lambda x: F.concat(x["head"], x["text"], F.lit(END + "\n")))
    built = examples.select("conv_id", "target", F.concat(F.array_join(before, ""), own["head"]).alias("context"), own["text"].alias("reply"), own["trained"].alias("trained"))
    return built.select(
        "conv_id", "target", F.concat("context", "reply", F.lit(END + "\n")).alias("formatted"),
        F.when(F.col("trained"), F.length("context") + 1).alias("loss_start"), F.when(F.col("trained"), F.length("reply")).otherwise(0).alias("loss_chars"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text as an array of (role, text)."""
    parts = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda part: part != "")
    body = lambda part: F.substring(part, F.lit(1), F.length(part) - len(END) - 1)
    role = lambda part: F.substring_index(body(part), "\n", 1)
    return F.transform(parts, lambda part: F.struct(unescaped(role(part)).alias("role"), unescaped(F.substring(body(part), F.length(role(part)) + 2, F.length(part))).alias("text")))


def conversation_digests(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation hold, read back from their texts and masks."""
    read = examples.withColumn("trained", F.when(F.col("loss_start").isNotNull(), unescaped(F.expr("substring(formatted, loss_start, loss_chars)"))))
    whole = read.groupBy("conv_id").agg(
        F.max_by("formatted", "target").alias("formatted"), F.sum(F.length("formatted")).alias("formatted_chars"),
        F.sort_array(F.collect_list(F.when(F.col("trained").isNotNull(), F.struct("target", "trained")))).alias("trained"))
    turns = whole.withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", F.array_join(F.col("trained.trained"), ""))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"))
