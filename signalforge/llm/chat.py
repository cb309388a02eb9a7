"""Chat formatting by prefix-target expansion: one training example for every assistant turn.

A turn is written ``<|role|>\\ntext<|end|>\\n``. Control strings inside roles and texts are
escaped: every backslash is doubled, then one backslash is put after the first character of
each control string. A control string therefore never occurs inside an escaped text, and a
single backslash within one can only be the inserted one, so :func:`unescape` is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of this template and of two common ones.
CONTROLS = ("<|", "|>", "[INST]", "[/INST]", "<s>", "</s>")
_INSIDE = r"(?<=<)(?=\|)|(?<=\|)(?=>)|(?<=\[)(?=/?INST\])|(?<=<)(?=/?s>)"
_INSERTED = r"(?<=<)\\(?=\|)|(?<=\|)\\(?=>)|(?<=\[)\\(?=/?INST\])|(?<=<)\\(?=/?s>)"
END = "<|end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _INSIDE, r"\\")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, _INSERTED, ""), F.lit("\\\\"), F.lit("\\"))


def prefix_examples(conversations: DataFrame) -> DataFrame:
    """Explode every assistant turn into its own example; only that reply is trainable.

    Input: conv_id, turn, role, text (other columns are ignored). Turns are ordered by turn
    number, ties by role and text; a null turn number comes first; null roles and texts count
    as empty; rows with a null conv_id form one conversation. Repeated rows stay repeated.
    An empty table gives an empty result.

    Output, one row per example: conv_id, example (from 0), n_turns (turns in it), formatted,
    loss_start and loss_end (code points of ``formatted`` under the loss mask, half open).
    Turns after the last reply get a closing example whose mask is empty, so that every turn
    of a conversation can be read back from its last example.
    """
    turn = F.struct(
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    convs = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    convs = convs.select(
        "conv_id",
        F.transform("turns", lambda t: F.concat(F.lit("<|"), escape(t.role), F.lit("|>\n"))).alias("heads"),
        F.transform("turns", lambda t: escape(t.text)).alias("bodies"),
        F.filter(
            F.transform("turns", lambda t, i: F.when((t.role == "assistant") | (i == F.size("turns") - 1), i)),
            lambda i: i.isNotNull(),
        ).alias("ends"),
        F.transform("turns", lambda t: t.role == "assistant").alias("replies"),
    )
    convs = convs.withColumn(
        "rendered", F.zip_with("heads", "bodies", lambda h, b: F.concat(h, b, F.lit(END)))
    )
    rows = convs.select("*", F.posexplode("ends").alias("example", "end"))
    context = F.array_join(F.slice("rendered", F.lit(1), F.col("end")), "")
    rows = rows.select(
        "conv_id",
        "example",
        (F.col("end") + 1).cast("long").alias("n_turns"),
        context.alias("context"),
        F.get("heads", F.col("end")).alias("head"),
        F.get("bodies", F.col("end")).alias("body"),
        F.get("replies", F.col("end")).alias("reply"),
    )
    start = (F.length("context") + F.length("head")).cast("long")
    return rows.select(
        "conv_id",
        "example",
        "n_turns",
        F.concat("context", "head", "body", F.lit(END)).alias("formatted"),
        start.alias("loss_start"),
        F.when(F.col("reply"), start + F.length("body")).otherwise(start).alias("loss_end"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Digest per conversation, decoded from the formatted examples alone.

    Each example is decoded where it stands; per conversation only the replies and the turns
    of the longest example travel.
    """
    pieces = F.filter(F.split("formatted", r"<\|end\|>\n"), lambda p: p != "")
    turns = F.array_join(
        F.transform(
            pieces,
            lambda p: F.concat(
                unescape(F.regexp_extract(p, r"(?s)^<\|(.*?)\|>\n", 1)),
                F.lit("\n"),
                unescape(F.regexp_extract(p, r"(?s)^<\|.*?\|>\n(.*)$", 1)),
                F.lit("\n"),
            ),
        ),
        "",
    )
    size = (F.col("loss_end") - F.col("loss_start")).cast("int")
    decoded = examples.select(
        "conv_id",
        "example",
        "n_turns",
        F.length("formatted").cast("long").alias("chars"),
        unescape(F.substring("formatted", (F.col("loss_start") + 1).cast("int"), size)).alias("loss"),
        turns.alias("turns"),
    )
    per = decoded.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max_by("turns", "example").alias("turns"),
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x.loss), ""
        ).alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return per.select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
