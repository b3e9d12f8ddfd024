"""Chat formatting: prefix-target expansion over a marked, reversible template (native).

A turn is rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts ``&`` becomes
``&amp;`` and ``<|`` becomes ``&lt;|`` (in roles also a line break ``&nl;``), so no text can hold a
control string, and undoing the escapes gives the text back exactly.

Every assistant turn becomes an example of its own: all turns before it as context, and only that
reply's body under the loss mask (``loss_start`` to ``loss_end``, code points of ``text``, end
exclusive). A conversation that does not end with an assistant turn also yields one example without
a target (``trainable`` false, an empty mask), so its last turns are in the output too. The examples
of a conversation of T turns hold O(T^2) text; that is what the expansion is.

Defined results: null role or text counts as empty; turns are ordered by (turn, role, text), null
turns first, so repeated rows stay and ties are fixed; a null conversation id is a conversation of
its own; no conversations give no examples. Only the four named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TARGET_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&nl;"), F.lit("\n")), F.lit("&lt;|"), F.lit("<|")),
                     F.lit("&amp;"), F.lit("&"))


def _head(role: Column) -> Column:
    return F.concat(F.lit(START), F.replace(escape(role), F.lit("\n"), F.lit("&nl;")), F.lit("\n"))


def render(role: Column, text: Column) -> Column:
    return F.concat(_head(role), escape(text), F.lit(END + "\n"))


def prefix_target_examples(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn",
                           role: str = "role", text: str = "text") -> DataFrame:
    """One row per example: conv_id, target (1-based turn), trainable, text, loss_start, loss_end."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    turns = conversations.select(F.col(conv).alias("conv_id"), F.struct(
        F.col(turn).alias("turn"), r.alias("role"), t.alias("text")).alias("one"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    whole = whole.select(
        "conv_id", F.transform("turns", lambda x: x["role"]).alias("roles"),
        F.transform("turns", lambda x: render(x["role"], x["text"])).alias("parts"),
        F.transform("turns", lambda x: F.length(_head(x["role"]))).alias("heads"))
    n = F.size("roles")
    targets = F.filter(F.sequence(F.lit(1), n), lambda i: (F.get("roles", i - 1) == TARGET_ROLE) | (i == n))
    examples = whole.select("*", F.explode(targets).alias("target"))
    trainable = F.get("roles", F.col("target") - 1) == TARGET_ROLE
    examples = examples.select(
        "conv_id", "target", trainable.alias("trainable"),
        F.array_join(F.slice("parts", 1, F.col("target")), "").alias("text"),
        F.length(F.get("parts", F.col("target") - 1)).alias("last"),
        F.get("heads", F.col("target") - 1).alias("head"))
    start = F.length("text") - F.col("last") + F.col("head")
    stop = F.length("text") - F.lit(len(END) + 1)
    return examples.select(
        "conv_id", "target", "trainable", "text",
        start.cast("long").alias("loss_start"),
        F.when(F.col("trainable"), stop).otherwise(start).cast("long").alias("loss_end"))


def parse(text: Column) -> Column:
    """The turns of a formatted text: array<struct<role, text>>, unescaped."""
    chunks = F.split(text, r"<\|im_end\|>\n")
    chunks = F.slice(chunks, 1, F.greatest(F.size(chunks) - 1, F.lit(0)))

    def turn(c):
        role = F.substring_index(c, "\n", 1)
        return F.struct(unescape(F.substr(role, F.lit(len(START) + 1))).alias("role"),
                        unescape(F.substr(c, F.length(role) + 2)).alias("text"))
    return F.transform(chunks, turn)


def masked(text: Column, start: Column, stop: Column) -> Column:
    """The text under an example's loss mask, unescaped."""
    return unescape(F.substr(text, (start + 1).cast("int"), (stop - start).cast("int")))


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from its examples alone: turns and masked texts, digested."""
    per = examples.withColumn("body", masked(F.col("text"), F.col("loss_start"), F.col("loss_end")))
    per = per.groupBy("conv_id").agg(
        F.max_by("text", "target").alias("full"),
        F.sort_array(F.collect_list(F.struct("target", "body"))).alias("bodies"),
        F.sum(F.length("text")).alias("formatted_chars"),
        F.count_if("trainable").alias("n_examples"))
    per = per.select("*", parse(F.col("full")).alias("turns"),
                     F.array_join(F.transform("bodies", lambda b: b["body"]), "").alias("loss"))
    lines = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    return per.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
        F.col("n_examples").cast("long").alias("n_examples"))
