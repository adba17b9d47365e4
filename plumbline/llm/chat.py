"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs, sorted by turn (ties: role, then
text), adjacent turns of one role are merged into a block, and the blocks are
concatenated. A block is

    <|im_start|>ROLE<|im_sep|>TEXT<|im_sep|>TEXT<|im_end|>

with one TEXT per merged turn, so the turns can be read back. Control strings inside
roles and texts are escaped: a backslash is doubled, and a backslash goes behind the first
character of anything that looks like a control string (``<|name|>``, ``<s>``, ``</s>``,
``[INST]``, ``[/INST]``, ``<<SYS>>``, ``<</SYS>>``), so none is left whole.

The loss mask covers the texts of assistant turns: the output is an array of segments
(text, loss) whose concatenation is the formatted text.

A conversation is one training example and becomes one row, so its turns meet in one
task. Turns are packed into lists before the shuffle, and all work on a list is linear in
its length. Defined cases: null texts and roles are empty; a null conv_id is a
conversation of its own; repeated rows are turns of their own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = r"([<\[])(\|[A-Za-z0-9_]*\|>|/?s>|</?SYS>>|/?INST\])"
LEARNED_ROLE = "assistant"


def escape(column):
    doubled = F.replace(column, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, CONTROL, r"$1\\$2")


def unescape(column):
    return F.regexp_replace(column, r"(?s)\\(.)", "$1")


def _segment(text, loss):
    return F.struct(text.alias("text"), loss.alias("loss"))


def _block_segments(block):
    """Header, texts with separators between them, end mark."""
    loss = block["role"] == LEARNED_ROLE
    no = F.lit(False)
    texts = F.flatten(
        F.transform(
            block["texts"],
            lambda t, i: F.when(i == 0, F.array(_segment(escape(t), loss))).otherwise(
                F.array(_segment(F.lit(SEP), no), _segment(escape(t), loss))
            ),
        )
    )
    head = F.concat(F.lit(START), escape(block["role"]), F.lit(SEP))
    return F.concat(F.array(_segment(head, no)), texts, F.array(_segment(F.lit(END), no)))


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: (conv_id, n_blocks, segments, formatted)."""
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("item"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    begins = sorted_turns.withColumn(
        "begins",
        F.filter(
            F.sequence(F.lit(0), F.size("items") - 1),
            lambda i: (i == 0)
            | (F.get(F.col("items"), i)["role"] != F.get(F.col("items"), i - 1)["role"]),
        ),
    )
    blocks = begins.withColumn(
        "blocks",
        F.transform(
            "begins",
            lambda b, k: F.struct(
                F.get(F.col("items"), b)["role"].alias("role"),
                F.transform(
                    F.slice(
                        F.col("items"),
                        b + 1,
                        F.coalesce(F.get(F.col("begins"), k + 1), F.size("items")) - b,
                    ),
                    lambda x: x["text"],
                ).alias("texts"),
            ),
        ),
    )
    marked = blocks.select(
        "conv_id",
        F.size("blocks").cast("long").alias("n_blocks"),
        F.flatten(F.transform("blocks", _block_segments)).alias("segments"),
    )
    return marked.withColumn(
        "formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns and the masked text, taken from the output: (conv_id, turns, loss_texts)."""
    def turns_of(block):
        parts = F.split(F.substr(block, F.lit(len(START) + 1)), r"<\|im_sep\|>")
        role = unescape(F.get(parts, F.lit(0)))
        return F.transform(
            F.slice(parts, F.lit(2), F.size(parts) - 1),
            lambda t: F.struct(role.alias("role"), unescape(t).alias("text")),
        )

    blocks = F.filter(F.split("formatted", r"<\|im_end\|>"), lambda b: b != "")
    return formatted.withColumn("turns", F.flatten(F.transform(blocks, turns_of))).withColumn(
        "loss_texts",
        F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what ``read_back`` finds."""
    back = read_back(formatted)
    loss = F.array_join("loss_texts", "")
    turns = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "n_blocks",
    )
