"""Chat formatting as one relational plan of Spark expressions.

Turn structs are collected and sorted per conversation, adjacent turns of one
role are merged by an array aggregation, and the blocks are concatenated:

    <|im_start|>role<|im_sep|>text<|im_end|>\n
    <|im_start|>role<|im_sep|>text<|im_turn|>text of the next turn<|im_end|>\n   (merged)

Inside texts and roles every ``<|`` is written ``<||``, so no text can contain
a control string, and reading back is exact: ``<||`` becomes ``<|``.

Defined cases: null text is empty; null role is empty; turns are ordered by
turn (null first), ties by role, then text; repeated rows are turns of their
own; rows of a null conv_id are one conversation.  A conversation is one output
row, so it must fit into a task's memory; no other rows meet in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, TURN, END = "<|im_start|>", "<|im_sep|>", "<|im_turn|>", "<|im_end|>\n"
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``loss`` (spans of
    ``formatted`` to learn from: start, length in code points; the texts of the
    assistant's turns, without the marks between them)."""
    clean = lambda c: escape(F.coalesce(F.col(f"`{c}`"), F.lit("")))
    one = F.struct(F.col(f"`{turn}`").alias("turn"), clean(role).alias("role"), clean(text).alias("text"))
    sorted_turns = F.array_sort(F.collect_list(one))
    block = "struct<role:string,texts:array<string>>"
    state = f"struct<done:array<{block}>,role:string,texts:array<string>>"
    flush = lambda s: F.when(s["texts"].isNull(), s["done"]).otherwise(
        F.concat(s["done"], F.array(F.struct(s["role"].alias("role"), s["texts"].alias("texts")))))

    def step(s: Column, t: Column) -> Column:
        same = s["texts"].isNotNull() & (s["role"] == t["role"])
        return F.when(same, F.struct(s["done"].alias("done"), s["role"].alias("role"),
                                     F.concat(s["texts"], F.array(t["text"])).alias("texts"))) \
            .otherwise(F.struct(flush(s).alias("done"), t["role"].alias("role"), F.array(t["text"]).alias("texts")))

    start = F.expr(f"cast(named_struct('done', array(), 'role', null, 'texts', null) as {state})")
    blocks = turns.groupBy(F.col(f"`{conv_id}`").alias("conv_id")).agg(sorted_turns.alias("turns")) \
        .select("conv_id", F.aggregate("turns", start, step, flush).alias("blocks"))
    written = F.transform("blocks", lambda b: F.concat(F.lit(START), b["role"], F.lit(SEP),
                                                        F.array_join(b["texts"], TURN), F.lit(END)))

    # where each block begins, then where each of its texts does
    def spans(s: Column, b: Column) -> Column:
        head = s["at"] + len(START) + F.length(b["role"]) + len(SEP)
        inner = F.aggregate(
            b["texts"], F.struct(head.alias("at"), s["spans"].alias("spans")),
            lambda q, t: F.struct(
                (q["at"] + F.length(t) + len(TURN)).alias("at"),
                F.when(b["role"] == LEARNED_ROLE, F.concat(q["spans"], F.array(
                    F.struct(q["at"].alias("start"), F.length(t).alias("length"))))).otherwise(q["spans"]).alias("spans")))
        return F.struct((inner["at"] - len(TURN) + len(END)).alias("at"), inner["spans"].alias("spans"))

    zero = F.expr("cast(named_struct('at', 0, 'spans', array()) as struct<at:int,spans:array<struct<start:int,length:int>>>)")
    return blocks.select("conv_id", F.array_join(written, "").alias("formatted"),
                         F.aggregate("blocks", zero, spans, lambda s: s["spans"]).alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of ``role, text``."""
    rows = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)

    def turns_of(b: Column) -> Column:
        # a block is role, separator, texts, end mark
        parts = F.split(F.substring(b, F.lit(1), F.length(b) - len(END)), r"<\|im_sep\|>")
        return F.transform(F.split(parts[1], r"<\|im_turn\|>"),
                           lambda t: F.struct(unescape(parts[0]).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(rows, turns_of))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
