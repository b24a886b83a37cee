"""Chat formatting in Spark expressions only.

Turns are collected per conversation as structs and sorted, adjacent turns of
one role are merged by array functions (each block is one slice), and the blocks are concatenated:

    <s>[ROLE]user[/ROLE]first text[TURN]second text</s><s>[ROLE]assistant[/ROLE]answer</s>

Control strings inside roles and texts are replaced by short codes that start
with ``~``, and ``~`` itself by ``~0``, so no text can open or close a block and
unescaping restores every text exactly.  ``[TURN]`` keeps merged turns apart.

The loss mask lists the spans of assistant texts in the formatted string.  The
map side of the aggregation already collects the turns of each task, and only
narrow conversation rows are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.arrays import let, running, texts_at

#: Control strings of the template and their codes inside texts; the first is the escape sign.
CONTROL = [("~", "~0"), ("<s>", "~1"), ("</s>", "~2"), ("[ROLE]", "~3"), ("[/ROLE]", "~4"), ("[TURN]", "~5"),
           ("[INST]", "~6"), ("[/INST]", "~7")]
OPEN, CLOSE, ROLE, END_ROLE, TURN = "<s>", "</s>", "[ROLE]", "[/ROLE]", "[TURN]"


def escape(text: Column) -> Column:
    for raw, code in CONTROL:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for raw, code in reversed(CONTROL):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_col``, ``formatted`` and ``loss_spans``.

    ``loss_spans`` are (start, stop) in code points of ``formatted``, one per
    turn of role ``learn``, stop exclusive, without template strings.

    * Turns are sorted by turn number, equal numbers by role, then text; null
      numbers come first.  Repeated rows are turns of their own.
    * Null texts and null roles count as empty strings.
    * The null conversation is a conversation of its own.
    * Other columns are ignored, whatever their names.  Empty input: no rows.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                 F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # escaping once per turn, before any concatenation
    chats = chats.select("conv", F.transform("turns", lambda t: F.struct(
        t["role"].alias("role"), escape(t["text"]).alias("text"))).alias("turns"))

    def merged(turns: Column) -> Column:
        # a block begins where the role changes; its texts are the slice up to the next one
        places = F.sequence(F.lit(0), F.size(turns) - 1)
        new = F.filter(places, lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]))
        return let(new, lambda first: F.transform(first, lambda i, k: F.struct(
            F.get(turns, i)["role"].alias("role"),
            F.transform(F.slice(turns, i + 1, F.coalesce(F.get(first, k + 1), F.size(turns)) - i),
                        lambda t: t["text"]).alias("texts"))))

    chats = chats.select("conv", let(F.col("turns"), merged).alias("blocks"))
    # template and text pieces in order; a piece under the loss is marked
    chats = chats.select("conv", F.flatten(F.transform("blocks", lambda b: F.concat(
        F.array(F.struct(F.concat(F.lit(OPEN + ROLE), escape(b["role"]), F.lit(END_ROLE)).alias("s"),
                         F.lit(False).alias("m"))),
        F.flatten(F.transform(b["texts"], lambda t, i: F.array(
            F.struct(F.when(i > 0, TURN).otherwise("").alias("s"), F.lit(False).alias("m")),
            F.struct(t.alias("s"), (b["role"] == learn).alias("m"))))),
        F.array(F.struct(F.lit(CLOSE).alias("s"), F.lit(False).alias("m")))))).alias("pieces"))

    def placed(pieces: Column) -> Column:
        stops = running(F.transform(pieces, lambda p: F.length(p["s"])))
        at = let(stops, lambda stop: F.transform(pieces, lambda p, i: F.struct(
            F.coalesce(F.get(stop, i - 1), F.lit(0)).alias("start"), F.get(stop, i).alias("stop"), p["m"].alias("m"))))
        return F.transform(F.filter(at, lambda x: x["m"]), lambda x: F.struct(
            x["start"].alias("start"), x["stop"].alias("stop")))

    spans = let(F.col("pieces"), placed)
    return chats.select(
        F.col("conv").alias(conv_col), F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"),
        spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as (role, text), read back in order."""
    blocks = F.transform(F.regexp_extract_all(formatted, F.lit(r"(?s)<s>(.*?)</s>"), F.lit(1)), lambda b: F.struct(
        unescape(F.regexp_extract(b, r"(?s)^\[ROLE\](.*?)\[/ROLE\]", 1)).alias("role"),
        F.split(F.regexp_replace(b, r"(?s)^\[ROLE\].*?\[/ROLE\]", ""), r"\[TURN\]", -1).alias("texts")))
    return F.flatten(F.transform(blocks, lambda b: F.transform(b["texts"], lambda t: F.struct(
        b["role"].alias("role"), unescape(t).alias("text")))))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between the spans."""
    return F.array_join(F.transform(texts_at(formatted, spans), unescape), "")
