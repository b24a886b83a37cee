"""Rows with very many elements: results against plain Python, and no quadratic time."""

from __future__ import annotations

import time
from itertools import accumulate

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabsmith.llm import arrays, chat, secrets
from tests.llm.test_operators import spans_brute

SIZES = [0, 1, 2, arrays.BLOCK - 1, arrays.BLOCK, arrays.BLOCK + 1, 3 * arrays.BLOCK, 1000]


def test_running(spark):
    rows = [(n, [(i * 7919) % 13 for i in range(n)]) for n in SIZES]
    out = spark.createDataFrame(rows, "n int, v array<int>").select(
        "n", arrays.running(F.col("v")).alias("s"), arrays.running(F.col("v"), F.greatest).alias("m"))
    got = {r.n: (r.s, r.m) for r in out.collect()}
    assert got == {n: (list(accumulate(v)), list(accumulate(v, max))) for n, v in rows}


def test_texts_at(spark):
    text = "aé𝄞\n" * 2000
    rows = [(n, [(7 * i, 7 * i + i % 8) for i in range(n)]) for n in SIZES]
    out = spark.createDataFrame(rows, "n int, v array<struct<start:int,stop:int>>").select(
        "n", arrays.texts_at(F.lit(text), F.col("v")).alias("t"))
    assert {r.n: r.t for r in out.collect()} == {n: [text[a:b] for a, b in v] for n, v in rows}


def redact_brute(text: str) -> str:
    out, at, until = [], 0, -1
    for _, a, b in spans_brute(text):
        if a > until:
            out.append(text[at:a] + "[SECRET]")
        until = max(until, b)
        at = until
    return "".join(out) + text[at:]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from([
    "token=abcdef", "password: \"token=abcdef\"", "0" * 24, "AKIA" + "B" * 16, "user=bob", "https://x.y/z", "é", " ", "\n",
    "\n\n", "aB3" * 8, "secret=", "AKIA" + "0a" * 14]), max_size=14).map("".join), min_size=1, max_size=40))
def test_redact_brute(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in secrets.redact(docs).collect()} == {
        i: redact_brute(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("unit", ["token=abcdef ", "user=alice token=abcdef\n\n"])
def test_text_with_very_many_secrets(spark, unit):
    """40,000 hits, then as many paragraphs, in one text; far over the limit before."""
    text = unit * 40_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    spans = secrets.scan_secrets(docs).collect()[0].spans
    clean = secrets.redact(docs).collect()[0].text
    assert time.time() - began < 60
    at = unit.index("token")
    own = [("ident", 0, 10)] if at else []
    want = [(k, i * len(unit) + a, i * len(unit) + b) for i in range(40_000)
            for k, a, b in own + [("assign", at, at + 12)]]
    assert [tuple(s) for s in spans] == want
    assert clean == unit.replace("user=alice", "[SECRET]").replace("token=abcdef", "[SECRET]") * 40_000


@pytest.mark.parametrize("roles", [("user", "assistant"), ("assistant",)])
def test_conversation_with_very_many_turns(spark, roles):
    """32,000 turns, one block each or all one block; 68 s before in the last review."""
    n = 32_000
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.get(
        F.array(*map(F.lit, roles)), (F.col("id") % len(roles)).cast("int")).alias("role"),
        F.concat(F.lit("~<s>é "), F.col("id")).alias("text"))
    began = time.time()
    row = chat.format_chats(turns).select(
        chat.read_turns(F.col("formatted")).alias("t"),
        chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()[0]
    assert time.time() - began < 60
    said = [(roles[i % len(roles)], f"~<s>é {i}") for i in range(n)]
    assert [tuple(t) for t in row.t] == said
    assert row.loss == "".join(t for r, t in said if r == "assistant")
