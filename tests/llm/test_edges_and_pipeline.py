"""Nulls, empty and long texts, repeated rows, empty tables, clashing columns; the pipeline's stages."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabsmith.llm import bpe, chat, linecrf, nnpu, partenum, quartile, secrets
from tabsmith.llm.binpack import best_fit
from tabsmith.llm.hostrules import host_quality
from tests.conftest import SF_MID, SF_SMALL
from tests.llm.test_operators import components_brute, rows_of, rules_brute, spans_brute

EDGE = [(1, "some words of text " * 8, "en", "s", 5), (1, "some words of text " * 8, "en", "s", 5), (2, None, None, None, None),
        (None, "", "en", "s", 0), (3, "long word " * 30_000, "fr", "s", 1), (4, "x" * 50_000, None, "t", 2),
        (1, "another text under the same id", "en", "t", 3)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["id", "n", "sid", "row", "key", "parts", "spans", "ids", "score", "held_out", "predicted", "kept", "n_words",
         "base_failed", "range", "fp", "component_id", "bin_id", "host", "sig", "ends", "linked", "body", "decoded"]


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, 1), (3, None, None), (1, 1, 0)],
                                 "doc_id long, quality int, toxic int")


def operators(spark):
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    return {
        "bpe": lambda d: bpe.decode(bpe.encode(d, path), path),
        "secrets": secrets.scan_secrets, "redact": secrets.redact,
        "toxicity": lambda d: nnpu.toxicity(d, labels(spark)), "quality": lambda d: linecrf.quality(d, labels(spark)),
        "fingerprints": quartile.edited_fingerprints, "join": partenum.ngram_jaccard_join, "pack": best_fit,
        "rules": host_quality}


def clashing(df):
    return df.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASH))


@pytest.mark.parametrize("name", ["bpe", "secrets", "redact", "toxicity", "quality", "fingerprints", "join", "pack", "rules"])
def test_edge_rows(spark, name):
    run = operators(spark)[name]
    docs = spark.createDataFrame(EDGE, SCHEMA)
    # the long text is cut into several pieces by packing: 60,000 words in sequences of 4,096
    want = len(EDGE) + (14 if name == "pack" else 0)
    assert len(run(clashing(docs)).collect()) == want
    assert run(clashing(docs).limit(0)).collect() == []


def test_edge_results(spark):
    docs = spark.createDataFrame(EDGE, SCHEMA)
    ids = [tuple(r) for r in partenum.ngram_jaccard_join(docs).collect()]
    # 32 words that repeat every four make 4 shingles; six words make 3
    assert sorted(r for r in ids if r[0] == 1) == [(1, 3, 1), (1, 4, 1), (1, 4, 1)]
    assert (2, 0, 2) in ids and (None, 0, None) in ids
    spans = secrets.scan_secrets(docs).collect()
    assert all(r.spans == [] for r in spans)
    chats = spark.createDataFrame([(None, None, None, None), (1, 1, "user", "a"), (1, 1, "user", "a")],
                                  "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.formatted for r in chat.format_chats(clashing(chats)).collect()}
    assert got == {None: "<s>[ROLE][/ROLE]</s>", 1: "<s>[ROLE]user[/ROLE]a[TURN]a</s>"}
    assert chat.format_chats(chats.limit(0)).collect() == []


def test_secrets_without_white_space(spark):
    """Digits of a key may not borrow letters outside it, and long texts without white space take linear time."""
    texts = ["user=alice ABCDEFGHIJ0123456789,foo", "user=alice abcdefghij0123456789,FOO", "7," * 400_000,
             "7," * 400_000 + "user=alice,abC1defghijklmnopqrstu9"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    start = time.monotonic()
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.scan_secrets(docs).collect()}
    assert time.monotonic() - start < 60
    assert got == {0: [], 1: [], 2: [], 3: [("ident", 800_000, 800_010), ("key", 800_011, 800_034)]}
    assert all(got[i] == spans_brute(t) for i, t in enumerate(texts))


def test_stage_edges(spark):
    docs = spark.createDataFrame(EDGE, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_SMALL)
        if name != "best-fit packing":
            assert out.columns == docs.columns
        out.collect()
        assert stage(spark, docs.limit(0), SF_SMALL).collect() == []
    # rows alike in id and text leave one, a shared id with another text stays
    left = corpus_pipeline.near_duplicates(spark, docs, SF_SMALL).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == sorted({(r[0] or 0, r[1] or "") for r in EDGE})


def test_pipeline_stages_brute(spark):
    """Each stage against brute force on its own input."""
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    kept = {r.doc_id: r.text for r in corpus_pipeline.quality_rules(spark, docs, SF_MID).collect()}
    rows = dict(rows_of(SF_MID))
    assert set(kept) == {k for k, t in rows.items() if not rules_brute(t)[-1]}
    small = docs.filter(F.col("doc_id").isin(sorted(kept)[:300]))
    texts = [rows[k] for k in sorted(kept)[:300]]
    groups = components_brute(texts, 5, 80)
    left = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, small, SF_MID).collect()}
    assert left == {sorted(kept)[i] for i, (_, c) in enumerate(groups) if i == c}
    for r in corpus_pipeline.secret_scan(spark, docs, SF_MID).collect():
        want, at = "", 0
        for _, a, b in spans_brute(rows[r.doc_id]):
            if a >= at:
                want += rows[r.doc_id][at:a] + "[SECRET]"
            at = max(at, b)
        assert r.text == want + rows[r.doc_id][at:] and r.n_chars == len(r.text)


def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.count() > 0 and corpus_pipeline.ORACLE_SQL is None
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "toxicity", "n-gram Jaccard join", "secret scans", "best-fit packing"]
