"""Operators of the subpackage against brute force, round trips and held-out labels."""

from __future__ import annotations

import hashlib
import io
import re
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabsmith.llm import bpe, chat, linecrf, nnpu, partenum, quartile, secrets, textops, warc
from tabsmith.llm.binpack import CAPACITIES, best_fit, pack
from tabsmith.llm.hostrules import host_quality, host_verdicts, reject_by_rules
from tabsmith.llm.queries import REGISTRY
from tabsmith.session import written
from tests.conftest import SF_MID, SF_SMALL
from tests.oracle_harness import compare, duck

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def rows_of(sf: str, table: str = "documents", columns: str = "doc_id, text"):
    return duckdb.sql(f"SELECT {columns} FROM read_parquet('{sf}/{table}.parquet')").fetchall()


@pytest.mark.parametrize("name", [n for n, (_, sql) in REGISTRY.items() if sql])
def test_oracle(spark, name):
    info = compare(spark, duck(SF_MID), name, *REGISTRY[name], SF_MID)
    assert info["schema"] and info["values"], info


# ------------------------------------------------------------------ 1 BPE
@pytest.fixture(scope="module")
def tokenizer_path():
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def library(path):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def test_bpe_equals_library(spark, tokenizer_path):
    lib = library(tokenizer_path)
    got = {r.doc_id: r for r in REGISTRY["op1_bpe_lexicon"][0](spark, SF_SMALL).collect()}
    for key, text in rows_of(SF_SMALL):
        ids = lib.encode(text or "", add_special_tokens=False).ids
        assert got[key].n_tokens == len(ids)
        assert got[key].ids_sha256 == sha(" ".join(map(str, ids)))
        assert got[key].decoded_sha256 == sha(lib.decode(ids, skip_special_tokens=False))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x24F), max_size=60))
def test_bpe_any_latin_text(text):
    import public_tokenizers
    path = public_tokenizers.path("word_bpe_49k.json")
    t = bpe.tokenizer(path)
    ids = [i for w in t.pieces(text) for i in (w if type(w) is tuple else t.merge(w))]
    assert ids == library(path).encode(text, add_special_tokens=False).ids


def test_bpe_special_tokens_and_long_word(tokenizer_path):
    t, lib = bpe.tokenizer(tokenizer_path), library(tokenizer_path)
    for text in ["a<|endoftext|>b<|startoftext|>", "ΑΣ ΑΣΑ", "x" * 5000, "日本 😀 don't I'LL", " \n", "²½ 12"]:
        ids = [i for w in t.pieces(text) for i in (w if type(w) is tuple else t.merge(w))]
        assert ids == lib.encode(text, add_special_tokens=False).ids, text[:20]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text(alphabet="abcé", min_size=1, max_size=6),
                       st.lists(st.integers(1, 5), min_size=1, max_size=4), min_size=1, max_size=30),
       st.lists(st.text(alphabet="abcé", min_size=1, max_size=7), max_size=10))
def test_transducer(tmp_path_factory, words, others):
    path = tmp_path_factory.mktemp("lexicon") / "l.mat"
    path.write_bytes(bpe.compile_lexicon(words))
    lexicon = bpe.Lexicon(str(path))
    asked = [*words, *others]
    got = [None if x is None else np.frombuffer(x, np.int32).tolist() for x in lexicon.find(asked)]
    assert got == [words.get(w) for w in asked]


# -------------------------------------------------------------- 2 secrets
def spans_brute(text, reach=secrets.REACH):
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                        re.I | re.A)
    found = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    for kind, pattern in (("ident", secrets.IDENT), ("key", secrets.KEY), ("endpoint", secrets.ENDPOINT)):
        found += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text, re.A)]
    ends = [m.end() for m in re.finditer(r"\n[\x20\t\r]*\n", text)]

    def scope(x):
        return sum(e <= x[1] for e in ends)

    def near(x, y):
        return max(x[1], y[1]) - (x[2] if x[1] < y[1] or x[1:] <= y[1:] else y[2]) <= reach
    out = []
    for x in found:
        wanted = ("access", "ident", "endpoint") if x[0] == "key" else ("assign", "hex", "key")
        if x[0] in secrets.BASE or any(
                y != x and y[0] in wanted and scope(x) == scope(y) and near(x, y) for y in found):
            out.append(x)
    return sorted(out, key=lambda x: (x[1], secrets.KINDS.index(x[0]), x[2]))


SECRET_TEXTS = [
    "user: bob9 x https://h.example/a token=abc", 'token=token"=abcdef password: "hunter22"',
    "é" * 50 + " https://a.b/c\n\nsecret = abcdefg", "user=alice abC1defghijklmnopqrstu9 z", "", None,
    "AKIA" + "A" * 16 + " abC1defghijklmnopqrstu9 https://x.y " + "0" * 30,
    "https://x.y " + "z" * 300 + " password=abcdefgh", "token=ab token=abcdef" * 50, "login: ann\n \npasswd=abc123",
    ("word " * 20000) + "api_key='abcdef' https://far.example"]


def test_secrets_brute(spark):
    texts = SECRET_TEXTS + [t for _, t in rows_of(SF_SMALL)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.scan_secrets(docs).collect()}
    for i, t in enumerate(texts):
        assert got[i] == spans_brute(t), (i, (t or "")[:80])


def test_secret_parts_of_any_length(spark):
    """Keys of 129 and more characters, identifiers of 65 and more, and wide gaps; spans written by hand."""
    key = "aB3" * 43
    rows = [
        (1, f"user=alice {key} z", [("ident", 0, 10), ("key", 11, 140)], "[SECRET] [SECRET] z"),
        (2, f"{'aB3' * 2000} https://x.y", [("key", 0, 6000), ("endpoint", 6001, 6012)], "[SECRET] [SECRET]"),
        (3, f"login: {'n' * 65} password=abcdef", [("ident", 0, 72), ("assign", 73, 88)], "[SECRET] [SECRET]"),
        (4, f"user = {'n' * 5000}, secret=abcdef", [("ident", 0, 5007), ("assign", 5009, 5022)], "[SECRET], [SECRET]"),
        (5, "user:     alice token=abcdef", [("ident", 0, 15), ("assign", 16, 28)], "[SECRET] [SECRET]"),
        (6, f"{key} alone", [], f"{key} alone")]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.scan_secrets(docs).collect()}
    assert got == {r[0]: r[2] for r in rows}
    assert {tuple(r) for r in secrets.redact(docs).collect()} == {(r[0], r[3]) for r in rows}


def test_secret_scope_decides(spark):
    """Parts of one paragraph link over any distance, parts of two paragraphs never; spans written by hand."""
    key = "abC1defghijklmnopqrstu9"
    rows = [(1, f"user=alice {'x ' * 5000}\n{key}", [("ident", 0, 10), ("key", 10012, 10035)]),
            (2, f"user=alice\n \n{key}", []),
            (3, f"https://x.y {'z' * 300} token=abcdef", [("endpoint", 0, 11), ("assign", 313, 325)])]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.scan_secrets(docs).collect()}
    assert got == {r[0]: r[2] for r in rows}
    near = {r.doc_id: [tuple(s) for s in r.spans] for r in secrets.scan_secrets(docs, reach=200).collect()}
    assert near == {1: [], 2: [], 3: [("assign", 313, 325)]}


def test_redact(spark):
    docs = spark.createDataFrame([(1, "a password=abcdef b", 7), (2, None, 8), (3, "x" * 9, 9)],
                                 "doc_id long, text string, spans int")
    assert {tuple(r) for r in secrets.redact(docs).collect()} == {
        (1, "a [SECRET] b", 7), (2, None, 8), (3, "x" * 9, 9)}


# ------------------------------------------------- 3 and 6, learnt scores
@pytest.mark.parametrize("name, label, least", [
    ("op3_nnpu_toxicity", "toxic", 0.8), ("op6_line_crf_quality", "quality", 0.95)])
def test_held_out(spark, name, label, least):
    got = {r.doc_id: r for r in REGISTRY[name][0](spark, SF_MID).collect()}
    assert len(got) == 1000 and all(0 <= r.score <= 1 for r in got.values())
    held = [(got[i].score, y) for i, y in rows_of(SF_MID, "labels", f"doc_id, {label}") if got[i].held_out]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg])
    assert auc >= least


@pytest.mark.parametrize("module, label, row", [(nnpu, "toxic", {"shard", "p", "f"}),
                                                 (linecrf, "quality", {"shard", "y", "x", "weight"})])
def test_fit_groups_hold_no_texts(spark, monkeypatch, module, label, row):
    """What is grouped by shard for the fits has features only, and the fits still come."""
    from pyspark.sql import GroupedData
    seen, apply = [], GroupedData.applyInPandas

    def recorded(self, *args):
        seen.append(set(self._df.columns))
        return apply(self, *args)
    monkeypatch.setattr(GroupedData, "applyInPandas", recorded)
    rows = [(i, f"vile{i % 3} words {'x' * 10_000}" if i % 2 else "kind words\nof text") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(80)], f"doc_id long, {label} int")
    models = module.train(docs, known)
    assert seen == [row]
    assert len(models[1] if module is nnpu else models) == module.SHARDS


def test_nnpu_separates():
    rng = np.random.default_rng(0)
    truth = rng.random(2000) < 0.2
    x = (rng.random((2000, 6)) < 0.05).astype(np.uint8)
    x[truth, 0] = 1
    positive = truth & (rng.random(2000) < 0.5)
    data = np.vstack([x[positive], x])
    w = nnpu.fit_nnpu(data, np.arange(len(data)) < positive.sum(), 0.2)
    p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    assert p[truth].mean() > 0.6 > 0.25 > p[~truth].mean()


def test_crf_marginals_brute():
    rng = np.random.default_rng(1)
    length = np.array([3, 1, 4])
    score, couple = rng.normal(size=8), rng.normal(size=(2, 2))
    good, pair, z = linecrf.marginals(score, couple, length)
    at, total = 0, 0.0
    for n in length:
        w, g = [], np.zeros(n)
        for bits in range(1 << n):
            y = [(bits >> i) & 1 for i in range(n)]
            e = np.exp(sum(score[at + i] * y[i] for i in range(n)) + sum(couple[a, b] for a, b in zip(y, y[1:])))
            w.append(e)
            g += e * np.array(y)
        assert np.allclose(good[at:at + n], g / sum(w))
        total += np.log(sum(w))
        at += n
    assert np.isclose(z, total) and np.isclose(pair.sum(), (length - 1).sum())


def test_crf_gradient_is_of_one_objective():
    """Against numeric differences, with documents of several chains."""
    rng = np.random.default_rng(5)
    length, y = np.array([3, 1, 9, 6]), np.array([1, 0, 0, 1])
    x, w = rng.normal(size=(19, 4)), rng.normal(size=8)
    _, g = linecrf.objective(w, x, y, length, 0.1, longest=4)
    step = 1e-6 * np.eye(8)
    numeric = [(linecrf.objective(w + e, x, y, length, 0.1, longest=4)[0]
                - linecrf.objective(w - e, x, y, length, 0.1, longest=4)[0]) / 2e-6 for e in step]
    assert np.allclose(g, numeric, atol=1e-7)


def test_crf_chains():
    size, doc = linecrf.chains(np.array([3, 8, 4, 9]), 4)
    assert size.tolist() == [3, 4, 4, 4, 4, 4, 1] and doc.tolist() == [0, 1, 1, 2, 3, 3, 3]


def fit_rows(monkeypatch):
    """The number of rows that each fit's groups get in all."""
    from pyspark.sql import GroupedData
    seen, apply = [], GroupedData.applyInPandas

    def recorded(self, *args):
        seen.append(self._df.count())
        return apply(self, *args)
    monkeypatch.setattr(GroupedData, "applyInPandas", recorded)
    return seen


def test_fit_rows_are_bounded(spark, monkeypatch):
    """One labelled id on thousands of rows, repeated or with other texts, adds no more rows than the bound."""
    seen = fit_rows(monkeypatch)
    rows = [(1, f"vile thing {i}") for i in range(4000)] + [(1, "vile thing")] * 3000 + [(2, "kind words")] * 3000
    rows += [(i, f"kind words {i}") for i in range(3, 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    known = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (3, 0, 0)], "doc_id long, toxic int, quality int")
    nnpu.train(docs, known, max_positive=200, max_unlabelled=300)
    linecrf.train(docs, known, max_docs=200)
    assert len(seen) == 2 and 0 < seen[0] < 1.5 * 500 and 0 < seen[1] < 1.5 * 200


def test_ids_with_both_labels_teach_nothing(spark):
    known = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (3, 0), (None, 1), (4, None), (5, 7)], "doc_id long, toxic int")
    got = {(r.id, r.y) for r in nnpu.one_label(known, "doc_id", "toxic").collect()}
    assert got == {(2, 1), (3, 0)}


def test_scores_by_hand(spark):
    """Scores recomputed from the models' numbers, feature by feature and chain by chain."""
    import zlib
    kept = {zlib.crc32(b"<vile>") % nnpu.HASHES: 0, zlib.crc32(b"kind>") % nnpu.HASHES: 1}
    weights = [np.array([2.0, -1.0, 0.5]), np.array([1.0, 0.0, -0.5])]
    docs = spark.createDataFrame([(1, "Vile, vile!"), (2, "kind and vile"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in nnpu.score(docs, (kept, weights, 0.1)).collect()}
    curve = lambda *g: np.mean([1 / (1 + np.exp(-v)) for v in g])        # noqa: E731
    assert np.allclose([got[i] for i in (1, 2, 3)], [curve(2.5, 0.5), curve(1.5, 0.5), curve(0.5, -0.5)])

    rng = np.random.default_rng(8)
    d = 3 * linecrf._LOCAL
    model = np.concatenate([rng.normal(size=d), 1 + rng.random(d), rng.normal(size=d + 5), [0.7, -0.2]])
    text = "A first line.\nsecond | line!!\nsecond | line!!"
    x, weight = linecrf.line_features(text)
    line = (x - model[:d]) / model[d:2 * d] @ model[2 * d:3 * d] + model[3 * d]
    couple, total, good = model[3 * d + 1:-2].reshape(2, 2), 0.0, np.zeros(3)
    for y in np.ndindex(2, 2, 2):
        e = np.exp(line @ np.array(y) + couple[y[0], y[1]] + couple[y[1], y[2]])
        total, good = total + e, good + e * np.array(y)
    mean = np.clip(good / total @ weight / weight.sum(), 1e-4, 1 - 1e-4)
    want = 1 / (1 + np.exp(-(0.7 * np.log(mean / (1 - mean)) - 0.2)))
    got = linecrf.score(spark.createDataFrame([(text,)], "text string"), [model]).first().score
    assert np.isclose(got, want)


# ---------------------------------------------------------- 4 fingerprints
def test_quartile_brute(spark):
    docs = sorted(rows_of(SF_SMALL), reverse=True)
    got = {r.doc_id: r for r in REGISTRY["op4_quartile_digest"][0](spark, SF_SMALL).collect()}
    assert len(got) == len(docs)

    def of(text):
        return quartile.digest(np.frombuffer(text.encode(), np.uint8))
    near = 0
    for k, (key, text) in enumerate(docs):
        text, after = text or "", docs[(k + 1) % len(docs)][1] or ""
        half = len(text) // 2
        edited, r = text[:len(text) - half] + after[:half], got[key]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (
            len(text), sha(edited), of(text), of(edited))
        assert (r.near_edited, r.near_next) == (quartile.likeness(of(text), of(edited)),
                                                quartile.likeness(of(text), of(after)))
        near += r.near_edited > r.near_next
    assert near > 0.95 * len(docs)


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=300), st.binary(max_size=300))
def test_likeness_bounds(a, b):
    x, y = (quartile.digest(np.frombuffer(v, np.uint8)) for v in (a, b))
    assert quartile.likeness(x, x) == 1.0
    assert 0.0 <= quartile.likeness(x, y) == quartile.likeness(y, x) <= 1.0


# ------------------------------------------------------------------ 5 WARC
def test_warc_edges(spark):
    long = "é" * 200_000
    pages = spark.createDataFrame(
        [(5, "http://a", "x" * 100), (3, None, "x" * 100), (3, "http://c", "x" * 100), (4, "u", None), (6, "u", ""),
         (None, "n", "x" * 100), (7, "l", long), (8, "l", long), (9, "s", "y" * 99), (10, "s", "y" * 99)],
        "page_id long, url string, html string")
    got = Counter((r.record_id, r.type, r.refers_to, r.payload_bytes, bytes(r.payload).decode())
                  for r in warc.read_archives(warc.write_archives(pages)).collect())
    x = "x" * 100
    assert got == Counter({
        ("3", "response", None, 100, x): 2, ("5", "revisit", "3", 100, ""): 1, (None, "revisit", "3", 100, ""): 1,
        ("4", "response", None, 0, ""): 1, ("6", "response", None, 0, ""): 1, ("7", "response", None, 400_000, long): 1,
        ("8", "revisit", "7", 400_000, ""): 1, ("9", "response", None, 99, "y" * 99): 1,
        ("10", "response", None, 99, "y" * 99): 1})
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_warc_validation():
    good = warc.make_record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None, "1970-01-01T00:00:00Z")
    assert warc.parse_record(good)["payload"] == b"abc"
    for bad in (good[:-1], good.replace(b"abc", b"abd"), good.replace(b"WARC-Date", b"WARC-Dat"), b"",
                good.replace(b"WARC/1.1", b"WARC/0.9"), good + b"x"):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)
    with pytest.raises(warc.WarcError):
        warc.load_dictionary(io.BytesIO(b"\x28\xb5\x2f\xfd0000"))


# ------------------------------------------------------------------ 7 chat
CHAT_TEXT = st.lists(st.sampled_from([
    "~", "~0", "~2", "0", "2", "<s>", "</s>", "[TURN]", "[ROLE]", "[/ROLE]", "[INST]", "</", "s>", "[", "]", "<", "a", "\n", "é"]),
    max_size=8).map("".join)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 9), st.sampled_from(["user", "assistant", "</s>", None]),
                          CHAT_TEXT | st.none()), min_size=1, max_size=30))
def test_chat_round_trip(spark, turns):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df).select("conv_id", chat.read_turns(F.col("formatted")).alias("t"),
                                       chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    want: dict = {}
    for c, n, role, text in sorted(turns, key=lambda t: (t[0], t[1], t[2] or "", t[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    got = {r.conv_id: ([tuple(t) for t in r.t], r.loss) for r in out.collect()}
    assert got == {c: (t, "".join(x for r, x in t if r == "assistant")) for c, t in want.items()}


# ---------------------------------------------------------- 8 Jaccard join
def components_brute(texts, width, percent):
    sets = []
    for t in texts:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        sets.append({tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width
                    else ({tuple(w)} if w else set()))
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def near_copies(seed, groups=6, size=14):
    """Groups of edits of one text, loose and tight, so buckets hold linked and unlinked members."""
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        words = [f"w{x}" for x in rng.integers(0, 10**6, rng.integers(6, 160))]
        for _ in range(size):
            mine = list(words)
            for at in rng.integers(0, len(mine), rng.integers(0, 1 + len(mine) // 25)):
                mine[at] = f"e{rng.integers(0, 10**6)}"
            out.append(" ".join(mine))
    return out + ["", None, "One", "one", "a b", "A  b", "same " * 50, "same " * 51]


@pytest.mark.parametrize("width, percent, n2, k2, block", [(4, 85, 2, 1, 3), (5, 80, 3, 1, 4096)])
def test_jaccard_brute(spark, monkeypatch, width, percent, n2, k2, block):
    """Blocks of three members make most open buckets span several blocks; texts meet in many pairs of blocks."""
    monkeypatch.setattr(partenum, "BLOCK", block)
    monkeypatch.setattr(partenum, "BLOCK_SETS", 4 if block == 3 else 2048)
    texts = near_copies(width) + [t for _, t in rows_of(SF_SMALL)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in
           partenum.ngram_jaccard_join(docs, width=width, percent=percent, n2=n2, k2=k2).collect()}
    want = components_brute(texts, width, percent)
    assert got == dict(enumerate(want))


def test_jaccard_repeated_and_null_ids(spark):
    """Ids that repeat, with the same or another text, and many null ids: links follow the texts."""
    texts = near_copies(3, groups=3, size=8)
    ids = [None if i % 3 == 0 else i % 5 for i in range(len(texts))]
    rows = list(zip(ids, texts)) * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.n_shingles, -1 if r.component_id is None else r.component_id)
                  for r in partenum.ngram_jaccard_join(docs).collect()))
    want = []
    groups = components_brute([t for _, t in rows], 4, 85)
    for at, (n, root) in enumerate(groups):
        members = [rows[j][0] for j, (_, c) in enumerate(groups) if c == root] if n else [rows[at][0]]
        least = min((m for m in members if m is not None), default=-1)
        want.append((n, least))
    assert got == sorted(want)


@pytest.mark.parametrize("block", [5, 4096])
def test_jaccard_cluster_and_outsiders(spark, monkeypatch, block):
    """A cluster of near copies, outsiders that share much with it without linking, and a second cluster beside it."""
    monkeypatch.setattr(partenum, "BLOCK", block)
    monkeypatch.setattr(partenum, "REMEMBERED", 3)
    monkeypatch.setattr(partenum, "ROUND_ROWS", 10 if block == 5 else 1_000_000)
    monkeypatch.setattr(partenum, "BLOCK_SHINGLES", 700 if block == 5 else 1 << 21)
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(200)]

    def edit(n, base=words):
        mine = list(base)
        for at in rng.permutation(len(mine))[:n]:
            mine[at] = f"e{rng.integers(0, 10**9)}"
        return " ".join(mine)

    second = edit(16).split()
    texts = [edit(1) for _ in range(60)] + [edit(14) for _ in range(8)] + [edit(1, second) for _ in range(30)] + [edit(30) for _ in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.ngram_jaccard_join(docs).collect()}
    want = components_brute(texts, 4, 85)
    assert got == dict(enumerate(want)) and len({c for _, c in want}) > 3


def test_packed_texts_are_unpacked_in_pieces():
    """Texts that pack a thousandfold come back a bounded amount at a time."""
    texts = ["one line of text\n" * 20_000, "", "x", "one line of text\n" * 20_000, "é" * 700_000, "end"] * 3
    batch = pa.RecordBatch.from_arrays([partenum.pack_texts(pa.array(texts)), pa.array(range(len(texts)))], ["text", "id"])
    assert sum(len(t) for t in batch.column("text").to_pylist()) < 20_000
    got, ids = [], []
    for part, some in partenum.unpacked(batch, "text"):
        assert part.num_rows == len(some) and sum(map(len, some.to_pylist()[:-1])) < partenum.UNPACKED
        got += some.to_pylist()
        ids += part.column("id").to_pylist()
    assert got == texts and ids == list(range(len(texts)))


def test_signatures_share_one():
    """Sets at the similarity limit always share an emitted signature."""
    rng = np.random.default_rng(5)
    for percent, n2, k2 in ((85, 2, 1), (80, 3, 1), (90, 4, 2)):
        edges, params = partenum.instance_params(percent, k2)
        subsets = [list(c) for c in partenum.combinations(range(n2), n2 - k2)]
        for size in (7, 12, 40, 300):
            for _ in range(40):
                a = np.unique(textops.mix(rng.integers(0, 2**63, size).astype(np.uint64)))
                d = size * (100 - percent) // 100
                b = np.unique(np.concatenate([a[rng.permutation(len(a))[d:]]]))
                sa, sb = (set(s[e].tolist()) for s, e in (
                    partenum.signatures(x, edges, params, n2, subsets) for x in (a, b)))
                assert len(b) == len(a) or sa & sb


def test_few_sets_emit_signatures_of_nothing():
    """Also the smallest sets of an instance rarely have more empty groups than are spared."""
    rng = np.random.default_rng(6)
    edges, params = partenum.instance_params(80, 1)
    band = int(np.searchsorted(edges, 400, "right"))
    emitted = []
    for _ in range(60):
        s = np.unique(rng.integers(0, 2**64, int(edges[band]), dtype=np.uint64))
        emitted.append(partenum.signatures(s, edges, params, 2, [[0], [1]])[1].all())
    assert sum(emitted) <= 6


@pytest.mark.parametrize("ranges", [1, 1024, 5900])
def test_shared_signatures_of_packed_ranges(ranges):
    """Signatures of several tasks, with copies: those of two sets or more, each set once, with the smallest."""
    rng = np.random.default_rng(7)
    values = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    tasks = [(values[rng.integers(0, 3000, 2000)], rng.choice([-(2**62), -5, 3, 7, 2**62], 2000)) for _ in range(3)]
    tasks.append((np.full(500, values[0]), np.arange(500)))             # one very common signature
    want = {}
    for sig, sid in tasks:
        for g, x in zip(sig.tolist(), sid.tolist()):
            want.setdefault(g, set()).add(x)
    by_part, found = {}, {}
    for task in tasks:
        for part, low, sid in zip(*partenum.pack_signatures(*task, ranges).to_pydict().values()):
            by_part.setdefault(part, []).append((np.frombuffer(low, np.uint32), np.frombuffer(sid, np.int64)))
    for part, rows in by_part.items():
        for batch in partenum.shared_signatures(part, *(np.concatenate(x) for x in zip(*rows))):
            for sig, sid, piv in zip(*batch.to_pydict().values()):
                found.setdefault((sig, piv), []).append(sid)
    assert sorted((min(x), sorted(x)) for x in want.values() if len(x) > 1) == sorted(
        (piv, sorted(x)) for (_, piv), x in found.items())
    assert len(by_part) <= ranges and len({sig for sig, _ in found}) == len(found)


def test_packing_signatures_is_small_beside_an_executor():
    """What a task packs at once takes a few MB beyond the signatures, not a hundred."""
    rng = np.random.default_rng(8)
    sig = rng.integers(0, 2**64, partenum.PACKED, dtype=np.uint64)
    sid = rng.integers(0, 2**62, partenum.PACKED)
    partenum.pack_signatures(sig[:9], sid[:9], 1)          # what is imported at the first call does not count
    tracemalloc.start()
    packed = partenum.pack_signatures(sig, sid, partenum.RANGES[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(x) // 4 for x in packed.column("sig").to_pylist()) == partenum.PACKED
    assert peak < 24 << 20


def test_small_batches_while_writing(spark):
    """Long rows reach Python a bounded amount at a time, one very long row alone; the session's choice is put back."""
    def seen(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(0, 3000, 1, 1).select(
        F.expr("CASE WHEN id = 5 THEN repeat('x', 9000000) ELSE repeat('some text ', 400) END").alias("text"))
    got = written(docs.mapInArrow(seen, "rows long, bytes long"), "seen", small_batches=True).collect()
    assert sum(r.rows for r in got) == 3000 and len(got) > 5
    assert sorted(r.bytes for r in got)[-2] < 3 << 20
    assert spark.conf.get(key) == before


def test_jaccard_unlike_long_texts_are_no_candidates(spark, monkeypatch):
    """Long texts with a passage in common share signatures; their sketches part them inside the join."""
    rng = np.random.default_rng(13)
    common = [f"c{i}" for i in range(280)]
    texts = [" ".join(common + [f"u{x}" for x in rng.integers(0, 10**9, 420)]) for _ in range(40)]
    texts += [texts[0] + " more", texts[1][:-1] + "x"]
    made, write = {}, partenum.written

    def counted(df, name):
        out = write(df, name)
        made.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(partenum, "written", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in partenum.ngram_jaccard_join(docs, width=5, percent=80).collect()}
    assert got == dict(enumerate(components_brute(texts, 5, 80)))
    assert sum(made["members"]) > 40 and sum(made["cross"]) <= 4


# ------------------------------------------------------------- 9 packing
@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=120), st.sampled_from([(64,), (8, 16, 64), (20, 64)]))
def test_pack(sizes, capacities):
    used: dict = {}
    for s, (b, o) in sorted(zip(sizes, pack(sizes, capacities)), key=lambda x: (x[1], x[0])):
        assert o == used.get(b, 0) or s == 0
        used[b] = used.get(b, 0) + s
    assert all(u <= max(capacities) for u in used.values())


def test_best_fit_places_every_token(spark):
    out = REGISTRY["op9_variable_best_fit"][0](spark, SF_MID).collect()
    tokens: Counter = Counter()
    used: Counter = Counter()
    for r in out:
        tokens[r.doc_id] += r.n_tokens
        used[r.bin_id] += r.n_tokens
    assert tokens == {k: len(WORD.findall(t or "")) for k, t in rows_of(SF_MID)} and len(tokens) == 1000
    size = {r.bin_id: r.bin_size for r in out}
    assert all(used[b] == r.bin_used for r in out for b in [r.bin_id])
    assert all(size[b] == min(c for c in CAPACITIES if c >= used[b]) for b in size)
    assert sum(used.values()) > 0.9 * sum(size.values())


# --------------------------------------------------------- 10 host rules
def rules_brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    seen, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        if seen[x] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            len(w) < 20 or 100 * len(covered) > 30 * len(w))


def test_rules_brute(spark):
    texts = ["", None, "a " * 30, "x\nx\n \nx", "p q r s t u v w " * 2, "é|<>#", " ".join(map(str, range(40))),
             "z " * 100_000] + [t for _, t in rows_of(SF_SMALL)]
    docs = spark.createDataFrame([(i, t, None, "h", 0) for i, t in enumerate(texts)], DOC)
    got = {r.doc_id: r for r in host_quality(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == rules_brute(t)


def test_host_verdicts(spark):
    good = " ".join(map(str, range(40)))
    rows = ([(i, "bad", None, "spam.example", 0) for i in range(60)] + [(100, good, None, "spam.example", 0)]
            + [(200 + i, good, None, f"h{i % 5}", 0) for i in range(100)] + [(300, good, None, None, 0)])
    docs = spark.createDataFrame(rows, DOC)
    kept = {r.doc_id: r.kept for r in host_quality(docs).collect()}
    assert not kept[100] and kept[300] and all(kept[200 + i] for i in range(100))
    assert {r.doc_id for r in reject_by_rules(docs).collect()} == {k for k, v in kept.items() if v}
    flags = spark.createDataFrame([], "host string, base_failed boolean")
    assert host_verdicts(flags, "host").count() == 0
