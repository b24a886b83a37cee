"""Whitening, periodic runs and the source mix against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.llm import pareto, runs, whitening
from tabsmith.llm.queries import REGISTRY
from tests.conftest import SF_MID, SF_SMALL

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ------------------------------------------------------------------ whitening

def spectrum_brute(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    fit = np.unique(x, axis=0)
    z = fit - fit.mean(axis=0)
    e, v = np.linalg.eigh(z.T @ z / len(fit))
    return fit, e[::-1], v[:, ::-1]


@pytest.mark.parametrize("seed", range(6))
def test_bidiagonal_solver(seed):
    """Singular values and directions of bidiagonal matrices: plain, graded, with zeros, split and clustered."""
    rng = np.random.default_rng(seed)
    for _ in range(30):
        n = int(rng.integers(1, 40))
        a, b = [(rng.normal(size=n), rng.normal(size=n - 1)), (10.0 ** rng.integers(-4, 4, n), 10.0 ** rng.integers(-4, 4, n - 1)),
                (rng.integers(-2, 3, n).astype(float), rng.integers(-2, 3, n - 1).astype(float)),
                (np.ones(n), np.full(n - 1, 1e-3)), (np.abs(np.arange(n) - n // 2) + 0.5, np.ones(n - 1)),
                (np.tile(rng.normal(size=5), 8)[:n], rng.normal(size=n - 1) * 1e-6)][seed]
        full = np.diag(a) + np.diag(b, 1)
        want = np.linalg.svd(full, compute_uv=False)
        got = whitening.dqds(a, b)
        assert np.abs(np.sqrt(got) - want).max() <= 1e-13 * max(want[0], 1e-300)
        if seed < 2:                           # no zeros: small values are relatively accurate
            lo = want > 1e-10 * want[0]
            assert np.allclose(np.sqrt(got)[lo], want[lo], rtol=1e-9 if seed else 1e-12, atol=0)
        got = got[got > got[0] * (n * 8 * 2.3e-16) ** 2]
        z = whitening.directions(a, b, got)
        if len(got):
            assert np.abs(z.T @ z - np.eye(len(got))).max() < 1e-8
            assert np.abs(full.T @ (full @ z) - z * got).max() < 1e-7 * got[0]


def test_triangular_factor(spark):
    """Blocks and parts merge into the factor of all centred rows, whatever their number and offset."""
    rng = np.random.default_rng(3)
    x = rng.integers(-50, 50, (700, 5)) + 1_000_000_000_000
    table = spark.createDataFrame([(r,) for r in x.tolist()], "x array<long>").repartition(150)
    part = whitening.triangular(table, "x", 5)
    z = x - x.mean(axis=0)
    assert part.n == 700 and part.sums == x.sum(axis=0).tolist()
    assert np.allclose(part.r.T @ part.r, z.T @ z, rtol=1e-10, atol=1e-6)
    assert whitening.triangular(table.limit(0), "x", 5) is None
    u, v, w = whitening.bidiagonal(part.r)
    back = part.r @ w
    assert np.allclose((back.T @ back), (np.diag(u) + np.diag(v, 1)).T @ (np.diag(u) + np.diag(v, 1)), rtol=1e-9, atol=1e-5)


def test_op11_brute(spark):
    table = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet").toPandas()
    x = np.floor(64 * np.array(table.embedding.tolist(), float)) + 1_000_000
    fit, e, v = spectrum_brute(x)
    w = (x - fit.mean(axis=0)) @ v[:, :16] / np.sqrt(e[:16])
    s = fit.sum(axis=0)
    deviation = ((len(fit) * x - s) ** 2).sum(axis=1).astype(int)
    got = REGISTRY["op11_bidiagonal_whitening"][0](spark, SF_SMALL).toPandas()
    assert len(got) == 16 * len(table) and set(got.component) == set(range(1, 17)) and set(got.n) == {len(fit)}
    assert got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[table.vec_id].to_numpy()
    sign = np.sign((wide * w).sum(axis=0))
    assert np.abs(wide * sign - w).max() < 1e-9
    shares = got.groupby("component").explained.first().to_numpy()
    assert np.allclose(shares, e[:16] / e.sum(), rtol=1e-10)
    assert got.groupby("vec_id").deviation.first().loc[table.vec_id].tolist() == deviation.tolist()


def test_whitening_edges(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 1.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]),
            (5, [float("inf"), 1.0]), (6, []), (7, [1.0]), (8, [1e300, -1e300]), (9, [0.0, 0.0]), (10, [2.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    clash = df.select("*", *(F.lit("own").alias(c) for c in ("id", "x", "n", "whitened", "dims", "deviation", "explained")))
    got = whitening.whiten(clash, "vec_id", "embedding", k=4).collect()
    assert Counter(r.vec_id for r in got) == Counter([1, 1, None, 8, 9, 10])
    assert {r.n for r in got} == {5}
    # without the entries that double precision cannot hold beside the others
    assert all(r.identity_error < 1e-9 for r in whitening.whiten(df.filter("vec_id <> 8"), "vec_id", "embedding").collect())
    assert len({tuple(r.whitened) for r in got if r.vec_id == 1}) == 1
    big = (1 << 52) + 1_000_000
    fit = [[1_000_064, 1_000_128], [1_000_192, 1_000_064], [big, 1_000_000 - (1 << 52)], [1_000_000, 1_000_000], [1_000_128, 1_000_128]]
    sums = [sum(c) for c in zip(*fit)]
    assert {r.vec_id: int(r.deviation) for r in got}[9] == sum((5 * a - s) ** 2 for a, s in zip(fit[3], sums))
    # one distinct vector has no direction with variance; a constant dimension adds none
    one = whitening.whiten(df.filter("vec_id = 1"), "vec_id", "embedding").collect()
    assert [(r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, [], [], 0.0)] * 2
    flat = spark.createDataFrame([(i, [5.0, float(i % 3), float(i % 3) * 2]) for i in range(9)], "vec_id long, embedding array<double>")
    got = whitening.whiten(flat, "vec_id", "embedding").collect()
    assert {len(r.whitened) for r in got} == {1} and {r.n for r in got} == {3}
    assert abs(got[0].explained[0] - 1) < 1e-12
    assert whitening.whiten(df.limit(0), "vec_id", "embedding").collect() == []
    assert whitening.whiten(df.filter("vec_id = 2"), "vec_id", "embedding").columns == [
        "vec_id", "n", "deviation", "whitened", "explained", "identity_error"]


# ----------------------------------------------------------------------- runs

def runs_brute(words: list, min_words: int = 6, min_power: int = 4) -> list[tuple[int, int, int]]:
    """Runs straight from the definition: for every period the maximal stretches of equal words that far apart."""
    code: dict = {}
    w = np.array([code.setdefault(x, len(code)) for x in words], np.int64)
    n, found = len(w), {}
    for q in range(1, n // min_power + 1):
        same = np.r_[False, w[:-q] == w[q:], False].astype(np.int8)
        step = np.diff(same)
        for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1)):
            if b + q - a >= max(min_words, min_power * q):
                found.setdefault((int(a), int(b) + q), q)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def edited_brute(key, text: str | None) -> list[str]:
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(key).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def told(rs) -> str:
    return "".join(f"{a},{n},{q}\n" for a, n, q in rs)


def collapsed_brute(words, rs) -> str:
    gone = {i for a, n, q in rs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_op12_brute(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()}
    got = REGISTRY["op12_periodic_runs"][0](spark, SF_MID).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    some = 0
    for r in got:
        words = edited_brute(r.doc_id, docs[r.doc_id])
        want = runs_brute(words)
        best = max(want, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        some += best is not None
        assert r.n_runs == len(want) and r.runs_sha256 == sha(told(want))
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.collapsed_sha256 == sha(collapsed_brute(words, want))
    assert some > 20


def test_runs_of_small_alphabets(spark):
    """Dense repetition: overlapping runs, shared starts, periods within periods, against the definition."""
    rng = np.random.default_rng(7)
    texts = ["a " * n for n in range(12)] + ["a b " * 9 + "c " + "a b c " * 7, "x y x y x y x y x z " * 5, "a a b " * 40]
    for _ in range(400):
        root = rng.integers(0, 3, int(rng.integers(1, 9))).tolist()
        body = rng.integers(0, 2, int(rng.integers(0, 30))).tolist() + root * int(rng.integers(1, 12)) + root[:int(rng.integers(0, 9))]
        texts.append(" ".join(map(str, body + rng.integers(0, 2, int(rng.integers(0, 20))).tolist())))
    for power, least in ((4, 6), (3, 1)):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        for r in runs.periodic_runs(docs, min_words=least, min_power=power).collect():
            want = runs_brute(r.text.split(), least, power)
            assert [tuple(x) for x in r.runs] == want
            assert r.collapsed == collapsed_brute(r.text.split(), want)
    with pytest.raises(ValueError):
        runs.periodic_runs(docs, min_power=2)


def test_runs_edges(spark):
    rows = [(1, None), (1, ""), (None, " \t\n"), (2, "long word " * 30_000), (3, "one two\x85x " * 6), (3, "one two\x85x " * 6), (4, "x" * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clash = df.select("*", *(F.lit("own").alias(c) for c in ("row", "runs", "collapsed", "best", "start", "__row")))
    got = runs.periodic_runs(clash).withColumn("best", runs.strongest(F.col("runs"))).collect()
    assert Counter((r.doc_id, r.collapsed) for r in got) == Counter({
        (1, ""): 2, (None, ""): 1, (2, "long word"): 1, (3, "one two\x85x"): 2, (4, "x" * 50_000): 1})
    assert {r.doc_id: r.best for r in got if r.doc_id in (1, 4)} == {1: None, 4: None}
    assert [tuple(r.best) for r in got if r.doc_id == 2] == [(0, 60_000, 2)] and got[0]["start"] == "own"
    assert runs.periodic_runs(clash.limit(0)).collect() == []
    # a greater ratio wins, then the smaller start
    pick = spark.createDataFrame([([(0, 9, 2), (20, 14, 3), (40, 28, 6), (90, 14, 3)],), ([],)], f"runs array<{runs.RUN}>")
    assert [r[0] and tuple(r[0]) for r in pick.select(runs.strongest(F.col("runs"))).collect()] == [(20, 14, 3), None]
    kept = runs.with_repeats(spark.createDataFrame([(None, "a b c"), (0, None), (0, " ")], "doc_id long, text string")).collect()
    assert [r.text for r in kept] == ["a b c", None, " "]


def test_long_text_is_not_quadratic(spark):
    """Four times the words take about four times as long, also where everything repeats."""
    import time
    took = []
    for n in (100_000, 400_000):
        codes = np.tile(np.arange(7), n // 7 + 1)[:n]
        start = time.perf_counter()
        found = runs.find_runs(codes, np.array([0, n]))
        took.append(time.perf_counter() - start)
        assert found.tolist() == [[0, n, 7]]
    assert took[1] < 10 * took[0] + 0.5


# ------------------------------------------------------------------------ mix

def targets_brute(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, still = sum(sizes.values()), {}, set(names)
    while still:
        total = sum(w[s] for s in still)
        full = [s for s in still if left * w[s] > most * sizes[s] * total]
        if not full:
            out.update({s: left * w[s] / total for s in still})
            break
        for s in full:
            out[s] = float(most * sizes[s])
        left -= sum(most * sizes[s] for s in full)
        still -= set(full)
    return out


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_op13_brute(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    size = {k: len(WORD.findall(r.text or "")) for k, r in docs.items()}
    total = Counter()
    for k, r in docs.items():
        total[r.source] += size[k]
    want = targets_brute(total)
    got = REGISTRY["op13_pareto_mix"][0](spark, sf).collect()
    again = REGISTRY["op13_pareto_mix"][0](spark, sf).collect()
    assert sorted(got) == sorted(again) and sorted(r.doc_id for r in got) == sorted(docs)
    taken = Counter()
    for r in got:
        source = docs[r.doc_id].source
        assert r["size"] == size[r.doc_id] and r.source_size == total[source]
        assert r.target == pytest.approx(want[source], rel=1e-12)
        assert r.taken % max(1, r["size"]) == 0 and 0 <= r.taken <= 3 * r["size"]
        # certain copies: the whole part of the expected ones
        assert r.taken >= int(want[source] / total[source] - 1e-9) * r["size"]
        taken[source] += r.taken
    for s, t in want.items():
        # near the target, or at most half of the shortest document that is left away from it
        rest = [r["size"] for r in got if docs[r.doc_id].source == s and 0 < r["size"] and
                r.taken == int(t / total[s]) * r["size"] and t < 3 * total[s]]
        assert abs(taken[s] - t) <= max(0.02 * t, min(rest, default=0) / 2, 1e-6), s


def test_targets_cap_and_reshare(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 1000, "d": 0, None: 7}, {"a": 1, "b": 1, "c": 5000}, {"B": 3, "a": 9, "\U0001f600": 50, "￿": 5},
                  {"only": 12}, {"a": 0, None: 0}):
        table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in pareto.targets(table).collect()}
        want = targets_brute(sizes)
        assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], rel=1e-12, abs=1e-12) for s in want)


def test_inclusion_and_preferences(spark):
    """Documents are drawn about as often as their inclusion says; certain copies always come."""
    rows = [(i, "a" if i < 60 else "b", 10, [0.2, 0.5, 1.0][i % 3]) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n long, wish double").cache()
    seen, rounds = Counter(), 10
    for seed in range(rounds):
        out = pareto.mix(docs.withColumn("text", F.lit("")), size=F.col("n"), preference=F.col("wish"), weights=(1, 1), seed=seed).collect()
        for r in out:
            assert r.copies >= int(r.expected) and r.copies <= int(r.expected) + 1 <= 4 and r.taken == 10 * r.copies
            seen[r.doc_id] += r.copies
        for source in (0, 1):
            assert abs(sum(r.taken for r in out if (r.doc_id >= 60) == bool(source)) - 600) <= 10
    expected = {r.doc_id: r.expected for r in out}
    assert len({round(e, 6) for e in expected.values()}) == 3
    for kind in range(3):
        ids = [i for i in range(120) if i % 3 == kind]
        rate = sum(seen[i] for i in ids) / rounds / len(ids)
        assert abs(rate - expected[ids[0]]) < 0.1
    docs.unpersist()


def test_mix_edges(spark):
    text = "w " * 50
    rows = [(1, "s", text), (1, "s", text), (None, None, "a b c"), (2, "s", None), (3, "", ""), (4, None, "word " * 20_000)] + [
        (9, "hot", "same words here")] * 300
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    clash = df.select("*", *(F.lit("own").alias(c) for c in ("id", "size", "u", "q", "p", "uid", "target", "taken", "place", "c",
                                                               "room", "running", "drawn", "gap", "weight", "preference")))
    got = pareto.mix(clash).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert sorted(got, key=str) == sorted(pareto.mix(clash.repartition(7)).collect(), key=str)
    sizes = {"": 0, "hot": 900, "s": 100, None: 20_003}
    want = targets_brute(sizes)
    by = {9: "hot", 1: "s", 2: "s", 3: "", 4: None, None: None}
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(want[by[r.doc_id]]) and r.taken == r.copies * r["size"]
        taken[by[r.doc_id]] += r.taken
    assert taken["hot"] == want["hot"] == 2700 and taken["s"] == 300
    assert pareto.mix(clash.limit(0)).collect() == []
    odd = pareto.mix(df, preference=F.when(F.col("doc_id") == 9, float("nan")).when(F.col("doc_id") == 4, -1.0)).collect()
    assert all(r.taken == 0 for r in odd)
