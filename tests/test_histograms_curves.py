"""Histograms of many columns and classes, and curves, against plain Python; their plans."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.operators import evaluate as EV
from tabsmith.operators import histogram as H


def bins_brute(values, bins):
    v = [x for x in values if x is not None and not math.isnan(x)]
    if not v:
        return []
    lo, hi = min(v), max(v)
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    count = [0] * bins
    for x in v:
        count[min(int(math.floor((x - lo) * bins / (hi - lo))), bins - 1)] += 1
    w = (hi - lo) / bins
    return [(b, lo + b * w, lo + (b + 1) * w, n) for b, n in enumerate(count)]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(11)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), rng.gauss(0, 5), rng.choice([None, 7.0]), float(rng.randrange(4)), None)
            for _ in range(900)] + [("a", float("nan"), 7.0, 1.0, None)]
    return rows, spark.createDataFrame(rows, "label string, x double, `same.x` double, few double, none double").cache()


@pytest.mark.parametrize("map_classes", [0, 200])
def test_histograms_brute(spark, table, map_classes):
    rows, df = table
    cols = ["x", "same.x", "few", "none"]
    got = {}
    for r in H.histograms(df, cols, 7).collect():
        got.setdefault(r.column_name, []).append((r.bin, r.lower, r["upper"], r["count"]))
    for i, c in enumerate(cols, 1):
        want = bins_brute([r[i] for r in rows], 7)
        assert [v[::3] for v in sorted(got.get(c, []))] == [w[::3] for w in want]
        assert np.allclose([v[1:3] for v in sorted(got.get(c, []))], [w[1:3] for w in want])
    by = {}
    for r in H.histograms_by_class(df, cols, "label", 5, map_classes).collect():
        by.setdefault((r.column_name, r.label), []).append((r.bin, r["count"]))
    for i, c in enumerate(cols, 1):
        for label in "abc":
            want = bins_brute([r[i] for r in rows if r[0] == label], 5)
            assert sorted(by.get((c, label), [])) == [(b, n) for b, _, _, n in want]
    assert {k for _, k in by} == {"a", "b", "c"}
    assert H.histograms(df.limit(0), ["x"]).collect() == [] and H.histograms_by_class(df.limit(0), ["x"], "label").collect() == []


def test_class_histogram_moves_no_rows(spark, table):
    """With broadcasts off, the counting scan neither joins nor shuffles raw rows on the label."""
    df = table[1]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = H.histogram_by_class(df, "x", "label")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Join") == 1            # the grid of bins with the counts
    assert plan.count("Aggregate") == 1


def test_adaptive_reads_once_for_all_columns(spark, table):
    rows, df = table
    out = H.adaptive_distribution(df, ["x", "few", "label", "same.x"]).collect()
    kinds = {r.column_name: r.kind for r in out}
    assert kinds == {"x": "histogram", "few": "top_values", "label": "top_values", "same.x": "top_values"}
    few = sorted(((r.position, float(r.value), r["count"]) for r in out if r.column_name == "few"))
    want = sorted(((-sum(r[3] == v for r in rows), v) for v in (0.0, 1.0, 2.0, 3.0)))
    assert few == [(i, v, -n) for i, (n, v) in enumerate(want, 1)]


def roc_brute(pairs, drop):
    pts, tp, fp = [], 0, 0
    for s in sorted({s for s, _ in pairs}, reverse=True):
        tp += sum(y == 1 and t == s for t, y in pairs)
        fp += sum(y != 1 and t == s for t, y in pairs)
        pts.append((s, fp, tp))
    keep = [p for i, p in enumerate(pts) if not drop or i in (0, len(pts) - 1) or
            pts[i + 1][1] - 2 * p[1] + pts[i - 1][1] or pts[i + 1][2] - 2 * p[2] + pts[i - 1][2]]
    pos, neg = tp or None, fp or None
    return [(math.inf, 0.0, 0.0)] + [(s, b / neg if neg else None, a / pos if pos else None) for s, b, a in keep]


@pytest.mark.parametrize("n_buckets", [3, None])
def test_curves_brute(spark, n_buckets):
    """Neighbours across ranges, ties, one class only, one score only, NULL groups."""
    rng = random.Random(2)
    rows = [(rng.choice([0, 1, None]), rng.randrange(2), round(rng.random(), 2)) for _ in range(700)]
    rows += [(7, 1, 0.5)] * 3 + [(8, 0, 0.1 * i) for i in range(4)] + [(0, 1, float("nan")), (0, 1, None)]
    df = spark.createDataFrame(rows, "g int, label int, score double")
    for drop in (True, False):
        got = {}
        for r in EV.roc_curve(df, group="g", drop_intermediate=drop, n_buckets=n_buckets).collect():
            got.setdefault(r.g, []).append((r.threshold, r.fpr, r.tpr))
        for g in (0, 1, None, 7, 8):
            pairs = [(s, y) for k, y, s in rows if k == g and s is not None and not math.isnan(s)]
            assert sorted(got[g], key=lambda p: -p[0]) == roc_brute(pairs, drop), g
    pr = EV.pr_curve(df, group="g", n_buckets=n_buckets).collect()
    assert sum(r.threshold is None for r in pr) == 5
    assert sorted((r.precision, r.recall) for r in pr if r.g == 7) == [(1.0, 0.0), (1.0, 1.0)]


def test_curves_scan_the_scores_once(spark, collected_plans, tmp_path):
    path = str(tmp_path / "scored")
    spark.createDataFrame([(i % 10, i % 2, (i * 37 % 101) / 101) for i in range(3000)], "fold int, label int, score double").write.parquet(path)
    df = spark.read.parquet(path)
    curve = EV.roc_curve(df, group="fold")
    assert path not in str(curve.inputFiles())           # only the written distinct scores are read again
    text = curve._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Join") == 1                        # the offsets of the ranges; no join on positions
    assert curve.count() > 10


@pytest.mark.parametrize("bitmap_bytes", [0, 16, 10_000_000])
def test_typed_distinct_brute(spark, bitmap_bytes):
    from datetime import date, datetime
    from decimal import Decimal
    from tabsmith.operators import profile as P
    rng = random.Random(4)
    rows = [(rng.randrange(-50, 50), rng.choice([-2**63, 2**63 - 1, 0, None]), rng.choice([0.0, -0.0, float("nan"), 1e-300, None]),
             rng.choice(["1", "1.0", "", None]), date(2020, 1, rng.randrange(1, 9)), datetime(2020, 1, 1, 0, 0, rng.randrange(5)),
             Decimal(rng.randrange(5)) / 4, rng.choice([True, False, None]), None, Decimal(rng.randrange(3))) for _ in range(300)]
    df = spark.createDataFrame(rows, "`a.i` int, big long, f double, s string, d date, t timestamp, m decimal(9,2), b boolean, "
                                     "e int, w decimal(38,2)")
    want = [len({v for v in (r[k] for r in rows) if v is not None and v == v}) for k in range(10)]
    got = {r.column_name: r.n_unique for r in P.distinct_counts(df, bitmap_bytes=bitmap_bytes).collect()}
    assert [got[c] for c in df.columns] == want
    near = {r.column_name: r.n_unique for r in P.distinct_counts(df, approx=True).collect()}
    assert all(abs(near[c] - n) <= 0.1 * n for c, n in zip(df.columns, want))
    assert {r.n_unique for r in P.distinct_counts(df.limit(0)).collect()} == {0}


def test_distinct_counts_cast_no_number_to_text(spark):
    from tabsmith.operators import profile as P
    df = spark.range(1000).select("id", (F.col("id") % 7).cast("double").alias("x"), F.col("id").cast("int").alias("k"))
    plan = P.distinct_counts(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "as string" not in plan and "bitmap_construct_agg" in plan


def test_profilers_take_any_name(spark):
    """Names with dots and backticks, in every profiler."""
    from tabsmith.operators import clean as C
    from tabsmith.operators import profile as P
    df = spark.createDataFrame([(1.0, "u", 0), (2.0, "v", 1), (None, None, 1)], "`x.y` double, `a``b.c` string, `l.l` int")
    num, text, label = df.columns
    assert [r.missing for r in P.null_counts(df).collect()] == [1, 1, 0]
    assert P.describe(df, [num]).first().mean == 1.5 and P.numeric_table(df).count() == 2
    assert P.categorical_table(df).first().unique_values == 3 and P.column_info(df).count() == 3
    assert P.value_counts(df, text).count() == 2 and P.value_share(df, text).count() == 2
    assert P.mode(df, num).first()[0] == 1.0 and P.mode_long(df, [num, text]).count() == 2
    assert P.category_share_by_class(df, text, label).count() == 2 and P.imbalance_ratio(df, label).first().ratio == 2.0
    assert P.positive_rate(df, label).first()[1] == 3 and P.tukey_counts(df, [num]).first().n_outliers == 0
    assert P.box_data(df, [num]).first().median == 1.5 and P.quantile_table(df, [num], [0.5]).first().value == 1.5
    assert P.sort_desc(df, num, text).count() == 3 and P.sorted_distinct(df, num).count() == 2
    assert P.distinct_values(df, [text]).first()["count"] == 3 and C.winsor_bounds(df, [num], only_affected=False).count() == 1
    assert C.target_check(df, label).count() == 2
    assert H.adaptive_distribution(df, [num, text]).count() == 4
