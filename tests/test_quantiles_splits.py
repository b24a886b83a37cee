"""Exact quantiles, ranks over ranges and exact stratified splits."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.operators import quantiles as Q
from tabsmith.operators import rank as RK
from tabsmith.operators import split as SP


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(7)
    vals = [5.0] * 3000 + [rnd.gauss(0, 100) for _ in range(5000)] + [float(i) for i in range(1000)]
    return spark.createDataFrame([(v,) for v in vals], "x double")


def interpolated(values, p):
    v = np.sort(np.array(values, float))
    h = (len(v) - 1) * p
    lo, hi = int(np.floor(h)), int(np.ceil(h))
    return v[lo] if v[lo] == v[hi] else (hi - h) * v[lo] + (h - lo) * v[hi]


@pytest.mark.parametrize("probs", [[0.01, 0.25, 0.5, 0.75, 0.99], [0.0, 1.0], [0.3333]])
@pytest.mark.parametrize("setting", [{}, {"sketch_k": 8, "margin": 0.0}, {"sketch_k": 8, "margin": 0.2}])
def test_quantiles_equal_sorted_values(spark, skewed, probs, setting):
    """Exact whatever the sketch: poor sketches only make the counted slices thicker."""
    values = [r.x for r in skewed.collect()]
    got = Q.quantiles(skewed.withColumn("a.b", -F.col("x")), ["x", "a.b"], probs, **setting)
    for p in probs:
        assert got["x"][p] == pytest.approx(interpolated(values, p), rel=1e-12, abs=1e-12)
        assert got["a.b"][p] == pytest.approx(interpolated([-v for v in values], p), rel=1e-12, abs=1e-12)


def test_quantiles_of_many_columns_take_three_scans(spark, collected_plans):
    """No more jobs for more columns."""
    rng = random.Random(3)
    rows = [tuple(rng.gauss(0, 1) for _ in range(12)) for _ in range(3000)]
    names = [f"c{i}" for i in range(12)]
    df = spark.createDataFrame(rows, names)
    with collected_plans(df) as seen:
        got = Q.quantiles(df, names, [0.1, 0.5, 0.9])
    for i, c in enumerate(names):
        assert got[c][0.5] == pytest.approx(interpolated([r[i] for r in rows], 0.5))
    assert len(seen) <= 3


def test_quantile_row_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None, -0.0), (3.0, None, 0.0), (float("nan"), None, 0.0)], "x double, y double, z double")
    row = Q.quantile_row(df, ["x", "y", "z"], [0.5, 1.0]).collect()[0]
    assert row["x"] == [2.0, 3.0] and row["y"] == [None, None] and row["z"] == [0.0, 0.0]
    assert Q.quantiles(df.limit(0), ["x"], [0.5]) == {"x": {0.5: None}}


@pytest.mark.parametrize("range_rows", [7, 100_000])
def test_global_rank_any_type(spark, range_rows):
    """Ranks over ranges equal a sort: text, dates, NULL keys and groups, ties, a hot group."""
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice(["é", "Z", "a", None, "zz"]), i % 11, i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, `k.1` string, d int, id int").repartition(5)
    got = RK.global_rank(df, [F.col("`k.1`").desc_nulls_last(), "d", "id"], ["g"], "place", range_rows).collect()
    want = {}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, [-b for b in (r[1] or "").encode()] + [1], r[2], r[3]))
        want.update({r[3]: i for i, r in enumerate(mine, 1)})
    assert {r.id: r.place for r in got} == want and got[0].__fields__ == ["g", "k.1", "d", "id", "place"]
    # ties only: every rank once
    ties = RK.global_rank(df.select("g", F.lit(1).alias("same")), ["same"], [], "place", range_rows).collect()
    assert sorted(r.place for r in ties) == list(range(1, 601))
    sums = RK.running_sum(df, ["id"], [], F.when(F.col("d") > 5, F.col("d")), "upto", range_rows).orderBy("id").collect()
    total = 0
    for r in sums:
        total += r.d if r.d > 5 else 0
        assert r.upto == total
    assert RK.global_rank(df.limit(0), ["id"]).collect() == []


def test_rank_has_no_window_over_a_group(spark):
    df = spark.createDataFrame([(i % 3, str(i)) for i in range(500)], "g int, k string")
    from tabsmith.operators import features as FE
    plans = [RK.global_rank(df, ["k"], ["g"], range_rows=50), RK.global_rank(df, ["k"], range_rows=50),
             FE.encoding_mapping(df.withColumn("k", F.col("k")), ["k"]), SP.kfold(df, "g", "k", 3, shuffle=False)]
    for plan in plans:
        text = plan._jdf.queryExecution().analyzed().toString()
        assert "Window" not in text or "__range" in text


def test_text_keys_split_unshuffled(spark):
    df = spark.createDataFrame([(f"k{i:04d}", i % 2) for i in range(90)], "id string, label int")
    got = {r.id: r.fold for r in SP.kfold(df, "label", "id", 3, shuffle=False).collect()}
    assert all(got[f"k{i:04d}"] == (i // 2) % 3 for i in range(90))


def _frame(spark):
    rows = [(i, 1 if i % 9 == 0 else 0) for i in range(5003)]
    return spark.createDataFrame(rows, "id long, label int")


def test_kfold_disjoint_complete_balanced(spark):
    f = SP.kfold(_frame(spark), "label", "id", 10, 42)
    assert f.count() == 5003 and f.select("id").distinct().count() == 5003
    sizes = f.groupBy("label", "fold").count().groupBy("label").agg(
        (F.max("count") - F.min("count")).alias("spread")).collect()
    assert all(r["spread"] <= 1 for r in sizes)


def test_kfold_deterministic_and_digit_independent(spark):
    a = SP.kfold(_frame(spark), "label", "id", 5, 42, digits=1)
    b = SP.kfold(_frame(spark), "label", "id", 5, 42, digits=3)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_holdout_exact_proportions(spark):
    h = SP.holdout(_frame(spark), "label", "id", 0.2, 42)
    c = {(r["label"], r["is_test"]): r["count"] for r in h.groupBy("label", "is_test").count().collect()}
    n1 = c[(1, True)] + c[(1, False)]
    n0 = c[(0, True)] + c[(0, False)]
    assert c[(1, True)] == int(n1 * 0.2 + 0.5) and c[(0, True)] == int(n0 * 0.2 + 0.5)


def test_unshuffled_folds_follow_key(spark):
    f = SP.kfold(_frame(spark), "label", "id", 3, shuffle=False).where("label = 0").orderBy("id")
    folds = [r["fold"] for r in f.limit(6).collect()]
    assert folds == [0, 1, 2, 0, 1, 2]


def test_unshuffled_rank_with_clustered_keys(spark):
    # keys clustered at both ends: quantile ranges keep the buckets even, and the
    # two-level rank equals a one-level row_number by key
    from pyspark.sql import Window
    keys = list(range(4000)) + [10**9 + i for i in range(3)] + [10**12 + i for i in range(1000)]
    df = spark.createDataFrame([(k, 1 if k % 7 == 0 else 0) for k in keys], "id long, label int")
    a = SP.stratified_rank(df, "label", "id", shuffle=False, digits=1).select("id", "__rank")
    b = df.select("id", F.row_number().over(Window.partitionBy("label").orderBy("id")).alias("__rank"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_top_k_per_group_hot_group_equals_one_level(spark):
    # group "a" holds most rows; the limited window (partial top-k per map
    # task) equals a plain row_number over the whole group, ties included
    from pyspark.sql import Window
    from tabsmith.operators import profile as P
    rows = [("a", i, float(i % 97)) for i in range(6000)] + [("b", i, float(i % 5)) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, k long, v double")
    a = P.top_k_per_group(df.repartition(8), "g", "v", 7, "k")
    assert "WindowGroupLimit" in a._jdf.queryExecution().executedPlan().toString()
    w = Window.partitionBy("g").orderBy(F.desc("v"), F.asc("k"))
    b = df.withColumn("rank", F.row_number().over(w)).where("rank <= 7")
    assert a.count() == 14 and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_quantiles_with_infinite_values(spark):
    vals = [float(i) for i in range(800)] + [float("inf")] * 200 + [float("-inf")] * 10
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = Q.quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.9], sketch_k=8)["x"]
    assert got == {0.0: float("-inf"), 0.25: interpolated(vals, 0.25), 0.5: interpolated(vals, 0.5), 0.9: float("inf")}


def test_split_keeps_rows_without_label_or_key(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, None), (None, 1)], "id long, label int")
    for shuffle in (True, False):
        assert SP.kfold(df, "label", "id", 2, shuffle=shuffle).count() == 4
    assert SP.holdout(df, "label", "id").count() == 4


def test_counting_pass_unpivots_no_rows(spark, collected_plans):
    """Only the last pass, over the open slices, may generate rows, and picks them first."""
    rng = np.random.default_rng(5)
    rows = [(float(a) if a > -2 else None, float(b)) for a, b in rng.normal(size=(4000, 2))]
    df = spark.createDataFrame(rows, "a double, b double")
    with collected_plans(df) as plans:
        got = Q.quantiles(df, ["a", "b"], [0.25, 0.5, 0.75])
    made = [p for p in plans if "Generate" in p]
    assert len(plans) >= 3 and all("filter(" in p for p in made) and len(made) <= 1
    for c, k in (("a", 0), ("b", 1)):
        want = np.quantile([r[k] for r in rows if r[k] is not None], [0.25, 0.5, 0.75])
        assert np.allclose([got[c][p] for p in (0.25, 0.5, 0.75)], want, rtol=1e-12)
