"""Property tests for the model layer (not SQL-expressible: seeded / iterative)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.operators import bayes as NB
from tabsmith.operators import evaluate as EV
from tabsmith.operators import forests as FO
from tabsmith.operators import growth as GR
from tabsmith.operators import logistic as LG
from tabsmith.operators import models as MD
from tabsmith.operators import split as SP
from tabsmith.plans import model_data as MDATA
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def mt(spark):
    return MDATA.model_table(spark, SF_SMALL)


@pytest.fixture(scope="module")
def asm(mt):
    return MDATA.assembled(mt).select("id", "label", "features")


def test_model_table_shape(mt):
    assert mt.columns == ["id", "label"] + MDATA.FEATURES
    assert mt.where(F.col("label").isin(0, 1)).count() == mt.count()


def test_lr_penalised_gradient_is_zero(spark, asm):
    """C-form objective: C·Σ logloss + ½‖w‖² has zero gradient at the solution."""
    n = asm.count()
    m = MD.fit_model(MD.logistic_regression(1.0, tol=1e-10), asm, n)
    rows = asm.collect()
    X = np.array([r["features"].toArray() for r in rows])
    y = np.array([r["label"] for r in rows], dtype=float)
    w, b = m.coefficients.toArray(), m.intercept
    p = 1.0 / (1.0 + np.exp(-(X @ w + b)))
    grad_w = X.T @ (p - y) + w          # C = 1
    grad_b = np.sum(p - y)
    scale = np.abs(X.T @ y).max()
    assert np.abs(grad_w).max() / scale < 1e-3 and abs(grad_b) / len(y) < 1e-3


def test_rf_importances_sum_to_one_and_repeat(spark, asm):
    spec = MD.random_forest(20, 8, 1, False)
    a = MD.fit_model(spec, asm).featureImportances.toArray()
    b = MD.fit_model(spec, asm).featureImportances.toArray()
    assert a.sum() == pytest.approx(1.0) and np.allclose(a, b)
    imp = MD.feature_importance(MD.fit_model(spec, asm), MDATA.FEATURES, spark).collect()
    assert [r["rank"] for r in imp] == list(range(1, len(MDATA.FEATURES) + 1))


def test_save_load_scores_identical(spark, mt, tmp_path):
    spec = MD.random_forest(10, 5, 1, True)
    d = MDATA.assembled(mt)
    model = MD.fit_model(spec, d)
    pm = MD.save_pipeline(model, MDATA.FEATURES, str(tmp_path / "rf"))
    back = MD.load_pipeline(str(tmp_path / "rf"))
    a = pm.transform(mt).select("id", "prediction", "probability").orderBy("id").collect()
    b = back.transform(mt).select("id", "prediction", "probability").orderBy("id").collect()
    assert a == b
    assert back.stages[0].getInputCols() == MDATA.FEATURES


def test_sparkml_gaussian_nb_matches_sql_fit(spark, mt, asm):
    m = MD.fit_model(MD.gaussian_nb(), asm)
    sql = {(r["class"], r["feature"]): r for r in NB.gaussian_nb_fit(mt, MDATA.FEATURES).collect()}
    theta = m.theta.toArray()
    sigma = m.sigma.toArray()
    for k in (0, 1):
        for i, f in enumerate(MDATA.FEATURES):
            assert theta[k, i] == pytest.approx(sql[(k, f)]["mean"], abs=1e-9)
            assert sigma[k, i] == pytest.approx(sql[(k, f)]["var"], rel=1e-6, abs=1e-9)


@pytest.mark.parametrize("kind", NB.KINDS)
def test_one_pass_nb_cv_equals_per_fold_fits(spark, mt, kind):
    """Fold-complement statistics give the model that a fit on the other folds gives."""
    f = MDATA.with_folds(mt, 5)
    if kind == "multinomial":
        f = f.withColumns({c: F.abs(F.col(c)) for c in MDATA.FEATURES})
    fast = {r["id"]: r for r in NB.cross_validate(f, MDATA.FEATURES, kind).collect()}
    for k in (0, 3):
        tr, te = f.where(F.col("fold") != k), f.where(F.col("fold") == k)
        for r in NB.score(te, NB.fit(tr, MDATA.FEATURES, kind), MDATA.FEATURES).collect():
            assert r["prediction"] == fast[r["id"]]["prediction"]
            assert r["score"] == pytest.approx(fast[r["id"]]["score"], abs=1e-9)


@pytest.mark.parametrize("kind,scaler", [("gaussian", "standard"), ("multinomial", "minmax")])
def test_fold_scaled_nb_equals_scaling_each_training_part(spark, kind, scaler):
    """Affine statistics equal a scaler and a model fitted on each training part in turn."""
    from tabsmith.operators import features as FE
    rng = np.random.default_rng(8)
    rows = [(i, i % 2, i % 4, float(rng.normal() + i % 2), float(rng.integers(0, 9)), 3.0) for i in range(200)]
    rows.append((999, 1, 2, 50.0, -20.0, 3.0))          # both extremes of one fold
    df = spark.createDataFrame(rows, "id int, label int, fold int, a double, b double, same double")
    cols = ["a", "b", "same"]
    fast = {r["id"]: r for r in NB.cross_validate(df, cols, kind, scale=cols, scaler=scaler).collect()} if kind == "gaussian" else None
    fit = FE.standardize if scaler == "standard" else FE.minmax_scale
    stats = FE.standard_stats if scaler == "standard" else FE.minmax_stats
    scalers = FE.fold_scalers(df, cols, "fold", scaler)
    for k in range(4):
        tr, te = df.where(F.col("fold") != k), df.where(F.col("fold") == k)
        st = stats(tr, cols)
        want = {r["id"]: r for r in fit(te, cols, st).collect()}
        for r in FE.scale_by_fold(te, scalers).collect():
            assert all(r[c] == pytest.approx(want[r["id"]][c], abs=1e-12) for c in cols)
        models = NB.fit(fit(tr, cols, st), cols, kind)
        both = NB.fit(df, cols, kind, fold_col="fold", scalers=scalers)[k]
        assert np.allclose(both.constant, models[None].constant) and np.allclose(both.factor, models[None].factor)
        if fast:
            for r in NB.score(fit(te, cols, st), models, cols).collect():
                assert r["score"] == pytest.approx(fast[r["id"]]["score"], abs=1e-9)
    with pytest.raises(ValueError):
        NB.fit(df, cols, "bernoulli", fold_col="fold", scalers=scalers)


def test_nb_edges(spark):
    df = spark.createDataFrame([(1, 0, 0, 1.0, 0.0), (2, 1, 0, 0.0, 2.0), (3, 0, 1, 2.0, 0.0), (4, 1, 1, 0.0, 3.0), (5, None, 1, 9.0, 9.0),
                                (6, 2, 0, None, 1.0)], "id int, label int, fold int, a double, b double")
    for kind in NB.KINDS:
        got = {r["id"]: r for r in NB.cross_validate(df, ["a", "b"], kind, keep=("id",)).collect()}
        assert set(got) == {1, 2, 3, 4, 5, 6}
        # class 2 is only in fold 0: its own model never predicts it
        assert {got[i]["prediction"] for i in (1, 2)} <= {0, 1} and all(got[i]["score"] == 0 for i in (1, 2))
    with pytest.raises(Exception, match="negative value in b"):
        NB.fit(df.withColumn("b", -F.col("b")), ["a", "b"], "multinomial")
    with pytest.raises(ValueError):
        NB.fit(df, ["a"], "other")
    assert NB.fit(df.limit(0), ["a", "b"]) == {}


def test_nb_compare_flags_one(spark, mt):
    f = MDATA.with_folds(mt, 3)
    rows = NB.compare({k: NB.cross_validate(f, MDATA.FEATURES, k) for k in ("gaussian", "bernoulli")}).collect()
    assert len(rows) == 2 and sum(r["is_best"] for r in rows) == 1
    assert max(rows, key=lambda r: r["auc_mean"])["is_best"]


def test_newton_folds_agree_with_spark_ml(spark, mt):
    """Every fold's coefficients equal a solver run on the other folds; the models are optimal by SQL sums."""
    d = MDATA.with_folds(mt, 4).cache()
    models = LG.fit(d, MDATA.FEATURES, fold_col="fold")
    rows = {r["fold"]: r for r in models.collect()}
    assert set(rows) == {0, 1, 2, 3} and all(r["gradient"] < 1e-10 and r["iterations"] < 20 for r in rows.values())
    for k in (0, 2):
        m = MD.fit_model(MD.logistic_regression(1.0, tol=1e-13), MDATA.assembled(d).where(F.col("fold") != k))
        assert np.abs(m.coefficients.toArray() - np.array(rows[k]["coefficients"])).max() < 1e-6
        assert abs(m.intercept - rows[k]["intercept"]) < 1e-6
    for r in LG.gradients(d, models, MDATA.FEATURES).collect():
        assert r["n_train"] == rows[r["fold"]]["n_train"]
        assert abs(r["expected"] - r["positives"]) < 1e-6 and r["gradient"] < 1e-9
    whole = LG.fit(d, MDATA.FEATURES)
    m = MD.fit_model(MD.logistic_regression(1.0, tol=1e-13), MDATA.assembled(d))
    got = LG.importance(whole, MDATA.FEATURES).orderBy("rank").collect()
    assert [r["feature"] for r in got] == [MDATA.FEATURES[i] for i in np.argsort(-np.abs(m.coefficients.toArray()), kind="stable")]
    a = {r["id"]: r["score"] for r in MD._score_cols(m.transform(MDATA.assembled(d)), ["id"]).collect()}
    assert all(abs(r["score"] - a[r["id"]]) < 1e-6 for r in LG.score(d, whole, MDATA.FEATURES).collect())
    d.unpersist()


def test_newton_edges(spark):
    rows = [(i, i % 2, i % 3, float(i % 2) * 1e3 + i % 5, 7.0, 1e-3 * i) for i in range(40)]
    rows += [(90, None, 0, 1.0, 7.0, 0.0), (91, 1, 0, None, 7.0, 0.0), (92, 0, 1, float("nan"), 7.0, 0.0)]
    df = spark.createDataFrame(rows, "id int, label int, fold int, a double, same double, c double")
    feats = ["a", "same", "c"]
    models = LG.fit(df, feats, fold_col="fold")       # separable, with a constant feature
    assert all(r["gradient"] < 1e-6 and np.isfinite(r["coefficients"]).all() for r in models.collect())
    got = {r["id"]: r for r in LG.score(df, models, feats, ["id", "fold"], "fold").collect()}
    assert len(got) == len(rows) and got[91]["score"] is None and got[92]["prediction"] is None
    assert LG.fit(df.limit(0), feats).collect() == [] and LG.fit(df.where("fold = 1"), feats, fold_col="fold").collect() == []
    one = LG.fit(df.where("label = 1"), feats).first()          # one class: the loss falls without end, slowly
    assert np.isfinite(one["intercept"])


def test_cross_validate_metrics_shape(spark, mt):
    d = MDATA.assembled(MDATA.with_folds(mt, 3))
    m, oof = MD.cross_validate(d, MD.gaussian_nb(), parallelism=3)
    rows = m.collect()
    assert len(rows) == 3 and all(0.0 <= r["auc"] <= 1.0 for r in rows)
    assert oof.count() == mt.count() and oof.select("id").distinct().count() == mt.count()


def test_rf_learns_signal(spark, mt):
    d = SP.holdout(MDATA.assembled(mt), "label", "id", 0.2, 42)
    _, _, metrics = MD.holdout_evaluate(d, MD.random_forest(30, 8, 1, True))
    assert metrics.collect()[0]["auc"] > 0.7


@pytest.fixture(scope="module")
def grown(spark, mt):
    d = MDATA.assembled(SP.kfold(mt, "label", "id", 3, shuffle=False)).select("id", "label", "fold", "features").cache()
    spec = MD.random_forest(12, None, 2, False, depth_cap=FO.FULL_DEPTH)
    return d, MD.fit_model(spec, d.where("fold <> 0"))


@pytest.mark.parametrize("depth", [1, 4, 9])
def test_cut_forest_equals_grown_forest(spark, grown, depth):
    """A full forest cut at a depth scores as the forest of equal seed that was grown to it."""
    d, full = grown
    test = d.where("fold = 0")
    direct = MD.fit_model(MD.random_forest(12, depth, 2, False), d.where("fold <> 0"))
    want = {r["id"]: r["score"] for r in MD._score_cols(direct.transform(test), ["id"]).collect()}
    got = FO.cut_scores(full, test, [FO.Cut(12, depth), FO.Cut(12)], ["id"]).collect()
    assert len(got) == len(want) and all(abs(r["scores"][0] - want[r["id"]]) < 1e-12 for r in got)
    whole = {r["id"]: r["score"] for r in MD._score_cols(full.transform(test), ["id"]).collect()}
    assert all(abs(r["scores"][1] - whole[r["id"]]) < 1e-12 for r in got)


def test_cut_forest_brute(spark, grown):
    """Tree counts, depths and minimum splits against a walk down the node table."""
    d, full = grown
    nodes = {}
    for r in FO.node_table(full).collect():
        nodes.setdefault(r["tree"], {})[r["id"]] = r
    split = {(r["tree"], r["id"]): (r["f"], r["t"]) for r in spark.read.parquet(
        FO.node_table(full).inputFiles()[0].rsplit("/", 1)[0]).selectExpr(
        "treeID AS tree", "nodeData.id AS id", "nodeData.split.featureIndex AS f",
        "get(nodeData.split.leftCategoriesOrThreshold, 0) AS t").collect()}
    cuts = [FO.Cut(t, depth, s) for t in (1, 5, 12) for depth in (2, None) for s in (2, 40)]

    def leaf(tree, at, level, cut):
        """(probability, predicted class or None) below a node, merged like spark.ml merges."""
        n = nodes[tree][at]
        if n["left"] < 0 or n["n"] < cut.min_split or (cut.depth is not None and level >= cut.depth):
            return n["prediction"]
        a, b = leaf(tree, n["left"], level + 1, cut), leaf(tree, n["right"], level + 1, cut)
        return n["prediction"] if a is not None and a == b else None

    def walk(tree, x, cut):
        at, level = 0, 0
        while leaf(tree, at, level, cut) is None:
            n = nodes[tree][at]
            f, t = split[(tree, at)]
            at, level = (n["left"] if x[f] <= t else n["right"]), level + 1
        return nodes[tree][at]["p"]

    test = d.where("fold = 0").limit(25).cache()
    got = {r["id"]: r["scores"] for r in FO.cut_scores(full, test, cuts, ["id"]).collect()}
    for r in test.collect():
        x = r["features"].toArray()
        for cut, s in zip(cuts, got[r["id"]]):
            assert s == pytest.approx(sum(walk(t, x, cut) for t in range(cut.trees)) / cut.trees, abs=1e-12)
    with pytest.raises(ValueError):
        FO.cut_scores(full, test, [FO.Cut(13)], ["id"])
    assert FO.cut_scores(full, test.limit(0), cuts, ["id"]).collect() == []


def test_grid_search_rows_and_best(spark, grown):
    d, _ = grown
    res, best = FO.grid_search(d, (3, 6), (2, None), (2, 30), (1, 4), refit=True)
    rows = res.collect()
    assert len(rows) == 16 and sum(r["is_best"] for r in rows) == 1
    top = max(rows, key=lambda r: r["auc_mean"])
    flagged = next(r for r in rows if r["is_best"])
    assert flagged["auc_mean"] == top["auc_mean"] and best.cut.trees == flagged["n_trees"]
    # one setting the long way: grow, cut, score, average over the folds
    pick = next(r for r in rows if (r["n_trees"], r["max_depth"], r["min_split"], r["min_leaf"]) == (6, None, 30, 4))
    aucs = []
    for k in (0, 1, 2):
        m = MD.fit_model(MD.random_forest(6, None, 4, False, depth_cap=FO.FULL_DEPTH), MD.ml_ready(d).where(F.col("fold") != k))
        s = FO.CutForest(m, FO.Cut(6, None, 30)).score(d.where(F.col("fold") == k))
        aucs.append(EV.auc(s).first()[0])
    assert pick["auc_mean"] == pytest.approx(sum(aucs) / 3, abs=0.02)
    assert best.score(d).count() == d.count()


def test_large_tables_are_dealt_by_rows_not_by_files(spark, tmp_path, monkeypatch):
    """One file of one row group is one task's rows, however many splits it has."""
    monkeypatch.setattr(MD, "PARTITION_ROWS", 1000)
    spark.range(0, 9000, 1, 1).selectExpr("id", "repeat(sha2(string(id), 512), 40) AS t").write.parquet(str(tmp_path / "one"))
    for deal in (MD.ml_ready, MD.dealt):
        out = deal(spark.read.parquet(str(tmp_path / "one")))
        sizes = out.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert sum(sizes) == 9000 and len(sizes) == 9 and max(sizes) <= 1100
        assert out.select("id").distinct().count() == 9000


def _nodes(forest):
    return {r["tree"]: r.asDict() for r in forest.trees.collect()}


def test_forest_is_the_same_wherever_nodes_are_split(spark, asm, monkeypatch):
    """Nodes counted over all partitions, rows moved in several turns, or whole trees in one task: the same trees."""
    spec = MD.random_forest(5, None, 2, True, seed=-7)
    want = _nodes(MD.fit_model(spec, asm))
    monkeypatch.setattr(GR, "TASK_ROWS", 150)
    monkeypatch.setattr(GR, "MOVED_ROWS", 2000)
    monkeypatch.setattr(GR, "COUNTED_NODES", 6)
    assert _nodes(MD.fit_model(spec, asm)) == want and len(want) == 5


def test_deep_forest_needs_few_jobs(spark, asm):
    """Levels are finished inside tasks: 30 of them are not 30 passes over the data."""
    sc = spark.sparkContext
    sc.setJobGroup("deep forest", "deep forest")
    model = MD.fit_model(MD.random_forest(4, None, 1, False), asm)
    jobs = sc.statusTracker().getJobIdsForGroup("deep forest")
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert model.depth > 12 and len(jobs) < 12


def test_subtree_splits_by_brute_force():
    rng = np.random.default_rng(2)
    x, y, w = rng.integers(0, 9, (300, 3)).astype(np.uint8), rng.integers(0, 3, 300).astype(np.uint8), rng.integers(1, 4, 300)
    s = GR.Settings(1, 6, 5, 9, 2, (1.0, 2.5, 0.5), 11, 1.0)
    heap, feature, cut, total = GR.finish(x, y, w.astype(np.uint8), 1, 0, s)
    at = {int(h): i for i, h in enumerate(heap)}

    def gini(rows):
        t = np.bincount(y[rows], w[rows], 3) * s.weights
        return t.sum(), 1 - ((t / t.sum()) ** 2).sum()

    def check(h, rows):
        i = at[h]
        assert total[i].tolist() == np.bincount(y[rows], w[rows], 3).tolist()
        best = []
        for f in GR.tried(s, 0, np.array([h]), 3)[0]:
            for c in range(8):
                a, b = rows[x[rows, f] <= c], rows[x[rows, f] > c]
                if w[a].sum() >= 5 and w[b].sum() >= 5:
                    (n, g), (m, k) = gini(a), gini(b)
                    best.append((gini(rows)[1] - (n * g + m * k) / (n + m), f, c))
        top = max((g for g, *_ in best), default=0)
        if h.bit_length() - 1 == s.depth or top < 1e-12:
            assert feature[i] == -1
            return 1
        assert any(abs(g - top) < 1e-12 and (f, c) == (feature[i], cut[i]) for g, f, c in best)
        right = x[rows, feature[i]] > cut[i]
        return 1 + check(2 * h, rows[~right]) + check(2 * h + 1, rows[right])

    assert check(1, np.arange(300)) == len(heap) > 20


def test_forest_edges(spark):
    from pyspark.ml.linalg import Vectors
    one = spark.createDataFrame([(0, 0, Vectors.dense([1.0, 2.0]))], ["id", "label", "features"])
    model = MD.fit_model(MD.random_forest(4, 3, 1, True), one)          # some bootstraps are empty
    assert len(_nodes(model)) == 4 and model.totalNumNodes == 4 and model.featureImportances.toArray().sum() == 0
    assert [r["scores"] for r in FO.cut_scores(model, one, [FO.Cut(2), FO.Cut(4)], ["id"]).collect()] == [[0.0, 0.0]]
    for bad in ([(0, None, Vectors.dense([1.0]))], [(0, 0.5, Vectors.dense([1.0]))], [(0, 1.0, Vectors.dense([float("nan")]))]):
        rows = [(1, 1.0, Vectors.dense([1.0])), *bad]
        with pytest.raises(Exception):
            MD.fit_model(MD.random_forest(2, 3), spark.createDataFrame(rows, ["id", "label", "features"]))


def test_forest_as_spark_model_scores_the_same(spark, grown):
    d, full = grown
    test = d.where("fold = 0")
    want = {r["id"]: r["score"] for r in MD._score_cols(full.spark_model().transform(test), ["id"]).collect()}
    got = {r["id"]: r["score"] for r in MD.scored_by(full, test, ["id"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert np.allclose(full.spark_model().featureImportances.toArray(), full.featureImportances.toArray())


def test_auc_of_lists_equals_auc(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 2)) if i % 17 else None, i % 3, [float(rng.integers(-3, 4)), rng.random() ** 4, rng.normal()])
            for i in range(800)]
    rows += [(1, 0, [float("nan"), 0.0, -0.0]), (0, None, [1.0, 0.0, -0.0]), (1, None, [0.5, 0.0, -0.0])]
    d = spark.createDataFrame(rows, "label int, fold int, scores array<double>")
    long = d.select("label", "fold", F.posexplode("scores").alias("place", "score"))
    want = {(r["fold"], r["place"]): r["auc"] for r in EV.auc(long, "label", "score", 1, ["fold", "place"]).collect()}
    for rows_of_a_range in (EV.LIST_RANGE, 10):
        monkeypatch.setattr(EV, "LIST_RANGE", rows_of_a_range)
        got = {(r["fold"], r["place"]): r["auc"] for r in EV.auc_of_lists(d, "label", "scores", 1, "fold").collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
