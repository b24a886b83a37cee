"""Hand-made edge frames: NULLs, NaN, empty tables, constants, ties, markers."""

import math

import pytest
from pyspark.sql import functions as F

from tabsmith.operators import clean as C
from tabsmith.operators import evaluate as EV
from tabsmith.operators import features as FE
from tabsmith.operators import histogram as H
from tabsmith.operators import missing as M
from tabsmith.operators import profile as P


def test_all_null_columns(spark):
    df = spark.createDataFrame([(i, None, None) for i in range(5)], "id int, s string, d double")
    ct = P.categorical_table(df, ["s"]).collect()[0]
    assert ct["most_common"] == "N/A" and ct["most_common_count"] == 0 and ct["unique_values"] == 1
    assert ct["missing_pct"] == 100.0
    d = P.describe(df, ["d"]).collect()[0]
    assert d["count"] == 0 and d["mean"] is None and d["p50"] is None
    nc = {r["column_name"]: r["missing_pct"] for r in P.null_counts(df).collect()}
    assert nc["s"] == 100.0 and nc["d"] == 100.0 and nc["id"] == 0.0


def test_empty_table_no_division_error(spark):
    df = spark.createDataFrame([], "a double, b string, label int, prediction int, score double")
    assert P.shape(df).collect()[0]["n_rows"] == 0
    r = M.missing_report(df).collect()
    assert all(x["missing_percentage"] is None for x in r)
    assert C.cleaning_summary(df, []).collect()[0]["retention_rate"] is None
    assert P.null_counts(df).where("missing_pct IS NOT NULL").count() == 0
    m = EV.classification_metrics(df).collect()
    assert len(m) == 1 and m[0]["accuracy"] is None and m[0]["auc"] is None


def test_constant_column(spark):
    df = spark.createDataFrame([(i, 3.0) for i in range(5)], "id int, x double")
    assert {r["x"] for r in FE.standardize(df, ["x"]).collect()} == {0.0}
    assert {r["x"] for r in FE.minmax_scale(df, ["x"]).collect()} == {0.0}
    h = H.histogram(df, "x", 30).collect()
    assert len(h) == 30 and sum(r["count"] for r in h) == 5
    hit = [r for r in h if r["count"] == 5][0]
    assert hit["lower"] <= 3.0 < hit["upper"]


def test_tied_mode_takes_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("a",), ("b",)], "v string")
    assert P.mode(df, "v").collect()[0]["mode"] == "a"
    assert P.mode_long(df, ["v"]).collect()[0]["mode"] == "a"


def test_nan_next_to_null(spark):
    df = spark.createDataFrame([(1, 5.0), (2, float("nan")), (3, None), (4, -1.0)], "id int, x double")
    kept = {r["id"] for r in C.apply_rules(df, [C.ge("x", 0)]).collect()}
    assert kept == {1}
    audit = C.rule_audit(df, [C.ge("x", 0)]).collect()[0]
    assert audit["records_removed"] == 3
    clipped = {r["id"]: r["x"] for r in df.select("id", C.clip("x", 0.0, 2.0).alias("x")).collect()}
    assert math.isnan(clipped[2]) and clipped[3] is None and clipped[1] == 2.0 and clipped[4] == 0.0
    from tabsmith.functions import normalize_nan
    d = P.describe(normalize_nan(df), ["x"]).collect()[0]
    assert d["count"] == 2 and d["max"] == 5.0


def test_markers_on_parquet_input(spark):
    vals = ["unknown", "Unknown", "?", "", "NaN", "N/A", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    rows = M.missing_types(df).collect()
    mt = {r["missing_type"]: r["count"] for r in rows}
    assert len(rows) == len(mt) and mt["NaN"] == 2       # NULL and the text
    for m in ["unknown", "Unknown", "?", ""]:
        assert mt[m] == 1
    tot = M.missing_report(df).collect()[0]
    assert tot["total_missing"] == 7 and tot["recommendation"] == "model_impute_or_drop_column"


@pytest.mark.parametrize("scores,expected", [
    ([0.1, 0.2, 0.3, 0.7, 0.8, 0.9], 1.0),
    ([0.5] * 6, 0.5),
])
def test_auc_perfect_and_tied(spark, scores, expected):
    labels = [0, 0, 0, 1, 1, 1]
    df = spark.createDataFrame([(l, int(s >= 0.5), s) for l, s in zip(labels, scores)],
                               "label int, prediction int, score double")
    assert math.isclose(EV.auc(df).collect()[0]["auc"], expected)
    roc = EV.roc_curve(df).orderBy("fpr", "tpr").collect()
    assert roc[0]["fpr"] == 0.0 and roc[0]["tpr"] == 0.0 and math.isinf(roc[0]["threshold"])
    assert roc[-1]["fpr"] == 1.0 and roc[-1]["tpr"] == 1.0
    pr = EV.pr_curve(df).collect()
    assert any(r["threshold"] is None and r["recall"] == 0.0 and r["precision"] == 1.0 for r in pr)


def test_single_class_never_predicted(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (0, 0, 0.2), (0, 0, 0.3), (0, 0, 0.4)],
                               "label int, prediction int, score double")
    m = EV.classification_metrics(df, score=None).collect()[0]
    assert m["precision"] == 0.0 and m["recall"] == 0.0 and m["f1"] == 0.0 and m["accuracy"] == 1.0
    rep = {r["class_label"]: r for r in EV.classification_report(df).collect()}
    assert rep["1"]["support"] == 0 and rep["1"]["precision"] == 0.0
    assert EV.auc(df).collect()[0]["auc"] is None


def test_unseen_category_strict(spark):
    train = spark.createDataFrame([("a",), ("b",)], "v string")
    enc = FE.LabelEncoder.fit(train, ["v"])
    test = spark.createDataFrame([("a",), ("c",), (None,)], "v string")
    with pytest.raises(Exception):
        enc.transform(test).collect()
    loose = {r["v"] for r in enc.transform(test, strict=False).collect()}
    assert loose == {0, None}
    codes = enc.transform(train)
    back = {r["v_decoded"] for r in enc.inverse(codes, ["v"]).collect()}
    assert back == {"a", "b"}


def test_missing_encodes_as_nan_class(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "v string")
    m = {r["value"]: r["code"] for r in FE.encoding_mapping(df, ["v"]).collect()}
    assert m == {"a": 0, "b": 1, "nan": 2}


def test_policy_mode_after_drop(spark):
    rows = [("unknown", "x"), ("unknown", "x"), ("unknown", "x"), ("j", "y"), ("j", "unknown"), ("k", "z"),
            ("k", "y")]
    df = spark.createDataFrame(rows, "job string, education string")
    clean, audit = M.apply_policy(df, [M.Step("job", "drop_rows"), M.Step("education", "fill_mode")])
    # 'x' is the mode of the raw column but its rows are dropped first
    assert sorted(r["education"] for r in clean.collect()) == ["y", "y", "y", "z"]
    a = {r["column_name"]: r for r in audit.collect()}
    assert a["job"]["affected"] == 3 and a["education"]["affected"] == 1
    assert a["education"]["fill_value"] == "y"


def test_rule_audit_equals_sequential(spark, ):
    from tests.conftest import SF_MID
    from tabsmith.plans.contacts import table
    li = table(spark, SF_MID, "lineitem")
    rules = [C.between("l_quantity", 3, 48), C.ge("l_discount", 0.01), C.gt("l_tax", 0.0)]
    one_pass = [r["records_removed"] for r in C.rule_audit(li, rules).orderBy("rule_order").collect()]
    seq, cur = [], li
    for r in rules:
        before = cur.count()
        cur = cur.where(r.predicate())
        seq.append(before - cur.count())
    assert one_pass == seq


def test_nan_counts_as_missing_in_describe(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, float("nan"))], "x double")
    d = P.describe(df, ["x"], with_missing=True).collect()[0]
    assert (d["count"], d["mean"], d["max"], d["missing"]) == (3, 2.0, 3.0, 1)
    assert (d["p25"], d["p50"], d["p75"]) == (1.5, 2.0, 2.5)


def test_winsor_beside_an_all_null_column(spark):
    df = spark.createDataFrame([(float(i), None) for i in range(200)], "x double, e double")
    got = {r["column_name"]: r["records_affected"] for r in
           C.winsor_bounds(df, ["x", "e"], only_affected=False).collect()}
    assert got == {"x": 4, "e": 0}
    r = C.WinsorModel.fit(df, ["x", "e"]).transform(df).agg(F.min("x"), F.max("x")).first()
    assert r[0] == pytest.approx(1.99) and r[1] == pytest.approx(197.01)


def test_policy_all_marker_column_and_fill_then_drop(spark):
    df = spark.createDataFrame([("unknown",)] * 3, "s string")
    clean, audit = M.apply_policy(df, [M.Step("s", "fill_mode")])
    assert {r["s"] for r in clean.collect()} == {"unknown"}
    a = audit.collect()[0]
    assert a["affected"] == 0 and a["fill_value"] is None
    df = spark.createDataFrame([("a",), ("a",), ("unknown",)], "s string")
    clean, audit = M.apply_policy(df, [M.Step("s", "fill_mode"), M.Step("s", "drop_rows")])
    assert clean.count() == 3
    assert {r["action"]: r["affected"] for r in audit.collect()} == {"fill_mode": 1, "drop_rows": 0}


def test_signed_zero_is_one_value(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (None,)], "x double")
    assert P.distinct_counts(df).collect()[0]["n_unique"] == 1


def test_empty_table_has_box_and_tukey_rows(spark):
    df = spark.createDataFrame([], "x double")
    assert [r["n_outliers"] for r in P.tukey_counts(df, ["x"]).collect()] == [0]
    assert [r["median"] for r in P.box_data(df, ["x"]).collect()] == [None]


def test_confusion_matrix_shows_labels_never_true(spark):
    df = spark.createDataFrame([(0, 1), (0, 0)], "label int, prediction int")
    got = {r["label"]: (r["pred_0"], r["pred_1"]) for r in EV.confusion_matrix(df).collect()}
    assert got == {0: (1, 1), 1: (0, 0)}


def test_encoder_with_many_categories(spark):
    df = spark.range(12_000).select(F.concat(F.lit("v"), "id").alias("v"))
    enc = FE.LabelEncoder.fit(df, ["v"])
    back = enc.inverse(enc.transform(df)).select(F.col("v_decoded").alias("v"))
    assert back.exceptAll(df).count() == 0 and back.count() == 12_000
