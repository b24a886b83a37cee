"""Classifier metrics and curves (EVL1-EVL8).

Every function takes a scored DataFrame ``(label, prediction, score[, group])``
with 0/1 labels (``pos_label`` selects the positive class for precision /
recall / F1) and can be grouped, e.g. by ``fold``, so all folds are evaluated
by one query.

AUC and the curves need running sums over scores in descending order.
Scores are first collapsed to distinct values per group (written once, the only
scan of the scored table); the running sums are then two-level: scores are cut
into ranges at approximate quantiles, per-range totals give each range its offset
(a table of groups × ranges), and the window runs only inside ``(group, range)``.
No step puts a whole group into one task.
"""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions import ratio
from tabsmith.session import written


def _groups(group) -> list[str]:
    if group is None:
        return []
    return [group] if isinstance(group, str) else list(group)


# ---------------------------------------------------------------- EVL1-EVL3
def confusion_matrix(scored: DataFrame, labels: Sequence = (0, 1), label: str = "label",
                     prediction: str = "prediction", group=None) -> DataFrame:
    """EVL1: rows = true label, one ``pred_<l>`` count column per label (all shown)."""
    g = _groups(group)
    names = [f"pred_{l}" for l in labels]
    got = scored.groupBy(*g, label).agg(
        *[F.count_if(F.col(prediction) == F.lit(l)).alias(f"pred_{l}") for l in labels])
    # a label that is never true still has its row of zeros
    kind = scored.schema[label].dataType
    every = scored.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(l).cast(kind) for l in labels])).alias(label),
        *[F.lit(0).cast("bigint").alias(x) for x in names])
    if g:
        every = scored.select(*g).distinct().crossJoin(every)
    return (got.unionByName(every).groupBy(*g, label)
            .agg(*[F.sum(x).alias(x) for x in names]))


def _counts(scored, label, prediction, pos_label, g):
    y = F.col(label) == F.lit(pos_label)
    p = F.col(prediction) == F.lit(pos_label)
    return scored.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == F.col(prediction)).alias("correct"),
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"))


def _prf(tp, fp, fn):
    precision = F.coalesce(ratio(tp, tp + fp), F.lit(0.0))
    recall = F.coalesce(ratio(tp, tp + fn), F.lit(0.0))
    f1 = F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
    return precision, recall, f1


def classification_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction",
                           score: str | None = "score", pos_label=1, group=None,
                           auc_pos_label=None) -> DataFrame:
    """EVL2-EVL4: ``accuracy, precision, recall, f1`` (0/0 → 0) and, with a
    score column, ``auc`` — per group when ``group`` is given.  ``auc_pos_label``
    (default ``pos_label``) is the class whose probability ``score`` holds."""
    g = _groups(group)
    c = _counts(scored, label, prediction, pos_label, g)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    pr, rc, f1 = _prf(tp, fp, fn)
    out = c.select(*g, ratio("correct", "n").alias("accuracy"), pr.alias("precision"),
                   rc.alias("recall"), f1.alias("f1"))
    if score is not None:
        a = auc(scored, label, score, pos_label if auc_pos_label is None else auc_pos_label, group)
        out = out.join(a, g, "left") if g else out.crossJoin(a)
    return out


# ---------------------------------------------------------------- running sums
def score_counts(scored: DataFrame, label: str, score: str, pos_label, g) -> DataFrame:
    """Distinct scores per group with positive / negative counts."""
    y = F.col(label) == F.lit(pos_label)
    return (scored.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
            .groupBy(*g, F.col(score).cast("double").alias("s"))
            .agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg")))


ROWS_PER_RANGE = 2_000_000


def _splits(sc: DataFrame, n_buckets: int | None) -> list[float]:
    """Range boundaries at approximate quantiles of the distinct scores.

    With ``n_buckets=None`` the same job also counts the distinct scores; only
    when one range would exceed ``ROWS_PER_RANGE`` a finer grid is computed."""
    nb = n_buckets or 256
    grid = [i / nb for i in range(1, nb)]
    row = sc.agg(F.percentile_approx("s", grid, max(10_000, 10 * nb)).alias("q"),
                 F.count(F.lit(1)).alias("n")).first()
    if n_buckets is None and row["n"] > nb * ROWS_PER_RANGE:
        return _splits(sc, int(min(65_536, math.ceil(row["n"] / ROWS_PER_RANGE))))
    inner = sorted({x for x in (row["q"] or []) if x is not None and not math.isinf(x)}) or [0.0]
    return [-math.inf] + inner + [math.inf]


def running_sums(sc: DataFrame, g: list[str], n_buckets: int | None = None) -> DataFrame:
    """For each distinct score (descending): ``tps``, ``fps`` = positives / negatives with score >= s, the
    group's ``all_pos``, ``all_neg``, and ``next_pos``, ``next_neg`` of the next lower score (NULL after the last).

    ``sc`` (``score_counts``) is written once.  A range of scores gives one row of
    totals with its first score's counts, from which come the offsets and the
    neighbour beyond its end; what else is needed lies inside (group, range).
    ``n_buckets=None`` sizes the ranges from the number of distinct scores."""
    sc = written(sc, "scores")
    splits = _splits(sc, n_buckets)  # ≤ n_buckets values reach the driver
    b = Bucketizer(splits=splits, inputCol="s", outputCol="__b", handleInvalid="keep").transform(sc)
    b = b.withColumn("__b", (F.lit(len(splits)) - F.col("__b")).cast("int"))  # descending ranges
    tot = b.groupBy(*g, "__b").agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__q"),
                                   F.max(F.struct("s", "pos", "neg")).alias("__first"))
    order = Window.partitionBy(*g).orderBy("__b")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*g)
    off = tot.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(g)], F.col("__b").alias("__o"),
                     F.coalesce(F.sum("__p").over(before), F.lit(0)).alias("__op"),
                     F.coalesce(F.sum("__q").over(before), F.lit(0)).alias("__oq"),
                     F.sum("__p").over(every).alias("all_pos"), F.sum("__q").over(every).alias("all_neg"),
                     F.lead("__first").over(order).alias("__beyond"))
    same = F.col("__b") == F.col("__o")
    for i, c in enumerate(g):
        same = same & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    j = b.join(off, same)
    inside = Window.partitionBy(*g, "__b").orderBy(F.desc("s"))
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    return j.select(*g, "s", "pos", "neg", "all_pos", "all_neg",
                    (F.col("__op") + F.sum("pos").over(upto)).alias("tps"),
                    (F.col("__oq") + F.sum("neg").over(upto)).alias("fps"),
                    F.coalesce(F.lead("pos").over(inside), F.col("__beyond.pos")).alias("next_pos"),
                    F.coalesce(F.lead("neg").over(inside), F.col("__beyond.neg")).alias("next_neg"))


# ---------------------------------------------------------------- EVL4
def auc(scored: DataFrame, label: str = "label", score: str = "score", pos_label=1,
        group=None, n_buckets: int | None = None) -> DataFrame:
    """EVL4: exact ROC AUC with ties counted half (trapezoids on the full curve).

    AUC = Σ_s neg_s · (P_above_s + pos_s / 2) / (P · N)."""
    g = _groups(group)
    sc = score_counts(scored, label, score, pos_label, g)
    rs = running_sums(sc, g, n_buckets)
    above = F.col("tps") - F.col("pos")
    agg = rs.groupBy(*g).agg(
        F.sum(F.col("neg") * (above + F.col("pos") * 0.5)).alias("__u"),
        F.sum("pos").alias("__P"), F.sum("neg").alias("__N"))
    return agg.select(*g, F.try_divide(F.col("__u"), F.col("__P").cast("double") * F.col("__N"))
                      .alias("auc"))


#: Scores of one place and group that a task of ``auc_of_lists`` puts in order, at most about.
LIST_RANGE = 4_000_000


def auc_of_lists(scored: DataFrame, label: str, scores: str, pos_label=1, group=None) -> DataFrame:
    """EVL4 for a list of scores a row: ``(group..., place, auc)``, what ``auc`` gives for the scores of each place.

    Batches count their distinct scores of all places, packed by group and range of scores; a range is some leading
    bits of the number (relative steps, more of them for more rows), so no task gets a whole group."""
    g = _groups(group)
    shift = 50 - max(0, math.ceil(math.log2(max(1, scored.count()) / LIST_RANGE)))
    names, kinds = [f"__g{i}" for i in range(len(g))], [scored.select(c).schema[0].dataType for c in g]

    def count(batches):
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in names))) if g else [()] * batch.num_rows
            lists, y = batch.column("scores"), np.array(batch.column("y").to_pylist(), float)
            codes = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            code = np.array([codes[k] for k in keys], np.int64)
            start = lists.offsets.to_numpy()
            row = np.repeat(np.arange(len(lists)), np.diff(start))
            place = np.arange(len(row)) - (start[:-1] - start[0])[row]
            s = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
            good = ~np.isnan(s)
            s, row, place = s[good] + 0.0, row[good], place[good]                # one zero
            if not len(s):
                continue
            bits = s.view(np.int64)
            part = np.where(bits < 0, ~(bits & 0x7FFFFFFFFFFFFFFF), bits) >> shift
            order = np.lexsort((s, place, part, code[row]))
            s, place, part, own, y = s[order], place[order], part[order], code[row][order], y[row][order]
            new = np.append(True, (s[1:] != s[:-1]) | (place[1:] != place[:-1]) | (part[1:] != part[:-1]) | (own[1:] != own[:-1]))
            first = np.flatnonzero(new)
            pos, neg = np.add.reduceat(y == 1, first, dtype=np.int64), np.add.reduceat(y == 0, first, dtype=np.int64)
            s, place, part, own = s[first], place[first], part[first], own[first]
            cut = np.append(np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (own[1:] != own[:-1]))), len(s))
            every = list(codes)
            heads = [every[i] for i in own[cut[:-1]]]
            packed = [pa.array([a[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary())
                      for a in (s, place.astype(np.int32), pos, neg)]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([h[i] for h in heads], batch.column(c).type) for i, c in enumerate(names)), pa.array(part[cut[:-1]]), *packed],
                [*names, "part", "s", "place", "pos", "neg"])

    def total(table: pa.Table) -> pa.Table:
        s, place, pos, neg = (np.concatenate([np.frombuffer(b.as_buffer(), kind) for b in table.column(c)])
                              for c, kind in (("s", float), ("place", np.int32), ("pos", np.int64), ("neg", np.int64)))
        order = np.lexsort((-s, place))
        s, place, pos, neg = s[order], place[order], pos[order], neg[order]
        first = np.flatnonzero(np.append(True, (s[1:] != s[:-1]) | (place[1:] != place[:-1])))
        pos, neg, place = np.add.reduceat(pos, first), np.add.reduceat(neg, first), place[first]
        own = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        before = np.cumsum(pos) - pos
        above = before - np.repeat(before[own], np.diff(np.append(own, len(place))))
        n = len(own)
        return pa.table([*(pa.array([table.column(c)[0].as_py()] * n, table.column(c).type) for c in [*names, "part"]),
                         pa.array(place[own]), pa.array(np.add.reduceat(pos, own)), pa.array(np.add.reduceat(neg, own)),
                         pa.array(np.add.reduceat(neg * (above + pos * 0.5), own))],
                        names=[*names, "part", "place", "pos", "neg", "u"])

    heads = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)]).add("part", "long")
    packed = T.StructType(heads.fields[:])
    for c in ("s", "place", "pos", "neg"):
        packed = packed.add(c, "binary")
    y = F.when(F.col(label).isNull(), F.lit(-1)).otherwise((F.col(label) == F.lit(pos_label)).cast("int"))
    rows = scored.where(F.col(scores).isNotNull()).select(
        *[F.col(c).alias(n) for c, n in zip(g, names)], y.alias("y"), F.col(scores).cast("array<double>").alias("scores"))
    ranges = (rows.mapInArrow(count, packed).groupBy(*names, "part").applyInArrow(
        total, T.StructType(heads.fields[:]).add("place", "integer").add("pos", "long").add("neg", "long").add("u", "double")))
    higher = Window.partitionBy(*names, "place").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    agg = (ranges.withColumn("above", F.coalesce(F.sum("pos").over(higher), F.lit(0))).groupBy(*names, "place")
           .agg(F.sum(F.col("u") + F.col("neg") * F.col("above")).alias("u"), F.sum("pos").alias("p"), F.sum("neg").alias("n")))
    return agg.select(*[F.col(n).alias(c) for c, n in zip(g, names)], "place",
                      F.try_divide(F.col("u"), F.col("p").cast("double") * F.col("n")).alias("auc"))


# ---------------------------------------------------------------- EVL5 / EVL6
def roc_curve(scored: DataFrame, label: str = "label", score: str = "score", pos_label=1,
              group=None, drop_intermediate: bool = True, n_buckets: int | None = None) -> DataFrame:
    """EVL5: ``(threshold, fpr, tpr)``; starts at (0, 0) with an infinite threshold.

    With ``drop_intermediate`` collinear points are dropped: those whose step has
    the same counts as the step to the next lower score, but for the first and
    the last point."""
    g = _groups(group)
    rs = running_sums(score_counts(scored, label, score, pos_label, g), g, n_buckets)
    first = (F.col("tps") == F.col("pos")) & (F.col("fps") == F.col("neg"))
    if drop_intermediate:
        rs = rs.where(first | F.col("next_pos").isNull() | (F.col("next_pos") != F.col("pos"))
                      | (F.col("next_neg") != F.col("neg")))
    curve = rs.select(*g, F.col("s").alias("threshold"), ratio("fps", "all_neg").alias("fpr"), ratio("tps", "all_pos").alias("tpr"),
                      first.alias("__first"))
    # the first point of each curve brings its start along: no second pass for the groups
    point = lambda t, x, y: F.struct(t.alias("threshold"), x.alias("fpr"), y.alias("tpr"))
    here = point(F.col("threshold"), F.col("fpr"), F.col("tpr"))
    start = point(F.lit(float("inf")), F.lit(0.0), F.lit(0.0))
    return curve.select(*g, F.inline(F.when(F.col("__first"), F.array(start, here)).otherwise(F.array(here))))


def pr_curve(scored: DataFrame, label: str = "label", score: str = "score", pos_label=1,
             group=None, n_buckets: int | None = None) -> DataFrame:
    """EVL6: ``(threshold, precision, recall)`` at every distinct score, plus the
    closing point (recall 0, precision 1) with a NULL threshold."""
    g = _groups(group)
    rs = running_sums(score_counts(scored, label, score, pos_label, g), g, n_buckets)
    first = (F.col("tps") == F.col("pos")) & (F.col("fps") == F.col("neg"))
    point = lambda t, x, y: F.struct(t.alias("threshold"), x.alias("precision"), y.alias("recall"))
    here = point(F.col("s"), F.coalesce(ratio("tps", F.col("tps") + F.col("fps")), F.lit(0.0)),
                 F.when(F.col("all_pos") == 0, F.lit(1.0)).otherwise(ratio("tps", "all_pos")))
    end = point(F.lit(None).cast("double"), F.lit(1.0), F.lit(0.0))
    return rs.select(*g, F.inline(F.when(first, F.array(end, here)).otherwise(F.array(here))))


# ---------------------------------------------------------------- EVL7 / EVL8
def classification_report(scored: DataFrame, labels: Sequence = (0, 1), label: str = "label",
                          prediction: str = "prediction") -> DataFrame:
    """EVL7: per class ``precision, recall, f1, support`` plus ``accuracy``,
    ``macro avg`` and ``weighted avg`` rows (``class_label`` is text)."""
    aggs = [F.count(F.lit(1)).alias("n"),
            F.count_if(F.col(label) == F.col(prediction)).alias("correct")]
    for i, l in enumerate(labels):
        y, p = F.col(label) == F.lit(l), F.col(prediction) == F.lit(l)
        aggs += [F.count_if(y & p).alias(f"tp{i}"), F.count_if(~y & p).alias(f"fp{i}"),
                 F.count_if(y & ~p).alias(f"fn{i}")]
    wide = scored.agg(*aggs)
    rows = []
    for i, l in enumerate(labels):
        tp, fp, fn = F.col(f"tp{i}"), F.col(f"fp{i}"), F.col(f"fn{i}")
        pr, rc, f1 = _prf(tp, fp, fn)
        rows.append((str(l), pr, rc, f1, (tp + fn).cast("bigint")))
    k = float(len(labels))
    macro = [sum((r[j] for r in rows[1:]), rows[0][j]) / F.lit(k) for j in (1, 2, 3)]
    sup = [r[4] for r in rows]
    tot = F.col("n")
    weighted = [F.try_divide(sum((r[j] * r[4] for r in rows[1:]), rows[0][j] * rows[0][4]),
                             tot.cast("double")) for j in (1, 2, 3)]
    acc = ratio("correct", "n")
    structs = [F.struct(F.lit(n).alias("class_label"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1"), s.alias("support")) for n, p, r, f, s in rows]
    structs.append(F.struct(F.lit("accuracy").alias("class_label"),
                            F.lit(None).cast("double").alias("precision"),
                            F.lit(None).cast("double").alias("recall"), acc.alias("f1"),
                            tot.alias("support")))
    structs.append(F.struct(F.lit("macro avg").alias("class_label"), macro[0].alias("precision"),
                            macro[1].alias("recall"), macro[2].alias("f1"), tot.alias("support")))
    structs.append(F.struct(F.lit("weighted avg").alias("class_label"), weighted[0].alias("precision"),
                            weighted[1].alias("recall"), weighted[2].alias("f1"), tot.alias("support")))
    return wide.select(F.inline(F.array(*structs)))


def cv_summary(fold_metrics: DataFrame, metrics: Sequence[str] = ("accuracy", "precision",
                                                                   "recall", "f1", "auc"),
               population: bool = False) -> DataFrame:
    """EVL8: ``(metric, mean, std)`` over folds; sample std unless ``population``."""
    ms = [m for m in metrics if m in fold_metrics.columns]
    long = fold_metrics.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ms])))
    sd = F.stddev_pop if population else F.stddev_samp
    return long.groupBy("metric").agg(F.avg("value").alias("mean"), sd("value").alias("std"))
