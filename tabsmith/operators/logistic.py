"""L2 logistic regression of all folds at once by shared Newton steps (MOD4, MOD10, MOD11, MOD14).

Every step is one pass over the table.  A row adds its loss, gradient and Hessian
to the model of every fold but its own, so ten cross-validated models cost one
scan a step instead of ten solver runs; eight or so steps reach the optimum.  A
task sends one small vector a pass (folds x parameters squared); the vectors
are added up in groups, and the driver solves one small system for each fold.

The objective is the one of the C form: the sum of the log losses plus
``|w|^2 / (2 C)``, the intercept unpenalised.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.operators import evaluate as EV
from tabsmith.operators.models import ml_ready
from tabsmith.operators.profile import sort_desc
from tabsmith.session import written

#: Vectors that are added up by one task, or by the driver.
GROUP = 256


def _usable(features: Sequence[str], label: str) -> Column:
    """Rows without missing entries: others teach nothing and have no score."""
    ok = F.col(f"`{label}`").isNotNull()
    for c in features:
        x = F.col(f"`{c}`").cast("double")
        ok = ok & x.isNotNull() & ~F.isnan(x)
    return ok


def _step_sums(x: np.ndarray, y: np.ndarray, fold: np.ndarray, folds: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Per model: rows, loss, gradient and Hessian over the rows outside its fold, flat."""
    z = x @ w.T
    p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
    mine = (fold[:, None] != folds[None, :]).astype(float)
    loss = ((np.logaddexp(0, z) - y[:, None] * z) * mine).sum(axis=0)
    grad = ((p - y[:, None]) * mine).T @ x
    s = p * (1 - p) * mine
    hess = np.stack([(x * s[:, k:k + 1]).T @ x for k in range(len(w))])
    return np.concatenate([mine.sum(axis=0)[:, None], loss[:, None], grad, hess.reshape(len(w), -1)], axis=1).ravel()


def _added(vectors: DataFrame, parts: int) -> np.ndarray:
    """Sum of the vectors (part, v); groups of ``GROUP`` parts are added up on the executors first."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")         # one order, so reruns agree
        total = np.sum([np.frombuffer(v) for v in pdf["v"]], axis=0)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0]) // GROUP], "v": [total.tobytes()]})

    while parts > GROUP:
        vectors = vectors.groupBy(F.floor(F.col("part") / GROUP)).applyInPandas(add, "part long, v binary")
        parts = -(-parts // GROUP)
    rows = sorted(vectors.collect(), key=lambda r: r.part)
    return np.sum([np.frombuffer(r.v) for r in rows], axis=0) if rows else np.zeros(0)


def fit(table: DataFrame, features: Sequence[str], label: str = "label", fold_col: str | None = None, C: float = 1.0,
        max_iter: int = 100, tol: float = 1e-10) -> DataFrame:
    """One row a model: ``fold``, ``intercept``, ``coefficients``, ``n_train``, ``iterations``, ``gradient``.

    With ``fold_col`` there is one model a fold, fitted on the other folds; else
    one model of all rows (fold NULL).  ``gradient`` is the largest entry of the
    penalised gradient at the result, relative to its largest entry at zero.
    Rows with a missing label, fold or feature are left out; a table without
    usable rows gives no model.  ``table`` is read once a step: pass a written one.
    """
    spark = table.sparkSession
    names = [f"f{i}" for i in range(len(features))]
    fold = F.lit(-1) if fold_col is None else F.col(f"`{fold_col}`")
    rows = table.where(_usable(features, label) & fold.isNotNull()).select(
        F.col(f"`{label}`").cast("double").alias("y"), fold.cast("int").alias("fold"),
        *[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(features, names)])
    schema = "fold int, intercept double, coefficients array<double>, n_train long, iterations int, gradient double"
    if fold_col is None:
        folds = np.array([-2])                # no row's own fold
        if rows.limit(1).count() == 0:
            return spark.createDataFrame([], schema)
    else:
        folds = np.array(sorted(r[0] for r in rows.select("fold").distinct().collect()), np.int64)
        if len(folds) < 2:
            return spark.createDataFrame([], schema)
    k, p = len(folds), len(features) + 1
    ridge = np.r_[np.full(p - 1, 1 / C), 0.0]

    def sums(w: np.ndarray) -> np.ndarray:
        def run(batches):
            total = None
            for batch in batches:
                if batch.num_rows:
                    x = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in names]
                                 + [np.ones(batch.num_rows)], axis=1)
                    got = _step_sums(x, batch.column("y").to_numpy(), batch.column("fold").to_numpy(), folds, w)
                    total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()),
                                                  pa.array([total.tobytes()], pa.binary())], ["part", "v"])

        got = _added(rows.mapInArrow(run, "part long, v binary"), rows.rdd.getNumPartitions()).reshape(k, -1)
        got = got.copy()
        got[:, 1] += 0.5 * (ridge * w * w).sum(axis=1)
        got[:, 2:2 + p] += ridge * w
        return got

    w, now = np.zeros((k, p)), None
    now = sums(w)
    scale = np.maximum(np.abs(now[:, 2:2 + p]).max(axis=1), 1e-300)
    step, share, done = np.zeros((k, p)), np.ones(k), np.zeros(k, int)
    for it in range(1, max_iter + 1):
        worst = np.abs(now[:, 2:2 + p]).max(axis=1) / scale
        open_ = worst > tol
        if not open_.any():
            break
        for m in np.flatnonzero(open_):
            if share[m] == 1.0:
                h = now[m, 2 + p:].reshape(p, p) + np.diag(ridge)
                # a feature that never varies leaves the intercept's direction open
                step[m] = np.linalg.lstsq(h, now[m, 2:2 + p], rcond=1e-14)[0]
        trial = w - np.where(open_, share, 0.0)[:, None] * step
        new = sums(trial)
        # a step that raises the objective is taken back and halved
        up = new[:, 1] > now[:, 1] + 1e-12 * np.abs(now[:, 1])
        good = open_ & ~up
        w[good], now[good], share[good] = trial[good], new[good], 1.0
        done[good] = it
        share[open_ & up] /= 2
        if (share < 1e-8).all():
            break
    worst = np.abs(now[:, 2:2 + p]).max(axis=1) / scale
    return spark.createDataFrame(
        [(None if fold_col is None else int(f), float(v[-1]), v[:-1].tolist(), int(s[0]), int(i), float(g))
         for f, v, s, i, g in zip(folds, w, now, done, worst)], schema)


def score(table: DataFrame, models: DataFrame, features: Sequence[str], keep: Sequence[str] = ("id", "label"),
          fold_col: str | None = None, label: str = "label") -> DataFrame:
    """``keep`` columns, ``prediction`` (1 at one half or more) and ``score`` = P(class 1), as plain sums.

    With ``fold_col`` every row is scored by the model that has not seen its
    fold.  A row with a missing feature has neither.  ``models`` has one row a
    fold and is broadcast.
    """
    m = models.select(F.col("fold").alias("__fold"), F.col("intercept").alias("__b"), F.col("coefficients").alias("__w"))
    if fold_col is None:
        both = table.crossJoin(F.broadcast(m))
    else:
        both = table.join(F.broadcast(m), F.col(f"`{fold_col}`").cast("int") == F.col("__fold"))
    z = F.col("__b")
    for i, c in enumerate(features):
        z = z + F.col(f"`{c}`").cast("double") * F.get("__w", F.lit(i))
    both = both.select(*keep, F.when(F.isnan(z), None).otherwise(z).alias("__z"))
    return both.select(*keep, (F.col("__z") >= 0).cast("int").alias("prediction"),
                       (1 / (1 + F.exp(-F.col("__z")))).alias("score"))


def cross_validate(table: DataFrame, features: Sequence[str], label: str = "label", fold_col: str = "fold", key: str = "id",
                   C: float = 1.0, pos_label: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """MOD10 for MOD4: ``(models, fold metrics, out-of-fold predictions)``.

    Precision, recall and F1 are those of ``pos_label`` (the original's positive
    class is 0), AUC that of class 1.
    """
    table = ml_ready(table.select(key, label, fold_col, *features), "folds")
    models = fit(table, features, label, fold_col, C)
    oof = written(score(table, models, features, [key, label, fold_col], fold_col), "oof")
    return models, EV.classification_metrics(oof, label, pos_label=pos_label, group=fold_col, auc_pos_label=1), oof


def gradients(table: DataFrame, models: DataFrame, features: Sequence[str], label: str = "label", fold_col: str = "fold",
              C: float = 1.0) -> DataFrame:
    """Optimality of fold models in plain SQL sums: ``(fold, n_train, positives, expected, gradient)``.

    ``expected`` is the sum of the predicted probabilities over the training rows,
    which equals the positives at the optimum; ``gradient`` the largest entry of
    the penalised gradient over the training rows, for each row.
    """
    m = models.select(F.col("fold").alias("__model"), F.col("intercept").alias("__b"), F.col("coefficients").alias("__w"))
    rows = table.where(_usable(features, label)).join(F.broadcast(m), F.col(f"`{fold_col}`").cast("int") != F.col("__model"))
    z = F.col("__b")
    for i, c in enumerate(features):
        z = z + F.col(f"`{c}`").cast("double") * F.get("__w", F.lit(i))
    rows = rows.withColumn("__p", 1 / (1 + F.exp(-z)))
    rest = F.col("__p") - F.col(f"`{label}`")
    sums = rows.groupBy("__model").agg(
        F.count(F.lit(1)).alias("n_train"), F.sum(F.col(f"`{label}`")).cast("long").alias("positives"),
        F.sum("__p").alias("expected"), F.first("__w").alias("__w"),
        *[F.sum(rest * F.col(f"`{c}`").cast("double")).alias(f"__g{i}") for i, c in enumerate(features)])
    grads = [F.abs(F.col(f"__g{i}") + F.get("__w", F.lit(i)) / C) for i in range(len(features))]
    grads.append(F.abs(F.col("expected") - F.col("positives")))
    return sums.select(F.col("__model").alias("fold"), "n_train", "positives", "expected",
                       (F.greatest(*grads) / F.col("n_train")).alias("gradient"))


def importance(models: DataFrame, features: Sequence[str]) -> DataFrame:
    """MOD14: ``(feature, coefficient, abs_coefficient, rank)`` of one model, by falling absolute value."""
    rows = models.select(F.posexplode("coefficients").alias("at", "coefficient"))
    rows = rows.select(F.element_at(F.array(*map(F.lit, features)), F.col("at") + 1).alias("feature"), "coefficient",
                       F.abs("coefficient").alias("abs_coefficient"))
    return sort_desc(rows, "abs_coefficient", "feature")
