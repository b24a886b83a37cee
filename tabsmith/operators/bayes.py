"""Naive Bayes in plain aggregates: Gaussian, Bernoulli and multinomial (MOD1-MOD3, MOD8-MOD10).

A fit is one grouped aggregate: rows, and per feature a mean and variance, a
count of entries above the threshold, or a sum.  For cross-validation the same
aggregate is taken per (fold, class); the statistics of a training part are
those of the other folds put together, so ten models cost the scan of one.
What reaches the driver is folds x classes x features.

Priors are empirical: rows of the class over all rows of the training part.
Scoring is a plain sum of columns: for each class a constant, plus one term for
each feature whose factors come from a row of the broadcast parameter table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.operators.features import fold_scalers, scale_by_fold

KINDS = ("gaussian", "bernoulli", "multinomial")


def _x(c: str) -> Column:
    return F.col(f"`{c}`").cast("double")


def _statistics(df: DataFrame, features: Sequence[str], kind: str, by: Sequence[Column], threshold: float,
                check: bool = True) -> DataFrame:
    """Rows and per-feature statistics of every group: ``n`` and ``m<i>``, ``v<i>`` (Gaussian) or ``s<i>``."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(features):
        if kind == "gaussian":
            aggs += [F.avg(_x(c)).alias(f"m{i}"), F.var_pop(_x(c)).alias(f"v{i}")]
        elif kind == "bernoulli":
            aggs.append(F.count_if(_x(c) > threshold).cast("double").alias(f"s{i}"))
        else:
            # counts cannot be negative; the check is part of the same scan
            error = F.raise_error(F.lit(f"negative value in {c}: multinomial needs counts"))
            aggs.append(F.sum(F.when(_x(c) < 0, error).otherwise(_x(c)) if check else _x(c)).alias(f"s{i}"))
    return df.groupBy(*by).agg(*aggs)


def _long(stats: DataFrame, features: Sequence[str], columns: dict[str, list[Column]]) -> DataFrame:
    total = Window.partitionBy(F.lit(0))      # one row a class
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), *[v[i].alias(k) for k, v in columns.items()])
                     for i, c in enumerate(features)])
    stats = stats.withColumn("prior", F.col("n") / F.sum("n").over(total))
    return stats.select("class", F.inline(rows), "prior", "n")


def gaussian_nb_fit(df: DataFrame, features: Sequence[str], label: str = "label", var_smoothing: float = 1e-9) -> DataFrame:
    """MOD1 fit: ``(class, feature, mean, var, prior, n)``.

    ``var`` is the population variance of the class plus ``var_smoothing`` times
    the largest variance of a feature over all rows, which the class moments give
    without another scan."""
    st = _statistics(df, features, "gaussian", [F.col(label).alias("class")], 0.0)
    k = range(len(features))
    total = Window.partitionBy(F.lit(0))      # one row a class
    st = st.withColumns({f"c{i}": F.sum(F.col("n") * F.col(f"m{i}")).over(total) / F.sum("n").over(total) for i in k})
    whole = [F.sum(F.col("n") * (F.col(f"v{i}") + (F.col(f"m{i}") - F.col(f"c{i}")) ** 2)).over(total)
             / F.sum("n").over(total) for i in k]
    st = st.withColumn("eps", F.lit(var_smoothing) * (F.greatest(*whole) if len(whole) > 1 else whole[0]))
    return _long(st, features, {"mean": [F.col(f"m{i}") for i in k], "var": [F.col(f"v{i}") + F.col("eps") for i in k]})


def bernoulli_nb_fit(df: DataFrame, features: Sequence[str], label: str = "label", alpha: float = 1.0,
                     threshold: float = 0.0) -> DataFrame:
    """MOD2 fit: ``(class, feature, prob, prior, n)``; ``prob = (count above threshold + alpha) / (n + 2 alpha)``."""
    st = _statistics(df, features, "bernoulli", [F.col(label).alias("class")], threshold)
    return _long(st, features, {"prob": [(F.col(f"s{i}") + alpha) / (F.col("n") + 2 * alpha) for i in range(len(features))]})


def multinomial_nb_fit(df: DataFrame, features: Sequence[str], label: str = "label", alpha: float = 1.0) -> DataFrame:
    """MOD3 fit: ``(class, feature, prob, prior, n)``; a feature's smoothed share of all sums of the class.

    A negative entry is an error."""
    st = _statistics(df, features, "multinomial", [F.col(label).alias("class")], 0.0)
    every = sum((F.col(f"s{i}") for i in range(1, len(features))), F.col("s0")) + alpha * len(features)
    return _long(st, features, {"prob": [(F.col(f"s{i}") + alpha) / every for i in range(len(features))]})


def priors(df: DataFrame, label: str = "label") -> DataFrame:
    """MOD15: ``(class, n, prior)``: rows of each class and their share of all rows."""
    n = df.groupBy(F.col(f"`{label}`").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("prior", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))     # one row a class


@dataclass
class NaiveBayes:
    """Parameters of one model: per class a constant and per feature a ``centre`` and a ``factor``.

    The log-likelihood of a class is ``constant + sum(factor * (x - centre)^2)``
    (Gaussian) or ``constant + sum(factor * x)`` (Bernoulli on 0/1, multinomial).
    """
    kind: str
    classes: list
    constant: np.ndarray
    centre: np.ndarray
    factor: np.ndarray
    threshold: float = 0.0


def _model(kind: str, classes: list, n: np.ndarray, stats: list, var_smoothing: float, alpha: float,
           threshold: float) -> NaiveBayes:
    """A model from the merged statistics of each class; a class without rows is never predicted."""
    with np.errstate(divide="ignore", invalid="ignore"):
        prior = np.log(n / n.sum())
    if kind == "gaussian":
        mean = np.stack([s[0] for s in stats])
        square = np.stack([s[1] for s in stats])               # sums of squared deviations
        centre = (n[:, None] * mean).sum(axis=0) / n.sum()
        whole = (square + n[:, None] * (mean - centre) ** 2).sum(axis=0) / n.sum()
        var = square / np.maximum(n, 1)[:, None] + var_smoothing * whole.max()
        with np.errstate(divide="ignore"):
            constant = prior - 0.5 * np.log(2 * math.pi * np.where(n[:, None] > 0, var, 1.0)).sum(axis=1)
            factor = np.where(n[:, None] > 0, -0.5 / var, 0.0)
        return NaiveBayes(kind, classes, constant, mean, factor)
    total = np.stack([s[0] for s in stats])
    if kind == "bernoulli":
        prob = (total + alpha) / (n[:, None] + 2 * alpha)
        no = np.log1p(-prob)
        return NaiveBayes(kind, classes, prior + no.sum(axis=1), np.zeros_like(prob), np.log(prob) - no, threshold)
    prob = (total + alpha) / (total.sum(axis=1, keepdims=True) + alpha * total.shape[1])
    return NaiveBayes(kind, classes, prior, np.zeros_like(prob), np.log(prob))


def _merged(parts: list, kind: str, width: int) -> tuple[int, tuple]:
    """Rows and statistics of several groups put together (parallel-variance formula for the Gaussian)."""
    n = sum(p[0] for p in parts)
    if n == 0:
        return 0, (np.zeros(width), np.zeros(width))
    if kind != "gaussian":
        return n, (sum(p[1] for p in parts),)
    mean = sum(p[0] * p[1] for p in parts) / n
    return n, (mean, sum(p[2] + p[0] * (p[1] - mean) ** 2 for p in parts))


def fit(df: DataFrame, features: Sequence[str], kind: str = "gaussian", label: str = "label", fold_col: str | None = None,
        var_smoothing: float = 1e-9, alpha: float = 1.0, threshold: float = 0.0, scalers: dict | None = None) -> dict:
    """One scan: ``{fold: model of the other folds}``, or ``{None: model of all rows}`` without ``fold_col``.

    ``scalers`` (``features.fold_scalers``) gives each model its inputs as scaled by
    its own training part: means, variances and sums follow an affine map, so
    the scan of the raw rows is enough (not for Bernoulli, whose counts do not).
    Rows without a label (or fold) teach nothing; NULL features are left out of
    means and sums."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    if scalers and kind == "bernoulli":
        raise ValueError("counts above a threshold do not follow a scaler")
    df = df.where(F.col(f"`{label}`").isNotNull())
    by = [F.col(f"`{label}`").alias("class")]
    if fold_col is not None:
        df = df.where(F.col(f"`{fold_col}`").isNotNull())
        by.append(F.col(f"`{fold_col}`").alias("fold"))
    # raw rows of a scaled fit may be negative; scaled to their own extremes they are not
    rows = _statistics(df, features, kind, by, threshold, check=not scalers).collect()        # folds x classes
    classes = sorted({r["class"] for r in rows})
    p, groups = len(features), {}
    for r in rows:
        got = lambda name: np.array([0.0 if r[f"{name}{i}"] is None else r[f"{name}{i}"] for i in range(p)])
        stats = (got("m"), got("v") * r["n"]) if kind == "gaussian" else (got("s"),)
        groups[(r["fold"] if fold_col is not None else None, r["class"])] = (r["n"], *stats)
    folds = sorted({f for f, _ in groups}) if fold_col is not None else [None]
    out = {}
    for fold in folds:
        merged = [_merged([g for (f, c), g in groups.items() if c == k and (fold is None or f != fold)], kind, p)
                  for k in classes]
        n = np.array([m[0] for m in merged], float)
        if scalers:
            shift, factor = (np.array([scalers[fold].get(c, (0.0, 1.0))[k] for c in features]) for k in (0, 1))
            merged = [(m, ((s[0] - shift) * factor, s[1] * factor ** 2) if kind == "gaussian" else ((s[0] - m * shift) * factor,))
                      for m, s in merged]
        if n.sum():
            out[fold] = _model(kind, classes, n, [m[1] for m in merged], var_smoothing, alpha, threshold)
    return out


def score(df: DataFrame, models: dict, features: Sequence[str], keep: Sequence[str] = ("id", "label"),
          fold_col: str | None = None) -> DataFrame:
    """``keep`` columns, ``prediction`` (the likeliest class, the lowest on ties) and ``score`` = P(last class | x).

    With ``fold_col`` a row is scored by the model that has not seen its fold.
    The parameter table has one row a fold."""
    if not models:
        raise ValueError("no model: no usable training rows")
    first = next(iter(models.values()))
    k, kind = len(first.classes), first.kind
    rows = [(f, *(v for c in range(k) for v in (float(m.constant[c]), m.centre[c].tolist(), m.factor[c].tolist())))
            for f, m in models.items()]
    fold_type = "int" if fold_col is None else df.schema[fold_col].dataType.simpleString()
    schema = f"__fold {fold_type}, " + ", ".join(
        f"__c{c} double, __m{c} array<double>, __f{c} array<double>" for c in range(k))
    table = F.broadcast(df.sparkSession.createDataFrame(rows, schema))
    both = df.crossJoin(table) if fold_col is None else df.join(table, F.col(f"`{fold_col}`") == F.col("__fold"))
    sums = []
    for c in range(k):
        total = F.col(f"__c{c}")
        for i, name in enumerate(features):
            x = _x(name)
            factor = F.get(f"__f{c}", F.lit(i))
            if kind == "gaussian":
                off = x - F.get(f"__m{c}", F.lit(i))
                total = total + factor * off * off
            elif kind == "bernoulli":
                total = total + F.when(x > first.threshold, factor).otherwise(0.0)
            else:
                total = total + factor * x
        sums.append(total.alias(f"__j{c}"))
    both = both.select(*keep, *sums)
    js = [F.col(f"__j{c}") for c in range(k)]
    both = both.withColumn("__top", F.greatest(*js) if k > 1 else js[0])
    pick = F.lit(first.classes[-1])
    for c in reversed(range(k - 1)):
        pick = F.when(js[c] >= F.col("__top"), F.lit(first.classes[c])).otherwise(pick)
    share = [F.exp(j - F.col("__top")) for j in js]
    return both.select(*keep, pick.alias("prediction"), (share[-1] / sum(share[1:], share[0])).alias("score"))


def cross_validate(df: DataFrame, features: Sequence[str], kind: str = "gaussian", label: str = "label",
                   fold_col: str = "fold", keep: Sequence[str] = ("id", "label"), scale: Sequence[str] = (),
                   scaler: str = "standard", **settings) -> DataFrame:
    """MOD10: out-of-fold ``keep + (fold, prediction, score)`` of one kind.

    The columns of ``scale`` are scaled (``scaler``: standard or minmax) with the
    statistics of each model's own training part, so no fold leaks into it."""
    scalers = fold_scalers(df, scale, fold_col, scaler) if scale else None
    models = fit(df, features, kind, label, fold_col, scalers=scalers, **settings)
    return score(scale_by_fold(df, scalers, fold_col) if scale else df, models, features, [*keep, fold_col], fold_col)


def compare(scored: dict[str, DataFrame], label: str = "label", fold_col: str = "fold") -> DataFrame:
    """MOD9: ``(model, auc_mean, auc_std, accuracy_mean, accuracy_std, is_best)`` of out-of-fold scores by name.

    Mean and population std over the folds; the best mean AUC (ties: the first
    name) is flagged."""
    from tabsmith.operators import evaluate as EV
    long = None
    for name, df in scored.items():
        part = df.select(F.lit(name).alias("model"), label, fold_col, "prediction", "score")
        long = part if long is None else long.unionByName(part)
    folds = EV.classification_metrics(long, label, group=["model", fold_col])
    rows = folds.groupBy("model").agg(
        F.avg("auc").alias("auc_mean"), F.stddev_pop("auc").alias("auc_std"),
        F.avg("accuracy").alias("accuracy_mean"), F.stddev_pop("accuracy").alias("accuracy_std"))
    place = Window.partitionBy(F.lit(0)).orderBy(F.desc("auc_mean"), "model")       # one row a kind
    return rows.withColumn("is_best", F.row_number().over(place) == 1)
