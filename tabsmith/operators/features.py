"""Feature preparation (FE1-FE7).

* Label encoding: the mapping is a DataFrame ``(feature, value, code)`` built
  from the distinct values (sorted by byte order, missing = ``nan``), joined to
  encode and to decode at any number of categories.
* Scalers take their statistics from a one-row aggregate cross-joined as a
  broadcast; the population std is used (the spark.ml scaler would use the
  sample std and centre nothing by default).
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions import column, number, string_or_nan
from tabsmith.operators.profile import long_values
from tabsmith.operators.rank import global_rank
from tabsmith.session import written


def encoding_mapping(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """FE2: ``(feature, value, code)``; codes 0..k-1 follow the sorted values, at any number of categories."""
    pairs = long_values(df, cols).select(
        F.col("column_name").alias("feature"),
        F.coalesce("value", F.lit("nan")).alias("value")).distinct()
    return global_rank(pairs, ["value"], ["feature"], "code").withColumn("code", (F.col("code") - 1).cast("int"))


class LabelEncoder:
    """FE1 / FE3: fit on the distinct values, transform to int codes, inverse to text.

    Both directions join the mapping table, whatever its size; AQE broadcasts
    it while it is small."""

    def __init__(self, cols: Sequence[str], mapping_df: DataFrame):
        self.cols = list(cols)
        self.mapping_df = mapping_df

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str]) -> "LabelEncoder":
        """The mapping is written to the shared folder: it is read once per column."""
        return cls(cols, written(encoding_mapping(df, cols), "mapping"))

    def _joined(self, df: DataFrame, c: str, have: str, want: str, key: Column) -> DataFrame:
        m = self.mapping_df.where(F.col("feature") == c).select(
            F.col(have).alias("__have"), F.col(want).alias("__want"))
        return df.withColumn("__key", key).join(m, F.col("__key") == F.col("__have"), "left")

    def transform(self, df: DataFrame, strict: bool = True) -> DataFrame:
        """Replace each encoded column by its int code.  ``strict`` raises on an
        unseen category, otherwise it becomes NULL."""
        out = df
        for c in self.cols:
            out = self._joined(out, c, "value", "code", string_or_nan(c))
            code = F.col("__want")
            if strict:
                code = F.when(code.isNull(), F.raise_error(
                    F.concat(F.lit(f"unseen category in {c}: "), F.col("__key")))).otherwise(code)
            out = out.withColumn(c, code.cast("int")).drop("__key", "__have", "__want")
        return out

    def inverse(self, df: DataFrame, cols: Sequence[str] | None = None,
                strict: bool = True) -> DataFrame:
        """FE3: add ``<col>_decoded`` with the original text of each code."""
        out = df
        for c in list(cols) if cols is not None else self.cols:
            out = self._joined(out, c, "code", "value", F.col(c).cast("int"))
            val = F.col("__want")
            if strict:
                val = F.when(val.isNull() & F.col("__key").isNotNull(), F.raise_error(
                    F.concat(F.lit(f"unknown code in {c}: "), F.col("__key").cast("string")))).otherwise(val)
            out = out.withColumn(f"{c}_decoded", val).drop("__key", "__have", "__want")
        return out


def standard_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: mean and population std of each column."""
    return df.agg(*[e for c in cols for e in (
        F.avg(F.col(c).cast("double")).alias(f"{c}__mean"),
        F.stddev_pop(F.col(c).cast("double")).alias(f"{c}__std"))])


def standardize(df: DataFrame, cols: Sequence[str], stats: DataFrame | None = None) -> DataFrame:
    """FE4: ``(x - mean) / std_pop``; a constant column becomes 0, NULL stays NULL.

    ``stats`` may come from another frame (e.g. the training part)."""
    cols = [c for c in cols if c in df.columns]
    st = stats if stats is not None else standard_stats(df, cols)
    j = df.crossJoin(F.broadcast(st))
    exprs = {}
    for c in cols:
        x, m, s = F.col(c).cast("double"), F.col(f"{c}__mean"), F.col(f"{c}__std")
        exprs[c] = F.when(x.isNull(), F.lit(None).cast("double")).when(s == 0, F.lit(0.0)).otherwise((x - m) / s)
    return j.withColumns(exprs).drop(*[f"{c}__{k}" for c in cols for k in ("mean", "std")])


def minmax_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.agg(*[e for c in cols for e in (
        F.min(F.col(c).cast("double")).alias(f"{c}__min"),
        F.max(F.col(c).cast("double")).alias(f"{c}__max"))])


def minmax_scale(df: DataFrame, cols: Sequence[str], stats: DataFrame | None = None) -> DataFrame:
    """FE5: ``(x - min) / (max - min)``; a constant column becomes 0 (not 0.5)."""
    cols = [c for c in cols if c in df.columns]
    st = stats if stats is not None else minmax_stats(df, cols)
    j = df.crossJoin(F.broadcast(st))
    exprs = {}
    for c in cols:
        x, lo, hi = F.col(c).cast("double"), F.col(f"{c}__min"), F.col(f"{c}__max")
        exprs[c] = F.when(x.isNull(), F.lit(None).cast("double")).when(hi == lo, F.lit(0.0)).otherwise(
            (x - lo) / (hi - lo))
    return j.withColumns(exprs).drop(*[f"{c}__{k}" for c in cols for k in ("min", "max")])


def fold_scalers(df: DataFrame, cols: Sequence[str], fold_col: str = "fold", kind: str = "standard") -> dict:
    """FE4 / FE5 without leaks: ``{fold: {column: (shift, factor)}}`` fitted on the *other* folds, in one scan.

    ``standard``: the moments of the other folds are put together (parallel-variance
    formula).  ``minmax``: the extremes of the other folds are the best one, or
    the second-best where the fold itself holds the best.  A column that is
    constant on the training part has factor 0; NULL stays NULL."""
    if kind not in ("standard", "minmax"):
        raise ValueError("kind must be standard or minmax")
    aggs = []
    for i, c in enumerate(cols):
        x = number(c)
        aggs += ([F.count(x).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")] if kind == "standard"
                 else [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")])
    rows = {r["__fold"]: r for r in df.where(column(fold_col).isNotNull()).groupBy(column(fold_col).alias("__fold")).agg(*aggs).collect()}
    out: dict = {f: {} for f in rows}
    for i, c in enumerate(cols):
        if kind == "standard":
            for f in rows:
                parts = [(r[f"n{i}"], r[f"m{i}"], r[f"v{i}"]) for g, r in rows.items() if g != f and r[f"n{i}"]]
                n = sum(p[0] for p in parts)
                mean = sum(p[0] * p[1] for p in parts) / n if n else 0.0
                var = sum(p[0] * (p[2] + (p[1] - mean) ** 2) for p in parts) / n if n else 0.0
                out[f][c] = (mean, 1 / math.sqrt(var) if var > 0 else 0.0)
        else:
            low = sorted((r[f"lo{i}"], str(f), f) for f, r in rows.items() if r[f"lo{i}"] is not None)[:2]
            high = sorted(((r[f"hi{i}"], str(f), f) for f, r in rows.items() if r[f"hi{i}"] is not None), reverse=True)[:2]
            for f in rows:
                lo = next((x for x, _, g in low if g != f), 0.0)
                hi = next((x for x, _, g in high if g != f), 0.0)
                out[f][c] = (lo, 1 / (hi - lo) if hi > lo else 0.0)
    return out


def scale_by_fold(df: DataFrame, scalers: dict, fold_col: str = "fold") -> DataFrame:
    """Every row scaled by the scaler that has not seen its fold; one affine row a fold is broadcast."""
    cols = list(next(iter(scalers.values()), {}))
    if not cols:
        return df
    kind = df.schema[fold_col].dataType.simpleString()
    table = df.sparkSession.createDataFrame([(f, [s[c][0] for c in cols], [s[c][1] for c in cols]) for f, s in scalers.items()],
                                            f"__fold {kind}, __shift array<double>, __factor array<double>")
    j = df.join(F.broadcast(table), column(fold_col) == F.col("__fold"), "left")
    return j.withColumns({c: (column(c).cast("double") - F.get("__shift", F.lit(i))) * F.get("__factor", F.lit(i))
                          for i, c in enumerate(cols)}).drop("__fold", "__shift", "__factor")


def binarize(df: DataFrame, cols: Sequence[str], threshold: float = 0.0) -> DataFrame:
    """FE6: ``x > threshold`` as 0.0 / 1.0 (NULL stays NULL)."""
    return df.withColumns({c: (F.col(c) > F.lit(threshold)).cast("double") for c in cols})


def feature_columns(df: DataFrame, target: str, exclude: Sequence[str] = ()) -> list[str]:
    """FE7: every column except the target (and keys), in table order."""
    ex = set(exclude) | {target}
    return [c for c in df.columns if c not in ex]


def assemble(df: DataFrame, features: Sequence[str], output: str = "features") -> DataFrame:
    """FE7: feature vector in the given order.  Inputs are cast to double first so
    no nominal (categorical) metadata reaches tree learners: codes stay ordinal."""
    casted = df.withColumns({c: F.col(c).cast("double") for c in features})
    return VectorAssembler(inputCols=list(features), outputCol=output,
                           handleInvalid="keep").transform(casted)
