"""Exact, repeatable stratified splits (SPL1-SPL3).

Rows are ranked inside their class by ``md5(key || seed)`` (ties by key);
the test part of a hold-out is ``rank <= floor(frac * n_class + 0.5)`` and a
k-fold assignment is ``(rank - 1) % k``, so per-class proportions are exact
and fold sizes differ by at most one.  ``md5`` text is identical in Spark and
DuckDB, so the oracle reproduces every assignment.

A plain ``row_number() over (partition by label ...)`` would run each class
in a single task.  Ranking is therefore two-level: rows are bucketed by the
first hex digits of the hash; a small ``(label, bucket)`` count table gives
each bucket its offset (running sum over at most 16^digits rows per class)
and ``row_number`` runs inside ``(label, bucket)`` only.  The join of the
offset table and the window share the ``(label, bucket)`` partitioning.
The number of digits follows the counted rows (about ``ROWS_PER_BUCKET`` rows
per bucket).  Rows without a label form a class of their own; no row is lost.  The offset window runs over the
``(label, bucket)`` count table only, at most 16^digits rows per class.  The unshuffled
split ranks by the key itself over ranges (``rank.global_rank``), so keys may be text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.operators.rank import global_rank


def hash_key(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))


ROWS_PER_BUCKET = 2_000_000


def _digits_for(n: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    if n <= 0:
        return 1
    return int(min(6, max(1, math.ceil(math.log(max(n / rows_per_bucket, 1.0), 16)))))


def stratified_rank(df: DataFrame, label: str, key: str, seed: int = 42,
                    shuffle: bool = True, digits: int | None = None) -> DataFrame:
    """Add ``__rank`` (1-based, inside the class) and ``__n_class``.

    ``shuffle=False`` ranks by ``key`` itself, of any orderable type (SPL3).
    ``digits=None`` picks the number of hash digits from the row count."""
    if not shuffle:
        ranked = global_rank(df, [key], [label], "__rank")
        sizes = df.groupBy(F.col(label).alias("__l")).agg(F.count(F.lit(1)).alias("__n_class"))
        return ranked.join(sizes, ranked[label].eqNullSafe(sizes["__l"])).drop("__l")
    if digits is None:
        digits = _digits_for(df.count())
    h = hash_key(key, seed)
    base = df.withColumn("__h", h).withColumn("__b", F.substring("__h", 1, digits))
    counts = base.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__c"))
    wcls = Window.partitionBy(label).orderBy("__b")
    offsets = counts.select(
        label, "__b",
        (F.sum("__c").over(wcls.rowsBetween(Window.unboundedPreceding, Window.currentRow))
         - F.col("__c")).alias("__off"),
        F.sum("__c").over(Window.partitionBy(label)).alias("__n_class"))
    # null-safe: rows without a label or key are a class and a bucket of their own
    offsets = offsets.withColumnsRenamed({label: "__l", "__b": "__ob"})
    j = base.join(offsets, base[label].eqNullSafe(offsets["__l"]) & base["__b"].eqNullSafe(offsets["__ob"])).drop(
        "__l", "__ob")
    wb = Window.partitionBy(label, "__b").orderBy(F.col("__h"), F.col(key))
    out = j.withColumn("__rank", F.col("__off") + F.row_number().over(wb))
    return out.drop("__h", "__b", "__off")


def n_test(n_class: Column, frac: float) -> Column:
    return F.floor(n_class.cast("double") * F.lit(frac) + F.lit(0.5))


def holdout(df: DataFrame, label: str, key: str, test_frac: float = 0.2, seed: int = 42,
            digits: int | None = None) -> DataFrame:
    """SPL1: add ``is_test`` (boolean): exactly ``round(test_frac * n_class)`` rows of
    every class are test rows."""
    r = stratified_rank(df, label, key, seed, True, digits)
    return r.withColumn("is_test", F.col("__rank") <= n_test(F.col("__n_class"), test_frac)).drop(
        "__rank", "__n_class")


def kfold(df: DataFrame, label: str, key: str, k: int = 10, seed: int = 42,
          shuffle: bool = True, digits: int | None = None) -> DataFrame:
    """SPL2 (shuffled) / SPL3 (``shuffle=False``): add ``fold`` in ``0..k-1``."""
    r = (stratified_rank(df, label, key, seed, True, digits) if shuffle
         else global_rank(df, [key], [label], "__rank"))
    return r.withColumn("fold", ((F.col("__rank") - 1) % k).cast("int")).drop("__rank", "__n_class")
