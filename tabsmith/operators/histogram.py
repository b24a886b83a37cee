"""Equi-width histograms and adaptive distributions (AGG18-AGG20, EVL10).

Bin of ``x`` = ``least(floor((x - lo) * bins / (hi - lo)), bins - 1)``: the
last bin is right-closed (``width_bucket`` would put the maximum in bin
``bins + 1``).  A constant column gets the range ``[x - 0.5, x + 0.5]``.

Any number of columns, over all rows or per class, takes two scans: one for the
extremes of every (column, class), one that counts (column, class, bin) with a
map-side combine.  The extremes of a checked number of classes are a constant
map in the second scan, so no row is joined or shuffled for its range; more
classes than that are joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions import categorical_columns, column, number, numeric_columns
from tabsmith.operators.profile import distinct_counts
from tabsmith.session import written

#: Ranges are constants of the counting scan up to so many classes.
MAP_CLASSES = 200


def _range(mn: float, mx: float) -> tuple[float, float]:
    return (mn - 0.5, mx + 0.5) if mn == mx else (mn, mx)


def _bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    # an infinite range has no width: its values count in the first bin, its upper end in the last
    at = F.floor((x - lo) * F.lit(float(bins)) / (hi - lo))
    return F.greatest(F.least(F.coalesce(at.cast("int"), F.lit(0)), F.lit(bins - 1)), F.lit(0))


def _grid(ranges: DataFrame, keys: Sequence[str], counted: DataFrame, bins: int) -> DataFrame:
    """All bins of every range, with their counts (0 where none)."""
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    counted = counted.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("bin").alias("__bin"), F.col("count").alias("__n"))
    same = F.col("bin") == F.col("__bin")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    w = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return grid.join(counted, same, "left").select(
        *keys, "bin", (F.col("lo") + F.col("bin") * w).alias("lower"), (F.col("lo") + (F.col("bin") + 1) * w).alias("upper"),
        F.coalesce("__n", F.lit(0)).alias("count"))


def histograms(df: DataFrame, cols: Sequence[str], bins: int = 30) -> DataFrame:
    """AGG18 for many columns: ``(column_name, bin, lower, upper, count)``, empty bins too, in two scans.

    NaN and NULL are left out; a column without values has no bins."""
    spark = df.sparkSession
    cols = list(cols)
    first = df.agg(F.lit(1), *[f(number(c)).alias(f"{n}{i}") for i, c in enumerate(cols)
                               for n, f in (("lo", F.min), ("hi", F.max))]).first()
    ranges = [(i, c, *_range(first[f"lo{i}"], first[f"hi{i}"])) for i, c in enumerate(cols) if first[f"lo{i}"] is not None]
    frame = spark.createDataFrame([r[1:] for r in ranges], "column_name string, lo double, hi double")
    if not ranges:
        return frame.select("column_name", F.lit(0).alias("bin"), F.col("lo").alias("lower"), F.col("hi").alias("upper"),
                            F.lit(0).cast("long").alias("count"))
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.when(number(c).isNotNull(), _bin(number(c), F.lit(lo), F.lit(hi), bins))
                 .alias("bin")) for _, c, lo, hi in ranges]))).where("bin IS NOT NULL")
    counted = long.groupBy("column_name", "bin").agg(F.count(F.lit(1)).alias("count"))
    return _grid(frame, ["column_name"], counted, bins)


def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """AGG18: ``(bin, lower, upper, count)`` for all ``bins`` bins (empty ones too)."""
    return histograms(df, [col], bins).drop("column_name")


def histograms_by_class(df: DataFrame, cols: Sequence[str], label: str, bins: int = 30,
                        map_classes: int = MAP_CLASSES) -> DataFrame:
    """AGG19 for many columns: ``(column_name, label, bin, lower, upper, count)``; every class has its own
    range in every column.  Rows without a label are left out."""
    spark, cols = df.sparkSession, list(cols)
    kind = df.schema[label].dataType
    rows = df.where(column(label).isNotNull()).select(column(label).alias("label"), *[
        number(c).alias(f"x{i}") for i, c in enumerate(cols)])
    wide = rows.groupBy("label").agg(*[f(f"x{i}").alias(f"{n}{i}") for i in range(len(cols)) for n, f in (("lo", F.min), ("hi", F.max))])
    wide = written(wide, "ranges")
    same = lambda i: F.col(f"lo{i}") == F.col(f"hi{i}")
    ranges = wide.select("label", F.inline(F.array(*[F.struct(
        F.lit(i).alias("i"), F.lit(c).alias("column_name"),
        F.when(same(i), F.col(f"lo{i}") - 0.5).otherwise(F.col(f"lo{i}")).alias("lo"),
        F.when(same(i), F.col(f"hi{i}") + 0.5).otherwise(F.col(f"hi{i}")).alias("hi")) for i, c in enumerate(cols)]))
    ).where("lo IS NOT NULL")
    if wide.count() <= map_classes and isinstance(kind, (T.StringType, T.IntegralType, T.BooleanType, T.DateType)):
        found: dict[int, list] = {}           # classes x columns, both checked
        for r in ranges.collect():
            found.setdefault(r["i"], []).append(r)
        bins_of = []
        for i in range(len(cols)):
            at = F.lit(None).cast("struct<col1:double,col2:double>")
            if i in found:
                at = F.element_at(F.create_map(*[p for r in found[i] for p in (
                    F.lit(r["label"]).cast(kind), F.struct(F.lit(r["lo"]), F.lit(r["hi"])))]), F.col("label"))
            one = _bin(F.col(f"x{i}"), at["col1"], at["col2"], bins)
            bins_of.append(F.struct(F.lit(i).alias("i"), F.when(F.col(f"x{i}").isNotNull(), one).alias("bin")))
        binned = rows.select("label", F.inline(F.array(*bins_of))).where("bin IS NOT NULL")
    else:
        long = rows.select("label", F.inline(F.array(*[
            F.struct(F.lit(i).alias("i"), F.col(f"x{i}").alias("x")) for i in range(len(cols))]))).where("x IS NOT NULL")
        binned = long.join(ranges, ["label", "i"]).withColumn("bin", _bin(F.col("x"), F.col("lo"), F.col("hi"), bins))
    counted = binned.groupBy("i", "label", "bin").agg(F.count(F.lit(1)).alias("count"))
    return _grid(ranges, ["i", "column_name", "label"],
                 counted.withColumn("column_name", F.element_at(F.array(*map(F.lit, cols)), F.col("i") + 1)), bins).drop("i")


def histogram_by_class(df: DataFrame, col: str, label: str, bins: int = 30, map_classes: int = MAP_CLASSES) -> DataFrame:
    """AGG19: per class ``(label, bin, lower, upper, count)``; every class uses its own min/max range."""
    return histograms_by_class(df, [col], label, bins, map_classes).drop("column_name")


def adaptive_distribution(df: DataFrame, cols: Sequence[str] | None = None,
                          distinct_threshold: int = 50, bins: int = 30, top_numeric: int = 20,
                          max_categories: int = 20) -> DataFrame:
    """AGG20: numeric columns with more than ``distinct_threshold`` distinct values
    get a 30-bin histogram, other numeric columns their top-20 values,
    categorical columns their top ``max_categories`` values.

    Rows ``(column_name, kind, position, value, lower, upper, count)``; ``position``
    is the bin index or the 1-based rank.  The distinct counts decide (one row a
    column); then all histograms take two scans and all value lists one."""
    num = numeric_columns(df)
    cols = list(cols) if cols is not None else num + categorical_columns(df)
    nd = {r["column_name"]: r["n_unique"] for r in distinct_counts(df, cols).collect()}
    wide = [c for c in cols if c in num and nd[c] > distinct_threshold]
    none = F.lit(None)
    out = histograms(df, wide, bins).select(
        "column_name", F.lit("histogram").alias("kind"), F.col("bin").alias("position"), none.cast("string").alias("value"),
        "lower", "upper", "count")
    listed = [c for c in cols if c not in wide]
    if listed:
        # a number orders as a number, a text as a text; the text is what is shown
        long = df.select(F.inline(F.array(*[F.struct(
            F.lit(c).alias("column_name"), (column(c).cast("double") if c in num else none.cast("double")).alias("x"),
            column(c).cast("string").alias("value"), F.lit(top_numeric if c in num else max_categories).alias("k"))
            for c in listed]))).where("value IS NOT NULL")
        counts = long.groupBy("column_name", "x", "value", "k").agg(F.count(F.lit(1)).alias("count"))
        # the limit of every list bounds what each task forwards
        place = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("count"), "x", "value"))
        top = counts.withColumn("position", place).where(F.col("position") <= max(top_numeric, max_categories)).where("position <= k")
        out = out.unionByName(top.select(
            "column_name", F.lit("top_values").alias("kind"), "position", "value", none.cast("double").alias("lower"),
            none.cast("double").alias("upper"), "count"))
    return out


def score_distribution(scored: DataFrame, score: str = "score", label: str = "label",
                       bins_all: int = 50, bins_class: int = 30) -> DataFrame:
    """EVL10: probability distribution overall (50 bins) and per true class (30 bins,
    own range each): rows ``(scope, label, bin, lower, upper, count)``."""
    a = histogram(scored, score, bins_all).select(
        F.lit("all").alias("scope"), F.lit(None).cast(scored.schema[label].dataType).alias("label"),
        "bin", "lower", "upper", "count")
    b = histogram_by_class(scored, score, label, bins_class).select(
        F.lit("by_class").alias("scope"), "label", "bin", "lower", "upper", "count")
    return a.unionByName(b)
