"""Aggregations and profiling (AGG*, SRT*, TOP*).

Design rules used throughout:

* one fused ``agg`` per table pass (moments, null counts and percentiles
  share a single scan and a single partial/final aggregate);
* per-value counting goes through ``unpivot`` → ``groupBy(column, value)``
  so hot values collapse in the map-side partial aggregate;
* "most frequent value" is ``min(struct(-count, value))``, a declarative
  aggregate with partial merge, never a window over a whole column;
* nothing is collected except bounded decisions (cardinality probes).
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions import categorical_columns, column, number, numeric_columns, pct, type_class
from tabsmith.operators import quantiles as Q
from tabsmith.operators.rank import global_rank

DESCRIBE_PROBS = [0.25, 0.5, 0.75]


def _inline(structs: list[Column]) -> Column:
    return F.inline(F.array(*structs))


# ---------------------------------------------------------------- AGG1
def shape(df: DataFrame) -> DataFrame:
    """AGG1: one row ``(n_rows, n_columns)``."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"))


# ---------------------------------------------------------------- AGG2/AGG3
def describe(df: DataFrame, cols: Sequence[str] | None = None, with_missing: bool = False, **kw) -> DataFrame:
    """AGG2 (+AGG3 with ``with_missing``): the 8-number describe, long format.

    Rows ``(column, count, mean, std, min, p25, p50, p75, max[, missing, missing_pct])``;
    quartiles are exact and linearly interpolated; std is the sample std; NaN
    counts as missing.  The moments ride on the quantiles' first scan.
    """
    cols = list(cols) if cols is not None else numeric_columns(df)
    extra = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(cols):
        x = number(c)
        extra += [F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}"), F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}")]
    q, row = Q.quantiles_with(df, cols, DESCRIBE_PROBS, extra, **kw)
    out = []
    for i, c in enumerate(cols):
        n = row[f"__n{i}"]
        one = [c, n, row[f"a{i}"], row[f"s{i}"], row[f"mn{i}"], *(q[c][p] for p in DESCRIBE_PROBS), row[f"mx{i}"]]
        if with_missing:
            missing = row["__rows"] - n
            one += [missing, missing * 100.0 / row["__rows"] if row["__rows"] else None]
        out.append(tuple(one))
    schema = ("column_name string, count bigint, mean double, std double, min double, p25 double, p50 double, p75 double, "
              "max double" + (", missing bigint, missing_pct double" if with_missing else ""))
    return df.sparkSession.createDataFrame(out, schema)


def numeric_table(df: DataFrame, cols: Sequence[str] | None = None, **kw) -> DataFrame:
    """AGG3: describe plus ``missing`` and ``missing_pct`` per numeric column."""
    return describe(df, cols, with_missing=True, **kw)


# ---------------------------------------------------------------- unpivot core
def long_values(df: DataFrame, cols: Sequence[str], value_type: str = "string") -> DataFrame:
    """``(column, value)`` rows; NULL values are kept as NULL."""
    return df.select(_inline([
        F.struct(F.lit(c).alias("column_name"), column(c).cast(value_type).alias("value"))
        for c in cols]))


def value_counts_long(df: DataFrame, cols: Sequence[str], dropna: bool = True) -> DataFrame:
    """``(column, value, count)`` for many columns in one shuffle."""
    lv = long_values(df, cols)
    if dropna:
        lv = lv.where(F.col("value").isNotNull())
    return lv.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("count"))


# ---------------------------------------------------------------- AGG5/AGG6/AGG22
def value_counts(df: DataFrame, col: str, normalize: bool = False,
                 dropna: bool = True) -> DataFrame:
    """AGG5 (+AGG6 with ``normalize``): ``(value, count[, pct])``, most frequent first.

    Ties are ordered by value (a total order; first appearance is not defined
    on a distributed table).  The share is against all non-missing rows.
    """
    if normalize:
        return value_share(df, col)
    base = df.select(column(col).alias("value"))
    if dropna:
        base = base.where(F.col("value").isNotNull())
    vc = base.groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    return vc.orderBy(F.desc("count"), F.asc("value"))


def value_share(df: DataFrame, col: str) -> DataFrame:
    """AGG6: value counts with percentage of the total (total is a 1-row broadcast)."""
    vc = (df.select(column(col).alias("value")).where(F.col("value").isNotNull())
          .groupBy("value").agg(F.count(F.lit(1)).alias("count")))
    total = vc.agg(F.sum("count").alias("__total"))
    return (vc.crossJoin(F.broadcast(total))
            .select("value", "count", pct("count", "__total").alias("pct"))
            .orderBy(F.desc("count"), F.asc("value")))


def category_share_by_class(df: DataFrame, col: str, label: str) -> DataFrame:
    """AGG22: per class, each category's count and share within the class."""
    g = (df.where(column(col).isNotNull())
         .groupBy(column(label).alias("label"), column(col).alias("value"))
         .agg(F.count(F.lit(1)).alias("count")))
    tot = g.groupBy("label").agg(F.sum("count").alias("__t"))
    # AQE broadcasts the totals while they are small; labels may be many
    return g.join(tot, "label").select("label", "value", "count", pct("count", "__t").alias("pct"))


# ---------------------------------------------------------------- AGG7
def null_counts(df: DataFrame, cols: Sequence[str] | None = None,
                only_missing: bool = False) -> DataFrame:
    """AGG7: ``(column, missing, missing_pct)`` from one fused aggregate.

    NaN in floating columns counts as missing.
    """
    cols = list(cols) if cols is not None else df.columns
    dtypes = dict((f.name, f.dataType) for f in df.schema.fields)

    def miss(c):
        x = column(c)
        m = x.isNull()
        if isinstance(dtypes[c], (T.DoubleType, T.FloatType)):
            m = m | F.isnan(x)
        return m

    wide = df.agg(F.count(F.lit(1)).alias("__n"),
                  *[F.count_if(miss(c)).alias(f"m{i}") for i, c in enumerate(cols)])
    out = wide.select(_inline([
        F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("missing"),
                 pct(F.col(f"m{i}"), F.col("__n")).alias("missing_pct"))
        for i, c in enumerate(cols)]))
    return out.where(F.col("missing") > 0) if only_missing else out


# ---------------------------------------------------------------- AGG10/AGG11/AGG12
def mode_long(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AGG11 for many columns: ``(column, mode, mode_count)``; smallest value wins ties,
    missing ignored.  ``min(struct(-count, value))`` merges partially, so no
    column's value set is ever gathered in one task."""
    vc = value_counts_long(df, cols)
    best = vc.groupBy("column_name").agg(
        F.min(F.struct((-F.col("count")).alias("nc"), F.col("value").alias("v"))).alias("b"))
    return best.select("column_name", F.col("b.v").alias("mode"), (-F.col("b.nc")).alias("mode_count"))


def mode(df: DataFrame, col: str) -> DataFrame:
    """AGG11: one row ``(mode, mode_count)`` (value keeps its type)."""
    vc = (df.where(column(col).isNotNull()).groupBy(column(col).alias("v"))
          .agg(F.count(F.lit(1)).alias("n")))
    b = vc.agg(F.min(F.struct((-F.col("n")).alias("nc"), F.col("v"))).alias("b"))
    return b.select(F.col("b.v").alias("mode"), (-F.col("b.nc")).alias("mode_count"))


def _as_long(df: DataFrame, c: str) -> Column | None:
    """A column of whole numbers, dates, times, flags or short decimals as a long that is equal where it is equal."""
    kind = df.schema[c].dataType
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return column(c).cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(column(c)).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column(c))
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return (column(c) * F.lit(10 ** kind.scale).cast("decimal(19,0)")).cast("long")
    return None


def typed_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(i, l, d, s)``: one row per value of ``cols[i]`` in the field of its own type, missing left out.

    Whole numbers and times are longs, floating numbers doubles (NaN is missing,
    -0.0 is 0.0), everything else text; no number becomes text."""
    rows = []
    for i, c in enumerate(cols):
        kind, long = df.schema[c].dataType, _as_long(df, c)
        floating = isinstance(kind, (T.DoubleType, T.FloatType))
        rows.append(F.struct(
            F.lit(i).alias("i"), (F.lit(None).cast("long") if long is None else long).alias("l"),
            (number(c) + F.lit(0.0) if floating else F.lit(None).cast("double")).alias("d"),
            (column(c).cast("string") if long is None and not floating else F.lit(None).cast("string")).alias("s")))
    return df.select(_inline(rows)).where("l IS NOT NULL OR d IS NOT NULL OR s IS NOT NULL")


#: Integers are counted in bitmaps where these take at most so many bytes a row.
BITMAP_BYTES = 16


def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None,
                    approx: bool = False, bitmap_bytes: int = BITMAP_BYTES) -> DataFrame:
    """AGG12: ``(column, n_unique)`` non-missing distinct counts (NaN is missing,
    -0.0 equals 0.0).

    Exact form: integer-like columns whose values lie dense are counted in bitmaps
    of 32,768 values each, which merge before the shuffle; all other values are
    made distinct in their own type by one shuffle, then counted per column.
    ``approx`` uses HLL++ in a single pass.
    """
    cols = list(cols) if cols is not None else df.columns
    spark = df.sparkSession
    if approx:
        floating = (T.DoubleType, T.FloatType)
        row = df.agg(*[F.approx_count_distinct(
            number(c) + F.lit(0.0) if isinstance(df.schema[c].dataType, floating) else column(c)).alias(f"d{i}")
            for i, c in enumerate(cols)]).first()
        return spark.createDataFrame([(c, row[i]) for i, c in enumerate(cols)], "column_name string, n_unique bigint")
    longs = {i: x for i, x in ((i, _as_long(df, c)) for i, c in enumerate(cols)) if x is not None}
    dense: list[int] = []
    if longs:
        row = df.agg(F.count(F.lit(1)).alias("n"), *[f(x).alias(f"{k}{i}") for i, x in longs.items()
                                                      for k, f in (("lo", F.min), ("hi", F.max))]).first()
        dense = [i for i in longs if row[f"lo{i}"] is not None
                 and ((row[f"hi{i}"] - row[f"lo{i}"]) // 32_768 + 1) * 4096 <= bitmap_bytes * row["n"]]
    rest = [i for i in range(len(cols)) if i not in dense]
    names = F.array(*map(F.lit, cols))
    got = spark.createDataFrame([(c, 0) for c in cols], "column_name string, n bigint")
    if rest:
        pairs = typed_values(df, [cols[i] for i in rest]).distinct()
        back = F.element_at(F.array(*map(F.lit, rest)), F.col("i") + 1)
        got = got.unionByName(pairs.groupBy("i").agg(F.count(F.lit(1)).alias("n")).select(
            F.element_at(names, back + 1).alias("column_name"), "n"))
    if dense:
        bits = df.select(_inline([F.struct(F.lit(i).alias("i"), longs[i].alias("l")) for i in dense])).where("l IS NOT NULL")
        maps = bits.groupBy("i", F.bitmap_bucket_number("l").alias("b")).agg(
            F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("l"))).alias("n"))
        got = got.unionByName(maps.groupBy("i").agg(F.sum("n").alias("n")).select(
            F.element_at(names, F.col("i") + 1).alias("column_name"), "n"))
    return got.groupBy("column_name").agg(F.sum("n").alias("n_unique"))


def distinct_values(df: DataFrame, cols: Sequence[str] | None = None,
                    max_values: int = 1000) -> DataFrame:
    """AGG10: ``(column, values, count, truncated)``.

    ``values`` is the sorted list of distinct values with missing rendered as
    ``nan`` (it counts as a value); ``count`` is exact.  A list is only built
    for columns with at most ``max_values`` distinct values, so one report row
    stays bounded; above the cap ``values`` is NULL and ``truncated`` is true.
    """
    cols = list(cols) if cols is not None else categorical_columns(df)
    pairs = long_values(df, cols).select(
        "column_name", F.coalesce("value", F.lit("nan")).alias("value")).distinct()
    counts = pairs.groupBy("column_name").agg(F.count(F.lit(1)).alias("count"))
    small = (pairs.join(counts.where(F.col("count") <= max_values).select("column_name"), "column_name",
                        "left_semi")
             .groupBy("column_name").agg(F.array_sort(F.collect_list("value")).alias("values")))
    return (counts.join(small, "column_name", "left")
            .select("column_name", "values", "count",
                    (F.col("count") > max_values).alias("truncated")))


def distinct_values_long(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """AGG10, whole: every ``(column, value)`` pair once, missing as ``nan``.

    No list is built, so a near-unique column stays spread over the shuffle
    partitions; this is the form to use where ``distinct_values`` truncates."""
    cols = list(cols) if cols is not None else categorical_columns(df)
    return long_values(df, cols).select(
        "column_name", F.coalesce("value", F.lit("nan")).alias("value")).distinct()


def domain_document(df: DataFrame) -> DataFrame:
    """Column metadata in long form ``(column_name, type, value)``: one row per
    distinct value of a categorical column, one row with a NULL value for any
    other.  No list is built, so a domain of any size is whole; written as
    JSON it is the expected-domain input of SRC3."""
    types = [(f.name, type_class(f.dataType)) for f in df.schema.fields]
    cats = [n for n, t in types if t == "categorical"]
    rest = df.sparkSession.createDataFrame([t for t in types if t[0] not in cats],
                                           "column_name string, type string").withColumn(
        "value", F.lit(None).cast("string"))
    if not cats:
        return rest
    return distinct_values_long(df, cols=cats).select(
        "column_name", F.lit("categorical").alias("type"), "value").unionByName(rest)


def column_info(df: DataFrame, max_values: int = 1000) -> DataFrame:
    """Column metadata document rows ``(column, type, values, count)``.

    Categorical columns carry their distinct values (AGG10); others only the
    type class.  This is the readable report; ``domain_document`` holds domains of
    any size, and SRC3 refuses a report whose list was cut.
    """
    types = [(f.name, type_class(f.dataType)) for f in df.schema.fields]
    cats = [n for n, t in types if t == "categorical"]
    meta = df.sparkSession.createDataFrame(types, "column_name string, type string")
    if not cats:
        return meta.select("column_name", "type", F.lit(None).cast("array<string>").alias("values"),
                           F.lit(None).cast("bigint").alias("count"))
    dv = distinct_values(df, cats, max_values=max_values).select("column_name", "values", "count")
    return meta.join(dv, "column_name", "left").select("column_name", "type", "values", "count")


# ---------------------------------------------------------------- AGG4
def categorical_table(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """AGG4: per categorical column ``(feature, unique_values, missing, missing_pct,
    most_common, most_common_count, most_common_pct)``.

    ``unique_values`` counts missing as one value; an all-missing column has
    mode ``N/A`` with count 0.  One shuffle over ``(column, value)`` pairs.
    """
    cols = list(cols) if cols is not None else categorical_columns(df)
    vc = long_values(df, cols).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    per = vc.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("unique_values"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
        F.sum("n").alias("__total"),
        F.min(F.when(F.col("value").isNotNull(),
                     F.struct((-F.col("n")).alias("nc"), F.col("value").alias("v")))).alias("b"))
    return per.select(
        F.col("column_name").alias("feature"),
        F.col("unique_values").cast("bigint").alias("unique_values"),
        F.col("missing").cast("bigint").alias("missing"),
        pct("missing", "__total").alias("missing_pct"),
        F.coalesce(F.col("b.v"), F.lit("N/A")).alias("most_common"),
        F.coalesce(-F.col("b.nc"), F.lit(0)).cast("bigint").alias("most_common_count"),
        F.coalesce(pct(-F.col("b.nc"), F.col("__total")), F.lit(0.0)).alias("most_common_pct"))


# ---------------------------------------------------------------- AGG13/AGG21
def imbalance_ratio(df: DataFrame, label: str) -> DataFrame:
    """AGG13: ``(n_classes, majority, minority, ratio)``; ratio only for 2 classes."""
    vc = df.where(column(label).isNotNull()).groupBy(column(label)).agg(F.count(F.lit(1)).alias("n"))
    return vc.agg(F.count(F.lit(1)).alias("n_classes"), F.max("n").alias("majority"),
                  F.min("n").alias("minority")).select(
        "n_classes", "majority", "minority",
        F.when(F.col("n_classes") == 2, F.try_divide(F.col("majority").cast("double"),
                                                     F.col("minority").cast("double")))
        .alias("ratio"))


def positive_rate(df: DataFrame, label: str, positive=1) -> DataFrame:
    """AGG21: share of rows whose label equals ``positive``."""
    return df.agg(F.avg((column(label) == F.lit(positive)).cast("double")).alias("positive_rate"),
                  F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- AGG15/16/17
def quantile_table(df: DataFrame, cols: Sequence[str], probs: Sequence[float], **kw) -> DataFrame:
    """AGG15: ``(column, prob, value)`` exact, linearly interpolated."""
    got = Q.quantiles(df, cols, probs, **kw)
    return df.sparkSession.createDataFrame([(c, float(p), got[c][float(p)]) for c in cols for p in probs],
                                           "column_name string, prob double, value double")


def _fences(df: DataFrame, cols: Sequence[str], whisker: float) -> dict[str, tuple]:
    """``{column: (q1, median, q3, lower fence, upper fence)}`` from exact quartiles (None without values)."""
    out = {}
    for c, q in Q.quantiles(df, cols, DESCRIBE_PROBS).items():
        q1, q2, q3 = (q[p] for p in DESCRIBE_PROBS)
        span = None if q1 is None else whisker * (q3 - q1)
        out[c] = (q1, q2, q3, None, None) if q1 is None else (q1, q2, q3, q1 - span, q3 + span)
    return out


def tukey_counts(df: DataFrame, cols: Sequence[str], whisker: float = 1.5) -> DataFrame:
    """AGG16: ``(column, q1, q3, lower_fence, upper_fence, n_outliers)``; the fences are constants of one scan."""
    f = _fences(df, cols, whisker)
    n = df.agg(*[F.count_if((number(c) < F.lit(f[c][3])) | (number(c) > F.lit(f[c][4]))).alias(f"n{i}")
                 for i, c in enumerate(cols)]).first()
    return df.sparkSession.createDataFrame(
        [(c, f[c][0], f[c][2], f[c][3], f[c][4], n[i]) for i, c in enumerate(cols)],
        "column_name string, q1 double, q3 double, lower_fence double, upper_fence double, n_outliers bigint")


def box_data(df: DataFrame, cols: Sequence[str], whisker: float = 1.5) -> DataFrame:
    """AGG17: box-plot data ``(column, median, q1, q3, whisker_low, whisker_high,
    n_outliers, mean, std)``; whiskers are the extreme data inside the fences."""
    f = _fences(df, cols, whisker)
    aggs = []
    for i, c in enumerate(cols):
        x, lo, hi = number(c), F.lit(f[c][3]).cast("double"), F.lit(f[c][4]).cast("double")
        inside = (x >= lo) & (x <= hi)
        aggs += [F.min(F.when(inside, x)).alias(f"wl{i}"), F.max(F.when(inside, x)).alias(f"wh{i}"),
                 F.count_if((x < lo) | (x > hi)).alias(f"n{i}"), F.avg(x).alias(f"m{i}"), F.stddev_samp(x).alias(f"s{i}")]
    g = df.agg(*aggs).first()
    return df.sparkSession.createDataFrame(
        [(c, f[c][1], f[c][0], f[c][2], *(g[f"{k}{i}"] for k in ("wl", "wh", "n", "m", "s"))) for i, c in enumerate(cols)],
        "column_name string, median double, q1 double, q3 double, whisker_low double, whisker_high double, "
        "n_outliers bigint, mean double, std double")


# ---------------------------------------------------------------- SRT/TOP/SET
def sort_desc(df: DataFrame, value: str, key: str) -> DataFrame:
    """SRT1: order by ``value`` descending, ties by ``key``; adds a 1-based ``rank``, at any number of rows."""
    return global_rank(df, [column(value).desc(), column(key).asc()], out="rank")


def sorted_distinct(df: DataFrame, col: str) -> DataFrame:
    """SRT2: sorted distinct non-missing values with their position, at any number of values."""
    d = df.select(column(col).alias("value")).where(F.col("value").isNotNull()).distinct()
    return global_rank(d, ["value"], out="position").orderBy("value")


def top_k(df: DataFrame, value: str, k: int, key: str) -> DataFrame:
    """TOP1: the ``k`` rows with the largest ``value`` (ties by ``key``).

    ``orderBy().limit()`` plans as ``TakeOrderedAndProject``: each task keeps
    only ``k`` rows."""
    return df.orderBy(F.desc(value), F.asc(key)).limit(k)


def top_k_per_group(df: DataFrame, group: str, value: str, k: int, key: str) -> DataFrame:
    """TOP1 per group: the ``k`` rows with the largest ``value`` (ties by
    ``key``) inside each group, with their ``rank``.

    ``row_number() <= k`` plans as a partial ``WindowGroupLimit`` before the
    shuffle (k ≤ ``spark.sql.optimizer.windowGroupLimitThreshold``): every
    map task forwards only its own top ``k`` per group, so a group holding a
    third of the rows reaches its final task as at most k rows per map task."""
    w = Window.partitionBy(group).orderBy(F.desc(value), F.asc(key))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def arg_max(df: DataFrame, item: str, metric: str) -> DataFrame:
    """TOP2: the item with the largest metric (``max_by``); ties → smallest item."""
    b = df.where(F.col(metric).isNotNull()).agg(
        F.min(F.struct((-F.col(metric)).alias("m"), F.col(item).alias("i"))).alias("b"))
    return b.select(F.col("b.i").alias(item), (-F.col("b.m")).alias(metric))


def set_difference(observed: DataFrame, expected: DataFrame, on: Sequence[str]) -> DataFrame:
    """SET1: distinct observed keys absent from ``expected`` (left-anti join).

    AQE broadcasts the domain side when it is small; no size is assumed here."""
    return observed.select(*on).distinct().join(expected.select(*on).distinct(), list(on), "left_anti")
