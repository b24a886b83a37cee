"""Null- and NaN-safe column helpers shared by every operator.

pandas and Spark disagree on missing values in predicates, ordering, clipping
and rounding.  These helpers pin the pandas-visible behaviour once:

* a predicate on a missing value is *false* (the row fails the rule);
* NaN is not a value: it is turned into NULL before any comparison;
* clipping lets NULL through instead of snapping it to a bound;
* ratios of zero denominators are NULL instead of an ANSI error.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The default missing-value vocabulary of a delimited-file scan.
NA_VALUES = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Markers counted as missing in categorical columns (besides NULL).
MISSING_MARKERS = ["unknown", "Unknown", "?", "", "NaN", "N/A"]


def column(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def col_of(c) -> Column:
    return column(c) if isinstance(c, str) else c


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def is_categorical_type(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.BooleanType))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if is_numeric_type(f.dataType) and f.name not in ex]


def categorical_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if is_categorical_type(f.dataType) and f.name not in ex]


def type_class(dt: T.DataType) -> str:
    if is_numeric_type(dt):
        return "numerical"
    if is_categorical_type(dt):
        return "categorical"
    return "other"


def holds(pred: Column) -> Column:
    """A predicate that is false (never NULL) on missing input."""
    return F.coalesce(pred, F.lit(False))


def not_equal_keep_null(c, value) -> Column:
    """``c != value`` where a missing ``c`` is kept (pandas semantics)."""
    return ~col_of(c).eqNullSafe(F.lit(value))


def nan_to_null(c, dt: T.DataType | None = None) -> Column:
    """Replace NaN by NULL for floating columns; other types pass through."""
    cc = col_of(c)
    if dt is not None and not isinstance(dt, (T.DoubleType, T.FloatType)):
        return cc
    return F.when(F.isnan(cc), F.lit(None)).otherwise(cc)


def number(c) -> Column:
    """The column as double with NaN as NULL: what every numeric statistic reads."""
    x = col_of(c).cast("double")
    return F.when(~F.isnan(x), x)


def normalize_nan(df: DataFrame) -> DataFrame:
    """NaN → NULL in every floating column, so NaN never orders above values."""
    fl = {f.name for f in df.schema.fields
          if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not fl:
        return df
    return df.select([nan_to_null(f.name).alias(f.name) if f.name in fl else F.col(f.name)
                      for f in df.schema.fields])


def clip(c, lo, hi) -> Column:
    """Clip into [lo, hi]; NULL stays NULL and NaN stays NaN (``least/greatest`` would not)."""
    cc = col_of(c)
    lo_c = col_of(lo) if isinstance(lo, (str, Column)) else F.lit(lo)
    hi_c = col_of(hi) if isinstance(hi, (str, Column)) else F.lit(hi)
    return (F.when(F.isnan(cc), cc)
            .when(cc < lo_c, lo_c)
            .when(cc > hi_c, hi_c)
            .otherwise(cc))


def ratio(num, den) -> Column:
    """num / den as double, NULL when den is 0 (ANSI-safe)."""
    return F.try_divide(col_of(num).cast("double"), col_of(den).cast("double"))


def pct(num, den) -> Column:
    """Percentage num/den*100, NULL on an empty denominator."""
    return F.try_divide(col_of(num).cast("double") * F.lit(100.0),
                        col_of(den).cast("double"))


def string_or_nan(c) -> Column:
    """Cast to string with missing rendered as the literal ``nan``."""
    return F.coalesce(col_of(c).cast("string"), F.lit("nan"))


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column; used only to present results for comparison."""
    return df.select([
        F.round(F.col(f.name), digits).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields])
