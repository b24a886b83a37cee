"""Projection, rename, selection and predicates (PRJ*, FLT*, REP1, LIM1).

All of these are narrow transformations: no shuffle, and plain predicates
stay pushable into the parquet scan.
"""

from __future__ import annotations

import re
from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions import col_of, not_equal_keep_null, string_or_nan


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """PRJ1: rename by a fixed map; names absent from ``df`` are ignored."""
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


def positional_map(columns: Sequence[str], names: Sequence[str], target_raw: str = "Class",
                   target: str = "deposit") -> dict[str, str]:
    """PRJ2 mapping: ``V<n>`` → ``names[n-1]``, ``target_raw`` → ``target``.

    ``V`` followed by anything but digits, or an index out of range, keeps its name.
    """
    out = {}
    for c in columns:
        m = re.fullmatch(r"V(\d+)", c)
        if m and 1 <= int(m.group(1)) <= len(names):
            out[c] = names[int(m.group(1)) - 1]
        elif c == target_raw:
            out[c] = target
    return out


def positional_rename(df: DataFrame, names: Sequence[str], target_raw: str = "Class",
                      target: str = "deposit") -> DataFrame:
    """PRJ2: positional rename (schema-only, computed on the driver from ``df.columns``)."""
    return rename(df, positional_map(df.columns, names, target_raw, target))


def drop_if_present(df: DataFrame, *cols: str) -> DataFrame:
    """PRJ3: drop columns; absent ones are a no-op."""
    return df.drop(*[c for c in cols if c in df.columns])


def recode(c, mapping: Mapping) -> Column:
    """PRJ7: simultaneous value recode (``{1: 0, 2: 1}`` never chains 1→0→…)."""
    cc = col_of(c)
    expr = None
    for k, v in mapping.items():
        expr = F.when(cc == F.lit(k), F.lit(v)) if expr is None else expr.when(cc == F.lit(k), F.lit(v))
    return expr.otherwise(cc) if expr is not None else cc


def recode_label(df: DataFrame, col: str, mapping: Mapping | None = None) -> DataFrame:
    """PRJ7 on a frame: default recode of the {1, 2} target to {0, 1}."""
    return df.withColumn(col, recode(col, mapping or {1: 0, 2: 1}))


def as_string_nan(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PRJ8: cast to string; missing becomes the literal ``nan``."""
    return df.withColumns({c: string_or_nan(c) for c in cols})


def drop_marker_rows(df: DataFrame, col: str, marker: str = "unknown") -> DataFrame:
    """FLT1: drop rows equal to the marker; rows with a missing value are kept."""
    return df.where(not_equal_keep_null(col, marker))


def replace_marker(df: DataFrame, col: str, marker: str, fill) -> DataFrame:
    """REP1: replace a marker by a value or by a column (e.g. a broadcast scalar)."""
    f = fill if isinstance(fill, Column) else F.lit(fill)
    return df.withColumn(col, F.when(F.col(col) == F.lit(marker), f).otherwise(F.col(col)))


def preview(df: DataFrame, n: int, key: str | Sequence[str]) -> DataFrame:
    """LIM1: the first ``n`` rows in key order (file order is not defined)."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(*keys).limit(n)
