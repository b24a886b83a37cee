"""Sources and sinks (SRC*, SNK*).

Tables are read with an explicit schema.  Delimited files are scanned as
strings, the missing-value vocabulary is mapped to NULL and the columns are
``try_cast`` to their declared types, so one ``NA`` never turns a numeric
column into text and a bad value never fails the job under ANSI mode.
"""

from __future__ import annotations

import warnings
from typing import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tabsmith.functions import NA_VALUES, column, normalize_nan


def _paths(paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


#: The line of a record that does not fit its columns.
_BROKEN = "__broken_record"

# One dialect for reading and writing: doubled quotes, blanks kept, "" for an empty text.
CSV_OPTIONS = dict(quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


# What counts as a number when no schema says so: no type suffixes, no hexadecimal floats.
_WHOLE = r"^[+-]?[0-9]+$"
_NUMBER = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))$"


def _typed(df: DataFrame) -> DataFrame:
    """Text columns as bigint or double where every present value is written as one (one aggregate, one row back)."""
    kinds = {"bigint": _WHOLE, "double": _NUMBER}
    fits = lambda c, k: column(c).rlike(kinds[k]) & column(c).try_cast(k).isNotNull()
    bad = df.agg(*[F.count_if(column(c).isNotNull() & ~fits(c, k)).alias(f"{k}{i}") for i, c in enumerate(df.columns) for k in kinds],
                 *[F.count(column(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    out = []
    for i, c in enumerate(df.columns):
        kind = next((k for k in kinds if bad[f"n{i}"] and bad[f"{k}{i}"] == 0), "string")
        out.append(column(c).try_cast(kind).alias(c))
    return df.select(out)


def _whole_records(reader, schema: T.StructType, paths: list[str]) -> DataFrame:
    """One record a line; a value that goes on over a line break is an error that says what to do."""
    raw = reader.schema(T.StructType([*schema.fields, T.StructField(_BROKEN, T.StringType())])).option(
        "columnNameOfCorruptRecord", _BROKEN).csv(paths)
    quotes = F.length(F.regexp_replace(F.col(_BROKEN), '[^"]', ""))
    error = F.raise_error(F.concat(F.lit("a quoted value holds a line break, read with multiline=True: "), F.col(_BROKEN)))
    # the scan wants a column of the file beside the broken record, also for a plain count
    some = F.coalesce(F.length(column(schema.fields[0].name)), F.lit(0)) >= 0
    return raw.where(F.when(F.col(_BROKEN).isNotNull() & (quotes % 2 == 1), error).otherwise(some)).drop(_BROKEN)


def read_table(spark: SparkSession, paths: str | Sequence[str],
               schema: T.StructType | str | None = None, fmt: str | None = None,
               na_values: Iterable[str] = NA_VALUES, header: bool = True, multiline: bool = False) -> DataFrame:
    """SRC1: read a parquet / CSV / JSON table.

    ``paths`` may be a list of candidates: the first that exists is read.
    For CSV, every value in ``na_values`` becomes NULL before typing; without
    a schema a column whose values are all whole numbers becomes bigint, all
    numbers double, anything else stays text (``1d`` and ``0x1p3`` are texts).
    Quotes are doubled inside quoted values.  A large file is split between
    tasks; that presumes one record a line, and a quoted line break is an error
    unless ``multiline=True`` reads each file in one task.
    """
    ps = _paths(paths)
    for p in ps[:-1]:
        try:
            return read_table(spark, p, schema, fmt, na_values, header, multiline)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    ps = ps[-1:]
    fmt = fmt or ("csv" if ps[0].endswith(".csv") else
                  "json" if ps[0].endswith(".json") else "parquet")
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    if fmt == "parquet":
        df = spark.read.parquet(*ps)
        if schema is not None:
            df = df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
        return normalize_nan(df)
    if fmt == "json":
        r = spark.read.schema(schema) if schema is not None else spark.read
        return normalize_nan(r.json(ps))
    # CSV: read as text, normalise the NA vocabulary, then type.
    reader = spark.read.options(header=header, mode="PERMISSIVE", multiLine=multiline, **CSV_OPTIONS)
    if schema is not None:
        text_schema = T.StructType([T.StructField(f.name, T.StringType(), True)
                                    for f in schema.fields])
    else:
        text_schema = reader.csv(ps).schema     # the header's names, all text
    raw = reader.schema(text_schema).csv(ps) if multiline or not text_schema.fields else _whole_records(reader, text_schema, ps)
    na = list(na_values)
    cols = []
    for f in raw.schema.fields:
        c = column(f.name)
        cleaned = F.when(c.isin(na), F.lit(None)).otherwise(c)
        target = None
        if schema is not None:
            target = schema[f.name].dataType
        if target is not None and not isinstance(target, T.StringType):
            cleaned = cleaned.try_cast(target)
        cols.append(cleaned.alias(f.name))
    out = raw.select(cols)
    if schema is None and cols:
        out = _typed(out)
    return normalize_nan(out)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: Sequence[str] | None = None) -> None:
    """SNK1: write a table (header on for CSV, never an index column)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.options(header=True, emptyValue='""', **CSV_OPTIONS).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """SNK2 / SNK3: a report table is small; one file keeps it readable.  Domains
    of any size go through ``write_table`` instead.  ``repartition`` leaves the
    report's last stage its own parallelism."""
    write_table(df.repartition(1), path, fmt=fmt)


# Column documents (SRC3), one row per value or one row per column with a list:
# {"column": ..., "type": ..., "value": ...} or {"column": ..., "type": ..., "values": [...], "count": n}
COLUMN_INFO_SCHEMA = T.StructType([
    T.StructField("column", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("values", T.ArrayType(T.StringType())),
    T.StructField("count", T.LongType()),
])


def read_domains(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: column-metadata JSON → expected domain pairs ``(column, value)``.

    A column whose list was cut when the document was written (a count without
    values) is an error, not an empty domain."""
    info = spark.read.schema(COLUMN_INFO_SCHEMA).json(path)
    cut = F.col("values").isNull() & F.col("value").isNull() & (F.col("count") > 0)
    values = F.when(cut, F.raise_error(F.concat(F.lit("domain list was cut: "), F.col("column")))
                    ).otherwise(F.coalesce("values", F.array("value")))
    return (info.where(F.col("type") == "categorical")
            .select("column", F.explode(values).alias("value")).where(F.col("value").isNotNull()))


def load_encoded(spark: SparkSession, table_path: str, mapping_path: str | None):
    """SRC4: reload the encoded table and its encoder mapping.

    A missing table is an error; a missing mapping only warns and yields None.
    """
    table = spark.read.parquet(table_path)
    mapping = None
    if mapping_path:
        try:
            mapping = spark.read.parquet(mapping_path)
            mapping.schema  # force resolution
        except AnalysisException:
            warnings.warn(f"encoder mapping not found at {mapping_path}")
            mapping = None
    return table, mapping
