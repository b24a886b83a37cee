"""Ranks and running sums over any order, without a window over a whole group.

Rows are dealt to ranges of (group, order), so a group with a third of the rows
spans many ranges.  Each range gives one total per group; their running sums are
the offsets, and the window that is left covers one group's rows of one range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions import column
from tabsmith.session import written

#: Rows of one range, about.
RANGE_ROWS = 1_000_000
#: Offsets are broadcast only if they are at most so many rows.
BROADCAST_ROWS = 100_000
_UID, _RANGE, _BEFORE = "__uid", "__range", "__before"


def running_sum(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), value: Column | None = None,
                out: str = "running", range_rows: int = RANGE_ROWS, rows: int | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its group up to and with its own, in ``order``.

    ``order`` are column names or sort expressions of any orderable type; NULL
    keys come where the expression puts them (first by default), NULL groups are
    groups.  Rows alike in ``order`` follow each other in an arbitrary but fixed
    order, and are spread over ranges too.  ``value`` is by default 1, which
    gives row numbers.  Sums are long.  An existing column ``out`` is replaced.

    The rows are counted once (``rows``: a bound the caller knows); no more than
    ``range_rows`` of them make one range and need no offsets.
    """
    df = df.drop(out)
    keys = [column(c) if isinstance(c, str) else c for c in order]
    groups = [column(c) for c in by]
    value = F.lit(1) if value is None else value
    table = df.withColumn("__value", F.coalesce(value.cast("long"), F.lit(0).cast("long")))
    within = (Window.partitionBy(*groups, _RANGE).orderBy(*keys, _UID)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    names = [column(c) for c in df.columns]
    if rows is None:
        table = written(table, "unranked")
        rows = table.count()
    table = table.withColumn(_UID, F.monotonically_increasing_id())
    if rows <= range_rows:
        return (table.withColumn(_RANGE, F.lit(0)).withColumn(out, F.sum("__value").over(within))
                .select(*names, out))
    table = written(table, "numbered")
    table = written(table.repartitionByRange(-(-rows // range_rows), *groups, *keys, F.col(_UID))
                    .withColumn(_RANGE, F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy(*groups).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(table.groupBy(*groups, _RANGE).agg(F.sum("__value").alias("__total"))
                      .select(*(g.alias(f"__by{i}") for i, g in enumerate(groups)), F.col(_RANGE).alias("__r"),
                              F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias(_BEFORE)), "offsets")
    small = F.broadcast(offsets) if offsets.count() <= BROADCAST_ROWS else offsets
    same = F.col(_RANGE) == F.col("__r")
    for i, g in enumerate(groups):
        same = same & g.eqNullSafe(F.col(f"__by{i}"))
    placed = table.join(small, same).withColumn(out, F.col(_BEFORE) + F.sum("__value").over(within))
    return placed.select(*names, out)


def global_rank(df: DataFrame, order: Sequence[str | Column], by: Sequence[str] = (), out: str = "rank",
                range_rows: int = RANGE_ROWS, rows: int | None = None) -> DataFrame:
    """``df`` with the row number (from 1) of every row within its group, in ``order``."""
    return running_sum(df, order, by, None, out, range_rows, rows)
