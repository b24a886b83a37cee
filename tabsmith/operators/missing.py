"""Missing-value report and policy (AGG8, AGG9, CLN1, CLN2).

The report is one fused aggregate: a NULL/NaN count per column plus one
``count_if(c = marker)`` per (string column, marker).  The policy is a list of
steps applied in order; the mode used for filling is a one-row aggregate
that is cross-joined (broadcast) instead of being collected.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions import MISSING_MARKERS, is_categorical_type, pct

# Recommendation tiers on the missing percentage rounded to 2 dp.
TIER_NONE = "none"
TIER_DROP_ROWS = "drop_rows"            # below 1 %
TIER_IMPUTE = "impute_mode_or_mean"     # below 10 %
TIER_MODEL_OR_DROP = "model_impute_or_drop_column"  # 10 % and above


def _wide_counts(df: DataFrame, markers: Sequence[str]):
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("__n")]
    plan = []  # (column, missing_type, alias)
    for i, f in enumerate(fields):
        x = F.col(f"`{f.name}`")
        miss = x.isNull()
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            miss = miss | F.isnan(x)
        elif isinstance(f.dataType, T.StringType) and "NaN" in markers:
            miss = miss | (x == F.lit("NaN"))    # one NaN entry per column
        aggs.append(F.count_if(miss).alias(f"n{i}"))
        plan.append((f.name, "NaN", f"n{i}", True))
        if isinstance(f.dataType, T.StringType):
            for j, m in enumerate(markers):
                if m == "NaN":
                    continue
                aggs.append(F.count_if(x == F.lit(m)).alias(f"m{i}_{j}"))
                plan.append((f.name, m, f"m{i}_{j}", False))
    return df.agg(*aggs), plan


def missing_types(df: DataFrame, markers: Sequence[str] = MISSING_MARKERS) -> DataFrame:
    """AGG8 detail: ``(column_name, missing_type, count, percentage)``.

    The ``NaN`` entry (NULL, NaN or that text) is always present; a marker entry only
    when it occurs.  Markers are only counted in string columns."""
    wide, plan = _wide_counts(df, markers)
    long = wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("missing_type"),
                 F.col(a).alias("count"), pct(F.col(a), F.col("__n")).alias("percentage"),
                 F.lit(is_null).alias("__null"))
        for c, t, a, is_null in plan])))
    return long.where(F.col("__null") | (F.col("count") > 0)).drop("__null")


def tier(pct_col) -> F.Column:
    """AGG9: recommendation tier from the percentage rounded to 2 dp."""
    r = F.round(pct_col, 2)
    return (F.when(pct_col.isNull() | (pct_col == 0), F.lit(TIER_NONE))
            .when(r < 1, F.lit(TIER_DROP_ROWS))
            .when(r < 10, F.lit(TIER_IMPUTE))
            .otherwise(F.lit(TIER_MODEL_OR_DROP)))


def missing_report(df: DataFrame, markers: Sequence[str] = MISSING_MARKERS) -> DataFrame:
    """AGG8 + AGG9: ``(column_name, dtype, is_categorical, total_missing,
    missing_percentage, recommendation)``, one row per column.

    NULL and marker counts are disjoint (a NULL never equals a marker), so
    the total is their sum."""
    wide, plan = _wide_counts(df, markers)
    dtypes = {f.name: f.dataType for f in df.schema.fields}
    structs = []
    for c in df.columns:
        aliases = [a for cc, _, a, _n in plan if cc == c]
        total = sum((F.col(a) for a in aliases[1:]), F.col(aliases[0]))
        structs.append(F.struct(
            F.lit(c).alias("column_name"), F.lit(dtypes[c].simpleString()).alias("dtype"),
            F.lit(isinstance(dtypes[c], T.StringType)).alias("is_categorical"),
            total.alias("total_missing"), pct(total, F.col("__n")).alias("missing_percentage")))
    out = wide.select(F.inline(F.array(*structs)))
    return out.withColumn("recommendation", tier(F.col("missing_percentage")))


# ---------------------------------------------------------------- CLN1 / CLN2
@dataclass(frozen=True)
class Step:
    column: str
    action: str          # drop_rows | fill_mode | keep | drop_column
    marker: str | None = "unknown"


# The cleaning policy of the original workflow, in order.
REFERENCE_POLICY = [
    Step("job", "drop_rows", "unknown"),
    Step("education", "fill_mode", "unknown"),
    Step("contact", "keep", "unknown"),
    Step("poutcome", "drop_column", None),
]


def _mode_row(df: DataFrame, col: str, marker: str | None, alias: str) -> DataFrame:
    x = F.col(col)
    cond = x.isNotNull() if marker is None else x.isNotNull() & (x != F.lit(marker))
    vc = df.where(cond).groupBy(x.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return vc.agg(F.min(F.struct((-F.col("n")).alias("nc"), F.col("v"))).alias("b")).select(
        F.col("b.v").alias(alias))


def apply_policy(df: DataFrame, policy: Sequence[Step] = REFERENCE_POLICY
                 ) -> tuple[DataFrame, DataFrame]:
    """CLN1 + CLN2: apply the steps in order; return ``(clean_df, audit_df)``.

    ``audit_df`` rows: ``(step, column_name, action, affected, fill_value)``
    where ``affected`` is rows removed / values replaced / markers kept.
    Steps on absent columns are skipped.  The mode of a fill step is
    computed after the preceding drops and without the marker; it reaches
    the rows as a one-row broadcast, never through the driver.
    """
    cur = df
    # the same steps without dropping rows: __alive marks the rows still there, __a<i> what step i hits
    seen = df.withColumn("__alive", F.lit(True))
    alive = F.col("__alive")
    audit_aggs = []
    audit_meta = []
    fills = []
    for i, st in enumerate(policy):
        if st.column not in cur.columns:
            continue
        x = F.col(st.column)
        hit = x.eqNullSafe(F.lit(st.marker)) if st.marker is not None else F.lit(False)
        if st.action == "drop_rows":
            audit_aggs.append(F.count_if(f"__a{i}").alias(f"a{i}"))
            cur = cur.where(~hit)
            seen = seen.withColumn(f"__a{i}", alive & hit).withColumn("__alive", alive & ~hit)
        elif st.action == "fill_mode":
            fill = F.col(f"__fill{i}")
            audit_aggs += [F.count_if(f"__a{i}").alias(f"a{i}"), F.max(fill).alias(f"__fill{i}")]
            m = _mode_row(cur, st.column, st.marker, f"__fill{i}")
            fills.append(i)
            # without any other value there is no mode: the marker stays
            cur = cur.crossJoin(F.broadcast(m)).withColumn(
                st.column, F.when(hit, F.coalesce(fill, x)).otherwise(x)).drop(f"__fill{i}")
            seen = (seen.crossJoin(F.broadcast(m)).withColumn(f"__a{i}", alive & hit & fill.isNotNull())
                    .withColumn(st.column, F.when(hit, F.coalesce(fill, x)).otherwise(x)))
        elif st.action == "keep":
            audit_aggs.append(F.count_if(f"__a{i}").alias(f"a{i}"))
            seen = seen.withColumn(f"__a{i}", alive & hit)
        elif st.action == "drop_column":
            audit_aggs.append(F.lit(None).cast("bigint").alias(f"a{i}"))
            cur, seen = cur.drop(st.column), seen.drop(st.column)
        else:
            raise ValueError(f"unknown action {st.action}")
        audit_meta.append((i, st))
    counts = seen.agg(*audit_aggs) if audit_aggs else df.sparkSession.range(1).select()
    structs = [F.struct(
        F.lit(i + 1).alias("step"), F.lit(st.column).alias("column_name"),
        F.lit(st.action).alias("action"), F.col(f"a{i}").alias("affected"),
        (F.col(f"__fill{i}") if i in fills
         else F.lit(None).cast("string")).alias("fill_value"))
        for i, st in audit_meta]
    audit = counts.select(F.inline(F.array(*structs)))
    return cur, audit


def policy_shape(before: DataFrame, after: DataFrame) -> DataFrame:
    """CLN2 shape: ``(rows_before, cols_before, rows_after, cols_after, rows_removed)``."""
    b = before.agg(F.count(F.lit(1)).alias("rows_before"))
    a = after.agg(F.count(F.lit(1)).alias("rows_after"))
    return b.crossJoin(a).select(
        "rows_before", F.lit(len(before.columns)).cast("bigint").alias("cols_before"),
        "rows_after", F.lit(len(after.columns)).cast("bigint").alias("cols_after"),
        (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"))
