"""Rule audit, winsorizing and domain checks (CLN3-CLN9, SET1).

* CLN3: the sequential rule filter is one pass: ``first_fail`` is a CASE over
  the rules in order, so "rows removed by rule k among the survivors of
  rules 1..k-1" is simply ``count_if(first_fail = k)``.
* CLN4: bounds of every column come from one aggregate; clipping never
  removes rows or touches other columns, so the per-column sequence of the
  single-machine version does not matter.
* CLN6: observed values are counted per ``(column, value)`` (one shuffle)
  and compared to the expected domain with a full outer join.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions import clip, column, holds, number, numeric_columns, pct, type_class
from tabsmith.operators import quantiles as Q
from tabsmith.operators.profile import long_values
from tabsmith.operators.rank import global_rank


@dataclass(frozen=True)
class Rule:
    """A row rule on one column: ``between`` (closed), ``ge`` or ``gt``."""
    column: str
    op: str
    lo: float | None = None
    hi: float | None = None
    condition: str = ""

    @property
    def name(self) -> str:
        return f"{self.column}_business_rule"

    def raw(self) -> Column:
        x = F.col(self.column)
        if self.op == "between":
            p = x.between(F.lit(self.lo), F.lit(self.hi))
        elif self.op == "ge":
            p = x >= F.lit(self.lo)
        elif self.op == "gt":
            p = x > F.lit(self.lo)
        elif self.op == "le":
            p = x <= F.lit(self.hi)
        elif self.op == "lt":
            p = x < F.lit(self.hi)
        else:
            raise ValueError(self.op)
        return p

    def predicate(self, dtype: T.DataType | None = None) -> Column:
        """FLT2/FLT3: true only for present, non-NaN values that satisfy the rule."""
        p = holds(self.raw())
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            p = p & ~F.isnan(F.col(self.column))
        return p


def between(col, lo, hi, condition=None) -> Rule:
    return Rule(col, "between", lo, hi, condition or f"{col} between {lo} and {hi}")


def ge(col, v, condition=None) -> Rule:
    return Rule(col, "ge", v, None, condition or f"{col} >= {v}")


def gt(col, v, condition=None) -> Rule:
    return Rule(col, "gt", v, None, condition or f"{col} > {v}")


# The business rules of the original workflow, in order.
REFERENCE_RULES = [
    between("age", 15, 100, "age between 15 and 100"),
    between("balance", -100000, 1000000, "balance between -100,000 and 1,000,000"),
    ge("duration", 0, "duration >= 0"),
    gt("campaign", 0, "campaign > 0"),
    ge("pdays", -1, "pdays >= -1"),
    ge("previous", 0, "previous >= 0"),
    between("day", 1, 31, "day between 1 and 31"),
]

# Winsorized columns and the categorical columns checked against a domain.
WINSOR_COLUMNS = ["balance", "duration", "campaign", "pdays", "previous"]
DOMAIN_COLUMNS = ["job", "marital", "education", "default", "housing", "loan", "contact", "month"]


def active_rules(df: DataFrame, rules: Sequence[Rule]) -> list[Rule]:
    """Rules whose column exists (the others are skipped)."""
    return [r for r in rules if r.column in df.columns]


def first_fail(df: DataFrame, rules: Sequence[Rule]) -> Column:
    """1-based index of the first failing rule, NULL when all pass."""
    dt = {f.name: f.dataType for f in df.schema.fields}
    expr = None
    for k, r in enumerate(rules, start=1):
        fail = ~r.predicate(dt[r.column])
        expr = F.when(fail, F.lit(k)) if expr is None else expr.when(fail, F.lit(k))
    return expr if expr is not None else F.lit(None).cast("int")


def rule_audit(df: DataFrame, rules: Sequence[Rule] = REFERENCE_RULES) -> DataFrame:
    """CLN3 audit: ``(rule_order, rule, column_name, condition, records_removed)``.

    One scan, one aggregate: rule k removes ``count_if(first_fail = k)`` rows."""
    rs = active_rules(df, rules)
    ff = first_fail(df, rs)
    wide = df.select(ff.alias("__ff")).agg(
        *[F.count_if(F.col("__ff") == k).alias(f"r{k}") for k in range(1, len(rs) + 1)])
    return wide.select(F.inline(F.array(*[F.struct(
        F.lit(k).alias("rule_order"), F.lit(r.name).alias("rule"),
        F.lit(r.column).alias("column_name"), F.lit(r.condition).alias("condition"),
        F.col(f"r{k}").alias("records_removed")) for k, r in enumerate(rs, start=1)])))


def apply_rules(df: DataFrame, rules: Sequence[Rule] = REFERENCE_RULES) -> DataFrame:
    """CLN3 filter: the rows that pass every active rule.

    The plain predicates are used (same rows kept as the NULL-safe form,
    since a NULL predicate drops the row) so they push down to the scan; a
    NaN guard is added for floating columns."""
    dt = {f.name: f.dataType for f in df.schema.fields}
    out = df
    for r in active_rules(df, rules):
        p = r.raw()
        if isinstance(dt[r.column], (T.DoubleType, T.FloatType)):
            p = p & ~F.isnan(F.col(r.column))
        out = out.where(p)
    return out


# ---------------------------------------------------------------- CLN4
def winsor_bounds(df: DataFrame, cols: Sequence[str] = WINSOR_COLUMNS, lower: float = 0.01,
                  upper: float = 0.99, only_affected: bool = True) -> DataFrame:
    """CLN4 report: ``(column_name, lower_bound, upper_bound, records_affected)``.

    Exact interpolated quantiles of all columns, then one more aggregate counting
    the values strictly outside."""
    cols = [c for c in cols if c in df.columns]
    q = Q.quantiles(df, cols, [lower, upper])
    n = df.agg(*[F.count_if((number(c) < F.lit(q[c][lower])) | (number(c) > F.lit(q[c][upper]))).alias(f"n{i}")
                 for i, c in enumerate(cols)]).first()
    rows = [(c, q[c][lower], q[c][upper], n[i]) for i, c in enumerate(cols) if n[i] > 0 or not only_affected]
    return df.sparkSession.createDataFrame(
        rows, "column_name string, lower_bound double, upper_bound double, records_affected bigint")


class WinsorModel:
    """Fitted bounds; ``transform`` clips only the columns that had values outside."""

    def __init__(self, bounds: dict[str, tuple[float, float, int]]):
        self.bounds = bounds

    @classmethod
    def fit(cls, df: DataFrame, cols: Sequence[str] = WINSOR_COLUMNS, lower: float = 0.01,
            upper: float = 0.99) -> "WinsorModel":
        rows = winsor_bounds(df, cols, lower, upper, only_affected=False).collect()
        return cls({r["column_name"]: (r["lower_bound"], r["upper_bound"], r["records_affected"])
                    for r in rows})

    def transform(self, df: DataFrame) -> DataFrame:
        exprs = {c: clip(F.col(c).cast("double"), lo, hi)
                 for c, (lo, hi, n) in self.bounds.items() if n > 0 and c in df.columns}
        return df.withColumns(exprs) if exprs else df

    def report(self, spark) -> DataFrame:
        rows = [(c, lo, hi, n) for c, (lo, hi, n) in self.bounds.items() if n > 0]
        return spark.createDataFrame(
            rows, "column_name string, lower_bound double, upper_bound double, records_affected bigint")


def winsorize(df: DataFrame, cols: Sequence[str] = WINSOR_COLUMNS, lower: float = 0.01,
              upper: float = 0.99) -> DataFrame:
    """CLN4 transform without a driver round trip: bounds arrive as a one-row
    broadcast and every listed column is clipped (and typed double)."""
    cols = [c for c in cols if c in df.columns]
    qr = Q.quantile_row(df, cols, [lower, upper])
    b = qr.select(*[F.col(c)[0].alias(f"{c}__lo") for c in cols] +
                  [F.col(c)[1].alias(f"{c}__hi") for c in cols])
    j = df.crossJoin(F.broadcast(b))
    j = j.withColumns({c: clip(F.col(c).cast("double"), F.col(f"{c}__lo"), F.col(f"{c}__hi"))
                       for c in cols})
    return j.drop(*[f"{c}__{s}" for c in cols for s in ("lo", "hi")])


# ---------------------------------------------------------------- CLN5
def target_check(df: DataFrame, target: str = "deposit") -> DataFrame:
    """CLN5: ``(value, count, position)``: sorted distinct target values with counts."""
    vc = df.where(column(target).isNotNull()).groupBy(column(target).alias("value")).agg(
        F.count(F.lit(1)).alias("count"))
    return global_rank(vc, ["value"], out="position")


# ---------------------------------------------------------------- CLN6 / SET1
def observed_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct ``(column_name, value)`` with missing rendered as ``nan``."""
    return long_values(df, cols).select(
        "column_name", F.coalesce("value", F.lit("nan")).alias("value")).distinct()


def unexpected_values(df: DataFrame, domain: DataFrame, cols: Sequence[str]) -> DataFrame:
    """SET1: observed values minus the expected domain, per column (left-anti join)."""
    obs = observed_pairs(df, cols)
    return obs.join(domain.select("column_name", "value").distinct(),
                    ["column_name", "value"], "left_anti")


def domain_check(df: DataFrame, domain: DataFrame, cols: Sequence[str] | None = None,
                 max_values: int = 1000) -> DataFrame:
    """CLN6: per column ``(column_name, expected, actual, unexpected, n_expected,
    n_actual, n_unexpected, has_unexpected)``.

    Lists are sorted and built only while a column has at most ``max_values``
    values of that kind (counts are always exact); ``unexpected_values`` gives
    the whole set in long form."""
    cols = [c for c in (cols or DOMAIN_COLUMNS) if c in df.columns]
    obs = observed_pairs(df, cols).withColumn("__a", F.lit(True))
    exp = (domain.where(F.col("column_name").isin(cols)).select("column_name", "value")
           .distinct().withColumn("__e", F.lit(True)))
    j = obs.join(exp, ["column_name", "value"], "full")
    a = F.coalesce(F.col("__a"), F.lit(False))
    e = F.coalesce(F.col("__e"), F.lit(False))
    counts = j.groupBy("column_name").agg(
        F.count_if(e).alias("n_expected"), F.count_if(a).alias("n_actual"),
        F.count_if(a & ~e).alias("n_unexpected"))

    def lst(flag, n):
        # the cap is applied inside the aggregate (collect_list skips NULLs), so
        # a column above max_values contributes no list entries at all
        return F.array_sort(F.collect_list(F.when(flag & (F.col(n) <= max_values), F.col("value"))))

    def capped(c, n):
        return F.when(F.col(n) <= max_values, F.col(c))

    lists = (j.join(counts, "column_name")
             .groupBy("column_name", "n_expected", "n_actual", "n_unexpected").agg(
                 lst(e, "n_expected").alias("expected"), lst(a, "n_actual").alias("actual"),
                 lst(a & ~e, "n_unexpected").alias("unexpected"))
             .withColumns({"expected": capped("expected", "n_expected"),
                           "actual": capped("actual", "n_actual"),
                           "unexpected": capped("unexpected", "n_unexpected")}))
    return lists.select("column_name", "expected", "actual", "unexpected", "n_expected",
                        "n_actual", "n_unexpected",
                        (F.col("n_unexpected") > 0).alias("has_unexpected"))


# ---------------------------------------------------------------- CLN7 / CLN8 / CLN9
def cleaning_summary(df: DataFrame, rules: Sequence[Rule] = REFERENCE_RULES,
                     cleaned_columns: int | None = None) -> DataFrame:
    """CLN7: ``(original_rows, original_columns, cleaned_rows, cleaned_columns,
    rows_removed, retention_rate, removal_rate)`` in one aggregate."""
    rs = active_rules(df, rules)
    ff = first_fail(df, rs)
    g = df.select(ff.alias("__ff")).agg(F.count(F.lit(1)).alias("original_rows"),
                                        F.count_if(F.col("__ff").isNull()).alias("cleaned_rows"))
    ncols = len(df.columns) if cleaned_columns is None else cleaned_columns
    return g.select(
        "original_rows", F.lit(len(df.columns)).cast("bigint").alias("original_columns"),
        "cleaned_rows", F.lit(ncols).cast("bigint").alias("cleaned_columns"),
        (F.col("original_rows") - F.col("cleaned_rows")).alias("rows_removed"),
        pct("cleaned_rows", "original_rows").alias("retention_rate"),
        (F.lit(100.0) - pct("cleaned_rows", "original_rows")).alias("removal_rate"))


def short_summary(rule_report: DataFrame, winsor_report: DataFrame) -> DataFrame:
    """CLN8: one row per processing step ``(step, type, column_name, condition,
    records, lower_bound, upper_bound)``."""
    r = rule_report.select(F.col("rule").alias("step"), F.lit("business_rule").alias("type"),
                           "column_name", "condition", F.col("records_removed").alias("records"),
                           F.lit(None).cast("double").alias("lower_bound"),
                           F.lit(None).cast("double").alias("upper_bound"))
    w = winsor_report.select(F.concat(F.col("column_name"), F.lit("_winsorization")).alias("step"),
                             F.lit("winsorization").alias("type"), "column_name",
                             F.lit(None).cast("string").alias("condition"),
                             F.col("records_affected").alias("records"),
                             "lower_bound", "upper_bound")
    return r.unionByName(w)


def schema_preview(df: DataFrame) -> DataFrame:
    """CLN9: ``(column_name, type_class, n_unique)`` (non-missing distinct count)."""
    from tabsmith.operators.profile import distinct_counts
    meta = df.sparkSession.createDataFrame(
        [(f.name, type_class(f.dataType), i) for i, f in enumerate(df.schema.fields)],
        "column_name string, type_class string, position int")
    return meta.join(distinct_counts(df), "column_name").select(
        "column_name", "type_class", "n_unique")


def post_clean_describe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Describe of the numerical columns after rules and winsorizing."""
    from tabsmith.operators.profile import describe
    return describe(df, cols or numeric_columns(df))
