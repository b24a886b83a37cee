"""Registered queries: one Spark plan and (where SQL can say it) one DuckDB oracle.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame over the given
tables (or data Spark derives from them).  Doubles are rounded to 6 decimals
only at the end, for presentation; the operators themselves never round.
Oracle SQL uses the same column names and the same rounding.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.functions import round_doubles
from tabsmith.operators import profile as P
from tabsmith.plans.contacts import (CATEGORICAL, CONTACTS_SQL, contacts, table)
from tabsmith.session import checkpoint_dir

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark, sf_dir, _fn=fn):
            return round_doubles(_fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[name] = (run, sql)
        return fn
    return deco


def CI(cond: str) -> str:
    """count of rows where ``cond`` holds (0, never NULL, on no match)."""
    return f"count(*) FILTER (WHERE {cond})"


def R(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


def W(sql: str) -> str:
    """Prefix with the contacts CTE."""
    return f"WITH contacts AS ({CONTACTS_SQL})\n{sql}"


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax"]
CONTACT_NUM = ["age", "balance", "balance_n", "day", "duration", "campaign", "pdays",
               "previous", "deposit"]
WINSOR_COLS = ["balance", "duration", "campaign", "pdays", "previous"]
ALL_CONTACT_COLS = ["id", "age", "job", "marital", "education", "in_default", "balance",
                    "balance_n", "housing", "loan", "contact", "day", "month", "duration",
                    "campaign", "pdays", "previous", "poutcome", "deposit"]


def _describe_sql(src: str, cols: list[str], with_missing=False) -> str:
    parts = []
    for c in cols:
        x = f"CAST({c} AS DOUBLE)"
        s = (f"SELECT '{c}' AS column_name, count({c}) AS count, {R(f'avg({x})')} AS mean, "
             f"{R(f'stddev_samp({x})')} AS std, {R(f'min({x})')} AS min, "
             f"{R(f'quantile_cont({x}, 0.25)')} AS p25, {R(f'quantile_cont({x}, 0.5)')} AS p50, "
             f"{R(f'quantile_cont({x}, 0.75)')} AS p75, {R(f'max({x})')} AS max")
        if with_missing:
            s += (f", count(*) - count({c}) AS missing, "
                  f"{R(f'(count(*) - count({c})) * 100.0 / count(*)')} AS missing_pct")
        parts.append(s + f" FROM {src}")
    return union(parts)


# ---------------------------------------------------------------- profile
@register("agg1_shape_contacts", W(
    "SELECT count(*) AS n_rows, CAST(19 AS BIGINT) AS n_columns FROM contacts"))
def q_agg1(spark, sf):
    """AGG1 row and column count."""
    return P.shape(contacts(spark, sf))


@register("agg2_describe_lineitem", _describe_sql("lineitem", LINEITEM_NUM))
def q_agg2(spark, sf):
    """AGG2 8-number describe of every numeric lineitem column."""
    return P.describe(table(spark, sf, "lineitem"), LINEITEM_NUM)


@register("agg3_numeric_table_contacts", W(_describe_sql("contacts", CONTACT_NUM, True)))
def q_agg3(spark, sf):
    """AGG3 numeric feature table with missing counts."""
    return P.numeric_table(contacts(spark, sf), CONTACT_NUM)


def _vc_union(src: str, cols: list[str], value_expr="CAST({c} AS VARCHAR)", where_nn=False):
    parts = []
    for c in cols:
        v = value_expr.format(c=c)
        w = f" WHERE {c} IS NOT NULL" if where_nn else ""
        parts.append(f"SELECT '{c}' AS column_name, {v} AS value, count(*) AS n FROM {src}{w} GROUP BY {v}")
    return union(parts)


@register("agg4_categorical_table_contacts", W(f"""
, vc AS ({_vc_union('contacts', CATEGORICAL)}),
 best AS (SELECT column_name, value, n FROM (
   SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rn
   FROM vc WHERE value IS NOT NULL) WHERE rn = 1),
 agg AS (SELECT column_name, count(*) AS unique_values,
   coalesce(sum(CASE WHEN value IS NULL THEN n END), 0) AS missing, sum(n) AS total
   FROM vc GROUP BY column_name)
SELECT a.column_name AS feature, CAST(a.unique_values AS BIGINT) AS unique_values,
  CAST(a.missing AS BIGINT) AS missing, {R('a.missing * 100.0 / a.total')} AS missing_pct,
  coalesce(b.value, 'N/A') AS most_common, CAST(coalesce(b.n, 0) AS BIGINT) AS most_common_count,
  {R('coalesce(b.n * 100.0 / a.total, 0)')} AS most_common_pct
FROM agg a LEFT JOIN best b ON a.column_name = b.column_name""".replace("WITH contacts", "WITH contacts", 1)))
def q_agg4(spark, sf):
    """AGG4 categorical feature table (unique incl. missing, mode, mode share)."""
    return P.categorical_table(contacts(spark, sf), CATEGORICAL)


@register("agg5_value_counts_job", W(
    "SELECT job AS value, count(*) AS count FROM contacts WHERE job IS NOT NULL GROUP BY job"))
def q_agg5(spark, sf):
    """AGG5 value counts, most frequent first."""
    return P.value_counts(contacts(spark, sf), "job")


@register("agg6_value_share_education", W(f"""
SELECT education AS value, count(*) AS count,
  {R('count(*) * 100.0 / sum(count(*)) OVER ()')} AS pct
FROM contacts WHERE education IS NOT NULL GROUP BY education"""))
def q_agg6(spark, sf):
    """AGG6 normalised value counts (percent of non-missing rows)."""
    return P.value_share(contacts(spark, sf), "education")


@register("agg7_null_counts_contacts", W(union([
    f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing, "
    f"{R(f'(count(*) - count({c})) * 100.0 / count(*)')} AS missing_pct FROM contacts"
    for c in ALL_CONTACT_COLS])))
def q_agg7(spark, sf):
    """AGG7 NULL count and share for every column."""
    return P.null_counts(contacts(spark, sf), ALL_CONTACT_COLS)


@register("agg10_distinct_values_contacts", W(f"""
, pairs AS (SELECT DISTINCT column_name, coalesce(value, 'nan') AS value FROM ({_vc_union('contacts', CATEGORICAL)}))
SELECT column_name, string_agg(value, '|' ORDER BY value) AS values_joined,
  count(*) AS count, count(*) > 1000 AS truncated
FROM pairs GROUP BY column_name"""))
def q_agg10(spark, sf):
    """AGG10 sorted distinct values and their number per categorical column."""
    dv = P.distinct_values(contacts(spark, sf), CATEGORICAL)
    return dv.select("column_name", F.array_join("values", "|").alias("values_joined"),
                     "count", "truncated")


@register("agg11_mode_contacts", W(f"""
SELECT column_name, value AS mode, n AS mode_count FROM (
  SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rn
  FROM ({_vc_union('contacts', CATEGORICAL, where_nn=True)})) WHERE rn = 1"""))
def q_agg11(spark, sf):
    """AGG11 mode per categorical column, smallest value on ties."""
    return P.mode_long(contacts(spark, sf), CATEGORICAL)


@register("agg12_distinct_counts_contacts", W(union([
    f"SELECT '{c}' AS column_name, CAST(count(DISTINCT {c}) AS BIGINT) AS n_unique FROM contacts"
    for c in ALL_CONTACT_COLS])))
def q_agg12(spark, sf):
    """AGG12 non-missing distinct count of every column."""
    return P.distinct_counts(contacts(spark, sf), ALL_CONTACT_COLS)


@register("agg13_imbalance_ratio", W(f"""
SELECT count(*) AS n_classes, max(n) AS majority, min(n) AS minority,
  CASE WHEN count(*) = 2 THEN {R('max(n) * 1.0 / min(n)')} END AS ratio
FROM (SELECT deposit, count(*) AS n FROM contacts WHERE deposit IS NOT NULL GROUP BY deposit)"""))
def q_agg13(spark, sf):
    """AGG13 class imbalance ratio of the target."""
    return P.imbalance_ratio(contacts(spark, sf), "deposit")


@register("agg15_quantiles_contacts", W(union([
    f"SELECT '{c}' AS column_name, CAST({p} AS DOUBLE) AS prob, "
    f"{R(f'quantile_cont({c}, {p})')} AS value FROM contacts"
    for c in WINSOR_COLS for p in (0.01, 0.99)])))
def q_agg15(spark, sf):
    """AGG15 exact 1 % / 99 % quantiles, linear interpolation."""
    return P.quantile_table(contacts(spark, sf), WINSOR_COLS, [0.01, 0.99])


TUKEY_COLS = ["balance", "duration", "campaign", "pdays", "previous"]


def _fence_cte(src, cols):
    sel = ", ".join(
        f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.5) AS {c}_q2, "
        f"quantile_cont({c}, 0.75) AS {c}_q3" for c in cols)
    return f"fences AS (SELECT {sel} FROM {src})"


def _lo(c):
    return f"({c}_q1 - 1.5 * ({c}_q3 - {c}_q1))"


def _hi(c):
    return f"({c}_q3 + 1.5 * ({c}_q3 - {c}_q1))"


@register("agg16_tukey_contacts", W(", " + _fence_cte("contacts", TUKEY_COLS) + "\n" + union([
    f"SELECT '{c}' AS column_name, {R(f'{c}_q1')} AS q1, {R(f'{c}_q3')} AS q3, "
    f"{R(_lo(c))} AS lower_fence, {R(_hi(c))} AS upper_fence, "
    f"(SELECT count(*) FROM contacts WHERE {c} < {_lo(c)} OR {c} > {_hi(c)}) AS n_outliers "
    f"FROM fences" for c in TUKEY_COLS])))
def q_agg16(spark, sf):
    """AGG16 Tukey 1.5·IQR outlier counts."""
    return P.tukey_counts(contacts(spark, sf), TUKEY_COLS)


@register("agg16_tukey_documents", f"WITH {_fence_cte('documents', ['n_chars'])}\n" + (
    f"SELECT 'n_chars' AS column_name, {R('n_chars_q1')} AS q1, {R('n_chars_q3')} AS q3, "
    f"{R(_lo('n_chars'))} AS lower_fence, {R(_hi('n_chars'))} AS upper_fence, "
    f"(SELECT count(*) FROM documents WHERE n_chars < {_lo('n_chars')} OR n_chars > {_hi('n_chars')}) "
    f"AS n_outliers FROM fences"))
def q_agg16d(spark, sf):
    """AGG16 on a skewed length column."""
    return P.tukey_counts(table(spark, sf, "documents"), ["n_chars"])


@register("agg17_box_contacts", W(", " + _fence_cte("contacts", TUKEY_COLS) + "\n" + union([
    f"SELECT '{c}' AS column_name, {R(f'{c}_q2')} AS median, {R(f'{c}_q1')} AS q1, "
    f"{R(f'{c}_q3')} AS q3, "
    f"(SELECT {R(f'min({c})')} FROM contacts WHERE {c} >= {_lo(c)} AND {c} <= {_hi(c)}) AS whisker_low, "
    f"(SELECT {R(f'max({c})')} FROM contacts WHERE {c} >= {_lo(c)} AND {c} <= {_hi(c)}) AS whisker_high, "
    f"(SELECT count(*) FROM contacts WHERE {c} < {_lo(c)} OR {c} > {_hi(c)}) AS n_outliers, "
    f"(SELECT {R(f'avg({c})')} FROM contacts) AS mean, "
    f"(SELECT {R(f'stddev_samp({c})')} FROM contacts) AS std "
    f"FROM fences" for c in TUKEY_COLS])))
def q_agg17(spark, sf):
    """AGG17 box-plot data (quartiles, whiskers, fliers, mean, std)."""
    return P.box_data(contacts(spark, sf), TUKEY_COLS)


@register("agg21_positive_rate", W(
    f"SELECT {R('avg(CASE WHEN deposit = 2 THEN 1.0 ELSE 0.0 END)')} AS positive_rate, "
    "count(*) AS n FROM contacts"))
def q_agg21(spark, sf):
    """AGG21 positive-class rate."""
    return P.positive_rate(contacts(spark, sf), "deposit", positive=2)


@register("agg22_category_share_job_by_deposit", W(f"""
SELECT deposit AS label, job AS value, count(*) AS count,
  {R('count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY deposit)')} AS pct
FROM contacts WHERE job IS NOT NULL GROUP BY deposit, job"""))
def q_agg22(spark, sf):
    """AGG22 category share within each class (bar-chart data)."""
    return P.category_share_by_class(contacts(spark, sf), "job", "deposit")


# ---------------------------------------------------------------- sort / top-k
@register("srt1_sort_brand_price_desc", f"""
SELECT p_brand, avg_price, row_number() OVER (ORDER BY avg_price DESC, p_brand) AS rank
FROM (SELECT p_brand, {R('avg(p_retailprice)')} AS avg_price FROM part GROUP BY p_brand)""")
def q_srt1(spark, sf):
    """SRT1 sort by a value descending (ties by key), with rank."""
    g = table(spark, sf, "part").groupBy("p_brand").agg(
        F.round(F.avg("p_retailprice"), 6).alias("avg_price"))
    return P.sort_desc(g, "avg_price", "p_brand")


@register("srt2_sorted_target_values", W(
    "SELECT deposit AS value, row_number() OVER (ORDER BY deposit) AS position "
    "FROM (SELECT DISTINCT deposit FROM contacts WHERE deposit IS NOT NULL)"))
def q_srt2(spark, sf):
    """SRT2 sorted distinct target values."""
    return P.sorted_distinct(contacts(spark, sf), "deposit")


@register("top1_top10_brands", """
SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10""")
def q_top1(spark, sf):
    """TOP1 top-k categories by count."""
    g = table(spark, sf, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return P.top_k(g, "n", 10, "p_brand")


@register("top1_top3_users_per_event_type", f"""
SELECT event_type, user_id, total, rank FROM (
  SELECT event_type, user_id, total,
    row_number() OVER (PARTITION BY event_type ORDER BY total DESC, user_id) AS rank
  FROM (SELECT event_type, user_id, {R('sum(value)')} AS total FROM events GROUP BY event_type, user_id))
WHERE rank <= 3""")
def q_top1g(spark, sf):
    """TOP1 per group via row_number() <= k."""
    g = table(spark, sf, "events").groupBy("event_type", "user_id").agg(
        F.round(F.sum("value"), 6).alias("total"))
    return P.top_k_per_group(g, "event_type", "total", 3, "user_id")


@register("top2_argmax_event_type", f"""
SELECT event_type, avg_value FROM (
  SELECT event_type, {R('avg(value)')} AS avg_value FROM events GROUP BY event_type)
ORDER BY avg_value DESC, event_type LIMIT 1""")
def q_top2(spark, sf):
    """TOP2 arg-max by a metric."""
    g = table(spark, sf, "events").groupBy("event_type").agg(
        F.round(F.avg("value"), 6).alias("avg_value"))
    return P.arg_max(g, "event_type", "avg_value")


# ---------------------------------------------------------------- transforms
from tabsmith.operators import clean as C  # noqa: E402
from tabsmith.operators import missing as M  # noqa: E402
from tabsmith.operators import transform as TR  # noqa: E402
from tabsmith.plans.contacts import RAW_SQL, STANDARD_NAMES, raw_contacts  # noqa: E402

_STD_COLS = ["id"] + [("in_default AS default" if n == "default" else n) for n in STANDARD_NAMES] \
    + ["deposit"]


@register("prj1_rename_fixed_map", W(f", raw AS ({RAW_SQL})\nSELECT id, V1 AS age, V2 AS job, "
                                     "V3, V4, V5, V6, V7, V8, V9, V10, V11, V12, V13, V14, V15, V16, "
                                     "Class FROM raw"))
def q_prj1(spark, sf):
    """PRJ1 rename by a fixed map; absent names ignored."""
    return TR.rename(raw_contacts(spark, sf), {"V1": "age", "V2": "job", "V99": "nope"})


@register("prj2_positional_rename", W(f", raw AS ({RAW_SQL})\nSELECT " + ", ".join(
    ["id"] + [f"V{i + 1} AS \"{n}\"" for i, n in enumerate(STANDARD_NAMES)] + ["Class AS deposit"])
    + " FROM raw"))
def q_prj2(spark, sf):
    """PRJ2 positional rename V<n> → standard name, Class → deposit."""
    return TR.positional_rename(raw_contacts(spark, sf), STANDARD_NAMES)


@register("prj3_drop_column", W("SELECT " + ", ".join(
    c for c in ALL_CONTACT_COLS if c != "poutcome") + " FROM contacts"))
def q_prj3(spark, sf):
    """PRJ3 drop a column if present (second name absent → no-op)."""
    return TR.drop_if_present(contacts(spark, sf), "poutcome", "not_there")


@register("prj7_recode_label", W(
    "SELECT id, CASE WHEN deposit = 1 THEN 0 WHEN deposit = 2 THEN 1 ELSE deposit END AS deposit "
    "FROM contacts"))
def q_prj7(spark, sf):
    """PRJ7 simultaneous label recode {1→0, 2→1}."""
    return TR.recode_label(contacts(spark, sf).select("id", "deposit"), "deposit")


@register("prj8_string_nan", W(
    "SELECT id, coalesce(CAST(balance_n AS VARCHAR), 'nan') AS balance_n, "
    "coalesce(CAST(day AS VARCHAR), 'nan') AS day FROM contacts"))
def q_prj8(spark, sf):
    """PRJ8 cast to string with missing → 'nan'."""
    return TR.as_string_nan(contacts(spark, sf).select("id", "balance_n", "day"),
                            ["balance_n", "day"])


@register("flt1_drop_unknown_job", W(
    "SELECT id, job FROM contacts WHERE job IS DISTINCT FROM 'unknown'"))
def q_flt1(spark, sf):
    """FLT1 drop sentinel rows, keep missing ones."""
    return TR.drop_marker_rows(contacts(spark, sf).select("id", "job"), "job")


@register("flt2_flt3_rule_predicates_balance_n", W(
    "SELECT id, coalesce(balance_n BETWEEN -500 AND 5000, false) AS in_range, "
    "coalesce(balance_n >= 0, false) AS non_negative FROM contacts"))
def q_flt23(spark, sf):
    """FLT2/FLT3 NULL-safe closed-interval and one-sided rules (missing fails)."""
    df = contacts(spark, sf)
    dt = dict((f.name, f.dataType) for f in df.schema.fields)
    return df.select("id", C.between("balance_n", -500, 5000).predicate(dt["balance_n"]).alias("in_range"),
                     C.ge("balance_n", 0).predicate(dt["balance_n"]).alias("non_negative"))


@register("lim1_preview_contacts", W("SELECT * FROM contacts ORDER BY id LIMIT 5"))
def q_lim1(spark, sf):
    """LIM1 first-n preview in key order."""
    return TR.preview(contacts(spark, sf), 5, "id")


# ---------------------------------------------------------------- missing values
def _mt_sql():
    parts = []
    for c in ALL_CONTACT_COLS:
        parts.append(f"SELECT '{c}' AS column_name, 'NaN' AS missing_type, count(*) - count({c}) AS count, "
                     f"{R(f'(count(*) - count({c})) * 100.0 / count(*)')} AS percentage FROM contacts")
        if c in CATEGORICAL:
            for m in M.MISSING_MARKERS:
                parts.append(
                    f"SELECT '{c}' AS column_name, '{m}' AS missing_type, count(*) FILTER (WHERE {c} = '{m}') AS count, "
                    f"{R(f'count(*) FILTER (WHERE {c} = {chr(39)}{m}{chr(39)}) * 100.0 / count(*)')} AS percentage "
                    f"FROM contacts HAVING count(*) FILTER (WHERE {c} = '{m}') > 0")
    return W(union(parts))


@register("agg8_missing_types_contacts", _mt_sql())
def q_agg8(spark, sf):
    """AGG8 NULL count and per-marker counts (markers only when present)."""
    return M.missing_types(contacts(spark, sf))


_SPARK_TYPES = {"id": "bigint", "age": "int", "balance": "double", "balance_n": "double",
                "day": "int", "duration": "double", "campaign": "int", "pdays": "int",
                "previous": "int", "deposit": "int"}


def _mr_sql():
    parts = []
    for c in ALL_CONTACT_COLS:
        if c in CATEGORICAL:
            tot = f"(count(*) - count({c})) + " + " + ".join(
                f"count(*) FILTER (WHERE {c} = '{m}')" for m in M.MISSING_MARKERS)
        else:
            tot = f"(count(*) - count({c}))"
        dtype = _SPARK_TYPES.get(c, "string")
        parts.append(f"SELECT '{c}' AS column_name, '{dtype}' AS dtype, "
                     f"{'true' if c in CATEGORICAL else 'false'} AS is_categorical, "
                     f"({tot}) AS total_missing, ({tot}) * 100.0 / count(*) AS missing_percentage "
                     f"FROM contacts")
    return W(f", t AS ({union(parts)})\nSELECT column_name, dtype, is_categorical, "
             f"CAST(total_missing AS BIGINT) AS total_missing, {R('missing_percentage')} AS missing_percentage, "
             "CASE WHEN total_missing = 0 THEN 'none' WHEN round(missing_percentage, 2) < 1 THEN 'drop_rows' "
             "WHEN round(missing_percentage, 2) < 10 THEN 'impute_mode_or_mean' "
             "ELSE 'model_impute_or_drop_column' END AS recommendation FROM t")


@register("agg9_missing_report_contacts", _mr_sql())
def q_agg9(spark, sf):
    """AGG8 totals + AGG9 recommendation tier per column."""
    return M.missing_report(contacts(spark, sf))


_MODE_EDU = ("(SELECT education FROM contacts WHERE job IS DISTINCT FROM 'unknown' AND "
             "education IS NOT NULL AND education <> 'unknown' GROUP BY education "
             "ORDER BY count(*) DESC, education LIMIT 1)")
_CLEAN_COLS = [c for c in ALL_CONTACT_COLS if c != "poutcome"]
CLEANED_SQL = ("SELECT " + ", ".join(
    f"CASE WHEN education = 'unknown' THEN {_MODE_EDU} ELSE education END AS education"
    if c == "education" else c for c in _CLEAN_COLS)
    + " FROM contacts WHERE job IS DISTINCT FROM 'unknown'")


def WC(sql: str) -> str:
    """contacts + cleaned (after the missing-value policy) CTEs."""
    return W(f", cleaned AS ({CLEANED_SQL})\n{sql}")


def cleaned_contacts(spark, sf):
    return M.apply_policy(contacts(spark, sf))[0]


@register("cln1_missing_policy_contacts", WC("SELECT * FROM cleaned"))
def q_cln1(spark, sf):
    """CLN1 missing-value policy: drop job=unknown rows, fill education mode,
    keep contact, drop poutcome."""
    return cleaned_contacts(spark, sf)


@register("cln2_policy_audit_contacts", W(f"""
SELECT * FROM (VALUES (1, 'job', 'drop_rows'), (2, 'education', 'fill_mode'), (3, 'contact', 'keep'),
  (4, 'poutcome', 'drop_column')) AS s(step, column_name, action)
JOIN (SELECT 1 AS step, count(*) FILTER (WHERE job = 'unknown') AS affected, CAST(NULL AS VARCHAR) AS fill_value FROM contacts
  UNION ALL SELECT 2, count(*) FILTER (WHERE job IS DISTINCT FROM 'unknown' AND education = 'unknown'), {_MODE_EDU} FROM contacts
  UNION ALL SELECT 3, count(*) FILTER (WHERE job IS DISTINCT FROM 'unknown' AND contact = 'unknown'), NULL FROM contacts
  UNION ALL SELECT 4, NULL, NULL) AS a USING (step)"""))
def q_cln2(spark, sf):
    """CLN2 policy audit: rows removed, values replaced (with fill), kept."""
    return M.apply_policy(contacts(spark, sf))[1]


@register("cln2_policy_shape_contacts", WC(
    "SELECT (SELECT count(*) FROM contacts) AS rows_before, CAST(19 AS BIGINT) AS cols_before, "
    "(SELECT count(*) FROM cleaned) AS rows_after, CAST(18 AS BIGINT) AS cols_after, "
    "(SELECT count(*) FROM contacts) - (SELECT count(*) FROM cleaned) AS rows_removed"))
def q_cln2s(spark, sf):
    """CLN2 shape before/after."""
    c = contacts(spark, sf)
    return M.policy_shape(c, M.apply_policy(c)[0])


def _rule_sql(r: C.Rule, col=None) -> str:
    c = col or r.column
    if r.op == "between":
        return f"coalesce({c} BETWEEN {r.lo} AND {r.hi}, false)"
    op = {"ge": ">=", "gt": ">"}[r.op]
    return f"coalesce({c} {op} {r.lo}, false)"


def _audit_sql(src: str, rules) -> str:
    ff = "CASE " + " ".join(f"WHEN NOT {_rule_sql(r)} THEN {k}" for k, r in enumerate(rules, 1)) + " END"
    parts = [f"SELECT {k} AS rule_order, '{r.name}' AS rule, '{r.column}' AS column_name, "
             f"'{r.condition}' AS condition, count(*) FILTER (WHERE ff = {k}) AS records_removed FROM f"
             for k, r in enumerate(rules, 1)]
    return f"f AS (SELECT {ff} AS ff FROM {src})\n" + union(parts)


@register("cln3_rule_audit_contacts", WC(", " + _audit_sql("cleaned", C.REFERENCE_RULES)))
def q_cln3(spark, sf):
    """CLN3 sequential business-rule audit (seven rules, one pass)."""
    return C.rule_audit(cleaned_contacts(spark, sf))


LINEITEM_RULES = [C.between("l_quantity", 3, 48), C.ge("l_discount", 0.01),
                  C.gt("l_tax", 0.0), C.between("l_linenumber", 1, 6)]


@register("cln3_rule_audit_lineitem", "WITH " + _audit_sql("lineitem", LINEITEM_RULES))
def q_cln3l(spark, sf):
    """CLN3 on rules that remove rows: each rule counts only survivors of earlier rules."""
    return C.rule_audit(table(spark, sf, "lineitem"), LINEITEM_RULES)


@register("cln3_rule_filter_lineitem", "SELECT l_orderkey, l_linenumber, l_quantity, l_discount, "
          "l_tax FROM lineitem WHERE " + " AND ".join(_rule_sql(r) for r in LINEITEM_RULES))
def q_cln3f(spark, sf):
    """CLN3 filter: rows passing every rule (predicates pushed to the scan)."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                             "l_discount", "l_tax")
    return C.apply_rules(li, LINEITEM_RULES)


def ruled_contacts(spark, sf):
    return C.apply_rules(cleaned_contacts(spark, sf))


RULED_SQL = "SELECT * FROM cleaned WHERE " + " AND ".join(_rule_sql(r) for r in C.REFERENCE_RULES)


def WR(sql: str) -> str:
    return WC(f", ruled AS ({RULED_SQL})\n{sql}")


def _winsor_sql(src="ruled", cols=WINSOR_COLS):
    q = ", ".join(f"quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.99) AS {c}_hi" for c in cols)
    parts = [f"SELECT '{c}' AS column_name, {R(f'{c}_lo')} AS lower_bound, {R(f'{c}_hi')} AS upper_bound, "
             f"(SELECT count(*) FROM {src} WHERE {c} < {c}_lo OR {c} > {c}_hi) AS records_affected FROM b"
             for c in cols]
    return f", b AS (SELECT {q} FROM {src}), wb AS ({union(parts)})\n"


@register("cln4_winsor_bounds_contacts", WR(_winsor_sql() + "SELECT * FROM wb WHERE records_affected > 0"))
def q_cln4(spark, sf):
    """CLN4 winsor bounds (1 % / 99 %) and rows strictly outside."""
    return C.winsor_bounds(ruled_contacts(spark, sf))


def _clip_sql(c):
    return (f"CASE WHEN CAST({c} AS DOUBLE) < {c}_lo THEN {c}_lo WHEN CAST({c} AS DOUBLE) > {c}_hi "
            f"THEN {c}_hi ELSE CAST({c} AS DOUBLE) END")


@register("cln4_winsorized_contacts", WR(
    ", b AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.99) AS {c}_hi"
                                  for c in WINSOR_COLS) + " FROM ruled)\n"
    "SELECT id, " + ", ".join(f"{R(_clip_sql(c))} AS {c}" for c in WINSOR_COLS) + " FROM ruled, b"))
def q_cln4w(spark, sf):
    """CLN4 clipped table (NULL passes through, bounds broadcast as one row)."""
    df = ruled_contacts(spark, sf)
    return C.winsorize(df).select("id", *WINSOR_COLS)


@register("cln5_target_check", WR(
    "SELECT deposit AS value, count(*) AS count, row_number() OVER (ORDER BY deposit) AS position "
    "FROM ruled WHERE deposit IS NOT NULL GROUP BY deposit"))
def q_cln5(spark, sf):
    """CLN5 target check: sorted unique values and counts."""
    return C.target_check(ruled_contacts(spark, sf))


DOMAIN_COLS_C = ["job", "marital", "education", "in_default", "housing", "loan", "contact", "month"]


def _domain_from_cleaned(spark, sf):
    """Expected domains = distinct values (AGG10) of the cleaned table in long form."""
    return P.distinct_values_long(cleaned_contacts(spark, sf))


_OBS_SQL = union([f"SELECT DISTINCT '{c}' AS column_name, coalesce(CAST({c} AS VARCHAR), 'nan') AS value "
                  f"FROM contacts" for c in DOMAIN_COLS_C])
_EXP_SQL = union([f"SELECT DISTINCT '{c}' AS column_name, coalesce(CAST({c} AS VARCHAR), 'nan') AS value "
                  f"FROM cleaned" for c in DOMAIN_COLS_C])


@register("set1_unexpected_values", WC(
    f", obs AS ({_OBS_SQL}), exp AS ({_EXP_SQL})\n"
    "SELECT column_name, value FROM obs EXCEPT SELECT column_name, value FROM exp"))
def q_set1(spark, sf):
    """SET1 observed categories minus the expected domain (left-anti join)."""
    return C.unexpected_values(contacts(spark, sf), _domain_from_cleaned(spark, sf), DOMAIN_COLS_C)


@register("set1_own_domain_customer_names", "SELECT '' AS column_name, '' AS value WHERE false")
def q_set1_own(spark, sf):
    """SET1 through SRC3 on near-unique text: a table has nothing unexpected
    against its own written domain, however many values that has."""
    names = table(spark, sf, "customer").select("c_name")
    path = scratch_path(spark, "customer_domain_json")
    SRC.write_table(P.domain_document(names).withColumnRenamed("column_name", "column"), path, fmt="json")
    domain = SRC.read_domains(spark, path).withColumnRenamed("column", "column_name")
    return C.unexpected_values(names, domain, ["c_name"])


_KEY_TEXT = "SELECT o_orderkey AS id, concat('k', o_orderkey) AS key_text FROM orders"


@register("fe3_decode_order_keys", f"SELECT id, key_text, key_text AS key_text_decoded, CAST(row_number() OVER "
                                   f"(ORDER BY key_text) - 1 AS INTEGER) AS code FROM ({_KEY_TEXT})")
def q_fe3_keys(spark, sf):
    """FE1 / FE3 on a text column with as many categories as rows."""
    t = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"),
                                          F.concat(F.lit("k"), F.col("o_orderkey")).alias("key_text"))
    enc = FE.LabelEncoder.fit(t, ["key_text"])
    coded = enc.inverse(enc.transform(t))
    return coded.select("id", F.col("key_text_decoded").alias("key_text"), "key_text_decoded",
                        F.col("key_text").alias("code"))


@register("cln6_domain_check", WC(
    f", obs AS ({_OBS_SQL}), exp AS ({_EXP_SQL}),\n"
    "j AS (SELECT coalesce(o.column_name, e.column_name) AS column_name, coalesce(o.value, e.value) AS value, "
    "o.value IS NOT NULL AS a, e.value IS NOT NULL AS e FROM obs o FULL JOIN exp e "
    "ON o.column_name = e.column_name AND o.value = e.value)\n"
    "SELECT column_name, string_agg(CASE WHEN e THEN value END, '|' ORDER BY value) AS expected, "
    "string_agg(CASE WHEN a THEN value END, '|' ORDER BY value) AS actual, "
    "coalesce(string_agg(CASE WHEN a AND NOT e THEN value END, '|' ORDER BY value), '') AS unexpected, "
    "count(*) FILTER (WHERE e) AS n_expected, count(*) FILTER (WHERE a) AS n_actual, count(*) FILTER (WHERE a AND NOT e) AS n_unexpected, "
    "count(*) FILTER (WHERE a AND NOT e) > 0 AS has_unexpected FROM j GROUP BY column_name"))
def q_cln6(spark, sf):
    """CLN6 category domain check (expected, actual, unexpected)."""
    d = C.domain_check(contacts(spark, sf), _domain_from_cleaned(spark, sf), DOMAIN_COLS_C)
    return d.select("column_name", F.array_join("expected", "|").alias("expected"),
                    F.array_join("actual", "|").alias("actual"),
                    F.array_join("unexpected", "|").alias("unexpected"),
                    "n_expected", "n_actual", "n_unexpected", "has_unexpected")


@register("cln7_cleaning_summary", WC(
    "SELECT count(*) AS original_rows, CAST(18 AS BIGINT) AS original_columns, "
    f"count(*) FILTER (WHERE {' AND '.join(_rule_sql(r) for r in C.REFERENCE_RULES)}) AS cleaned_rows, "
    "CAST(18 AS BIGINT) AS cleaned_columns, "
    f"count(*) - count(*) FILTER (WHERE {' AND '.join(_rule_sql(r) for r in C.REFERENCE_RULES)}) AS rows_removed, "
    f"{R('count(*) FILTER (WHERE ' + ' AND '.join(_rule_sql(r) for r in C.REFERENCE_RULES) + ') * 100.0 / count(*)')} AS retention_rate, "
    f"{R('100.0 - count(*) FILTER (WHERE ' + ' AND '.join(_rule_sql(r) for r in C.REFERENCE_RULES) + ') * 100.0 / count(*)')} AS removal_rate "
    "FROM cleaned"))
def q_cln7(spark, sf):
    """CLN7 cleaning summary (retention and removal rates)."""
    return C.cleaning_summary(cleaned_contacts(spark, sf))


@register("cln8_short_summary", WR(
    _winsor_sql() + ", " + _audit_sql("cleaned", C.REFERENCE_RULES).replace("f AS", "f AS", 1)
    .replace("\n", "\n", 1).split("\n", 1)[0] + "\n, ra AS (" + _audit_sql("cleaned", C.REFERENCE_RULES)
    .split("\n", 1)[1] + ")\n"
    "SELECT rule AS step, 'business_rule' AS type, column_name, condition, records_removed AS records, "
    "CAST(NULL AS DOUBLE) AS lower_bound, CAST(NULL AS DOUBLE) AS upper_bound FROM ra UNION ALL "
    "SELECT column_name || '_winsorization', 'winsorization', column_name, NULL, records_affected, "
    "lower_bound, upper_bound FROM wb WHERE records_affected > 0"))
def q_cln8(spark, sf):
    """CLN8 short per-rule / per-winsor summary."""
    cl = cleaned_contacts(spark, sf)
    return C.short_summary(C.rule_audit(cl), C.winsor_bounds(C.apply_rules(cl)))


@register("cln9_schema_preview", WR(union([
    f"SELECT '{c}' AS column_name, '{'categorical' if c in CATEGORICAL else 'numerical'}' AS type_class, "
    f"CAST(count(DISTINCT {c}) AS BIGINT) AS n_unique FROM ruled" for c in _CLEAN_COLS])))
def q_cln9(spark, sf):
    """CLN9 post-clean schema preview: type class and distinct count."""
    return C.schema_preview(ruled_contacts(spark, sf))


_POST_NUM = ["age", "balance", "balance_n", "day", "duration", "campaign", "pdays", "previous", "deposit"]


@register("cln_post_outlier_describe", WR(
    ", b AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.01) AS {c}_lo, quantile_cont({c}, 0.99) AS {c}_hi"
                                  for c in WINSOR_COLS) + " FROM ruled),\n"
    "w AS (SELECT " + ", ".join(_clip_sql(c) + f" AS {c}" if c in WINSOR_COLS else c for c in _POST_NUM)
    + " FROM ruled, b)\n" + _describe_sql("w", _POST_NUM)))
def q_post(spark, sf):
    """Describe after rules + winsorizing (the outlier report's statistics)."""
    return P.describe(C.winsorize(ruled_contacts(spark, sf)), _POST_NUM)


# ---------------------------------------------------------------- histograms
from tabsmith.operators import evaluate as EV  # noqa: E402
from tabsmith.operators import features as FE  # noqa: E402
from tabsmith.operators import histogram as H  # noqa: E402
from tabsmith.operators import split as SP  # noqa: E402


def _hist_sql(src: str, x: str, bins: int, group: str | None = None) -> str:
    g = f"{group} AS label, " if group else ""
    gsel = "label, " if group else ""
    gby = " GROUP BY label" if group else ""
    jn = "USING (label)" if group else "ON true"
    w = f"((hi - lo) / {float(bins)})"
    return f"""v AS (SELECT {g}CAST({x} AS DOUBLE) AS x FROM {src} WHERE {x} IS NOT NULL{' AND ' + group + ' IS NOT NULL' if group else ''}),
mm AS (SELECT {gsel}min(x) AS mn, max(x) AS mx FROM v{gby}),
r AS (SELECT {gsel}CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo, CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi FROM mm),
c AS (SELECT {gsel}least(CAST(floor((x - lo) * {float(bins)} / (hi - lo)) AS INTEGER), {bins - 1}) AS bin, count(*) AS count
      FROM v JOIN r {jn} GROUP BY {gsel}bin),
g AS (SELECT CAST(range AS INTEGER) AS bin FROM range({bins}))
SELECT {('r.' + gsel) if group else ''}g.bin, {R(f'lo + g.bin * {w}')} AS lower, {R(f'lo + (g.bin + 1) * {w}')} AS upper,
  coalesce(c.count, 0) AS count
FROM g CROSS JOIN r LEFT JOIN c ON c.bin = g.bin{' AND c.label = r.label' if group else ''}"""


@register("agg18_histogram_lineitem_price", "WITH " + _hist_sql("lineitem", "l_extendedprice", 30))
def q_agg18(spark, sf):
    """AGG18 30-bin equi-width histogram, last bin right-closed, empty bins kept."""
    return H.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 30)


@register("agg19_histogram_duration_by_deposit", W(", " + _hist_sql("contacts", "duration", 30, "deposit")))
def q_agg19(spark, sf):
    """AGG19 per-class histogram, each class with its own range."""
    return H.histogram_by_class(contacts(spark, sf), "duration", "deposit", 30)


def _adaptive_sql():
    hist = _hist_sql("part", "p_retailprice", 30)
    parts = [f"SELECT 'p_retailprice' AS column_name, 'histogram' AS kind, bin AS position, "
             f"CAST(NULL AS VARCHAR) AS value, lower, upper, count FROM hist"]
    for c, k in (("p_size", 20), ("p_brand", 20), ("p_type", 20)):
        parts.append(f"SELECT '{c}', 'top_values', CAST(position AS INTEGER), value, NULL, NULL, count FROM ("
                     f"SELECT CAST({c} AS VARCHAR) AS value, count(*) AS count, "
                     f"row_number() OVER (ORDER BY count(*) DESC, {c}) AS position FROM part "
                     f"WHERE {c} IS NOT NULL GROUP BY {c}) WHERE position <= {k}")
    return f"WITH hist AS (WITH {hist})\n" + union(parts)


@register("agg20_adaptive_distribution_part", _adaptive_sql())
def q_agg20(spark, sf):
    """AGG20 adaptive distribution: histogram above 50 distinct values, else top values."""
    return H.adaptive_distribution(table(spark, sf, "part"),
                                   ["p_retailprice", "p_size", "p_brand", "p_type"])


# ---------------------------------------------------------------- features
ENC_COLS = ["job", "marital", "education", "in_default", "housing", "loan", "contact", "month"]
SCALE_COLS = ["age", "balance", "day", "duration", "campaign", "pdays", "previous"]


def _enc_sql_maps(src="cleaned"):
    return ", ".join(
        f"m_{c} AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS code FROM "
        f"(SELECT DISTINCT coalesce(CAST({c} AS VARCHAR), 'nan') AS value FROM {src}))" for c in ENC_COLS)


def _enc_sql_select(src="cleaned", decoded=False):
    sel = ", ".join(f"m_{c}.code AS {c}" for c in ENC_COLS)
    if decoded:
        sel += ", " + ", ".join(f"m_{c}.value AS {c}_decoded" for c in ("job", "education"))
    joins = " ".join(f"JOIN m_{c} ON coalesce(CAST({src}.{c} AS VARCHAR), 'nan') = m_{c}.value"
                     for c in ENC_COLS)
    return f"SELECT {src}.id, {sel} FROM {src} {joins}"


@register("fe1_label_encode_contacts", WC(", " + _enc_sql_maps() + "\n" + _enc_sql_select()))
def q_fe1(spark, sf):
    """FE1 label encoding: sorted distinct values → 0..k-1 (missing = 'nan')."""
    cl = cleaned_contacts(spark, sf)
    enc = FE.LabelEncoder.fit(cl, ENC_COLS)
    return enc.transform(cl).select("id", *ENC_COLS)


@register("fe2_encoding_mapping", WC("\n" + union([
    f"SELECT '{c}' AS feature, value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS code "
    f"FROM (SELECT DISTINCT coalesce(CAST({c} AS VARCHAR), 'nan') AS value FROM cleaned)" for c in ENC_COLS])))
def q_fe2(spark, sf):
    """FE2 encoder mapping table (feature, value, code)."""
    return FE.encoding_mapping(cleaned_contacts(spark, sf), ENC_COLS)


@register("fe3_decode_contacts", WC(", " + _enc_sql_maps() + "\n" + _enc_sql_select(decoded=True)))
def q_fe3(spark, sf):
    """FE3 decode codes back to text (<col>_decoded), strict on unknown codes."""
    cl = cleaned_contacts(spark, sf)
    enc = FE.LabelEncoder.fit(cl, ENC_COLS)
    coded = enc.transform(cl).select("id", *ENC_COLS)
    return enc.inverse(coded, ["job", "education"])


@register("fe4_standardize_contacts", WC(
    ", st AS (SELECT " + ", ".join(f"avg(CAST({c} AS DOUBLE)) AS {c}_m, stddev_pop(CAST({c} AS DOUBLE)) AS {c}_s"
                                   for c in SCALE_COLS) + " FROM cleaned)\n"
    "SELECT id, " + ", ".join(
        f"{R(f'CASE WHEN {c} IS NULL THEN NULL WHEN {c}_s = 0 THEN 0.0 ELSE ({c} - {c}_m) / {c}_s END')} AS {c}"
        for c in SCALE_COLS) + " FROM cleaned, st"))
def q_fe4(spark, sf):
    """FE4 standardisation with the population std (constant column → 0)."""
    return FE.standardize(cleaned_contacts(spark, sf).select("id", *SCALE_COLS), SCALE_COLS)


@register("fe5_minmax_contacts", WC(
    ", st AS (SELECT " + ", ".join(f"min(CAST({c} AS DOUBLE)) AS {c}_lo, max(CAST({c} AS DOUBLE)) AS {c}_hi"
                                   for c in SCALE_COLS) + " FROM cleaned)\n"
    "SELECT id, " + ", ".join(
        f"{R(f'CASE WHEN {c} IS NULL THEN NULL WHEN {c}_hi = {c}_lo THEN 0.0 ELSE ({c} - {c}_lo) / ({c}_hi - {c}_lo) END')} AS {c}"
        for c in SCALE_COLS) + " FROM cleaned, st"))
def q_fe5(spark, sf):
    """FE5 min-max scaling to [0, 1] (constant column → 0)."""
    return FE.minmax_scale(cleaned_contacts(spark, sf).select("id", *SCALE_COLS), SCALE_COLS)


@register("fe6_binarize_contacts", WC("SELECT id, " + ", ".join(
    f"CAST({c} > 0 AS DOUBLE) AS {c}" for c in SCALE_COLS) + " FROM cleaned"))
def q_fe6(spark, sf):
    """FE6 binarise at > 0."""
    return FE.binarize(cleaned_contacts(spark, sf).select("id", *SCALE_COLS), SCALE_COLS)


# ---------------------------------------------------------------- splits
SCORED_SQL = ("SELECT id, CASE WHEN deposit = 2 THEN 1 ELSE 0 END AS label, "
              "least(1.0, floor(duration / 5) / 1000.0) AS score, "
              "CASE WHEN least(1.0, floor(duration / 5) / 1000.0) >= 0.5 THEN 1 ELSE 0 END AS prediction "
              "FROM contacts")


def scored_contacts(spark, sf):
    """SQL-made scores: label from the target, score from ``duration`` with ties."""
    c = contacts(spark, sf)
    score = F.least(F.lit(1.0), F.floor(F.col("duration") / 5) / 1000.0)
    return c.select("id", F.when(F.col("deposit") == 2, 1).otherwise(0).alias("label"),
                    score.alias("score"), F.when(score >= 0.5, 1).otherwise(0).alias("prediction"))


def WS(sql: str) -> str:
    return W(f", scored AS ({SCORED_SQL})\n{sql}")


def _rank_sql(src, k=None, frac=None, shuffle=True, seed=42):
    order = f"md5(CAST(id AS VARCHAR) || '{seed}'), id" if shuffle else "id"
    rk = f"row_number() OVER (PARTITION BY label ORDER BY {order})"
    if k is not None:
        return f"SELECT id, label, CAST(({rk} - 1) % {k} AS INTEGER) AS fold FROM {src}"
    return (f"SELECT id, label, {rk} <= floor(count(*) OVER (PARTITION BY label) * {frac} + 0.5) AS is_test "
            f"FROM {src}")


@register("spl1_holdout_80_20", WS(_rank_sql("scored", frac=0.2)))
def q_spl1(spark, sf):
    """SPL1 exact stratified 80/20 hold-out (seed 42)."""
    return SP.holdout(scored_contacts(spark, sf).select("id", "label"), "label", "id", 0.2, 42)


@register("spl2_kfold10", WS(_rank_sql("scored", k=10)))
def q_spl2(spark, sf):
    """SPL2 stratified shuffled 10-fold assignment."""
    return SP.kfold(scored_contacts(spark, sf).select("id", "label"), "label", "id", 10, 42)


@register("spl2_kfold5", WS(_rank_sql("scored", k=5)))
def q_spl2b(spark, sf):
    """SPL2 stratified shuffled 5-fold assignment."""
    return SP.kfold(scored_contacts(spark, sf).select("id", "label"), "label", "id", 5, 42)


@register("spl3_unshuffled_kfold3", WS(_rank_sql("scored", k=3, shuffle=False)))
def q_spl3(spark, sf):
    """SPL3 stratified unshuffled 3-fold assignment (rank by key)."""
    return SP.kfold(scored_contacts(spark, sf).select("id", "label"), "label", "id", 3, shuffle=False)


@register("spl2_fold_sizes_orders", f"""
WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS label FROM orders),
f AS ({_rank_sql('o', k=10)})
SELECT fold, label, count(*) AS n FROM f GROUP BY fold, label""")
def q_spl_sizes(spark, sf):
    """SPL2 per-fold class sizes on orders (sizes differ by at most one per class)."""
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("label"))
    return SP.kfold(o, "label", "id", 10, 42).groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- evaluation
@register("evl1_confusion_matrix", WS(
    "SELECT label, count(*) FILTER (WHERE prediction = 0) AS pred_0, "
    "count(*) FILTER (WHERE prediction = 1) AS pred_1 FROM scored GROUP BY label"))
def q_evl1(spark, sf):
    """EVL1 confusion matrix (rows true, columns predicted)."""
    return EV.confusion_matrix(scored_contacts(spark, sf))


def _auc_sql(src, group=None):
    g = f"{group}, " if group else ""
    part = f"PARTITION BY {group} " if group else ""
    gb = f" GROUP BY {group}" if group else ""
    return (f"d AS (SELECT {g}score AS s, count(*) FILTER (WHERE label = 1) AS pos, "
            f"count(*) FILTER (WHERE label <> 1) AS neg FROM {src} GROUP BY {g}score),\n"
            f"rs AS (SELECT {g}s, pos, neg, sum(pos) OVER ({part}ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tps "
            f"FROM d),\n"
            f"a AS (SELECT {g}sum(neg * (tps - pos + pos * 0.5)) / (sum(pos) * sum(neg)) AS auc FROM rs{gb})")


def _metric_cols(src_alias=""):
    tp = "count(*) FILTER (WHERE label = 1 AND prediction = 1)"
    fp = "count(*) FILTER (WHERE label <> 1 AND prediction = 1)"
    fn = "count(*) FILTER (WHERE label = 1 AND prediction <> 1)"
    return (f"{R('count(*) FILTER (WHERE label = prediction) * 1.0 / count(*)')} AS accuracy, "
            f"{R(f'coalesce({tp} * 1.0 / nullif({tp} + {fp}, 0), 0)')} AS precision, "
            f"{R(f'coalesce({tp} * 1.0 / nullif({tp} + {fn}, 0), 0)')} AS recall, "
            f"{R(f'coalesce(2.0 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0)')} AS f1")


@register("evl2_evl4_metrics", WS(", " + _auc_sql("scored") + "\n"
                                  f"SELECT {_metric_cols()}, (SELECT {R('auc')} FROM a) AS auc FROM scored"))
def q_evl24(spark, sf):
    """EVL2-EVL4 accuracy, precision, recall, F1 (0/0 → 0) and exact ROC AUC."""
    return EV.classification_metrics(scored_contacts(spark, sf))


def _folded_sql():
    return (f", folds AS ({_rank_sql('scored', k=10)}),\n"
            "fs AS (SELECT s.*, f.fold FROM scored s JOIN folds f USING (id))")


@register("evl4_metrics_by_fold", WS(
    _folded_sql() + ", " + _auc_sql("fs", "fold") + "\n"
    f"SELECT m.*, {R('a.auc')} AS auc FROM (SELECT fold, {_metric_cols()} FROM fs GROUP BY fold) m "
    "JOIN a USING (fold)"))
def q_evl4f(spark, sf):
    """EVL2-EVL4 per fold in one grouped query (all folds at once)."""
    s = scored_contacts(spark, sf)
    # the fold assignment feeds a sizing job and the metrics job: write it once
    checkpoint_dir(spark)
    f = SP.kfold(s, "label", "id", 10, 42).checkpoint()
    return EV.classification_metrics(f, group="fold")


@register("evl5_roc_curve", WS(f""",
d AS (SELECT score AS s, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
      FROM scored GROUP BY score),
r AS (SELECT s, sum(pos) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tps,
      sum(neg) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS fps, row_number() OVER (ORDER BY s DESC) AS idx FROM d),
t AS (SELECT max(idx) AS last, max(tps) AS P, max(fps) AS N FROM r),
k AS (SELECT r.*, lag(tps) OVER (ORDER BY idx) AS tp0, lead(tps) OVER (ORDER BY idx) AS tp2,
      lag(fps) OVER (ORDER BY idx) AS fp0, lead(fps) OVER (ORDER BY idx) AS fp2 FROM r)
SELECT CAST('inf' AS DOUBLE) AS threshold, 0.0 AS fpr, 0.0 AS tpr
UNION ALL
SELECT {R('s')}, {R('fps * 1.0 / N')}, {R('tps * 1.0 / P')} FROM k, t
WHERE idx = 1 OR idx = last OR fp2 - 2 * fps + fp0 <> 0 OR tp2 - 2 * tps + tp0 <> 0"""))
def q_evl5(spark, sf):
    """EVL5 ROC curve with collinear points dropped, starting at (0, 0, inf)."""
    return EV.roc_curve(scored_contacts(spark, sf))


@register("evl6_pr_curve", WS(f""",
d AS (SELECT score AS s, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
      FROM scored GROUP BY score),
r AS (SELECT s, sum(pos) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tps,
      sum(neg) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS fps FROM d),
t AS (SELECT max(tps) AS P FROM r)
SELECT {R('s')} AS threshold, {R('coalesce(tps * 1.0 / nullif(tps + fps, 0), 0)')} AS precision,
  {R('CASE WHEN P = 0 THEN 1.0 ELSE tps * 1.0 / P END')} AS recall FROM r, t
UNION ALL SELECT NULL, 1.0, 0.0"""))
def q_evl6(spark, sf):
    """EVL6 precision-recall curve ending at (recall 0, precision 1)."""
    return EV.pr_curve(scored_contacts(spark, sf))


def _report_body():
    """The report over a CTE ``scored``."""
    rows = []
    for l in (0, 1):
        tp = f"count(*) FILTER (WHERE label = {l} AND prediction = {l})"
        fp = f"count(*) FILTER (WHERE label <> {l} AND prediction = {l})"
        fn = f"count(*) FILTER (WHERE label = {l} AND prediction <> {l})"
        rows.append((f"coalesce({tp} * 1.0 / nullif({tp} + {fp}, 0), 0)",
                     f"coalesce({tp} * 1.0 / nullif({tp} + {fn}, 0), 0)",
                     f"coalesce(2.0 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0)",
                     f"count(*) FILTER (WHERE label = {l})"))
    parts = [f"SELECT '{l}' AS class_label, {R(p)} AS precision, {R(r)} AS recall, {R(f)} AS f1, "
             f"{s} AS support FROM scored" for l, (p, r, f, s) in zip((0, 1), rows)]
    parts.append("SELECT 'accuracy', NULL, NULL, "
                 f"{R('count(*) FILTER (WHERE label = prediction) * 1.0 / count(*)')}, count(*) FROM scored")
    parts.append("SELECT 'macro avg', " + ", ".join(
        R(f"({rows[0][j]} + {rows[1][j]}) / 2.0") for j in range(3)) + ", count(*) FROM scored")
    parts.append("SELECT 'weighted avg', " + ", ".join(
        R(f"({rows[0][j]} * {rows[0][3]} + {rows[1][j]} * {rows[1][3]}) * 1.0 / count(*)") for j in range(3))
        + ", count(*) FROM scored")
    return union(parts)


@register("evl7_classification_report", WS(_report_body()))
def q_evl7(spark, sf):
    """EVL7 classification report (per class, accuracy, macro and weighted averages)."""
    return EV.classification_report(scored_contacts(spark, sf))


@register("evl8_cv_summary", WS(
    _folded_sql() + ", " + _auc_sql("fs", "fold") + ",\n"
    f"m AS (SELECT fold, {_metric_cols()} FROM fs GROUP BY fold),\n"
    "mm AS (SELECT m.*, a.auc FROM m JOIN a USING (fold))\n" + union([
        f"SELECT '{k}' AS metric, {R(f'avg({k})')} AS mean, {R(f'stddev_samp({k})')} AS std FROM mm"
        for k in ("accuracy", "precision", "recall", "f1", "auc")])))
def q_evl8(spark, sf):
    """EVL8 cross-validation summary: mean and sample std per metric over folds."""
    s = scored_contacts(spark, sf)
    checkpoint_dir(spark)
    per_fold = EV.classification_metrics(SP.kfold(s, "label", "id", 10, 42).checkpoint(), group="fold")
    return EV.cv_summary(per_fold)


@register("evl10_score_distribution", WS(
    ", all_h AS (WITH " + _hist_sql("scored", "score", 50) + "),\n"
    "cls_h AS (WITH " + _hist_sql("scored", "score", 30, "label") + ")\n"
    "SELECT 'all' AS scope, CAST(NULL AS INTEGER) AS label, bin, lower, upper, count FROM all_h UNION ALL "
    "SELECT 'by_class', label, bin, lower, upper, count FROM cls_h"))
def q_evl10(spark, sf):
    """EVL10 score distribution overall (50 bins) and per true class (30 bins)."""
    return H.score_distribution(scored_contacts(spark, sf))


# ---------------------------------------------------------------- models
from tabsmith.operators import bayes as NB  # noqa: E402
from tabsmith.operators import forests as FO  # noqa: E402
from tabsmith.operators import logistic as LG  # noqa: E402
from tabsmith.operators import models as MD  # noqa: E402
from tabsmith.plans import model_data as MDATA  # noqa: E402
from tabsmith.session import written  # noqa: E402

_FEATS = MDATA.FEATURES


def _model_sql():
    """SQL twin of ``model_data.model_table(scale='standard')`` as CTE ``mt``."""
    enc_cols = ", ".join(f"m_{c}.code AS {c}" for c in MDATA.ENCODED)
    joins = " ".join(f"JOIN m_{c} ON coalesce(CAST(cleaned.{c} AS VARCHAR), 'nan') = m_{c}.value"
                     for c in MDATA.ENCODED)
    enc = (f"enc AS (SELECT cleaned.id, CASE WHEN deposit = 2 THEN 1 ELSE 0 END AS label, "
           + ", ".join(f"CAST(cleaned.{c} AS DOUBLE) AS {c}" for c in MDATA.SCALED)
           + f", {enc_cols} FROM cleaned {joins})")
    st = ("st AS (SELECT " + ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in MDATA.SCALED)
          + " FROM enc)")
    sel = ", ".join(
        f"CASE WHEN {c}_s = 0 THEN 0.0 ELSE ({c} - {c}_m) / {c}_s END AS {c}" if c in MDATA.SCALED
        else f"CAST({c} AS DOUBLE) AS {c}" for c in _FEATS)
    mt = f"mt AS (SELECT id, label, {sel} FROM enc, st)"
    return ", " + _enc_sql_maps() + ",\n" + enc + ",\n" + st + ",\n" + mt + "\n"


def _gnb_params_sql():
    pc = ("pc AS (SELECT label AS class, count(*) AS n, "
          + ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) AS v_{c}" for c in _FEATS) + " FROM mt GROUP BY label)")
    vm = "vm AS (SELECT greatest(" + ", ".join(f"var_pop({c})" for c in _FEATS) + ") AS vmax, count(*) AS total_n FROM mt)"
    parts = [f"SELECT class, '{c}' AS feature, m_{c} AS mean, v_{c} + 1e-9 * vmax AS var, n * 1.0 / total_n AS prior, n "
             f"FROM pc, vm" for c in _FEATS]
    return f", {pc}, {vm},\ngp AS ({union(parts)})\n"


@register("mod1_gaussian_nb_params_sql", WC(_model_sql() + _gnb_params_sql()
                                           + f"SELECT class, feature, {R('mean')} AS mean, {R('var')} AS var, "
                                             f"{R('prior')} AS prior, n FROM gp"))
def q_mod1p(spark, sf):
    """MOD1 / MOD15 Gaussian NB parameters fitted in one grouped aggregate
    (class means, smoothed variances, empirical priors)."""
    mt = MDATA.model_table(spark, sf)
    return NB.gaussian_nb_fit(mt, _FEATS).withColumn("class", F.col("class").cast("int"))


def _gnb_score_sql():
    import math as _m
    wide = "pw AS (SELECT " + ", ".join(
        [f"max(CASE WHEN class = {k} THEN prior END) AS prior_{k}" for k in (0, 1)]
        + [f"max(CASE WHEN class = {k} AND feature = '{c}' THEN {v} END) AS {v}_{k}_{c}"
           for k in (0, 1) for c in _FEATS for v in ("mean", "var")]) + " FROM gp)"
    jll = {}
    for k in (0, 1):
        terms = [f"ln(prior_{k})"] + [
            f"- 0.5 * ({_m.log(2 * _m.pi)!r} + ln(var_{k}_{c})) - 0.5 * ({c} - mean_{k}_{c}) * ({c} - mean_{k}_{c}) / var_{k}_{c}"
            for c in _FEATS]
        jll[k] = " ".join(terms)
    return (f", {wide},\nj AS (SELECT id, label, {jll[0]} AS j0, {jll[1]} AS j1 FROM mt, pw)\n"
            "SELECT id, label, CASE WHEN j1 > j0 THEN 1 ELSE 0 END AS prediction, "
            f"{R('exp(j1 - greatest(j0, j1)) / (exp(j0 - greatest(j0, j1)) + exp(j1 - greatest(j0, j1)))')} AS score "
            "FROM j")


@register("mod1_gaussian_nb_scores_sql", WC(_model_sql() + _gnb_params_sql() + _gnb_score_sql()))
def q_mod1s(spark, sf):
    """MOD1 / MOD8 Gaussian NB scoring from the SQL-fitted parameters."""
    mt = MDATA.model_table(spark, sf)
    return NB.score(mt, NB.fit(mt, _FEATS), _FEATS)


@register("mod2_bernoulli_nb_params_sql", WC(_model_sql() + ", " + (
    "pc AS (SELECT label AS class, count(*) AS n, " + ", ".join(
        f"count(*) FILTER (WHERE {c} > 0) AS c_{c}" for c in _FEATS) + " FROM mt GROUP BY label)\n")
    + union([f"SELECT class, '{c}' AS feature, {R(f'(c_{c} + 1.0) / (n + 2.0)')} AS prob, "
             f"{R('n * 1.0 / (SELECT count(*) FROM mt)')} AS prior, n FROM pc" for c in _FEATS])))
def q_mod2(spark, sf):
    """MOD2 Bernoulli NB parameters (binarised at > 0, alpha = 1)."""
    mt = MDATA.model_table(spark, sf)
    return NB.bernoulli_nb_fit(mt, _FEATS).withColumn("class", F.col("class").cast("int"))


def _mnb_sql():
    mm = "mm AS (SELECT " + ", ".join(f"min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in _FEATS) + " FROM mt)"
    mx = ("mx AS (SELECT label, " + ", ".join(
        f"CASE WHEN {c}_hi = {c}_lo THEN 0.0 ELSE ({c} - {c}_lo) / ({c}_hi - {c}_lo) END AS {c}" for c in _FEATS)
        + " FROM mt, mm)")
    pc = ("pc AS (SELECT label AS class, count(*) AS n, " + ", ".join(f"sum({c}) AS s_{c}" for c in _FEATS)
          + " FROM mx GROUP BY label)")
    denom = "(" + " + ".join(f"s_{c}" for c in _FEATS) + f" + {float(len(_FEATS))})"
    return (f", {mm}, {mx}, {pc}\n" + union([
        f"SELECT class, '{c}' AS feature, {R(f'(s_{c} + 1.0) / {denom}')} AS prob, "
        f"{R('n * 1.0 / (SELECT count(*) FROM mt)')} AS prior, n FROM pc" for c in _FEATS]))


@register("mod3_multinomial_nb_params_sql", WC(_model_sql() + _mnb_sql()))
def q_mod3(spark, sf):
    """MOD3 multinomial NB parameters on min-max scaled inputs (alpha = 1)."""
    mt = MDATA.model_table(spark, sf, scale="minmax")
    return NB.multinomial_nb_fit(mt, _FEATS).withColumn("class", F.col("class").cast("int"))


@register("mod15_nb_priors_sql", WC(_model_sql() + f"""
SELECT label AS class, count(*) AS n, {R('count(*) * 1.0 / sum(count(*)) OVER ()')} AS prior FROM mt GROUP BY label"""))
def q_mod15(spark, sf):
    """MOD15 NB parameter report: class counts and priors."""
    return NB.priors(MDATA.encoded_table(spark, sf))


def _nb_scores_sql(kind: str, src: str, name: str, train: str | None = None) -> str:
    """CTE ``<name>`` (id, label, fold, prediction, score): every row of ``src`` (with a fold)
    scored by the naive Bayes of the other folds, or of the rows of ``train`` with its kfold."""
    import math as _m
    stat = {"gaussian": ["avg({c}) AS mean_{c}", "var_pop({c}) AS var_{c}"],
            "bernoulli": ["(count(*) FILTER (WHERE {c} > 0) + 1.0) / (count(*) + 2.0) AS prob_{c}"],
            "multinomial": ["sum({c}) + 1.0 AS s_{c}"]}[kind]
    every = " + ".join(f"s_{c}" for c in _FEATS)
    cols = ", ".join(t.format(c=c) for c in _FEATS for t in stat)
    value = {"gaussian": [("mean", "mean_{c}"), ("var", "var_{c} + 1e-9 * vmax")], "bernoulli": [("prob", "prob_{c}")],
             "multinomial": [("prob", "s_{c} / (" + every + ")")]}[kind]
    term = {"gaussian": f"- 0.5 * ({_m.log(2 * _m.pi)!r} + ln(var_{{k}}_{{c}})) - 0.5 * ({{c}} - mean_{{k}}_{{c}}) * ({{c}} - mean_{{k}}_{{c}}) / var_{{k}}_{{c}}",
            "bernoulli": "+ CASE WHEN {c} > 0 THEN ln(prob_{k}_{c}) ELSE ln(1 - prob_{k}_{c}) END",
            "multinomial": "+ {c} * ln(prob_{k}_{c})"}[kind]
    jll = {k: f"ln(prior_{k}) " + " ".join(term.format(k=k, c=c) for c in _FEATS) for k in (0, 1)}
    vmax = "greatest(" + ", ".join(f"var_pop({c})" for c in _FEATS) + ")" if kind == "gaussian" else "0"
    return (
        f"{name}_tr AS ("
        + (train or f"SELECT k.kfold, t.* FROM (SELECT DISTINCT fold AS kfold FROM {src}) k JOIN {src} t ON t.fold <> k.kfold")
        + "),\n"
        f"{name}_pc AS (SELECT kfold, label AS class, count(*) AS n, {cols} FROM {name}_tr GROUP BY kfold, label),\n"
        f"{name}_vm AS (SELECT kfold, count(*) AS total_n, {vmax} AS vmax FROM {name}_tr GROUP BY kfold),\n"
        f"{name}_pw AS (SELECT {name}_pc.kfold, " + ", ".join(
            [f"max(CASE WHEN class = {k} THEN n * 1.0 / total_n END) AS prior_{k}" for k in (0, 1)]
            + [f"max(CASE WHEN class = {k} THEN {e.format(c=c)} END) AS {v}_{k}_{c}"
               for k in (0, 1) for c in _FEATS for v, e in value])
        + f" FROM {name}_pc JOIN {name}_vm USING (kfold) GROUP BY {name}_pc.kfold),\n"
        f"{name}_j AS (SELECT id, label, fold, {jll[0]} AS j0, {jll[1]} AS j1 FROM {src} JOIN {name}_pw ON fold = kfold),\n"
        f"{name} AS (SELECT id, label, fold, CASE WHEN j1 > j0 THEN 1 ELSE 0 END AS prediction, "
        f"exp(j1 - greatest(j0, j1)) / (exp(j0 - greatest(j0, j1)) + exp(j1 - greatest(j0, j1))) AS score FROM {name}_j)")


def _fold_sql(k: int) -> str:
    return f", folds AS ({_rank_sql('mt', k=k)}),\nmtf AS (SELECT mt.*, folds.fold FROM mt JOIN folds USING (id)),\n"


def _fold_metrics_sql(src: str) -> str:
    return (_auc_sql(src, "fold") + f"\nSELECT m.*, {R('a.auc')} AS auc FROM (SELECT fold, {_metric_cols()} FROM {src} "
            "GROUP BY fold) m JOIN a USING (fold)")


def _folded(spark, sf, k: int, scale: str = "standard"):
    """The model table with its folds, written once: it feeds the statistics and the scoring."""
    return written(MDATA.with_folds(MDATA.model_table(spark, sf, scale), k), "folds")


def _cv_frame(spark, sf, scale="standard", k=10):
    return MDATA.assembled(MDATA.with_folds(MDATA.model_table(spark, sf, scale), k))


@register("mod1_gaussian_nb_cv10", WC(_model_sql() + _fold_sql(10) + _nb_scores_sql("gaussian", "mtf", "sc") + ",\n"
                                      + _fold_metrics_sql("sc")))
def q_mod1cv(spark, sf):
    """MOD1 + MOD10: Gaussian NB, stratified 10-fold metrics per fold."""
    return EV.classification_metrics(written(NB.cross_validate(_folded(spark, sf, 10), _FEATS), "oof"), group="fold")


@register("mod2_bernoulli_nb_oof", WC(_model_sql() + _fold_sql(5) + _nb_scores_sql("bernoulli", "mtf", "sc") + "\n"
                                      f"SELECT id, label, fold, prediction, {R('score')} AS score FROM sc"))
def q_mod2oof(spark, sf):
    """MOD2 + MOD8: Bernoulli NB (entries above 0, alpha 1, empirical priors), out-of-fold scores of 5 folds."""
    return NB.cross_validate(_folded(spark, sf, 5), _FEATS, "bernoulli")


def _minmax_sql() -> str:
    """CTE ``mx``: the folded model table with every feature scaled to [0, 1] over all rows."""
    lo = ", ".join(f"min({c}) AS {c}_lo, max({c}) AS {c}_hi" for c in _FEATS)
    x = ", ".join(f"CASE WHEN {c}_hi = {c}_lo THEN 0.0 ELSE ({c} - {c}_lo) / ({c}_hi - {c}_lo) END AS {c}" for c in _FEATS)
    return f"mm AS (SELECT {lo} FROM mtf),\nmx AS (SELECT id, label, fold, {x} FROM mtf, mm),\n"


@register("mod3_multinomial_nb_oof", WC(_model_sql() + _fold_sql(5) + _minmax_sql() + _nb_scores_sql("multinomial", "mx", "sc")
                                        + f"\nSELECT id, label, fold, prediction, {R('score')} AS score FROM sc"))
def q_mod3oof(spark, sf):
    """MOD3 + MOD8: multinomial NB on min-max data (alpha 1, empirical priors), out-of-fold scores of 5 folds."""
    return NB.cross_validate(_folded(spark, sf, 5, "minmax"), _FEATS, "multinomial")


@register("mod10_nb_oof_predictions", WC(_model_sql() + _fold_sql(10) + _nb_scores_sql("gaussian", "mtf", "sc") + "\n"
                                         f"SELECT id, label, fold, prediction, {R('score')} AS score FROM sc"))
def q_mod10(spark, sf):
    """MOD10 pooled out-of-fold predictions (id, label, fold, prediction, score)."""
    return NB.cross_validate(_folded(spark, sf, 10), _FEATS)


def _fold_scaled_sql(cols: list[str], stats: str, scaled: str) -> tuple[str, str]:
    """CTEs of the unscaled table with folds and every model's own scaler; ``sx``: each row scaled by the scaler
    that has not seen its fold.  Second: the training rows of every model, scaled by its scaler."""
    rest = ", ".join(f"CAST(t.{c} AS DOUBLE) AS {c}" for c in _FEATS if c not in cols)
    x = ", ".join(f"{scaled.format(c=c)} AS {c}" for c in cols) + (f", {rest}" if rest else "")
    ctes = (f", folds AS ({_rank_sql('enc', k=10)}),\nef AS (SELECT enc.*, folds.fold FROM enc JOIN folds USING (id)),\n"
            "ks AS (SELECT DISTINCT fold AS kfold FROM ef),\n"
            "fs AS (SELECT kfold, " + ", ".join(stats.format(c=c) for c in cols) + " FROM ks JOIN ef ON fold <> kfold GROUP BY kfold),\n"
            f"sx AS (SELECT t.id, t.label, t.fold, {x} FROM ef t JOIN fs ON t.fold = fs.kfold),\n")
    return ctes, f"SELECT fs.kfold, t.id, t.label, {x} FROM ef t JOIN fs ON t.fold <> fs.kfold"


_STD_FOLD = _fold_scaled_sql(MDATA.SCALED, "avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s",
                             "CASE WHEN {c}_s = 0 THEN 0.0 ELSE (t.{c} - {c}_m) / {c}_s END")
_MM_FOLD = _fold_scaled_sql(_FEATS, "min({c}) AS {c}_lo, max({c}) AS {c}_hi",
                            "CASE WHEN {c}_hi = {c}_lo THEN 0.0 ELSE (t.{c} - {c}_lo) * 1.0 / ({c}_hi - {c}_lo) END")


def _encoded_folds(spark, sf):
    return written(MDATA.with_folds(MDATA.encoded_table(spark, sf), 10), "folds")


@register("mod10_gaussian_nb_cv10_fold_scaled", WC(
    _model_sql() + _STD_FOLD[0] + _nb_scores_sql("gaussian", "sx", "sc", _STD_FOLD[1])
    + f"\nSELECT id, label, fold, prediction, {R('score')} AS score FROM sc"))
def q_mod10fold(spark, sf):
    """FE4 + MOD10 with scale_scope = fold: Gaussian NB, 10 folds, numeric features standardised with the
    statistics of each training part (no leak), out-of-fold scores."""
    return NB.cross_validate(_encoded_folds(spark, sf), _FEATS, scale=MDATA.SCALED)


@register("mod10_multinomial_nb_cv10_fold_minmax", WC(
    _model_sql() + _MM_FOLD[0] + _nb_scores_sql("multinomial", "sx", "sc", _MM_FOLD[1])
    + f"\nSELECT id, label, fold, prediction, {R('score')} AS score FROM sc"))
def q_mod10foldmm(spark, sf):
    """FE5 + MOD10 with scale_scope = fold: multinomial NB, 10 folds, every feature scaled by the extremes of
    each training part, out-of-fold scores."""
    return NB.cross_validate(_encoded_folds(spark, sf), _FEATS, "multinomial", scale=_FEATS, scaler="minmax", alpha=1.0)


#: CTE ``mtf`` whose fold 0 is the 20 % test part: its model is the one of the 80 % part.
_HOLDOUT_SQL = (f", hold AS ({_rank_sql('mt', frac=0.2)}),\n"
                "mtf AS (SELECT mt.*, CASE WHEN hold.is_test THEN 0 ELSE 1 END AS fold FROM mt JOIN hold USING (id)),\n")


def _holdout(spark, sf):
    return written(SP.holdout(MDATA.model_table(spark, sf), "label", "id", 0.2, 42), "holdout")


@register("mod8_nb_holdout_report", WC(_model_sql() + _HOLDOUT_SQL + _nb_scores_sql("gaussian", "mtf", "sc")
                                       + ",\nscored AS (SELECT * FROM sc WHERE fold = 0)\n" + _report_body()))
def q_mod8(spark, sf):
    """MOD8 + EVL7: Gaussian NB fitted on the 80 % part, report on the 20 % part."""
    d = _holdout(spark, sf)
    models = NB.fit(d.where(~F.col("is_test")), _FEATS)
    return EV.classification_report(NB.score(d.where("is_test"), models, _FEATS))


def _kind_summary_sql(kind: str) -> str:
    """Mean and population std of AUC and accuracy over the folds of one kind's scores."""
    auc = _auc_sql(f"{kind}_sc", "fold")
    return (f"SELECT '{kind}_nb' AS model, avg(auc) AS auc_mean, stddev_pop(auc) AS auc_std, avg(accuracy) AS accuracy_mean, "
            f"stddev_pop(accuracy) AS accuracy_std FROM (WITH {auc} SELECT a.fold, a.auc, m.accuracy FROM a JOIN (SELECT fold, "
            f"count(*) FILTER (WHERE label = prediction) * 1.0 / count(*) AS accuracy FROM {kind}_sc GROUP BY fold) m USING (fold))")


@register("mod9_nb_type_comparison", WC(
    _model_sql() + _fold_sql(5) + _minmax_sql() + ",\n".join(
        _nb_scores_sql(kind, "mx" if kind == "multinomial" else "mtf", f"{kind}_sc") for kind in NB.KINDS)
    + ",\ncmp AS (" + union([_kind_summary_sql(kind) for kind in NB.KINDS]) + ")\n"
    + f"SELECT model, {R('auc_mean')} AS auc_mean, {R('auc_std')} AS auc_std, {R('accuracy_mean')} AS accuracy_mean, "
    f"{R('accuracy_std')} AS accuracy_std, row_number() OVER (ORDER BY auc_mean DESC, model) = 1 AS is_best FROM cmp"))
def q_mod9(spark, sf):
    """MOD9: Gaussian / Bernoulli / multinomial NB, 5-fold AUC and accuracy
    (population std), best by mean AUC."""
    std = _folded(spark, sf, 5)
    scaled = written(FE.minmax_scale(std, _FEATS), "minmax")
    return NB.compare({f"{kind}_nb": written(NB.cross_validate(scaled if kind == "multinomial" else std, _FEATS, kind), "oof")
                       for kind in NB.KINDS})


# logistic regression and forests: iterative / seeded, so no oracle for their values;
# tests/test_models.py covers them, and mod4_logistic_optimality has one for its sums.
def _lr_table(spark, sf):
    return MDATA.with_folds(MDATA.model_table(spark, sf), 10)


@register("mod4_logistic_cv10")
def q_mod4(spark, sf):
    """MOD4 + MOD10: L2 logistic regression (C = 1), 10-fold; precision / recall /
    F1 for the majority class (label 0) and AUC for the deposit probability."""
    return LG.cross_validate(_lr_table(spark, sf), _FEATS)[1]


@register("mod4_logistic_optimality", WC(
    _model_sql() + _fold_sql(10).rstrip(",\n") + "\n"
    f"SELECT k.fold, count(*) AS n_train, CAST(sum(label) AS BIGINT) AS positives, {R('sum(label)')} AS expected, "
    "CAST(0 AS DOUBLE) AS gradient FROM (SELECT DISTINCT fold FROM mtf) k JOIN mtf ON mtf.fold <> k.fold GROUP BY k.fold"))
def q_mod4opt(spark, sf):
    """MOD4: optimality of the ten fold models by plain sums over their training rows: the expected
    positives equal the counted ones, the penalised gradient a row is zero."""
    models, _, _ = LG.cross_validate(table := _folded(spark, sf, 10), _FEATS)
    return LG.gradients(table, models, _FEATS)


@register("mod11_lr_accuracy_cv")
def q_mod11(spark, sf):
    """MOD11 accuracy-only CV summary (mean, population std, per-fold list size), from the table of MOD4."""
    m = LG.cross_validate(_lr_table(spark, sf), _FEATS)[1]
    return m.agg(F.avg("accuracy").alias("accuracy_mean"), F.stddev_pop("accuracy").alias("accuracy_std"),
                 F.count(F.lit(1)).alias("n_folds"))


@register("mod14_lr_coefficients")
def q_mod14(spark, sf):
    """MOD14 LR coefficients sorted by absolute value (sign kept), full data."""
    return LG.importance(LG.fit(MD.ml_ready(MDATA.model_table(spark, sf)), _FEATS), _FEATS)


@register("mod5_random_forest_cv10")
def q_mod5(spark, sf):
    """MOD5 + MOD10: 100-tree forest (no depth limit: 30 levels, sqrt features, balanced class
    weights per training part), 10-fold metrics."""
    return MD.cross_validate(_cv_frame(spark, sf, "none"), MD.random_forest(100, None, 1, True))[0]


@register("mod13_rf_feature_importance")
def q_mod13(spark, sf):
    """MOD6 + MOD13: 100-tree forest without class weights on all rows; importances."""
    d = MD.dealt(MDATA.assembled(MDATA.model_table(spark, sf, "none")).select("label", "features"))
    model = MD.fit_model(MD.random_forest(100, None, 1, False), d)
    return MD.feature_importance(model, _FEATS, spark)


@register("mod7_rf_holdout_metrics")
def q_mod7(spark, sf):
    """MOD7 final forest (150 trees, depth 10, split >= 5, leaf >= 2, balanced) on 80 %, metrics on 20 %."""
    d = SP.holdout(MDATA.assembled(MDATA.model_table(spark, sf, "none")), "label", "id", 0.2, 42)
    return FO.holdout_cut(d, FO.Cut(150, 10, 5), 2, True)[2]


@register("mod12_rf_grid_search")
def q_mod12(spark, sf):
    """MOD12 grid search: trees {50, 100, 150} x depth {5, 10, 15, none} x split {2, 5, 10} x leaf
    {1, 2, 4} (108 settings) x 3 unshuffled stratified folds, exact ROC AUC; one row per
    setting, best flagged."""
    d = MDATA.assembled(SP.kfold(MDATA.model_table(spark, sf, "none"), "label", "id", 3, shuffle=False))
    return FO.grid_search(d)[0]


def _snk5_sql() -> str:
    gp = _gnb_params_sql().replace("FROM mt", "FROM tr")
    rows = [("class_prior", "CAST(NULL AS VARCHAR)", "prior", " WHERE feature = 'age'"),
            ("class_count", "CAST(NULL AS VARCHAR)", "n", " WHERE feature = 'age'"),
            ("class_mean", "feature", "mean", ""), ("class_var", "feature", "var", "")]
    return (f", hold AS ({_rank_sql('mt', frac=0.2)}),\ntr AS (SELECT mt.* FROM mt JOIN hold USING (id) WHERE NOT is_test)" + gp
            + union([f"SELECT 'gaussian_nb' AS model_id, 'train80' AS scope, class, '{p}' AS param, {f} AS feature, "
                     f"{R(v)} AS value FROM gp{w}" for p, f, v, w in rows]))


@register("snk5_model_params", WC(_model_sql() + _snk5_sql()))
def q_snk5(spark, sf):
    """SNK5 parameter export of the Gaussian NB fitted on the 80 % part: class priors, counts, means
    and variances, with the rows that they were fitted on."""
    d = _holdout(spark, sf).where(~F.col("is_test"))
    return MD.nb_params(NB.gaussian_nb_fit(d, _FEATS), "gaussian_nb", "train80")


@register("snk5_forest_params")
def q_snk5f(spark, sf):
    """SNK5 parameter export of the final forest: its settings, and what the fitted trees became."""
    d = SP.holdout(MDATA.assembled(MDATA.model_table(spark, sf, "none")), "label", "id", 0.2, 42)
    spec = MD.random_forest(150, 10, 2, True)
    model = MD.fit_model(spec, MD.ml_ready(d.where(~F.col("is_test")).select("label", "features")))
    return MD.model_params(spec, spark, "rf_final", model)


def _nb_cv_sql():
    folds = (", folds AS (SELECT id, CAST((row_number() OVER (PARTITION BY label ORDER BY "
             "md5(CAST(id AS VARCHAR) || '42'), id) - 1) % 10 AS INTEGER) AS fold FROM mt),\n"
             "mtf AS (SELECT mt.*, folds.fold FROM mt JOIN folds USING (id)),\n"
             "tr AS (SELECT k.kfold, mtf.* FROM (SELECT DISTINCT fold AS kfold FROM mtf) k "
             "JOIN mtf ON mtf.fold <> k.kfold),\n")
    pc = ("pc AS (SELECT kfold, label AS class, count(*) AS n, "
          + ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) AS v_{c}" for c in _FEATS)
          + " FROM tr GROUP BY kfold, label),\n")
    vm = ("vm AS (SELECT kfold, count(*) AS total_n, greatest(" + ", ".join(f"var_pop({c})" for c in _FEATS)
          + ") AS vmax FROM tr GROUP BY kfold),\n")
    wide = ("pw AS (SELECT pc.kfold, " + ", ".join(
        [f"max(CASE WHEN class = {k} THEN n * 1.0 / total_n END) AS prior_{k}" for k in (0, 1)]
        + [f"max(CASE WHEN class = {k} THEN m_{c} END) AS mean_{k}_{c}, "
           f"max(CASE WHEN class = {k} THEN v_{c} + 1e-9 * vmax END) AS var_{k}_{c}"
           for k in (0, 1) for c in _FEATS]) + " FROM pc JOIN vm USING (kfold) GROUP BY pc.kfold),\n")
    import math as _m
    jll = {k: " ".join([f"ln(prior_{k})"] + [
        f"- 0.5 * ({_m.log(2 * _m.pi)!r} + ln(var_{k}_{c})) - 0.5 * ({c} - mean_{k}_{c}) * ({c} - mean_{k}_{c}) / var_{k}_{c}"
        for c in _FEATS]) for k in (0, 1)}
    j = (f"j AS (SELECT id, label, fold, {jll[0]} AS j0, {jll[1]} AS j1 FROM mtf JOIN pw ON mtf.fold = pw.kfold),\n"
         "sc AS (SELECT id, label, fold, CASE WHEN j1 > j0 THEN 1 ELSE 0 END AS prediction, "
         "exp(j1 - greatest(j0, j1)) / (exp(j0 - greatest(j0, j1)) + exp(j1 - greatest(j0, j1))) AS score FROM j)\n")
    return folds + pc + vm + wide + j


def nb_cv_scores(spark, sf):
    return NB.cross_validate(_folded(spark, sf, 10), _FEATS)


@register("mod10_gaussian_nb_cv10_scores_sql", WC(_model_sql() + _nb_cv_sql()
                                                 + f"SELECT id, label, fold, prediction, {R('score')} AS score FROM sc"))
def q_mod10s(spark, sf):
    """MOD1 + MOD10 one-pass Gaussian NB 10-fold CV: out-of-fold predictions from
    fold-complement sufficient statistics (no per-fold refit)."""
    return nb_cv_scores(spark, sf)


@register("mod10_gaussian_nb_cv10_metrics_sql", WC(
    _model_sql() + _nb_cv_sql().rstrip("\n") + ",\n" + _auc_sql("sc", "fold") + "\n"
    f"SELECT m.*, {R('a.auc')} AS auc FROM (SELECT fold, {_metric_cols()} FROM sc GROUP BY fold) m "
    "JOIN a USING (fold)"))
def q_mod10m(spark, sf):
    """MOD10 per-fold accuracy / precision / recall / F1 / AUC of the one-pass NB CV."""
    return EV.classification_metrics(written(nb_cv_scores(spark, sf), "oof"), group="fold")


# ---------------------------------------------------------------- sources / remaining projections
from tabsmith import sources as SRC  # noqa: E402
from tabsmith.session import scratch_path  # noqa: E402


@register("rep1_replace_unknown_contact", W(
    "SELECT id, CASE WHEN contact = 'unknown' THEN 'not_recorded' ELSE contact END AS contact FROM contacts"))
def q_rep1(spark, sf):
    """REP1 replace a sentinel by a given value."""
    return TR.replace_marker(contacts(spark, sf).select("id", "contact"), "contact", "unknown", "not_recorded")


@register("agg10_column_info_contacts", W(f"""
, pairs AS (SELECT DISTINCT column_name, coalesce(value, 'nan') AS value FROM ({_vc_union('contacts', CATEGORICAL)}))
SELECT column_name, 'categorical' AS type, string_agg(value, '|' ORDER BY value) AS values_joined, count(*) AS count
FROM pairs GROUP BY column_name
UNION ALL
SELECT column_name, 'numerical', NULL, NULL FROM (VALUES {", ".join(f"('{c}')" for c in ALL_CONTACT_COLS if c not in CATEGORICAL)}) t(column_name)"""))
def q_agg10i(spark, sf):
    """AGG10 column-information document rows (type class, sorted values, count)."""
    ci = P.column_info(contacts(spark, sf))
    return ci.select("column_name", "type", F.array_join("values", "|").alias("values_joined"), "count")


_CSV_COLS = ["id", "age", "job", "balance_n", "duration", "deposit"]


@register("src1_csv_round_trip_contacts", W(
    "SELECT id, age, CASE WHEN id % 13 = 0 THEN NULL ELSE job END AS job, balance_n, duration, deposit "
    "FROM contacts"))
def q_src1(spark, sf):
    """SRC1 / SNK1: write a delimited file (missing written as ``NA``, some labels as
    ``n/a``), read it back with a schema; the NA vocabulary becomes NULL and
    numbers keep their types.  The file lives in the shared checkpoint folder."""
    c = contacts(spark, sf).select(*_CSV_COLS)
    txt = c.select("id", "age", F.when(F.col("id") % 13 == 0, F.lit("n/a")).otherwise(F.col("job")).alias("job"),
                   F.coalesce(F.col("balance_n").cast("string"), F.lit("NA")).alias("balance_n"),
                   "duration", "deposit")
    path = scratch_path(spark, "contacts_csv")
    SRC.write_table(txt, path, fmt="csv")
    return SRC.read_table(spark, path, fmt="csv", schema="id bigint, age int, job string, balance_n double, "
                                                         "duration double, deposit int")


@register("src3_domains_from_json", WC(
    "\n" + union([f"SELECT DISTINCT '{c}' AS column_name, coalesce(CAST({c} AS VARCHAR), 'nan') AS value FROM cleaned"
                  for c in CATEGORICAL if c != "poutcome"])))
def q_src3(spark, sf):
    """SRC3 / SNK2: the column-information document of the cleaned table is written
    as JSON and read back as expected domains ``(column, value)``."""
    info = P.domain_document(cleaned_contacts(spark, sf)).withColumnRenamed("column_name", "column")
    path = scratch_path(spark, "column_info_json")
    SRC.write_table(info, path, fmt="json")
    return SRC.read_domains(spark, path).withColumnRenamed("column", "column_name")


@register("src4_reload_encoded_table", WC(", " + _enc_sql_maps() + "\n" + _enc_sql_select()))
def q_src4(spark, sf):
    """SRC4 / SNK1: write the encoded table and its mapping, reload both; the
    reloaded mapping decodes the reloaded table."""
    cl = cleaned_contacts(spark, sf)
    enc = FE.LabelEncoder.fit(cl, ENC_COLS)
    t_path, m_path = scratch_path(spark, "encoded"), scratch_path(spark, "mapping")
    SRC.write_table(enc.transform(cl).select("id", *ENC_COLS), t_path)
    SRC.write_table(enc.mapping_df, m_path)
    table_df, mapping = SRC.load_encoded(spark, t_path, m_path)
    assert mapping is not None
    return table_df


@register("agg10_distinct_values_long_contacts", W(f"""
SELECT DISTINCT column_name, coalesce(value, 'nan') AS value FROM ({_vc_union('contacts', ALL_CONTACT_COLS)})"""))
def q_agg10l(spark, sf):
    """AGG10 whole: every distinct ``(column, value)`` of every column (the
    near-unique ``id`` included), no list cap."""
    return P.distinct_values_long(contacts(spark, sf), ALL_CONTACT_COLS)


@register("fe7_feature_vector", WC(_model_sql() + "SELECT id, label, " + ", ".join(
    f"{R(c)} AS v{i:02d}" for i, c in enumerate(_FEATS)) + " FROM mt"))
def q_fe7(spark, sf):
    """FE7 feature vector of the model table, unpacked by position: entry i is
    feature i in table order (checks the assembler order and values)."""
    from pyspark.ml.functions import vector_to_array
    d = MDATA.assembled(MDATA.model_table(spark, sf))
    arr = vector_to_array(F.col("features"))
    return d.select("id", "label", *[arr[i].alias(f"v{i:02d}") for i in range(len(_FEATS))])


@register("snk4_pipeline_reload_scores", WC(_model_sql() + _gnb_params_sql() + _gnb_score_sql()))
def q_snk4(spark, sf):
    """SNK4: spark.ml Gaussian NB fitted on all rows, saved with its assembler as
    one PipelineModel in the shared folder, loaded back and used to score the
    raw feature columns (the feature list travels with the model).  spark.ml's
    Gaussian NB equals the SQL fit, so the SQL scoring is the oracle."""
    mt = MDATA.model_table(spark, sf)
    model = MD.fit_model(MD.gaussian_nb(), MDATA.assembled(mt))
    path = scratch_path(spark, "nb_pipeline")
    MD.save_pipeline(model, _FEATS, path)
    loaded = MD.load_pipeline(path)
    return MD._score_cols(loaded.transform(mt), ["id", "label"])


_NUMERIC_TABLE_SCHEMA = ("column_name string, count bigint, mean double, std double, min double, p25 double, "
                         "p50 double, p75 double, max double, missing bigint, missing_pct double")


@register("snk3_numeric_table_csv_round_trip", W(_describe_sql("contacts", CONTACT_NUM, True)))
def q_snk3(spark, sf):
    """SNK3: the numeric feature table (AGG3) written as a CSV statistics table
    (header, one file) in the shared folder and read back with its schema."""
    path = scratch_path(spark, "numeric_table_csv")
    SRC.write_report(P.numeric_table(contacts(spark, sf), CONTACT_NUM), path, fmt="csv")
    return SRC.read_table(spark, path, fmt="csv", schema=_NUMERIC_TABLE_SCHEMA)


@register("snk2_missing_report_json_round_trip", _mr_sql())
def q_snk2(spark, sf):
    """SNK2: the missing-value report (AGG8 + AGG9) written as a JSON report
    in the shared folder and read back with the report's own schema."""
    rep = M.missing_report(contacts(spark, sf))
    path = scratch_path(spark, "missing_report_json")
    SRC.write_report(rep, path)
    return spark.read.schema(rep.schema).json(path)
