"""The ``contacts`` table: a stand-in for the bank-contact table of the original
workflow, derived from ``orders`` ⋈ ``customer`` so it grows with the inputs.

It has the same column roles (12 features, 3 missingness tiers, imbalanced
binary target ``deposit`` ∈ {1, 2}) plus a unique key ``id`` and a numeric
column with real NULLs (``balance_n``).  ``CONTACTS_SQL`` is the same
definition as portable SQL for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Canonical column names of the raw table, in position order
# (raw names V1..V16, target raw name Class -> deposit).
STANDARD_NAMES = [
    "age", "job", "marital", "education", "default", "balance", "housing", "loan",
    "contact", "day", "month", "duration", "campaign", "pdays", "previous", "poutcome",
]
TARGET_RAW, TARGET = "Class", "deposit"

# In this table ``default`` is called ``in_default`` (reserved word in SQL).
CONTACT_FEATURES = [
    "age", "job", "marital", "education", "in_default", "balance", "housing", "loan",
    "contact", "day", "month", "duration", "campaign", "pdays", "previous", "poutcome",
]
CATEGORICAL = ["job", "marital", "education", "in_default", "housing", "loan", "contact",
               "month", "poutcome"]
NUMERIC = ["age", "balance", "balance_n", "day", "duration", "campaign", "pdays", "previous"]

CONTACTS_SQL = """
SELECT o_orderkey AS id,
  CAST(18 + (c_custkey * 37 + o_orderkey) % 78 AS INT) AS age,
  CASE WHEN c_custkey % 157 = 0 THEN 'unknown' ELSE lower(c_mktsegment) END AS job,
  CASE o_orderstatus WHEN 'F' THEN 'married' WHEN 'O' THEN 'single' ELSE 'divorced' END AS marital,
  CASE WHEN o_orderkey % 24 = 0 THEN 'unknown' WHEN o_orderkey % 24 < 13 THEN 'secondary'
       WHEN o_orderkey % 24 < 20 THEN 'tertiary' ELSE 'primary' END AS education,
  CASE WHEN o_orderkey % 55 = 0 THEN 'yes' ELSE 'no' END AS in_default,
  c_acctbal AS balance,
  CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE c_acctbal END AS balance_n,
  CASE WHEN o_orderkey % 9 < 5 THEN 'yes' ELSE 'no' END AS housing,
  CASE WHEN o_orderkey % 6 = 0 THEN 'yes' ELSE 'no' END AS loan,
  CASE WHEN o_orderkey % 7 < 2 THEN 'unknown' WHEN o_orderkey % 7 = 2 THEN 'telephone' ELSE 'cellular' END AS contact,
  CAST(extract(day FROM o_orderdate) AS INT) AS day,
  substr('janfebmaraprmayjunjulaugsepoctnovdec', CAST(3 * extract(month FROM o_orderdate) - 2 AS INT), 3) AS month,
  o_totalprice / 100 AS duration,
  CAST(1 + (o_orderkey * o_orderkey) % 63 AS INT) AS campaign,
  CAST(CASE WHEN o_orderkey % 11 < 9 THEN -1 ELSE (o_orderkey * 31) % 871 END AS INT) AS pdays,
  CAST(CASE WHEN o_orderkey % 11 < 9 THEN 0 ELSE 1 + o_orderkey % 10 END AS INT) AS previous,
  CASE WHEN o_orderkey % 11 < 9 THEN 'unknown' WHEN o_orderkey % 3 = 0 THEN 'failure'
       WHEN o_orderkey % 3 = 1 THEN 'other' ELSE 'success' END AS poutcome,
  CASE WHEN o_totalprice > 470000 OR (o_orderpriority = '1-URGENT' AND o_totalprice > 340000) THEN 2 ELSE 1 END AS deposit
FROM orders JOIN customer ON o_custkey = c_custkey
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build ``contacts`` with the DataFrame API (same rows as ``CONTACTS_SQL``).

    The join is a plain equi-join on the customer key; AQE picks broadcast or
    sort-merge from runtime sizes, so nothing here assumes ``customer`` is small.
    """
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
        "o_orderpriority")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    j = o.join(c, o.o_custkey == c.c_custkey)
    k, ck = F.col("o_orderkey"), F.col("c_custkey")
    m11 = k % 11 < 9
    return j.select(
        k.alias("id"),
        (F.lit(18) + (ck * 37 + k) % 78).cast("int").alias("age"),
        F.when(ck % 157 == 0, "unknown").otherwise(F.lower("c_mktsegment")).alias("job"),
        F.when(F.col("o_orderstatus") == "F", "married")
         .when(F.col("o_orderstatus") == "O", "single").otherwise("divorced").alias("marital"),
        F.when(k % 24 == 0, "unknown").when(k % 24 < 13, "secondary")
         .when(k % 24 < 20, "tertiary").otherwise("primary").alias("education"),
        F.when(k % 55 == 0, "yes").otherwise("no").alias("in_default"),
        F.col("c_acctbal").alias("balance"),
        F.when(k % 101 == 0, F.lit(None).cast("double")).otherwise(F.col("c_acctbal")).alias("balance_n"),
        F.when(k % 9 < 5, "yes").otherwise("no").alias("housing"),
        F.when(k % 6 == 0, "yes").otherwise("no").alias("loan"),
        F.when(k % 7 < 2, "unknown").when(k % 7 == 2, "telephone").otherwise("cellular").alias("contact"),
        F.dayofmonth("o_orderdate").cast("int").alias("day"),
        F.substring(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"),
                    F.month("o_orderdate") * 3 - 2, F.lit(3)).alias("month"),
        (F.col("o_totalprice") / 100).alias("duration"),
        (F.lit(1) + (k * k) % 63).cast("int").alias("campaign"),
        F.when(m11, F.lit(-1)).otherwise((k * 31) % 871).cast("int").alias("pdays"),
        F.when(m11, F.lit(0)).otherwise(F.lit(1) + k % 10).cast("int").alias("previous"),
        F.when(m11, "unknown").when(k % 3 == 0, "failure").when(k % 3 == 1, "other")
         .otherwise("success").alias("poutcome"),
        F.when((F.col("o_totalprice") > 470000)
               | ((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 340000)), 2)
         .otherwise(1).alias("deposit"),
    )


RAW_SQL = ("SELECT id, " + ", ".join(
    f"{'in_default' if n == 'default' else n} AS V{i + 1}" for i, n in enumerate(STANDARD_NAMES))
    + ", deposit AS Class FROM contacts")


def raw_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``contacts`` under the raw positional names V1..V16 and ``Class`` (plus ``id``)."""
    c = contacts(spark, sf_dir)
    return c.select(["id"] + [
        F.col("in_default" if n == "default" else n).alias(f"V{i + 1}")
        for i, n in enumerate(STANDARD_NAMES)] + [F.col("deposit").alias(TARGET_RAW)])


def with_contacts(sql: str) -> str:
    """Prefix an oracle query with the ``contacts`` CTE."""
    return f"WITH contacts AS ({CONTACTS_SQL})\n{sql}"
