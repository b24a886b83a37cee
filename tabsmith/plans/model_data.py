"""Model input tables built from the cleaned ``contacts`` table.

Steps (as in the original workflow): missing-value policy → label encoding
of the categorical columns → global standardisation of the numeric subset →
target recode {1, 2} → {0, 1}.  The 15 features keep table order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.operators import features as FE
from tabsmith.operators import missing as M
from tabsmith.operators import split as SP
from tabsmith.plans.contacts import contacts
from tabsmith.session import checkpoint_dir

# Feature order and the numeric subset that is standardised.
FEATURES = ["age", "job", "marital", "education", "in_default", "balance", "housing", "loan",
            "contact", "day", "month", "duration", "campaign", "pdays", "previous"]
SCALED = ["age", "balance", "day", "duration", "campaign", "pdays", "previous"]
ENCODED = ["job", "marital", "education", "in_default", "housing", "loan", "contact", "month"]


def encoded_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, label, FEATURES...)``: encoded, unscaled, label in {0, 1}."""
    cl = M.apply_policy(contacts(spark, sf_dir))[0].persist()
    enc = FE.LabelEncoder.fit(cl, ENCODED)
    t = enc.transform(cl).select(
        "id", F.when(F.col("deposit") == 2, 1).otherwise(0).alias("label"),
        *[F.col(c).cast("double").alias(c) for c in FEATURES])
    # cut the lineage (join, policy, encoder) once; every fold / model reads this
    checkpoint_dir(spark)
    out = t.checkpoint()
    cl.unpersist()
    return out


def model_table(spark: SparkSession, sf_dir: str, scale: str = "standard") -> DataFrame:
    """Model input; ``scale`` = ``standard`` (numeric subset, global stats),
    ``minmax`` (standard, then every feature to [0, 1]) or ``none``."""
    t = encoded_table(spark, sf_dir)
    if scale in ("standard", "minmax"):
        t = FE.standardize(t, SCALED)
    if scale == "minmax":
        t = FE.minmax_scale(t, FEATURES)
    return t


def with_folds(df: DataFrame, k: int = 10, seed: int = 42) -> DataFrame:
    return SP.kfold(df, "label", "id", k, seed)


def assembled(df: DataFrame) -> DataFrame:
    return FE.assemble(df, FEATURES)
