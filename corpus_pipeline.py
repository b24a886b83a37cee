"""Corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet to the shared folder and read again as the next one's
``docs``.  All stages but the last return the columns of ``documents``.

1. quality rules: documents that fail, or whose host is rejected, go;
2. toxicity: documents scored toxic go;
3. n-gram Jaccard join (five words, 0.8): one document of each group stays;
4. secret scan: secrets in the texts are replaced by a mark;
5. best-fit packing: every document is placed in sequences of several lengths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.llm.binpack import best_fit
from tabsmith.llm.hostrules import reject_by_rules
from tabsmith.llm.nnpu import fold, score, train, THRESHOLD
from tabsmith.llm.partenum import join_checked, ngram_jaccard_join
from tabsmith.llm.secrets import redact
from tabsmith.session import written

#: The last stage cannot be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host is not rejected.

    Null and empty texts have too few words and go; repeated rows share their
    verdict; a null source is a host of its own.  Very long texts are counted
    whole.  No documents: no rows.  Other columns stay as they are, whatever their names.
    """
    return reject_by_rules(docs, "text", "source")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not scored toxic; learnt from the labels outside the held-out fold.

    Null and empty texts get the classifiers' intercept; rows without an id are
    scored but teach nothing; repeated rows share their score and teach once.
    Ids with both labels teach nothing; without a confirmed document all rows
    stay.  No documents: no rows.  Other columns stay, whatever their names.
    """
    learn = fold("doc_id", 4) != 2
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs.filter(learn), labels.filter(learn), "doc_id", "text")
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    return score(row, model, "text", "score").filter(F.col("score") < THRESHOLD).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    A row is known by its id and text, so rows that share an id but not the
    text are judged apart; of rows alike in both one stays.  Rows without an id
    come after all others.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"),
                   F.sha2(F.coalesce("text", F.lit("")), 256).alias("text"))
    groups = written(ngram_jaccard_join(docs.select(key.alias("key"), "text"), "key", "text", width=5, percent=80)
                     .select("key", "component_id"), "groups")
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("key"))
    gone = written(groups.filter(~F.col("key").eqNullSafe(F.col("component_id"))).select("key").distinct(), "copies")
    left = join_checked(row, gone.withColumnRenamed("key", "gone"), F.col("key").eqNullSafe(F.col("gone")), "left_anti")
    more = written(groups.groupBy("key").count().filter("count > 1").select(F.col("key").alias("more")), "repeats")
    if more.limit(1).count():
        again = F.col("key").eqNullSafe(F.col("more"))
        left = join_checked(left, more, again, "left_anti").unionByName(
            join_checked(left, more, again, "left_semi").dropDuplicates(["key"]))
    return left.select("row.*")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced; ``n_chars`` follows the text.

    A null text stays null and keeps its ``n_chars``; repeated rows and rows
    without an id are treated by their text alone; of spans that overlap the
    union is replaced.  No documents: no rows.  Other columns stay, whatever their names.
    """
    out = redact(docs, "doc_id", "text")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), "n_chars"))
    return out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in the sequences.

    Null and empty texts are one piece of no words; repeated rows and rows
    without an id are packed as they are; texts longer than the longest
    sequence are cut into pieces.  No documents: no rows.  Other columns are dropped.
    """
    return best_fit(docs, "doc_id", text_col="text")


STAGES = [("quality rules", quality_rules), ("toxicity", toxicity), ("n-gram Jaccard join", near_duplicates),
          ("secret scans", secret_scan), ("best-fit packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
