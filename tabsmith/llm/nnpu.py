"""Toxicity scores by non-negative positive-unlabelled learning.

Only confirmed toxic documents are used as labels; everything else is unlabelled
text, toxic or not.  With class prior p the risk of a scorer g is estimated by

    p E_P[l(g)] + max(0, E_U[l(-g)] - p E_P[l(-g)])

with the logistic loss l: the unlabelled part minus its toxic share stands for
the clean documents, and where that difference turns negative the step goes
back instead of fitting it further.

Features are the words of a text and the 5-letter grams of ``<word>``, hashed;
those that toxic documents have far more often than unlabelled
ones are kept.  The classifiers
are numpy models, one per shard of the training sample, each fitted in a task
of its own; the score of a document is the mean of their probabilities.  A
document's score depends on its text alone.

The sample is bounded by about ``max_positive`` and ``max_unlabelled`` rows that
differ in id or text, chosen by hashes; all documents are scored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.llm.textops import slices
from tabsmith.session import written

HASHES = 1 << 18
FEATURES = 512
SHARDS = 2
#: A feature is kept if so many toxic documents and this share of them have it, so many times as often as the unlabelled.
SUPPORT, SUPPORT_SHARE, LIFT = 4, 0.02, 2.0
MAX_POSITIVE, MAX_UNLABELLED = 4_000, 12_000
THRESHOLD = 0.3
_WORD = re.compile(r"[^\W\d_]+")
#: Words whose features a task remembers; a tuple each, so a worker holds a few tens of MB of them.
_REMEMBERED = 60_000


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def word_features(word: str) -> set[int]:
    """Hashes of a word and of the 5-letter grams of the word between brackets."""
    w = f"<{word}>"
    return {zlib.crc32(x.encode()) % HASHES for x in (w, *(w[i:i + 5] for i in range(len(w) - 4)))}


class Features:
    """Kept features of texts, with a bounded memory of words."""

    def __init__(self, kept: dict[int, int] | None = None):
        self.kept, self.seen = kept, {}        # word -> features

    def of(self, text: str | None) -> set[int]:
        found: set[int] = set()
        for w in set(_WORD.findall((text or "").lower())):
            got = self.seen.get(w)
            if got is None:
                got = tuple(word_features(w))
                if self.kept is not None:
                    got = tuple(self.kept[f] for f in got if f in self.kept)
                if len(self.seen) >= _REMEMBERED:
                    self.seen.clear()
                self.seen[w] = got
            found.update(got)
        return found


def fit_nnpu(x: np.ndarray, positive: np.ndarray, prior: float, steps: int = 300, rate: float = 0.1,
             ridge: float = 5e-4) -> np.ndarray:
    """Weights (last: intercept) of a linear scorer that minimises the non-negative PU risk."""
    x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    p, u = x[positive], x[~positive]
    w = np.zeros(x.shape[1])
    w[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        gp, gu = p @ w, u @ w
        sp, su = 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
        clean = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        up = prior * p.T @ (sp - 1) / len(p)
        down = u.T @ su / len(u) - prior * p.T @ sp / len(p)
        g = (up + down if clean >= 0 else -down) + ridge * w * (np.arange(len(w)) < len(w) - 1)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.999 ** k)) + 1e-8)
    return w


def share(df: DataFrame, bound: int, *cols: str) -> Column:
    """Keeps about ``bound`` rows by a hash of ``cols``, all rows if there are fewer."""
    n = max(1, df.count())
    return F.pmod(F.xxhash64(*cols), F.lit(1_000_000)) < int(min(1.0, bound / n) * 1_000_000)


def one_label(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """``(id, y)`` of the ids that have one label, 0 or 1; null ids and labels, and ids with both, are left out."""
    return (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).dropna().filter("y in (0, 1)")
            .groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("top")).filter("y = top").select("id", "y"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_positive: int = MAX_POSITIVE,
          max_unlabelled: int = MAX_UNLABELLED) -> tuple[dict[int, int], list[np.ndarray], float]:
    """Kept features, the weights of each shard's classifier, and the class prior.

    ``docs`` and ``labels`` hold what may be learnt from; rows without an id,
    labels that are null, and ids with both labels teach nothing; rows alike in
    id and text teach once.  Without a confirmed document there are no
    classifiers and the prior is 0.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    known = one_label(labels, id_col, label_col)
    prior = known.agg(F.avg("y")).first()[0] or 0.0
    prior = min(max(prior, 0.0), 0.95)
    toxic = known.filter("y = 1").select("id")
    toxic = written(toxic.filter(share(toxic, max_positive, "id")), "toxic")     # at most about max_positive ids
    confirmed = written(docs.join(F.broadcast(toxic), "id").dropDuplicates(["id", "text"]), "confirmed")
    confirmed = confirmed.filter(share(confirmed, max_positive, "id", "text"))
    unlabelled = docs.filter(share(docs, max_unlabelled, "id", "text")).dropDuplicates(["id", "text"])
    sample = written(confirmed.withColumn("p", F.lit(1)).union(unlabelled.withColumn("p", F.lit(0))), "sample")

    def count(batches):
        seen, find = np.zeros((2, HASHES), np.int64), Features()
        for batch in batches:
            for text, p in zip(batch.column("text").to_pylist(), batch.column("p").to_pylist()):
                seen[p, list(find.of(text))] += 1
        at = np.flatnonzero(seen.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[1, at]), pa.array(seen[0, at])], ["f", "p", "u"])

    sizes = {r.p: r.n for r in sample.groupBy("p").agg(F.count("*").alias("n")).collect()}
    np_, nu = sizes.get(1, 0), sizes.get(0, 0)
    if not np_ or not nu or prior <= 0:
        return {}, [], 0.0
    each = (sample.mapInArrow(count, "f long, p long, u long").groupBy("f")
            .agg(F.sum("p").alias("p"), F.sum("u").alias("u")))
    rp, ru = (F.col("p") + 0.5) / (np_ + 1), (F.col("u") + 0.5) / (nu + 1)
    gain = F.col("p") * F.log(rp / ru)       # how much the toxic documents favour the feature
    kept = {r.f: i for i, r in enumerate(
        each.filter((rp > LIFT * ru) & (F.col("p") >= max(SUPPORT, SUPPORT_SHARE * np_))).orderBy(F.desc(gain), "f").limit(FEATURES).collect())}

    def to_features(batches):
        find = Features(kept)
        for batch in batches:
            for part in slices(batch, "text"):
                found = [sorted(find.of(t)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("shard"), part.column("p"), pa.array(found, pa.list_(pa.int32()))], ["shard", "p", "f"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros((len(pdf), len(kept)), np.uint8)
        for i, found in enumerate(pdf["f"]):
            x[i, found] = 1
        positive = pdf["p"].to_numpy() == 1
        if positive.all() or not positive.any():
            return pd.DataFrame({"w": pd.Series([], dtype=object)})
        return pd.DataFrame({"w": [fit_nnpu(x, positive, prior).tolist()]})

    # texts become features before the shuffle: a group holds its documents' feature numbers only
    models = (sample.select(F.pmod(F.xxhash64("id", "text", F.lit("shard")), F.lit(SHARDS)).alias("shard"), "p", "text")
              .mapInArrow(to_features, "shard long, p int, f array<int>")
              .groupBy("shard").applyInPandas(fit, T.StructType([T.StructField("w", T.ArrayType(T.DoubleType()))])))
    return kept, [np.array(r.w) for r in models.collect()], prior


def score(docs: DataFrame, model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the toxicity of every whole text in ``out_col`` (0 to 1, higher: likelier toxic).

    Null texts count as empty; an empty text gets the classifiers' intercept.
    All rows and columns stay, a column named ``out_col`` is replaced.  A model
    without classifiers gives 0.
    """
    kept, weights, _ = model
    w = np.array(weights) if weights else None
    rest = [c for c in docs.columns if c != out_col]
    plain = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        find = Features(kept)
        for batch in batches:
            for part in slices(batch, "text"):
                out = np.zeros(part.num_rows)
                if w is not None:
                    for i, text in enumerate(part.column("text").to_pylist()):
                        g = w[:, sorted(find.of(text))].sum(axis=1) + w[:, -1]
                        out[i] = (1 / (1 + np.exp(-g))).mean()
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(out)], ["row", "score"])

    return (plain.mapInArrow(run, plain.select("row").schema.add("score", "double"))
            .select("row.*", F.col("score").alias(out_col)))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``.

    Learns only from rows whose id does not fall in the held-out fold
    (crc32 modulo 4 is 2).  Repeated rows, null ids and null texts are scored
    like any other row; columns that clash with the result's are replaced.
    Empty documents give no rows, empty labels the score 0 everywhere.  A very
    long text is scored whole, in memory linear in its different words.
    """
    learn = fold(id_col, 4) != 2
    model = train(docs.filter(learn), labels.filter(learn), id_col, text_col)
    return (score(docs, model, text_col).withColumn("held_out", ~learn)
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))
