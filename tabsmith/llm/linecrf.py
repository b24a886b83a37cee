"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  A line's score comes from features of the line and
of its neighbours, and a transition weight couples adjacent labels; the
forward-backward recursion gives each line's probability of being good.  A
document's quality is the mean of these marginals weighted by line length,
mapped to a probability by a logistic curve.

The field learns from labelled documents: all lines carry their document's
label, and the couplings and neighbours sort out the lines that do not fit.
The sample is bounded by about ``max_docs`` rows that differ in id or text,
chosen by hashes and dealt to a few shards; each shard fits its own numpy model
in one task and the document scores are averaged.  All documents are scored,
whole texts, from the text alone.

The fit minimises the mean over documents of -log P(labels) / lines, so every
document counts alike, with a ridge.  For the fit alone, documents of more than
``CHAIN`` lines are cut into chains of so many (every line still teaches, the
coupling over a cut does not): a step's recursion is then no longer than that.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.llm.nnpu import fold, one_label, share
from tabsmith.llm.textops import slices
from tabsmith.session import written

SHARDS = 4
MAX_DOCS = 6_000
THRESHOLD = 0.5
#: Lines of one chain of the fit.
CHAIN = 512
_SYMBOLS = "#*$%&|<>"
_UPPER = re.compile(r"[^\W\d_a-zß-öø-ÿ]")
_LOCAL = 12


def local_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Own features (lines x local) and weights (lengths) of the lines of a text; at least one line."""
    lines = (text or "").split("\n")
    rows, seen = [], set()
    for line in lines:
        words = line.split()
        n, m = len(line) or 1, len(words) or 1
        kinds = len(set(words))
        marks = sum(map(line.count, _SYMBOLS))
        rows.append((
            np.log1p(len(line)) / 5, marks / n, marks > 0, line.count("|") / m, line.count("!") / m,
            len(_UPPER.findall(line)) / n, (m - kinds) / m, sum(map(str.__eq__, words, words[1:])) / m,
            line in seen and bool(words), sum(map(str.isdigit, line)) / n, line.rstrip()[-1:] in (".", "?", "!") if words else 0,
            min(len(line) / m, 20) / 10))
        seen.add(line)
    return np.array(rows, np.float64), np.array([max(len(line), 1) for line in lines], np.float64)


def with_neighbours(x: np.ndarray) -> np.ndarray:
    """Features of each line, of the line before and of the line after (zeros where there is none)."""
    none = np.zeros((1, _LOCAL))
    return np.hstack([x, np.vstack([none, x[:-1]]), np.vstack([x[1:], none])])


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features (lines x 3 * local) and weights (lengths) of the lines of a text; at least one line."""
    x, weight = local_features(text)
    return with_neighbours(x), weight


def marginals(score: np.ndarray, couple: np.ndarray, length: np.ndarray,
              share: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of every line, summed pair probabilities, and the log partition of all chains.

    ``score`` holds the lines of all chains one after the other, ``length``
    the lines of each; the two sums weigh each chain by ``share`` (default 1).
    The recursions step through all chains at once, longest first, so finished
    chains drop off the end.
    """
    order = np.argsort(-length, kind="stable")
    first = (np.cumsum(length) - length)[order]
    size = length[order]
    share = (np.ones(len(length)) if share is None else share)[order]
    alpha = np.zeros((len(score), 2))
    beta = np.zeros((len(score), 2))
    node = np.stack([np.zeros_like(score), score], axis=1)
    alive = len(size)
    alpha[first] = node[first]
    active = []
    for t in range(1, int(size[0]) if len(size) else 0):
        alive = int(np.searchsorted(-size, -t, "left"))
        at = first[:alive] + t
        active.append(at)
        a = alpha[at - 1][:, :, None] + couple[None]
        alpha[at] = np.logaddexp(a[:, 0], a[:, 1]) + node[at]
    pair = np.zeros((2, 2))
    last = first + size - 1
    total = np.zeros(len(score))
    z = np.logaddexp(alpha[last, 0], alpha[last, 1])
    total[first] = z
    owner = np.repeat(np.arange(len(length)), length)
    by_doc = np.zeros(len(length))
    by_doc[order] = z
    total = by_doc[owner]
    for at in reversed(active):
        b = couple[None] + (node[at] + beta[at])[:, None, :]
        beta[at - 1] = np.logaddexp(b[:, :, 0], b[:, :, 1])
        pair += np.einsum("c,cij->ij", share[:len(at)], np.exp(alpha[at - 1][:, :, None] + b - total[at][:, None, None]))
    good = np.exp(np.minimum(alpha[:, 1] + beta[:, 1] - total, 0))
    return good, pair, float(z @ share)


def document_logit(good: np.ndarray, weight: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Logit of the length-weighted mean of the marginals of each document."""
    cuts = np.cumsum(length) - length
    mean = np.add.reduceat(good * weight, cuts) / np.add.reduceat(weight, cuts)
    mean = np.clip(mean, 1e-4, 1 - 1e-4)
    return np.log(mean / (1 - mean))


def chains(length: np.ndarray, longest: int = CHAIN) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the chains that documents of ``length`` lines are cut into, and the document of each."""
    count = -(-length // longest)
    doc = np.repeat(np.arange(len(length)), count)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    return np.minimum(longest, length[doc] - place * longest), doc


def objective(w: np.ndarray, x: np.ndarray, y: np.ndarray, length: np.ndarray, ridge: float,
              longest: int = CHAIN) -> tuple[float, np.ndarray]:
    """Mean of -log P(labels) / lines over the documents plus ridge * |w|^2 / 2, and its gradient.

    ``x`` holds the lines' features of all documents, ``y`` the label of each
    document, ``w`` the weights and the four couplings [from, to].
    """
    size, doc = chains(length, longest)
    share, label = 1 / length[doc] / len(length), y[doc]
    score, couple = x @ w[:-4], w[-4:].reshape(2, 2)
    good, pair, z = marginals(score, couple, size, share)
    truth, each = np.repeat(label, size).astype(np.float64), np.repeat(share, size)
    joint = np.zeros((2, 2))
    for v in (0, 1):
        joint[v, v] = ((size - 1) * share)[label == v].sum()
    value = z - (each * truth) @ score - (joint * couple).sum() + ridge * (w @ w) / 2
    return value, np.concatenate([x.T @ ((good - truth) * each), (pair - joint).ravel()]) + ridge * w


def fit_crf(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, steps: int = 120, rate: float = 0.1,
            ridge: float = 1e-3) -> np.ndarray:
    """Parameters of one model: feature means, scales, weights, intercept, couplings (4), curve (2)."""
    length = np.array([len(x) for x, _ in docs])
    x, weight = np.vstack([x for x, _ in docs]), np.concatenate([w for _, w in docs])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1] + 4)
    m, v2 = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        _, g = objective(w, x, y, length, ridge)
        m, v2 = 0.9 * m + 0.1 * g, 0.999 * v2 + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** k)) / (np.sqrt(v2 / (1 - 0.999 ** k)) + 1e-8)
    good, _, _ = marginals(x @ w[:-4], w[-4:].reshape(2, 2), length)
    logit = document_logit(good, weight, length)
    a, b = 1.0, 0.0
    for _ in range(300):                       # the curve from mean marginal to probability
        p = 1 / (1 + np.exp(-(a * logit + b)))
        a, b = a - 0.05 * ((p - y) * logit).mean(), b - 0.2 * (p - y).mean()
    return np.concatenate([mean, scale, w, [max(a, 0.05), b]])


def predict(docs: list[tuple[np.ndarray, np.ndarray]], model: np.ndarray) -> np.ndarray:
    """Probability of good quality of each document under one model."""
    d = 3 * _LOCAL
    length = np.array([len(x) for x, _ in docs])
    x, weight = np.vstack([x for x, _ in docs]), np.concatenate([w for _, w in docs])
    w = model[2 * d:-2]
    good, _, _ = marginals((x - model[:d]) / model[d:2 * d] @ w[:d] + w[d], w[-4:].reshape(2, 2), length)
    return 1 / (1 + np.exp(-(model[-2] * document_logit(good, weight, length) + model[-1])))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", max_docs: int = MAX_DOCS) -> list[np.ndarray]:
    """One model per shard of at most about ``max_docs`` labelled rows in all.

    Rows without an id and null labels teach nothing, neither do ids with both
    labels; rows alike in id and text teach once.  A shard with one label only
    gives no model; without any model (no labels, no documents) every score is 0.5.
    """
    known = one_label(labels, id_col, label_col)
    known = written(known.filter(share(known, max_docs, "id")), "labelled")     # at most about max_docs ids
    sample = written(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
                     .dropDuplicates(["id", "text"]), "labelled-rows")
    sample = (sample.filter(share(sample, max_docs, "id", "text"))
              .select(F.pmod(F.xxhash64("id", "text", F.lit("shard")), F.lit(SHARDS)).alias("shard"), "y", "text"))

    def to_features(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = [local_features(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("shard"), part.column("y"), pa.array([x.tobytes() for x, _ in found], pa.binary()),
                     pa.array([w.tobytes() for _, w in found], pa.binary())], ["shard", "y", "x", "weight"])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf["y"].to_numpy()
        if len(set(y.tolist())) < 2:
            return pd.DataFrame({"w": pd.Series([], dtype=object)})
        lines = [(with_neighbours(np.frombuffer(x, np.float64).reshape(-1, _LOCAL)), np.frombuffer(w, np.float64))
                 for x, w in zip(pdf["x"], pdf["weight"])]
        return pd.DataFrame({"w": [fit_crf(lines, y).tolist()]})

    # texts become line features before the shuffle: a group holds numbers, whatever the length of its lines
    models = (sample.mapInArrow(to_features, "shard long, y int, x binary, weight binary")
              .groupBy("shard").applyInPandas(fit, T.StructType([T.StructField("w", T.ArrayType(T.DoubleType()))])))
    return [np.array(r.w) for r in models.collect()]


def score(docs: DataFrame, models: list[np.ndarray], text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the quality of every whole text in ``out_col`` (0 to 1).

    Null texts count as empty, an empty text as one empty line.  All rows and
    columns stay, a column named ``out_col`` is replaced.
    """
    rest = [c for c in docs.columns if c != out_col]
    plain = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                out = np.full(part.num_rows, 0.5)
                if models:
                    docs = [line_features(t) for t in part.column("text").to_pylist()]
                    out = np.mean([predict(docs, m) for m in models], axis=0)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(out)], ["row", "score"])

    return (plain.mapInArrow(run, plain.select("row").schema.add("score", "double"))
            .select("row.*", F.col("score").alias(out_col)))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``.

    Learns only from rows whose id does not fall in the held-out fold (crc32
    modulo 3 is 1).  Repeated rows, null ids and null texts are scored like any
    other row; columns that clash with the result's are replaced.  Empty
    documents give no rows, empty labels the score 0.5 everywhere.  A very long
    text is scored whole: its lines are one chain, in memory linear in them.
    """
    learn = fold(id_col, 3) != 1
    models = train(docs.filter(learn), labels.filter(learn), id_col, text_col)
    return (score(docs, models, text_col).withColumn("held_out", ~learn)
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))
