"""Whitening of integer vectors through a triangular factor and a qd solver.

1. Every task folds its vectors block by block into one triangular factor: a
   block is centred on its own mean before the QR step, and the difference of
   two means enters as one more row, so the factors of centred parts merge into
   the factor ``R`` of all centred vectors.  Factors of the tasks are merged a
   few at a time, level by level, until one is left; only that one (dimensions
   squared) reaches the driver.
2. Householder reflections bring ``R`` to upper bidiagonal form ``B``.
3. The differential qd algorithm with shifts finds the squared singular values
   of ``B`` to high relative accuracy.
4. Twisted factorisations of ``B'B - s`` give the directions: the stationary and
   the progressive factorisation meet at the row with the least residual.
   Values that lie close together share a subspace; their vectors are iterated
   against each other until they are orthogonal.

Nothing is squared before step 3, so small directions keep their accuracy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.session import written

#: Bytes of triangular factors that one task merges at once, and factors at most.
MERGE_BYTES, MERGE = 64 << 20, 64
#: Vectors of one block.
BLOCK = 4096
#: Entries beyond this size count as this size.
LARGEST = float(1 << 52)
_EPS = float(np.finfo(np.float64).eps)
#: Values closer than this share of themselves are treated as one subspace.
CLUSTER = 1e-3


# ---------------------------------------------------------------- blockwise QR

@dataclass
class Part:
    """Count, integer sums (exact) and the triangular factor of the centred vectors of a part."""
    n: int
    sums: list
    r: np.ndarray


def fold(part: Part | None, n: int, sums: list, rows: np.ndarray) -> Part:
    """``part`` with a centred block: ``rows`` are its vectors, or its factor, centred on its own mean."""
    if part is None:
        return Part(n, sums, np.linalg.qr(rows, mode="r"))
    both = part.n + n
    # n_b * S_a - n_a * S_b in whole numbers: the difference of the means, times both counts
    gap = np.array([float(n * a - part.n * b) for a, b in zip(part.sums, sums)])
    between = gap / np.sqrt(float(part.n) * n * both)
    return Part(both, [a + b for a, b in zip(part.sums, sums)],
                np.linalg.qr(np.vstack([part.r, rows, between[None, :]]), mode="r"))


def fold_block(part: Part | None, x: np.ndarray) -> Part:
    """``part`` with a block of integer vectors."""
    n = len(x)
    base = x[0]
    moved = x - base                          # small whole numbers, whatever the offset
    sums = [int(s) for s in moved.sum(axis=0, dtype=object)] if np.abs(moved).max(initial=0) > 1 << 40 else \
        moved.sum(axis=0).tolist()
    centred = moved - np.array(sums, np.float64) / n
    return fold(part, n, [int(b) * n + int(s) for b, s in zip(base, sums)], centred)


def _row(part: Part, at: int) -> dict:
    return {"at": at, "n": part.n, "sums": [str(s) for s in part.sums], "r": part.r.tobytes(), "rows": len(part.r)}


_SCHEMA = "at long, n long, sums array<string>, r binary, rows int"


def _merged(rows: Iterator, at: int) -> dict | None:
    part = None
    for n, sums, r, m in rows:
        part = fold(part, int(n), [int(s) for s in sums], np.frombuffer(r, np.float64).reshape(m, -1))
    return None if part is None else _row(part, at)


def triangular(vectors: DataFrame, column: str, dims: int) -> Part | None:
    """Count, sums and triangular factor of all vectors of ``column`` (array of long); None without rows."""
    def blocks(batches):
        part = None
        for batch in batches:
            flat = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            for a in range(0, len(flat), BLOCK):
                part = fold_block(part, flat[a:a + BLOCK])
        if part is not None:
            yield pa.RecordBatch.from_pylist([_row(part, TaskContext.get().partitionId())], schema=pa.schema(
                [("at", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("r", pa.binary()),
                 ("rows", pa.int32())]))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")           # one order of the merges, so reruns agree
        return pd.DataFrame([_merged(zip(pdf["n"], pdf["sums"], pdf["r"], pdf["rows"]), int(pdf["to"].iloc[0]))])

    few = int(max(2, min(MERGE, MERGE_BYTES // (8 * dims * dims))))
    parts = written(vectors.select(column).mapInArrow(blocks, _SCHEMA), "factors")
    level = parts.agg(F.count("*").alias("n"), F.max("at").alias("last")).first()
    left = 0 if level.n == 0 else level.last + 1
    while left > 1:
        parts = written(parts.withColumn("to", F.floor(F.col("at") / few)).groupBy("to").applyInPandas(merge, _SCHEMA),
                        "factors")
        left = -(-left // few)
    row = parts.first()
    if row is None:
        return None
    return Part(row.n, [int(s) for s in row.sums], np.frombuffer(row.r, np.float64).reshape(row.rows, -1))


# ------------------------------------------------------------ bidiagonal form

def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right basis ``v`` with ``u' r v`` upper bidiagonal."""
    d = r.shape[1]
    a = np.zeros((max(len(r), d), d))
    a[:len(r)] = r
    v = np.eye(d)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        size = np.abs(x).max(initial=0.0)
        if not size:
            return x, 0.0
        w = x / size
        w[0] += np.copysign(np.linalg.norm(w), w[0])
        return w, 2 / (w @ w)

    for k in range(d):
        w, t = reflector(a[k:, k].copy())
        a[k:, k:] -= np.outer(t * w, w @ a[k:, k:])
        if k + 2 < d:
            w, t = reflector(a[k, k + 1:].copy())
            a[k:, k + 1:] -= np.outer(a[k:, k + 1:] @ w, t * w)
            v[:, k + 1:] -= np.outer(v[:, k + 1:] @ w, t * w)
    return np.diag(a)[:d].copy(), np.diag(a, 1)[:d - 1].copy(), v


# ------------------------------------------------------------------------ dqds

def _sweep(q: list, e: list, lo: int, hi: int, shift: float) -> tuple[list, list, float] | None:
    """One differential qd step with a shift on rows lo..hi; None if the shift passes the least value."""
    nq, ne = [], []
    d = q[lo] - shift
    least = d
    for i in range(lo, hi):
        if d < 0:
            return None
        top = d + e[i]
        if top == 0.0:                        # a zero row: the value moves down unchanged
            nq.append(0.0)
            ne.append(0.0)
            d = q[i + 1] - shift
        else:
            t = q[i + 1] / top
            nq.append(top)
            ne.append(e[i] * t)
            d = d * t - shift
        least = min(least, d)
    if d < 0:
        return None
    nq.append(d)
    return nq, ne, least


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, falling, to high relative accuracy.

    Every step keeps all values non-negative: a shift that passes the least
    value is taken back and made smaller.  Neighbours are cut apart where the
    off-diagonal entry is below the rounding of the values beside it.
    """
    q, e = (diagonal.astype(float) ** 2).tolist(), (upper.astype(float) ** 2).tolist()
    tol = (10 * _EPS) ** 2
    out: list[float] = []
    # parts (lo, hi, shifted so far) that are still joined by off-diagonal entries
    todo = [(0, len(q) - 1, 0.0)] if q else []
    while todo:
        lo, hi, moved = todo.pop()
        if lo == hi:
            out.append(moved + q[lo])
            continue
        cut = next((i for i in range(hi - 1, lo - 1, -1) if e[i] <= tol * (moved + min(q[i], q[i + 1])) or e[i] == 0.0), None)
        if cut is not None:
            todo += [(lo, cut, moved), (cut + 1, hi, moved)]
            continue
        if q[hi] > 1.5 * q[lo]:               # the large end on top: the small values come out at the bottom
            q[lo:hi + 1], e[lo:hi] = q[lo:hi + 1][::-1], e[lo:hi][::-1]
        # the lesser value of the last two rows bounds the least value from above
        s, t, x = q[hi - 1], q[hi], e[hi - 1]
        half = (s + t + x) / 2
        root = half + np.sqrt(max(0.0, half * half - s * t))
        guess = min(s * t / root if root else 0.0, min(q[lo:hi + 1]))
        new = None
        for share in (1 - 1e-9, 0.95, 0.5, 0.1):
            new = _sweep(q, e, lo, hi, share * guess) if guess else None
            if new is not None:
                moved += share * guess
                break
        if new is None:
            new = _sweep(q, e, lo, hi, 0.0)
        q[lo:hi + 1], e[lo:hi] = new[0], new[1]
        todo.append((lo, hi, moved))
    return np.array(sorted(out, reverse=True))


# ---------------------------------------------------------- twisted directions

class Twisted:
    """Both factorisations of B'B - value, met at the row ``r`` with the least residual."""

    def __init__(self, q: np.ndarray, ab: np.ndarray, b2: np.ndarray, value: float):
        n = len(q)
        self.tiny = _EPS * _EPS * max(value, float(q.max()), 1e-300)
        s, p = np.empty(n), np.empty(n)
        self.top, self.low = np.empty(n), np.empty(n)
        self.down, self.up = np.empty(max(0, n - 1)), np.empty(max(0, n - 1))
        s[0] = -value
        for i in range(n - 1):                # stationary: from the top
            d = self.top[i] = self._safe(s[i] + q[i])
            self.down[i] = ab[i] / d
            s[i + 1] = b2[i] * (s[i] / d) - value
        p[-1] = q[-1] - value
        for i in range(n - 2, -1, -1):        # progressive: from the bottom
            d = self.low[i + 1] = self._safe(b2[i] + p[i + 1])
            self.up[i] = ab[i] / d
            p[i] = p[i + 1] * (q[i] / d) - value
        gamma = s + p + value
        self.r = int(np.argmin(np.abs(gamma)))
        self.gamma = self._safe(gamma[self.r])

    def _safe(self, d: float) -> float:
        return d if abs(d) > self.tiny else -self.tiny

    def vector(self) -> np.ndarray:
        """The solution for the unit vector at the twist, of length 1."""
        f = np.zeros(len(self.top))
        f[self.r] = 1.0
        return self._back(f)

    def _back(self, w: np.ndarray) -> np.ndarray:
        z = w.copy()
        for i in range(self.r - 1, -1, -1):
            z[i] -= self.down[i] * z[i + 1]
        for i in range(self.r, len(z) - 1):
            z[i + 1] -= self.up[i] * z[i]
        return z / np.linalg.norm(z)

    def step(self, f: np.ndarray) -> np.ndarray:
        """One step of inverse iteration from ``f``."""
        w, r, n = f.copy(), self.r, len(f)
        for i in range(1, r + 1):
            w[i] -= self.down[i - 1] * w[i - 1]
        for i in range(n - 2, r - 1, -1):
            w[i] -= self.up[i] * w[i + 1]
        w[:r] /= self.top[:r]
        w[r] /= self.gamma
        w[r + 1:] /= self.low[r + 1:]
        return self._back(w / np.abs(w).max())


def directions(diagonal: np.ndarray, upper: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Orthonormal right singular vectors (columns) of the bidiagonal matrix for falling squared singular values."""
    n = len(diagonal)
    out = np.zeros((n, len(values)))
    q, ab, b2 = diagonal ** 2, diagonal[:-1] * upper, upper ** 2
    # entries below the rounding of both neighbours make blocks; a vector lives in one block only
    least = np.minimum(np.abs(diagonal[:-1]), np.abs(diagonal[1:]))
    edge = np.r_[0, np.flatnonzero(np.abs(upper) <= _EPS * least) + 1, n]
    owner = sorted(((x, a, b) for a, b in zip(edge[:-1], edge[1:]) for x in dqds(diagonal[a:b], upper[a:b - 1])),
                   key=lambda t: (-t[0], t[1]))[:len(values)]
    group: list[int] = []
    for k, (x, a, b) in enumerate(owner):
        if not group or owner[group[-1]][0] - x > CLUSTER * owner[group[-1]][0]:
            group = []
        mine = [j for j in group if owner[j][1] == a]
        basis = out[a:b, mine]
        pair = Twisted(q[a:b], ab[a:b - 1], b2[a:b - 1], x)
        z = pair.vector()
        if mine:
            # a shared subspace: what the vectors before leave of the start (or a start of its own), iterated
            if np.linalg.norm(z - basis @ (basis.T @ z)) < 0.1:
                z = np.random.default_rng(k).normal(size=b - a)
            for _ in range(4):
                z -= basis @ (basis.T @ z)
                z = pair.step(z / np.linalg.norm(z))
            for _ in range(2):
                z -= basis @ (basis.T @ z)
                z /= np.linalg.norm(z)
        out[a:b, k] = z
        group.append(k)
    return out


# ------------------------------------------------------------------- whitening

@dataclass
class Whitening:
    """A fitted whitening: ``n`` vectors with sums ``sums``; ``values`` fall, ``axes`` has a column for each."""
    n: int
    sums: list
    axes: np.ndarray
    values: np.ndarray
    trace: float


def solve(part: Part, k: int) -> Whitening:
    """The first ``k`` directions of a triangular factor; directions without variance are left out."""
    diagonal, upper, v = bidiagonal(part.r)
    squares = dqds(diagonal, upper)
    # what rounding leaves of a direction without variance
    floor = squares[0] * (len(diagonal) * 8 * _EPS) ** 2 if len(squares) else 0.0
    squares = squares[:k][squares[:k] > floor]
    return Whitening(part.n, part.sums, v @ directions(diagonal, upper, squares), squares / part.n,
                     float((part.r ** 2).sum()) / part.n)


def whole(vector: Column, scale: float = 64, offset: int = 1_000_000) -> Column:
    """Whole numbers floor(scale * entry) + offset of a vector; null for vectors with null or non-finite entries."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = F.transform(v, lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(LARGEST)), F.lit(-LARGEST))) + F.lit(offset))
    return F.when(vector.isNotNull() & fine, kept)


def _project(x: np.ndarray, model: Whitening) -> np.ndarray:
    """Whitened coordinates: the difference from the exact mean is taken in whole numbers first."""
    base = [s // model.n for s in model.sums]
    rest = np.array([float(s - b * model.n) for s, b in zip(model.sums, base)]) / model.n
    return ((x - np.array(base, np.int64)) - rest) @ model.axes / np.sqrt(model.values)


def _deviation(x: np.ndarray, model: Whitening) -> list[int]:
    """Exact sums over the dimensions of (n * x - S) squared."""
    base = [s // model.n for s in model.sums]
    rest = [s - b * model.n for s, b in zip(model.sums, base)]
    moved = x - np.array(base, np.int64)
    bound = (int(np.abs(moved).max(initial=0)) + 1) * model.n
    if bound * bound * max(1, x.shape[1]) < 1 << 62:
        d = model.n * moved - np.array(rest, np.int64)
        return (d * d).sum(axis=1).tolist()
    d = moved.astype(object) * model.n - np.array(rest, dtype=object)
    return (d * d).sum(axis=1).tolist()


def whiten(vectors: DataFrame, id_col: str, vector_col: str, k: int = 16, scale: float = 64,
           offset: int = 1_000_000) -> DataFrame:
    """One row per usable vector: ``id_col``, ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``.

    Entries become whole numbers x = floor(scale * c) + offset.  Each distinct x
    vector counts once: ``n`` of them with sums S per dimension.  ``whitened``
    and ``explained`` are arrays over at most ``k`` components by falling
    variance: coordinates with unit variance, and shares of the whole variance.
    ``deviation`` is the exact sum over the dimensions of (n x - S) squared, as
    decimal(38,0) (null beyond).  ``identity_error`` is measured on the whitened
    distinct vectors: the largest absolute entry of their covariance less the
    identity.

    * Rows whose vector is null, empty or holds null or non-finite entries give
      no row.  Entries beyond 2**52 after scaling count as 2**52.
    * If lengths differ, the most frequent length (ties: the longest) is fitted
      and the other rows give no row.
    * Repeated rows and null ids each give a row; equal vectors have equal
      results.  Other columns are ignored, whatever their names.
    * Directions without variance are left out, so one distinct vector gives
      empty arrays (error 0).  Equal variances: any orthonormal directions of
      their subspace, the same for all rows.  Empty input: no rows.
    """
    spark = vectors.sparkSession
    # cast without a name that could clash
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), whole(F.col(f"`{vector_col}`"), scale, offset).alias("x"))
    rows = rows.filter(F.col("x").isNotNull() & (F.size("x") > 0))
    schema = ("n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double")
    kind = rows.schema["id"].dataType
    usual = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if usual is None:
        return spark.createDataFrame([], schema).select(F.lit(None).cast(kind).alias(id_col), "*")
    dims = usual.dims
    rows = rows.filter(F.size("x") == dims)
    distinct = written(rows.select("x").distinct(), "distinct")
    model = solve(triangular(distinct, "x", dims), k)
    width = len(model.values)
    error = 0.0
    if width:
        # whitened coordinates as whole numbers of 2**-40, so that sums and means stay exact
        def project(batches):
            for batch in batches:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(
                    np.rint(_project(x, model) * float(1 << 40)).astype(np.int64).ravel(), width).cast(
                        pa.list_(pa.int64()))], ["w"])

        check = triangular(distinct.mapInArrow(project, "w array<long>"), "w", width)
        r = check.r / float(1 << 40)
        error = float(np.abs(r.T @ r / check.n - np.eye(width)).max())
    shares = (model.values / model.trace).tolist() if width else []

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            w = _project(x, model)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.full(len(x), model.n)),
                 pa.array([str(d) for d in _deviation(x, model)], pa.string()),
                 pa.ListArray.from_arrays(np.arange(0, (len(x) + 1) * width, width or 1, dtype=np.int32)[:len(x) + 1]
                                          if width else np.zeros(len(x) + 1, np.int32), pa.array(w.ravel()))],
                ["id", "n", "deviation", "whitened"])

    out = rows.mapInArrow(run, rows.select("id").schema.add("n", "long").add("deviation", "string")
                          .add("whitened", T.ArrayType(T.DoubleType())))
    return out.select(F.col("id").alias(id_col), "n", F.expr("try_cast(deviation AS decimal(38,0))").alias("deviation"),
                      "whitened", F.lit(shares).cast("array<double>").alias("explained"),
                      F.lit(error).alias("identity_error"))
