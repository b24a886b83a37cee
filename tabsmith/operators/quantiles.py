"""Exact linear-interpolated quantiles of any number of columns in three scans.

1. One aggregate gives every column's count and a mergeable KLL sketch, whose
   quantiles just below and above each wanted rank are the cut points.  Other
   statistics (moments, extremes, missing counts) ride along.
2. One aggregate counts every ``(column, bucket)``: rows, smallest and largest value of
   every bucket between neighbouring cut points.  The buckets cover the whole
   line, so each wanted rank falls into exactly one, whatever the sketch's error;
   a bucket of one value (a value that a third of the rows hold, say) answers at
   once.
3. The values of the remaining buckets, a thin slice of the rows, are counted and
   ranked; a slice beyond one task's size is ranked over ranges.

The driver sees a few numbers per column and rank.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tabsmith.functions import column, number
from tabsmith.operators.rank import running_sum

#: Size parameter of the sketches: about 0.1 % of rank error, 100 KB a column.
SKETCH_K = 4096
#: Distance of the cut points from a wanted rank, as a share of the rows.
MARGIN = 0.002


def _ranks(n: int, probs: Sequence[float]) -> dict[float, tuple[int, int]]:
    """The two ranks (from 0) that each probability lies between."""
    out = {}
    for p in probs:
        h = (n - 1) * p
        out[p] = (math.floor(h), min(math.ceil(h), n - 1))
    return out


def quantiles_with(df: DataFrame, cols: Sequence[str], probs: Sequence[float], extra: Sequence[Column] = (),
                   sketch_k: int = SKETCH_K, margin: float = MARGIN) -> tuple[dict[str, dict[float, float | None]], Row]:
    """``({column: {probability: value}}, row of the extra aggregates)``.

    NaN and NULL are left out, infinities are values, -0.0 equals 0.0; a column
    without values has None everywhere."""
    cols, probs = list(cols), [float(p) for p in probs]
    wide = sorted({min(1.0, max(0.0, p + s)) for p in probs for s in (-margin, margin)})
    at = F.array(*[F.lit(r) for r in wide])
    xs = [number(c) + F.lit(0.0) for c in cols]              # -0.0 + 0.0 is 0.0
    first = df.agg(
        *extra, *[F.count(x).alias(f"__n{i}") for i, x in enumerate(xs)],
        *[F.when(F.count(x) > 0, F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(x, F.lit(sketch_k)), at))
          .alias(f"__q{i}") for i, x in enumerate(xs)]).first()
    found: dict[int, dict[int, float]] = {i: {} for i in range(len(cols))}
    wanted = {i: _ranks(first[f"__n{i}"], probs) if first[f"__n{i}"] else {} for i in range(len(cols))}
    cuts = {i: sorted(set(first[f"__q{i}"])) for i in range(len(cols)) if wanted[i]}

    def bucket(i: int) -> Column:
        total = F.lit(0)
        for cut in cuts[i]:
            total = total + (xs[i] >= F.lit(cut)).cast("int")
        return total

    live = list(cuts)
    if live:
        # a generator works on interpreted rows: the counts need none, and the slices are picked inside their arrays
        marked = df.select(*[e for i in live for e in (xs[i].alias(f"x{i}"), bucket(i).alias(f"b{i}"))])
        inside = {(i, b): F.when(F.col(f"b{i}") == b, F.col(f"x{i}")) for i in live for b in range(len(cuts[i]) + 1)}
        counted = marked.agg(*[f(x).alias(f"{name}{i}_{b}") for (i, b), x in inside.items()
                               for name, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
        before, open_ = {i: 0 for i in live}, []
        for i, b in inside:                                                  # columns x cut points
            n, lo, hi = (counted[f"{name}{i}_{b}"] for name in ("n", "lo", "hi"))
            ranks = sorted({k for pair in wanted[i].values() for k in pair if before[i] <= k < before[i] + n})
            if ranks and lo == hi:
                found[i].update((k, lo) for k in ranks)
            elif ranks:
                open_.append((i, b, before[i], n, ranks))
            before[i] += n
        if open_:
            width = len(wide) + 1
            slots = [i * width + b for i, b, *_ in open_]
            rows = df.select(F.array(*[F.struct(F.lit(i).alias("i"), bucket(i).alias("b"), xs[i].alias("x"))
                                       for i in sorted({o[0] for o in open_})]).alias("all"))
            long = rows.select(F.inline(F.filter(
                "all", lambda s: s["x"].isNotNull() & (s["i"] * width + s["b"]).isin(slots))))
            slices = long.groupBy("i", "b", "x").agg(F.count(F.lit(1)).alias("n"))
            ranked = running_sum(slices, ["x"], ["i", "b"], F.col("n"), "upto", rows=sum(n for _, _, _, n, _ in open_))
            picks = df.sparkSession.createDataFrame(
                [(i, b, k - before_) for i, b, before_, _, ranks in open_ for k in ranks], "i int, b int, k long")
            hit = (F.col("upto") > F.col("k")) & (F.col("upto") - F.col("n") <= F.col("k"))
            start = {(i, b): before_ for i, b, before_, _, _ in open_}
            for r in ranked.join(F.broadcast(picks), ["i", "b"]).where(hit).select("i", "b", "k", "x").collect():
                found[r.i][r.k + start[(r.i, r.b)]] = r.x
    out = {}
    for i, c in enumerate(cols):
        out[c] = dict.fromkeys(probs)
        for p, (lo, hi) in wanted[i].items():
            a, b, h = found[i][lo], found[i][hi], (first[f"__n{i}"] - 1) * p
            out[c][p] = a if a == b else (hi - h) * a + (h - lo) * b
    return out, first


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], **kw) -> dict[str, dict[float, float | None]]:
    """Exact quantiles of several columns as a small dict (driver-side report)."""
    return quantiles_with(df, cols, probs, **kw)[0]


def quantile_row(df: DataFrame, cols: Sequence[str], probs: Sequence[float], **kw) -> DataFrame:
    """One-row frame: for each column an ``array<double>`` of exact quantiles."""
    got = quantiles(df, cols, probs, **kw)
    return df.sparkSession.range(1).select(*[
        F.array(*[F.lit(got[c][float(p)]).cast("double") for p in probs]).alias(c) for c in cols])
