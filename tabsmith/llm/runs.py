"""Periodic runs of words by a dictionary of basic factors.

A run is a stretch of words with smallest period ``q``, at least
``max(min_words, min_power * q)`` words long, that no neighbouring word extends
with the same period.

Basic factors are the stretches whose length is a power of two.  The factor of
length ``2 L`` at a position is named by the pair of names of its halves, so
equal factors of one document have equal names.  Successive occurrences of a
factor of length ``L`` that lie within a window of twice that length are at most
``L`` apart, and all of them in such a window form one arithmetic progression:
its difference is a period.  Positions whose successor has the same distance
``p`` and that follow each other are ``p`` such progressions side by side; they
propose one stretch of period ``p``.  With ``L / 2 < p <= L`` every period is
looked for at one length only.  Proposed stretches are extended word by word and
deduplicated.

A run of period ``q`` has at least ``3 q - L + 1 > 0`` such positions, and no
nearer occurrence of the factor hides them: a nearer one would give the run a
smaller period.  So no run is missed.  A factor that occurs once in its document
has no part in a run, and its extensions are not named; ordinary prose ends
after a few lengths.  Words are compared themselves, not by hashes.

Each document is worked on within its own row, many short ones at a time in
numpy; nothing is shuffled and no group is formed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.llm.textops import slices

#: Words of a run at least, and how often the period fits into it at least.
MIN_WORDS, MIN_POWER = 6, 4
RUN = "struct<start:bigint,length:bigint,period:bigint>"
WORD = r"[^\x20\x09-\x0D]+"


def coded(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Words of each text, codes of all words (equal only within one text) and the first word of each text."""
    words = [t.split() for t in texts]         # bytes split at \x20 \x09-\x0D only
    first = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=first[1:])
    codes = np.empty(first[-1], np.int64)
    base = 0
    for w, a in zip(words, first.tolist()):
        seen: dict[bytes, int] = {}
        codes[a:a + len(w)] = [seen.setdefault(x, len(seen)) for x in w]
        codes[a:a + len(w)] += base
        base += len(seen)
    return words, codes, first


def proposals(codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches (start, end, period) proposed by the progressions of all basic factors."""
    n = len(codes)
    end_of = np.repeat(first[1:], np.diff(first))
    pos, name, size = np.arange(n), codes, 1
    found = []
    while len(pos):
        order = np.argsort(name, kind="stable")
        at, by = pos[order], name[order]
        same = by[1:] == by[:-1]
        gap = at[1:] - at[:-1]
        hit = same & (gap <= size) & (2 * gap > size)
        i, p = at[:-1][hit], gap[hit]
        if len(i):
            again = np.argsort(i)
            i, p = i[again], p[again]
            new = np.r_[True, (i[1:] != i[:-1] + 1) | (p[1:] != p[:-1])]
            last = np.r_[np.flatnonzero(new)[1:] - 1, len(i) - 1]
            found.append((i[new], i[last] + size + p[new], p[new]))
        # only factors that occur twice in their document go on
        twice = np.zeros(len(at), bool)
        twice[1:] |= same
        twice[:-1] |= same
        full = np.full(n, -1, np.int64)
        full[at[twice]] = np.cumsum(np.r_[True, ~same])[twice]
        pos = np.sort(at[twice])
        pos = pos[pos + 2 * size <= end_of[pos]]
        pos = pos[full[pos + size] >= 0]
        name = full[pos] * np.int64(len(at) + 1) + full[pos + size]
        size *= 2
    if not found:
        none = np.empty(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def extended(codes: np.ndarray, first: np.ndarray, start: np.ndarray, end: np.ndarray,
             period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches, as far as they go on with their period within their document."""
    doc = np.searchsorted(first, start, "right") - 1
    low, high = first[doc], first[doc + 1]
    start, end = start.copy(), end.copy()
    go = np.arange(len(start))
    while len(go):
        go = go[start[go] > low[go]]
        go = go[codes[start[go] - 1] == codes[start[go] - 1 + period[go]]]
        start[go] -= 1
    go = np.arange(len(start))
    while len(go):
        go = go[end[go] < high[go]]
        go = go[codes[end[go]] == codes[end[go] - period[go]]]
        end[go] += 1
    return start, end


def find_runs(codes: np.ndarray, first: np.ndarray, min_words: int = MIN_WORDS,
              min_power: int = MIN_POWER) -> np.ndarray:
    """All runs of all documents: rows (start, length, period) over the concatenated words, by start, period."""
    start, end, period = proposals(codes, first)
    # a run's own progressions span it whole, so shorter stretches come from no run
    long = end - start >= np.maximum(min_words, min_power * period)
    start, end, period = start[long], end[long], period[long]
    start, end = extended(codes, first, start, end, period)
    rows = np.unique(np.stack([start, period, end], axis=1).reshape(-1, 3), axis=0)
    return np.stack([rows[:, 0], rows[:, 2] - rows[:, 0], rows[:, 1]], axis=1)


def repeated(runs: np.ndarray, n: int) -> np.ndarray:
    """Marks of the words that some run contains after its first period."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, runs[:, 0] + runs[:, 2], 1)
    np.add.at(step, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(step[:-1]) > 0


def periodic_runs(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, min_words: int = MIN_WORDS,
                  min_power: int = MIN_POWER) -> DataFrame:
    """``docs`` with ``runs`` (start, length, period; by start, then period) and ``collapsed`` of every whole text.

    ``collapsed`` has the words that no run contains after its first period,
    joined by one space; a text without runs keeps all its words.  ``keep``
    names the columns that stay (default: all).

    * A null text counts as empty; a text without words has no runs and
      collapses to the empty text, never null.
    * Words are compared by their bytes.  Runs of different periods may overlap
      or share a start; each is reported.
    * Repeated rows and null ids are worked on like any other row, columns named
      ``runs`` or ``collapsed`` are replaced.  Empty input: no rows.
    * Work is n log n in the words of a row; memory is bounded by slices of 1 MB
      of text, or by the longest row.

    ``min_power`` is 3 at least: below that a run may be shorter than the
    progressions that propose it.
    """
    if min_power < 3 or min_words < 1:
        raise ValueError("min_power must be 3 or more and min_words 1 or more")
    rest = [c for c in (docs.columns if keep is None else keep) if c not in ("runs", "collapsed")]
    fields = [F.col(f"`{c}`") for c in rest] or [F.lit(0).alias("none")]
    plain = docs.select(F.struct(*fields).alias("row"), F.col(f"`{text_col}`").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words, codes, first = coded([(t or "").encode() for t in part.column("text").to_pylist()])
                found = find_runs(codes, first, min_words, min_power)
                drop = repeated(found, len(codes))
                cut = np.searchsorted(found[:, 0], first)
                text = []
                for w, a, b, i, j in zip(words, first[:-1], first[1:], cut[:-1], cut[1:]):
                    if j > i:
                        w = [x for x, gone in zip(w, drop[a:b].tolist()) if not gone]
                    text.append(b" ".join(w).decode())
                shift = np.repeat(first[:-1], np.diff(cut))
                values = pa.StructArray.from_arrays(
                    [pa.array(found[:, 0] - shift), pa.array(found[:, 1]), pa.array(found[:, 2])],
                    fields=list(kind.value_type))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), values, type=kind),
                     pa.array(text, pa.string())], ["row", "runs", "collapsed"])

    out = plain.mapInArrow(run, plain.select("row").schema.add("runs", T.ArrayType(T.StructType(
        [T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))).add("collapsed", "string"))
    return out.select(*(F.col(f"row.`{c}`") for c in rest), "runs", "collapsed")


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period (ties: smallest start, then period); null without runs.

    Two ratios are compared by whole quotients, then by remainders over their
    periods in whole numbers, so no rounding decides.
    """
    def better(a: Column, b: Column) -> Column:
        # a and b come by start, then period: b wins only by a greater ratio
        return F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)

    return F.aggregate(runs, F.lit(None).cast(RUN), better)


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with planted repetitions: every tenth document (by crc32 of its id) repeats a stretch of its own words.

    With h the crc32 of the decimal id, g = floor(h / 10) and n words, a
    document with h % 10 = 0 keeps its words before a = g % n and repeats the
    p = 1 + floor((n - a) / (3 + g % 8)) words from there on to its end.  Other
    documents, texts without words and rows with a null id stay as they are.
    """
    h = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
    g = F.floor(h / 10)
    chosen = (h % 10 == 0) & F.col(f"`{text_col}`").rlike(WORD)

    def told(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = F.sequence(F.lit(0), (n - 1).cast("int"))
        return F.array_join(F.transform(at, lambda i: F.get(
            words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    # a one-element transform binds the words once, as a let-expression
    words = F.array(F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(WORD), F.lit(0)))
    return docs.withColumn(text_col, F.when(chosen, F.get(F.transform(words, told), F.lit(0))).otherwise(F.col(f"`{text_col}`")))
