"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted, each with a cost.  Documents are packed
largest first into the open sequence that leaves the least room.  Where none
has room, each permitted length that holds the document is tried with the
documents still to come, and the one with the least cost per token filled is
opened.  At the end every sequence shrinks to the shortest length that holds
its contents.

The narrow (id, size) rows are written, counted and dealt in turn to as many
partitions as make one group of about ``FULL`` pieces each, whatever files the
documents lie in; a group holds at most ``GROUP`` pieces, so memory is bounded,
no key can be hot, and unfinished sequences are a few for each group, not for
each file.  A document longer than the longest permitted length is cut into
pieces of that length and a rest; every token is placed exactly once.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.session import written

CAPACITIES = (512, 1024, 2048, 4096)
#: Cost of a sequence besides its length: the work that each sequence brings.
OVERHEAD = 32
#: Pieces that are packed together at most, and how many a partition is meant to get.
GROUP, FULL = 50_000, 45_000


def word_count(text: Column) -> Column:
    """Words of a text (runs of other than \\x20 \\x09-\\x0D) as its token count; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _fill(room: int, sizes: list[int], left: dict[int, int]) -> int:
    """Tokens that still fit into ``room``, largest first, from what is left of each size.

    The sizes looked at differ and all fit, so there are fewer than sqrt(2 * room) of them.
    """
    used = 0
    i = bisect_left(sizes, room - used + 1) - 1
    while i >= 0 and used < room:
        n = min(left[sizes[i]], (room - used) // sizes[i])
        used += n * sizes[i]
        i = min(i - 1, bisect_left(sizes, room - used + 1) - 1)
    return used


def pack(sizes: list[int], capacities=CAPACITIES, overhead: int = OVERHEAD) -> list[tuple[int, int]]:
    """Bin number and offset of each piece; ``sizes`` are at most the largest capacity.

    Pieces of size 0 go to the first bin.  Equal sizes keep their order.
    """
    capacities = sorted(capacities)
    out: list = [None] * len(sizes)
    left: dict[int, int] = {}
    for s in sizes:
        left[s] = left.get(s, 0) + 1
    kinds = sorted(k for k in left if k)
    room: list[tuple[int, int]] = []          # (free, bin), sorted
    filled: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = sizes[i]
        left[s] -= 1
        if s == 0:
            out[i] = (0, 0)
            continue
        if not left[s]:
            kinds.pop()                        # sizes come in falling order
        at = bisect_left(room, (s, -1))
        if at == len(room):
            cost, _, c = min(((c + overhead) / (s + _fill(c - s, kinds, left)), c, c) for c in capacities if c >= s)
            filled.append(0)
            free, b = c, len(filled) - 1
        else:
            free, b = room.pop(at)
        out[i] = (b, filled[b])
        filled[b] += s
        if free > s:
            insort(room, (free - s, b))
    return out


def best_fit(docs: DataFrame, id_col: str = "doc_id", size: Column | None = None, text_col: str = "text",
             capacities=CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """Pieces of all documents with their places.

    ``size`` is the token count of a row (default: words of ``text_col``).
    Returns ``id_col``, ``piece`` (from 0), ``start`` (first token in the
    document), ``n_tokens``, ``bin_id`` (text), ``bin_offset``, ``bin_size``
    (permitted length after shrinking) and ``bin_used``.

    * A null or negative size counts as 0; a document without tokens has one
      piece of 0 tokens, placed at the start of its group's first bin.
    * Repeated rows and null ids are packed as they are.  Other columns are
      ignored, whatever their names.  Empty input: no rows.
    * Inside a group rows come by a hash of id and size, so equal sizes are
      placed alike in every run over the same partitions.
    """
    capacities = sorted(capacities)
    largest = capacities[-1]
    size = word_count(F.col(text_col)) if size is None else size
    rows = written(docs.select(F.col(id_col).alias("id"),
                               F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long").alias("n")), "sizes")
    pieces = rows.agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("n") / largest)))).first()[0] or 0
    rows = rows.repartition(max(1, -(-int(pieces) // FULL))).sortWithinPartitions(F.xxhash64("id", "n"), "id", "n")

    def run(batches):
        part, group = TaskContext.get().partitionId(), 0
        pieces = []                           # (id, piece, start, tokens)

        def out(kind):
            places = pack([p[3] for p in pieces], capacities, overhead)
            used: dict[int, int] = {}
            for p, (b, _) in zip(pieces, places):
                used[b] = used.get(b, 0) + p[3]
            fit = {b: next(c for c in capacities if c >= u) for b, u in used.items()}
            return pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in pieces], kind), *(pa.array([p[k] for p in pieces], pa.int64()) for k in (1, 2, 3)),
                 pa.array([f"{part}-{group}-{b}" for b, _ in places], pa.string()),
                 pa.array([o for _, o in places], pa.int64()), pa.array([fit[b] for b, _ in places], pa.int64()),
                 pa.array([used[b] for b, _ in places], pa.int64())],
                ["id", "piece", "start", "n_tokens", "bin_id", "bin_offset", "bin_size", "bin_used"])

        for batch in batches:
            kind = batch.schema.field("id").type
            for key, n in zip(batch.column("id").to_pylist(), batch.column("n").to_pylist()):
                for k in range(max(1, -(-n // largest))):
                    pieces.append((key, k, k * largest, min(largest, n - k * largest)))
                    if len(pieces) >= GROUP:
                        yield out(kind)
                        pieces, group = [], group + 1
        if pieces:
            yield out(kind)

    schema = rows.select("id").schema
    for c in ("piece", "start", "n_tokens"):
        schema = schema.add(c, "long")
    schema = schema.add("bin_id", "string")
    for c in ("bin_offset", "bin_size", "bin_used"):
        schema = schema.add(c, "long")
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
