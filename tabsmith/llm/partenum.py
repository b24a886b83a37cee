"""N-gram Jaccard join with PartEnum signatures.

Two documents link when the Jaccard similarity of their shingle sets reaches
``percent`` / 100.  Sets are put in size bands whose widest ratio is
100 / ``percent``, so linked sets lie in the same or in adjacent bands.  For a
pair of adjacent bands the similarity bounds the symmetric difference by some
``k``.  The hash domain is dealt into ``G`` groups of ``n2`` parts; at least one
group then holds at most ``k2`` of the differing shingles, so the two sets
agree on some ``n2 - k2`` of its parts.  Each set emits one signature for every
such subset of parts, and linked sets share at least one signature.

Subsets without any shingle would put unrelated sets together.  ``spare`` extra
groups leave that many more agreeing groups, so a set with at most ``spare``
groups that have an empty subset never needs those signatures; only the rare
set with more of them emits all.  How many groups have one follows from the
shingles a part holds, so ``spare`` does too: more where sets are cut finer.

Candidates are checked exactly and without all pairs of a group:

1. copies share one set id, so they count once;
2. every bucket (one signature) compares its members with one pivot;
3. components of those links are taken; a bucket whose other members now lie in
   one component needs nothing more;
4. in the other buckets the members outside the largest component are compared
   with all members of other components, in blocks: every pair of blocks is a
   join key of its own, so no key has more rows than two blocks, and a cluster
   is not compared with itself for the sake of an outsider.  The join condition
   holds the size ratio, a 1024-bit parity sketch whose distance never exceeds
   the true difference, and the eight open buckets of each side before the
   shared one, so only near pairs leave the join, and not once for each bucket
   they share (256 bits do for the links to a pivot, which are few);
5. a 2048-bit sketch settles most remaining pairs, the texts decide the rest:
   first each set against its smallest near partner, then the pairs whose ends
   still lie in different components.  Texts are dealt into blocks and meet in
   pairs of blocks, so a text is moved and read once for each pair of blocks,
   however many pairs it is in.  (Sketches cannot part long texts, so a few
   thousand of those make most of these pairs.)

Signatures are made and moved once: a task packs some hundred thousand of them, sorted
and cut into ranges, so a range is a few rows of bytes, and the task of a range
keeps only the signatures of two sets or more.  A signature that all sets share
costs its task twelve bytes a set.  Every other step is a shuffle by signature or
set id over narrow rows.  Texts travel only for the sets of pairs that the
sketches let pass.  A written table is deleted when the one made of it is written.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, exp

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.llm.textops import _M1, mix, shingle_sets, signed, slices
from tabsmith.session import release, small_batches, written

#: A side of a join is broadcast only if it has at most so many narrow rows.
BROADCAST_ROWS = 200_000
#: Members of one bucket that are compared with as many others in one task.
BLOCK = 4096
#: A pair of one bucket is passed over if both sides have one of so many earlier open buckets in common.
BEFORE = 8
#: Above so many members the open buckets are compared in rounds, each with a share of the buckets: the rows
#: that a round brings together, and the disk they take, are that share.
ROUND_ROWS, ROUNDS = 1_000_000, 4
#: Ids of sets that a task remembers to emit copies once; beyond it starts anew, ``distinct`` settles the rest.
REMEMBERED = 200_000
#: Signatures that a task packs at once; a range has about as many as that number of shingles gives, and there
#: are at least and at most so many ranges.
PACKED, RANGE_SHINGLES, RANGES = 1 << 18, 1 << 21, (1024, 1 << 16)
#: Rows of one batch of signatures.
BATCH = 1 << 16
#: Bytes of text that a task makes sets of at once, and that it unpacks at once: the kernels take some 50 times that.
SLICE, UNPACKED = 1 << 18, 1 << 18
#: Bits of the sketch that pairs are checked with before their texts, and of the one made of the texts themselves.
WIDE_BITS, TEXT_BITS = 2048, 1 << 14
#: A block of texts that a task compares with another: about so many shingles, and so many sets, at most.
BLOCK_SHINGLES, BLOCK_SETS = 1 << 21, 2048
_SKETCH = ["s0", "s1", "s2", "s3"]
#: The wide sketch folded to 1024 bits, in words.
_FOLDED = [f"f{i}" for i in range(16)]


def band_edges(percent: int, largest: int = 1 << 40) -> list[int]:
    """Smallest set size of each band; a band ends where the size ratio would pass 100 / percent."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(edges[-1] * 100 // percent + 1)
    return edges


def instance_params(percent: int, k2: int, n2: int = 2) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Band edges, and (k, groups, spare) of each instance.

    Instance j joins sets of bands j-1 and j, and also those of band j-1 among
    themselves, so the sizes of a pair add up to at most r[j-1] + r[j].
    """
    edges = band_edges(percent)
    out = []
    for j in range(len(edges) - 1):
        below = edges[j] - 1
        k = (below + edges[j + 1] - 1) * (100 - percent) // (100 + percent)
        need = k // (k2 + 1) + 1
        # groups with an empty subset in the smallest sets, whose parts hold the fewest shingles
        held = edges[max(j - 1, 0)] / (need * n2)
        empty = min(1.0, comb(n2, k2) * exp(-held * (n2 - k2)))
        spare = 1 + min(int(1.5 * need * empty), need // 6)
        out.append((k, need + spare, spare))
    return np.array(edges), out


def signatures(s: np.ndarray, edges: np.ndarray, params, n2: int, subsets) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of one shingle set (sorted distinct 64-bit hashes) in the order of
    (instance, group, subset), and which of them the set emits."""
    band = int(np.searchsorted(edges, len(s), "right")) - 1
    high, mixed = s >> np.uint64(32), mix(s ^ _M1)
    out, emit = [], []
    for inst in (band, band + 1):
        k, groups, spare = params[inst]
        if k == 0:
            continue                     # sets that differ cannot link
        parts = groups * n2
        slot = ((high * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
        total = np.zeros(parts, np.uint64)
        np.add.at(total, slot, mixed)
        filled = (np.bincount(slot, minlength=parts) > 0).reshape(groups, n2)
        total = total.reshape(groups, n2)
        sums = np.stack([total[:, c].sum(axis=1, dtype=np.uint64) for c in subsets], axis=1)
        some = np.stack([filled[:, c].any(axis=1) for c in subsets], axis=1)
        place = np.arange(sums.size, dtype=np.uint64).reshape(sums.shape)
        sig = mix(sums + mix(place + (np.uint64(inst) << np.uint64(40)) + _M1))
        out.append(sig.ravel())
        emit.append((some | ((~some.all(axis=1)).sum() > spare)).ravel())
    return (np.concatenate(out), np.concatenate(emit)) if out else (np.empty(0, np.uint64), np.empty(0, bool))


def set_id(s: np.ndarray) -> np.uint64:
    return mix(np.sum(mix(s), dtype=np.uint64, keepdims=True) + np.uint64(len(s)))[0]


def sketch(s: np.ndarray, bits: int = 256) -> np.ndarray:
    """Parities of the counts of shingles by hash; two sketches differ in at most as many bits as the sets."""
    odd = (np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def pack_signatures(sig: np.ndarray, sid: np.ndarray, ranges: int) -> pa.RecordBatch:
    """``(part, sig, sid)``: one row for each of the ``ranges`` of signatures, with 32 bits of each
    signature inside its range and the set ids, as bytes.  What the lost bits put together is told apart later."""
    place = (sig >> np.uint64(16)) * np.uint64(ranges)
    order = np.argsort(place)
    place = place[order]
    part = (place >> np.uint64(48)).astype(np.int32)
    low = ((place >> np.uint64(16)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    sid = sid[order]
    cut = np.flatnonzero(np.diff(part, prepend=-1))
    ends = np.append(cut[1:], len(part))
    return pa.RecordBatch.from_arrays(
        [pa.array(part[cut]), pa.array([low[i:j].tobytes() for i, j in zip(cut, ends)], pa.binary()),
         pa.array([sid[i:j].tobytes() for i, j in zip(cut, ends)], pa.binary())], ["part", "sig", "sid"])


def shared_signatures(part: int, low: np.ndarray, sid: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``(sig, sid, piv)`` of the signatures of one range that several sets have; ``piv`` is the smallest of them."""
    order = np.argsort(low)
    low, sid = low[order], sid[order]
    same = low[1:] == low[:-1]
    several = np.append(same, False) | np.append(False, same)
    low, sid = low[several], sid[several]
    order = np.lexsort((sid, low))
    low, sid = low[order], sid[order]
    first = np.append(True, low[1:] != low[:-1])[:len(low)]
    new = first | np.append(True, sid[1:] != sid[:-1])[:len(low)]      # copies of other tasks emitted it too
    low, sid, first = low[new], sid[new], first[new]
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, len(low)))
    piv = np.repeat(sid[start], size)
    many = np.repeat(size > 1, size)
    low, sid, piv = low[many], sid[many], piv[many]
    sig = low.astype(np.int64) | (np.int64(part) << np.int64(32))
    for at in range(0, len(sig), BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(x[at:at + BATCH]) for x in (sig, sid, piv)], ["sig", "sid", "piv"])


def pack_texts(column: pa.Array) -> pa.Array:
    """Texts as zstd frames: candidates' texts are shuffled, so they travel small."""
    plan = zstandard.ZstdCompressor(level=6)
    return pa.array([plan.compress((t or "").encode("utf-8")) for t in column.to_pylist()], pa.binary())


def unpacked(batch: pa.RecordBatch, column: str):
    """``(row slice, texts)`` in pieces of about ``UNPACKED`` bytes of text, however small they were packed."""
    plan = zstandard.ZstdDecompressor()
    texts, size, start = [], 0, 0
    for i, t in enumerate(batch.column(column).to_pylist(), 1):
        texts.append(plan.decompress(t))
        size += len(texts[-1])
        if size >= UNPACKED or i == batch.num_rows:
            yield batch.slice(start, i - start), pa.array([x.decode("utf-8") for x in texts], pa.large_string())
            texts, size, start = [], 0, i


def fresh(seen: set, ids: list) -> list[int]:
    """Places of the ids that were not seen before; ``seen`` stays bounded."""
    if len(seen) > REMEMBERED:
        seen.clear()
    return [i for i, x in enumerate(ids) if x is not None and not (x in seen or seen.add(x))]


def join_checked(left: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join; ``small`` (a written narrow table) is broadcast only after its rows are counted."""
    if small.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(small), on, how)
    return left.join(small, on, how)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): one row (id, c) per node, c the smallest id.

    Smallest-label spreading with pointer jumping; each step is written to the
    shared folder, no label or edge reaches the driver.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("c"))
                     .select(F.col("a").alias("id"), "c"), "labels")
    while True:
        near = (both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("c").alias("m"))
                .select(F.col("a").alias("id"), "m"))
        step = labels.select("id", "c").join(near, "id").select("id", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        up = labels.select(F.col("id").alias("c"), F.col("c").alias("top"))
        new = written(step.join(up, "c", "left")
                      .select("id", "old", F.least("c", F.coalesce("top", "c")).alias("c")), "labels")
        release(labels)
        labels = new
        if new.filter(F.col("old") != F.col("c")).limit(1).count() == 0:
            release(both)
            done = new.select("id", "c")
            done._written_path = new._written_path
            return done


def _ratio(percent: int, a: str, b: str):
    return F.least(F.col(a), F.col(b)) * 100 >= F.greatest(F.col(a), F.col(b)) * percent


def _sketch_close(percent: int, left: str, right: str, words: list[str] = _SKETCH):
    bits = sum((F.bit_count(F.col(f"{left}{c}").bitwiseXOR(F.col(f"{right}{c}"))) for c in words), F.lit(0))
    return bits * (100 + percent) <= (F.col(f"{left}n") + F.col(f"{right}n")) * (100 - percent)


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       width: int = 4, percent: int = 85, n2: int = 2, k2: int = 1) -> DataFrame:
    """Set size and link component of every document.

    Returns one row per input row: ``id_col``, ``n_shingles`` (long) and
    ``component_id`` (smallest id reachable over links, its own included).

    * Null text counts as empty; a text without words has no shingles, links
      with nothing and is its own component.
    * Repeated rows and repeated ids each keep their row; equal texts are linked.
    * A null id never is a component's id unless all ids of the component are null.
    * Other columns are ignored, whatever their names.  Empty input: no rows.
    """
    if not 0 <= k2 < n2 or not 50 <= percent <= 100:
        raise ValueError("need 0 <= k2 < n2 and 50 <= percent <= 100")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.xxhash64(text_col).alias("hash"))
    subsets = [list(c) for c in combinations(range(n2), n2 - k2)]
    edges, params = instance_params(percent, k2, n2)

    def to_sets(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sets = shingle_sets(part.column("text"), width)
                full = np.array([len(s) > 0 for s in sets], bool)
                sid = pa.array(signed([set_id(s) if len(s) else 0 for s in sets]), mask=~full)
                sk = np.array([sketch(s) for s in sets], np.int64).reshape(len(sets), 4)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("hash"), pa.array([len(s) for s in sets], pa.int64()), sid,
                     *(pa.array(np.ascontiguousarray(sk[:, j])) for j in range(4)),
                     pa.array([sketch(s, WIDE_BITS) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                    ["id", "hash", "n", "sid", *_SKETCH, "wide"])

    def to_signatures(batches):
        met: set[int] = set()                # ids of the sets of this task: copies emit once
        found, held = [], 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                sets = [s for s in shingle_sets(part.column("text"), width) if len(s)]
                own = [set_id(s) for s in sets]
                for i in fresh(met, [int(x) for x in own]):
                    sig, emit = signatures(sets[i], edges, params, n2, subsets)
                    found.append((sig[emit], np.full(int(emit.sum()), own[i]).view(np.int64)))
                    held += len(found[-1][0])
                    if held >= PACKED:
                        yield pack_signatures(*(np.concatenate(x) for x in zip(*found)), ranges)
                        found, held = [], 0
        if held:
            yield pack_signatures(*(np.concatenate(x) for x in zip(*found)), ranges)

    def to_buckets(batches):
        """Rows come by range."""
        key, low, sid = None, [], []
        for batch in batches:
            for part, x, y in zip(*(batch.column(c).to_pylist() for c in ("part", "sig", "sid"))):
                if part != key and low:
                    yield from shared_signatures(key, np.concatenate(low), np.concatenate(sid))
                    low, sid = [], []
                key = part
                low.append(np.frombuffer(x, np.uint32))
                sid.append(np.frombuffer(y, np.int64))
        if low:
            yield from shared_signatures(key, np.concatenate(low), np.concatenate(sid))

    schema = docs.select("id", "hash").schema.add("n", "long").add("sid", "long")
    for c in _SKETCH:
        schema = schema.add(c, "long")
    schema = schema.add("wide", T.ArrayType(T.LongType()))
    with small_batches(docs.sparkSession):
        sets = written(docs.mapInArrow(to_sets, schema), "sets")

    # buckets with at least two different sets, each row with the bucket's pivot
    shingles = sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    ranges = min(max(RANGES[0], shingles // RANGE_SHINGLES), RANGES[1])
    with small_batches(docs.sparkSession):
        multi = written(docs.select("text").mapInArrow(to_signatures, "part int, sig binary, sid binary")
                        .repartition("part").sortWithinPartitions("part")
                        .mapInArrow(to_buckets, "sig long, sid long, piv long"), "buckets")

    # the candidates' sizes, sketches and the row that has their text
    wanted = multi.select("sid").distinct()
    candidates = written(sets.join(wanted, "sid").groupBy("sid").agg(
        F.min(F.struct("id", "hash")).alias("rep"), F.first("n").alias("n"), *(F.first(c).alias(c) for c in [*_SKETCH, "wide"])), "candidates")
    wide = candidates.select("sid", "n", "wide")
    info = candidates.drop("wide")
    half = len(_FOLDED)
    folded = candidates.select("sid", "n", *(F.get("wide", F.lit(i)).bitwiseXOR(F.get("wide", F.lit(i + half))).alias(f)
                                             for i, f in enumerate(_FOLDED)))

    def with_text(of: DataFrame) -> DataFrame:
        """``of`` (a written narrow table with ``rep``) with the texts; a repeated row comes as often."""
        here = F.col("id").eqNullSafe(F.col("rep.id")) & (F.col("hash") == F.col("rep.hash"))
        return join_checked(docs, of, here).select(*(c for c in of.columns if c != "rep"), "text")

    def first_texts(batches):
        met: set[int] = set()                # of repeated rows one is enough
        for batch in batches:
            new = fresh(met, batch.column("sid").to_pylist())
            for part in slices(batch.take(pa.array(new, pa.int64())), "text", SLICE):
                yield pa.RecordBatch.from_arrays([part.column("sid"), pack_texts(part.column("text"))], ["sid", "text"])

    def texts_of(pairs: DataFrame) -> tuple[DataFrame, int]:
        """The packed texts of both ends, and the number of blocks that they are compared in."""
        ends = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
        ends = written(info.select("sid", "rep", "n").join(ends, "sid"), "ends")
        size = ends.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("sets")).first()
        with small_batches(docs.sparkSession):
            out = written(with_text(ends.drop("n")).mapInArrow(first_texts, "sid long, text binary").dropDuplicates(["sid"]), "texts")
        release(ends)
        return out, max(1, -(-size.n // BLOCK_SHINGLES), -(-size.sets // BLOCK_SETS))

    def verify(batches):
        """Rows come by pair of blocks, the texts of a pair of blocks before its pairs."""
        key, known = None, {}                # set id -> its shingles and their sketch
        for batch in batches:
            lo, hi, a, b = (batch.column(c).to_pylist() for c in ("lo", "hi", "a", "b"))
            packed = [x is None for x in b]
            kept, i = [], 0
            while i < len(a):
                if (lo[i], hi[i]) != key:
                    key, known = (lo[i], hi[i]), {}
                end = i + 1
                while end < len(a) and packed[end] == packed[i] and (lo[end], hi[end]) == key:
                    end += 1
                if packed[i]:
                    for part, texts in unpacked(batch.slice(i, end - i), "text"):
                        for x, s in zip(part.column("a").to_pylist(), shingle_sets(texts, width)):
                            known[x] = s, sketch(s, TEXT_BITS).view(np.uint64)
                else:
                    for x, y in zip(a[i:end], b[i:end]):
                        (s, s_bits), (t, t_bits) = known[x], known[y]
                        n = len(s) + len(t)
                        if int(np.bitwise_count(s_bits ^ t_bits).sum()) * (100 + percent) > n * (100 - percent):
                            continue
                        both = len(np.intersect1d(s, t, assume_unique=True))
                        if 100 * both >= percent * (n - both):
                            kept.append((x, y))
                i = end
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in kept], pa.int64()) for k in (0, 1)], ["a", "b"])

    def near(pairs: DataFrame) -> DataFrame:
        # the wide sketch settles most pairs before any text is moved; many pairs take several rounds
        ends = [wide.select(F.col("sid").alias(k), F.col("n").alias(f"n_{k}"), F.col("wide").alias(f"wide_{k}")) for k in "ab"]
        bits = F.aggregate(F.zip_with("wide_a", "wide_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        pairs = written(pairs, "candidate-pairs")
        rounds = ROUNDS if pairs.count() > ROUND_ROWS else 1
        kept = []
        for k in range(rounds):
            some = pairs.filter(F.pmod(F.xxhash64("a"), F.lit(rounds)) == k)
            kept.append(written(some.join(ends[0], "a").join(ends[1], "b").filter(
                bits * (100 + percent) <= (F.col("n_a") + F.col("n_b")) * (100 - percent)).select("a", "b"), "pairs"))
        release(pairs)
        if rounds == 1:
            return kept[0]
        out = kept[0]
        for more in kept[1:]:
            out = out.union(more)
        out = written(out, "pairs")
        release(*kept)
        return out

    def proven(pairs: DataFrame, texts: tuple[DataFrame, int]) -> DataFrame:
        """The pairs that link.  A text travels once for each pair of blocks that has a pair with it, not for each pair."""
        table, blocks = texts
        lo, hi = (F.pmod(F.xxhash64(c), F.lit(blocks)) for c in "ab")
        at = pairs.select(F.least(lo, hi).alias("lo"), F.greatest(lo, hi).alias("hi"), "a", "b")
        ends = at.select("lo", "hi", F.col("a").alias("sid")).union(at.select("lo", "hi", "b")).distinct()
        both = (ends.join(table, "sid").select("lo", "hi", F.col("sid").alias("a"), F.lit(None).cast("long").alias("b"), "text")
                .union(at.withColumn("text", F.lit(None).cast("binary"))))
        with small_batches(docs.sparkSession):
            return written(both.repartition("lo", "hi").sortWithinPartitions("lo", "hi", F.asc_nulls_first("b"), "a")
                           .mapInArrow(verify, "a long, b long"), "links")

    def links(pairs: DataFrame, comp: DataFrame | None = None) -> DataFrame:
        """Components with the proven links of ``pairs``; a pair inside one component moves no text.

        First every set with its smallest near partner, then the pairs that are still apart.
        """
        def edges_of(labels):
            return labels.select(F.col("id").alias("a"), F.col("c").alias("b")).filter("a <> b")

        pairs = near(pairs)
        texts = texts_of(pairs)
        tried = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        found = proven(tried, texts)
        first = components(found if comp is None else edges_of(comp).union(found))
        release(found, *([] if comp is None else [comp]))
        ends = [first.select(F.col("id").alias(k), F.col("c").alias(f"c_{k}")) for k in "ab"]
        apart = written(pairs.join(ends[0], "a", "left").join(ends[1], "b", "left")
                        .filter(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")
                        .join(tried, ["a", "b"], "left_anti"), "apart")
        release(pairs)
        more = proven(apart, texts)
        release(apart, texts[0])
        out = components(edges_of(first).union(more))
        release(first, more)
        return out

    def named(prefix: str, key: str) -> DataFrame:
        return info.select(F.col("sid").alias(key), *(F.col(c).alias(f"{prefix}{c}") for c in ["n", *_SKETCH]))

    ratio = _ratio(percent, "l_n", "r_n")
    close = ratio & _sketch_close(percent, "l_", "r_")
    star = (multi.filter("sid <> piv").select(F.col("piv").alias("a"), F.col("sid").alias("b")).distinct()
            .join(named("r_", "b"), "b").join(named("l_", "a"), "a").filter(close).select("a", "b"))
    comp = links(star)

    # buckets whose members, the pivot apart, lie in more than one component
    rest = (multi.filter("sid <> piv").select("sig", "sid")
            .join(comp.withColumnRenamed("id", "sid"), "sid", "left")
            .withColumn("c", F.coalesce("c", "sid")))
    parts = written(rest.groupBy("sig", "c").agg(F.count("*").alias("m")), "parts")
    # one row a bucket: its members, and its largest component
    open_ = written(parts.groupBy("sig").agg(F.sum("m").alias("m"), F.count("*").alias("n"),
                                             F.max(F.struct("m", "c")).alias("top"))
                    .filter("n > 1").select("sig", F.col("top.c").alias("big"),
                                            F.ceil(F.col("m") / BLOCK).cast("int").alias("all_blocks"),
                                            F.ceil((F.col("m") - F.col("top.m")) / BLOCK).cast("int").alias("few_blocks")), "open")
    release(parts)
    members = written(join_checked(rest, open_, "sig"), "members")
    release(multi, open_)
    rounds = ROUNDS if members.count() > ROUND_ROWS else 1
    # a set's buckets in order, each with the ones just before it: a pair that has one of those in common met there
    before = F.collect_list("sig").over(Window.partitionBy("sid").orderBy("sig").rowsBetween(-BEFORE, -1))
    values, at = ["n", "c", *_FOLDED, "before"], F.xxhash64("sid")
    closer = ratio & _sketch_close(percent, "l_", "r_", _FOLDED)
    once = (F.col("r_c") == F.col("big")) | (F.col("a") < F.col("b"))
    found = []
    for k in range(rounds):
        some = members.filter(F.pmod(F.xxhash64("sig"), F.lit(rounds)) == k).withColumn("before", before)
        some = written(some.join(folded, "sid"), "round")
        left = (some.filter(F.col("c") != F.col("big"))
                .select("sig", F.col("sid").alias("a"), "big", *(F.col(c).alias(f"l_{c}") for c in values),
                        F.pmod(at, "few_blocks").alias("low"), F.explode(F.sequence(F.lit(0), F.col("all_blocks") - 1)).alias("high")))
        right = some.select(F.col("sig").alias("r_sig"), F.col("sid").alias("b"), *(F.col(c).alias(f"r_{c}") for c in values),
                            F.explode(F.sequence(F.lit(0), F.col("few_blocks") - 1)).alias("r_low"),
                            F.pmod(at, "all_blocks").alias("r_high"))
        found.append(written(left.join(
            right, (F.col("sig") == F.col("r_sig")) & (F.col("low") == F.col("r_low")) & (F.col("high") == F.col("r_high"))
            & (F.col("l_c") != F.col("r_c")) & once & closer & ~F.arrays_overlap("l_before", "r_before"))
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cross"))
        release(some)
    release(members)
    cross = found[0]
    for more in found[1:]:
        cross = cross.union(more)
    cross = cross.distinct()
    comp = links(cross, comp)
    release(candidates, *found)

    # the smallest document id of each component, back on every document
    placed = written(sets.select("id", "n", "sid").join(comp.withColumnRenamed("id", "sid"), "sid", "left")
                     .select("id", "n", F.coalesce("c", "sid").alias("c")), "placed")
    release(sets, comp)
    least = placed.filter("c is not null").groupBy("c").agg(F.min("id").alias("least"))
    return (placed.join(least, "c", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("least"))
                    .alias("component_id")))
