"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Every byte gives triplets with two of the bytes after it; each triplet is hashed to a bucket and counted.  A bucket is coded
by the quartile of all bucket counts it falls in (two bits), which keeps the
profile and drops the document's scale; the length is coded on a logarithmic
scale.  Two digests are compared bucket by bucket with a score between 0 and 1.

Digest (hex): one byte of length code, one byte of the quartile ratios, then
two bits a bucket.  Equal texts have equal digests.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.llm.textops import BYTE_CODE, mix, slices, text_buffer
from tabsmith.session import written

BUCKETS = 1024
#: Offsets of the two later bytes of a triplet in the window.
SKIPS = ((1, 2), (1, 3), (2, 4), (3, 5))
#: Difference of two bucket codes 0..3 apart; the ends of the scale weigh more.
STEP = np.array([0, 1, 2, 6], np.int64)
#: Scores are 0 from this share of the largest possible difference on.
FAR = 0.5


def _tables() -> list[np.ndarray]:
    return [(mix(BYTE_CODE + np.uint64(j + 1)) & np.uint64(0xFFFFFFFF)).astype(np.uint32) for j in range(3 * len(SKIPS))]


_T = _tables()


def bucket_counts(data: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of the hashed triplets of one text's bytes; shorter than three bytes: all zero."""
    out = np.zeros(buckets, np.int64)
    for k, (a, b) in enumerate(SKIPS):
        n = len(data) - b
        if n > 0:
            x, y, z = _T[3 * k:3 * k + 3]
            h = (x[data[:n]] + y[data[a:a + n]]) ^ z[data[b:b + n]]
            out += np.bincount((h * np.uint32(2654435761)) >> np.uint32(32 - buckets.bit_length() + 1),
                               minlength=buckets)
    return out


def digest(data: np.ndarray, buckets: int = BUCKETS) -> str:
    """Hex digest of the bytes of one text."""
    counts = bucket_counts(data, buckets)
    q = np.sort(counts)[[buckets // 4 - 1, buckets // 2 - 1, 3 * buckets // 4 - 1]]
    code = (counts[:, None] > q).sum(axis=1).astype(np.uint8)
    length = min(255, int(round(8 * np.log2(len(data) + 1))))
    ratio = (int(15 * q[0] // max(q[2], 1)) << 4) | int(15 * q[1] // max(q[2], 1))
    packed = code[0::4] | code[1::4] << 2 | code[2::4] << 4 | code[3::4] << 6
    return (bytes([length, ratio]) + packed.tobytes()).hex()


_LOW = np.arange(256)
_PAIR = np.zeros((256, 256), np.uint8)
for _s in range(0, 8, 2):
    _PAIR += STEP[np.abs((_LOW[:, None] >> _s & 3) - (_LOW[None, :] >> _s & 3))].astype(np.uint8)


def likeness(a: str | None, b: str | None) -> float | None:
    """Bounded likeness of two digests: 1 for equal ones, falling with the difference, never below 0.

    The difference adds up bucket steps, the length codes and the quartile
    ratios; ``FAR`` of the largest bucket difference, and more, gives 0.
    """
    if a is None or b is None:
        return None
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    if len(x) != len(y):
        raise ValueError("digests of different size")
    (n, r), (m, s) = x[:2].tolist(), y[:2].tolist()
    head = min(32, abs(n - m)) + abs((r >> 4) - (s >> 4)) + abs((r & 15) - (s & 15))
    far = FAR * 6 * 4 * (len(x) - 2) / 2
    return float(max(0.0, 1.0 - (head + int(_PAIR[x[2:], y[2:]].sum(dtype=np.int64))) / far))


def _likenesses(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([likeness(x, y) for x, y in zip(a, b)], dtype="float64")


def add_digest(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """``df`` with the digest of ``text_col`` (null: of the empty text) in ``out_col``; a
    column of that name is replaced, all rows and other columns stay."""
    kept = [c for c in df.columns if c != out_col]
    plain = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, off = text_buffer(part.column("text"))
                found = [digest(data[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(found, pa.string())], ["row", "d"])

    return (plain.mapInArrow(run, plain.select("row").schema.add("d", "string"))
            .select("row.*", F.col("d").alias(out_col)))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of every text and of its edited form, with their likenesses.

    The edited text keeps the first half of the code points (the larger one)
    and takes the rest from the start of the next document, by descending id;
    the last is followed by the first.  Returns ``id_col``, ``n_chars``,
    ``edited``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``,
    ``near_next``.

    * Null and empty texts count as empty.  Null ids come last; equal ids are
      ordered by text, so repeated rows follow each other.
    * A single row is its own next.  Other columns are ignored.  Empty input:
      no rows.

    The order is cut into ranges of ids at approximate quantiles; a range also
    gets the first row of the range after it, so no task holds more than one
    range and each text is shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # a few ranges for each shuffle partition, so ranges of unequal size even out
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.select(F.percentile_approx("id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0]
    cuts = sorted({*(cuts or [])})
    bounds = F.array(*(F.lit(c) for c in cuts)).cast(f"array<{rows.schema['id'].dataType.simpleString()}>")
    # 0 is the range of the largest ids; null ids have a range of their own at the end
    number = F.when(F.col("id").isNull(), len(cuts) + 1).otherwise(F.size(F.filter(bounds, lambda c: c >= F.col("id"))))
    rows = add_digest(rows, "text", "fp").withColumn("range", number)
    key = F.struct(F.col("id").isNull().alias("none"), (-F.col("id")).alias("back"), F.col("text").alias("text"))
    first = written(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
                    .withColumn("range", number).groupBy("range").agg(
                        F.min(key).alias("k"), F.min_by("id", key).alias("id")), "firsts")
    filled = [r["range"] for r in first.select("range").orderBy("range").collect()]
    if not filled:
        after = F.lit(0)
    else:
        after = F.create_map(*(F.lit(x) for i, r in enumerate(filled) for x in (r, filled[i - 1])))[F.col("range")]
    guests = add_digest(first.select("id", F.col("k.text").alias("text"), "range"), "text", "fp").select(
        "id", "text", "fp", after.alias("range"), F.lit(1).alias("guest"))
    both = rows.select("id", "text", "fp", "range", F.lit(0).alias("guest")).union(guests)
    order = Window.partitionBy("range").orderBy("guest", F.desc_nulls_last("id"), "text")
    near = both.withColumns({"next": F.lead("text").over(order), "next_fp": F.lead("fp").over(order)}).filter("guest = 0")
    half = F.floor(F.length("text") / 2).cast("int")
    near = near.select(
        "id", F.length("text").cast("long").alias("n_chars"), "fp", "next_fp",
        F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next", F.lit(1), half)).alias("edited"))
    near = add_digest(near, "edited", "edited_fp")
    like = F.pandas_udf(_likenesses, "double")
    return near.select(
        F.col("id").alias(id_col), "n_chars", "edited", F.col("fp").alias("fingerprint"),
        F.col("edited_fp").alias("edited_fingerprint"), like("fp", "edited_fp").alias("near_edited"),
        like("fp", "next_fp").alias("near_next"))
