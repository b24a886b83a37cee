"""Mixing sources to target weights by Pareto order sampling.

Every source has a target of words.  A document is expected in
``m = min(most, c * preference)`` copies, with ``c`` such that the expected words
of its source meet the target.  The whole part of ``m`` is certain; for the
fraction ``p`` documents are ranked by random odds over inclusion odds,

    Q = (U / (1 - U)) / (p / (1 - p)),

with ``U`` a hash of the document, and the sample is the front of that order up
to a fixed size: the words that the certain copies leave open.  The document at
the border rarely fits; documents behind it that do fit are taken in the same
order until the gap is below the tolerance or nothing fits, and then one more if
that leaves the source nearer to its target.

The order is cut by running sums over ranges of (source, Q), so a source with a
third of all rows spans many tasks; equal rows are spread too.  Sources meet in a
partial aggregate, and only two numbers a round reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.binpack import word_count
from tabsmith.llm.partenum import join_checked
from tabsmith.operators.rank import global_rank, running_sum
from tabsmith.session import written

#: Weights of the sources in their order, repeating, and copies of a document at most.
WEIGHTS, MOST = (5, 2, 1), 3
#: Share of a target that may stay open while shorter documents would fit.
TOLERANCE = 0.0005


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size) with ``target``.

    In the order of their values (NULL last) the sources weigh ``weights``,
    repeating.  They share the sum of all sizes by weight; a target stops at
    ``most`` times its source's size and the excess goes to the others by weight,
    until none is above.
    """
    ranked = global_rank(sources, [F.col("source").asc_nulls_last()], out="place")
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    ranked = written(ranked.withColumn("weight", weight.cast("long")), "sources")
    limit = F.col("source_size") * most
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    share, capped = 0.0, -1
    while True:
        above = limit < F.lit(share) * F.col("weight")
        now = ranked.agg(F.count_if(above).alias("n"), F.sum(F.when(above, limit)).alias("full"),
                         F.sum(F.when(~above, F.col("weight"))).alias("open")).first()
        if now.n == capped or not now.open:
            break
        # whole numbers until the division, so reruns agree
        capped, share = now.n, (total - (now.full or 0)) / now.open
    return ranked.withColumn("target", F.least(limit.cast("double"), F.lit(share) * F.col("weight")))


def _expected(rows: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """``sources`` with ``c``: expected copies are min(most, c * preference)."""
    state = sources.withColumn("c", F.lit(0.0)).withColumn("full", F.lit(-1).cast("long"))
    while True:
        state = written(state, "factors")
        side = state.select(F.col("source").alias("__s"), F.col("c").alias("__c"))
        both = join_checked(rows, side, F.col("source").eqNullSafe(F.col("__s")))
        over = F.col("__c") * F.col("preference") > most
        # decimals add up alike in every order
        sums = written(both.groupBy("source").agg(
            F.count_if(over).alias("now"), F.sum(F.when(over, F.col("size"))).alias("held"),
            F.sum(F.when(~over, (F.col("size") * F.col("preference")).cast("decimal(38,9)"))).alias("free"))
            .select(F.col("source").alias("__s"), "now", "held", "free"), "sums")
        joined = state.join(sums, F.col("source").eqNullSafe(F.col("__s")))
        if joined.filter(F.col("now") != F.col("full")).limit(1).count() == 0:
            return state.drop("full")
        open_words = F.col("target") - F.coalesce("held", F.lit(0)) * most
        c = F.when(F.col("free") > 0, open_words / F.col("free").cast("double")).otherwise(F.col("c"))
        state = joined.withColumn("c", c).withColumn("full", F.col("now")).drop("__s", "now", "held", "free")


def _fill(ranked: DataFrame, tolerance: float) -> DataFrame:
    """``uid`` of the documents that bring sources with an open gap nearer to their target."""
    gap = ranked.groupBy("source").agg((F.first("room") - F.sum(F.col("drawn") * F.col("size"))).alias("gap"),
                                       F.first("target").alias("target"))
    found = None
    while True:
        gap = written(gap.filter(F.col("gap") > F.col("target") * tolerance)
                      .select(F.col("source").alias("__s"), "gap", F.col("target").alias("__target")), "gaps")
        here = F.col("source").eqNullSafe(F.col("__s"))
        free = join_checked(ranked.filter("drawn = 0 AND q IS NOT NULL").select("source", "size", "q", "uid"), gap,
                            here & (F.col("size") < 2 * F.col("gap")))
        if found is not None:
            free = join_checked(free, found, "uid", "left_anti")
        free = written(free, "free")
        # a front of the shorter documents, in the same order, as long as it fits
        fit = written(running_sum(free.filter(F.col("size") <= F.col("gap")), ["q", "uid"], ["source"], F.col("size"))
                      .filter(F.col("running") <= F.col("gap")), "fitting")
        if fit.limit(1).count() == 0:
            # nothing fits: one document over the target where that is nearer to it than without
            one = F.min(F.struct("size", "q", "uid")).alias("one")
            new = free.groupBy("source").agg(one).select("one.uid")
            return new if found is None else found.union(new)
        found = written(fit.select("uid") if found is None else found.union(fit.select("uid")), "found")
        gap = (gap.join(fit.groupBy("source").agg(F.sum("size").alias("got")), here, "left")
               .select(F.col("__s").alias("source"), (F.col("gap") - F.coalesce("got", F.lit(0))).alias("gap"),
                       F.col("__target").alias("target")))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        size: Column | None = None, preference: Column | None = None, weights: Sequence[int] = WEIGHTS,
        most: int = MOST, seed: int = 0, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per document: ``id_col``, ``size``, ``source_size``, ``target``, ``expected``, ``copies`` and ``taken``.

    ``size`` is by default the words of ``text_col``; ``preference`` (default 1)
    multiplies the copies that a document is expected in, before the limit of
    ``most``.  ``target`` belongs to the document's source (``targets``);
    ``taken`` is ``copies * size``; its sum over a source differs from the target
    by less than ``tolerance`` of it, or by at most half of the shortest document
    that could still be taken.

    * A null text has size 0, as has a null or negative ``size``; rows of size 0
      are not taken (0 copies).  A null, negative or non-finite preference
      counts as 0.
    * A null source is a source, the last in order.
    * ``U`` hashes id, source and text with the seed, so reruns agree whatever
      the partitions; repeated rows are rows of their own, and which of several
      equal rows are taken makes no difference.  A null id is a value.
    * A source without words has target 0.  Empty input: no rows.
    * Other columns are ignored, whatever their names.
    """
    size = word_count(F.col(f"`{text_col}`")) if size is None else size
    wish = F.lit(1.0) if preference is None else preference.cast("double")
    wish = F.when(wish.isNull() | F.isnan(wish) | (wish < 0) | (wish == float("inf")), 0.0).otherwise(wish)
    hashed = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`").cast("string"), F.lit("/"), F.col(f"`{source_col}`").cast("string"),
                        F.lit("/"), F.col(f"`{text_col}`"))
    rows = written(docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"),
        F.greatest(F.coalesce(size, F.lit(0)), F.lit(0)).cast("long").alias("size"), wish.alias("preference"),
        ((F.pmod(hashed, F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)).alias("u"),
        F.monotonically_increasing_id().alias("uid")), "sizes")
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    if preference is None:
        sources = sources.withColumn("c", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
    else:
        sources = _expected(rows, written(sources, "targets"), most)
    side = written(sources.select(F.col("source").alias("__s"), "source_size", "target", "c"), "targets")
    m = F.least(F.lit(float(most)), F.col("c") * F.col("preference"))
    rows = join_checked(rows, side, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    rows = rows.withColumn("expected", F.when(F.col("size") > 0, m).otherwise(0.0))
    rows = rows.withColumn("sure", F.floor("expected")).withColumn("p", F.col("expected") - F.col("sure"))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    rows = rows.withColumn("q", F.when(F.col("p") > 0, odds))
    # fixed size: the words that the certain copies leave open
    words = F.when(F.col("q").isNotNull(), F.col("size")).otherwise(0)
    ranked = running_sum(rows, [F.col("q").asc_nulls_last(), "uid"], ["source"], words, "running")
    sure = written(rows.groupBy("source").agg(F.sum(F.col("sure") * F.col("size")).alias("certain"),
                                              F.first("target").alias("target"))
                   .select(F.col("source").alias("__s"), (F.col("target") - F.col("certain")).alias("room")), "rooms")
    ranked = join_checked(ranked, sure, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    inside = F.col("q").isNotNull() & (F.col("running") <= F.col("room"))
    ranked = written(ranked.withColumn("drawn", inside.cast("long")), "drawn")
    late = written(_fill(ranked, tolerance), "late")
    ranked = join_checked(ranked, late.withColumn("late", F.lit(1)), "uid", "left")
    copies = F.col("sure") + F.col("drawn") + F.coalesce("late", F.lit(0))
    return ranked.select(F.col("id").alias(id_col), "size", "source_size", "target", "expected",
                         copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
