"""Quality rules with host-level verdicts, in Spark expressions only.

Per document the rules count words, symbols, repeated lines and words inside
repeated 8-word windows.  Failures are then aggregated by host; the failure
rate of a host is shrunk with a beta prior fitted to all hosts by the method of
moments, and documents of hosts whose shrunk rate passes a limit are rejected
together with the documents that fail on their own.

The per-document counts need no shuffle: windows are hashed inside the row and
repeats are found by sorting the hashes of that row alone, and only in rows
that have a repeat at all.  Host totals are a partial aggregate, so a host with
a third of the rows arrives as one row per map task.  Only the rejected hosts
are joined back, by broadcast when counted small, else by a shuffle join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.session import written

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
WINDOW = 8
#: A broadcast of rejected hosts has at most so many rows.
BROADCAST_ROWS = 100_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs at least twice in the row."""
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(p: Column) -> Column:
        def same(x: Column, i: Column) -> Column:
            # get() is NULL outside the array, and NULL = x keeps nothing
            return F.coalesce(F.get(p, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(
                F.get(p, i + 1)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(p, same), lambda x: x["i"]))

    def covered(s: Column) -> Column:
        last = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at"))
        return F.aggregate(s, last, lambda a, i: F.struct(
            (a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n"), i.alias("at")), lambda a: a["n"])

    # one-element transforms bind each array once, as a let-expression
    return F.get(F.transform(F.array(pairs), lambda p: F.get(
        F.transform(F.array(repeated(p)), covered), F.lit(0))), F.lit(0))


def rule_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the rule counts and ``base_failed`` appended.

    Null text counts as empty: all counts 0, failed (fewer than 20 words).
    Existing columns of the same names are replaced.
    """
    kept = [c for c in docs.columns if c not in COUNTS + ["base_failed"]]
    t = F.coalesce(F.col(text_col), F.lit(""))
    step = docs.select(*kept, t.alias("__t"))
    step = step.select(
        *kept, "__t", F.array_remove(F.split("__t", SPACES), "").alias("__w"),
        F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__l"))
    step = step.select(
        *kept, "__w", F.transform("__w", lambda w: F.xxhash64(w)).alias("__h"),
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.regexp_replace("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"))
    windows = F.transform(F.sequence(F.lit(1), F.size("__h") - (WINDOW - 1)),
                          lambda i: F.xxhash64(F.slice(F.col("__h"), i, F.lit(WINDOW))))
    step = step.select(
        *kept, "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.when(F.col("n_words") > WINDOW, windows).otherwise(F.array().cast("array<bigint>")).alias("__h"))
    step = step.withColumn(
        "n_repeat_words",
        F.when(F.size(F.array_distinct("__h")) < F.size("__h"), _repeat_words(F.col("__h")))
        .otherwise(F.lit(0)).cast("long"))
    return step.drop("__h").withColumn(
        "base_failed",
        (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30))


def host_verdicts(flags: DataFrame, host_col: str, limit: float = 0.5) -> DataFrame:
    """Per host: documents, failures, shrunk failure rate and whether it is rejected.

    ``flags`` has ``host_col`` and boolean ``base_failed``.  The beta prior has
    mean m and variance v of the hosts' raw rates; its weight is
    m (1 - m) / v - 1, at least 1, and the weight of all documents where the
    hosts do not differ.  The null host is a host of its own.  No rows: no hosts.
    """
    hosts = flags.groupBy(F.col(host_col).alias("host")).agg(
        F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.sum("n_docs").alias("all"))
    prior = prior.select("m", F.when(F.col("v") > 0, F.greatest(
        F.lit(1.0), F.col("m") * (1 - F.col("m")) / F.col("v") - 1)).otherwise(F.col("all")).alias("weight"))
    return (hosts.join(F.broadcast(prior))      # one row
            .withColumn("host_rate", (F.col("n_failed") + F.col("m") * F.col("weight"))
                        / (F.col("n_docs") + F.col("weight")))
            .withColumn("host_rejected", F.col("host_rate") > limit)
            .select("host", "n_docs", "n_failed", "host_rate", "host_rejected"))


def host_quality(docs: DataFrame, text_col: str = "text", host_col: str = "source",
                 limit: float = 0.5) -> DataFrame:
    """Every document with its rule counts, ``base_failed`` and ``kept``.

    Returns the columns of ``docs`` without the text, the counts of
    ``rule_counts``, ``base_failed`` and ``kept``: false if the document fails
    itself or its host is rejected.  One row per input row; repeated rows,
    null ids and a null host are kept as they are; columns that clash with the
    result's are replaced.  Empty input: no rows.
    """
    spare = [c for c in docs.columns if c not in (text_col, host_col, "kept", "base_failed", *COUNTS)]
    flags = written(rule_counts(docs.select(*spare, F.col(host_col).alias("__host"), F.col(text_col).alias("__x")),
                                "__x").drop("__x"), "rules")
    bad = written(host_verdicts(flags, "__host", limit).filter("host_rejected")
                  .select(F.col("host").alias("__bad_host"), F.lit(True).alias("__bad")), "hosts")
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    out = flags.join(bad, F.col("__host").eqNullSafe(F.col("__bad_host")), "left")
    return out.select(
        *(F.col(f"`{c}`") for c in spare), F.col("__host").alias(host_col), *COUNTS, "base_failed",
        (~F.col("base_failed") & F.col("__bad").isNull()).alias("kept"))


def reject_by_rules(docs: DataFrame, text_col: str = "text", host_col: str = "source",
                    limit: float = 0.5) -> DataFrame:
    """The documents that pass, with the columns they had.

    One pass over the texts: rows and counts are written, the host totals and
    the filter read what is written, and no text is shuffled.
    """
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"),
                      F.col(host_col).alias("__host"), F.col(text_col).alias("__x"))
    flags = written(rule_counts(row, "__x").select("__row", "__host", "base_failed"), "rules")
    bad = written(host_verdicts(flags, "__host", limit).filter("host_rejected").select("host"), "hosts")
    if bad.count() <= BROADCAST_ROWS:
        bad = F.broadcast(bad)
    passed = flags.filter(~F.col("base_failed"))
    return passed.join(bad, passed["__host"].eqNullSafe(bad["host"]), "left_anti").select("__row.*")
