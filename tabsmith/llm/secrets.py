"""Secret scan with multipart credential linking, in Spark expressions only.

Three kinds of spans stand on their own: assignments of a secret-like name,
access identifiers and long hex runs.  Credentials often come in parts, and a
part alone proves little: an access identifier of an unusual form, a mixed
token that may be a key, the address of a service.  Such weak candidates are
reported only when complementary parts co-occur.

Scopes are paragraphs (runs of text between blank lines), and parts of one
scope link at any distance, unless the caller bounds the gap between their
intervals by ``reach`` code points.  The interval join is done by order, not by pairs: candidates of one
scope are sorted by position and each looks up the nearest earlier and the
nearest later interval of each role.  A weak key is reported when an identifier
or an endpoint lies within reach, a weak identifier or an endpoint when a
secret (an assignment, a hex run or a weak key) does.  Work is linear in the
candidates, and one scope never holds more than one document.

Positions come from the regular expression itself: each match is taken with the
gap before it, and running sums of the lengths (taken in blocks, so a text with
very many matches is no quadratic row) give starts and ends in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.llm.arrays import let, running, texts_at
from tabsmith.session import written

#: Fixed patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = (r"""((?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?)"""
          r"""([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Weak parts, of any length: identifiers after a user-like name, mixed tokens, service addresses.
IDENT = r"(?i:user|username|login|account|client_id|key_id)[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9_.@-]{3,}+"
KEY = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[A-Z0-9+/_=-]*+[a-z])(?=[a-z0-9+/_=-]*+[A-Z])[A-Za-z0-9+/_=-]{20,}+"
ENDPOINT = r"(?:https?|s3|jdbc:[a-z]+|postgres|mysql|redis|mongodb|ftp)://[A-Za-z0-9._:@/-]+"
KINDS = ["assign", "access", "hex", "ident", "key", "endpoint"]
BASE = KINDS[:3]
#: Largest gap, in code points, between parts that belong together; the scope alone decides by default.
REACH = 2**31 - 1

_SPAN = "array<struct<kind:string,start:int,stop:int>>"


def _matches(text: Column, pattern: str, kind: str, quick: Column, least: int = 0) -> Column:
    """Spans (kind, start, stop) of all matches; with ``least`` of those whose last group is that long."""
    groups = pattern if least else f"()({pattern})"
    whole = rf"(?s)\G(.*?){groups}"      # \G: the rest behind the last match is read once
    parts = F.arrays_zip(*(F.transform(F.regexp_extract_all(text, F.lit(whole), F.lit(g)), F.length).alias(n)
                           for g, n in ((1, "gap"), (2, "head"), (3, "tail"))))

    def placed(found: Column) -> Column:
        stops = running(F.transform(found, lambda p: p["gap"] + p["head"] + p["tail"]))
        return let(stops, lambda at: F.transform(found, lambda p, i: F.struct(
            F.lit(kind).alias("kind"), (F.get(at, i) - p["tail"] - p["head"]).alias("start"), F.get(at, i).alias("stop"),
            p["tail"].alias("tail"))))

    spans = F.transform(F.filter(let(parts, placed), lambda p: p["tail"] >= least),
                        lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["stop"].alias("stop")))
    return F.when(quick, spans).otherwise(F.array().cast(_SPAN))


def find_parts(docs: DataFrame, text_col: str, out_col: str = "parts") -> DataFrame:
    """``docs`` with all base spans and weak candidates of each text in ``out_col``.

    A plain test first keeps texts without any match away from the scan for positions.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    found = [
        _matches(t, ASSIGN, "assign", t.rlike(ASSIGN), least=6),
        _matches(t, ACCESS, "access", t.contains("AKIA") & t.rlike(ACCESS)),
        _matches(t, HEX, "hex", t.rlike(HEX)),
        _matches(t, IDENT, "ident", t.rlike(IDENT)),
        _matches(t, KEY, "key", t.rlike(KEY)),
        _matches(t, ENDPOINT, "endpoint", t.contains("://") & t.rlike(ENDPOINT)),
    ]
    return docs.withColumn(out_col, F.concat(*found))


def _near(role: Column, reach: int) -> Column:
    """Whether an interval of ``role`` other than the row's own lies within reach of it."""
    scope = Window.partitionBy("key", "scope").rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(F.when(role, F.col("stop"))).over(scope.orderBy("start", "stop", "kind"))
    after = F.min(F.when(role, F.col("start"))).over(scope.orderBy(F.desc("start"), F.desc("stop"), F.desc("kind")))
    return (F.coalesce(F.col("start") - before <= reach, F.lit(False))
            | F.coalesce(after - F.col("stop") <= reach, F.lit(False)))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 reach: int = REACH) -> DataFrame:
    """Every document with the spans of its secrets.

    Returns ``id_col`` and ``spans``, an array of (kind, start, stop) by start,
    then kind as listed in ``KINDS``; starts and stops count code points, stops
    are exclusive.  Base spans always stand; weak ones only with complementary
    parts in their scope and within ``reach``.

    * Null and empty texts have no spans (an empty array).
    * One row per input row, also for repeated rows, repeated ids and null ids.
    * Other columns are ignored, whatever their names.  Empty input: no rows.
    """
    return _linked(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), reach).select(
        F.col("id").alias(id_col), "spans")


def _linked(rows: DataFrame, reach: int) -> DataFrame:
    """``rows`` (with ``id`` and ``text``) without the text, and ``spans``.

    Rows with candidates are keyed by id and a digest of the text, so repeated
    rows share one set of candidates and each gets its result.
    """
    kept = [c for c in rows.columns if c != "text"]
    found = find_parts(rows, "text")
    weak = F.exists("parts", lambda p: ~p["kind"].isin(BASE)) & (F.size("parts") > 1)
    # paragraph of a position: how many blank lines end before it
    breaks = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?s)\G(.*?\n[\x20\t\r]*\n)"), F.lit(1)),
                         F.length)
    ends = running(breaks)
    found = written(found.select(
        *kept, "parts", F.when(weak, F.sha2(F.concat_ws("\n", F.coalesce(F.col("id").cast("string"), F.lit("")), "text"), 256))
        .alias("key"), F.when(weak, ends).alias("ends")), "parts")

    # blank lines are sorted among the candidates and counted on the way
    lines = F.transform("ends", lambda e: F.struct(F.lit("").alias("kind"), e.alias("start"), e.alias("stop")))
    each = (found.filter("key is not null").dropDuplicates(["key"])
            .select("key", F.explode(F.concat("parts", lines)).alias("p")).select("key", "p.*")
            .withColumn("scope", F.count_if(F.col("kind") == "").over(
                Window.partitionBy("key").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)))
            .filter("kind <> ''"))
    secret = F.col("kind").isin("assign", "hex", "key")
    other = F.col("kind").isin("access", "ident", "endpoint")
    linked = (each.select("*", _near(secret, reach).alias("by_secret"), _near(other, reach).alias("by_other"))
              .filter(F.col("kind").isin(BASE) | F.when(F.col("kind") == "key", F.col("by_other"))
                      .otherwise(F.col("by_secret"))))
    linked = linked.groupBy("key").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("linked"))

    order = F.array(*(F.lit(k) for k in KINDS))

    def sorted_spans(spans: Column) -> Column:
        ranked = F.array_sort(F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["stop"].alias("stop"),
            s["kind"].alias("kind"))))
        return F.transform(ranked, lambda s: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))

    # rows without weak parts never take part in the join
    alone = F.filter("parts", lambda p: p["kind"].isin(BASE))
    keyed = found.filter("key is not null").join(linked, "key", "left")
    return (found.filter("key is null").select(*kept, sorted_spans(alone).alias("spans"))
            .unionByName(keyed.select(*kept, sorted_spans(F.coalesce("linked", alone)).alias("spans"))))


def count_kind(spans, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind))


def digest(spans: Column) -> Column:
    """``kind:start:stop`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _merged(spans: Column) -> Column:
    """Spans, sorted by start, with those that overlap or touch as one (start, stop)."""
    def joined(spans: Column, reached: Column) -> Column:
        # a cut begins where a span starts behind all before it, and ends where the spans before the next one reach
        starts = F.when(F.size(spans) > 0, F.sequence(F.lit(0), F.size(spans) - 1)).otherwise(F.array().cast("array<int>"))
        new = F.filter(starts, lambda i: F.get(spans, i)["start"] > F.coalesce(F.get(reached, i - 1), F.lit(-1)))
        return let(new, lambda first: F.transform(first, lambda i, k: F.struct(
            F.get(spans, i)["start"].alias("start"),
            F.get(reached, F.coalesce(F.get(first, k + 1), F.size(spans)) - 1).alias("stop"))))

    return let(spans, lambda s: let(running(F.transform(s, lambda x: x["stop"]), F.greatest), lambda m: joined(s, m)))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]",
           reach: int = REACH) -> DataFrame:
    """``docs`` with every secret span of ``text_col`` replaced by ``mark``; overlapping spans by one.

    All columns and rows stay; a null text stays null.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
                       F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"),
                       F.col(f"`{text_col}`").alias("body"))
    found = _linked(rows, reach)

    clean = found.select("row", "body", _merged(F.col("spans")).alias("cuts"))
    size = F.length("body")
    kept = let(F.col("cuts"), lambda c: let(size, lambda n: F.transform(F.sequence(F.lit(0), F.size(c)), lambda i: F.struct(
        F.coalesce(F.get(c, i - 1)["stop"], F.lit(0)).alias("start"), F.coalesce(F.get(c, i)["start"], n).alias("stop")))))
    pieces = texts_at(F.col("body"), kept)
    text = F.when(F.size("cuts") > 0, F.array_join(pieces, mark)).otherwise(F.col("body"))
    return clean.select(*(text.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns))
