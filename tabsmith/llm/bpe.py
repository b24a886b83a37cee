"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The frequent words of the corpus (counted over all documents) are merged once
and compiled, with their token ids as outputs, into a minimal acyclic
transducer: words that end alike share states, outputs stand on the arcs and
are pulled towards the start.  The automaton is one flat file in the shared
folder; Spark ships it to every executor, where tasks memory-map it.  A word is
looked up by walking arcs; a word that the automaton lacks is merged exactly.
Both give the same ids, so the lexicon's size only changes speed.

The tokenizer is read from a ``tokenizers`` JSON file: NFC, white space, lower
case, the pattern that picks words, byte letters, ranked merges with an
end-of-word suffix, and added tokens that are cut from the raw text first.
"""

from __future__ import annotations

import heapq
import json
import mmap
import re
import struct
import unicodedata
import uuid
from array import array
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.llm.textops import slices
from tabsmith.session import scratch_path, written

#: Fixed value: the pattern of words for which a faster form is known.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE = regex.compile(r"\s")
LETTER = re.compile(r"[^\W\d_]")
NO_WORD = 0xFFFFFFFF
#: Words of the lexicon; all others are merged when they occur.
LEXICON_WORDS = 131_072
#: Longer words never enter the lexicon.
LEXICON_CHARS = 64
#: Words outside the lexicon that a task remembers before it starts anew.
REMEMBERED = 100_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 as is, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Tokenizer:
    """Pieces, merges and strings of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): r for r, m in enumerate(model["merges"])}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(split, regex.V0)
        self.cut = regex.compile("(" + "|".join(
            regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.letters = byte_letters()
        # the standard library's classes agree on texts without these characters, and are faster
        self.plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+") if split == PATTERN else None
        odd = [c for c in map(chr, range(0x250)) if unicodedata.category(c) in ("Nl", "No")
               or c.isspace() != bool(SPACE.match(c)) or bool(LETTER.match(c)) != unicodedata.category(c).startswith("L")]
        self.odd = re.compile("[" + re.escape("".join(odd)) + "\u0250-\U0010ffff]")

    def pieces(self, text: str) -> list[str]:
        """Words of a text in order; an added token is returned as a 1-tuple of its id."""
        if self.cut is None or not any(t in text for t in self.added):
            return self._words(text)
        out: list = []
        for part in self.cut.split(text):
            if part in self.added:
                out.append((self.added[part],))
            elif part:
                out.extend(self._words(part))
        return out

    def _words(self, text: str) -> list[str]:
        # character-wise lower case: no final sigma; white space never is part of a piece
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if self.plain and not self.odd.search(text):
            return self.plain.findall(text)
        return self.pattern.findall(text)

    def merge(self, word: str) -> list[int]:
        """Token ids of one word: the lowest ranked pair is merged first, the leftmost of equals."""
        tokens = [self.letters[b] for b in word.encode("utf-8")]
        tokens[-1] += self.suffix
        n = len(tokens)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            r = self.ranks.get((tokens[i], tokens[i + 1]))
            if r is not None:
                heap.append((r, i, tokens[i], tokens[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if j >= n or tokens[i] != a or tokens[j] != b:
                continue                              # one of the two was merged meanwhile
            tokens[i], tokens[j] = a + b, ""
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n:
                    r = self.ranks.get((tokens[x], tokens[y]))
                    if r is not None:
                        heapq.heappush(heap, (r, x, tokens[x], tokens[y]))
        return [self.vocab[t] for t in tokens if t]


@lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


@lru_cache(maxsize=4)
def token_strings(path: str) -> pa.Array:
    """The string of every token id."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    out: list = [None] * (max(ids.values()) + 1)
    for text, i in ids.items():
        out[i] = text
    return pa.array(out, pa.string())


def _common(a: tuple, b: tuple) -> int:
    n = 0
    while n < len(a) and n < len(b) and a[n] == b[n]:
        n += 1
    return n


class _State:
    __slots__ = ("arcs", "final", "number")

    def __init__(self):
        self.arcs: dict[int, list] = {}      # byte -> [target, output]
        self.final: tuple | None = None      # output at the end of a word
        self.number = -1

    def key(self) -> tuple:
        return self.final, tuple((b, t.number, o) for b, (t, o) in sorted(self.arcs.items()))


def compile_lexicon(words: dict[str, list[int]]) -> bytes:
    """The minimal transducer of ``words`` as one flat file.

    Words come in byte order; the states of the last word's path stay open and
    are replaced by an equal state, if there is one, once the next word leaves
    them.  Outputs are id sequences; what the words below an arc have in common
    moves to the arc.
    """
    known: dict[tuple, _State] = {}
    order: list[_State] = []

    def close(path: list[_State], letters: bytes, keep: int) -> None:
        for d in range(len(path) - 1, keep, -1):
            state = path.pop()
            same = known.get(k := state.key())
            if same is None:
                state.number = len(order)
                order.append(state)
                known[k] = same = state
            path[-1].arcs[letters[d - 1]][0] = same

    path, last = [_State()], b""
    for raw, ids in sorted((w.encode("utf-8"), tuple(ids)) for w, ids in words.items()):
        shared = _common(tuple(last), tuple(raw))
        close(path, last, shared)
        rest = ids
        for d in range(shared):
            arc = path[d].arcs[raw[d]]
            n = _common(arc[1], rest)
            if pushed := arc[1][n:]:
                below = path[d + 1]
                for a in below.arcs.values():
                    a[1] = pushed + a[1]
                if below.final is not None:
                    below.final = pushed + below.final
                arc[1] = arc[1][:n]
            rest = rest[n:]
        for d in range(shared, len(raw)):
            path.append(_State())
            path[d].arcs[raw[d]] = [path[d + 1], rest]
            rest = ()
        path[-1].final = rest if path[-1].final is None else path[-1].final
        last = raw
    close(path, last, 0)
    root = path[0]
    root.number = len(order)
    order.append(root)

    outputs: dict[tuple, int] = {(): 0}
    pool: list[int] = [0]

    def place(ids: tuple) -> int:
        if ids not in outputs:
            outputs[ids] = len(pool)
            pool.extend((len(ids), *ids))
        return outputs[ids]

    first, finals, labels, targets, emits = [0], [], bytearray(), [], []
    for s in order:
        finals.append(NO_WORD if s.final is None else place(s.final))
        for b, (t, o) in sorted(s.arcs.items()):
            labels.append(b)
            targets.append(t.number)
            emits.append(place(o))
        first.append(len(labels))
    pad = bytes(-len(labels) % 4)
    head = struct.pack("<4sIIII", b"MAT1", len(order), len(labels), len(pool), len(pad))
    return b"".join([head, *(struct.pack(f"<{len(x)}I", *x) for x in (first, finals, targets, emits, pool)),
                     bytes(labels), pad])


class Lexicon:
    """A compiled transducer, memory-mapped."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        magic, states, arcs, pool, _ = struct.unpack_from("<4sIIII", self.map)
        if magic != b"MAT1":
            raise ValueError(f"{path} holds no lexicon")
        words, at = np.frombuffer(self.map, np.uint32, 2 * states + 1 + 2 * arcs + pool, 20), 0
        cuts = []
        for n in (states + 1, states, arcs, arcs, pool):
            cuts.append(words[at:at + n])
            at += n
        first, self.finals, self.targets, self.emits, self.pool = cuts
        labels = np.frombuffer(self.map, np.uint8, arcs, 20 + 4 * at)
        self.keys = np.repeat(np.arange(states, dtype=np.int64), np.diff(first.astype(np.int64))) * 256 + labels
        self.root = states - 1

    def find(self, words: list[str]) -> list[bytes | None]:
        """Token ids (int32 bytes) of each word, None where the lexicon lacks it.

        All words walk the automaton together, one byte a step; an arc is found
        by its state and byte in the sorted table of arcs.
        """
        raw = [w.encode("utf-8") for w in words]
        size = np.array([len(r) for r in raw], np.int64)
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        data = np.frombuffer(b"".join(raw) + b"\0", np.uint8)
        state = np.full(len(raw), self.root, np.int64)
        alive, who, pieces = np.arange(len(raw)), [], []
        for step in range(int(size.max(initial=0))):
            alive = alive[size[alive] > step]
            key = state[alive] * 256 + data[start[alive] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[arc] == key
            state[alive[~known]] = -1
            alive, arc = alive[known], arc[known]
            state[alive] = self.targets[arc]
            who.append(alive)
            pieces.append(self.emits[arc])
        done = np.flatnonzero(state >= 0)
        done = done[self.finals[state[done]] != NO_WORD]
        who.append(done)
        pieces.append(self.finals[state[done]])
        found = np.zeros(len(raw), bool)
        found[done] = True
        who, pieces = np.concatenate(who), np.concatenate(pieces).astype(np.int64)
        used = found[who] & (pieces > 0)
        order = np.argsort(who[used], kind="stable")
        who, pieces = who[used][order], pieces[used][order]
        n = self.pool[pieces].astype(np.int64)
        ends = np.cumsum(n)
        ids = self.pool[np.repeat(pieces + 1 - (ends - n), n) + np.arange(n.sum())].astype(np.int32).tobytes()
        stop = np.cumsum(np.bincount(who, n, len(raw)).astype(np.int64)) * 4
        return [ids[a:b] if f else None for a, b, f in zip([0, *stop[:-1].tolist()], stop.tolist(), found.tolist())]


@lru_cache(maxsize=2)
def _mapped(name: str) -> Lexicon:
    return Lexicon(SparkFiles.get(name))


def word_counts(docs: DataFrame, text_col: str, tokenizer_path: str) -> DataFrame:
    """Occurrences of every word in all texts (word, n); tasks send partial counts."""
    def count(batches):
        t, seen = tokenizer(tokenizer_path), Counter()

        def out():
            short = [w for w in seen if len(w) <= LEXICON_CHARS and type(w) is str]
            return pa.RecordBatch.from_arrays([pa.array(short, pa.string()),
                                               pa.array([seen[w] for w in short], pa.int64())], ["word", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(t.pieces(text))
                if len(seen) > REMEMBERED:
                    yield out()
                    seen.clear()
        yield out()

    return (docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def build_lexicon(docs: DataFrame, text_col: str, tokenizer_path: str, words: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words of all texts and ship the file to the executors;
    returns its name there.

    All words from the smallest count on that leaves at most ``words`` enter; the
    count is found from how many words have each count, so the driver gets the
    lexicon's words and nothing else.
    """
    spark = docs.sparkSession
    t = tokenizer(tokenizer_path)
    counts = written(word_counts(docs, text_col, tokenizer_path).filter("n > 1"), "counts")
    least, total = 1 << 62, 0
    for r in counts.groupBy("n").agg(F.count("*").alias("m")).orderBy(F.desc("n")).limit(words).collect():
        total += r.m
        if total > words:
            break
        least = r.n
    top = counts.filter(F.col("n") >= least)
    data = compile_lexicon({r.word: t.merge(r.word) for r in top.collect()})
    name = f"lexicon-{uuid.uuid4().hex}.mat"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_path(spark, 'lexicon')}/{name}")
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(where.toString())
    return name


_SEEN: dict[str, tuple[dict, dict]] = {}


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", out_col: str = "ids",
           keep: list[str] | None = None, words: int = LEXICON_WORDS) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) and the token ids of ``text_col`` in
    ``out_col`` (array of int).

    Null and empty texts have no ids.  Repeated rows and nulls in other columns
    are kept; a column named ``out_col`` is replaced.  Empty input: no rows.
    Special tokens are neither added nor skipped: their strings in a text give
    their ids.
    """
    name = build_lexicon(docs, text_col, tokenizer_path, words)
    kept = [c for c in (docs.columns if keep is None else keep) if c != out_col]
    plain = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(f"`{text_col}`").alias("text"))

    def run(batches):
        t, lexicon = tokenizer(tokenizer_path), _mapped(name)
        if name not in _SEEN:
            _SEEN.clear()
            _SEEN[name] = {}, {}
        seen, hits = _SEEN[name]         # word -> its ids as int32 bytes; those of the lexicon
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t.pieces(text) if text else [] for text in part.column("text").to_pylist()]
                if len(seen) > len(hits) + REMEMBERED:
                    seen.clear()
                    seen.update(hits)    # words of the lexicon stay: it bounds them
                new = set().union(*texts).difference(seen)
                plain_words = [w for w in new if type(w) is str]
                for w, got in zip(plain_words, lexicon.find(plain_words)):
                    if got is None:
                        seen[w] = array("i", t.merge(w)).tobytes()
                    else:
                        seen[w] = hits[w] = got
                seen.update((w, array("i", w).tobytes()) for w in new if type(w) is tuple)
                ids = [b"".join(map(seen.__getitem__, pieces)) for pieces in texts]
                ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
                values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)],
                    ["row", "ids"])

    schema = plain.select("row").schema.add("ids", T.ArrayType(T.IntegerType()))
    done = plain.mapInArrow(run, schema)
    return done.select("row.*", F.col("ids").alias(out_col))


def decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the text of the token ids in ``ids_col``: the tokens joined by one blank
    (the file names no decoder).  Null ids give null, no ids an empty text; a column
    named ``out_col`` is replaced, all other columns and rows stay."""
    kept = [c for c in df.columns if c != out_col]
    plain = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(f"`{ids_col}`").alias("ids"))

    def run(batches):
        strings = token_strings(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = part.column("ids")
                tokens = pc.list_flatten(ids)
                ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())])
                text = pc.binary_join(pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), strings.take(tokens)), " ")
                text = pc.if_else(pc.is_null(ids), pa.scalar(None, pa.string()), text)
                yield pa.RecordBatch.from_arrays([part.column("row"), text], ["row", "text"])

    return (plain.mapInArrow(run, plain.select("row").schema.add("text", "string"))
            .select("row.*", F.col("text").alias(out_col)))
