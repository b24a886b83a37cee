"""Zstandard WARC archives: writer and reader.

An archive starts with a skippable frame that holds the dictionary all its
records share; each record is one frame of its own.  Tasks write their archives
straight to the shared folder under names no other attempt uses, and return one
manifest row per finished archive.  Only archives of the written manifest are
read, so files of failed or repeated attempts never count.

Payloads that occur more than once (from ``least`` bytes on) are stored once, in
the record of the smallest id; the others are revisit records that refer to it.
The table of repeated payloads is aggregated on both sides of its shuffle, so a
payload shared by a third of the pages is a single row; it is broadcast only
when counted small.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.llm.textops import slices
from tabsmith.session import scratch_path, written

#: Fixed values of the format: a skippable frame with a dictionary, a frame, a dictionary.
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, b"\x28\xb5\x2f\xfd", b"\x37\xa4\x30\xec"
VERSION = b"WARC/1.1"
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
ID_PREFIX, ID_NULL = "<urn:x-page:", "<urn:x-page>"
#: An archive is closed once it is this large.
ARCHIVE_BYTES = 64 << 20
DICTIONARY_BYTES, DICTIONARY_RECORDS = 16 << 10, 200
BROADCAST_ROWS = 200_000
_CHUNK = 1 << 20


class WarcError(ValueError):
    """An archive or record that breaks the format."""


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a Hadoop-style path."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def record_id(key) -> str:
    return ID_NULL if key is None else f"{ID_PREFIX}{quote(str(key), safe='')}>"


def record_key(name: str | None) -> str | None:
    """The id that a record name holds (None for the null id)."""
    if not name or name == ID_NULL:
        return None
    return unquote(name[len(ID_PREFIX):-1])


def make_record(key, uri: str | None, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One response record, or a revisit record (``refers_to``: name of the response) without the payload."""
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))
    block = http if refers_to else http + payload
    head = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", record_id(key)),
            ("WARC-Date", date)]
    if uri is not None:
        head.append(("WARC-Target-URI", quote(uri, safe="!#$%&'()*+,/:;=?@[]~")))
    if refers_to:
        head += [("WARC-Refers-To", refers_to),
                 ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"),
             ("Content-Length", str(len(block)))]
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in head)
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers and payload of one record; raises WarcError for a broken one."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or lines[0] != VERSION:
        raise WarcError("no WARC header")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon:
            raise WarcError(f"header line without a colon: {name[:80]!r}")
        headers[name] = value.strip()
    for name in NEEDED:
        if name not in headers:
            raise WarcError(f"{name} is missing")
    if not headers["Content-Length"].isdigit():
        raise WarcError("Content-Length is no number")
    size = int(headers["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError(f"{headers['WARC-Record-ID']}: block of {len(rest) - 4} bytes, header says {size}")
    http, mark, payload = rest[:size].partition(b"\r\n\r\n")
    declared = [x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    if not mark or len(declared) != 1:
        raise WarcError(f"{headers['WARC-Record-ID']}: no HTTP header")
    n = int(declared[0].partition(b":")[2])
    digest = headers.get("WARC-Payload-Digest", "").removeprefix("sha256:")
    if headers["WARC-Type"] == "response":
        if len(payload) != n or hashlib.sha256(payload).hexdigest() != digest:
            raise WarcError(f"{headers['WARC-Record-ID']}: payload does not match its length or digest")
    elif headers["WARC-Type"] != "revisit" or payload or "WARC-Refers-To" not in headers:
        raise WarcError(f"{headers['WARC-Record-ID']}: neither a response nor a revisit")
    return {"headers": headers, "payload": payload, "payload_bytes": n, "digest": digest}


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary from the first records of an archive; too few for training: their raw bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except (zstandard.ZstdError, ValueError):
        raw = b"".join(samples)[-DICTIONARY_BYTES:].ljust(8, b"\n")
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def load_dictionary(stream) -> zstandard.ZstdCompressionDict:
    """The dictionary in the leading skippable frame, itself compressed or not."""
    head = stream.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != SKIPPABLE:
        raise WarcError("the archive does not start with a dictionary frame")
    size = struct.unpack("<I", head[4:])[0]
    data = stream.read(size)
    if len(data) != size:
        raise WarcError("the dictionary frame is cut off")
    if data[:4] == FRAME:
        data = zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 26)
    kind = zstandard.DICT_TYPE_FULLDICT if data[:4] == DICTIONARY else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(data, dict_type=kind)


def read_frames(stream) -> Iterator[bytes]:
    """The content of every frame after the dictionary, one at a time."""
    plan = zstandard.ZstdDecompressor(dict_data=load_dictionary(stream))
    data = stream.read(_CHUNK)
    while data:
        one, out = plan.decompressobj(), []
        while True:
            out.append(one.decompress(data))
            if one.eof:
                data = one.unused_data or stream.read(_CHUNK)
                break
            data = stream.read(_CHUNK)
            if not data:
                raise WarcError("the last frame is cut off")
        yield b"".join(out)


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
                   body_col: str = "html", least: int = 100, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write one record per page; returns the manifest (archive, n_records, n_bytes).

    * Null bodies are empty, null urls leave the target header out.
    * Rows that share the smallest id of a payload are all responses; null ids
      are never the smallest unless all are null, then all are responses.
    * Repeated rows get a record each.  Other columns are ignored.  No pages:
      an empty manifest.
    """
    folder = folder or scratch_path(pages.sparkSession, "archives")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"),
                        F.encode(F.coalesce(F.col(body_col), F.lit("")), "UTF-8").alias("body"))
    rows = rows.select("*", F.sha2("body", 256).alias("digest"))
    firsts = written(rows.filter(F.octet_length("body") >= least).groupBy("digest")
                     .agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "repeats")
    if firsts.count() <= BROADCAST_ROWS:
        firsts = F.broadcast(firsts)
    rows = rows.join(firsts, "digest", "left").select(
        "id", "url", "body", "digest",
        F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers"))

    def write(batches):
        store, base = open_folder(folder)
        store.create_dir(base, recursive=True)
        out = plan = None
        done, records, size = [], 0, 0
        for batch in batches:
            for part in slices(batch, "body"):
                made = [make_record(r["id"], r["url"], r["body"], r["digest"],
                                    None if r["refers"] is None else record_id(r["refers"]), date)
                        for r in part.to_pylist()]
                if out is None and made:
                    name = f"{folder}/{uuid.uuid4().hex}.warc.zst"
                    out = store.open_output_stream(f"{base}/{name.rpartition('/')[2]}", compression=None)
                    words = train(made[:DICTIONARY_RECORDS])
                    plan = zstandard.ZstdCompressor(level=3, dict_data=words, write_content_size=True)
                    kept = zstandard.ZstdCompressor(level=3).compress(words.as_bytes())
                    size = out.write(struct.pack("<II", SKIPPABLE, len(kept)) + kept)
                    records = 0
                for one in made:
                    size += out.write(plan.compress(one))
                records += len(made)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((name, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, records, size))
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()),
             pa.array([d[2] for d in done], pa.int64())], ["archive", "n_records", "n_bytes"])

    return written(rows.mapInArrow(write, "archive string, n_records long, n_bytes long"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """All records of the archives in ``manifest`` (column ``archive``).

    Returns ``record_id``, ``type``, ``uri``, ``refers_to``, ``payload_digest``,
    ``payload_bytes`` (of the full payload, also for revisits) and ``payload``
    (binary, empty for revisits).  Ids are given back as text, null as null.
    A broken archive or record raises WarcError.
    """
    def read(batches):
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                store, path = open_folder(name)
                rows, size = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for data in read_frames(stream):
                        r = parse_record(data)
                        h = r["headers"]
                        rows.append((record_key(h["WARC-Record-ID"]), h["WARC-Type"],
                                     unquote(h["WARC-Target-URI"]) if "WARC-Target-URI" in h else None,
                                     record_key(h.get("WARC-Refers-To")), r["digest"], r["payload_bytes"], r["payload"]))
                        size += len(data)
                        if size > _CHUNK:
                            yield out(rows)
                            rows, size = [], 0
                if rows:
                    yield out(rows)

    names = ["record_id", "type", "uri", "refers_to", "payload_digest", "payload_bytes", "payload"]
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]

    def out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    n = max(1, min(4096, manifest.count()))
    return manifest.select("archive").repartition(n).mapInArrow(
        read, "record_id string, type string, uri string, refers_to string, payload_digest string, "
              "payload_bytes long, payload binary")
