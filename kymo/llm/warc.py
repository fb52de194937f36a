"""WARC archives as seekable Zstandard bundles.

A bundle is a row of independent frames, each of some records, then a skippable frame with the seek table (the public
seekable format: compressed and decompressed size of each frame, a footer with a magic number). An index maps each record
to its frame and the offset inside the decompressed frame. Bundles are written by the tasks into the shared folder, each
under a name of its own that is put in place by a rename, so a task that runs again leaves one whole bundle.

Of records with equal payloads of ``LEAST`` bytes or more the one with the largest id is the response; the others revisit
it. A revisit has no payload; its HTTP header keeps the payload's length, its WARC header the digest.

Cases: a null payload is empty; smaller payloads are always responses; payloads equal by SHA-1 and length are equal; rows
with one id are records of their own, a null id is always a response; an empty table makes no bundle and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, shared_dir, table, utf8, written

LEAST = 1000
FRAME_BYTES = 1 << 18
#: Compressed bytes of archives that a task reads back.
READ_BYTES = 1 << 24
#: Fixed values of the public seekable format: magic numbers of the skippable frame and of the seek table's footer.
_SKIPPABLE, _FOOTER = 0x184D2A5E, 0x8F92EAB1
#: Groups of equal payloads are dealt to so many tasks each.
SALTS = 32
_CRLF = b"\r\n"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return (pafs.LocalFileSystem(), urlparse(uri).path) if urlparse(uri).scheme in ("", "file") else pafs.FileSystem.from_uri(uri)


def record(page_id: int, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC record; ``digest``: the payload's SHA-1 in hex."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {''.join((url or '').split())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + _CRLF * 2 + block + _CRLF * 2


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The record that begins at ``at``: its header, its block, and where the next begins."""
    end = data.index(_CRLF * 2, at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record here")
    head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    begin = end + 4
    stop = begin + int(head["content-length"])
    if data[stop : stop + 4] != _CRLF * 2:
        raise ValueError("the record doesn't end where its header says")
    return head, data[begin:stop], stop + 4


class BundleWriter:
    """Frames of records, and the seek table behind them. ``places`` gets (id, frame, offset in the frame) of each record."""

    def __init__(self, out):
        self.out, self.frames, self.held, self.size, self.places = out, [], [], 0, []
        self.pack = zstandard.ZstdCompressor(level=3).compress

    def add(self, page_id: int, data: bytes) -> None:
        self.places.append((page_id, len(self.frames), self.size))
        self.held.append(data)
        self.size += len(data)
        if self.size >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.held:
            packed = self.pack(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, _FOOTER)
        self.out.write(struct.pack("<II", _SKIPPABLE, len(body)) + body)


def seek_table(file, size: int) -> list[tuple[int, int, int]]:
    """(begin, compressed size, size) of each frame, from the end of a bundle."""
    file.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", file.read(9))
    if magic != _FOOTER:
        raise ValueError("no seek table")
    file.seek(size - 9 - 8 * n)
    raw, out, at = file.read(8 * n), [], 0
    for packed, plain in struct.iter_unpack("<II", raw):
        out.append((at, packed, plain))
        at += packed
    return out


def roles(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = LEAST) -> DataFrame:
    """(id, ``digest``, ``size``, ``refers_to``) of each row, written. Only digests and ids are shuffled; large groups are salted."""
    raw = utf8(payload_col)
    marked = written(pages.select(F.col(id_col), F.sha1(raw).alias("digest"), F.length(raw).cast("long").alias("size")), "digests")
    shared = marked.filter(F.col("size") >= least).groupBy("digest", "size").agg(F.max(id_col).alias("response"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    shared = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = marked.withColumn("salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))
    refers = F.when(F.col("response") != F.col(id_col), F.col("response"))
    return written(salted.join(shared, ["digest", "size", "salt"], "left").select(id_col, "digest", "size", refers.alias("refers_to")), "roles")


def write_bundles(pages: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", least: int = LEAST) -> DataFrame:
    """Write every row as a record; gives the index (``bundle``, id, ``frame``, ``offset``, ``packed``: bytes of a frame, at its first record)."""
    key = F.xxhash64(id_col, "digest").alias("key")
    known = roles(pages, id_col, payload_col, least).select(key, "digest", "size", "refers_to").dropDuplicates(["key", "digest"])
    raw = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string").alias("url"), utf8(payload_col).alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("key", key)
    rows = raw.join(known, ["key", "digest"]).select(id_col, "url", "payload", "digest", "size", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/{TaskContext.get().partitionId():06d}.warc.zst"
        fs, path = filesystem(name)
        fs.create_dir(os.path.dirname(path), recursive=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        n = 0
        with fs.open_output_stream(part) as out:
            bundle = BundleWriter(out)
            for b in batches:
                for page_id, url, payload, digest, size, refers in zip(*(b.column(k) for k in range(6)), strict=True):
                    refers = refers.as_py()
                    bundle.add(page_id.as_py(), record(page_id.as_py(), url.as_py(), b"" if refers is not None else payload.as_py(), digest.as_py(), size.as_py(), refers))
                    n += 1
            bundle.close()
        if not n:
            fs.delete_file(part)
            return
        fs.move(part, path)
        ids, frames, offsets = zip(*bundle.places, strict=True)
        packed = [0 if at else bundle.frames[k][0] for k, at in zip(frames, offsets, strict=True)]
        yield batch(f"bundle string, {id_col} long, frame int, offset long, packed long", [[name] * n, ids, frames, offsets, packed])

    return rows.mapInArrow(run, f"bundle string, `{id_col}` long, frame int, offset long, packed long")


def read_bundles(index: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Every record of the bundles of an index, read frame by frame: id, type, lengths and digests as the archive has them.

    The frames are dealt to a task for each READ_BYTES of them, whatever the size of the index.
    """
    packed = index.agg(F.sum("packed")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-packed // READ_BYTES))
    frames = index.groupBy("bundle", "frame").agg(F.collect_list(F.struct(F.col(id_col).alias("id"), "offset")).alias("places"))  # a frame's records: bounded by FRAME_BYTES
    dealt = frames.repartition(tasks, "bundle", "frame")
    schema = f"`{id_col}` long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, list] = {}
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for bundle, frame, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                fs, path = filesystem(bundle)
                with fs.open_input_file(path) as f:
                    if bundle not in tables:
                        tables[bundle] = seek_table(f, f.size())
                    begin, packed, plain = tables[bundle][frame]
                    f.seek(begin)
                    data = zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=plain)
                for place in places.as_py():
                    head, block, _ = parse(data, place["offset"])
                    http, _, payload = block.partition(_CRLF * 2)
                    size = int(http.rpartition(b"Content-Length:")[2])
                    digest = base64.b32decode(head["warc-payload-digest"].partition(":")[2]).hex()
                    revisit = head["warc-type"] == "revisit"
                    page_id = None if (name := head["warc-record-id"][10:-1]) == "None" else int(name)
                    if page_id != place["id"] or not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
                        raise ValueError(f"record {page_id} of {bundle} isn't what the index says")
                    for column, value in zip(out, (page_id, size, digest, head["warc-type"], int(head["warc-refers-to"][10:-1]) if revisit else None), strict=True):
                        column.append(value)
            yield batch(schema.replace("`", ""), out)

    return dealt.mapInArrow(run, schema)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    index = written(write_bundles(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"), "warc-index")
    return read_bundles(index)


OP7_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND last <> page_id THEN last END AS refers_to
FROM m
"""
