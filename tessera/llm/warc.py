"""Operator 2: a dictionary-compressed WARC writer, and its reader.

Each task writes its records into archives. An archive begins with a skippable frame that holds a Zstandard
dictionary built from records of that archive; every record follows as a frame of its own, compressed with
that dictionary, so that a reader can start at any record. Archives go to a shared folder under names of one
attempt; a manifest of finished archives, written as a table, decides which of them count, so that lost
executors and repeated tasks leave no wrong records.

Of records with equal payloads the one with the largest key is the response and the others are revisits of
it; the groups of equal payloads are found from digests and keys alone and are pre-aggregated, and payloads
are never brought together.

Defined results: a null payload counts as empty; equal payloads include the empty one; repeated rows (same
key and payload) each get a record, all of the same type and under the same record id; a null key is smaller
than every other key; urls read back as they were, null, empty or with line ends. Any other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, shared_dir, ship

#: Magic numbers of a skippable frame that holds a dictionary, and of the other frames.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
#: An archive is closed at so many bytes of records before compression. The dictionary is built from the records at its start.
ARCHIVE_BYTES = 64 << 20
SAMPLE_BYTES = 2 << 20
DICTIONARY_BYTES = 64 << 10
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


#: Says that a target is written with percent signs and line ends escaped, so that it reads back as it was.
ESCAPED = "X-Target-URI-Escaped"
_ESCAPES = {"%": "%25", "\r": "%0D", "\n": "%0A"}


def _target(url: str | None) -> list[str]:
    """The header of a target, none for null; one that would break the line is escaped."""
    if url is None:
        return []
    if not any(c in url for c in "\r\n") and url == url.strip(" "):
        return ["WARC-Target-URI: " + url]
    return ["WARC-Target-URI: <" + "".join(_ESCAPES.get(c, c) for c in url) + ">", f"{ESCAPED}: 1"]


def _url(named: dict) -> str | None:
    found = named.get("WARC-Target-URI")
    if found is None or ESCAPED not in named:
        return found
    return re.sub("%(25|0D|0A)", lambda m: {"25": "%", "0D": "\r", "0A": "\n"}[m[1]], found[1:-1])


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC 1.1 record. A revisit keeps the headers of the answer and no payload."""
    head = HTTP % len(payload)
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if key is None else key}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *_target(url),
        "WARC-Payload-Digest: sha1:" + payload_digest(payload),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines[2:2] = [f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Key, type, digest, size and payload (None for a revisit) of a record. The payload is checked against its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    named = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(named["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = named["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = named["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError("a payload differs from its digest")
    key = lambda x: int(y) if (y := named[x][len("<urn:page:") : -1]) else None
    return {"key": key("WARC-Record-ID"), "url": _url(named), "type": named["WARC-Type"], "digest": digest, "size": size, "payload": None if revisit else payload, "refers_to": key("WARC-Refers-To") if revisit else None}


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; where there are too few records to train one, their ends as a raw one."""
    import zstandard

    total = sum(map(len, records))
    if len(records) >= 16 and total >= 16 * 1024:
        try:
            return zstandard.train_dictionary(min(size, total // 8), records).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(r[:4096] for r in records[:16])[-size:] or b"WARC/1.1\r\n"


def write_archive(out, records: list[bytes], level: int = 3) -> None:
    """The skippable frame with the dictionary, then a frame for each record."""
    import zstandard

    sample, size = [], 0
    for r in records:
        sample.append(r)
        size += len(r)
        if size >= SAMPLE_BYTES:
            break
    raw = build_dictionary(sample)
    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
    squeeze = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw))
    for r in records:
        out.write(squeeze.compress(r))


def read_archive(source) -> Iterator[bytes]:
    """The records of an archive, read frame by frame."""
    import zstandard

    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame")
    known = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(source.read(size)))
    rest = b""
    while True:
        more = rest or source.read(1 << 20)
        if not more:
            return
        frame, out = known.decompressobj(), []
        while True:
            out.append(frame.decompress(more))
            if frame.eof:
                rest = frame.unused_data
                break
            more = source.read(1 << 20)
            if not more:
                raise ValueError("a record is cut off")
        yield b"".join(out)


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def with_types(pages: DataFrame, key: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """key, digest and refers_to of the rows that revisit another. Only keys and digests are shuffled."""
    keys = pages.select(F.col(key).alias("k"), F.sha1(payload).alias("d"), F.octet_length(payload).alias("n")).filter(F.col("n") >= min_bytes)
    firsts = keys.groupBy("d").agg(F.max("k").alias("refers_to"), F.count("*").alias("many")).filter("many > 1").drop("many")
    return keys.join(firsts, "d").filter("k IS NULL AND refers_to IS NOT NULL OR k < refers_to").select("k", "d", "refers_to").distinct()


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write a record for each row below ``folder`` and return the manifest: path and number of records of each archive."""
    spark = pages.sparkSession
    ship(spark)
    base = pages.select(F.col(key).cast("long").alias("k"), F.col(url).cast("string").alias("u"), F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary").alias("p"))
    revisits = with_types(base, "k", "p", min_bytes).withColumn("revisit", F.lit(True)).withColumnRenamed("k", "rk").withColumnRenamed("d", "rd")
    typed = base.withColumn("d", F.sha1("p")).join(revisits, F.col("k").eqNullSafe(F.col("rk")) & (F.col("d") == F.col("rd")), "left")
    typed = typed.select("k", "u", "p", "refers_to", F.coalesce("revisit", F.lit(False)).alias("revisit"))

    def run(batches):
        files, top = _place(folder)
        files.create_dir(top, recursive=True)
        held: list[bytes] = []
        size = 0

        def close():
            name = f"{top}/{uuid.uuid4().hex}.warc.zst"
            with files.open_output_stream(name) as out:
                write_archive(out, held)
            return pa.RecordBatch.from_arrays([pa.array([name.removeprefix(top)]), pa.array([len(held)], pa.int64())], ["path", "records"])

        for batch in batches:
            for k, u, p, r, v in zip(*(batch.column(i) for i in range(5)), strict=True):
                held.append(record(k.as_py(), u.as_py(), p.as_py(), r.as_py(), v.as_py()))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return keep(typed.mapInArrow(run, "path string, records bigint"))


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the archives of a manifest: key, url, type, digest, size, refers_to and payload (null for revisits)."""
    ship(manifest.sparkSession)
    many = max(manifest.sparkSession.sparkContext.defaultParallelism, 1)
    kinds = {"key": pa.int64(), "url": pa.string(), "type": pa.string(), "digest": pa.string(), "size": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def run(batches):
        files, top = _place(folder)
        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, size, seen = [], 0, 0
                with files.open_input_stream(top + path) as source:
                    for data in read_archive(source):
                        rows.append(parse_record(data))
                        seen, size = seen + 1, size + len(data)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], t) for k, t in kinds.items()})
                            rows, size = [], 0
                if seen != records:
                    raise ValueError(f"{path} has {seen} records, not {records}")
                if rows:
                    yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], t) for k, t in kinds.items()})

    return manifest.select("path", "records").repartition(many).mapInArrow(run, "key bigint, url string, type string, digest string, size bigint, refers_to bigint, payload binary")


def compress_bytes(records: list[bytes]) -> bytes:
    """An archive in memory, for tests and small uses."""
    out = io.BytesIO()
    write_archive(out, records)
    return out.getvalue()


def op2_warc(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc/{uuid.uuid4().hex}"
    found = read(write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder), folder)
    return found.select(F.col("key").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to", "url")
