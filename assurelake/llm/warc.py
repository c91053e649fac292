"""WARC archives in Zstandard: writer with deduplicated payloads, and the validating reader.

An archive starts with a skippable frame that holds the dictionary, then has one frame per record.
The writer trains the dictionary from the archive's own first records. The reader loads it from that
frame, decodes one frame at a time, and checks the version line, the headers that must be there, the
length of the block, the end of the record and the digest of the payload.

Archives are bounded in size, written under a temporary name by the task that has the rows and
renamed when complete. Rows are sorted within a task, so a task that runs again writes the same
archives under the same names, and the folder holds whole archives of every row once.

Defined results: a null html is an empty payload. A null url leaves out the target URI. Records with
equal payloads of at least `min_bytes` revisit the one with the largest id; rows that repeat that id
are all responses, as are rows with a null id. An empty table makes no archive and reads as no rows.
Records of other kinds (warcinfo, request, ...) are read too: without an HTTP head the block is the
payload, without a digest header the digest is computed, and an id that names no page is a null.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import urllib.parse
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assurelake.llm.common import cut, table, work_path

DICTIONARY_MAGIC = 0x184D2A5D
#: Payload bytes of an archive, before compression, and the records that its dictionary is trained on.
ARCHIVE_BYTES, TRAINED_ON, DICTIONARY_BYTES = 32 << 20, 200, 16 << 10
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
RECORDS_SCHEMA = "archive string, page_id long, type string, target_uri string, refers_to long, payload_digest string, payload_bytes long"


def _uri(url: str) -> str:
    """The url with white space and control characters escaped, so that it stays one header line."""
    return "".join(urllib.parse.quote(c) if c <= " " or c == "\x7f" else c for c in url)


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit without it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_uri(url)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """A whole archive of the records."""
    sample = [r[:4096] for r in records[:TRAINED_ON]]
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes() if len(sample) >= 16 else b""
    except zstandard.ZstdError:  # too little to train on
        trained = b""
    trained = trained or b"".join(sample)[:DICTIONARY_BYTES]
    packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True)
    return struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained + b"".join([packer.compress(r) for r in records])


def frames(content: bytes) -> Iterator[bytes]:
    """The decoded frames after the dictionary frame."""
    magic, size = struct.unpack_from("<II", content) if len(content) >= 8 else (0, 0)
    if magic != DICTIONARY_MAGIC or len(content) < 8 + size:
        raise ValueError("no dictionary frame at the start of the archive")
    words = content[8 : 8 + size]
    if words[:4] == zstandard.FRAME_HEADER:  # a dictionary may itself be compressed
        words = zstandard.ZstdDecompressor().decompress(words)
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
    at, view = 8 + size, memoryview(content)
    while at < len(content):
        frame, out = unpacker.decompressobj(), []
        while not frame.eof:
            if at >= len(content):
                raise ValueError("the last frame is cut short")
            piece = view[at : at + 16384]
            out.append(frame.decompress(piece))
            at += len(piece) - len(frame.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> dict:
    """Headers and payload of one record; ValueError if it isn't a valid one."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"no version line: {lines[0][:40]!r}")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"no header: {line[:40]!r}")
        fields[name.strip().lower()] = value.strip()
    if lacking := {"warc-type", "warc-record-id", "warc-date", "content-length"} - fields.keys():
        raise ValueError(f"headers are missing: {sorted(lacking)}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"the block has {len(rest) - 4} bytes, Content-Length is {length}")
    # a block of HTTP has a head and a payload; any other block is the payload
    kind, block = fields["warc-type"], rest[:length]
    http, _, payload = block.partition(b"\r\n\r\n") if fields.get("content-type", "").lower().startswith("application/http") else (b"", b"", block)
    stated = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    own = kind != "revisit"  # a revisit leaves out the payload that its head is about
    if own and stated not in (None, len(payload)):
        raise ValueError(f"the payload of {fields['warc-record-id']} has {len(payload)} bytes, its head says {stated}")
    digest = _sha1(fields["warc-payload-digest"]) if "warc-payload-digest" in fields else None
    if own and digest not in (None, hashlib.sha1(payload).hexdigest()):
        raise ValueError(f"the payload of {fields['warc-record-id']} doesn't match its digest")
    return {
        "page_id": _page(fields["warc-record-id"]), "type": kind, "target_uri": fields.get("warc-target-uri"), "refers_to": _page(fields.get("warc-refers-to", "")),
        "payload_digest": digest or (hashlib.sha1(payload).hexdigest() if own else None), "payload_bytes": len(payload) if own else stated, "payload": payload if own else None,
    }


def _page(record_id: str) -> int | None:
    """The page of a record id as the writer makes them; null for ids of another kind."""
    m = re.fullmatch(r"<urn:page:(-?[0-9]+)>", record_id)
    return int(m[1]) if m else None


def _sha1(labelled: str) -> str | None:
    """A labelled SHA-1, in base 32 or hexadecimal digits, as the latter; null for another algorithm."""
    name, _, value = labelled.partition(":")
    if name.lower() != "sha1":
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def revisits(pages: DataFrame, id_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """(id, digest, refers_to) of the rows whose payload a row with a larger id repeats."""
    payload = F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b""))
    narrow = pages.select(F.col(id_col).cast("long").alias("_id"), F.sha1(payload).alias("_digest"), F.octet_length(payload).alias("_n"))
    narrow = narrow.filter((F.col("_n") >= min_bytes) & F.col("_id").isNotNull()).select("_id", "_digest")
    groups = narrow.groupBy("_digest").agg(F.max("_id").alias("_last"), F.count("*").alias("_c")).filter("_c > 1").select("_digest", "_last")
    # a written table, so that both sides of the join are scans and Spark can split a hot digest
    return narrow.join(cut(groups, "warc-groups"), "_digest").filter("_id < _last").distinct()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 1000) -> DataFrame:
    """Write a record for each row into archives in `folder` (a URI that all executors share); returns
    the list of archives: path, records, bytes."""
    again = revisits(pages, id_col, html_col, min_bytes)
    payload = F.coalesce(F.encode(F.col(html_col), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), payload.alias("_payload"))
    rows = rows.withColumn("_digest", F.sha1("_payload")).join(again, ["_id", "_digest"], "left")
    # in one order, so that a task that runs again writes the same archives under the same names
    rows = rows.select("_id", "_url", "_digest", "_payload", "_last").sortWithinPartitions("_id", "_url", "_digest")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        seq, kept, size = 0, [], 0

        def flush() -> pa.RecordBatch:
            name = f"{base}/part-{task.partitionId():06d}-{seq:04d}.warc.zst"
            content = archive(kept)
            with store.open_output_stream(f"{name}.{task.taskAttemptId()}.tmp") as out:
                out.write(content)
            store.move(f"{name}.{task.taskAttemptId()}.tmp", name)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(kept)]), pa.array([len(content)])], names=["path", "records", "bytes"])

        for batch in batches:
            for i, url, _, payload, last in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kept.append(record(i, url, payload, last))
                size += len(payload)
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    seq, kept, size = seq + 1, [], 0
        if kept:
            yield flush()

    return cut(rows.mapInArrow(write, "path string, records long, bytes long"), "warc-list")


def read_archives(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """Every record of the archives in `folder`, validated. A damaged archive fails the read."""
    schema = RECORDS_SCHEMA + (", payload binary" if with_payload else "")
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                path, content = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                rows, size = [], 0
                for frame in frames(content):
                    got = parse(frame)
                    if not with_payload:
                        del got["payload"]
                    rows.append(got | {"archive": path})
                    size += len(frame)
                    if size > ARCHIVE_BYTES // 4 or len(rows) >= 5000:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    kinds = {x.strip().split(" ")[0]: types[x.strip().split(" ")[1]] for x in schema.split(",")}

    def out(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds[n]) for n in names], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("path", "content").mapInArrow(read, schema)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a record and read back."""
    folder = work_path(spark, "warc")
    listed = write_archives(table(spark, sf_dir, "pages"), folder)
    columns = ["page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to"]
    if listed.isEmpty():
        return spark.createDataFrame([], RECORDS_SCHEMA).select(*columns)
    return read_archives(spark, folder).select(*columns)


OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS last FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN m.last IS NULL OR m.last = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN m.last IS NULL OR m.last = d.page_id THEN NULL ELSE m.last END AS refers_to
FROM d LEFT JOIN m ON d.payload_digest = m.payload_digest AND d.payload_bytes >= 1000
"""
