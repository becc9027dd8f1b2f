"""Dictionary-compressed WARC archives (operator 2).

Pages with equal payloads are found by their digests alone: of each such group the page with the largest id is a ``response`` and the
others are ``revisit`` records that name it, made from ids, URLs, digests and lengths. The owners of the groups meet the pages
again; up to a counted bound they are broadcast, and then pages are written by the tasks that scan them and no payload
moves. Each task writes archives of about ``archive_bytes`` of payload (or ``ARCHIVE_RECORDS`` records): a Zstandard dictionary is
trained on pieces spread evenly over all bytes of the archive's records and stored in a leading skippable frame (magic
0x184D2A5D), and every record follows whole as a frame of its own.

Archives have names that follow from the task and are moved into place when complete, so a task that runs again
writes the same files. They are written through pyarrow's file systems and read back by Spark's binary reader.

Defined results: a null html is an empty payload, equal to an empty one; of repeated rows (same id and payload)
one is the response if the id is the largest, the one with the alphabetically last URL; null ids are smaller than any other and
read back as null; line breaks in a URL are percent-escaped in the header; an empty table gives no archives and an empty result;
columns besides id, URL and html are ignored. A payload of any length is one record, so a task holds
``archive_bytes`` plus its longest payload.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.workspace import Workspace, few

ARCHIVE_BYTES, ARCHIVE_RECORDS, DICT_BYTES, LEVEL = 16 << 20, 50_000, 32 << 10, 3
#: A dictionary is trained on at most SAMPLES pieces of SAMPLE_BYTES.
SAMPLE_BYTES, SAMPLES = 4 << 10, 512
DICT_MAGIC = 0x184D2A5D
WARC_DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "archive string, records bigint, payload_bytes bigint, archive_bytes bigint, dictionary_bytes bigint"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}/{digest}')}>"


def record(page_id, url: str | None, payload: bytes, digest: str, response: bool, owner, length: int | None = None) -> bytes:
    """One WARC/1.1 record; a revisit carries no payload, only its ``length``."""
    length = len(payload) if length is None else length
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + payload if response else http
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if response else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {WARC_DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {length}",
    ]
    head += [f"X-Page-Id: {page_id}"] if page_id is not None else []
    if not response:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(owner, digest)}"]
        head += [f"X-Refers-To-Page-Id: {owner}"] if owner is not None else []
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> bytes:
    """A dictionary trained on pieces spread evenly over all bytes of the records, or where they are too few, a record's start."""
    import zstandard

    step = max(SAMPLE_BYTES, sum(map(len, records)) // SAMPLES)
    pieces, at = [], 0
    for r in records:  # ``at`` is the next piece's start, counted from the start of ``r``
        while at < len(r):
            pieces.append(r[at : at + SAMPLE_BYTES])
            at += step
        at -= len(r)
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return records[0][:DICT_BYTES]


def write_archive(records: list[bytes]) -> tuple[bytes, int]:
    import zstandard

    raw = build_dictionary(records)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(raw))
    out = io.BytesIO()
    out.write(struct.pack("<II", DICT_MAGIC, len(raw)) + raw)
    for r in records:
        out.write(packer.compress(r))
    return out.getvalue(), len(raw)


def read_archive(data: bytes):
    """Headers (a dict with lower-case names) and block of every record."""
    import zstandard

    magic, size = struct.unpack_from("<II", data)
    if magic != DICT_MAGIC:
        raise ValueError("the archive has no leading dictionary frame")
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    with unpacker.stream_reader(io.BytesIO(data[8 + size :]), read_across_frames=True) as stream:
        lines = io.BufferedReader(stream)
        while version := lines.readline():
            if version != b"WARC/1.1\r\n":
                raise ValueError("not a WARC record")
            head = {}
            while (line := lines.readline()) != b"\r\n":
                name, _, value = line.decode().rstrip("\r\n").partition(": ")
                head[name.lower()] = value
            block = lines.read(int(head["content-length"]))
            lines.read(4)
            yield head, block


def _store(folder: str, name: str, data: bytes) -> None:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    draft = f"{path}/.{name}.{TaskContext.get().taskAttemptId()}"
    with system.open_output_stream(draft) as f:
        f.write(data)
    system.move(draft, f"{path}/{name}")


def _write(folder: str, archive_bytes: int, label: str):
    def run(batches):
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            nonlocal made, held, size
            data, dictionary = write_archive(held)
            name = f"{label}-{part:06d}-{made:05d}.warc.zst"
            _store(folder, name, data)
            row = [[name], [len(held)], [size], [len(data)], [dictionary]]
            made, held, size = made + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array(row[0]), *(pa.array(v, pa.int64()) for v in row[1:])], ["archive", "records", "payload_bytes", "archive_bytes", "dictionary_bytes"])

        for batch in batches:
            for page_id, url, html, sha1, length, owner in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode()
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                response = html is not None
                if response and payload_digest(payload) != digest:
                    raise ValueError("a payload is not what its digest says")
                held.append(record(page_id, url, payload, digest, response, owner, length))
                size += len(payload)
                if size >= archive_bytes or len(held) >= ARCHIVE_RECORDS:
                    yield flush()
        if held:
            yield flush()

    return run


def write_pages(
    pages: DataFrame, ws: Workspace, folder: str, archive_bytes: int = ARCHIVE_BYTES,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """Write every page below ``folder``; gives the manifest, one row per archive."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"))
    keys = rows.groupBy("digest", "id", "url").agg(F.count(F.lit(1)).alias("same"))
    owners = keys.groupBy("digest").agg(F.max(F.struct("id", "url", "same")).alias("top"), F.sum("same").alias("copies"))
    owners = ws.save(owners.filter("copies > 1").select("digest", F.struct("top.id", "top.url").alias("top"), F.col("top.same").alias("same")), "owners")
    met = rows.join(few(owners), "digest", "left")
    own = F.col("top").isNull() | (F.col("id").eqNullSafe(F.col("top.id")) & F.col("url").eqNullSafe(F.col("top.url")))
    met = met.withColumn("own", own).withColumn("repeated", F.col("own") & (F.coalesce("same", F.lit(1)) > 1))
    length, owner = F.octet_length("html").cast("long").alias("length"), F.when(F.col("top").isNull(), F.col("id")).otherwise(F.col("top.id")).alias("owner")
    direct = met.filter(~F.col("repeated")).select("id", "url", F.when(F.col("own"), F.col("html")).alias("html"), "digest", length, owner)
    manifest = ws.save(direct.mapInArrow(_write(folder, archive_bytes, "pages"), MANIFEST), "manifest-pages")
    if owners.filter("same > 1").isEmpty():
        return manifest
    # rows that repeat an owner: one of them is the response, the others revisit it
    again = met.filter("repeated").groupBy("digest", "id", "url").agg(F.first("html").alias("html"), F.count(F.lit(1)).alias("same"))
    again = again.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("same").cast("int"))))
    again = again.select("id", "url", F.when(F.col("n") == 1, F.col("html")).alias("html"), "digest", length, F.col("id").alias("owner"))
    repeats = ws.save(again.mapInArrow(_write(folder, archive_bytes, "repeats"), MANIFEST), "manifest-repeats")
    return manifest.unionByName(repeats)


def _read(batches):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "archive"]
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            cols = [[] for _ in names]
            for head, block in read_archive(data):
                kind, digest = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    if payload_digest(payload) != digest:
                        raise ValueError(f"damaged record in {path}")
                for c, v in zip(cols, (head.get("x-page-id"), int(head["x-payload-length"]), digest, kind, head.get("x-refers-to-page-id"), head["warc-target-uri"], path), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n == "payload_bytes" else pa.string()) for n, c in zip(names, cols, strict=True)], names)


def read_pages(spark: SparkSession, folder: str, id_type: str = "bigint") -> DataFrame:
    """One row per record of the archives below ``folder``; response payloads are checked against their digests."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    schema = "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, target_uri string, archive string"
    read = files.select("path", "content").mapInArrow(_read, schema)
    return read.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))
