"""WARC archives: writing, normalising whole-file gzip to one member a record, and reading by offset.

``write_archives`` puts pages into archives that are one gzip stream each, as many tools wrongly make them.
``normalize`` inflates each such stream once, rewrites every record as a gzip member of its own and gives the index:
offset and length of each member.  ``publish`` writes the result as .warc.gz files with .idx sidecars (a line of offset
and length for each record), and ``read_files`` opens records by the sidecar alone, each by one read of its range.

A file is written under a name of its own and then renamed, so a killed task leaves no half file; names hold the task
attempt, and only the names in publish's result count, which Spark commits: a task that runs again adds files that
nobody reads.  Archives have bounded size, and no record is cut: one longer than that is an archive of its own.

Of pages with equal payloads (equal in SHA-256) of at least 1000 bytes, that with the largest page_id is the response
and the others revisit it.

Rows: a null html has the empty payload; a null or empty url gives a record without target; null page_ids are
responses (or revisit a numbered one); of repeated page_ids with the same payload each row gets a record, and all rows
with the largest id are responses; payloads of any length are kept whole; further columns are ignored; an empty table
gives no archive and an empty table.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, discard, materialize, new_folder, table

LEAST_REVISIT = 1000
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
ID_PREFIX = "urn:shelfmark:page:"
END = b"\r\n\r\n"


def decide(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is null for responses.  Only payloads that occur twice are
    joined, on their SHA-256; Spark splits one with very many pages."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    body = F.encode("html", "utf-8")
    rows = rows.withColumns({"digest": F.sha1(body), "_same": F.unhex(F.sha2(body, 256))})
    twice = rows.where(F.octet_length("html") >= least).groupBy("_same").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null").drop("n")
    return rows.join(twice, "_same", "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))).drop("keeper", "_same")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.0", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{ID_PREFIX}{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url:
        head.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID_PREFIX}{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def parse_record(body: bytes | memoryview, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record that starts at a place."""
    body = bytes(body) if not isinstance(body, bytes) else body
    head_end = body.index(END, at)
    lines = body[at:head_end].decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    start = head_end + 4
    end = start + int(headers["content-length"])
    if body[end : end + 4] != END:
        raise ValueError("a WARC record does not end where its length says")
    return headers, body[start:end], end + 4


def write_archives(decided: DataFrame, most_bytes: int = 8 << 20, level: int = 4, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """(archive, content): archives of about most_bytes before compression, each one single gzip stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size = TaskContext.get().partitionId(), 0, 0
        stream, chunks = zlib.compressobj(level, wbits=31), []

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"shelf-{part:06d}-{number:05d}.warc.gz"]), pa.array([b"".join([*chunks, stream.flush()])], pa.binary())], ["archive", "content"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
                page_id, url, html, digest, refers_to = row
                data = record(page_id, url, html.encode(), digest, refers_to, date)
                chunks.append(stream.compress(data))
                size += len(data)
                if size >= most_bytes:
                    yield close()
                    number, size, stream, chunks = number + 1, 0, zlib.compressobj(level, wbits=31), []
        if size:
            yield close()

    return bounded_batches(decided).select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "archive string, content binary")


def normalize(archives: DataFrame, level: int = 6) -> DataFrame:
    """(archive, content, offsets, lengths): every record a gzip member of its own, and the sidecar index.  A content
    that is already split into members, or into several streams, is read through all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("archive").to_pylist(), batch.column("content").to_pylist()):
                plain = []
                while content:
                    stream = zlib.decompressobj(wbits=31)
                    plain.append(stream.decompress(content) + stream.flush())
                    content = stream.unused_data
                body = b"".join(plain)
                members, at = [], 0
                while at < len(body):
                    _, _, end = parse_record(body, at)
                    packer = zlib.compressobj(level, wbits=31)
                    members.append(packer.compress(body[at:end]) + packer.flush())
                    at = end
                lengths = [len(m) for m in members]
                offsets = [0]
                for n in lengths[:-1]:
                    offsets.append(offsets[-1] + n)
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(members)], pa.binary()), pa.array([offsets[: len(lengths)]], longs), pa.array([lengths], longs)], ["archive", "content", "offsets", "lengths"])

    return archives.mapInArrow(run, "archive string, content binary, offsets array<long>, lengths array<long>")


def _put(store, path: str, data: bytes) -> None:
    """The whole file or none."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part, compression=None) as out:
        out.write(data)
    store.move(part, path)


def publish(normalized: DataFrame, uri: str) -> DataFrame:
    """(archive, bytes, records): archives and sidecars written below a URI that pyarrow's file systems reach from
    every executor.  Materialize the result: its names are the files that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(uri)
        store.create_dir(base, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for name, content, offsets, lengths in zip(*(batch.column(c).to_pylist() for c in ("archive", "content", "offsets", "lengths"))):
                name = f"{name.removesuffix('.warc.gz')}-{attempt}.warc.gz"
                _put(store, f"{base}/{name}", content)
                _put(store, f"{base}/{name}.idx", "".join(f"{a} {n}\n" for a, n in zip(offsets, lengths)).encode())
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(content)], pa.int64()), pa.array([len(offsets)], pa.int64())], ["archive", "bytes", "records"])

    return normalized.mapInArrow(run, "archive string, bytes long, records long")


_FIELDS = {"archive": pa.string(), "offset": pa.int64(), "length": pa.int64(), "page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}


def _number(header: str | None) -> int | None:
    digits = header[len(ID_PREFIX) + 1 : -1] if header else ""
    return int(digits) if digits else None


def _told(member: bytes, where: str) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of one gzip member."""
    headers, block, _ = parse_record(zlib.decompress(member, wbits=31))
    http, _, payload = block.partition(END)
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest, kind = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"{where}: the payload does not match its headers")
    return _number(headers["warc-record-id"]), size, digest, kind, _number(headers.get("warc-refers-to"))


def read_files(published: DataFrame, uri: str) -> DataFrame:
    """(archive, offset, length, page_id, payload_bytes, payload_digest, record_type, refers_to): each record of the
    published archives, found by the sidecar; a response's payload is digested again and must match its header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with store.open_input_stream(f"{base}/{name}.idx", compression=None) as f:
                    index = [tuple(map(int, line.split())) for line in f.read().decode().splitlines()]
                with store.open_input_file(f"{base}/{name}") as f:
                    rows = [(name, at, n, *_told(f.read_at(n, at), f"{name} at {at}")) for at, n in index]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _FIELDS.values())], list(_FIELDS))

    kinds = {pa.string(): "string", pa.int64(): "long"}
    return published.select("archive").mapInArrow(run, ", ".join(f"{k} {kinds[t]}" for k, t in _FIELDS.items()))


def op7_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = new_folder(spark, "warc-files")
    archives = materialize(write_archives(decide(table(spark, sf_dir, "pages"))), "warc")
    published = materialize(publish(normalize(archives), uri), "warc-names", batch_rows=4)  # whole archives
    discard(archives)
    spread = published.repartition(max(1, -(-published.count() // 8)), "archive")
    return read_files(spread, uri).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op7_warc_normaliser": op7_warc_normaliser}
ORACLES = {
    "op7_warc_normaliser": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT *, CASE WHEN strlen(html) >= {LEAST_REVISIT} THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS keeper FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type, nullif(keeper, page_id) AS refers_to FROM k"""
}
