"""WARC writing, reading, and a normaliser of monolithic gzip streams.

Archives are rows (archive, data) of a table, so that any store Spark reaches can hold them; ``export_files`` puts them
into a mounted folder as .warc.gz files with .idx sidecars. The writer makes one gzip stream of a whole archive, as many
crawlers do. The normaliser inflates such a stream once, front to back, rewrites every record as a gzip member of its
own, and gives a sidecar index of member offsets, by which single records can be read; the round trip writes it to files of
its own and reads the records by them.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.session import materialize, scratch_dir

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX_TYPE = "array<struct<offset: bigint, length: bigint, record_id: string, type: string>>"
_INDEX_ARROW = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("type", pa.string())]))


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def page_of(identifier: str) -> int | None:
    text = identifier.rpartition(":")[2].rstrip(">")
    return None if text == "null" else int(text)


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP head only, whose Content-Length is that of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class RecordReader:
    """Splits inflated bytes into whole records, as they come."""

    def __init__(self) -> None:
        self.held = bytearray()

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        """(headers, whole record) of each record that is complete."""
        self.held += data
        at = 0
        while (head := self.held.find(b"\r\n\r\n", at)) >= 0:
            headers = parse_headers(bytes(self.held[at:head]))
            end = head + 4 + int(headers["content-length"]) + 4
            if end > len(self.held):
                break
            yield headers, bytes(self.held[at:end])
            at = end
        del self.held[:at]


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def inflate(data: bytes, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The content of a gzip file of one or many members, in bounded pieces."""
    at = 0
    while at < len(data):
        stream = zlib.decompressobj(31)
        while not stream.eof:
            fed = data[at : at + chunk]
            at += len(fed)
            piece = stream.decompress(fed, chunk)
            while piece or stream.unconsumed_tail:
                if piece:
                    yield piece
                if stream.eof:
                    break
                piece = stream.decompress(stream.unconsumed_tail, chunk)
            if not fed and not stream.eof:
                raise ValueError("a gzip stream ends early")
        at -= len(stream.unused_data)  # they belong to the next member


def mark_revisits(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(id, digest, first) of every page whose payload a page of smaller id has: only ids and digests shuffle."""
    body = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    ids = pages.select(F.col(id_col).alias("page"), F.sha1(body).alias("sha"), F.octet_length(body).alias("n")).where(F.col("n") >= min_bytes)
    ids = ids.groupBy("page", "sha").agg(F.first("n").alias("n"))
    first = ids.groupBy("sha").agg(F.min("page").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null").select("sha", "first")
    first = materialize(first, "warc-payloads")  # both sides of the join are then plain shuffles, of which a hot payload's is split
    return ids.join(first, "sha").where("page is null or page <> first").select("page", "sha", "first")


def write_warc(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, archive_bytes: int = 8 << 20, date: str = "2024-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """Archives (archive string, data binary) of whole-file gzip streams with a record for each page.

    Of pages with equal payloads of at least ``min_bytes`` bytes, the smallest id is the response and the others are
    revisits that refer to it. Null html is an empty payload, a null url leaves out the target, a null id never is the
    first of its group unless all ids there are null (then each is a response). Rows of equal id and payload are alike:
    all responses or all revisits. An archive closes once it has ``archive_bytes`` of records; a larger record has one
    of its own. Extra columns are ignored. An empty table gives no archive.
    """
    body = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    source = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), body.alias("body"))
    # written first, so that the size of the marks is known: few of them spare the pages' shuffle
    marks = materialize(mark_revisits(pages, id_col=id_col, html_col=html_col, min_bytes=min_bytes), "warc-revisits")
    marks = marks.select(F.col("page").alias("m_page"), F.col("sha").alias("m_sha"), "first")
    rows = source.join(marks, F.expr("page <=> m_page and sha1(body) = m_sha"), "left").select("page", "url", "body", "first", F.col("m_sha").isNotNull().alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        stream, parts, size = None, [], 0

        def closed() -> pa.RecordBatch:
            parts.append(stream.flush())
            name = f"part-{TaskContext.get().partitionId():06d}-{number:06d}"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(parts)], pa.binary())], names=["archive", "data"])

        for batch in batches:
            for page, url, payload, first, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stream is None:
                    stream, parts, size = zlib.compressobj(level, zlib.DEFLATED, 31), [], 0
                record = build_record(page, url, payload, payload_digest(payload), first, revisit, date)
                parts.append(stream.compress(record))
                size += len(record)
                if size >= archive_bytes:
                    yield closed()
                    stream, number = None, number + 1
        if stream is not None:
            yield closed()

    return rows.mapInArrow(write, "archive string, data binary")


def normalize(archives: DataFrame, *, level: int = 6) -> DataFrame:
    """Archives whose every record is a gzip member of its own: (archive, data, index).

    ``index`` holds, for each record, the offset and length of its member, its record id and type. Null data is an
    archive without records. A stream that breaks off raises.
    """

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader, members, index, offset = RecordReader(), [], [], 0
                for piece in inflate(data or b""):
                    for headers, record in reader.feed(piece):
                        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = packer.compress(record) + packer.flush()
                        index.append({"offset": offset, "length": len(member), "record_id": headers.get("warc-record-id"), "type": headers.get("warc-type")})
                        members.append(member)
                        offset += len(member)
                if reader.held:
                    raise ValueError(f"archive {name} ends within a record")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(members)], pa.binary()), pa.array([index], _INDEX_ARROW)], names=["archive", "data", "index"])

    return archives.select("archive", "data").mapInArrow(rewrite, f"archive string, data binary, index {INDEX_TYPE}")


def sidecar(normalized: DataFrame) -> DataFrame:
    """The offset index, one row for each record: archive, offset, length, record_id, type.

    An archive without records has no row, and an empty table gives an empty result.
    """
    return normalized.select("archive", F.inline("index"))


def write_sidecar(normalized: DataFrame, folder: str) -> DataFrame:
    """Writes the offset index beside the archives, as tab-separated files in a new folder, and reads it back.

    Rows as in ``sidecar``; a missing record id or type is an empty field and comes back as null.
    """
    lines = sidecar(normalized)
    lines.write.option("sep", "\t").csv(folder)
    return normalized.sparkSession.read.schema(lines.schema).option("sep", "\t").csv(folder)


def with_index(archives: DataFrame, index: DataFrame) -> DataFrame:
    """(archive, data, index) of archives and their sidecar, records by offset; archives without records are left out.

    An archive's records are one group, bounded by the archive's size.
    """
    each = index.groupBy("archive").agg(F.sort_array(F.collect_list(F.struct(*(c for c in index.columns if c != "archive")))).alias("index"))
    return archives.select("archive", "data").join(each, "archive")


def parse_member(member: bytes) -> dict:
    """What one gzip member says of its page; for a response, bytes and digest are of the payload as read."""
    record = zlib.decompress(member, 31)
    head = record.index(b"\r\n\r\n")
    headers = parse_headers(record[:head])
    block = record[head + 4 : head + 4 + int(headers["content-length"])]
    at = block.index(b"\r\n\r\n") + 4
    revisit = headers["warc-type"] == "revisit"
    stated = headers["warc-payload-digest"].removeprefix("sha1:")
    payload = None if revisit else block[at:]
    if payload is not None and payload_digest(payload) != stated:
        raise ValueError(f"{headers['warc-record-id']}: the payload does not match its digest")
    length = int(re.search(rb"Content-Length: (\d+)", block[:at])[1]) if revisit else len(payload)
    return {"page_id": page_of(headers["warc-record-id"]), "url": headers.get("warc-target-uri"), "payload": payload, "payload_bytes": length, "payload_digest": stated, "record_type": headers["warc-type"], "refers_to": page_of(headers["warc-refers-to"]) if revisit else None}


def read_warc(normalized: DataFrame, *, payload: bool = True) -> DataFrame:
    """One row for each record, read member by member through the index.

    A record without a page id or address has nulls there; a revisit's payload is null, its size and digest those that it
    states. A response whose payload does not have the stated digest raises. An empty table gives an empty result.
    """
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    fields = [f for f in fields if payload or f[0] != "payload"]
    schema = "page_id bigint, url string, " + "payload binary, " * payload + "payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, index in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                view = memoryview(data)
                for lo in range(0, len(index), 2000):
                    rows = [parse_member(view[x["offset"] : x["offset"] + x["length"]]) for x in index[lo : lo + 2000]]
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in fields], names=[n for n, _ in fields])

    return normalized.select("archive", "data", "index").mapInArrow(read, schema)


def export_files(normalized: DataFrame, folder: str) -> DataFrame:
    """Writes <archive>.warc.gz and its .idx sidecar into a folder that all executors mount; returns archive, path, records.

    Files appear whole, by a rename, and are replaced where they exist; an empty table writes none.
    """
    import os

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            for name, data, index in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                path = os.path.join(folder, f"{name}.warc.gz")
                lines = "".join(f"{x['offset']}\t{x['length']}\t{x['record_id']}\t{x['type']}\n" for x in index)
                for target, content in ((path, data), (f"{path}.idx", lines.encode())):
                    mine = f"{target}.{TaskContext.get().taskAttemptId()}"
                    with open(mine, "wb") as out:
                        out.write(content)
                    os.replace(mine, target)  # a retried task puts the same file
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([path]), pa.array([len(index)], pa.int64())], names=["archive", "path", "records"])

    return normalized.select("archive", "data", "index").mapInArrow(put, "archive string, path string, records bigint")


def load_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Archives (archive, data) of .warc.gz files, by any path that Spark reads; a file is one value, so it must be under 2 GB."""
    return spark.read.format("binaryFile").load(pattern).select(F.regexp_extract("path", r"([^/]+?)(\.warc)?(\.gz)?$", 1).alias("archive"), F.col("content").alias("data"))


def warc_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes all pages to archives, normalises those with a sidecar index, and reads the records back through the sidecar's files."""
    whole = materialize(write_warc(pages, **options), "warc-whole")
    normal = materialize(normalize(whole), "warc-normal")
    index = write_sidecar(normal, f"{scratch_dir(pages.sparkSession)}/warc-sidecar-{uuid.uuid4().hex}")
    return read_warc(with_index(normal, index), payload=False)
