"""WARC archives: a writer and a sequential reader, both spread over tasks by Spark.

Writer: pages with equal payloads are found by a Spark aggregate over digests; one of them is
the response, the others become revisit records that name it. Payloads stay where they are, unless a table
of copies is too large to broadcast. Each task streams its rows into
archives of bounded size in the shared folder, one gzip member for each record. A
file is written under an attempt's name and then moved, so a task that runs again
leaves no half file behind.

Reader: a task opens an archive as a stream, inflates it incrementally, member by
member, frames each record by its Content-Length and verifies block and payload
digests. It never holds more than one record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apexframe.llm.common import lookup, scratch_path, stored

ARCHIVE_BYTES = 256 << 20
READ_BYTES = 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = "record_id string, record_type string, target_uri string, refers_to_id string, payload_bytes long, payload_digest string"


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _one_line(value: object) -> str:
    """A header value: no line breaks, which would end the header."""
    return "" if value is None or value is pd.NA else re.sub(r"[\r\n]+", " ", str(value))


def record_bytes(record_id: str, uri: str | None, payload: bytes, refers_to: str | None = None) -> bytes:
    """One WARC/1.1 record: a response, or a revisit that has only the HTTP head as its block."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {_one_line(uri)}",
        f"WARC-Payload-Digest: {_digest(payload)}",
        f"WARC-Block-Digest: {_digest(block)}",
        "Content-Type: application/http;msgtype=response",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    deflate = zlib.compressobj(level, zlib.DEFLATED, 31)
    return deflate.compress(data) + deflate.flush()


def _members(stream) -> Iterator[bytes]:
    """The inflated members of a gzip stream, one after the other, read in small pieces."""
    inflate, parts, fed = zlib.decompressobj(31), [], False
    while piece := stream.read(READ_BYTES):
        while piece:
            parts.append(inflate.decompress(piece))
            fed = True
            piece = b""
            if inflate.eof:
                yield b"".join(parts)
                piece, inflate, parts, fed = inflate.unused_data, zlib.decompressobj(31), [], False
    if fed:
        raise ValueError("the archive ends inside a gzip member")


def _headers(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def parse_record(data: bytes) -> dict:
    """Frame one record by its Content-Length and verify its digests; raises ValueError if it is damaged."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    fields = _headers(head)
    length = int(fields["content-length"])
    block, tail = rest[:length], rest[length:]
    if len(block) != length or tail != b"\r\n\r\n":
        raise ValueError(f"{fields.get('warc-record-id')}: the block isn't as long as its Content-Length says")
    if "warc-block-digest" in fields and _digest(block) != fields["warc-block-digest"]:
        raise ValueError(f"{fields.get('warc-record-id')}: block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["warc-type"]
    if kind == "response" and _digest(payload) != fields["warc-payload-digest"]:
        raise ValueError(f"{fields.get('warc-record-id')}: payload digest differs")
    size = len(payload) if kind == "response" else int(_headers(http)["content-length"])
    bare = lambda x: x.strip("<>") if x else None
    return {
        "record_id": bare(fields["warc-record-id"]),
        "record_type": kind,
        "target_uri": fields.get("warc-target-uri"),
        "refers_to_id": bare(fields.get("warc-refers-to")),
        "payload_bytes": size,
        "payload_digest": base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex(),
        "payload": payload if kind == "response" else None,
    }


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write (record_id, uri, payload, refers_to_id) rows as archives; returns (path, records). Runs when acted on."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _filesystem(folder)
        store.create_dir(root, recursive=True)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        out, records, number, size, name = None, 0, 0, 0, ""
        done = []

        def close():
            out.close()
            store.move(name, final := f"{root}/part-{part:06d}-{number:04d}.warc.gz")
            done.append((final, records))

        for pdf in batches:
            for record_id, uri, payload, refers in zip(pdf["record_id"], pdf["uri"], pdf["payload"], pdf["refers_to_id"], strict=True):
                if out is None:
                    name, records, size = f"{root}/.{part:06d}-{number:04d}-{attempt}", 0, 0
                    out = store.open_output_stream(name)
                member = gzip_member(record_bytes(record_id, uri, bytes(payload), None if pd.isna(refers) else refers))
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= archive_bytes:
                    close()
                    out, number = None, number + 1
        if out is not None:
            close()
        yield pd.DataFrame(done, columns=["path", "records"])

    return pages.select("record_id", "uri", "payload", "refers_to_id").mapInPandas(write, "path string, records long")


def read_archives(archives: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Records of the archives named in ``archives.path``; with ``payloads`` also the response bodies."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = _filesystem(folder)
        names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")] + ["payload"] * payloads
        for pdf in batches:
            for path in pdf["path"]:
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for member in _members(stream):
                        rows.append(parse_record(member))
                        held += len(member) if payloads else 300
                        if not payloads:
                            rows[-1]["payload"] = None
                        if held > 4 << 20:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                yield pd.DataFrame(rows, columns=names)

    return archives.select("path").mapInPandas(read, RECORD_SCHEMA + ", payload binary" * payloads)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 1000) -> tuple[str, DataFrame]:
    """Write every page and give (folder, written archives as a table).

    Of pages with equal payloads of at least ``revisit_bytes`` bytes the one with the
    largest id is the response, the others revisit it. Edge cases: null html is the
    empty payload; a null id is smaller than any other (all of a class null: all are
    responses); rows that repeat both id and payload of the response are responses too;
    an empty table writes no archive; other columns are ignored.
    """
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("uri"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= revisit_bytes, F.sha2("payload", 256)))
    first = rows.where("digest is not null").groupBy("digest").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = stored(first, "warc-copies")
    urn = lambda c: F.concat(F.lit("urn:x-page:"), F.coalesce(c.cast("string"), F.lit("null")))
    marked = lookup(rows, first, "digest", "n", ["id"]).withColumn("revisits", F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")))
    records = marked.select(urn(F.col("id")).alias("record_id"), "uri", "payload", F.when(F.col("revisits"), urn(F.col("first"))).alias("refers_to_id"))
    written = scratch_path(spark, "warc-index")
    write_archives(records, folder).write.parquet(written)
    return folder, spark.read.schema("path string, records long").parquet(written)


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 1000) -> DataFrame:
    """Archive the pages, read the archives back; a row for each record read.

    Returns id, payload_bytes, payload_digest (hex SHA-1), record_type, refers_to (the response's id).
    """
    spark = pages.sparkSession
    folder, archives = archive_pages(pages, id_col, url_col, html_col, revisit_bytes)
    spread = archives.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    found = read_archives(spread, folder)
    number = lambda c: F.expr(f"try_cast(substring({c}, 12) as bigint)")
    return found.select(number("record_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", number("refers_to_id").alias("refers_to"))
