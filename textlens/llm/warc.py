"""WARC: write captures as request, response (or revisit) and metadata records; read archives; assemble transactions."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, scratch, stored, table

#: Payloads of fewer bytes are never written as revisits.
MIN_REVISIT_BYTES = 0
#: Records in one archive at most, and bytes of an archive of records of average size. A reader takes an archive whole, below 2 GB.
RECORDS_PER_FILE, FILE_BYTES = 30_000, 96 << 20
#: Payload bytes that the reader hands on at once.
BATCH_BYTES = 8 << 20

_RFC4648 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORD_SCHEMA = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, payload_digest string, content_type string, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of SHA-1, five hex digits (20 bits) to four base32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * g + 1, 5), 16, 32), 4, "0") for g in range(8)]
    return F.translate(F.concat(*parts), *_RFC4648)


def _urn(*key: Column) -> Column:
    h = F.md5(F.concat_ws("\n", *key))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _page_urn(page: Column, digest: Column, url: Column) -> Column:
    return _urn(F.lit("page"), F.coalesce(page.cast("string"), F.lit("null")), digest, F.coalesce(url, F.lit("")))


def _record(kind: str | Column, rid: Column, body: Column, content_type: str, *headers: tuple[str, Column]) -> Column:
    """One record as text; a header whose value is null is left out. The record ends with two line ends, the writer's separator."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind), F.concat(F.lit("WARC-Record-ID: "), rid), F.lit("WARC-Date: 2024-01-01T00:00:00Z")]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    lines += [F.lit(f"Content-Type: {content_type}"), F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), body)


def write_warc(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Writes three records for each row of pages(page_id, url, html) as gzip archives below `path`.

    The payload is the html in UTF-8, null as empty. Of equal payloads of at least `min_revisit_bytes` bytes the one with the
    smallest page_id (null before all) is a response, the others are revisits of it without a payload; equal means the same
    SHA-1 and length. Record ids follow from page_id, url and payload, so a retried task writes the same bytes; rows equal in
    all three write repeated records, which the reader counts. A null url is left out of the headers; line ends in it become
    blanks. An empty table writes no record; a record must fit a task's memory. Other columns of pages aren't written.
    Groups are found by a partial aggregate on the digest, so a payload that a third of all rows share is one row per task;
    only if the table of repeated payloads is small enough to broadcast do the pages stay where they are.
    """
    base = pages.select("page_id", F.regexp_replace("url", "[\\r\\n]+", " ").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    base = base.withColumns({"digest": base32_sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html")})
    least = F.struct(F.col("page_id").isNotNull().alias("has"), "page_id", F.coalesce("url", F.lit("")).alias("url"))
    payloads = stored(base.groupBy("digest", "bytes").agg(F.min(least).alias("least"), F.count("*").alias("n")), "payloads")
    mean = payloads.agg((F.sum(F.col("bytes") * F.col("n")) / F.sum("n")).alias("m")).first()["m"] or 0
    first = stored(payloads.where((F.col("n") > 1) & (F.col("bytes") >= min_revisit_bytes)).select("digest", "bytes", F.col("least.page_id").alias("first_id"), F.col("least.url").alias("first_url"), F.lit(True).alias("grouped")), "repeated")
    rows = base.join(first, ["digest", "bytes"], "left")
    revisit = F.coalesce("grouped", F.lit(False)) & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    rid = _page_urn(F.col("page_id"), F.col("digest"), F.col("url"))
    uri, digest = F.col("url"), F.concat(F.lit("sha1:"), F.col("digest"))
    page = F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit("\r\n"))
    records = F.array(
        F.when(revisit, _record("revisit", rid, F.lit(""), "application/http;msgtype=response", ("WARC-Target-URI", uri), ("WARC-Refers-To", _page_urn(F.col("first_id"), F.col("digest"), F.col("first_url"))), ("WARC-Payload-Digest", digest), ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))))
        .otherwise(_record("response", rid, F.concat(F.lit(_HTTP), F.col("html")), "application/http;msgtype=response", ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest))),
        _record("request", _urn(F.lit("request"), rid), F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")), "application/http;msgtype=request", ("WARC-Target-URI", uri), ("WARC-Concurrent-To", rid)),
        _record("metadata", _urn(F.lit("metadata"), rid), F.coalesce(page, F.lit("")), "application/warc-fields", ("WARC-Target-URI", uri), ("WARC-Concurrent-To", rid)),
    )
    rows.select(F.explode(records).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", min(RECORDS_PER_FILE, max(3, int(FILE_BYTES // (mean / 3 + 400))))).text(path)
    discard(payloads, first)


def _chunks(content: bytes) -> Iterator[bytes]:
    """The decompressed bytes, piece by piece; gzip members may follow each other."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at = memoryview(content), 0
    d = zlib.decompressobj(31)
    while at < len(view) or d.unconsumed_tail:
        data = d.unconsumed_tail or view[at : at + (1 << 18)]
        if not d.unconsumed_tail:
            at += len(data)
        if piece := d.decompress(data, 1 << 22):
            yield piece
        if d.eof:
            at -= len(d.unused_data)
            d = zlib.decompressobj(31)


def parse_warc(content: bytes) -> Iterator[tuple]:
    """Rows of RECORD_SCHEMA. Blocks are cut by Content-Length, so payloads may hold anything; a cut-off last record is an error."""
    buffer, pieces = b"", _chunks(content)

    def more() -> bool:
        nonlocal buffer
        piece = next(pieces, b"")
        buffer += piece
        return bool(piece)

    while True:
        buffer = buffer.lstrip(b"\r\n")
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not more():
                if buffer.strip():
                    raise ValueError("an archive ends inside a record's headers")
                return
            buffer = buffer.lstrip(b"\r\n")
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in buffer[:end].decode("utf-8").split("\r\n")[1:])}
        size, start = int(head["content-length"]), end + 4
        parts, have = [buffer[start : start + size]], min(size, len(buffer) - start)
        buffer = buffer[start + have :]
        while have < size:
            piece = next(pieces, b"")
            if not piece:
                raise ValueError("an archive ends inside a record's block")
            parts.append(piece[: size - have])
            buffer = piece[size - have :]
            have += len(parts[-1])
        block = b"".join(parts)
        if head["warc-type"] == "response":
            block = block.partition(b"\r\n\r\n")[2]
        yield (head.get("warc-record-id"), head["warc-type"], head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("warc-payload-digest"), head.get("content-type"), block)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives below `path` (plain or gzip), one row each, RECORD_SCHEMA; several archives a task, one at a time."""
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]

    def rows(batches):
        for batch in batches:
            for content in batch["content"]:
                held, size = [], 0
                for r in parse_warc(content):
                    held.append(r)
                    size += len(r[-1]) + 200
                    if size >= BATCH_BYTES:
                        yield pd.DataFrame(held, columns=names)
                        held, size = [], 0
                if held:
                    yield pd.DataFrame(held, columns=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInPandas(rows, RECORD_SCHEMA)


def assemble_captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, copies, response, request, metadata, source, source_metadata), by one aggregate
    on the id that requests and metadata name as concurrent.

    response is the response or revisit record; a capture without a request or metadata record has null there. Records
    written several times under one id count in `copies`. Revisits also carry `source` and `source_metadata`, the response
    record they refer to and its metadata (null if it isn't in the archives). Requests and metadata whose capture is missing
    are left out. An extra column of `records` stays within the structs; no records make no captures. Only revisits take
    part in the join to their sources, so captures without a reference never meet in one task.
    """
    whole = F.struct(*[F.col(c) for c in records.columns])
    main = F.col("type").isin("response", "revisit")

    def of(which: Column) -> Column:
        return F.first(F.when(which, whole), ignorenulls=True)

    kinds = [of(main).alias("response"), F.count_if(main).alias("copies"), of(F.col("type") == "request").alias("request"), of(F.col("type") == "metadata").alias("metadata")]
    out = records.groupBy(F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to")).alias("capture_id")).agg(*kinds).where("copies > 0")
    source = out.where("response.type = 'response'").select(F.col("capture_id").alias("_to"), F.col("response").alias("source"), F.col("metadata").alias("source_metadata"))
    refers = F.col("response.refers_to").isNotNull()
    revisits = out.where(refers).join(source, F.col("response.refers_to") == F.col("_to"), "left").drop("_to")
    return out.where(~refers).select("*", *(F.lit(None).cast(source.schema[c].dataType).alias(c) for c in ("source", "source_metadata"))).unionByName(revisits)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages, written, read once and assembled; one row per page."""
    path = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    records = read_warc(spark, path)
    fields = F.when(F.col("type") == "metadata", F.regexp_extract(F.col("payload").cast("string"), r"page-id: (-?\d+)", 1).try_cast("long"))
    digest = F.when(F.col("type") == "response", base32_sha1(F.col("payload"))).otherwise(F.regexp_replace("payload_digest", "^sha1:", ""))
    small = stored(records.select("record_id", "type", "concurrent_to", "refers_to", digest.alias("digest"), F.octet_length("payload").cast("long").alias("bytes"), fields.alias("page_id")), "records")
    return (
        assemble_captures(small)
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select(
            F.col("metadata.page_id").alias("page_id"),
            F.coalesce("source.bytes", "response.bytes").alias("payload_bytes"),
            F.coalesce("source.digest", "response.digest").alias("payload_digest"),
            F.col("response.type").alias("record_type"),
            F.col("source_metadata.page_id").alias("refers_to"),
        )
    )


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(x, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d
"""
