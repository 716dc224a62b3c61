"""WARC archives: write captures as linked records, read them back, assemble transactions.

Every capture is three records: a ``response`` (or, for a payload that an earlier capture already
holds, a ``revisit``), a ``request`` and a ``metadata`` record; the last two name the first in
``WARC-Concurrent-To``. :func:`assemble` joins the three through that identifier and emits one
nested row per capture.

Defined cases: a null body is an empty payload; a null url leaves out ``WARC-Target-URI`` and reads
back as null; line breaks in a url are percent-encoded; a null page id sorts before all others and
reads back as null; rows with the same page id are captures of their own; an empty table writes an
archive with no records and reads back as no rows; further columns of the pages are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import lookup, shared_dir, written

VERSION = "WARC/1.1\r\n"
#: Each record ends with these two line breaks.
RECORD_END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: A table of revisits with up to this many rows (about 20 MB) is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Digits of Spark's base 32 and the alphabet of RFC 4648, in the order of their values.
CONV_DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD_SCHEMA = (
    "warc_type string, record_id string, concurrent_to string, target_uri string, warc_date string, "
    "declared_digest string, refers_to string, block_bytes long, payload_digest string, payload binary, block string"
)


def sha1_base32(data: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a string or binary column."""
    digest = F.sha1(data)
    parts = [
        F.lpad(F.conv(F.substring(digest, at, n), 16, 32), n * 4 // 5, "0") for at, n in ((1, 15), (16, 15), (31, 10))
    ]
    return F.translate(F.concat(*parts), CONV_DIGITS, BASE32)


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _record(kind: Column, record_id: Column, date: str, content_type: str, block: Column, *lines: Column) -> Column:
    return F.concat(
        F.lit(VERSION), _line("WARC-Type", kind), _line("WARC-Record-ID", record_id), F.lit(f"WARC-Date: {date}\r\n"),
        *lines, F.lit(f"Content-Type: {content_type}\r\n"), _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"), block,
    )


def _id(page_id: Column, seq: Column, kind: str) -> Column:
    return F.concat(F.lit("<urn:capture:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), seq.cast("string"), F.lit(f":{kind}>"))


def revisits(pages: DataFrame, total: int, min_bytes: int = 0) -> DataFrame:
    """(seq, first_page, first_seq) of every capture whose payload an earlier one holds.

    ``pages`` has seq, page_id, digest and n_bytes. The earliest is the one with the smallest page id, then seq.
    """
    large = pages.where(F.col("n_bytes") >= min_bytes).select("seq", "page_id", "digest")
    firsts = (
        large.groupBy("digest")
        .agg(F.min(F.struct("page_id", "seq")).alias("first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
    )
    return (
        lookup(large, firsts, "digest", total, how="inner")
        .where("seq != first.seq")
        .select("seq", F.col("first.page_id").alias("first_page"), F.col("first.seq").alias("first_seq"))
    )


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", min_bytes: int = 0) -> None:
    """Write ``pages`` (page_id, url, html) to gzip archives below ``path``.

    The captures are numbered and written once: row numbers follow the splits of a scan, which follow
    the number of cores, and they link a revisit to the capture that it repeats.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = written(pages.select(F.monotonically_increasing_id().alias("seq"), "page_id", "url", body.alias("html")), "warc-captures")
    slim = written(
        rows.select("seq", "page_id", sha1_base32(F.col("html")).alias("digest"), F.octet_length("html").alias("n_bytes")),
        "warc-digests",
    )
    total = slim.count()
    again = written(revisits(slim, total, min_bytes), "warc-revisits")
    rows = rows.join(F.broadcast(again) if again.count() <= BROADCAST_ROWS else again, "seq", "left")
    rows = rows.withColumn("digest", sha1_base32(F.col("html")))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    page, seq, is_again = F.col("page_id"), F.col("seq"), F.col("first_seq").isNotNull()
    capture_id = _id(page, seq, "response")
    target, beside = _line("WARC-Target-URI", uri), _line("WARC-Concurrent-To", capture_id)
    host = F.coalesce(F.nullif(F.parse_url(F.regexp_replace(uri, r"[^!-~]", "_"), F.lit("HOST")), F.lit("")), F.lit("unknown"))
    capture = _record(
        F.when(is_again, "revisit").otherwise("response"), capture_id, date, "application/http; msgtype=response",
        F.concat(F.lit(HTTP_HEAD), F.when(is_again, "").otherwise(F.col("html"))), target,
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Profile", F.when(is_again, PROFILE)),
        _line("WARC-Refers-To", F.when(is_again, _id(F.col("first_page"), F.col("first_seq"), "response"))),
    )
    request = _record(
        F.lit("request"), _id(page, seq, "request"), date, "application/http; msgtype=request",
        F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n")), target, beside,
    )
    metadata = _record(
        F.lit("metadata"), _id(page, seq, "metadata"), date, "application/warc-fields",
        F.concat(
            _line("pageId", page.cast("string")), _line("payloadLength", F.octet_length("html").cast("string")),
        ), target, beside,
    )
    rows.select(F.explode(F.array(capture, request, metadata)).alias("value")).write.option("lineSep", RECORD_END).option("compression", "gzip").text(path)


def _parse(batches):
    """Records of the pieces between version lines; a piece that ends inside a block is joined to the next."""
    mark, end = VERSION.encode(), RECORD_END.encode()
    file, held = None, None

    def parts(piece: bytes):
        """(header fields, block), or None while the block isn't whole."""
        at = piece.find(end)
        if at < 0:
            return None
        fields = {}
        for line in piece[:at].decode("utf-8", "replace").split("\r\n"):
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        n = int(fields.get("content-length", 0))
        block = piece[at + 4 : at + 4 + n]
        return (fields, block) if len(block) == n else None

    def row(fields: dict, block: bytes) -> tuple:
        kind = fields.get("warc-type")
        payload = block
        if fields.get("content-type", "").startswith("application/http"):
            payload = block.partition(end)[2]
        whole = kind in ("response", "resource")
        return (
            kind, fields.get("warc-record-id"), fields.get("warc-concurrent-to"), fields.get("warc-target-uri"), fields.get("warc-date"),
            fields.get("warc-payload-digest"), fields.get("warc-refers-to"), len(payload),
            base64.b32encode(hashlib.sha1(payload).digest()).decode() if whole else None, payload if whole else None,
            None if whole else block.decode("utf-8", "replace"),
        )

    types = [("string", pa.string()), ("long", pa.int64()), ("binary", pa.binary())]
    kinds = [dict(types)[x.split()[1]] for x in RECORD_SCHEMA.split(", ")]
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]

    def batch(rows: list):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    for b in batches:
        out, size = [], 0
        for name, piece in zip(b.column("file").to_pylist(), b.column("value").to_pylist()):
            if name != file:
                if held is not None:
                    raise ValueError(f"{file}: the last record is cut short")
                file = name
            piece = piece if held is None else held + mark + piece
            if not piece:  # before the first version line of a file
                continue
            got = parts(piece)
            held = piece if got is None else None
            if got:
                out.append(row(*got))
                size += len(piece)
                if size > 16 << 20:
                    yield batch(out)
                    out, size = [], 0
        if out:
            yield batch(out)
    if held is not None:
        raise ValueError(f"{file}: the last record is cut short")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``; a block may hold any bytes, version lines included."""
    pieces = spark.read.option("lineSep", VERSION).text(path)
    return pieces.select(
        F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")
    ).mapInArrow(_parse, RECORD_SCHEMA)


def _field(block: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(block, rf"(?m)^{name}: ([^\r\n]*)\r?$", 1), F.lit(""))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its own record, the request and the metadata recorded beside it.

    A revisit's ``metadata.refers_to_page`` is the page id of the capture that its WARC-Refers-To names, found by
    that record id. Captures without a request or metadata record keep null there, and so do references to
    records that aren't in the archives or have no page id. Each join is on a record id, which is unique; a
    capture that very many revisits name is joined by broadcast.
    """
    extra = ["payload"] if "payload" in records.columns else []
    captures = records.where(F.col("warc_type").isin("response", "revisit", "resource")).select(
        "record_id", F.struct("warc_type", "target_uri", "warc_date", "declared_digest", "refers_to", "block_bytes", "payload_digest", *extra).alias("capture"),
    )
    request = records.where("warc_type = 'request'").select(
        F.col("concurrent_to").alias("record_id"), F.struct(F.col("record_id").alias("request_id"), "target_uri", "block").alias("request")
    )
    block = F.col("block")
    metadata = records.where("warc_type = 'metadata'").select(
        F.col("concurrent_to").alias("record_id"),
        _field(block, "pageId").cast("long").alias("page_id"), _field(block, "payloadLength").cast("long").alias("payload_bytes"),
    )
    named = records.where("warc_type = 'revisit' AND refers_to IS NOT NULL").select("record_id", "refers_to")
    often = named.groupBy("refers_to").agg(F.count(F.lit(1)).alias("_n"))
    pages = metadata.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("refers_to_page")).join(often, "refers_to")
    followed = lookup(named, pages, "refers_to", named.count(), how="inner").select("record_id", "refers_to_page")
    metadata = metadata.join(followed, "record_id", "left")
    metadata = metadata.select("record_id", F.struct("page_id", "payload_bytes", "refers_to_page").alias("metadata"))
    return captures.join(request, "record_id", "left").join(metadata, "record_id", "left")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, read the archives back, and describe each assembled capture."""
    path = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = written(read_records(spark, path).drop("payload"), "warc-records")
    rows = assemble(records)
    again = F.col("capture.warc_type") == "revisit"
    return rows.select(
        F.col("metadata.page_id").alias("page_id"),
        F.when(again, F.col("metadata.payload_bytes")).otherwise(F.col("capture.block_bytes")).alias("payload_bytes"),
        F.when(again, F.substring_index("capture.declared_digest", ":", -1)).otherwise(F.col("capture.payload_digest")).alias("payload_digest"),
        F.col("capture.warc_type").alias("record_type"),
        F.col("metadata.refers_to_page").alias("refers_to"),
    )


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), b AS (
  SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
         array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform(range(4), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             ((('0x' || substr(h, (5 * g + 1)::INT, 5))::BIGINT >> (15 - 5 * i)::INT) & 31)::INT + 1, 1)), '')), '') AS payload_digest,
         min(page_id) OVER (PARTITION BY h) AS first_page
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_page THEN NULL ELSE first_page END AS refers_to
FROM b
"""
