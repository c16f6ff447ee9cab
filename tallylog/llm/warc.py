"""WARC archives of captures, and the assembly of their records into one row per capture.

Each capture is three records: a request, a response (or a revisit of an earlier response with
the same payload), and metadata; request and metadata name the response in
WARC-Concurrent-To.  Archives are written by Spark's text writer, whose line separator is the blank lines
that end a record, so a file is a plain WARC 1.1 file.  They are read as whole files, whose bytes the writer
bounds, and records are cut by Content-Length.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.llm.shared import ROW_ID, materialize, scratch_path, utf8_or_empty, with_row_ids

_CRLF = "\r\n"
_VERSION = "WARC/1.1"
#: The capture time of pages that have none, and the profile of identical payloads.
CAPTURED = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Captures in one archive file at most, and bytes of a payload beyond which a capture has a file of its own: a file
#: of many captures has 256 MB at most, however large pages are.
CAPTURES_PER_FILE, LARGE_PAGE = 1_000, 1 << 18


def _uuid(*parts: Column) -> Column:
    """A record id that depends on its parts alone."""
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(kind: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    """One WARC record without the blank lines that follow it; null fields are left out."""
    size = F.octet_length(block).cast("string")
    lines = [F.lit(_VERSION), F.concat(F.lit("WARC-Type: "), kind)]
    lines += [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    lines += [F.concat(F.lit("Content-Length: "), size)]
    return F.concat(F.concat_ws(_CRLF, *lines), F.lit(_CRLF * 2), block)


def sha1_base32(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a text in UTF-8: four base32 characters for each five hex digits."""
    digest = F.sha1(text.cast("binary"))
    fives = [F.lpad(F.conv(F.substring(digest, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*fives), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 0
) -> None:
    """Write a request, a response or revisit, and metadata for every page to gzipped WARC files at ``path``.

    Of pages with equal payloads of at least ``min_revisit_bytes`` bytes, the one with the smallest id is a
    response and the others are revisits of it; smaller payloads are all responses.  Null ids are larger
    than any other.  A null html is an empty payload; a null url an empty target.  Of repeated rows
    one is the response.
    """
    base = with_row_ids(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")))
    base = base.withColumn("html", utf8_or_empty(F.col("html"))).withColumn("url", F.translate(utf8_or_empty(F.col("url")), "\r\n", ""))
    base = base.withColumn("digest", sha1_base32(F.col("html"))).withColumn("bytes", F.octet_length("html"))
    order = F.struct(F.col("id").isNull().alias("unknown"), F.col("id").alias("id"), F.col(ROW_ID).alias("row"), F.col("url").alias("url"))
    equal = base.where(F.col("bytes") >= min_revisit_bytes).groupBy("digest", "bytes").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    equal = materialize(equal.where("n > 1").drop("n"), "payloads")
    large = base.where(F.col("bytes") > LARGE_PAGE)
    parts = [(base.where(F.col("bytes") <= LARGE_PAGE), CAPTURES_PER_FILE), *([] if large.isEmpty() else [(large, 1)])]
    for part, captures in parts:
        records = _records(part, equal)
        records.write.mode("append").option("lineSep", _CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", 3 * captures).text(path)


def _records(base: DataFrame, equal: DataFrame) -> DataFrame:
    """``value``: three records of each page of ``base``; ``equal`` has the first page of each payload that repeats."""
    # only payloads that repeat take part in the join; one that fills many rows is split by adaptive execution
    rows = base.join(equal, ["digest", "bytes"], "left")
    revisit = F.col("first.row").isNotNull() & (F.col("first.row") != F.col(ROW_ID))

    row = F.col(ROW_ID).cast("string")
    record_id = _uuid(F.lit("response"), row)
    uri = ("WARC-Target-URI", F.when(F.col("url") != "", F.col("url")))
    date = ("WARC-Date", F.lit(CAPTURED))
    host = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    target = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1)
    target = F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target))
    request = _record(
        F.lit("request"),
        [("WARC-Record-ID", _uuid(F.lit("request"), row)), date, uri, ("WARC-Concurrent-To", record_id), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), target, F.lit(f" HTTP/1.1{_CRLF}Host: "), host, F.lit(_CRLF * 2)),
    )
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(_CRLF * 2))
    capture = _record(
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        [
            ("WARC-Record-ID", record_id),
            date,
            uri,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
            ("WARC-Refers-To", F.when(revisit, _uuid(F.lit("response"), F.col("first.row").cast("string")))),
            ("WARC-Refers-To-Target-URI", F.when(revisit & (F.col("first.url") != ""), F.col("first.url"))),
            ("WARC-Refers-To-Date", F.when(revisit, F.lit(CAPTURED))),
            ("WARC-Profile", F.when(revisit, F.lit(_PROFILE))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(revisit, head).otherwise(F.concat(head, "html")),
    )
    metadata = _record(
        F.lit("metadata"),
        [("WARC-Record-ID", _uuid(F.lit("metadata"), row)), date, uri, ("WARC-Concurrent-To", record_id), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat_ws(_CRLF, F.concat(F.lit("page-id: "), F.col("id").cast("string")), F.concat(F.lit("payload-bytes: "), F.col("bytes").cast("string")), F.lit("")),
    )
    return rows.select(F.explode(F.array(request, capture, metadata)).alias("value"))


_FIELDS = ("type", "record_id", "target_uri", "date", "concurrent_to", "refers_to", "header_digest", "payload_bytes", "payload_digest", "fields", "payload")
_DDL = (
    "type string, record_id string, target_uri string, date string, concurrent_to string, refers_to string, "
    "header_digest string, payload_bytes long, payload_digest string, fields map<string,string>, payload binary"
)
_SCHEMA = pa.schema([(f, pa.string()) for f in _FIELDS[:7]] + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def _headers(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines)
    return {name.strip().lower(): value.strip() for name, colon, value in pairs if colon}


def records_of(stream) -> Iterator[tuple]:
    """The records of one archive, read one after the other by their lengths."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        lines = []
        while (line := stream.readline()).strip():
            lines.append(line)
        head = _headers(lines)
        block = stream.read(int(head["content-length"]))
        kind = head.get("warc-type", "")
        payload, fields = None, None
        if head.get("content-type", "").startswith("application/http"):
            payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
        elif kind == "metadata":
            fields = list(_headers(block.split(b"\r\n")).items())
        else:
            payload = block
        yield (
            kind, head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-date"), head.get("warc-concurrent-to"),
            head.get("warc-refers-to"), head.get("warc-payload-digest", "").rpartition(":")[2] or None,
            None if payload is None else len(payload),
            None if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode(),
            fields, payload,
        )


def _parse(keep_payloads: bool):
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = io.BytesIO(content.as_buffer())
                packed = raw.read(2) == b"\x1f\x8b"
                raw.seek(0)
                rows = []
                for record in records_of(gzip.GzipFile(fileobj=raw) if packed else raw):
                    rows.append(record if keep_payloads else (*record[:-1], None))
                    if len(rows) >= 500:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    return run


def read_records(spark: SparkSession, path: str, keep_payloads: bool = True) -> DataFrame:
    """One row per record of the archives in a folder; a file is read in one task, its records one by one."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parse(keep_payloads), _DDL)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture (response, revisit or resource record) with its request and metadata.

    ``records`` is read several times, so it should be a stored table rather than archives being parsed.

    A request or metadata record belongs to the capture that it names in WARC-Concurrent-To, that names it,
    or, for metadata, that its request belongs to.  Of several requests or metadata records of a capture the one
    with the smallest record id is kept, beside their number, so no capture gathers an
    unbounded group.  Records that belong to no capture are left out.

    Returns ``capture`` (the record), ``request``, ``metadata`` (null if there is none), ``n_requests``, ``n_metadata``.
    """
    captures = records.where(F.col("type").isin("response", "revisit", "resource"))
    requests, metadata = records.where("type = 'request'"), records.where("type = 'metadata'")
    named = captures.where("concurrent_to is not null").select(F.col("concurrent_to").alias("named"), F.col("record_id").alias("by"))

    def anchored(part: DataFrame) -> DataFrame:
        return part.join(named, part["record_id"] == F.col("named"), "left").withColumn("anchor", F.coalesce("by", "concurrent_to")).drop("by", "named")

    requests = anchored(requests)
    via = requests.groupBy(F.col("record_id").alias("via")).agg(F.min("anchor").alias("via_anchor"))
    metadata = anchored(metadata)
    metadata = metadata.join(via, metadata["anchor"] == via["via"], "left").withColumn("anchor", F.coalesce("via_anchor", "anchor"))

    def first_of(part: DataFrame, name: str, plural: str) -> DataFrame:
        row = F.struct("record_id", "target_uri", "date", "fields")
        return part.groupBy("anchor").agg(F.min_by(row, "record_id").alias(name), F.count("*").alias(plural))

    out = captures.select(F.struct(*records.columns).alias("capture"), F.col("record_id").alias("anchor"))
    out = out.join(first_of(requests, "request", "n_requests"), "anchor", "left")
    out = out.join(first_of(metadata, "metadata", "n_metadata"), "anchor", "left")
    return out.drop("anchor").na.fill(0, ["n_requests", "n_metadata"])


def archive_pages(pages: DataFrame, min_revisit_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Write all pages to archives, read them back and assemble the captures.

    Returns ``page_id, payload_bytes, payload_digest, record_type, refers_to, verified``: size and digest of
    the full payload, for a revisit those of the response it refers to, and whether the digest of
    the bytes read agrees with the record's header.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_archives(pages, path, min_revisit_bytes=min_revisit_bytes)
    records = materialize(read_records(spark, path, keep_payloads=False), "records")
    captures = materialize(assemble(records), "captures")
    id_type = pages.schema["page_id"].dataType
    flat = captures.select(
        F.col("metadata.fields")["page-id"].cast(id_type).alias("page_id"),
        F.col("capture.record_id").alias("record_id"),
        F.col("capture.type").alias("record_type"),
        F.col("capture.refers_to").alias("refers_to_record"),
        F.col("capture.header_digest").alias("header_digest"),
        F.col("capture.payload_bytes").alias("bytes"),
        F.col("capture.payload_digest").alias("digest"),
    )
    wanted = flat.where("record_type = 'revisit'").select(F.col("refers_to_record").alias("record_id")).distinct()
    originals = flat.join(wanted, "record_id", "left_semi").select(
        F.col("record_id").alias("original"), F.col("page_id").alias("refers_to"), F.col("bytes").alias("original_bytes"), F.col("digest").alias("original_digest")
    )
    out = flat.join(originals, flat["refers_to_record"] == originals["original"], "left")
    digest = F.coalesce("digest", "original_digest")
    return out.select(
        "page_id",
        F.coalesce("bytes", "original_bytes").alias("payload_bytes"),
        digest.alias("payload_digest"),
        "record_type",
        "refers_to",
        (digest == F.col("header_digest")).alias("verified"),
    )
