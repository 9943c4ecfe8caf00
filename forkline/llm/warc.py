"""WARC: records written by Spark's text writer, read back with exact framing, and assembled into captures.

A record is one row of the text writer, whose line separator is the blank line that ends a record. Reading splits at
the version marker; a record whose declared length goes on past a marker inside its payload takes the next pieces of
its file. Archives are compressed, so a file is read as one stream; payloads never travel between tasks on reading.

Request and metadata records name the response or revisit they belong to (concurrent-to); records that meet on that
identifier are one capture. A revisit takes size and digest of the full payload from the response it refers to.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forkline.session import stage

# Fixed values of the format and the contract.
MARK = "WARC/1."
CRLF = "\r\n"
SHARED_BYTES = 1000


def _uuid(kind: str) -> Column:
    """Identifier of a page's record of some kind, the same whenever it is computed."""
    h = F.md5(F.concat_ws("\x1f", F.lit(kind), F.coalesce(F.col("page_id").cast("string"), F.lit("-")),
                          F.coalesce("url", F.lit("\x00")), "digest"))
    part = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *part), F.lit(">"))


def _line(name: str, value: Column | str) -> Column:
    """A header line; none for a null value. Line breaks in values are taken out."""
    value = F.lit(value) if isinstance(value, str) else value
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), "[\r\n]", ""), F.lit(CRLF)), F.lit(""))


def _record(kind: Column | str, record_id: Column, block: Column, *more: Column) -> Column:
    return F.concat(
        F.lit(MARK + "1" + CRLF), _line("WARC-Type", kind), _line("WARC-Record-ID", record_id),
        _line("WARC-Date", "2024-01-01T00:00:00Z"), _line("WARC-Target-URI", F.col("url")), *more,
        _line("Content-Length", F.octet_length(block)), F.lit(CRLF), block)


def write_archives(pages: DataFrame, path: str) -> None:
    """Request, response or revisit, and metadata records of ``page_id, url, html`` rows as compressed archives.

    Of rows with equal payloads of 1000 bytes or more, the one with the largest ``page_id`` is the response (all rows
    that share it) and the others revisit it; a null id counts as smaller than any. A null html is an empty payload;
    a null url has no target. Other columns are ignored. An empty table gives empty archives.
    """
    base = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    base = base.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html"))
    base = base.withColumn("id", _uuid("response"))
    first = (
        base.where((F.col("bytes") >= SHARED_BYTES) & F.col("page_id").isNotNull()).groupBy("digest", "bytes")
        .agg(F.max(F.struct("page_id", "id")).alias("first"))
        .select("digest", "bytes", F.col("first.page_id").alias("first_page"), F.col("first.id").alias("first_id"))
    )
    known = base.join(first, ["digest", "bytes"], "left")
    again = F.coalesce(F.col("first_page") > F.coalesce("page_id", F.lit(-(2**63))), F.lit(False))
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(CRLF + CRLF))
    answer = _record(
        F.when(again, "revisit").otherwise("response"), F.col("id"), F.concat(head, F.when(again, "").otherwise(F.col("html"))),
        _line("Content-Type", "application/http; msgtype=response"),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        _line("WARC-Refers-To", F.when(again, F.col("first_id"))),
        _line("WARC-Profile", F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))))
    host = F.regexp_extract(F.coalesce("url", F.lit("")), "^[^:]*://([^/?#]*)", 1)
    asked = F.concat(F.lit("GET / HTTP/1.1" + CRLF), _line("Host", host), F.lit(CRLF))
    request = _record("request", _uuid("request"), asked, _line("Content-Type", "application/http; msgtype=request"),
                      _line("WARC-Concurrent-To", F.col("id")))
    about = _record("metadata", _uuid("metadata"), _line("page_id", F.col("page_id")), _line("Content-Type", "application/warc-fields"),
                    _line("WARC-Concurrent-To", F.col("id")))
    rows = known.select(F.explode(F.array(request, answer, about)).alias("value"))
    rows.write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


RECORD = (
    "record_id string, type string, target_uri string, date string, concurrent_to array<string>, refers_to string, "
    "declared_digest string, bytes bigint, digest string, fields string, payload binary, complete boolean"
)


def _parsed(raw: bytes, with_payload: bool) -> tuple | None:
    """A record from the piece after its marker; None while it is shorter than declared."""
    head, gap, body = raw.partition(b"\r\n\r\n")
    names: dict[str, list[str]] = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        names.setdefault(name.strip().lower().decode("latin-1"), []).append(value.strip().decode("utf-8", "replace"))
    one = lambda n: names.get(n, [None])[0]
    length = one("content-length")
    if not gap or length is None or not length.isdigit() or len(body) < int(length):
        return None
    block, kind = body[: int(length)], one("warc-type")
    http = (one("content-type") or "").startswith("application/http")
    payload = block.partition(b"\r\n\r\n")[2] if http else block
    answer = kind in ("response", "resource")
    return (
        one("warc-record-id"), kind, one("warc-target-uri"), one("warc-date"), names.get("warc-concurrent-to", []),
        one("warc-refers-to"), one("warc-payload-digest"), len(payload) if answer else None,
        hashlib.sha1(payload).hexdigest() if answer else None, None if answer else block.decode("utf-8", "replace"),
        payload if answer and with_payload else None, True)


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Records of the archives. ``fields`` is the block of records that are no response.

    A record cut off at the end of its file, or a piece without header, is kept as a row with ``complete`` false and
    its bytes as ``payload``. Uncompressed archives must not be split within a record that holds the marker itself.
    """
    pieces = spark.read.text(path, lineSep=MARK).select(F.col("value").cast("binary"), F.col("_metadata.file_path").alias("file"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([
            ("record_id", pa.string()), ("type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()),
            ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("declared_digest", pa.string()),
            ("bytes", pa.int64()), ("digest", pa.string()), ("fields", pa.string()), ("payload", pa.binary()), ("complete", pa.bool_())])
        broken = lambda raw: (*[None] * 4, [], *[None] * 5, raw, False)
        now, open_piece = None, None

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            rows = []
            for cell, file in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                piece = cell.as_py()
                if file != now:
                    if open_piece is not None:
                        rows.append(broken(open_piece))
                    now, open_piece = file, None
                raw = piece if open_piece is None else open_piece + MARK.encode() + piece
                if not raw:
                    continue
                got = _parsed(raw, with_payload)
                open_piece = raw if got is None else None
                if got is not None:
                    rows.append(got)
            if rows:
                yield batch_of(rows)
        if open_piece is not None:
            yield batch_of([broken(open_piece)])

    return pieces.mapInArrow(run, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id, response, requests, metadata``, ``payload_bytes`` and
    ``payload_digest`` of the full payload, and ``refers_to`` with the ``fields`` of the response's metadata.

    Records that repeat an identifier are as many captures. Requests and metadata without a response are a capture
    with a null response. A revisit whose response is not there has null sizes and the digest it declares. Incomplete
    pieces take no part.
    """
    records = records.where("complete")
    keyed = records.withColumn("capture_id", F.explode(F.expr(
        "if(type in ('request', 'metadata') and size(concurrent_to) > 0, array_distinct(concurrent_to), array(record_id))")))
    answer = F.expr("type in ('response', 'revisit', 'resource')")
    whole = F.struct("record_id", "type", "target_uri", "date", "refers_to", "declared_digest", "bytes", "digest", "payload")
    small = F.struct("record_id", "target_uri", "date", "fields")
    made = keyed.groupBy("capture_id").agg(
        F.first(F.when(answer, whole), ignorenulls=True).alias("response"),
        F.greatest(F.count_if(answer), F.lit(1)).cast("int").alias("copies"),
        F.collect_set(F.when(F.col("type") == "request", small)).alias("requests"),
        F.collect_set(F.when(F.col("type") == "metadata", small)).alias("metadata"))
    made = stage(made, "captures")
    first = made.where("response.type <> 'revisit'").select(
        F.col("capture_id").alias("refers_to"), F.col("response.bytes").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"), F.col("metadata.fields").alias("first_fields"))
    own = made.where("response is null or response.type <> 'revisit'").select(
        "*", F.col("response.bytes").alias("payload_bytes"), F.col("response.digest").alias("payload_digest"),
        F.lit(None).cast("string").alias("refers_to"), F.lit(None).cast("array<string>").alias("first_fields"))
    again = made.where("response.type = 'revisit'").withColumn("refers_to", F.col("response.refers_to"))
    again = again.join(first, "refers_to", "left").withColumn(
        "payload_digest", F.coalesce("payload_digest", F.expr("regexp_extract(response.declared_digest, '^sha1:(.*)$', 1)")))
    both = own.unionByName(again)
    return both.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copy", "copies")


def page_field(fields: Column) -> Column:
    """Page id in the first line of a metadata record; null where the record is missing, empty or says something else."""
    return F.regexp_extract(F.element_at(fields, 1), r"^page_id: (-?\d+)", 1).try_cast("bigint")
