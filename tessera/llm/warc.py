"""WARC archives: writing captures, reading records, assembling transactions.

A capture is written as three records: a request, a response (or a revisit of
an earlier response with the same payload) and metadata; the request and the
metadata name the response in WARC-Concurrent-To. Archives are written by
Spark's text writer and read by its binary file reader, so both work on any
file system that Spark knows. Record ids are made of the capture's own id, its
payload's digest and a hash of its address, so a revisit names its target
rightly however the table is cut and whichever task is run again. Archives hold
about ``FILE_BYTES`` each by the mean size of a page and are inflated as they are
read, so a worker holds one compressed archive and one record. Records are cut
by Content-Length, so payloads may hold anything; a record that ends early is an
error. Assembly groups records by the capture they name and emits one nested
row each.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .cluster import shared_dir

LEAST, DATE, FILE_BYTES, STEP = 100, "2024-01-01T00:00:00Z", 128 << 20, 1 << 20
_RECORD = "record_id string, type string, concurrent_to string, refers_to string, uri string, date string, mime string, payload_bytes long, payload_digest string, http string, fields map<string,string>, payload binary"


def _record(kind: str, head: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}")]
    for name, value in head:
        lines += [F.lit(f"\r\n{name}: "), value]
    return F.concat(*lines, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def write_warc(captures: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = DATE, least: int = LEAST, file_bytes: int = FILE_BYTES) -> None:
    """Writes a request, a response or revisit, and a metadata record per row.

    Of rows with equal payloads of ``least`` bytes or more, that with the least
    id is the response and the others revisit it; equal rows of that id are
    both responses, with equal records. Null payloads are empty ones; null ids
    are written as such and revisit when any other row has the payload. Ids are
    integers. Other columns are left out; an empty table writes no record.
    """
    rows = captures.select(
        F.col(f"`{id_col}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("_url"),
        F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).alias("_body"),
    )
    mean = rows.agg(F.avg(F.octet_length("_body"))).first()[0] or 0
    per_file = int(min(20_000, max(1, file_bytes // (mean + 1000))))
    rows = rows.withColumn("_size", F.octet_length("_body").cast("long")).withColumn("_sha", F.sha2("_body", 256))
    rows = rows.withColumn("_row", F.concat_ws(":", F.coalesce(F.col("_id").cast("string"), F.lit("")), "_sha", F.hex(F.xxhash64("_url"))))
    first = rows.filter(F.col("_size") >= least).groupBy("_sha").agg(F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "_row"))).alias("_first"))
    rows = rows.join(first, "_sha", "left").withColumn("_again", F.coalesce(~F.col("_id").eqNullSafe(F.col("_first._id")) & F.col("_first").isNotNull(), F.lit(False)))
    name = lambda kind, row: F.concat(F.lit(f"<urn:x-capture:{kind}:"), row.cast("string"), F.lit(">"))
    safe = F.regexp_replace("_url", "[\\r\\n]", " ")
    own = name("main", F.col("_row"))
    common = [("WARC-Target-URI", safe), ("WARC-Date", F.lit(date))]
    digest = [("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_sha")))]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_size").cast("string"), F.lit("\r\n\r\n"))
    say = [("Content-Type", F.lit("application/http; msgtype=response"))]
    response = _record("response", [("WARC-Record-ID", own), *common, *digest, *say], F.concat(http, F.col("_body")))
    revisit = _record("revisit", [("WARC-Record-ID", own), *common, *digest, ("WARC-Refers-To", name("main", F.col("_first._row"))), ("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), *say], http)
    host = F.regexp_extract(safe, "^[a-zA-Z]+://([^/?#]*)", 1)
    target = F.regexp_replace(safe, "^[a-zA-Z]+://[^/?#]*", "")
    ask = F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))
    request = _record("request", [("WARC-Record-ID", name("request", F.col("_row"))), *common, ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http; msgtype=request"))], ask)
    fields = F.concat(F.lit("capture-id: "), F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit("\r\n"))
    metadata = _record("metadata", [("WARC-Record-ID", name("metadata", F.col("_row"))), *common, ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))], fields)
    three = F.concat_ws("\r\n\r\n", request, F.when(F.col("_again"), revisit).otherwise(response), metadata)
    rows.select(three.alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").mode("overwrite").text(path)


def _head(block: bytes) -> dict[str, str]:
    out = {}
    for line in block.split(b"\r\n"):
        k, colon, v = line.partition(b":")
        if colon:
            out[k.strip().decode("utf-8", "replace").lower()] = v.strip().decode("utf-8", "replace")
    return out


def _inflated(data: bytes) -> Iterator[bytes]:
    """An archive, plain or gzip (one member or many), in steps."""
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(data), STEP):
            yield data[at : at + STEP]
        return
    view, at = memoryview(data), 0
    while at < len(data):
        member, tail = zlib.decompressobj(31), b""
        while at < len(data) and not member.eof:
            own = tail or view[at : at + STEP]
            made = member.decompress(own, STEP)
            if not tail:
                at += len(own)
            tail = member.unconsumed_tail
            if made:
                yield made
            while tail and not member.eof:
                made = member.decompress(tail, STEP)
                tail = member.unconsumed_tail
                yield made
        if not member.eof:
            raise ValueError("the archive ends within a gzip member")
        at -= len(member.unused_data)
        while at < len(data) and data[at] == 0:
            at += 1


def parse_warc(data: bytes, with_payload: bool = True) -> Iterator[dict]:
    """Records of an archive as rows of ``read_warc``; raises ValueError where a record is cut short."""
    parts = _inflated(data)
    buf, at = bytearray(), 0

    def more() -> bool:
        nonlocal at
        part = next(parts, None)
        if part is None:
            return False
        del buf[:at]
        at = 0
        buf.extend(part)
        return True

    while True:
        while len(buf) - at < 2 and more():
            pass
        while buf[at : at + 2] == b"\r\n":
            at += 2
            while len(buf) - at < 2 and more():
                pass
        if at >= len(buf):
            return
        seen = at
        while (end := buf.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(buf) - at - 3)
            if not more():
                raise ValueError("no WARC record where one should begin")
        if buf[at : at + 5] != b"WARC/":
            raise ValueError("no WARC record where one should begin")
        head = _head(bytes(buf[at:end]))
        size = int(head["content-length"])
        at = end + 4
        while len(buf) - at < size:
            if not more():
                raise ValueError(f"record {head.get('warc-record-id')} is cut short")
        block = bytes(buf[at : at + size])
        at += size
        mime = head.get("content-type", "")
        http, fields, payload = None, {}, block
        if mime.startswith("application/http"):
            top, _, payload = block.partition(b"\r\n\r\n")
            http, _, rest = top.partition(b"\r\n")
            http, fields = http.decode("utf-8", "replace"), _head(rest)
        elif mime == "application/warc-fields":
            fields = _head(block)
        full = head["warc-type"] != "revisit"
        yield {
            "record_id": head.get("warc-record-id"), "type": head["warc-type"], "concurrent_to": head.get("warc-concurrent-to"), "refers_to": head.get("warc-refers-to"), "uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "mime": mime,
            "payload_bytes": len(payload) if full else None, "payload_digest": hashlib.sha256(payload).hexdigest() if full else None, "http": http, "fields": list(fields.items()), "payload": payload if with_payload and full else None,
        }


def read_warc(spark, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of all archives below path."""
    arrow = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}.get(t, pa.string())) for n, t in (c.split(" ") for c in _RECORD.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                rows: list[dict] = []
                size = 0
                for r in parse_warc(b.column(0)[i].as_py(), with_payload):
                    rows.append(r)
                    size += len(r["payload"] or b"") + 500
                    if size > 1 << 24:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(tx.tidied(run), _RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, main, request, metadata, and refers (what a revisit repeats).

    A record belongs to the capture it names in concurrent_to, else to its own.
    Captures without a response or revisit have a null main; of several
    different records of a kind, that with the least id counts. A capture that
    is in the archives several times gives as many rows. refers is null for
    responses and for revisits of records that are not in the archives.
    """
    body = F.struct(*[F.col(c) for c in records.columns if c != "fields"], F.map_entries("fields").alias("fields"))
    kind = lambda *types: F.min(F.when(F.col("type").isin(*types), body))
    whole = records.withColumn("capture_id", F.coalesce("concurrent_to", "record_id")).groupBy("capture_id").agg(kind("response", "revisit").alias("main"), kind("request").alias("request"), kind("metadata").alias("metadata"), F.count_if(F.col("type").isin("response", "revisit")).alias("_times"))
    said = F.col("metadata.fields")
    whole = whole.withColumn("capture_number", F.try_element_at(F.map_from_entries(F.coalesce(said, F.array().cast(said_type))), F.lit("capture-id")).try_cast("long"))
    target = whole.filter("main.type = 'response'").select(F.col("main.record_id").alias("_rid"), F.struct("capture_number", F.col("main.payload_bytes").alias("payload_bytes"), F.col("main.payload_digest").alias("payload_digest")).alias("refers"))
    out = whole.join(target, whole["main.refers_to"] == target["_rid"], "left").withColumn("_rid", F.explode(F.sequence(F.lit(1), F.greatest(F.col("_times").cast("int"), F.lit(1)))))
    return out.drop("_rid", "_times")


said_type = "array<struct<key:string,value:string>>"


def round_trip(captures: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes archives to the shared folder, reads them back and returns one row per capture."""
    spark = captures.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_warc(captures, path, id_col, url_col, payload_col, least=least, file_bytes=file_bytes)
    whole = assemble(read_warc(spark, path, with_payload=False))
    again = F.col("main.type") == "revisit"
    return whole.select(
        F.col("capture_number").alias(id_col), F.when(again, F.col("refers.payload_bytes")).otherwise(F.col("main.payload_bytes")).alias("payload_bytes"),
        F.when(again, F.col("refers.payload_digest")).otherwise(F.col("main.payload_digest")).alias("payload_digest"), F.col("main.type").alias("record_type"),
        F.when(again, F.col("refers.capture_number")).alias("refers_to"), F.col("main.uri").alias("target_uri"), F.col("request.http").alias("request_line"), F.col("capture_id"),
    )
