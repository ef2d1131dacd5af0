"""WARC archives: write pages as transactions, read records back, assemble captures.

Writing makes three records per page, request, response (or revisit) and metadata, tied by
WARC-Concurrent-To. Archives are written by Spark's text writer, whose line separator is the
record terminator, so any file system that Spark reaches will do. Reading frames records by
Content-Length, in a stream per archive. Assembly joins request and metadata records to the
response that their concurrent-to identifiers name (or that names them) and emits one nested row per capture.

Defined results: null payloads are empty; a null url becomes urn:page:<page_id>; line breaks in a
url are percent-encoded; of equal payloads the smallest page_id is the response (a null one
comes last); rows that repeat page_id and payload are numbered and give a capture each,
all responses where their page_id is the smallest; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.session import materialize, ship

TERMINATOR = "\r\n\r\n"
#: Pages per archive file.
PAGES_PER_FILE = 4000
#: Bytes of payload and number of records that the reader passes on at once.
OUT_BYTES, OUT_RECORDS = 8_000_000, 1000
#: RFC 4648 digits and those that conv() makes.
BASE32, CONV32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("record_id", "type", "target_uri", "date", "content_type")]
    + [T.StructField("concurrent_to", T.ArrayType(T.StringType())), T.StructField("refers_to", T.StringType()), T.StructField("payload_digest", T.StringType()), T.StructField("http_header", T.StringType()), T.StructField("payload", T.BinaryType())]
)


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 SHA-1, without padding (160 bits need none)."""
    digits = F.sha1(data)
    return F.concat(*(F.translate(F.lpad(F.conv(F.substring(digits, 1 + 10 * k, 10), 16, 32), 8, "0"), CONV32, BASE32) for k in range(4)))


def _record_id(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts)))
    return F.concat(F.lit("<urn:uuid:"), *(x for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, b), F.lit("-" if a < 21 else ">"))))


def _record(kind: Column | str, headers: list[tuple[str, Column]], content_type: str, block: Column) -> Column:
    lines = [F.lit("WARC/1.1\r\nWARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind, F.lit("\r\n")]
    for name, value in headers:
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")))
    return F.concat(*lines, F.lit(f"Content-Type: {content_type}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def write_pages(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2025-01-01T00:00:00Z", page_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes gzip-compressed archives to the folder `path`. Payloads of at least min_bytes that repeat become revisits."""
    light = pages.select(F.col(page_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    light = light.withColumn("digest", sha1_base32(F.col("payload").cast("binary"))).withColumn("bytes", F.octet_length("payload").cast("long"))
    per = light.groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    first = per.groupBy("digest").agg(F.min("page_id").alias("first_page"), F.sum("n").alias("copies"), F.max("n").alias("most")).where("copies > 1").drop("copies")
    # as a table, so that the join can split a payload that many pages share
    first = materialize(first, "digests")
    rows = light.join(first, "digest", "left")
    repeated = F.coalesce(F.col("most") > 1, F.lit(False))
    once = rows.where(~repeated).withColumn("copy", F.lit(0))
    if first.where(repeated).isEmpty():
        rows = once
    else:
        number = F.row_number().over(Window.partitionBy("digest", "page_id").orderBy("url")) - 1
        rows = once.unionByName(rows.where(repeated).withColumn("copy", number))
    url = F.replace(F.replace(F.coalesce(F.col("url"), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")))), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = (F.col("bytes") >= min_bytes) & F.col("first_page").isNotNull() & ~F.col("first_page").eqNullSafe(F.col("page_id"))
    response_id, target = _record_id("response", F.col("page_id"), F.col("digest"), F.col("copy")), _record_id("response", F.col("first_page"), F.col("digest"), F.lit(0))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", url)]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    response = _record(
        F.when(revisit, "revisit").otherwise("response"),
        [("WARC-Record-ID", response_id), *common, ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), ("WARC-Refers-To", F.when(revisit, target))],
        "application/http;msgtype=response",
        F.concat(http, F.when(revisit, "").otherwise(F.col("payload"))),
    )
    request = _record("request", [("WARC-Record-ID", _record_id("request", F.col("page_id"), F.col("digest"), F.col("copy"))), *common, ("WARC-Concurrent-To", response_id)], "application/http;msgtype=request", F.concat(F.lit("GET "), url, F.lit(" HTTP/1.1\r\nAccept: */*\r\n\r\n")))
    fields = F.coalesce(F.concat(F.lit("page_id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))
    metadata = _record("metadata", [("WARC-Record-ID", _record_id("metadata", F.col("page_id"), F.col("digest"), F.col("copy"))), *common, ("WARC-Concurrent-To", response_id)], "application/warc-fields", fields)
    rows.select(F.concat_ws(TERMINATOR, request, response, metadata).alias("value")).write.option("lineSep", TERMINATOR).option("compression", "gzip").option("maxRecordsPerFile", PAGES_PER_FILE).text(path)


def records_in(chunks: Iterator[bytes]) -> Iterator[dict]:
    """The records of one archive, from its decompressed bytes piece by piece."""
    held = bytearray()

    def more() -> bool:
        got = next(chunks, None)
        if got is not None:
            held.extend(got)
        return got is not None

    while True:
        while held[:2] == b"\r\n" or (len(held) < 2 and more()):
            if held[:2] == b"\r\n":
                del held[:2]
        if not held:
            return
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                raise ValueError("a WARC header breaks off")
        lines = held[:end].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record where one should start: {lines[0][:40]!r}")
        headers: dict[str, list[str]] = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        one = lambda name, h=headers: h.get(name, [None])[0]
        size = int(one("content-length") or 0)
        while len(held) < end + 4 + size:
            if not more():
                raise ValueError("a WARC block breaks off")
        block = bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size]
        http, payload = None, block
        if (one("content-type") or "").lower().startswith("application/http"):
            head, _, payload = block.partition(b"\r\n\r\n")
            http = head.decode("utf-8", "replace")
        yield {"record_id": one("warc-record-id"), "type": one("warc-type"), "target_uri": one("warc-target-uri"), "date": one("warc-date"), "content_type": one("content-type"), "concurrent_to": headers.get("warc-concurrent-to"), "refers_to": one("warc-refers-to"), "payload_digest": one("warc-payload-digest"), "http_header": http, "payload": payload}


def inflated(data: memoryview, step: int = 1 << 20) -> Iterator[bytes]:
    """Pieces of the decompressed data; gzip members may follow each other, plain data pass through."""
    if bytes(data[:2]) != b"\x1f\x8b":
        for at in range(0, len(data), step):
            yield bytes(data[at : at + step])
        return
    unzip, rest = zlib.decompressobj(31), bytes(data[:step])
    at = step
    while True:
        while rest:
            out = unzip.decompress(rest, 8 * step)
            rest = unzip.unconsumed_tail
            if out:
                yield out
            if unzip.eof:
                rest, unzip = unzip.unused_data, zlib.decompressobj(31)
        if at >= len(data):
            return
        rest = bytes(data[at : at + step])
        at += step


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives in `path`."""
    ship(spark)
    schema = pa.schema([(n, pa.string()) for n in ("record_id", "type", "target_uri", "date", "content_type")] + [("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("http_header", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                held, size = [], 0
                for record in records_in(inflated(memoryview(content.as_buffer()))):
                    held.append(record)
                    size += len(record["payload"])
                    if size > OUT_BYTES or len(held) >= OUT_RECORDS:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, target_uri, date, record_type, refers_to, payload_digest, http_header,
    payload, request struct and metadata struct (null where there is none)."""
    main = records.where(F.col("type").isin("response", "revisit")).dropDuplicates(["record_id"])
    side = records.where(F.col("type").isin("request", "metadata"))
    # a response may itself name the request it belongs to
    named = main.where(F.size("concurrent_to") > 0).select(F.explode("concurrent_to").alias("side_id"), F.col("record_id").alias("named_by"))
    side = side.join(named, side["record_id"] == named["side_id"], "left").select("*", F.coalesce(F.col("named_by"), F.element_at("concurrent_to", 1)).alias("capture"))
    out = main
    for kind in ("request", "metadata"):
        held = side.where(F.col("type") == kind).groupBy("capture").agg(F.min(F.struct("record_id", "http_header", "payload")).alias(kind)).withColumnRenamed("capture", f"{kind}_of")
        out = out.join(held, out["record_id"] == held[f"{kind}_of"], "left").drop(f"{kind}_of")
    return out.select(F.col("record_id").alias("capture_id"), "target_uri", "date", F.col("type").alias("record_type"), "refers_to", "payload_digest", "http_header", "payload", "request", "metadata")
