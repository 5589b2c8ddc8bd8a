"""WARC archives: writing captures, reading records back and assembling transactions.

Each page becomes a request, a response (or a revisit of an equal payload) and a metadata record, tied
by WARC-Concurrent-To. Records are rows of text that Spark's own writer puts into gzip files, a blank line
after each, so the archive goes to any store and survives lost executors. Reading streams through the files
line by line and follows Content-Length. Assembly joins the records of a
transaction through their concurrent-to identifiers and emits one nested row a capture.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, table

#: Payloads of fewer bytes are always stored as responses.
MIN_REVISIT_BYTES = 0
RECORDS_A_FILE = 3000
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(hex_digest: Column) -> Column:
    """Bare upper-case base32 of a SHA-1 given in hexadecimal: 8 groups of 20 bits, 4 characters each."""

    def group(i: int) -> list[Column]:
        bits = F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 10).cast("int")
        return [F.substr(F.lit(_BASE32), F.shiftright(bits, 15 - 5 * k).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for k in range(4)]

    return F.concat(*[c for i in range(8) for c in group(i)])


def _urn(*what: Column) -> Column:
    m = F.md5(F.concat_ws("|", *what))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def plan_captures(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest (hexadecimal), first_id and first_url of the response with an equal payload.

    The first page of a payload is found from digests alone; the join back is one that Spark may split by rows when a
    third of all pages share a payload.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.encode("payload", "UTF-8")))
    large = F.octet_length("payload") >= min_revisit_bytes
    first = rows.where(large).groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("n"), "page_id", "url")).alias("f"), F.count("*").alias("pages"))
    first = first.where("pages > 1").select(F.col("digest").alias("_d"), F.col("f.page_id").alias("first_id"), F.col("f.url").alias("first_url"))
    return rows.join(first, (F.col("digest") == F.col("_d")) & large, "left").drop("_d")


def to_records(captures: DataFrame) -> DataFrame:
    """One text column: the records of all captures."""
    crlf = "\r\n"
    clean = lambda c: F.regexp_replace(c, "[\\x00-\\x20]", "%20")
    url = clean(F.col("url"))
    digest = base32_sha1(F.col("digest"))
    revisit = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    ident = lambda kind, page, u: _urn(F.lit(kind), F.coalesce(page.cast("string"), F.lit("null")), u, F.col("digest"))
    own = ident("response", F.col("page_id"), F.col("url"))
    base = captures.select(
        "page_id", "payload", "first_id", url.alias("url"), clean(F.col("first_url")).alias("first_url"), digest.alias("digest"), revisit.alias("revisit"),
        own.alias("own"), ident("response", F.col("first_id"), F.col("first_url")).alias("first"), ident("request", F.col("page_id"), F.col("url")).alias("req"), ident("metadata", F.col("page_id"), F.col("url")).alias("meta"),
        F.octet_length("payload").alias("bytes"),
    )
    date = F.lit("2000-01-01T00:00:00Z")

    def record(kind: Column, ident: Column, mime: str, more: Column, block: Column) -> Column:
        head = F.concat(
            F.lit(f"WARC/1.1{crlf}WARC-Type: "), kind, F.lit(f"{crlf}WARC-Record-ID: "), ident, F.lit(f"{crlf}WARC-Date: "), date,
            F.lit(f"{crlf}WARC-Target-URI: "), F.col("url"), more, F.lit(f"{crlf}Content-Type: {mime}{crlf}Content-Length: "), F.octet_length(block).cast("string"), F.lit(crlf * 2),
        )
        return F.concat(head, block)

    tied = F.concat(F.lit(f"{crlf}WARC-Concurrent-To: "), F.col("own"))
    host = F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    request = F.concat(F.lit("GET "), F.col("url"), F.lit(f" HTTP/1.1{crlf}Host: "), host, F.lit(crlf * 2))
    answer = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.col("bytes").cast("string"), F.lit(crlf * 2))
    said = F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(f"{crlf}revisitOf: "), F.when(F.col("revisit"), F.col("first_id").cast("string")).otherwise(F.lit("")), F.lit(crlf))
    digest_line = F.concat(F.lit(f"{crlf}WARC-Payload-Digest: sha1:"), F.col("digest"))
    points = F.concat(digest_line, F.lit(f"{crlf}WARC-Profile: {_REVISIT}{crlf}WARC-Refers-To: "), F.col("first"), F.lit(f"{crlf}WARC-Refers-To-Target-URI: "), F.coalesce("first_url", F.lit("")), F.lit(f"{crlf}WARC-Refers-To-Date: "), date)
    main = F.when(F.col("revisit"), record(F.lit("revisit"), F.col("own"), "application/http; msgtype=response", points, answer)).otherwise(
        record(F.lit("response"), F.col("own"), "application/http; msgtype=response", digest_line, F.concat(answer, F.col("payload")))
    )
    return base.select(
        F.explode(
            F.array(
                record(F.lit("request"), F.col("req"), "application/http; msgtype=request", tied, request),
                main,
                record(F.lit("metadata"), F.col("meta"), "application/warc-fields", tied, said),
            )
        ).alias("value")
    )


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Writes gzip files of records under path. Null html is an empty payload, a null url an empty one; all rows are written.

    Of rows with equal payloads that with the smallest page_id is the response (null ids come last; rows that repeat an id are all responses of it).
    Extra columns are left out. An empty table writes no record. Payloads may be as long as a row of Spark's holds.
    """
    records = to_records(plan_captures(pages, min_revisit_bytes))
    records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


RECORD_SCHEMA = "type string, record_id string, concurrent_to string, target_uri string, date string, refers_to_id string, digest string, payload_bytes long, page_id long, refers_to long, payload binary"
#: The type of what should be a record but has no end of its header, no valid Content-Length, or fewer bytes than that tells.
DAMAGED = "damaged"


def records(lines):
    """(headers in lower case, block) of each record, from (file, line) in order; lines were separated by CRLF.

    Only the record at hand is held. One that is damaged gives its headers so far with the type DAMAGED and the bytes read, and reading
    goes on at the next line that begins a record. Files never share a record.
    """
    at, head, size, got, block = None, None, -1, 0, []

    def end(whole: bool):
        return (head if whole else head | {"warc-type": DAMAGED}), b"".join(block)[: size if size >= 0 else None]

    for file, line in lines:
        if file != at:
            if head is not None:
                yield end(False)
            at, head, size = file, None, -1
        if head is not None and size >= 0:
            block.append(line + b"\r\n")
            got += len(line) + 2
        elif line.startswith(b"WARC/"):
            if head is not None:
                yield end(False)
            head, got, block = {}, 0, []
        elif head is not None and line:
            key, _, value = line.decode("utf-8", "replace").partition(":")
            head[key.strip().lower()] = value.strip()
        elif head is not None:
            told = head.get("content-length", "")
            if not (told.isascii() and told.isdigit()):
                yield end(False)
                head = None
                continue
            size = int(told)
        if head is not None and 0 <= size <= got:
            yield end(True)
            head, size = None, -1
    if head is not None:
        yield end(False)


def inflate(data: bytes) -> bytes:
    """The bytes of a gzip file of one or many members, or the data itself; what a broken member still gives is kept."""
    out = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        try:
            out.append(d.decompress(data) + d.flush())
        except zlib.error:
            break
        data = d.unused_data
    return b"".join(out) if out else data


def parse(data: bytes):
    """The records of one archive's bytes, gzip (one or many members) or plain."""
    yield from records((0, line) for line in inflate(data).split(b"\r\n"))


def _number(text: str | None) -> int | None:
    text = (text or "").strip()
    return int(text) if text.lstrip("-").isascii() and text.lstrip("-").isdigit() else None


def _row(head: dict, block: bytes, payload: bool) -> dict:
    row = dict.fromkeys(("type", "record_id", "concurrent_to", "target_uri", "date", "refers_to_id", "digest", "payload_bytes", "page_id", "refers_to", "payload"))
    row |= {"type": head.get("warc-type"), "record_id": head.get("warc-record-id"), "concurrent_to": head.get("warc-concurrent-to"), "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date"), "refers_to_id": head.get("warc-refers-to")}
    if row["type"] == "response":
        body = block.partition(b"\r\n\r\n")[2]
        row["digest"] = base64.b32encode(hashlib.sha1(body).digest()).decode()
        row["payload_bytes"], row["payload"] = len(body), body if payload else None
    elif row["type"] == "revisit":
        row["digest"] = (head.get("warc-payload-digest") or "").rpartition(":")[2]
        sizes = [x.partition(b":")[2] for x in block.partition(b"\r\n\r\n")[0].split(b"\r\n") if x.lower().startswith(b"content-length:")]
        row["payload_bytes"] = _number(sizes[0].decode("ascii", "replace")) if sizes else None
    elif row["type"] == "metadata":
        told = dict(x.split(": ", 1) for x in block.decode("utf-8", "replace").split("\r\n") if ": " in x)
        row["page_id"], row["refers_to"] = _number(told.get("pageId")), _number(told.get("revisitOf"))
    elif row["type"] == DAMAGED:
        row["payload"] = block if payload else None
    return row


def read_records(spark, path: str, payload: bool = True, whole: bool = False) -> DataFrame:
    """One row a record of the archives under path; payload holds a response's bytes, if asked for.

    gzip files are read as a stream of lines, so a file may be of any size and a task holds the record at hand (a payload of up to 2 GB, as Spark's rows
    allow). Plain archives, which Spark would cut between tasks, are read with `whole`, a file at a time. Damaged records are rows of type DAMAGED;
    empty files give none.
    """
    s, i = pa.string(), pa.int64()
    schema = pa.schema([("type", s), ("record_id", s), ("concurrent_to", s), ("target_uri", s), ("date", s), ("refers_to_id", s), ("digest", s), ("payload_bytes", i), ("page_id", i), ("refers_to", i), ("payload", pa.binary())])

    def batched(found):
        rows, held = [], 0
        for head, block in found:
            rows.append(_row(head, block, payload))
            held += len(block) if payload else 0
            if len(rows) == 500 or held > 16_000_000:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def run(batches):
        if whole:
            yield from batched(r for batch in batches for data in batch.column(0) for r in parse(data.as_py()))
        else:
            yield from batched(records((f, v.as_py()) for batch in batches for f, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)))

    if whole:
        return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORD_SCHEMA)
    lines = spark.read.option("lineSep", "\r\n").text(path)
    return lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line")).mapInArrow(run, RECORD_SCHEMA)


def assemble(records: DataFrame, payload: bool = True) -> DataFrame:
    """One row a capture: capture_id and the structs request, response and metadata (null where a record is missing).

    A request or metadata record belongs to the record that it names as concurrent; a response or revisit to itself. Captures
    that were written more than once, from repeated rows, come back as often. Records of other types, and damaged ones, belong to none; extra
    columns are left out, whatever their names. Of two equal records either is taken. An empty table gives an empty one.
    """
    records = records.where(F.col("type").isin("request", "response", "revisit", "metadata"))
    fields = ["type", "record_id", "target_uri", "date"]
    main = F.col("type").isin("response", "revisit")
    of = {"request": (F.col("type") == "request", fields), "response": (main, fields + ["digest", "payload_bytes", "refers_to_id"] + ["payload"] * payload), "metadata": (F.col("type") == "metadata", fields + ["page_id", "refers_to"])}
    joined = records.groupBy(F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to")).alias("capture_id")).agg(
        *[F.first(F.when(test, F.struct(*cols)), ignorenulls=True).alias(name) for name, (test, cols) in of.items()],
        F.greatest(F.count_if(main), F.count_if(F.col("type") == "request"), F.count_if(F.col("type") == "metadata"), F.lit(1)).cast("int").alias("_n"),
    )
    return joined.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")


def op2_warc(spark, sf_dir: str) -> DataFrame:
    """Captures of all pages, written as an archive and read back from it."""
    path = scratch(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    out = assemble(read_records(spark, path, payload=False), payload=False)
    return out.select(
        F.col("metadata.page_id").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.type").alias("record_type"),
        F.col("metadata.refers_to").alias("refers_to"),
    )


def oracle() -> str:
    chars = " || ".join(f"substr('{_BASE32}', 1 + ((('0x' || substr(h, {5 * i + 1}, 5))::INTEGER >> {15 - 5 * k}) & 31), 1)" for i in range(8) for k in range(4))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, {chars} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN NULL ELSE first_id END AS refers_to
FROM p JOIN f USING (h)"""
