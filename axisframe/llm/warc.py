"""WARC archives: written from captures, read back, and assembled to one row per transaction.

Every capture is a request, a response (or a revisit of an equal payload) and
a metadata record; the request and the metadata name the response in
``WARC-Concurrent-To``.  Archives are gzipped WARC/1.1 files in the shared
folder.  Their payloads are UTF-8, so Spark's text writer writes them, with the
blank lines that close a record as its line separator.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import new_path, ready, saved, small_side, spread_join

#: Bytes of payload of one archive at most, but for a single longer one, as a file is read whole by one task; and what makes a payload long.
FILE_BYTES, LONG_BYTES = 1 << 27, 1 << 17
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hex_digest: Column) -> Column:
    """The upper-case base32 of a 40-digit hexadecimal digest."""
    fives = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.lpad(F.conv(F.substring(hex_digest, k * 10 + 1, F.lit(10)), 16, 32), 8, "0"))
    return F.translate(F.lower(F.concat_ws("", fives)), "0123456789abcdefghijklmnopqrstuv", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uri(url: Column) -> Column:
    """A URL that fits on a header line: blanks and control characters are percent-encoded."""
    return F.regexp_replace(F.regexp_replace(url, r"[\r\n\t]", "%20"), r"[\x00-\x20\x7F]", "%20")


def _record(kind: Column | str, record: Column, content: str, block: Column, *more: Column) -> Column:
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind), F.concat(F.lit("WARC-Record-ID: "), record), F.lit("WARC-Date: 2020-01-01T00:00:00Z"), *more, F.lit(f"Content-Type: {content}"), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(head, F.lit("\r\n\r\n"), block)


def deduplicated(pages: DataFrame) -> DataFrame:
    """The captures with their record's name, payload, sha1 and size, and for all but the largest page_id of equal payloads, the page_id and the name of the response they revisit.

    A name is the page_id and a hash of url and payload, so that rows that
    repeat a page_id are told apart unless they are equal.
    """
    payload = F.coalesce("html", F.lit(""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload.cast("binary")).alias("sha1")).withColumn("size", F.octet_length("payload"))
    about = F.sha1(F.concat_ws("|", F.coalesce(F.col("url").isNotNull().cast("string")), F.coalesce("url", F.lit("")), "sha1").cast("binary"))
    own = own.withColumn("name", F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.substring(about, 1, 16)))
    of = own.filter("page_id is not null").groupBy("sha1", "size").agg(F.max(F.struct("page_id", "name")).alias("response"), F.count(F.lit(1)).alias("n"))
    # Only payloads that are there more than once have anything to say.
    of = saved(of.filter("n > 1").select("sha1", "size", F.col("response.page_id").alias("response_id"), F.col("response.name").alias("response_name")), "repeated-payloads")
    return own.join(small_side(of), ["sha1", "size"], "left")


def write(pages: DataFrame) -> str:
    """Writes the archives of ``pages`` (page_id, url, html) and returns their folder."""
    spark, path = ready(pages.sparkSession), new_path(pages.sparkSession, "warc")
    urn = lambda kind, name: F.concat(F.lit(f"<urn:x-capture:{kind}:"), F.col(name), F.lit(">"))
    revisit = F.coalesce(F.col("page_id") < F.col("response_id"), F.lit(False))
    kept = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"), kept)
    uri = _uri(F.coalesce("url", F.lit("urn:x-none")))
    target, together = F.concat(F.lit("WARC-Target-URI: "), uri), F.concat(F.lit("WARC-Concurrent-To: "), urn("response", "name"))
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("sha1")))
    refers = [F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn("response", "response_name"))), F.when(revisit, F.lit(f"WARC-Profile: {_PROFILE}"))]
    get = F.concat(F.lit("GET "), uri, F.lit(" HTTP/1.1\r\n\r\n"))
    about = F.concat_ws("\r\n", F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))), F.concat(F.lit("hasUrl: "), F.col("url").isNotNull().cast("string")), F.lit(""))
    records = F.array(
        _record("request", urn("request", "name"), "application/http; msgtype=request", get, target, together),
        _record(F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), urn("response", "name"), "application/http; msgtype=response", http, target, digest, *refers),
        _record("metadata", urn("metadata", "name"), "application/warc-fields", about, target, together),
    )
    most = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    for part, size in (("short", LONG_BYTES), ("long", most)) if most > LONG_BYTES else (("short", LONG_BYTES),):
        rows = deduplicated(pages).filter(F.col("size") > LONG_BYTES if part == "long" else F.col("size") <= LONG_BYTES).select(F.explode(records).alias("record"))
        rows.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", 3 * max(1, FILE_BYTES // size)).option("compression", "gzip").text(f"{path}/{part}")
    return path


_HEADER = re.compile(rb"WARC/1\.[01]\r\n(.*?)\r\n\r\n", re.S)
_FIELDS = ("warc_type", "record_id", "target_uri", "concurrent_to", "payload_digest", "refers_to")
_NAMES = {"WARC-Type": 0, "WARC-Record-ID": 1, "WARC-Target-URI": 2, "WARC-Concurrent-To": 3, "WARC-Payload-Digest": 4, "WARC-Refers-To": 5}


def records(data: bytes):
    """(header fields, block) of each record; lengths alone say where a block ends, whatever is in it."""
    at = 0
    while head := _HEADER.match(data, at):
        fields: list = [None] * 6
        length = 0
        for line in head[1].decode("utf-8", "replace").split("\r\n"):
            name, _, value = line.partition(": ")
            if name in _NAMES:
                fields[_NAMES[name]] = value
            elif name == "Content-Length":
                length = int(value)
        yield fields, data[head.end() : head.end() + length]
        at = head.end() + length + 4
    if data[at:].strip():
        raise ValueError(f"no WARC record at byte {at}")


def _plain(data: bytes) -> bytes:
    """The bytes of an archive, of all its gzip members if it is compressed."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data))
        data = member.unused_data
    return b"".join(out) if out else data


def _payload_bytes(fields: list, block: bytes) -> int | None:
    """How many bytes of payload a response has; raises if they aren't those that its digest was taken of."""
    if fields[0] != "response":
        return None
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    if fields[4] and base64.b32encode(hashlib.sha1(payload).digest()).decode() != fields[4].removeprefix("sha1:"):
        raise ValueError(f"the payload of {fields[1]} doesn't match its digest")
    return len(payload)


def read(spark, path: str) -> DataFrame:
    """A row per record of the archives: the header's fields, the block, and how many bytes of payload it has if it is a response."""

    def made(batches):
        schema = pa.schema([*((x, pa.string()) for x in _FIELDS), ("payload_bytes", pa.int64()), ("block", pa.binary())])
        for batch in batches:
            for data in batch.column(0):
                rows: list = [[] for _ in schema]
                size = 0
                for fields, block in records(_plain(data.as_py())):
                    for own, v in zip(rows, (*fields, _payload_bytes(fields, block), block)):
                        own.append(v)
                    size += len(block)
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(rows, schema)], schema=schema)
                        rows, size = [[] for _ in schema], 0
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(rows, schema)], schema=schema)

    files = ready(spark).read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(made, ", ".join(f"{x} string" for x in _FIELDS) + ", payload_bytes long, block binary")


def _http(block: Column) -> tuple[Column, Column]:
    """The header (as text) and the body of an HTTP message."""
    head = F.substring_index(F.decode(block, "ISO-8859-1"), "\r\n\r\n", 1)
    return head, F.substring(block, F.length(head) + 5, F.octet_length(block))


def transactions(archive: DataFrame) -> DataFrame:
    """One row per capture: capture_id, target_uri, copies, and nested request, response and metadata.

    Records are joined by the id they are concurrent to (a response by its
    own).  A capture without one of the records has nulls there.  Records
    that repeat an id count once, and ``copies`` tells how often a response
    does; records without an id go.
    """
    key = F.coalesce("concurrent_to", "record_id")
    head, body = _http(F.col("block"))
    kind = F.col("warc_type")
    side = lambda k, value: F.max(F.when(kind.isin(*k), value))
    answer = F.struct("record_id", F.col("warc_type").alias("type"), F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "refers_to", head.alias("http_header"), "payload_bytes")
    rows = archive.filter(key.isNotNull()).groupBy(key.alias("capture_id")).agg(
        F.max("target_uri").alias("target_uri"),
        F.count(F.when(kind.isin("response", "revisit"), 1)).alias("copies"),
        side(["request"], F.struct("record_id", head.alias("http_header"))).alias("request"),
        side(["response", "revisit"], answer).alias("answer"),
        # Apart from the rest, so that who doesn't ask for payloads doesn't move them.
        side(["response", "revisit"], body).alias("payload"),
        side(["metadata"], F.struct("record_id", F.decode("block", "UTF-8").alias("fields"))).alias("metadata"),
    )
    response = F.struct(*(F.col("answer")[c].alias(c) for c in ("record_id", "type", "payload_digest", "refers_to", "http_header", "payload_bytes")), "payload")
    return rows.select("capture_id", "target_uri", "copies", "request", response.alias("response"), "metadata")


def captures(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to for every row of ``pages``, all from archives written and read back.

    Of equal payloads the largest page_id is the response and the others
    revisit it; a revisit's payload is that of the response it refers to.  A
    null html is an empty payload, a null url has no target.  A row with a
    null page_id is always a response.  Rows that repeat a page_id are
    captures of their own, equal ones too.  An empty table gives no rows.
    Other columns are ignored.
    """
    table = transactions(read(pages.sparkSession, write(pages)))
    # An empty match isn't a number.
    number = lambda c, pattern: F.regexp_extract(c, pattern, 1).try_cast("long")
    copy = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    answer = ["record_id", "type", "payload_digest", "refers_to", "payload_bytes"]
    table = saved(table.filter("copies > 0").select(number("metadata.fields", r"pageId: (\S+)").alias("page_id"), copy, *(F.col(f"response.{c}").alias(c) for c in answer)), "captures")
    revisits = table.filter("type = 'revisit'").drop("payload_bytes")
    asked = revisits.groupBy("refers_to").agg(F.count(F.lit(1)).alias("n"))
    found = asked.join(table.filter("type = 'response' and copy = 1").select(F.col("record_id").alias("refers_to"), "payload_bytes"), "refers_to")
    revisits = spread_join(revisits, found, ("refers_to",), "n", "page_id")
    of = lambda rows, refers: rows.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), refers.alias("refers_to"))
    return of(table.filter("type = 'response'"), F.lit(None).cast("long")).union(of(revisits, number("refers_to", r":(-?\d+):[0-9a-f]+>$")))
