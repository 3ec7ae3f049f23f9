"""WARC archives: writing page captures, reading records back, assembling transactions.

Spark's text writer writes the archives, so any file system and any retry will do: a row holds the
records of one capture and the line separator is the two line ends that close a WARC record.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: Uncompressed bytes that an archive should have; each is read back as one value.
FILE_BYTES = 32 << 20
#: Payloads of fewer bytes are never revisited.
REVISIT_BYTES = 1000
END = "\r\n\r\n"
_DATE = "2020-01-01T00:00:00Z"

RECORD = (
    "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, content_type string, "
    "header_digest string, http_length long, payload_bytes long, payload_digest string, payload binary, fields map<string, array<string>>, error string"
)


def _record(kind: Column | str, uid: Column, fields: list[tuple[str, Column]], block: Column) -> Column:
    """A record without the line ends that close it; fields that are null are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    lines = [F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: <urn:uuid:"), uid, F.lit(f">\r\nWARC-Date: {_DATE}"))]
    lines += [F.coalesce(F.concat(F.lit(f"\r\n{name}: "), value), F.lit("")) for name, value in fields]
    head = F.concat(*lines, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END))
    return F.concat(head, block)


def _uuid(kind: str, name: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind), name).cast("binary"))
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_revisit: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Writes gzipped archives below ``path``: a request, a response or revisit, and metadata a row.

    Payload is the body in UTF-8, a null one empty.  Among equal payloads (by SHA-1 and length) of
    at least ``min_revisit`` bytes the largest id has the response and the others revisit it, null ids
    too; all smaller ones have responses.  The id goes into the metadata; spaces and control
    characters of the target are written as %XX.  Rows that repeat an id and its payload are written
    each, under the same record ids.
    Only ids, digests and lengths are grouped, with pre-aggregation; bodies move once, in the join
    that adaptive execution splits where one digest is very common; those too small for a revisit
    have keys of their own there.  Bodies over a sixteenth of ``file_bytes`` have archives of their
    own, so that none grows far beyond the greater of ``file_bytes`` and one record.  An archive is one gzip
    member, as Spark's writer makes it, and cannot be entered in the middle.  An empty table gives no record.
    """
    base = pages.select(
        F.col(id_col).alias("id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(body_col).cast("string"), F.lit("")).alias("body"),
    )
    base = base.withColumn("sha1", F.sha1(F.col("body").cast("binary"))).withColumn("size", F.octet_length("body").cast("long"))
    keys = cut(base.select("id", "sha1", "size"))
    big = F.col("size") > max(min_revisit, file_bytes >> 4)
    measure = lambda of: (F.coalesce(F.sum(F.when(of, F.col("size"))), F.lit(0)), F.count(F.when(of, 1)))
    total, rows, big_total, big_rows = keys.agg(*measure(~big), *measure(big)).first()
    groups = keys.where(F.col("size") >= min_revisit).groupBy("sha1", "size").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    base = base.withColumn("key", F.when(F.col("size") >= min_revisit, F.col("sha1")).otherwise(F.concat(F.lit("-"), F.xxhash64("id", "url").cast("string"))))
    joined = base.join(groups.select(F.col("sha1").alias("key"), "size", "first"), ["key", "size"], "left")

    # the same for rows that repeat in full, and for the response of a group whatever row has it
    named = lambda i: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("null")), F.col("sha1"))
    name, first = F.concat_ws(":", named(F.col("id")), F.when(F.col("id").isNull(), F.xxhash64("url").cast("string"))), named(F.col("first"))
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    uid = _uuid("response", name)
    target = F.col("url")
    for code in (*range(33), 127):
        target = F.replace(target, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    target = F.when(F.regexp_like("url", F.lit("[\\x00-\\x20\\x7f]")), target).otherwise(F.col("url"))
    here = [("WARC-Target-URI", target)]
    with_ = [("WARC-Concurrent-To", F.concat(F.lit("<urn:uuid:"), uid, F.lit(">")))]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    response = _record(
        F.when(revisit, "revisit").otherwise("response"),
        uid,
        here
        + [("Content-Type", F.lit("application/http;msgtype=response")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1")))]
        + [("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))), ("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:uuid:"), _uuid("response", first), F.lit(">"))))],
        F.when(revisit, http).otherwise(F.concat(http, F.col("body"))),
    )
    ask = F.concat(F.lit("GET "), F.coalesce(target, F.lit("/")), F.lit(" HTTP/1.1"), F.lit(END))
    request = _record("request", _uuid("request", name), here + with_ + [("Content-Type", F.lit("application/http;msgtype=request"))], ask)
    facts = F.coalesce(F.concat(F.lit("page-id: "), F.col("id").cast("string"), F.lit("\r\n")), F.lit("\r\n"))
    metadata = _record("metadata", _uuid("metadata", name), here + with_ + [("Content-Type", F.lit("application/warc-fields"))], facts)
    lines = joined.select("size", F.concat(request, F.lit(END), response, F.lit(END), metadata).alias("value"))
    for of, total, rows in ((big, big_total, big_rows), (~big, total, rows)):
        per_file = max(1, int(file_bytes * rows / (total + 1200 * rows))) if rows else 1
        if rows or of is not big and not big_rows:  # of an empty table, one archive without records
            lines.where(of).select("value").write.mode("append").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


_PIECE = 32 << 10


def unpack(raw: bytes) -> tuple[bytes, str | None]:
    """The bytes of an archive, its gzip members unpacked, and what is wrong with these.

    A member that is damaged or cut short gives what can be read of it; reading goes on at the next.
    """
    if raw[:2] != b"\x1f\x8b":
        return raw, None
    out, at, error = [], 0, None
    while 0 <= at < len(raw):
        z, begin = zlib.decompressobj(31), at
        try:
            while at < len(raw) and not z.eof:
                out.append(z.decompress(raw[at : at + _PIECE]))
                at += min(_PIECE, len(raw) - at)
            at -= len(z.unused_data)
            if z.eof and (at >= len(raw) or raw[at : at + 2] == b"\x1f\x8b"):
                continue
            error = error or ("bytes after a gzip member" if z.eof else "truncated gzip member")
            if not z.eof:
                break
        except zlib.error:
            error = "damaged gzip member"
        at = raw.find(b"\x1f\x8b\x08", max(at, begin + 1) if z.eof else begin + 1)
    return b"".join(out), error


def _next_record(data: bytes, at: int) -> int:
    found = data.find(b"\r\nWARC/", at)
    return len(data) if found < 0 else found + 2


def records(raw: bytes):
    """(header, block, error) of each record of an archive; gzip members and plain bytes are both read.

    Header names are lower-cased; of a repeated one the first counts.  A record's length is what its
    header says, so blocks may hold anything.  Where that cannot be, or bytes are no record at all,
    ``error`` says so, the block is what there is up to the next record, and reading goes on there.
    """
    data, broken = unpack(raw)
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        if data[at : at + 5] != b"WARC/":
            stop = _next_record(data, at)
            yield {}, data[at:stop], "not a record"
            at = stop
            continue
        end = data.find(b"\r\n\r\n", at)
        header = {}
        for line in data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            header.setdefault(k.strip().lower(), v.strip())
        size = header.get("content-length", "")
        if end < 0:
            yield header, b"", broken or "truncated"
            return
        stop = end + 4 + int(size) if size.isascii() and size.isdigit() and len(size) < 16 else -1
        if 0 <= stop <= len(data):
            yield header, data[end + 4 : stop], None
        else:
            why = "bad content-length" if stop < 0 else broken or "truncated"
            stop = _next_record(data, end + 2)
            yield header, data[end + 4 : stop], why
        at = stop
    if broken:
        yield {}, b"", broken


def dechunk(body: bytes) -> bytes | None:
    """A chunked HTTP body put together; None if it is not well formed."""
    out, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        size = body[at:end].split(b";")[0].strip()
        if not size or len(size) > 15 or size.strip(b"0123456789abcdefABCDEF"):
            return None
        n = int(size, 16)
        if not n:
            return b"".join(out)
        if end + 2 + n > len(body):
            return None
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
    return None


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives (.gz and .warc) below ``path``, with the schema RECORD.

    payload_bytes and payload_digest (SHA-1, hex) are of the bytes found in response records, after
    the HTTP header, and null for other types; ``payload`` false leaves out the bytes themselves.
    A chunked body is put together; a content coding such as gzip stays, as it is part of the payload.
    ``http_length`` is the length that the HTTP header gives, null if it is no number; ``fields``
    those of metadata, each with all its values.  What is damaged gives a row with ``error`` and no
    payload, and the other records of the archive are read all the same.  An archive is one value of
    at most 2 GB.
    """

    def parse(batches):
        def row(header, block, error):
            of = lambda k: header.get(k)
            plain = lambda k: header[k].strip("<>").removeprefix("urn:uuid:") if k in header else None
            kind, body, length, facts = of("warc-type"), None, None, None
            if kind in ("response", "revisit"):
                head, _, rest = block.partition(b"\r\n\r\n")
                for line in head.lower().split(b"\r\n")[1:]:
                    name, _, value = (x.strip() for x in line.partition(b":"))
                    if name == b"content-length":
                        length = int(value) if value.isdigit() and len(value) < 16 else None
                    elif name == b"transfer-encoding" and value.endswith(b"chunked"):
                        whole = dechunk(rest)
                        rest = rest if whole is None else whole
                body = rest if kind == "response" and not error else None
            elif kind == "metadata":
                lists: dict[str, list[str]] = {}
                for k, m, v in (x.partition(":") for x in block.decode("utf-8", "replace").split("\r\n")):
                    if m:
                        lists.setdefault(k.strip(), []).append(v.strip())
                facts = list(lists.items())
            return (
                plain("warc-record-id"), kind, plain("warc-concurrent-to"), plain("warc-refers-to"), of("warc-target-uri"), of("warc-date"), of("content-type"),
                of("warc-payload-digest"), length, None if body is None else len(body), None if body is None else hashlib.sha1(body).hexdigest(), body if payload else None, facts, error,
            )

        kinds = [pa.string()] * 8 + [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.map_(pa.string(), pa.list_(pa.string())), pa.string()]
        names = [x.split()[0] for x in RECORD.split(", ")[:12]] + ["fields", "error"]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for k in range(batch.num_rows):
                rows, held = [], 0
                for header, block, error in records(batch.column("content")[k].as_buffer().to_pybytes()):
                    rows.append(row(header, block, error))
                    held += len(block) if payload else 0
                    if len(rows) >= 4096 or held > 8 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(parse, RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: (capture_id, target_uri, date, response, request, metadata, original).

    Requests and metadata join the response or revisit that they name as concurrent; of several,
    the one with the least record id counts.  A revisit's ``original`` is the response it refers to,
    with that one's metadata; payload size and digest come from there.  Records that name no known
    response form no capture, nor do those without an id; a revisit of an unknown record has a null
    original.  A damaged response is a capture whose response.error says why.
    """
    held = ["record_id", "payload_bytes", "payload_digest", "payload", "header_digest", "http_length", "error"]
    response = found.where("type in ('response', 'revisit') and record_id is not null").select(
        F.col("record_id").alias("capture_id"), "target_uri", "date", "refers_to", F.struct("type", *held).alias("response")
    )

    def beside(kind: str) -> DataFrame:
        some = found.where((F.col("type") == kind) & F.col("concurrent_to").isNotNull())
        return some.groupBy(F.col("concurrent_to").alias("capture_id")).agg(F.min(F.struct("record_id", "target_uri", F.map_entries("fields").alias("fields"))).alias(kind))

    joined = response.join(beside("request"), "capture_id", "left").join(beside("metadata"), "capture_id", "left")
    shaped = joined.withColumn("metadata", F.when(F.col("metadata").isNotNull(), F.struct("metadata.record_id", F.map_from_entries("metadata.fields").alias("fields"))))
    shaped = shaped.withColumn("request", F.when(F.col("request").isNotNull(), F.struct("request.record_id", "request.target_uri")))
    originals = shaped.where("response.type = 'response'").select(
        F.col("capture_id").alias("refers_to"), F.struct(*(F.col(f"response.{c}").alias(c) for c in ("record_id", "payload_bytes", "payload_digest")), F.col("metadata.fields").alias("fields")).alias("original")
    )
    originals = originals.groupBy("refers_to").agg(F.first("original").alias("original"))
    plain = shaped.where("response.type = 'response'").withColumn("original", F.lit(None).cast(originals.schema["original"].dataType))
    again = shaped.where("response.type = 'revisit'").join(originals, "refers_to", "left")
    cols = ["capture_id", "target_uri", "date", "response", "request", "metadata", "original"]
    return plain.select(cols).unionByName(again.select(cols))


def archived_pages(pages: DataFrame, path: str) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to archives at ``path`` and assembles what is read back."""
    write_warc(pages, path)
    return assemble(cut(read_warc(pages.sparkSession, path, payload=False)))
