"""Archives: round trip against a plain reading, hostile payloads, foreign records."""

import gzip
import hashlib

from motionlake.llm.warc import archived_pages, assemble, read_warc, records, write_warc


def brute(rows):
    out, first = [], {}
    for i, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 1000 and i is not None:
            first[raw] = max(first.get(raw, i), i)
    for i, _, h in rows:
        raw = (h or "").encode()
        f = first.get(raw)
        out.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if f is not None and f != i else "response", f if f is not None and f != i else None))
    return sorted(out, key=str)


def shaped(df):
    out = []
    for x in df.collect():
        v = x.response.type == "revisit"
        p = x.original if v else x.response
        page = x.metadata.fields.get("page-id")
        out.append((int(page[0]) if page else None, p.payload_bytes, p.payload_digest, x.response.type, int(x.original.fields["page-id"][0]) if v else None))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path):
    evil = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n" * 30
    big, exact, short = "é" * 600, "y" * 1000, "z" * 999
    rows = [(1, "http://a/ b\r\nX: y", big), (2, None, big), (3, "http://c", big), (4, "u", exact), (9, "u", exact), (5, "u", short), (6, "u", short), (7, "u", None), (8, "u", ""), (10, "u", evil), (None, "u", "lone"), (11, "http://x\u2028", "\r\n\r\n\x00" * 3), (12, "u", "q" * 300000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'k' AS sha1", "3 AS size").repartition(3)
    assert shaped(archived_pages(df, f"file://{tmp_path}/a")) == brute(rows)
    found = read_warc(spark, f"file://{tmp_path}/a")
    assert found.count() == 3 * len(rows)
    bodies = {x.payload_digest: bytes(x.payload) for x in found.where("type = 'response'").collect()}
    assert all(hashlib.sha1(v).hexdigest() == k for k, v in bodies.items())


def test_repeated_rows_and_empty(spark, tmp_path):
    rows = [(1, "u", "x" * 2000), (1, "u", "x" * 2000), (2, "v", "s"), (2, "v", "s")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = shaped(archived_pages(df, f"file://{tmp_path}/b"))
    assert [x[3] for x in got] == ["response"] * 4
    more = spark.createDataFrame([*rows, (0, "w", "x" * 2000), (0, "w", "x" * 2000)], "page_id long, url string, html string")
    assert [x[3:] for x in shaped(archived_pages(more, f"file://{tmp_path}/d"))][:2] == [("revisit", 1)] * 2
    write_warc(df.limit(0), f"file://{tmp_path}/c")
    assert assemble(read_warc(spark, f"file://{tmp_path}/c")).count() == 0


def rec(kind, rid, block, length=None, **more):
    head = "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in more.items())
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{rid}>\r\n{head}Content-Length: {len(block) if length is None else length}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_foreign_archive(spark, tmp_path):
    parts = [
        rec("warcinfo", "i", b"software: x\r\n"),
        rec("request", "q1", b"GET / HTTP/1.1\r\n\r\n", WARC_Concurrent_To="<urn:uuid:r1>"),
        rec("request", "q0", b"GET / HTTP/1.1\r\n\r\n", WARC_Concurrent_To="<urn:uuid:r1>"),
        rec("response", "r1", b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi", WARC_Target_URI="http://h"),
        rec("revisit", "v1", b"HTTP/1.1 200 OK\r\n\r\n", WARC_Refers_To="<urn:uuid:gone>"),
        rec("metadata", "m9", b"a: b\r\n", WARC_Concurrent_To="<urn:uuid:unknown>"),
    ]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)) + gzip.compress(b"WARC/1.0\r\nContent-Length: 99\r\n\r\ncut"))
    got = {x.capture_id: x for x in assemble(read_warc(spark, f"file://{tmp_path}")).collect()}
    assert set(got) == {"r1", "v1"} and got["r1"].request.record_id == "q0" and got["r1"].metadata is None
    assert got["r1"].response.payload_bytes == 2 and got["v1"].original is None
    assert len(list(records(b"".join(parts)))) == 6


HTTP = b"HTTP/1.1 200 OK\r\n\r\n"


def read(spark, folder, name, raw):
    folder.mkdir()
    (folder / name).write_bytes(raw)
    return read_warc(spark, f"file://{folder}")


def test_repeated_metadata_fields(spark, tmp_path):
    raw = rec("response", "r1", HTTP + b"hi") + rec("metadata", "m1", b"outlink: a\r\nvia: x\r\noutlink: b\r\n", WARC_Concurrent_To="<urn:uuid:r1>")
    (got,) = assemble(read(spark, tmp_path / "a", "x.warc", raw)).collect()
    assert got.metadata.fields == {"outlink": ["a", "b"], "via": ["x"]} and got.response.error is None


def test_bad_lengths(spark, tmp_path):
    good = rec("response", "r9", b"HTTP/1.1 200 OK\r\nContent-Length: many\r\n\r\nok")
    for k, length in enumerate(("x", "", "-3", "99999999", "1e3", "9" * 40, "3")):
        raw = rec("response", "r1", HTTP + b"hello", length=length) + good
        for j, zipped in enumerate((raw, gzip.compress(raw), gzip.compress(raw[: -len(good)]) + gzip.compress(good))):
            rows = {x.record_id: x for x in read(spark, tmp_path / f"{k}-{j}", "x.warc.gz", zipped).collect()}
            assert rows["r9"].error is None and bytes(rows["r9"].payload) == b"ok" and rows["r9"].http_length is None
            assert length == "3" or rows["r1"].error and rows["r1"].payload is None, length
            assert length != "3" or rows[None].error == "not a record"


def test_damaged_and_plain_archives(spark, tmp_path):
    parts = [rec("response", f"r{k}", HTTP + bytes([65 + k]) * 3000) for k in range(3)]
    one, each = gzip.compress(b"".join(parts)), b"".join(map(gzip.compress, parts))
    got = lambda name, raw: [(x.record_id, x.error) for x in read(spark, tmp_path / f"{name}", "x.warc.gz", raw).collect()]
    whole = [(f"r{k}", None) for k in range(3)]
    assert got("a", one) == got("b", each) == whole
    # cut short in what closes the member: the records are whole, the damage is told
    assert got("c", one[:-6]) == [*whole, (None, "truncated gzip member")]
    assert got("d", each[:-12])[:2] == whole[:2] and "truncated gzip member" in [e for _, e in got("e", each[:-12])]
    hurt = bytearray(each)
    hurt[len(gzip.compress(parts[0])) + 14] ^= 0xFF
    assert (rows := got("f", bytes(hurt)))[0] == whole[0] and whole[2] in rows and (None, "damaged gzip member") in rows
    assert [(x.record_id, x.error) for x in read(spark, tmp_path / "g", "x.warc", b"".join(parts)[:-1500]).collect()] == [*whole[:2], ("r2", "truncated")]
    assert got("h", b"") == [] and got("i", b"junk") == [(None, "not a record")]
    assert assemble(read_warc(spark, f"file://{tmp_path}/g")).where("response.error = 'truncated'").count() == 1


def test_chunked_body(spark, tmp_path):
    head = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: Chunked\r\n\r\n"
    raw = rec("response", "a", head + b"4\r\nwiki\r\nA;x=1\r\n0123456789\r\n0\r\n\r\n") + rec("response", "b", head + b"zz\r\nno")
    got = {x.record_id: bytes(x.payload) for x in read(spark, tmp_path / "a", "x.warc", raw).collect()}
    assert got == {"a": b"wiki0123456789", "b": b"zz\r\nno"}


def test_large_pages_have_archives_of_their_own(spark, tmp_path):
    rows = [(k, "u", "x" * (90_000 if k % 10 == 0 else 500) + str(k)) for k in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    write_warc(df, f"file://{tmp_path}/a", file_bytes=200_000)
    sizes = [len(gzip.decompress(f.read_bytes())) for f in (tmp_path / "a").glob("*.gz")]
    assert max(sizes) < 300_000 and read_warc(spark, f"file://{tmp_path}/a").count() == 180


def test_ids_that_are_no_numbers(spark, tmp_path):
    df = spark.createDataFrame([("a", "u", "x" * 2000), ("b", "u", "x" * 2000)], "page_id string, url string, html string")
    got = archived_pages(df, f"file://{tmp_path}/a").selectExpr("metadata.fields['page-id'][0] AS id", "response.type", "original.fields['page-id'][0] AS first").collect()
    assert sorted(map(tuple, got)) == [("a", "revisit", "b"), ("b", "response", None)]
