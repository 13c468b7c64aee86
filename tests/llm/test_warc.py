import gzip
import hashlib

import pytest

from longspan.llm import warc
from longspan.llm.common import scratch


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS digest", "1 AS payload", "2 AS refers_to")


def round_trip(spark, df, **options):
    path = scratch(spark)
    warc.write_archive(warc.records(df), path, **options)
    return path, warc.read_records(spark, path)


def test_round_trip_over_small_chunks_and_files(spark):
    big = "é漢<p>\r\n\r\nWARC/1.1\r\n" * 5000
    rows = [(k, f"http://h/{k}", big[k * 3 :] if k % 3 else f"page {k} " * 20) for k in range(30)] + [(40, "http://h/40", "page 3 " * 20), (41, None, None), (42, "u", "short"), (43, "u", "short")]
    path, df = round_trip(spark, pages(spark, rows), chunk_bytes=1000, records_per_file=7)
    got = {r["page_id"]: r for r in df.collect()}
    assert len(got) == len(rows)
    first = {}
    for i, _, html in sorted(rows, key=lambda r: r[0]):
        data = (html or "").encode()
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        origin = first.setdefault(data, i) if len(data) >= 100 else i
        assert (r["record_type"], r["refers_to"]) == (("response", None) if origin == i else ("revisit", origin))
    chunks = warc.read_chunks(spark, path).where("record_type != 'revisit'").collect()
    whole = {}
    for c in sorted(chunks, key=lambda c: (c["record_id"], c["chunk_no"])):
        assert len(c["chunk"]) <= 1000
        whole.setdefault(c["record_id"], (c["page_id"], bytearray()))[1].extend(c["chunk"])
    assert {i: bytes(b).decode() for i, b in whole.values()} == {i: h or "" for i, _, h in rows if got[i]["record_type"] == "response"}


def test_damage_is_seen(spark):
    path = scratch(spark)
    rows = warc.records(pages(spark, [(1, "u", "x" * 500)])).withColumn("digest", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("0" * 64))
    warc.write_archive(rows, path)
    with pytest.raises(Exception, match="damaged"):
        warc.read_records(spark, path).collect()


def test_odd_rows(spark):
    rows = [(None, None, "n" * 200), (None, "u\r\nx", "n" * 200), (5, "u", "n" * 200), (5, "u", "n" * 200), (6, "u", "n" * 200), (7, "", "")]
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in round_trip(spark, pages(spark, rows))[1].collect()), key=str)
    assert got == sorted([(None, "revisit", 5), (None, "revisit", 5), (5, "response", None), (5, "response", None), (6, "revisit", 5), (7, "response", None)], key=str)
    assert round_trip(spark, pages(spark, []))[1].collect() == []


def test_a_member_per_record(spark, tmp_path):
    """Ordinary WARC files: a gzip member for each record, no segments."""
    bodies = [b"", b"x" * 10, b"y\r\n\r\nWARC/1.1\r\n" * 9000, bytes(range(256)) * 900]
    members = []
    for k, body in enumerate(bodies):
        digest = f"WARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\n" if k % 2 else ""
        head = f"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:uuid:{k}>\r\nWARC-Target-URI: http://h/{k}\r\n{digest}Content-Length: {len(body)}\r\n\r\n"
        members.append(gzip.compress(head.encode() + body + warc.END))
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members))
    got = {r["url"]: r for r in warc.read_records(spark, f"file://{tmp_path}").collect()}
    assert {u: (r["payload_bytes"], r["payload_digest"]) for u, r in got.items()} == {f"http://h/{k}": (len(b), hashlib.sha256(b).hexdigest()) for k, b in enumerate(bodies)}
    whole = {}
    for c in sorted(warc.read_chunks(spark, f"file://{tmp_path}").collect(), key=lambda c: (c["record_id"], c["chunk_no"])):
        assert len(c["chunk"]) <= warc.CHUNK_BYTES
        whole[c["record_id"]] = whole.get(c["record_id"], b"") + bytes(c["chunk"])
    assert [whole[f"<urn:uuid:{k}>"] for k in range(4)] == bodies


@pytest.mark.parametrize("tail", [gzip.compress(b"WARC/1.0\r\n")[:-9], b"not gzip"])
def test_a_broken_end_is_seen(spark, tmp_path, tail):
    whole = gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nContent-Length: 3\r\n\r\nabc" + warc.END)
    (tmp_path / "a.warc.gz").write_bytes(whole + tail)
    with pytest.raises(Exception, match="before its time|incorrect header"):
        warc.read_records(spark, f"file://{tmp_path}").collect()


def test_payloads_are_not_shuffled(spark):
    rows = warc.records(pages(spark, [(k, "u", "x" * 500) for k in range(5)]))
    assert "SortMergeJoin" not in rows._jdf.queryExecution().toString()


def record(k, body, uri=None, more=b""):
    return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <%d>\r\nWARC-Target-URI: %s\r\n%sContent-Length: %d\r\n\r\n" % (k, uri or b"http://h/%d" % k, more, len(body)) + body + warc.END


def test_foreign_headers_padding_and_plain_files(spark, tmp_path):
    """Folded lines, lines without a colon, Latin-1, zeros at the end, and a file that isn't compressed."""
    folded = record(1, b"one", more=b"X-Note: a\r\n  b: c\r\nnothing\r\n")
    latin = record(2, b"two", uri="http://h/é".encode("latin-1"))
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(folded) + b"\x00" * 5000 + gzip.compress(latin) + b"\x00" * 70_000)
    (tmp_path / "b.warc").write_bytes(record(3, b"three") + record(4, b"") + b"\x00" * 100)
    (tmp_path / "c.txt").write_bytes(b"no archive")
    got = {r["url"]: r["payload_bytes"] for r in warc.read_records(spark, f"file://{tmp_path}").collect()}
    assert got == {"http://h/1": 3, "http://h/é": 3, "http://h/3": 5, "http://h/4": 0}


def test_a_large_foreign_record_is_chunked(spark, tmp_path):
    """100 MB in rows of 64 KB, and its digest is that of the whole."""
    body = bytes(range(256)) * (100 * (1 << 20) // 256)
    digest = hashlib.sha256(body).hexdigest()
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record(1, body, more=b"WARC-Payload-Digest: sha256:%s\r\n" % digest.encode()), 1))
    rows = warc.read_chunks(spark, f"file://{tmp_path}").selectExpr("chunk_no", "length(chunk) AS n", "last").collect()
    assert len(rows) == 1600 and max(r["n"] for r in rows) == 1 << 16 and [r["chunk_no"] for r in rows if r["last"]] == [1600]
    (r,) = warc.read_records(spark, f"file://{tmp_path}").collect()
    assert (r["payload_bytes"], r["payload_digest"], r["n_chunks"]) == (len(body), digest, 1600)
