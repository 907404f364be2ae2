import gzip
import hashlib
import io

import pytest

from driftline.llm import warc

KIND = "page_id long, url string, html string, record_type string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash") for i, u, h in rows], KIND)


BIG, SMALL = "é" * 700, "tiny"
ROWS = [
    (1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, None, BIG), (4, "http://a/4", SMALL), (5, "http://a/5", SMALL), (6, "u", None), (7, "u", ""), (8, "u", "x" * 999), (9, "u", "x" * 999),
    (10, "u", "y" * 1000), (11, "u", "y" * 1000), (12, "u\r\nInjected: 1", "WARC/1.1\r\n\r\n" * 300), (None, "u", BIG), (13, "u", "z" * 300_000), (13, "u", "z" * 300_000),
]


def want(rows):
    top = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            top[b] = max(top.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        again = b in top and i != top[b]
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top[b] if again else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    got = [tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in warc.round_trip(spark, pages(spark, ROWS)).collect()]
    assert sorted(got, key=repr) == want(ROWS)


def test_empty_table(spark):
    assert warc.round_trip(spark, pages(spark, [])).collect() == []


def test_chunks(spark, tmp_path):
    archives = warc.write(warc.plan(pages(spark, ROWS)), f"file://{tmp_path}/w")
    chunks = warc.read_chunks(archives)
    for r in chunks.where("page_id = 13 and record_type = 'response'").groupBy("record_id").count().collect():
        assert r["count"] == 2 * -(-300_000 // warc.CHUNK)
    own = chunks.where("page_id = 3").orderBy("chunk_no").collect()
    assert b"".join(r["data"] or b"" for r in own) == BIG.encode() and own[-1]["is_last"] and own[-1]["sha1_so_far"] == hashlib.sha1(BIG.encode()).hexdigest()
    assert max(r["n"] for r in chunks.selectExpr("octet_length(data) n").collect()) <= warc.CHUNK
    files = [p for p in (tmp_path / "w").iterdir()]
    assert sum(gzip.decompress(p.read_bytes()).count(b"WARC-Type: ") for p in files) == len(ROWS)
    assert not any(b"\nInjected: 1" in gzip.decompress(p.read_bytes()) for p in files)


def record(body=b"hello", length=None, tail=b"\r\n\r\n"):
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: %d\r\n\r\n" % (len(body) if length is None else length) + body + tail


def read(raw):
    return [b"".join(chunks) for _, chunks in warc.stream(io.BytesIO(raw))]


def test_streams_plain_and_zipped_and_refuses_broken_ones():
    assert read(record() + record(b"")) == [b"hello", b""]
    assert read(gzip.compress(record()) + gzip.compress(record(b"x" * 200_000))) == [b"hello", b"x" * 200_000]
    assert read(b"") == []
    for bad in (record(length=50), record(tail=b""), record(length=3), b"HTTP/1.1 200\r\n\r\n", record()[:20], gzip.compress(record())[:-12]):
        with pytest.raises(ValueError):
            read(bad)


def test_the_round_trip_carries_the_payloads(spark, monkeypatch):
    made = {}
    monkeypatch.setattr(warc, "cut", lambda df, name, cut=warc.cut: made.setdefault(name, cut(df, name)))
    texts = ["a" * 200_000, "short", "", None]
    pages = spark.createDataFrame([(k, f"http://x/{k}", t) for k, t in enumerate(texts)], "page_id long, url string, html string")
    assert warc.round_trip(spark, pages).count() == len(texts)
    got = {}
    for r in made["warc-chunks"].orderBy("page_id", "chunk_no").collect():
        got[r["page_id"]] = got.get(r["page_id"], b"") + bytes(r["data"])
    assert got == {k: (t or "").encode() for k, t in enumerate(texts)}


def test_archives_are_read_in_as_many_tasks(spark, tmp_path):
    rows = [(k, f"http://a/{k}", f"page {k} " * 200) for k in range(60)]
    archives = warc.write(warc.plan(pages(spark, rows)).repartition(12), f"file://{tmp_path}/w")
    n = archives.count()
    chunks = warc.read_chunks(archives)
    from pyspark.sql import functions as F

    assert n == 12 and chunks.rdd.getNumPartitions() == n
    assert chunks.select(F.spark_partition_id().alias("p")).distinct().count() > n // 2
    assert chunks.select("page_id").distinct().count() == 60
