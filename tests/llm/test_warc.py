import base64
import gzip
import hashlib
import json
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.llm import warc as W

PAGES = "page_id long, url string, html string"


@given(st.lists(st.binary(max_size=200), min_size=1, max_size=6), st.integers(1, 300))
@settings(max_examples=50, deadline=None)
def test_records_from_any_pieces(payloads, size):
    stream = b"".join(b"WARC/1.1\r\nX: 1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(p), p) for p in payloads)
    pieces = [stream[i : i + size] for i in range(0, len(stream), size)]
    got = list(W.Reader(iter(pieces)))
    assert [r.partition(b"\r\n\r\n")[2][:-4] for _, r in got] == payloads and b"".join(r for _, r in got) == stream


@given(st.binary(max_size=5000), st.integers(1, 3))
@settings(max_examples=30, deadline=None)
def test_inflate_members(data, n):
    assert b"".join(W.inflated(gzip.compress(data) * n)) == data * n


def test_digest(spark):
    for text in ("", "a", "é" * 1000):
        got = spark.range(1).select(W.base32_of(F.sha1(F.lit(text).cast("binary")))).first()[0]
        assert got == base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_round_trip(spark, tmp_path):
    long = "x\r\n\r\nWARC/1.1\r\n" * 50_000
    rows = [(3, "http://a b\r\nX: y", "same"), (1, None, "same"), (2, "u", "other é"), (4, "u", None), (5, "u", ""), (6, "u", long), (7, "u", long), (None, "u", "none"), (8, "u", "twice"), (8, "u", "twice")]
    pages = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("clash")).withColumn("size", F.lit(1)).repartition(3)
    catalog = W.archive(pages, f"file://{tmp_path}/w")
    got = W.read(catalog).collect()
    assert len(got) == len(rows)
    by = {r.id: r for r in got}
    kinds = {i: (r.record_type, r.refers_to) for i, r in by.items()}
    assert kinds == {3: ("revisit", 1), 1: ("response", None), 2: ("response", None), 4: ("response", None), 5: ("revisit", 4), 6: ("response", None), 7: ("revisit", 6), None: ("response", None), 8: ("response", None)}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert by[i].payload_bytes == len(raw) and by[i].payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    # every record is a member of its own, where the index says, and together they are the stream
    for c in catalog.collect():
        data = open(W.file_system(c.archive)[1], "rb").read()
        at = 0
        for line in open(W.file_system(c["index"])[1]):
            x = json.loads(line)
            assert x["offset"] == at
            z = zlib.decompressobj(31)
            assert z.decompress(data[at : at + x["length"]]).startswith(b"WARC/1.1\r\n") and z.eof and not z.unused_data
            at += x["length"]
        assert at == len(data)


def test_empty_table(spark, tmp_path):
    assert W.read(W.archive(spark.createDataFrame([], PAGES), f"{tmp_path}/w")).count() == 0


def test_smaller_payloads_are_not_compared(spark):
    rows = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], PAGES)
    every = W.digested(rows)
    assert {r.id: r.of for r in W.records(every, W.repeated(every, least=3)).collect()} == {1: None, 2: None, 3: None, 4: 3}


def test_streams_are_bounded_and_read_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "STREAMS", {100: 8, 1000: 2})
    rows = [(i, "u", "x" * n + str(i)) for i, n in enumerate([10] * 20 + [500] * 5 + [5000] * 3)]
    catalog = W.archive(spark.createDataFrame(rows, PAGES).coalesce(1), f"{tmp_path}/w")
    assert sorted(r.records for r in catalog.collect()) == [1] * 3 + [1, 2, 2] + [4, 8, 8]
    assert {(r.id, r.payload_bytes) for r in W.read(catalog).collect()} == {(i, len(h)) for i, _, h in rows}


def test_streams_are_normalised_record_by_record(spark, tmp_path):
    """Memory stays far below what the records take together."""
    import tracemalloc

    stream = b"".join(b"WARC/1.1\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Type: response\r\nContent-Length: 1000000\r\n\r\n%s\r\n\r\n" % (i, b"z" * 1_000_000) for i in range(40))
    packed = gzip.compress(stream)
    del stream
    tracemalloc.start()
    W.put(f"{tmp_path}/x.gz", (W.member(r) for _, r in W.Reader(W.inflated(memoryview(packed)))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12_000_000


def test_names_of_file_systems():
    assert W.file_system("file:///a/b")[1] == W.file_system("/a/b")[1] == "/a/b"
    try:
        fs, at = W.file_system("s3a://bucket/folder/x")
        assert at == "bucket/folder/x" and fs.type_name == "s3"
    except (OSError, NotImplementedError) as e:  # Arrow without S3, or no network to ask for the bucket's region
        assert "Unrecognized" not in str(e)
