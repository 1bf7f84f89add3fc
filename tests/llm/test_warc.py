import gzip
import hashlib
import random

from pyspark.sql import functions as F

from trialframe.llm import warc as W
from trialframe.llm.common import scratch


def test_arc_versions_and_lengths():
    for version in "12":
        bodies = [b"", b"plain\n\nbody", "é\x00\r\n\r\nWARC/1.0\r\n".encode(), b"x" * 1000]
        data = W.arc_start("20200102030405", version) + b"\n"
        for k, b in enumerate(bodies):
            data += W.arc_record(f"http://h/{k} with space", b, "20200102030405", version) + b"\n"
        got = list(W.parse_arc(data))
        assert [x[2] for x in got] == bodies and not any(x[3] for x in got)
        assert [x[1][0] for x in got] == [f"http://h/{k}%20with%20space" for k in range(4)]
    cut = list(W.parse_arc(data[:-500]))
    assert cut[-1][3] and len(cut) == 4
    noisy = b"garbage line\n" + data
    assert [x[2] for x in W.parse_arc(noisy)] == bodies


def test_dates_and_ids():
    assert W._iso("20200102030405") == "2020-01-02T03:04:05Z" and W._iso("20200102") == "2020-01-02T00:00:00Z"
    assert W._record_id("f", 1) == W._record_id("f", 1) != W._record_id("f", 2)


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def round_trip(spark, df, version="1"):
    arc, out = scratch(spark), scratch(spark)
    W.write_arc(df, arc, "page_id", "url", "html", version=version)
    W.write_warc(W.mark_revisits(W.arc_to_warc(W.read_arc(spark, arc))), out)
    return W.read_warc(spark, out)


def test_round_trip_with_revisits(spark):
    big, tricky = "é" * 60, "a\r\n\r\nWARC/1.0\r\nContent-Length: 5\r\n\r\nxx\n" * 5
    rows = [(7, "http://a/1", big), (3, "http://a/ 2", big), (9, None, big), (1, "u", "s" * 99), (2, "u", "s" * 99), (4, "", None), (5, "é", ""), (6, "x", tricky), (8, "y", tricky), (None, "z", big)]
    for version in "12":
        got = {r.item_id: r for r in round_trip(spark, pages(spark, rows), version).collect()}
        assert set(got) == {r[0] for r in rows}
        for i, _, h in rows:
            raw = (h or "").encode()
            r = got[i]
            assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
            assert r.payload is None if r.warc_type == "revisit" else bytes(r.payload) == raw
        kinds = {i: (r.warc_type, r.refers_to_item) for i, r in got.items()}
        assert kinds == {7: ("revisit", 3), 3: ("response", None), 9: ("revisit", 3), None: ("revisit", 3), 1: ("response", None), 2: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None), 8: ("revisit", 6)}
        assert {r.refers_to_id for r in got.values()} == {None, got[3].record_id, got[6].record_id}


def test_repeated_rows_and_empty(spark):
    got = round_trip(spark, pages(spark, [(1, "u", "q" * 200)] * 3)).groupBy("warc_type").count().collect()
    assert {r.warc_type: r["count"] for r in got} == {"response": 1, "revisit": 2}
    assert round_trip(spark, pages(spark, []).where(F.lit(True))).count() == 0


def test_more_records_than_a_file_holds(spark, monkeypatch):
    monkeypatch.setattr(W, "FILE_RECORDS", 7)
    got = round_trip(spark, pages(spark, [(i, f"u{i}", f"body {i}" * 30) for i in range(40)]).coalesce(1))
    assert got.count() == 40 and got.select("record_id").distinct().count() == 40


def test_files_are_bounded_by_bytes_and_long_payloads_are_whole(spark, monkeypatch):
    monkeypatch.setattr(W, "FILE_BYTES", 10_000)
    rng = random.Random(3)
    bodies = [str(rng.random()) * 100 for _ in range(60)] + ["long \r\n" * 600_000]
    df = spark.createDataFrame([(i, f"u{i}", b, "x", 5) for i, b in enumerate(bodies)], "page_id long, url string, html string, file string, payload int").coalesce(1)
    arc = scratch(spark)
    W.write_arc(df, arc, "page_id", "url", "html")
    assert spark.read.format("binaryFile").load(arc).count() > 5
    got = {r.item_id: bytes(r.payload).decode() for r in round_trip(spark, df).collect()}
    assert got == dict(enumerate(bodies))


def test_gzip_members_are_streamed_as_far_as_they_go():
    one, two = W.arc_record("u", b"a" * 5000, "20200102") + b"\n", W.arc_record("v", bytes(range(256)) * 4, "20200102") + b"\n"
    packed = gzip.compress(one) + gzip.compress(two)
    whole = list(W.parse_arc(W._opened(packed)))
    assert [(r[0], r[1][0], len(r[2]), r[3]) for r in whole] == [(0, "u", 5000, False), (len(one), "v", 1024, False)]
    cut = list(W.parse_arc(W._opened(packed[:-200])))
    assert len(cut) == 2 and cut[1][3] and not cut[0][3]
