"""Archives: exact round trips, framing, broken segments, revisits."""

import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from tillroll.llm import catalog, warc

SF = "/root/testdata/sf0.01"


def slow(rows):
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        same = [q for q, _, g in rows if (g or "").encode() == b and q is not None]
        lead = max(same, default=None)
        revisit = len(b) >= 1000 and p != lead
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", lead if revisit else None))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_query_on_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()
    assert rows(catalog.op5_warc(spark, SF)) == slow([tuple(p) for p in pages])


def test_chunks_and_segments_round_trip():
    rng = random.Random(1)
    for n in (0, 1, 4095, 4096, 4097, 50_000):
        p = rng.randbytes(n)
        for size in (1, 7, 4096, 1 << 20):
            if n / size < 5000:
                assert warc.unchunked(warc.chunked(p, size)) == p
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    for broken in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\n", b"3\r\nabc", b"-1\r\n\r\n"):
        assert warc.unchunked(broken) is None
    page = warc.page_records("u", "7", "http://x/\r\ny", b"q" * 900, hashlib.sha1(b"q" * 900).hexdigest(), None, "d", 100, 33)
    data = b"".join(r + b"\r\n\r\n" for r in page)
    got = list(warc.parse(data))
    assert got == list(warc.parse(gzip.compress(data))) == list(warc.parse(b"".join(gzip.compress(r + b"\r\n\r\n") for r in page)))
    assert [r["segment"] for r in got] == list(range(1, len(got) + 1)) and got[-1]["total"] == sum(len(r["block"]) for r in got)
    assert got[0]["uri"] == "http://x/%0D%0Ay"
    with pytest.raises(ValueError):
        list(warc.parse(data[:-300]))


def test_edge_cases(spark, tmp_path):
    long = "é😀\r\n\r\nWARC/1.1\r\n" * 20_000
    data = [(1, "u", long), (2, "u", long), (3, None, None), (4, "u", ""), (5, "u\r\nX: y", "s" * 999), (6, "u", "s" * 999), (7, "u", "t" * 1000),
            (9, "u", "t" * 1000), (9, "u", "t" * 1000), (8, "u", "t" * 1000), (None, "u", "t" * 1000), (None, "u", "n" * 2000), (None, "u", "n" * 2000),
            (10, "u", "é" * 500), (11, "u", "é" * 500)]
    df = spark.createDataFrame([(p, u, h, "x") for p, u, h in data], "page_id long, url string, html string, digest string")
    path = str(tmp_path / "a")
    got = warc.archive_round_trip(df, path=path, segment_bytes=1000, file_records=50)
    want = slow(data)
    assert rows(got) == want and all(r.complete for r in got.collect())
    assert len([f for f in os.listdir(path) if f.startswith("part-")]) > 5
    back = warc.read_pages(spark, path).where("record_type = 'response'").select("page_id", F.col("payload").cast("string").alias("p")).collect()
    assert ("é" * 500, long) == tuple(next(r.p for r in back if r.page_id == i) for i in (11, 2))
    assert rows(warc.archive_round_trip(df.limit(0))) == []
    names = spark.createDataFrame([("a\r\nb: c", "u", "z" * 1500), ("+ %", "u", "z" * 1500)], "page_id string, url string, html string")
    assert rows(warc.archive_round_trip(names)) == slow([tuple(r) for r in names.collect()])


def test_missing_or_wrong_segments_are_told(spark):
    p = b"payload " * 100
    sha = hashlib.sha1(p).hexdigest()
    made = []
    for i, name in enumerate(["whole", "gap", "short", "twice", "digest"]):
        recs = [next(warc.parse(r + b"\r\n\r\n")) for r in warc.page_records(name, str(i), "u", p, sha, None, "d", 200, 64)]
        if name == "gap":
            del recs[2]
        if name == "short":
            recs[-1]["block"] = recs[-1]["block"][:-3]
        if name == "twice":
            recs.append(dict(recs[1]))
        if name == "digest":
            recs[0]["digest"] = "00" * 20
        made += recs
    random.Random(2).shuffle(made)
    df = spark.createDataFrame([tuple(r[f.split()[0]] for f in warc.PARSED.split(", ")) for r in made], warc.PARSED)
    got = {r.page: (r.complete, r.payload) for r in warc.reassemble(df).collect()}
    assert got == {"0": (True, bytearray(p)), **{str(i): (False, None) for i in range(1, 5)}}
