"""Operator 6: round trips, the normaliser and odd pages."""

import gzip
import hashlib
import random

import pytest

from oreline.llm import warc
from oreline.llm.common import fresh_path

BIG = "<p>same page</p>" * 100


def test_pages(spark):
    rows = [
        (1, "https://a.example/", BIG, 5), (2, None, BIG, 5), (9, "https://b.example/\r\nX: y", BIG, 5), (9, "u", BIG, 5),
        (3, "u", "small", 5), (4, "u", "small", 5), (5, "u", None, 5), (6, "u", "", 5), (7, "u", "é漢\r\n\r\nWARC/1.1\r\n" * 200, 5), (None, "u", BIG, 5), (8, "u", "x" * 3_000_000, 5),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, _last int").repartition(3)
    got = sorted(map(tuple, warc.round_trip(pages).collect()), key=str)
    want = []
    for page, _, html, _ in rows:
        raw = (html or "").encode()
        kind = "revisit" if html == BIG and page != 9 else "response"
        want.append((page, len(raw), hashlib.sha1(raw).hexdigest(), kind, 9 if kind == "revisit" else None))
    assert got == sorted(want, key=str)


def test_payloads_come_back(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    back = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read(warc.archive(pages, fresh_path(spark, "warc"))).collect()}
    assert back == {r["page_id"]: r["html"] for r in pages.collect()}


def test_shuffled_roles(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet").selectExpr("page_id", "url", "repeat(cast(page_id % 7 as string), 2000) AS html")
    a = warc.read(warc.archive(pages, fresh_path(spark, "warc"), broadcast_rows=0), with_payload=False)
    b = warc.round_trip(pages)
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    assert b.where("record_type = 'response'").count() == 7


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def records(n, rng):
    out = []
    for i in range(n):
        payload = rng.randbytes(rng.choice([0, 1, 50, 5000])) + b"\r\n\r\n" * (i % 3)
        out.append(warc.record(i, f"http://x/{i}", payload, hashlib.sha1(payload).hexdigest(), len(payload), None, "response"))
    return out


@pytest.mark.parametrize("members", [1, 4])
def test_normaliser(tmp_path, members):
    """A monolithic stream, or one of several members, becomes a member per record, each found by the index."""
    own = records(40, random.Random(members))
    step = len(own) // members
    source, target = tmp_path / "mono.warc.gz", tmp_path / "out.warc.gz"
    source.write_bytes(b"".join(gzip.compress(b"".join(own[i : i + step])) for i in range(0, len(own), step)))
    assert warc.normalise(str(source), str(target)) == len(own)
    assert list(warc.read_indexed(str(target))) == own
    assert gzip.decompress(target.read_bytes()) == b"".join(own)


def test_broken_archives(tmp_path):
    own = records(3, random.Random(5))
    source = tmp_path / "cut.warc.gz"
    source.write_bytes(gzip.compress(b"".join(own)[:-10]))
    with pytest.raises(ValueError, match="ends within a record"):
        warc.normalise(str(source), str(tmp_path / "out"))
    source.write_bytes(gzip.compress(b"".join(own))[:-9])
    with pytest.raises(ValueError, match="ends within a record"):
        warc.normalise(str(source), str(tmp_path / "out"))
    spoilt = own[1].replace(b"sha1:", b"sha1:0", 1)
    with pytest.raises(ValueError, match="header says"):
        warc.parse(spoilt)
