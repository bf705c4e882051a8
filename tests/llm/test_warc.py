import gzip

import numpy as np
import pytest
from strandline.llm import warc

FAKE = "WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
PAGES = [
    (1, "http://a.example/", "<p>one</p>"), (2, None, "x"), (3, "http://b.example/", None), (4, "http://c.example/", ""), (None, "http://d.example/", "<b>é 你 😀</b>"),
    (5, "http://e.example/", FAKE), (6, "http://f.example/", "before " + FAKE * 3 + "WARC/1.0\r\n"), (7, "http://g.example/?x=\r\nEvil: 1", "\r\n\r\n"), (8, "", "long " * 30_000),
    (1, "http://a.example/", "<p>one</p>"), (9, " spaced ", "WARC/1.0\r\nContent-Length: 99999999\r\n\r\n"), (10, None, None), (-3, "u", "y"),
]


def rows(df):
    return sorted(((r["page_id"], r["url"], r["html"]) for r in df.collect()), key=str)


@pytest.fixture
def pages(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("path", F.lit("clash")).withColumn("at", F.lit(1))


@pytest.mark.parametrize("split", [warc.SPLIT, 300, 1000])
def test_round_trip_with_magic_inside_payloads(spark, pages, tmp_path, split):
    path = "file://" + str(tmp_path / "archive")
    warc.write_pages(spark, pages.coalesce(2), path)
    assert rows(warc.read_pages(spark, path, split)) == sorted(PAGES, key=str)


def test_query(spark, pages):
    assert rows(warc.round_trip(spark, pages)) == sorted(PAGES, key=str)
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def brute(offset, after):
    nxt, at, out = dict(zip(offset, after)), 0, set()
    while at in nxt:
        out.add(at)
        at = nxt[at]
    return out


def test_pointer_jumping_against_walking():
    rng = np.random.default_rng(6)
    for _ in range(200):
        cuts = np.sort(rng.choice(np.arange(1, 500), rng.integers(1, 30), replace=False))
        true = np.concatenate([[0], cuts])
        after = np.append(cuts, 500)
        fake = np.setdiff1d(rng.integers(1, 500, 20), true)
        offset = np.concatenate([true, fake])
        to = np.concatenate([after, fake + rng.integers(1, 200, len(fake))])
        order = rng.permutation(len(offset))
        got = warc.reachable(offset[order], to[order], 500)
        assert set(offset[order][got]) == brute(offset.tolist(), to.tolist()) == set(true)


def test_damage_is_told():
    with pytest.raises(ValueError):
        warc.reachable(np.array([0, 10]), np.array([10, 20]), 30)
    with pytest.raises(ValueError):
        warc.reachable(np.array([5]), np.array([30]), 30)


def record(kind, url, body, version="1.1", more=""):
    head = f"WARC/{version}\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\n{more}Content-Length: {len(body)}\r\n\r\n"
    return head.encode() + body + b"\r\n\r\n"


ARCHIVE = [
    record("warcinfo", "", b"software: x\r\n"), record("request", "http://a.example/", b"GET / HTTP/1.1\r\n\r\n"),
    record("response", "http://a.example/", b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>one</p>\r\n\r\n" + FAKE.encode()),
    record("resource", "http://b.example/", b"\x1f\x8b\x08 is no member", "1.0"), record("metadata", "http://b.example/", FAKE.encode()),
    record("response", "http://c.example/", b"HTTP/1.1 204 No Content\r\n\r\n"), record("resource", "http://d.example/", b"cut short", more="WARC-Truncated: length\r\n"),
]
WANT = [(None, "http://a.example/", "<p>one</p>\r\n\r\n" + FAKE), (None, "http://b.example/", "\x1f\ufffd\x08 is no member"), (None, "http://c.example/", ""), (None, "http://d.example/", "cut short")]


@pytest.mark.parametrize("split", [warc.SPLIT, 200])
@pytest.mark.parametrize("form", ["plain", "members", "one member"])
def test_archives_of_other_writers(spark, tmp_path, split, form):
    whole = {"plain": b"".join, "members": lambda r: b"".join(map(gzip.compress, r)), "one member": lambda r: gzip.compress(b"".join(r))}[form](ARCHIVE * 3)
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc").write_bytes(whole)
    (tmp_path / "a" / "y.warc").write_bytes(b"".join(ARCHIVE[:2]))
    assert rows(warc.read_pages(spark, "file://" + str(tmp_path / "a"), split)) == sorted(WANT * 3, key=str)


def test_a_cut_archive_raises(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc").write_bytes(b"".join(ARCHIVE)[:-7])
    with pytest.raises(Exception, match="breaks before the end"):
        warc.read_pages(spark, "file://" + str(tmp_path / "a"), 200).count()


def test_chains_inside_a_range():
    at, after = np.array([0, 5, 9, 20, 30]), np.array([9, 30, 20, 70, 50])
    assert warc.exits(at, after).tolist() == [70, 50, 70, 70, 50]
    assert warc.walked(at, after, 0).tolist() == [0, 2, 3] and warc.walked(at, after, 6).tolist() == []
    assert warc.exits(at[:0], after[:0]).tolist() == []
