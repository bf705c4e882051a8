"""WARC archives: writing pages as records, and reading archives in byte ranges by boundary-chain verification.

A record begins with a version line and says how long its payload is, so each record names its successor's offset. A reader that starts in the middle of
a file can't trust a version line it meets, since payloads may hold one. So tasks only emit candidates: each place where a version
line begins, with the offset its header leads to. Which of them are records is told by pointer jumping from offset 0, on two levels. Inside a range of the
file every candidate's pointer is replaced by its target's until it leaves the range; the offsets where pointers leave are the
only places where a chain can enter another range, and there are few of them, as chains run together. Pointer jumping over these, log2(n) rounds for n of them, tells where the
true chain enters each range. Each range then walks its own part of the chain and reads its records. So no task holds more than a range's candidates, or a file's entries.
Candidates that the chain doesn't reach lie inside payloads and are dropped.

In a compressed archive each record is a gzip member; its candidates are the places of gzip's magic from which a whole member that starts with a version line can be read.

Files are read with pyarrow's file systems, so local, HDFS and S3 paths work alike; they are written through Spark's committed text writer.

Defined results: versions 1.0 and 1.1 are read. Pages are the records of type ``resource``, and those of type ``response``, whose HTTP header is left out; other types are
part of the chain and give no row. A page with a null html is a record with an empty payload and a ``WARC-Truncated: unspecified`` header, and reads back as null; an empty html reads back
empty. A null page_id or url has no header and reads back as null. A url with control characters travels in base64. Repeated pages are repeated records. An
empty table makes an archive without records. A file's tail that is no whole record raises, as it can't be told from damage.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import common

VERSION = re.compile(rb"WARC/1\.[01]\r\n")
VERSION_BYTES = 10
GZIP = b"\x1f\x8b\x08"
SPLIT = 8 << 20
#: Bytes read past a split at first; a header that is longer is read on to its end.
HEADER_MAX = 1 << 16
_PAGE = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])
_HEADER = re.compile(rb"([A-Za-z0-9-]+):[ \t]*([^\r\n]*)\r\n")


def write_pages(spark: SparkSession, pages: DataFrame, path: str) -> None:
    """One uncompressed archive file for each partition: records end with two line ends, which the text writer puts in as its separator."""
    page, url, html = pages["page_id"].cast("long"), pages["url"].cast("string"), pages["html"].cast("string")
    odd = url.rlike(r"[\x00-\x1f\x7f]") | (F.trim(url) != url) | (url == "")
    lines = [
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nContent-Type: text/html\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Record-ID: <urn:page:"), page.cast("string"), F.lit(">\r\n")), F.lit("")),
        F.coalesce(F.when(odd, F.concat(F.lit("X-Target-URI-Base64: "), F.regexp_replace(F.base64(F.encode(url, "UTF-8")), r"\s", ""), F.lit("\r\n"))).otherwise(F.concat(F.lit("WARC-Target-URI: "), url, F.lit("\r\n"))), F.lit("")),
        F.when(html.isNull(), F.lit("WARC-Truncated: unspecified\r\n")).otherwise(F.lit("")),
        F.concat(F.lit("Content-Length: "), F.coalesce(F.octet_length(html), F.lit(0)).cast("string"), F.lit("\r\n\r\n")),
        F.coalesce(html, F.lit("")),
    ]
    pages.select(F.concat(*lines).alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def _open(path: str):
    fs, inner = pafs.FileSystem.from_uri(path) if urlsplit(path).scheme else (pafs.LocalFileSystem(), path)
    return fs.open_input_file(inner)


def header_end(buf: bytes, at: int) -> tuple[int, int] | None:
    """(payload's place, payload's length) of the header at ``at``; None where it is no header or ``buf`` ends in it, and a length past any file's is none."""
    stop = buf.find(b"\r\n\r\n", at)
    if stop < 0 or any(buf[m.start() - 1 : m.start()] == b"\n" for m in VERSION.finditer(buf, at + 1, stop)):  # a header has no second version line
        return None
    for name, value in _HEADER.findall(buf, at + VERSION_BYTES, stop + 2):
        if name.lower() == b"content-length":
            return (stop + 4, int(value)) if value.isdigit() and len(value.lstrip(b"0")) < 19 else None
    return None


def member(f, at: int, buf: bytes = b"") -> tuple[bytes, int] | None:
    """(content, offset after it) of the gzip member at ``at``, if a whole one with records is there; ``buf``: the file's bytes from there on, as far as they were read."""
    inflate, out, done = zlib.decompressobj(31), [], at
    try:
        while not inflate.eof:
            if not buf:
                f.seek(done)
                buf = f.read(1 << 20)
                if not buf:
                    return None
            out.append(inflate.decompress(buf))
            done += len(buf)
            buf = b""
            if len(out) == 1 and len(out[0]) >= VERSION_BYTES and not VERSION.match(out[0]):
                return None
    except zlib.error:
        return None
    content = b"".join(out)
    return (content, done - len(inflate.unused_data)) if VERSION.match(content) else None


def candidates(path: str, lo: int, hi: int) -> tuple[list[int], list[int]]:
    """Offsets in [lo, hi) where a record (or a compressed archive's member) may begin, and where each would end; none that would end past the file."""
    found, after = [], []
    with _open(path) as f:
        size = f.size()
        packed = f.read(3) == GZIP
        f.seek(lo)
        if packed:
            buf = f.read(hi - lo + 2)
            at = buf.find(GZIP)
            while 0 <= at < hi - lo:
                got = member(f, lo + at, buf[at:])
                if got:
                    found.append(lo + at)
                    after.append(got[1])
                at = buf.find(GZIP, at + 1)
            return found, after
        buf = f.read(hi - lo + HEADER_MAX + VERSION_BYTES)
        starts = [m.start() for m in VERSION.finditer(buf, 0, hi - lo + VERSION_BYTES - 1)]
        while starts and buf.find(b"\r\n\r\n", starts[-1]) < 0 and (more := f.read(len(buf))):  # the last header may be of any length
            buf += more
    for at in starts:
        end = header_end(buf, at)
        if end and lo + end[0] + end[1] + 4 <= size:
            found.append(lo + at)
            after.append(lo + end[0] + end[1] + 4)
    return found, after


def exits(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Where the chain from each candidate (rising) leaves the candidates, by pointer jumping."""
    n = len(at)
    to = np.searchsorted(at, after)
    jump = np.where((to < n) & (at[np.minimum(to, n - 1)] == after), to, np.arange(n)) if n else to
    for _ in range(n.bit_length()):
        jump = jump[jump]
    return after[jump]


def walked(at: np.ndarray, after: np.ndarray, entry: int) -> np.ndarray:
    """Places of the candidates (rising) on the chain that enters at ``entry``."""
    out, k = [], int(np.searchsorted(at, entry))
    while k < len(at) and at[k] == entry:
        out.append(k)
        entry = after[k]
        k = int(np.searchsorted(at, entry))
    return np.array(out, np.int64)


def reachable(offset: np.ndarray, after: np.ndarray, size: int) -> np.ndarray:
    """Which candidates the chain from offset 0 reaches, by pointer jumping; raises where the chain leaves the candidates before the file's end."""
    order = np.argsort(offset)
    offset, after = offset[order], after[order]
    n = len(offset)
    if size and (not n or offset[0] != 0):
        raise ValueError("no record at the start of the archive")
    to = np.searchsorted(offset, after)
    good = (to < n) & (offset[np.minimum(to, n - 1)] == after)
    jump = np.append(np.where(good, to, n), n)
    reached = np.zeros(n + 1, bool)
    reached[0] = n > 0
    for _ in range(max(1, n.bit_length())):
        reached[jump[reached]] = True
        jump = jump[jump]
    reached = reached[:n]
    if n and after[np.flatnonzero(reached)[-1]] != size:
        raise ValueError("the chain of records breaks before the end of the archive")
    out = np.zeros(n, bool)
    out[order] = reached
    return out


def _page(buf: bytes, at: int) -> tuple[tuple[int | None, str | None, str | None] | None, int]:
    """(page of the record at ``at``, None where it isn't one; offset of the next record)."""
    place, length = header_end(buf, at)
    fields = {k.lower(): v for k, v in _HEADER.findall(buf, at + VERSION_BYTES, place - 2)}
    after, kind = place + length + 4, fields.get(b"warc-type", b"resource").strip().lower()
    if kind not in (b"resource", b"response"):
        return None, after
    page = re.fullmatch(rb"<urn:page:(-?\d+)>", fields.get(b"warc-record-id", b""))
    url = fields[b"warc-target-uri"].decode("utf-8", "replace") if b"warc-target-uri" in fields else None
    if b"x-target-uri-base64" in fields:
        url = base64.b64decode(fields[b"x-target-uri-base64"]).decode()
    body = buf[place : place + length]
    if kind == b"response":
        body = body[cut + 4 :] if (cut := body.find(b"\r\n\r\n")) >= 0 else b""
    html = None if not body and fields.get(b"warc-truncated") == b"unspecified" else body.decode("utf-8", "replace")
    return (int(page[1]) if page else None, url, html), after


def _pages_between(path: str, begin: int, end: int, packed: bool, starts: np.ndarray) -> list[tuple]:
    with _open(path) as f:
        f.seek(begin)
        buf = f.read(end - begin)
        found = []
        for at in starts.tolist():
            whole, here = (member(f, at, buf[at - begin :])[0], 0) if packed else (buf, at - begin)
            page, here = _page(whole, here)
            found.append(page)
            while packed and VERSION.match(whole, here):  # a member with several records
                page, here = _page(whole, here)
                found.append(page)
    return [p for p in found if p]


def read_pages(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(page_id, url, html) of every page of the archives under ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(path).select("path", "length").where("length > 0")
    parts = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("lo"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found_in = "path string, length long, part long, at array<long>, after array<long>, exits array<long>"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, length, lo in zip(*(c.to_pylist() for c in b.columns)):
                at, after = (np.array(x, np.int64) for x in candidates(path, lo, min(lo + split, length)))
                lists = [pa.array([x], pa.list_(pa.int64())) for x in (at, after, np.unique(exits(at, after)))]
                yield pa.record_batch([pa.array([path]), pa.array([length], pa.int64()), pa.array([lo // split], pa.int64()), *lists], names=["path", "length", "part", "at", "after", "exits"])

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left = []
            for entry, at, after in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("entry", "at", "after"))):
                at, after = np.array(at or [], np.int64), np.array(after or [], np.int64)
                k = int(np.searchsorted(at, entry))
                left.append(int(exits(at, after)[k]) if k < len(at) and at[k] == entry else -1)
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(left, pa.int64())], names=["path", "length", "entry", "leaves"])

    def chain(t: pa.Table) -> pa.Table:
        keep = reachable(t["entry"].to_numpy(), t["leaves"].to_numpy(), t["length"][0].as_py())
        return t.filter(pa.array(keep)).select(["path", "entry"])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, entry, at, after in zip(*(c.to_pylist() for c in b.columns)):
                at, after = np.array(at, np.int64), np.array(after, np.int64)
                true = walked(at, after, entry)
                with _open(path) as f:
                    packed = f.read(3) == GZIP
                for k in range(0, len(true), 1000):
                    own = true[k : k + 1000]
                    rows = _pages_between(path, int(at[own[0]]), int(after[own[-1]]), packed, at[own])
                    yield pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_PAGE)], schema=_PAGE)

    found = common.written(spark, parts.repartition(width, "path", "lo").mapInArrow(find, found_in), "candidates")
    asked = found.select("path", "length", F.explode("exits").alias("entry")).where("entry < length").unionByName(files.select("path", "length", F.lit(0).cast("long").alias("entry"))).distinct()
    asked = asked.withColumn("part", F.expr(f"entry div {split}"))
    held = asked.join(found.select("path", "part", "at", "after"), ["path", "part"], "left").select("path", "length", "entry", "at", "after")
    entries = held.mapInArrow(entered, "path string, length long, entry long, leaves long")
    true = entries.groupBy("path").applyInArrow(chain, "path string, entry long").withColumn("part", F.expr(f"entry div {split}"))
    # the offsets are small whatever the payloads, so the width is given and not left to the shuffle's size
    ranges = true.join(found.select("path", "part", "at", "after"), ["path", "part"]).repartition(width, "path", "part")
    return ranges.select("path", "entry", "at", "after").mapInArrow(take, "page_id long, url string, html string")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages written to archives in the shared folder and read back from them."""
    path = f"{common.own_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_pages(spark, pages, path)
    return read_pages(spark, path)
