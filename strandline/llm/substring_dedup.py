"""Repeated passages: exact counts of all windows of ``K`` words by super-k-mer partitioning.

A window's minimiser is its ``M``-word gram with the smallest hash. Consecutive windows that share a minimiser (the same occurrence of it) make a
super-k-mer; its words travel once, packed as a string, to the minimiser's bucket, instead of K words for each window. Equal windows have equal
minimisers, so all occurrences of a window meet in one bucket, where the windows are sorted by hash, those of one hash are compared word by word and byte
by byte, and counted exactly. Packed strings are compressed by bucket before the exchange.

The result has one row for each maximal run of consecutive windows that occur twice or more, anywhere: the passage's place, its windows, how
many of them occur here for the first time (by doc_id, then place) and the largest number of occurrences. Windows that aren't first
occurrences can be taken out without losing any text altogether.

Defined results: words are runs of letters and digits, lower-cased. A null or empty text, or one with under K words, has no windows. A passage that
repeats inside one text counts too. Rows sharing a doc_id are one document (see ``one_row_per_id``); rows with a null doc_id take no part.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm import common, kernel
from strandline.llm.kernel import U

K, M = 50, 4
#: Words or windows compared at a time: all of them are, whatever their number.
PART = 1 << 16
#: Stored bytes of the input, in MB, for each bucket; a bucket's windows are in memory together.
MB_EACH = 4.0
_PACKED = "bucket int, ids binary, starts binary, words binary, text binary"
_PACKED_ARROW = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("ids", "starts", "words", "text"))])
_RUN_ARROW = pa.schema([("doc_id", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("firsts", pa.int32()), ("most", pa.int64())])


def _give_back() -> None:
    """Freed memory goes back to the system, as Spark uses a worker again and again; without glibc nothing is done."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def super_kmers(words: kernel.Words, k: int = K, m: int = M) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser hash, first word, windows, text) of each super-k-mer."""
    at, doc = kernel.inside(words.first, k)
    if not len(at):
        return np.zeros(0, U), at, at, doc
    gram = kernel.windows(words.h, m, 9)
    bits = int(len(gram)).bit_length()
    low = U((1 << bits) - 1)
    place = kernel.sliding_min((gram & ~low) | np.arange(len(gram), dtype=U), k - m + 1)[at] & low
    head = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
    return gram[place[head].astype(np.int64)], at[head], np.diff(np.append(head, len(at))), doc[head]


def _spread(bits: int, k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for whole in batches:
            _give_back()
            for batch in kernel.slices(whole):
                words = kernel.Words(batch.column(1))
                gram, first, count, doc = super_kmers(words, k, m)
                if not len(gram):
                    continue
                size = words.end - words.start + 1
                ends = np.concatenate([[0], np.cumsum(size)])
                packed = np.full(ends[-1], 32, np.uint8)
                packed[kernel.spans(ends[:-1], size - 1)] = words.data[kernel.spans(words.start, size - 1)]
                bucket = (kernel.mix(gram, 3) & U((1 << bits) - 1)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                bucket, first, count, doc = bucket[order], first[order], count[order], doc[order]
                ids = batch.column(0).to_numpy(zero_copy_only=False)[doc]
                start, length = (first - words.first[doc]).astype("<u4"), (count + k - 1).astype("<u4")
                edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                rows = []
                for a, b in zip(edge, np.append(edge[1:], len(bucket))):
                    lo = ends[first[a:b]]
                    text = packed[kernel.spans(lo, ends[first[a:b] + length[a:b]] - lo)]
                    rows.append({"bucket": int(bucket[a]), "ids": ids[a:b].astype("<i8").tobytes(), "starts": start[a:b].tobytes(), "words": length[a:b].tobytes(), "text": squeeze.compress(text.tobytes())})
                yield pa.RecordBatch.from_pylist(rows, _PACKED_ARROW)

    return run


def unequal_words(data: np.ndarray, stop: np.ndarray, h: np.ndarray, held: np.ndarray) -> bool:
    """Whether words (those ``held``; each ends at ``stop``) of one hash differ in their bytes. ``PART`` words at a time are compared with the first word of
    their hash, so that what is in memory besides is one entry a distinct word."""
    seen, seen_start, seen_stop = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for lo in range(0, len(h), PART):
        some = lo + np.flatnonzero(held[lo : lo + PART])
        if not len(some):
            continue
        e = stop[some].astype(np.int64)
        b = np.where(some > 0, stop[some - 1].astype(np.int64) + 1, 0)
        own, first, back = np.unique(h[some], return_index=True, return_inverse=True)
        start, end = b[first], e[first]
        if len(seen):
            at = np.minimum(np.searchsorted(seen, own), len(seen) - 1)
            old = seen[at] == own
            start[old], end[old] = seen_start[at[old]], seen_stop[at[old]]
        else:
            old = np.zeros(len(own), bool)
        size = e - b
        like, limit = start[back], end[back]
        if (limit - like != size).any() or (data[kernel.spans(b, size)] != data[kernel.spans(like, size)]).any():
            return True
        into = np.searchsorted(seen, own[~old])
        seen, seen_start, seen_stop = (np.insert(x, into, y[~old]) for x, y in ((seen, own), (seen_start, start), (seen_stop, end)))
    return False


def unequal_windows(h: np.ndarray, at: np.ndarray, like: np.ndarray, k: int) -> np.ndarray:
    """Windows (by first word, rising) that differ in some word from the window at ``like``: where both are one word further than those before, only their last words are new."""
    on = np.concatenate([[False], (at[1:] == at[:-1] + 1) & (like[1:] == like[:-1] + 1)])
    apart = h[at + k - 1] != h[like + k - 1]
    whole = np.flatnonzero(~on)
    for lo in range(0, len(whole), 100_000):
        w = whole[lo : lo + 100_000]
        step = np.arange(k)
        apart[w] = (h[at[w][:, None] + step] != h[like[w][:, None] + step]).any(1)
    return apart


def grouped(one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order that puts equal values next to each other, size of each run)."""
    order = np.argsort(one, kind="stable")
    one = one[order]
    head = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]]))
    return order, np.diff(np.append(head, len(order)))


def _count(k: int):
    """In one bucket: runs of windows that occur more than once, within each super-k-mer. Windows are sorted by hash; those of one hash are then compared, words by their bytes and windows word by word."""

    def run(t: pa.Table) -> pa.Table:
        _give_back()
        expand = zstandard.ZstdDecompressor()
        parts: list[list[np.ndarray]] = [[] for _ in range(6)]
        blobs, words = [], 0
        for own, begin, count, text in zip(*(t[c].to_pylist() for c in ("ids", "starts", "words", "text"))):  # a map task's share at a time
            data = np.frombuffer(expand.decompress(text), np.uint8)
            stop = np.flatnonzero(data == 32)
            h = kernel.word_hashes(data, np.concatenate([[0], stop[:-1] + 1]), stop)
            bounds = np.concatenate([[0], np.cumsum(np.frombuffer(count, "<u4").astype(np.int64))])
            at, kmer = kernel.inside(bounds, k)
            place = (np.frombuffer(begin, "<u4").astype(np.int64)[kmer] + at - bounds[kmer]).astype(np.int32)
            for part, column in zip(parts, (np.frombuffer(own, "<i8"), kmer.astype(np.int32), kernel.windows(h, k, 31)[at], at + words, place, h)):
                part.append(column)
            blobs.append(data)
            words += len(h)
        lead = np.cumsum([0, *map(len, parts[0])])
        parts[1] = [kmer + np.int32(n) for kmer, n in zip(parts[1], lead)]
        whole = []
        while parts:  # a column at a time, so that only one is there twice
            whole.append(np.concatenate(parts.pop(0)))
        ids, owner, one, at, place, h = whole
        data = np.concatenate(blobs)
        del whole, blobs
        order, size = grouped(one)
        again = np.repeat(size > 1, size)
        if again.any():
            twice = order[again]
            by = np.argsort(twice)
            twice, like = twice[by], np.repeat(order[(np.cumsum(size) - size)[size > 1]], size[size > 1])[by]
            del by
            held = np.zeros(words + 1, np.int32)
            held[at[twice]] = 1
            held[at[twice] + k] -= 1
            held = np.cumsum(held, out=held)[:-1] > 0
            stop = np.flatnonzero(data == 32).astype(np.int32 if len(data) < 1 << 31 else np.int64)
            strange = unequal_words(data, stop, h, held)
            del held
            if strange or any(unequal_windows(h, at[twice[lo : lo + PART]], at[like[lo : lo + PART]], k).any() for lo in range(0, len(twice), PART)):  # a hash has let us down: by the bytes themselves
                start = np.concatenate([[0], stop[:-1] + 1])
                texts: dict[tuple[int, bytes], int] = {}
                for i in twice:
                    one[i] = texts.setdefault((int(one[i]), data[start[at[i]] : stop[at[i] + k - 1]].tobytes()), len(texts))
                alone = np.ones(len(one), bool)
                alone[twice] = False
                one[alone] = np.arange(len(texts), len(texts) + int(alone.sum()))
                order, size = grouped(one)
                again = np.repeat(size > 1, size)
        one = at = h = data = like = twice = stop = None
        times = np.empty(len(order), np.int64)
        times[order] = np.repeat(size, size)
        first = np.zeros(len(order), bool)
        member = order[again]
        if len(member):
            group = np.repeat(np.arange(len(size)), size)[again]
            by = np.lexsort((place[member], ids[owner[member]], group))
            lead = np.concatenate([[True], group[by][1:] != group[by][:-1]])
            first[member[by[lead]]] = True
        some = np.flatnonzero(times > 1)
        if not len(some):
            return _RUN_ARROW.empty_table()
        begin = np.concatenate([[True], (some[1:] != some[:-1] + 1) | (owner[some[1:]] != owner[some[:-1]])])
        head = np.flatnonzero(begin)
        last = np.append(head[1:], len(some)) - 1
        return pa.table([ids[owner[some[head]]], place[some[head]].astype(np.int32), place[some[last]].astype(np.int32), np.add.reduceat(first[some].astype(np.int32), head), np.maximum.reduceat(times[some], head)], schema=_RUN_ARROW)

    return run


def repeated_passages(spark: SparkSession, docs: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """(doc_id, start_word, n_words, windows, first_windows, max_copies) of each maximal run of windows that occur more than once; words count from 0."""
    bits = max(3, (common.bucket_count(spark, docs, MB_EACH) - 1).bit_length())
    packed = common.one_row_per_id(spark, docs).where("text is not null").mapInArrow(_spread(bits, k, m), _PACKED)
    runs = packed.groupBy("bucket").applyInArrow(_count(k), "doc_id long, a int, b int, firsts int, most long")
    # runs of neighbouring super-k-mers are joined where one's last window comes right before the other's first
    along = Window.partitionBy("doc_id").orderBy("a")
    parted = runs.withColumn("new", (F.col("a") > F.lag("b", 1, -2).over(along) + 1).cast("int")).withColumn("run", F.sum("new").over(along))
    return parted.groupBy("doc_id", "run").agg(
        F.min("a").alias("start_word"), (F.max("b") - F.min("a") + k).cast("int").alias("n_words"), (F.max("b") - F.min("a") + 1).cast("int").alias("windows"),
        F.sum("firsts").cast("int").alias("first_windows"), F.max("most").alias("max_copies"),
    ).drop("run")
