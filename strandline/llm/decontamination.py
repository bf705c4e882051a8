"""Benchmark decontamination by winnowing.

Words are hashed, and every ``K`` consecutive words make a gram. Of each ``W`` consecutive grams the one with the smallest hash is kept (all of
them, where equal), in test items and in training texts alike. A span of ``GUARANTEE`` = W + K - 1 words or more that both share holds a whole window of
grams, whose minimum both keep; so joining the kept hashes finds every such span. Each hit is then extended word by word to
the whole shared span, whose words are then compared byte by byte, and spans shorter than ``MIN_WORDS`` are dropped.

Test items of up to ``SMALL_BYTES`` together are broadcast, fingerprints and words, and texts are matched in one pass without a shuffle. A larger
test set is joined on the fingerprints, and only texts with hits are brought together with their items.

Defined results: words are runs of letters and digits, lower-cased. A text or item that is null, empty or under K words shares nothing.
Items of K to W + K - 2 words have their smallest gram kept; nothing is guaranteed for these. Each maximal span is one row; an item that is in
a text twice, or repeated in the test set under several ids, gives a row for each. An item
without an id is an item like any other; its spans have a null item_id. Rows that share a doc_id are each looked at by themselves. The stage
judges each row by its own text, whatever its doc_id and however large the test set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import common, kernel
from strandline.llm.kernel import U

K, W = 5, 4
GUARANTEE = W + K - 1
MIN_WORDS = 8
SMALL_BYTES = 16 << 20
_SPAN = "doc_id long, item_id long, doc_start int, item_start int, words int"
_SPAN_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("doc_start", pa.int32()), ("item_start", pa.int32()), ("words", pa.int32())])
_DIGEST_ARROW = _SPAN_ARROW.append(pa.field("digest", pa.binary()))


def fingerprints(words: kernel.Words, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, word index over all texts, text) of the grams that winnowing keeps."""
    at, doc = kernel.inside(words.first, k)
    if not len(at):
        return np.zeros(0, U), at, doc
    gram = kernel.windows(words.h, k, 7)[at]
    keep = np.zeros(len(gram), bool)
    if len(gram) >= w:
        least = kernel.sliding_min(gram, w)
        whole = doc[w - 1 :] == doc[: len(doc) - w + 1]
        least[~whole] = 0
        padded = np.concatenate([np.zeros(w - 1, U), least, np.zeros(w - 1, U)])
        most = padded[: len(gram)].copy()
        for j in range(1, w):
            np.maximum(most, padded[j : j + len(gram)], out=most)
        keep = (most == gram) & (most > 0)
    per = np.bincount(doc, minlength=len(words.first) - 1)
    few = (per > 0) & (per < w)
    if few.any():
        first = np.cumsum(per) - per
        low = np.minimum.reduceat(gram, first[per > 0])
        smallest = np.zeros(len(per), U)
        smallest[per > 0] = low
        keep |= few[doc] & (gram == smallest[doc])
    return gram[keep], at[keep], doc[keep]


def shared_runs(a: np.ndarray, b: np.ndarray, offset: int, least: int) -> list[tuple[int, int]]:
    """Maximal equal runs, of ``least`` words or more, of a[i] and b[i - offset]: (start in a, length)."""
    lo, hi = max(0, offset), min(len(a), len(b) + offset)
    same = np.zeros(hi - lo + 2, np.int8)
    same[1:-1] = a[lo:hi] == b[lo - offset : hi - offset]
    step = np.diff(same)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return [(int(s) + lo, int(e - s)) for s, e in zip(starts, ends) if e - s >= least]


def equal_runs(a: list[bytes], b: list[bytes], start: int, least: int) -> list[tuple[int, int]]:
    """Runs, of ``least`` words or more, of words that are equal byte by byte; all of a and b, unless a hash has let us down."""
    if a == b:
        return [(start, len(a))]
    same = [False, *(x == y for x, y in zip(a, b)), False]
    edge = [k for k in range(1, len(same)) if same[k] != same[k - 1]]
    return [(start + x - 1, y - x) for x, y in zip(edge[::2], edge[1::2]) if y - x >= least]


class TestSet:
    """Fingerprints of the test items, sorted by hash, and the items' words."""

    __test__ = False

    def __init__(self, ids: list[int | None], texts: list[str | None]) -> None:
        words = kernel.Words(pa.array(texts, pa.large_string()))
        h, at, item = fingerprints(words)
        order = np.argsort(h, kind="stable")
        self.ids = ids
        self.hash, self.at, self.item = h[order], (at - words.first[item])[order], item[order]
        self.words = words
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.hash >> U(42)).astype(np.int64)] = True

    def spans(self, words: kernel.Words, least: int = MIN_WORDS) -> list[tuple[int, int, int, int, int]]:
        """(text, item index, start in text, start in item, words), each maximal span once."""
        h, at, doc = fingerprints(words)
        hit = np.flatnonzero(self.filter[(h >> U(42)).astype(np.int64)])
        lo, hi = np.searchsorted(self.hash, h[hit], "left"), np.searchsorted(self.hash, h[hit], "right")
        some = hi > lo
        hit, lo, hi = hit[some], lo[some], hi[some]
        if not len(hit):
            return []
        k = kernel.spans(lo, hi - lo)
        who = np.repeat(hit, hi - lo)
        lines = np.unique(np.stack([doc[who], self.item[k], at[who] - words.first[doc[who]] - self.at[k]], 1), axis=0)
        found = []
        last, letters = -1, []
        for d, i, offset in lines.tolist():
            text = words.h[words.first[d] : words.first[d + 1]]
            item = self.words.h[self.words.first[i] : self.words.first[i + 1]]
            runs = shared_runs(text, item, offset, least)
            if runs and d != last:
                last, letters = d, words.texts(d)
            other = self.words.texts(i) if runs else []
            for s, n in runs:
                found += [(d, i, a, a - offset, b) for a, b in equal_runs(letters[s : s + n], other[s - offset : s - offset + n], s, least)]
        return found


def _items(test: DataFrame) -> DataFrame:
    return test.select(test["item_id"].cast("long").alias("item_id"), test["text"].cast("string").alias("item_text")).where("item_text is not null")


def _is_small(items: DataFrame, limit: int) -> bool:
    return (items.agg(F.sum(F.octet_length("item_text") + 64)).first()[0] or 0) <= limit


def _collected(items: DataFrame) -> TestSet:
    rows = items.orderBy("item_id", "item_text").collect()
    return TestSet([r["item_id"] for r in rows], [r["item_text"] for r in rows])


def _batch(rows: list[tuple], schema: pa.Schema = _SPAN_ARROW) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _joined_spans(rows: DataFrame, items: DataFrame, min_words: int) -> DataFrame:
    """The spans found by joining fingerprints, with the SHA-256 of the document's text."""

    def keep(id_name: str, text_name: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in kernel.slices(whole, text_name):
                    h, _, doc = fingerprints(kernel.Words(batch.column(1)))
                    pair = pa.table({"h": pa.array(h.view(np.int64)), "i": pa.array(doc)}).group_by(["h", "i"]).aggregate([])
                    yield pa.record_batch([pair["h"].combine_chunks().cast(pa.int64()), batch.column(0).take(pair["i"].combine_chunks()), batch.column(2).take(pair["i"].combine_chunks())], names=["h", id_name, "check_" + id_name])

        return run

    tagged = rows.withColumn("check", F.xxhash64("text"))
    item_rows = items.withColumn("check", F.xxhash64("item_text"))
    left = tagged.mapInArrow(keep("doc_id", "text"), "h long, doc_id long, check_doc_id long")
    right = item_rows.mapInArrow(keep("item_id", "item_text"), "h long, item_id long, check_item_id long")
    pairs = left.join(right, "h").select("doc_id", "check_doc_id", "item_id", "check_item_id").distinct()
    on_item = pairs["item_id"].eqNullSafe(item_rows["item_id"]) & (pairs["check_item_id"] == item_rows["check"])
    with_item = pairs.join(item_rows, on_item).select(pairs["doc_id"].alias("d"), "check_doc_id", pairs["item_id"], "item_text")
    on_doc = tagged["doc_id"].eqNullSafe(F.col("d")) & (tagged["check"] == F.col("check_doc_id"))
    both = tagged.join(with_item, on_doc).select("doc_id", "text", "item_id", "item_text", F.unhex(F.sha2("text", 256)).alias("digest"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in kernel.slices(whole):
                found = []
                for d, text, i, item, digest in zip(*(c.to_pylist() for c in batch.columns)):
                    spans = TestSet([i], [item]).spans(kernel.Words(pa.array([text], pa.large_string())), min_words)
                    found += [(d, i, s, t, n, digest) for _, _, s, t, n in spans]
                if found:
                    yield _batch(found, _DIGEST_ARROW)

    return both.mapInArrow(extend, _SPAN + ", digest binary")


def contaminated_spans(spark: SparkSession, docs: DataFrame, test: DataFrame, min_words: int = MIN_WORDS, small_bytes: int = SMALL_BYTES) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, words) of every maximal span of ``min_words`` words or more that a document shares with an item; starts count words from 0."""
    rows, items = common.id_text(docs).where("text is not null"), _items(test)
    if _is_small(items, small_bytes):
        shared = spark.sparkContext.broadcast(_collected(items))

        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in kernel.slices(whole):
                    found = shared.value.spans(kernel.Words(batch.column(1)), min_words)
                    if found:
                        ids = batch.column(0).to_pylist()
                        yield _batch([(ids[d], shared.value.ids[i], s, t, n) for d, i, s, t, n in found])

        return rows.mapInArrow(match, _SPAN)

    return _joined_spans(rows, items, min_words).drop("digest")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that share no span of ``MIN_WORDS`` words with a benchmark item, with all their columns."""
    test = common.table(common.tuned(spark), sf_dir, "benchmark")
    items = _items(test)
    if not _is_small(items, SMALL_BYTES):
        found = _joined_spans(common.id_text(docs).where("text is not null"), items, MIN_WORDS)
        name = common.fresh_name(docs, "gone")
        gone = common.written(spark, found.select(F.col("digest").alias(name)).distinct(), "contaminated")
        return docs.join(gone, F.unhex(F.sha2(docs["text"].cast("string"), 256)) == F.col(name), "left_anti")
    shared = spark.sparkContext.broadcast(_collected(items))

    @F.arrow_udf("boolean")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in texts:
            good = []
            for batch in kernel.slices(pa.record_batch([arr], names=["text"])):
                part = np.ones(batch.num_rows, bool)
                part[[d for d, *_ in shared.value.spans(kernel.Words(batch.column(0)))]] = False
                good.append(part)
            yield pa.array(np.concatenate(good) if good else np.zeros(0, bool))

    return docs.where(clean(docs["text"].cast("string")))
