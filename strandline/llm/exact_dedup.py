"""Exact de-duplication against a minimal perfect hash of the history's distinct digests.

The documents already taken in (the history) are reduced to distinct SHA-256 digests, each with its winner, the smallest doc_id.
Digests are spread over buckets by their leading bits. In each bucket a minimal perfect hash is built over the history's
digests; its slots hold the full 32-byte digest and the winner's doc_id. A new document's digest is looked up: the function
sends any digest to some slot, so the slot's bytes decide. Equal bytes make it a repeat of that winner, and it goes; digests
that aren't members are grouped among themselves and the smallest doc_id of each group stays. Only digests and ids are shuffled, pre-combined
before the exchange, so a text with a billion copies costs a row for each task.

Defined results: two texts are copies when their UTF-8 bytes are equal; the smallest doc_id wins (a null doc_id comes last).
The empty text is a text like others. A null text equals nothing and stays. Rows repeated with doc_id and text are one document, and
one row of them stays. An empty table gives an empty one. Other columns, whatever their names, come through unread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import common
from strandline.llm.kernel import U, mix

_DIGEST = pa.binary(32)


class PerfectHash:
    """Minimal perfect hash of distinct 32-byte keys (rows of a uint8 matrix), by levels of bit arrays.

    On each level the keys left are hashed to an array of twice their number of bits; a bit that just one key takes is that
    key's, and the others go on to the next level. A key's index is the rank of its bit among all set bits.
    """

    def __init__(self, keys: np.ndarray) -> None:
        words = np.ascontiguousarray(keys).view(np.uint64).reshape(-1, 4)
        self.n, left, self.levels, level, ranks = len(words), words, [], 0, 0
        while len(left):
            m = max(64, 2 * len(left))
            spot = (self._hash(left, level) % U(m)).astype(np.int64)
            own = np.bincount(spot, minlength=m) == 1
            self.levels.append((m, own, ranks + np.cumsum(own) - own))
            ranks += int(own.sum())
            left, level = left[~own[spot]], level + 1

    @staticmethod
    def _hash(words: np.ndarray, level: int) -> np.ndarray:
        return mix(mix(words[:, 0], level) ^ words[:, 1] ^ mix(words[:, 2] + words[:, 3], level + 1000), level)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key: members get theirs; others get any slot, or -1 where every level has them fall on an unowned bit."""
        words = np.ascontiguousarray(keys).view(np.uint64).reshape(-1, 4)
        out, todo = np.full(len(words), -1, np.int64), np.arange(len(words))
        for level, (m, own, rank) in enumerate(self.levels):
            if not len(todo):
                break
            spot = (self._hash(words[todo], level) % U(m)).astype(np.int64)
            hit = own[spot]
            out[todo[hit]] = rank[spot[hit]]
            todo = todo[~hit]
        return out


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(arr):
        return np.zeros((0, 32), np.uint8)
    return np.frombuffer(b"".join(arr.to_pylist()), np.uint8).reshape(-1, 32)


def _look_up(tables: pa.Table) -> pa.Table:
    """Of one bucket: the history's digests as they are, and the new ones that no slot holds."""
    old = tables.filter(tables["historical"])
    new = tables.filter(pa.compute.invert(tables["historical"]))
    keys, asked = _matrix(old["digest"]), _matrix(new["digest"])
    table = PerfectHash(keys)
    slots = np.zeros((table.n, 32), np.uint8)
    where = table.index(keys)
    slots[where] = keys
    at = table.index(asked)
    repeat = (at >= 0) & (slots[np.maximum(at, 0)] == asked).all(1) if table.n else np.zeros(len(asked), bool)
    locator = np.zeros(table.n, np.int64)
    locator[where] = np.arange(len(keys))
    copies = old["copies"].to_numpy().copy()
    np.add.at(copies, locator[at[repeat]], new["copies"].to_numpy()[repeat])
    kept = old.set_column(old.schema.get_field_index("copies"), "copies", pa.array(copies, pa.int64()))
    return pa.concat_tables([kept, new.filter(pa.array(~repeat))]).drop_columns(["bucket"])


def digests(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def winners(spark: SparkSession, docs: DataFrame, history: Column | None = None) -> DataFrame:
    """(digest, historical, doc_id, copies, winner_rows) of the documents that stay.

    history: a condition on ``doc_id`` telling the rows already taken in; by default those in the lower half of the doc_id range, as ids
    are given in the order of arrival.
    """
    rows = common.id_text(docs).where("text is not null")
    if history is None:
        low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
        history = F.col("doc_id") <= F.lit(((low or 0) + (high or 0)) // 2)
    hashed = rows.select(digests(F.col("text")).alias("digest"), "doc_id", F.coalesce(history, F.lit(False)).alias("historical"))
    per_id = hashed.groupBy("digest", "historical", "doc_id").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("n").alias("n")))
    distinct = per_id.groupBy("digest", "historical").agg(least.alias("w"), F.sum("n").alias("copies"))
    buckets = 2 * common.bucket_count(spark, docs, 64.0)
    bucket = F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(buckets))
    spread = distinct.select(bucket.alias("bucket"), "digest", "historical", F.col("w.id").alias("doc_id"), "copies", F.col("w.n").alias("winner_rows"))
    schema = "digest binary, historical boolean, doc_id long, copies long, winner_rows long"
    return spread.groupBy("bucket").applyInArrow(_look_up, schema)


def exact_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, copies, historical, digest in hex) of each document that stays; a null text's digest is null."""
    kept = winners(spark, docs).select("doc_id", "copies", "historical", F.lower(F.hex("digest")).alias("digest"))
    nulls = common.id_text(docs).where("text is null")
    return kept.unionByName(nulls.select("doc_id", F.lit(1).cast("long").alias("copies"), F.lit(False).alias("historical"), F.lit(None).cast("string").alias("digest")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, with all its columns.

    The winners (digest and id, no text) are written once. Documents are matched to them by doc_id and digest, so texts don't move further than
    that join needs; only where some winner has several rows are those rows alone reduced to one.
    """
    won = common.written(spark, winners(spark, docs).select(F.col("digest").alias("__won"), F.col("doc_id").alias("__id"), F.col("winner_rows").alias("__rows")), "winners")
    key = docs["doc_id"].cast("long").eqNullSafe(won["__id"]) & (digests(docs["text"].cast("string")) == won["__won"])
    several = bool(won.where("__rows > 1").limit(1).count())
    single = docs.join(won.where("__rows = 1") if several else won, key, "left_semi")
    out = single.unionByName(docs.where(docs["text"].isNull()))
    if several:
        more = docs.join(won.where("__rows > 1"), key, "left_semi")
        out = out.unionByName(more.dropDuplicates(["doc_id", "text"]))
    return out
