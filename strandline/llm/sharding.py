"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``VNODES`` points of a 64-bit ring, and a key belongs to the next point clockwise. No shard takes more than
ceil((1 + EPSILON) * keys / shards). Each shard first takes the keys of its own arcs in ring order; where it is full, the rest of an
arc (its keys furthest along, by hash and then by key) continues clockwise to the next points whose shards have room. Only keys
of overfull arcs move, and a change in the number of shards moves about keys / shards.

The plan is made from the number of keys of each arc (shards * VNODES numbers, whatever the data); keys are ranked only inside arcs
that are split.

Equal keys are counted before they are ranked, partition by partition, so no task holds all rows of one key.

Defined results: a key is a doc_id; equal doc_ids hash alike and are ranked next to each other, so rows repeated stay together but for a
boundary that falls between them. A null doc_id hashes as a key of its own. Texts aren't read. An empty table gives an empty one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.kernel import U, mix

SHARDS, VNODES, EPSILON = 64, 64, 0.05
_TOP = U(1 << 63)


@dataclass
class Ring:
    """Points in ring order, shifted by 2**63 so that signed hashes compare alike; shard of each point."""

    point: np.ndarray
    shard: np.ndarray


def ring(shards: int = SHARDS, vnodes: int = VNODES) -> Ring:
    """A shard's points depend on its number only, so adding shards leaves the others' points where they are."""
    own = np.repeat(np.arange(shards), vnodes)
    point = mix(mix(own.astype(U), 11) ^ mix(np.tile(np.arange(vnodes), shards).astype(U), 12), 13)
    signed = (point ^ _TOP).view(np.int64)
    order = np.argsort(signed, kind="stable")
    return Ring(signed[order], own[order])


def arcs(r: Ring, hashes: np.ndarray) -> np.ndarray:
    """Index of the next point clockwise, past the last one again the first."""
    return np.searchsorted(r.point, hashes) % len(r.point)


def plan(r: Ring, counts: np.ndarray, epsilon: float = EPSILON) -> list[tuple[int, int, int, int]]:
    """(arc, ranks below, shard, hops) pieces, for each arc in order of rank: its keys with a rank under ``ranks below`` (and not of
    an earlier piece) go to ``shard``, ``hops`` points further on."""
    shards = int(r.shard.max()) + 1
    room = np.full(shards, math.ceil((1 + epsilon) * int(counts.sum()) / shards))
    pieces: list[tuple[int, int, int, int]] = []
    over = []
    for arc in np.flatnonzero(counts):
        s = r.shard[arc]
        took = int(min(room[s], counts[arc]))
        room[s] -= took
        if took:
            pieces.append((int(arc), took, int(s), 0))
        if took < counts[arc]:
            over.append((int(arc), took, int(counts[arc])))
    for arc, done, total in over:
        hop = 0
        while done < total:
            hop += 1
            s = r.shard[(arc + hop) % len(r.point)]
            took = int(min(room[s], total - done))
            if took:
                room[s] -= took
                done += took
                pieces.append((arc, done, int(s), hop))
    return sorted(pieces)


def _ranked(keyed: DataFrame) -> DataFrame:
    """``rank`` of each row in its arc, by hash and key, from 1. Equal keys are counted first, one row each, and given their ranks by a number within
    the key, so that a key with a third of all rows is numbered in many tasks; keys are numbered in ranges of the hash, many to an arc."""
    salted = keyed.withColumn("salt", F.spark_partition_id())
    parts = salted.groupBy("arc", "h", "doc_id", "salt").agg(F.count("*").alias("n"))
    slot = F.shiftright("h", 50)
    of_key = Window.partitionBy("arc", "h", "doc_id").orderBy("salt")
    before = parts.withColumn("in_key", F.sum("n").over(of_key) - F.col("n"))
    keys = parts.groupBy("arc", "h", "doc_id").agg(F.sum("n").alias("n")).withColumn("slot", slot)
    slots = keys.groupBy("arc", "slot").agg(F.sum("n").alias("n"))
    lead = slots.withColumn("lead", F.sum("n").over(Window.partitionBy("arc").orderBy("slot")) - F.col("n")).drop("n")
    in_slot = keys.withColumn("at", F.sum("n").over(Window.partitionBy("arc", "slot").orderBy("h", "doc_id")) - F.col("n"))
    starts = in_slot.join(lead, ["arc", "slot"]).select("arc", "h", "doc_id", (F.col("at") + F.col("lead")).alias("start"))
    on = lambda a, b: (a["h"] == b["h"]) & a["doc_id"].eqNullSafe(b["doc_id"])
    placed = before.join(starts, on(before, starts)).select(before["arc"], before["h"], before["doc_id"], "salt", (F.col("start") + F.col("in_key")).alias("start"), "n")
    return placed.select("doc_id", "h", "arc", F.explode(F.sequence(F.col("start") + 1, F.col("start") + F.col("n"))).alias("rank"))


def shard_keys(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, vnodes: int = VNODES, epsilon: float = EPSILON) -> DataFrame:
    """(doc_id, shard, hops) of every row; hops is 0 where the key is in its own arc's shard."""
    r = ring(shards, vnodes)

    @F.arrow_udf("int")
    def arc_of(h: pa.Array) -> pa.Array:
        return pa.array(arcs(r, h.to_numpy(zero_copy_only=False)), pa.int32())

    key = docs.select(docs["doc_id"].cast("long").alias("doc_id"))
    keyed = key.withColumn("h", F.xxhash64("doc_id")).withColumn("arc", arc_of("h"))
    counts = np.zeros(len(r.point), np.int64)
    for row in keyed.groupBy("arc").count().collect():  # as many rows as the ring has points at most
        counts[row["arc"]] = row["count"]
    pieces = plan(r, counts, epsilon)
    piece_arc, piece_end = (np.array([p[i] for p in pieces], np.int64) for i in (0, 1))
    piece_shard, piece_hops = (np.array([p[i] for p in pieces], np.int32) for i in (2, 3))
    first = np.searchsorted(piece_arc, np.arange(len(r.point) + 1))
    split = np.flatnonzero(np.diff(first) > 1)
    # one rising number for each piece: arcs one after the other, each as long as its keys are many
    base = np.cumsum(counts) - counts
    bound = base[piece_arc] + piece_end

    @F.arrow_udf("struct<shard:int,hops:int>")
    def place(arc: pa.Array, rank: pa.Array) -> pa.Array:
        a, k = arc.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        which = np.searchsorted(bound, base[a] + k)
        return pa.StructArray.from_arrays([pa.array(piece_shard[which]), pa.array(piece_hops[which])], names=["shard", "hops"])

    parted = F.col("arc").isin(split.tolist()) if len(split) else F.lit(False)
    ranked = keyed.where(~parted).withColumn("rank", F.lit(1).cast("long"))
    if len(split):
        ranked = ranked.unionByName(_ranked(keyed.where(parted)))
    return ranked.select("doc_id", place("arc", "rank").alias("p")).select("doc_id", "p.shard", "p.hops")
