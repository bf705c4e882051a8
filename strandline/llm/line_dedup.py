"""Line de-duplication by aligning overlapping documents.

Each document is the sequence of its lines' hashes. Texts that are equal line by line are one content: its later documents lose all their
lines. A later content is aligned by patience diff with every earlier one that shares a line with it, however many hold that line, and each aligned common block
that holds a line which isn't empty is deleted from the later document (``every_deletion``; the query runs this).

Partners that can't add a deletion are skipped, which changes no result. A line can only be deleted by a partner that holds it, and an empty line by one
that holds the same run from the nearest line before or after it: these are the line's items. So the document is aligned with the first
holder of each of its items, then for the lines that are left with the next 4 holders of theirs, the next 16 and so on, until no line is left or no earlier holder of it is.
Each round's rows are written to the shared folder. What grows faster than the input: a line that many hold and that is never aligned
(say, twice in a document, once in all others) brings its document together with all its earlier holders.

``deletions`` is a narrower rule, not run by any query: a line is rare when it is in at least two and at most max(``RARE_FLOOR``, ``RARE_SHARE`` of all) contents, every later
holder is paired only with the line's earliest one, and only blocks with such a line are deleted.

Only line hashes travel; texts move once, to be cut.

Defined results: lines are compared without surrounding white space; lines left empty are never compared, and are deleted only
inside a block. Later means a larger doc_id. A null text stays null and an empty one empty. Where all lines go, the text becomes empty. A document is aligned
with earlier documents as they came, not as they were cut, and loses the union of all blocks. Rows sharing a doc_id are one document
(see ``one_row_per_id``); rows with a null doc_id keep their text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm import common

RARE_FLOOR, RARE_SHARE = 16, 0.01
BLANK = 0
WIDER = 4
_ROUND = pa.schema([("doc_id", pa.int64()), ("lines", pa.list_(pa.int64())), ("gone", pa.list_(pa.int32())), ("open", pa.list_(pa.int64()))])


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (i, j), a[i] == b[j], both rising: common ends first, then lines unique on both sides by their longest rising
    run, then the same between these anchors."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            out.append((alo, blo))
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            ahi, bhi = ahi - 1, bhi - 1
            out.append((ahi, bhi))
        if alo == ahi or blo == bhi:
            continue
        na, nb = Counter(a[alo:ahi]), Counter(b[blo:bhi])
        where = {b[j]: j for j in range(blo, bhi) if nb[b[j]] == 1}
        both = [(i, where[a[i]]) for i in range(alo, ahi) if na[a[i]] == 1 and a[i] in where]
        tops: list[int] = []
        ends: list[int] = []
        before = [-1] * len(both)
        for k, (_, j) in enumerate(both):
            at = bisect_left(tops, j)
            before[k] = ends[at - 1] if at else -1
            if at == len(tops):
                tops.append(j)
                ends.append(k)
            else:
                tops[at], ends[at] = j, k
        chain, k = [], ends[-1] if ends else -1
        while k >= 0:
            chain.append(both[k])
            k = before[k]
        if chain:
            x, y = alo, blo
            for i, j in reversed(chain):
                out.append((i, j))
                todo.append((x, i, y, j))
                x, y = i + 1, j + 1
            todo.append((x, ahi, y, bhi))
    return sorted(out)


def deleted_lines(later: list[int], earlier: list[int], rare: set[int] | None = None) -> set[int]:
    """Places in ``later`` inside an aligned common block that holds a line of ``rare``; without it, a line that isn't empty."""
    gone: set[int] = set()
    pairs = patience(later, earlier)
    k = 0
    while k < len(pairs):
        e = k + 1
        while e < len(pairs) and pairs[e][0] == pairs[e - 1][0] + 1 and pairs[e][1] == pairs[e - 1][1] + 1:
            e += 1
        block = [i for i, _ in pairs[k:e]]
        if any(later[i] != BLANK if rare is None else later[i] in rare for i in block):
            gone.update(block)
        k = e
    return gone


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, places = [], []
        for doc, later, partners in zip(*(c.to_pylist() for c in batch.columns)):
            gone: set[int] = set()
            for p in partners:
                gone |= deleted_lines(later, p["lines"], set(p["rare"]))
            if gone:
                ids.append(doc)
                places.append(sorted(gone))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.list_(pa.int32()))], names=["doc_id", "gone"])


def items(lines: list[int]) -> list[list[int]]:
    """For each place, hashes of what a partner must hold to delete it: the line, or for an empty one its run from the nearest other line on either side."""
    out: list[list[int]] = [[] for _ in lines]
    for step in (1, -1):
        near, far = BLANK, 0
        for i in range(len(lines))[::step]:
            if lines[i] != BLANK:
                near, far = lines[i], 0
                out[i] = [near]
            elif near != BLANK:
                far += step
                out[i].append(hash((near, far)))
    return out


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        each = [sorted({x for own in items(v) for x in own}) for v in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(each, pa.list_(pa.int64()))], names=["doc_id", "items"])


def _round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a document come together, its own (with ``gone``) before its partners' lines; one row of ``_ROUND`` for each document."""
    doc, lines, gone, done = None, [], set(), []

    def settle() -> None:
        if doc is not None:
            left = {x for i, own in enumerate(items(lines)) if i not in gone for x in own}
            done.append((doc, lines, sorted(gone), sorted(left)))

    def out() -> pa.RecordBatch:
        rows = [pa.array([r[i] for r in done], f.type) for i, f in enumerate(_ROUND)]
        done.clear()
        return pa.RecordBatch.from_arrays(rows, schema=_ROUND)

    for batch in batches:
        for i, sequence, before in zip(*(c.to_pylist() for c in batch.columns)):
            if before is not None:
                settle()
                doc, lines, gone = i, sequence, set(before)
            elif len(gone) < len(lines):
                gone |= deleted_lines(lines, sequence)
        yield out()
    settle()
    yield out()


def _sequences(rows: DataFrame) -> DataFrame:
    line = F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\t\r]", " ")))
    hashed = F.transform(line, lambda x: F.when(x == "", F.lit(BLANK).cast("long")).otherwise(F.xxhash64(x)))
    return rows.where("text is not null and text <> ''").select("doc_id", hashed.alias("lines"))


def _contents(spark: SparkSession, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, lines) of the first document of each content; the deletions of all others."""
    lines = common.written(spark, _sequences(rows).withColumn("content", F.sha2(F.array_join(F.transform("lines", lambda x: x.cast("string")), ","), 256)), "lines")
    content = lines.groupBy("content").agg(F.min("doc_id").alias("lead"), F.count("*").alias("n"))
    copies = content.where("n > 1")
    copied = lines.join(copies, "content").where("doc_id <> lead").select("doc_id", F.sequence(F.lit(0), F.size("lines") - 1).alias("gone"))
    leads = content.select(F.col("lead").alias("doc_id"))
    return common.written(spark, lines.join(leads, "doc_id", "left_semi").select("doc_id", "lines"), "contents"), copied


def every_deletion(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(doc_id, gone array<int>) of the documents that lose lines, each aligned with every earlier content that shares a line with it; lines count from 0."""
    contents, copied = _contents(spark, rows)
    held = contents.mapInArrow(_items, "doc_id long, items array<long>").select("doc_id", F.explode("items").alias("item"))
    order = Window.partitionBy("item").orderBy("doc_id")
    ranks = held.withColumns({"rank": F.row_number().over(order) - 1, "next": F.lead("doc_id").over(order)})
    ranked = common.written(spark, ranks.where("rank > 0 or next is not null").select("item", "doc_id", "rank"), "ranked")
    holders = ranked.select("item", F.col("doc_id").alias("partner"), F.col("rank").alias("at"))
    left = ranked.where("rank > 0")
    state = contents.withColumn("gone", F.array().cast("array<int>"))
    rounds, lo, step = [], 0, 1
    while True:
        near = holders.where((F.col("at") >= lo) & (F.col("at") < lo + step))
        pairs = left.join(near, "item").where("at < rank").select("doc_id", "partner").distinct()
        others = pairs.join(contents.select(F.col("doc_id").alias("partner"), "lines"), "partner").select("doc_id", "lines", F.lit(None).cast("array<int>").alias("gone"))
        own = state.join(left.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "lines", "gone")
        together = own.unionByName(others).repartition("doc_id").sortWithinPartitions("doc_id", F.col("gone").isNull())
        state = common.written(spark, together.mapInArrow(_round, "doc_id long, lines array<long>, gone array<int>, open array<long>"), "round")
        rounds.append(state.select("doc_id", "gone"))
        lo, step = lo + step, step * WIDER
        left = state.select("doc_id", F.explode("open").alias("item")).join(ranked.where(F.col("rank") > lo), ["doc_id", "item"])
        left = common.written(spark, left.select("item", "doc_id", "rank"), "open")
        if left.limit(1).count() == 0:
            break
    gone = reduce(DataFrame.unionByName, rounds).groupBy("doc_id").agg(F.max_by("gone", F.size("gone")).alias("gone"))  # each round holds what the ones before it found
    return gone.where("size(gone) > 0").unionByName(copied)


def deletions(spark: SparkSession, rows: DataFrame, floor: int = RARE_FLOOR, share: float = RARE_SHARE) -> DataFrame:
    """(doc_id, gone array<int>) of the documents that lose lines by the narrower rule; lines count from 0."""
    contents, copied = _contents(spark, rows)
    holders = contents.select("doc_id", F.explode(F.array_distinct("lines")).alias("line")).where(F.col("line") != BLANK)
    most = max(floor, int(share * contents.count()))
    firsts = holders.groupBy("line").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("n") <= most))
    pairs = holders.join(firsts, "line").where("doc_id <> first").groupBy("doc_id", "first").agg(F.collect_list("line").alias("rare"))
    earlier = contents.select(F.col("doc_id").alias("first"), F.col("lines").alias("other"))
    partners = pairs.join(earlier, "first").groupBy("doc_id").agg(F.collect_list(F.struct(F.col("other").alias("lines"), "rare")).alias("partners"))
    aligned = contents.join(partners, "doc_id").select("doc_id", "lines", "partners").mapInArrow(_align, "doc_id long, gone array<int>")
    return aligned.unionByName(copied)


def line_dedup(spark: SparkSession, docs: DataFrame, floor: int = RARE_FLOOR, share: float = RARE_SHARE, every_pair: bool = False) -> DataFrame:
    """(doc_id, text without the deleted lines, n_lines, removed array<int>) of every document; ``every_pair`` is the whole job, else the narrower rule."""
    rows = common.one_row_per_id(spark, docs)
    gone = common.written(spark, every_deletion(spark, rows) if every_pair else deletions(spark, rows, floor, share), "deletions").toDF("__id", "gone")
    # both sides are always shuffled: deletions grow with the corpus, so a plan that broadcasts them on small tables only would not be the one that runs on large ones
    every = rows.join(gone.hint("merge"), F.col("doc_id") == F.col("__id"), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    out = every.select(
        "doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).alias("n_lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("removed"),
    )
    bare = common.id_text(docs).where("doc_id is null").select("doc_id", "text", F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).alias("n_lines"), F.array().cast("array<int>").alias("removed"))
    return out.unionByName(bare)
