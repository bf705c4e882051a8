"""Documents whose sets of word n-grams have a Jaccard similarity of at least ``TAU``: each one's class and number of links, or all pairs.

Prefix filtering: put the tokens (hashed n-grams) of each set in some global order; two sets of sizes a, b with similarity t or more
share a token among the first a - ceil(t a) + 1 of one and the first b - ceil(t b) + 1 of the other. That holds for any order, so a pair must share
a prefix token under each of ``ORDERS`` different orders, and the filters are intersected before a pair is verified. All orders put tokens with
few documents first, and break ties by different hashes: tokens of one document only fill most prefixes, and passages that
thousands of documents share come last.

1. Equal texts are one document with a weight from here on, by SHA-256; the later copies come in again at the end, by a join.
2. Tokens go to buckets by hash, packed (6 bytes a token), and are counted there exactly. Only tokens of two documents or more go back.
3. Each document's prefixes are cut. A document whose prefix holds one-document tokens only can't have a partner and ends here.
4. The rest are grouped: documents that share a prefix token of the first order are linked, and linked documents form a group (connected
   components). A group over ``BLOCK`` documents is parted again by the prefix tokens of the other orders. Pairs can only be inside a group.
5. In a group the filters of all orders and then the intersections are products of 0/1 matrices, some rows at a time against the documents that share
   a prefix token with them; rows are laid out by a min-hash, so that copies are next to each other. A group still over ``BLOCK`` documents is
   cut into blocks, and each pair of blocks is a cell of its own, so no task holds more than two blocks; nothing is left out, but a document of
   a group of m blocks travels m times.

A class is what links connect, and pairs inside it are counted, never listed: each cell gives a row for each of its documents. ``similar_pairs`` lists
the pairs between different texts.

Defined results: words are runs of letters and digits, lower-cased. A text with fewer than N words has its whole word sequence as its only
token; a null or empty text has no partner. Texts without words are linked to equal texts only. Rows sharing a doc_id are one document (see ``one_row_per_id``), rows with a
null doc_id take no part. Copies have similarity 1. Tokens are compared by 48 bits of hash: for two sets of 1000 tokens, one in 10**8 such pairs
of sets counts a token too many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import common, kernel
from strandline.llm.kernel import U

N, TAU, ORDERS, BLOCK = 3, 0.6, 3, 2048
ROWS, WIDTH = 128, 8192
BITS = 48
#: Tokens that a task packs together: the more, the fewer and larger rows it sends.
FLUSH = 1 << 20
_PACKED = "bucket int, base long, ids binary, sizes binary, counts binary, tokens binary, dfs binary"
_LINKED = "doc_id long, low long, links long, alone boolean"
_DOC = "doc_id long, size int, tokens binary, marks binary, keys array<long>"
#: Places of up to so many documents (some 32 MB) are broadcast to the documents' tokens.
PLACED_ROWS = 1 << 20


def _pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view("<u8").reshape(-1).astype(U)


def _join(column: pa.ChunkedArray) -> bytes:
    return b"".join(column.to_pylist())


def _ids(t: pa.Table) -> np.ndarray:
    parts = [np.frombuffer(raw, "<u4" if 4 * n == len(raw) else "<i8").astype(np.int64) + base for base, raw, n in zip(t["base"].to_pylist(), t["ids"].to_pylist(), (len(c) // 4 for c in t["counts"].to_pylist()))]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def tokens_of(texts: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(token, text) for each n-gram of each text, repeats included; tokens have 48 bits."""
    words = kernel.Words(texts)
    at, doc = kernel.inside(words.first, n)
    token = kernel.windows(words.h, n)[at] if len(at) else np.zeros(0, U)
    count = words.count()
    for k in range(1, n):  # texts of k words
        few = np.flatnonzero(count == k)
        if len(few):
            token = np.concatenate([token, kernel.windows(words.h, k)[words.first[few]]])
            doc = np.concatenate([doc, few])
    return token >> U(64 - BITS), doc


def _runs(bucket: int, ids, sizes, counts, tokens, dfs=None) -> dict:
    """One packed row. Ids are 4 bytes each above the smallest where that holds them."""
    base = int(ids.min())
    near = int(ids.max()) - base < 1 << 32
    return {
        "bucket": int(bucket), "base": base if near else 0, "ids": (ids - base).astype("<u4").tobytes() if near else ids.astype("<i8").tobytes(), "sizes": sizes.astype("<u4").tobytes(),
        "counts": counts.astype("<u4").tobytes(), "tokens": _pack(tokens), "dfs": b"" if dfs is None else dfs.astype("<u2").tobytes(),
    }


def _schema() -> pa.Schema:
    return pa.schema([("bucket", pa.int32()), ("base", pa.int64()), *((c, pa.binary()) for c in ("ids", "sizes", "counts", "tokens", "dfs"))])


def _packed(ids: np.ndarray, token: np.ndarray, doc: np.ndarray, bits: int) -> pa.RecordBatch:
    """Distinct tokens of some documents by bucket. A document's size goes along with the first of its rows only, and is 0 in the others."""
    docs, keep = len(ids), BITS - bits
    cell = (token & U((1 << bits) - 1)) * U(docs) + doc.astype(U)
    order = np.lexsort((token, cell)) if docs.bit_length() + bits + keep > 64 else np.argsort((cell << U(keep)) | (token >> U(bits)))
    cell, token = cell[order], token[order]
    fresh = np.concatenate([[True], (cell[1:] != cell[:-1]) | (token[1:] != token[:-1])])
    cell, rest = cell[fresh].astype(np.int64), token[fresh] >> U(bits)
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    counts, owner, bucket = np.diff(np.append(first, len(cell))), cell[first] % docs, cell[first] // docs
    total = np.bincount(owner, counts, minlength=docs).astype(np.int64)
    who, where = np.unique(owner, return_index=True)
    size = np.zeros(len(owner), np.int64)
    size[where] = total[who]
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    rows = []
    for a, b in zip(edge, np.append(edge[1:], len(bucket))):
        lo, hi = first[a], first[b] if b < len(first) else len(cell)
        rows.append(_runs(bucket[a], ids[owner[a:b]], size[a:b], counts[a:b], rest[lo:hi]))
    return pa.RecordBatch.from_pylist(rows, _schema())


def _spread(bits: int, n: int):
    """Distinct tokens of each text, packed by bucket: a token's ``bits`` low bits name its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            lead = np.cumsum([0, *(len(h[0]) for h in held)])
            whole = _packed(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] + n for h, n in zip(held, lead)]), bits)
            held.clear()
            return whole

        for whole in batches:
            for batch in kernel.slices(whole):
                token, doc = tokens_of(batch.column(1), n)
                if len(token):
                    held.append((batch.column(0).to_numpy(zero_copy_only=False), token, doc))
                if sum(len(h[1]) for h in held) >= FLUSH:
                    yield out()
        if held:
            yield out()

    return run


def _count(bits: int):
    """In one bucket: documents of each token; tokens of two or more go on to their document's home."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        bucket = U(key[0].as_py())
        ids, sizes = _ids(t), np.frombuffer(_join(t["sizes"]), "<u4")
        counts, tokens = np.frombuffer(_join(t["counts"]), "<u4").astype(np.int64), _unpack(_join(t["tokens"]))
        order = np.argsort(tokens, kind="stable")
        ranked = tokens[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        run_length = np.diff(np.append(first, len(ranked)))
        df = np.empty(len(tokens), np.int64)
        df[order] = np.repeat(run_length, run_length)
        live = df > 1
        kept = np.add.reduceat(live.astype(np.int64), np.cumsum(counts) - counts)
        tokens, df = (tokens[live] << U(bits)) | bucket, np.minimum(df[live], 65535)
        some = (kept > 0) | (sizes > 0)
        ids, sizes, kept = ids[some], sizes[some], kept[some]
        home = (kernel.mix(ids.view(U), 5) & U((1 << bits) - 1)).astype(np.int64)
        by_home = np.argsort(home, kind="stable")
        start = (np.cumsum(kept) - kept)[by_home]
        ids, sizes, kept, home = ids[by_home], sizes[by_home], kept[by_home], home[by_home]
        at = kernel.spans(start, kept)
        tokens, df, ends = tokens[at], df[at], np.append(0, np.cumsum(kept))
        edge = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]])) if len(home) else np.zeros(0, np.int64)
        rows = [_runs(home[a], ids[a:b], sizes[a:b], kept[a:b], tokens[ends[a] : ends[b]], df[ends[a] : ends[b]]) for a, b in zip(edge, np.append(edge[1:], len(home)))]
        return pa.Table.from_pylist(rows, _schema())

    return run


def _cut(tau: float, orders: int):
    """At one home: each document's tokens and prefixes; documents whose prefixes hold no shared token go."""

    def run(t: pa.Table) -> pa.Table:
        ids, sizes = _ids(t), np.frombuffer(_join(t["sizes"]), "<u4")
        counts, tokens, df = np.frombuffer(_join(t["counts"]), "<u4").astype(np.int64), _unpack(_join(t["tokens"])), np.frombuffer(_join(t["dfs"]), "<u2")
        own, back = np.unique(ids, return_inverse=True)
        size, doc = np.bincount(back, sizes, minlength=len(own)).astype(np.int64), np.repeat(back, counts)
        live = np.bincount(doc, minlength=len(own))
        least = np.ceil(tau * size - 1e-9).astype(np.int64)
        cut = (size - least + 1) - (size - live)
        keep = cut > 0
        mine = keep[doc]
        doc, tokens, df = doc[mine], tokens[mine], df[mine]
        begin = np.cumsum(np.where(keep, live, 0)) - np.where(keep, live, 0)
        marks, keys = np.zeros(len(tokens), np.uint8), np.zeros(0, U)
        for k in range(orders):
            order = np.lexsort((kernel.mix(tokens, 100 + k), df, doc))
            rank = np.arange(len(order)) - begin[doc[order]]
            chosen = order[rank < cut[doc[order]]]
            marks[chosen] |= 1 << k
            keys = keys if k else tokens[chosen]
        order = np.lexsort((tokens, doc))
        tokens, marks = tokens[order], marks[order]
        taken = np.where(keep, np.minimum(cut, live), 0)
        ends = np.cumsum(taken)
        rows = []
        for d in np.flatnonzero(keep):
            lo, hi = begin[d], begin[d] + live[d]
            rows.append({"doc_id": int(own[d]), "size": int(size[d]), "tokens": _pack(tokens[lo:hi]), "marks": marks[lo:hi].tobytes(), "keys": keys[ends[d] - taken[d] : ends[d]].astype(np.int64)})
        schema = pa.schema([("doc_id", pa.int64()), ("size", pa.int32()), ("tokens", pa.binary()), ("marks", pa.binary()), ("keys", pa.list_(pa.int64()))])
        return pa.Table.from_pylist(rows, schema)

    return run


class _Cell:
    """The documents of one cell, laid out by min-hash, and their tokens under one index (tokens of a single document left out)."""

    def __init__(self, sizes: np.ndarray, tokens: list[np.ndarray], marks: list[np.ndarray], side: np.ndarray) -> None:
        length = np.array([len(x) for x in tokens], np.int64)
        flat, mark = np.concatenate(tokens), np.concatenate(marks)
        low = np.minimum.reduceat(np.where(mark & 1, kernel.mix(flat, 55), ~U(0)), np.cumsum(length) - length)
        self.order = np.lexsort((sizes, low))
        rank = np.empty(len(sizes), np.int64)
        rank[self.order] = np.arange(len(sizes))
        _, label, times = np.unique(flat, return_inverse=True, return_counts=True)
        several = times > 1
        keep = several[label]
        row = np.repeat(rank, length)[keep]
        label = (np.cumsum(several) - 1)[label[keep]]
        by = np.argsort(row, kind="stable")
        self.row, self.label, self.mark, self.width = row[by], label[by], mark[keep][by], int(several.sum())
        self.first = np.searchsorted(self.row, np.arange(len(sizes) + 1))
        self.sizes, self.side = sizes[self.order], side[self.order]

    def common(self, rows: np.ndarray, cols: np.ndarray, bit: int) -> np.ndarray:
        """Sizes of the intersections of rows' and cols' tokens with a mark in ``bit`` (0: of all tokens)."""
        r = kernel.spans(self.first[rows], self.first[rows + 1] - self.first[rows])
        c = kernel.spans(self.first[cols], self.first[cols + 1] - self.first[cols])
        if bit:
            r, c = r[self.mark[r] & bit > 0], c[self.mark[c] & bit > 0]
        here, there = np.zeros(self.width, bool), np.zeros(self.width, bool)
        here[self.label[r]], there[self.label[c]] = True, True
        both = here & there
        r, c = r[both[self.label[r]]], c[both[self.label[c]]]
        name = np.cumsum(both) - 1
        rl, cl = name[self.label[r]], name[self.label[c]]
        ri, ci = np.searchsorted(rows, self.row[r]), np.searchsorted(cols, self.row[c])
        out = np.zeros((len(rows), len(cols)), np.float32)
        total = int(both.sum())
        if total > WIDTH:
            x, y = np.argsort(rl, kind="stable"), np.argsort(cl, kind="stable")
            rl, ri, cl, ci = rl[x], ri[x], cl[y], ci[y]
        for lo in range(0, total, WIDTH):
            w = min(WIDTH, total - lo)
            x, y = (slice(None), slice(None)) if w == total else (slice(*np.searchsorted(rl, [lo, lo + w])), slice(*np.searchsorted(cl, [lo, lo + w])))
            a, b = np.zeros((len(rows), w), np.float32), np.zeros((len(cols), w), np.float32)
            a[ri[x], rl[x] - lo] = 1
            b[ci[y], cl[y] - lo] = 1
            out += a @ b.T
        return out

    def near(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """Those of cols that share a first-order prefix token with some of rows."""
        marked = self.mark & 1 > 0
        mine = kernel.spans(self.first[rows], self.first[rows + 1] - self.first[rows])
        here = np.zeros(self.width, bool)
        here[self.label[mine[marked[mine]]]] = True
        found = np.zeros(len(self.sizes), bool)
        found[self.row[marked & here[self.label]]] = True
        return cols[found[cols]]


def pairs_in(sizes: np.ndarray, tokens: list[np.ndarray], marks: list[np.ndarray], side: np.ndarray, tau: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of one cell (by place) and their similarities. side: 0 for both blocks the same, else 1 or 2."""
    cell = _Cell(sizes, tokens, marks, side)
    alone = bool((side == 0).all())
    one = np.arange(len(sizes)) if alone else np.flatnonzero(cell.side == 1)
    two = one if alone else np.flatnonzero(cell.side == 2)
    orders = int(max((m.max(initial=0) for m in marks), default=0)).bit_length()
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for lo in range(0, len(one), ROWS):
        rows = one[lo : lo + ROWS]
        cols = cell.near(rows, two[lo:] if alone else two)
        if not len(cols):
            continue
        small, big = np.minimum(cell.sizes[rows][:, None], cell.sizes[cols]), np.maximum(cell.sizes[rows][:, None], cell.sizes[cols])
        mask = small >= tau * big - 1e-9
        if alone:
            mask &= cols > rows[:, None]
        for k in range(orders):
            r, c = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
            rows, cols, mask = rows[r], cols[c], mask[np.ix_(r, c)]
            if not len(r):
                break
            mask &= cell.common(rows, cols, 1 << k) > 0
        r, c = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
        if not len(r):
            continue
        rows, cols = rows[r], cols[c]
        x, y = np.nonzero(mask[np.ix_(r, c)])
        both = cell.common(rows, cols, 0)[x, y].astype(np.float64)
        union = cell.sizes[rows[x]] + cell.sizes[cols[y]] - both
        good = both >= tau * union - 1e-9
        found.append((cell.order[rows[x[good]]], cell.order[cols[y[good]]], both[good] / union[good]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _joined(n: int, x: np.ndarray, y: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id of each node's component."""
    label = ids.copy()
    while True:
        low, new = np.minimum(label[x], label[y]), label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        if (new == label).all():
            return label
        label = new


def _verify(tau: float, links: bool):
    """Cells of one bucket: the pairs, or with ``links`` a row for each document that has some: the smallest id it hangs together with here, and the weight of its partners."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("root", "ascending"), ("i", "ascending"), ("j", "ascending"), ("doc_id", "ascending")])
        cell = np.stack([t[c].to_numpy() for c in ("root", "i", "j")], 1)
        first = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]).any(1)]))
        ids, sizes, side, weight, blocks = (t[c].to_numpy().astype(np.int64) for c in ("doc_id", "size", "side", "weight", "m"))
        out = []
        for a, b in zip(first, np.append(first[1:], len(ids))):
            part = t.slice(a, b - a)
            tokens = [_unpack(x) for x in part["tokens"].to_pylist()]
            marks = [np.frombuffer(x, np.uint8) for x in part["marks"].to_pylist()]
            p, q, s = pairs_in(sizes[a:b], tokens, marks, side[a:b], tau)
            name = ids[a:b]
            if links:
                w = weight[a:b].astype(np.float64)
                times = np.bincount(p, w[q], b - a) + np.bincount(q, w[p], b - a)
                some = np.flatnonzero(times)
                out.append((name[some], _joined(b - a, p, q, name)[some], times[some].astype(np.int64), np.full(len(some), blocks[a] == 1)))
            else:
                out.append((np.minimum(name[p], name[q]), np.maximum(name[p], name[q]), s))
        names, kinds = (("doc_id", "low", "links", "alone"), (pa.int64(), pa.int64(), pa.int64(), pa.bool_())) if links else (("doc_id_a", "doc_id_b", "jaccard"), (pa.int64(), pa.int64(), pa.float64()))
        return pa.table({n: pa.array(np.concatenate(c), k) for n, c, k in zip(names, zip(*out), kinds)})

    return run


def _keys_of(order: int):
    """(doc_id, root, key) of each prefix token under one order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, roots, keys = [], [], [np.zeros(0, np.int64)]
            for i, root, raw, mark in zip(*(c.to_pylist() for c in b.columns)):
                own = _unpack(raw)[np.frombuffer(mark, np.uint8) >> order & 1 == 1].astype(np.int64)
                ids.append(np.full(len(own), i))
                roots.append(np.full(len(own), root))
                keys.append(own)
            whole = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (ids, roots, keys)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in whole], names=["doc_id", "root", "key"])

    return run


def _linked_by(spark: SparkSession, keys: DataFrame, by: list[str]) -> DataFrame:
    """(node, root) of the groups of ``keys(doc_id, by)`` that share a key."""
    least = keys.groupBy(*by).agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    links = keys.join(least, by).where("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    return common.written(spark, common.linked_groups(spark, links), "groups")


def _placed(cut: DataFrame, places: DataFrame) -> DataFrame:
    """Documents' tokens with ``places(node, ...)``: up to ``PLACED_ROWS`` of these are broadcast, so that tokens stay where they are; beyond, both are shuffled."""
    few = places.limit(PLACED_ROWS + 1).count() <= PLACED_ROWS
    return cut.join(F.broadcast(places) if few else places, F.col("doc_id") == F.col("node"))


def _groups(spark: SparkSession, cut: DataFrame, orders: int, block: int) -> DataFrame:
    """(node, root): groups by the first order; those over ``block`` are parted by each other order in turn, which no similar pair can lose by."""
    groups = _linked_by(spark, cut.select("doc_id", F.explode("keys").alias("key")), ["key"])
    for k in range(1, orders):
        large = groups.groupBy("root").count().where(F.col("count") > block).select("root")
        if not large.limit(1).count():
            break
        rows = _placed(cut, groups.join(large, "root", "left_semi")).select("doc_id", "root", "tokens", "marks")
        parted = _linked_by(spark, rows.mapInArrow(_keys_of(k), "doc_id long, root long, key long"), ["root", "key"])
        groups = common.written(spark, groups.join(large, "root", "left_anti").select("node", "root").unionByName(parted), "groups")
    return groups


def _copies(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """(doc_id, lead, n) of the documents whose text occurs more than once; lead is the smallest id."""
    hashed = rows.select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    several = hashed.groupBy("digest").agg(F.min("doc_id").alias("lead"), F.count("*").alias("n")).where("n > 1")
    return common.written(spark, hashed.join(several, "digest").select("doc_id", "lead", "n"), "copies")


def _cells(spark: SparkSession, docs: DataFrame, n: int, tau: float, orders: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(cell, documents with their tokens and places); (doc_id, lead, n) of the copies."""
    buckets = common.bucket_count(spark, docs)
    bits = max(3, (buckets - 1).bit_length())
    rows = common.one_row_per_id(spark, docs).where("text <> ''")
    copies = _copies(spark, rows)
    single = common.without_ids(spark, rows, copies.where("doc_id <> lead").select("doc_id"))
    packed = single.mapInArrow(_spread(bits, n), _PACKED)
    shared = packed.groupBy("bucket").applyInArrow(_count(bits), _PACKED)
    cut = common.written(spark, shared.groupBy("bucket").applyInArrow(_cut(tau, orders), _DOC), "prefixes")
    groups = _groups(spark, cut, orders, block)
    blocks = groups.groupBy("root").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("m"))
    weights = copies.where("doc_id = lead").select(F.col("lead").alias("node"), F.col("n").alias("weight"))
    places = groups.join(blocks, "root").join(weights, "node", "left").select("node", "root", "m", F.coalesce("weight", F.lit(1)).alias("weight"))
    placed = _placed(cut.drop("keys"), places)
    own = F.pmod(F.xxhash64("doc_id"), F.col("m")).cast("int")
    cells = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    cells = cells.select(
        "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "m", "doc_id", "size", "weight", "tokens", "marks",
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
    )
    return cells.withColumn("cell", F.pmod(F.xxhash64("root", "i", "j"), F.lit(4 << bits))), copies


def similar_pairs(spark: SparkSession, docs: DataFrame, n: int = N, tau: float = TAU, orders: int = ORDERS, block: int = BLOCK) -> DataFrame:
    """(doc_id_a, doc_id_b, jaccard) of all pairs of different texts with a similarity of ``tau`` or more, each text by the smallest of its ids; a < b."""
    cells, _ = _cells(spark, docs, n, tau, orders, block)
    return cells.groupBy("cell").applyInArrow(lambda t: _verify(tau, False)(t.drop_columns(["cell"])), "doc_id_a long, doc_id_b long, jaccard double")


def similar_documents(spark: SparkSession, docs: DataFrame, n: int = N, tau: float = TAU, orders: int = ORDERS, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, links) of every document with a link: the smallest id of its class, and how many other documents it is similar to, copies counted.
    A document without a link has no row."""
    cells, copies = _cells(spark, docs, n, tau, orders, block)
    found = common.written(spark, cells.groupBy("cell").applyInArrow(lambda t: _verify(tau, True)(t.drop_columns(["cell"])), _LINKED), "linked")
    lows = found.where("alone").select(F.col("doc_id").alias("node"), F.col("low").alias("root"))
    parted = found.where("not alone and doc_id <> low").select(F.col("doc_id").alias("a"), F.col("low").alias("b"))
    if parted.limit(1).count():  # classes that lie in several cells
        lows = lows.unionByName(common.linked_groups(spark, parted))
    linked = found.groupBy("doc_id").agg(F.sum("links").alias("links")).join(lows, F.col("doc_id") == F.col("node")).select("node", "root", "links")
    leads = copies.select("lead").distinct()
    single = linked.join(leads, F.col("node") == F.col("lead"), "left_anti").select(F.col("node").alias("doc_id"), F.col("root").alias("class_id"), "links")
    several = copies.join(linked, F.col("lead") == F.col("node"), "left").select("doc_id", F.coalesce("root", "lead").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"))
    return single.unionByName(several)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of similar ones, and all documents without a link, with all columns.

    Rows with a null doc_id stay.
    """
    classes = similar_documents(common.tuned(spark), docs)
    gone = common.written(spark, classes.where("doc_id <> class_id").select("doc_id"), "near-copies")
    return common.without_ids(spark, docs, gone)
