"""SentencePiece encoding and decoding with sampled segmentations.

The lattice of a text has a node at each byte position and an edge for each vocabulary piece that fits there. Forward filtering sums, for each node,
the weights of all segmentations of what lies before it; backward sampling walks from the end and picks each piece with exactly its share
of that sum. So a segmentation comes out with probability proportional to the product of its pieces' weights (raised to ``alpha``).
The random numbers are a hash of (seed, row key, word index, step), so a row's segmentation never depends on its neighbours,
batches or partitions.

No piece runs over the start of a run of spaces (checked when the vocabulary is read), so a text's lattice falls into independent words, and the
forward pass is done once for each distinct word of a slice, for all words abreast. A BPE model's scores are ranks; rank r
is given Zipf's log weight -log(r + 3). A unigram model's scores are taken as they are.

Decoding is lossless: a space prefixed to each text as the model's own encoder does is taken off again, characters outside the vocabulary are spelled in
byte pieces, and so is U+2581, which a piece would turn into a space.

Defined results: a null text has null pieces and decodes to null; an empty one has no pieces and decodes to the empty text. A null
doc_id is a row key of its own. Rows repeated with key and text get the same segmentation.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from strandline.llm import common, kernel
from strandline.llm.kernel import U

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA, SEED = 0.3, 2024
#: Bytes of text whose lattices are held at once; a lattice takes some 60 bytes for each byte of its distinct words.
LATTICE_BYTES = 1 << 19
_OUT = "doc_id long, ids array<int>, n_ids int, decoded string"
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_ids", pa.int32()), ("decoded", pa.string())])


class Vocabulary:
    """Pieces as bytes (spaces for U+2581) in a hashed trie, their log weights, and the byte pieces."""

    def __init__(self, path: str) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_id = np.full(256, -1, np.int32)
        weight = np.full(n, -np.inf)
        scores = np.array([sp.get_score(i) for i in range(n)])
        usual = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        real = scores[usual][scores[usual] > -1e8]  # a BPE model gives -1e9 to pieces it never merges
        ranks = len(real) > 1 and len(np.unique(real)) == len(real) and (real == np.rint(real)).all()
        scores = np.maximum(scores, real.min() - 1 if len(real) else -1.0)
        for i in range(n):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_id[b], self.bytes_of[i] = i, bytes([b])
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces, so decoding could lose characters")
        for i in usual:
            piece = sp.id_to_piece(i)
            if "▁" in piece.lstrip("▁"):
                raise ValueError(f"piece {i} has a space after other characters")
            self.bytes_of[i] = piece.replace("▁", " ").encode()
            weight[i] = -np.log(-scores[i] + 3) if ranks else scores[i]
        weight[usual] -= np.log(np.exp(weight[usual]).sum())
        weight[self.byte_id] = weight[usual].min() - 5
        self.weight = weight
        node: dict[tuple[int, int], int] = {}
        final = [-1]
        for i in usual:
            at = 0
            for b in self.bytes_of[i]:
                nxt = node.get((at, b))
                if nxt is None:
                    nxt = node[at, b] = len(final)
                    final.append(-1)
                at = nxt
            final[at] = i
        self.final = np.array(final, np.int32)
        self.depth = max(len(self.bytes_of[i]) for i in usual)
        bits = max(10, (4 * len(node)).bit_length())
        self.mask = (1 << bits) - 1
        self.slot_key, self.slot_node = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        for (at, b), nxt in node.items():
            key = at << 8 | b
            s = self._slot(np.array([key]))[0]
            while self.slot_key[s] >= 0:
                s = (s + 1) & self.mask
            self.slot_key[s], self.slot_node[s] = key, nxt
        length = np.array([len(x) for x in self.bytes_of], np.int64)
        self.length, self.offset, self.blob = length, np.cumsum(length) - length, np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(U) * U(0x9E3779B97F4A7C15)) >> U(40)).astype(np.int64) & self.mask

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Trie node after ``byte``, or -1."""
        key = node.astype(np.int64) << 8 | byte
        slot, out = self._slot(key), np.full(len(key), -1, np.int32)
        todo = np.arange(len(key))
        while len(todo):
            there = self.slot_key[slot]
            hit = there == key
            out[todo[hit]] = self.slot_node[slot[hit]]
            on = (there >= 0) & ~hit
            todo, key, slot = todo[on], key[on], (slot[on] + 1) & self.mask
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _with_prefix(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A space before each text that isn't empty."""
    size = np.diff(off)
    some = size > 0
    new = np.concatenate([[0], np.cumsum(size + some)])
    out = np.full(new[-1], 32, np.uint8)
    keep = np.ones(new[-1], bool)
    keep[new[:-1][some]] = False
    out[keep] = data
    return out, new


class Lattice:
    """Forward-filtered lattices of distinct words, laid end to end (a word of n bytes has n + 1 nodes)."""

    def __init__(self, v: Vocabulary, data: np.ndarray, start: np.ndarray, length: np.ndarray, alpha: float) -> None:
        self.base = np.cumsum(length + 1) - (length + 1)
        total = int((length + 1).sum())
        line = np.zeros(total, np.uint8)
        at = kernel.spans(self.base, length)
        line[at] = data[kernel.spans(start, length)]
        end = np.repeat((self.base + length).astype(np.int32), length + 1)
        begins, ends, pieces = [], [], []
        whole = np.zeros(total, bool)  # characters that are pieces themselves
        lead = line & 0xC0
        char = np.where(line < 0x80, 1, np.where(line >= 0xF0, 4, np.where(line >= 0xE0, 3, np.where(lead == 0xC0, 2, 0)))).astype(np.int8)
        first = at[char[at] > 0].astype(np.int32)
        here, node = first, np.zeros(len(first), np.int32)
        for k in range(1, v.depth + 1):
            node = v.step(node, line[here + k - 1])
            on = node >= 0
            here, node = here[on], node[on]
            found = v.final[node] >= 0
            begins.append(here[found])
            ends.append(here[found] + np.int32(k))
            pieces.append(v.final[node[found]])
            whole[here[found & (char[here] == k)]] = True
            more = here + k < end[here]
            here, node = here[more], node[more]
            if not len(here):
                break
        spelled = first[~whole[first]]
        spelled = kernel.spans(spelled, np.minimum(char[spelled], end[spelled] - spelled).astype(np.int64)).astype(np.int32)
        begins.append(spelled)
        ends.append(spelled + np.int32(1))
        pieces.append(v.byte_id[line[spelled]])
        begin, stop, piece = np.concatenate(begins), np.concatenate(ends), np.concatenate(pieces)
        del begins, ends, pieces, whole, char, end, line, lead, at
        offset = stop - np.repeat(self.base.astype(np.int32), length + 1)[stop]
        order = np.argsort((offset.astype(np.int64) * total + stop) * v.depth + (stop - begin) - 1)
        self.begin, self.piece, stop, offset = begin[order], piece[order], stop[order], offset[order]
        head = np.flatnonzero(np.concatenate([[True], stop[1:] != stop[:-1]])) if len(stop) else np.zeros(0, np.int64)
        self.first = np.zeros(total, np.int32)
        self.first[stop[head]] = head
        fan = np.diff(np.append(head, len(stop)))
        score = np.full(total, -np.inf)
        score[self.base] = 0.0
        self.upto = np.zeros(len(stop))
        weight_of = alpha * v.weight
        step_at = offset[head]
        cuts = np.flatnonzero(np.concatenate([[True], step_at[1:] != step_at[:-1]])) if len(head) else np.zeros(0, np.int64)
        for lo, hi in zip(cuts, np.append(cuts[1:], len(head))):
            e, n, to = head[lo:hi], fan[lo:hi], stop[head[lo:hi]]
            edge = slice(e[0], e[-1] + n[-1])
            x = score[self.begin[edge]] + weight_of[self.piece[edge]]
            local = e - e[0]
            peak = np.maximum.reduceat(x, local)
            peak = np.where(np.isfinite(peak), peak, 0.0)
            p = np.exp(x - np.repeat(peak, n))
            sums, live, r = np.zeros(len(e)), np.arange(len(e)), 0
            while len(live):
                k = local[live] + r
                sums[live] += p[k]
                p[k] = sums[live]
                r += 1
                live = live[n[live] > r]
            with np.errstate(divide="ignore"):
                score[to] = np.where(sums > 0, peak + np.log(sums), -np.inf)
            self.upto[edge] = p / np.repeat(np.where(sums > 0, sums, 1.0), n)


def sample(v: Vocabulary, data: np.ndarray, off: np.ndarray, keys: np.ndarray, alpha: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(piece ids of all texts, number of each text) for texts that have their prefix."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(off) - 1, np.int64)
    space = data == 32
    start = np.zeros(n, bool)
    start[1:] = space[1:] & ~space[:-1]
    start[off[:-1][np.diff(off) > 0]] = True
    begin = np.flatnonzero(start)
    length = np.diff(np.append(begin, n))
    sums = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * kernel.powers(kernel.BASE, n), out=sums[1:])
    h = kernel.mix((sums[begin + length] - sums[begin]) * kernel.powers(kernel.BASE_INV, n)[begin] ^ kernel.mix(length.astype(U), 3))
    _, where, word = np.unique(h, return_index=True, return_inverse=True)
    order = np.argsort(length[where], kind="stable")  # neighbours of like length; the choice of words stays the same
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    where, word = where[order], back[word]
    lattice = Lattice(v, data, begin[where], length[where], alpha)
    text = np.searchsorted(off, begin, "right") - 1
    nth = np.arange(len(begin)) - np.searchsorted(begin, off[:-1])[text]
    state = kernel.mix(kernel.mix(keys.view(U), seed)[text] ^ kernel.mix(nth.astype(U), 21), 22)
    out = np.full(n, -1, np.int32)
    live, base = np.arange(len(begin)), lattice.base[word]
    at, step = base + length, 0
    while len(live):
        r = (kernel.mix(state[live], 1000 + step) >> U(11)).astype(np.float64) * 2.0**-53
        edge = lattice.first[at[live]]
        low = np.flatnonzero(lattice.upto[edge] <= r)
        while len(low):
            edge[low] += 1
            low = low[lattice.upto[edge[low]] <= r[low]]
        at[live] = lattice.begin[edge]
        out[begin[live] + at[live] - base[live]] = lattice.piece[edge]
        live = live[at[live] > base[live]]
        step += 1
    taken = out >= 0
    count = np.concatenate([[0], np.cumsum(taken)])
    return out[taken], np.diff(count[off])


def decode(v: Vocabulary, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts whose pieces these are, without their prefix."""
    length = v.length[ids]
    data = v.blob[kernel.spans(v.offset[ids], length)]
    size = np.concatenate([[0], np.cumsum(length)])
    off = size[np.concatenate([[0], np.cumsum(count)])]
    some = np.diff(off) > 0
    keep = np.ones(len(data), bool)
    keep[off[:-1][some]] = False
    return data[keep], np.concatenate([[0], np.cumsum(np.diff(off) - some)])


def encode_rows(v: Vocabulary, keys: pa.Array, texts: pa.Array, alpha: float, seed: int) -> pa.RecordBatch:
    data, off = kernel.utf8(texts)
    gone = texts.is_null().to_numpy(zero_copy_only=False)
    key = keys.fill_null(-(1 << 62)).to_numpy(zero_copy_only=False).astype(np.int64)
    ids, count = sample(v, *_with_prefix(data, off), key, alpha, seed)
    back, back_off = decode(v, ids, count)
    bounds = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids, pa.int32()), mask=pa.array(gone))
    bits = pa.array(~gone).buffers()[1] if len(gone) else None
    text = pa.StringArray.from_buffers(len(gone), pa.py_buffer(back_off.astype(np.int32).tobytes()), pa.py_buffer(back.tobytes()), bits)
    return pa.RecordBatch.from_arrays([keys, lists, pa.array(count.astype(np.int32), mask=gone), text], schema=_OUT_ARROW)


def sampled_pieces(spark: SparkSession, docs: DataFrame, model: str = MODEL, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """(doc_id, ids, n_ids, decoded) of every row: a sampled segmentation, and the text that its pieces decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for whole in batches:
            for batch in kernel.slices(whole, limit=LATTICE_BYTES):
                yield encode_rows(v, batch.column(0), batch.column(1), alpha, seed)

    return common.id_text(docs).mapInArrow(run, _OUT)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, as the pipeline's last stage."""
    return sampled_pieces(common.tuned(spark), docs)
