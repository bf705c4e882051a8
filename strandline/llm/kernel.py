"""Byte-level numpy kernels over Arrow string columns: word bounds, 64-bit word and window hashes.

Everything works on the UTF-8 buffers themselves, a slice of a few MB at a time, so the temporary arrays stay in cache
and a worker's memory doesn't depend on the batch Spark sends. A single text longer than a slice is one slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE, BASE_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
SLICE = 1 << 21
_WORD = np.zeros(256, bool)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _WORD[_c] = True
_WORD[128:] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown by doubling."""
    have = _powers.get(base)
    if have is None:
        have = np.ones(1, U)
    while len(have) < n:
        have = np.concatenate([have, have * U(pow(base, len(have), 1 << 64))])
    _powers[base] = have
    return have[:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """splitmix64's finaliser: a bijection of 64-bit values."""
    x = x + U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string array; a null counts as an empty text here."""
    if not pa.types.is_large_string(arr.type):
        arr = arr.cast(pa.large_string())
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8)[off[0] : off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` bytes of text, each row whole."""
    arr = batch.column(batch.schema.get_field_index(column))
    _, off = utf8(arr)
    i, n = 0, len(arr)
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


_NEAR = 64
_table: list[np.ndarray] = []


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for each pair of bounds, none empty: the sum of a random number for each (place, byte).

    A polynomial modulo 2**64 would do with fewer steps, but gives words that follow certain patterns one and the same value."""
    if not len(start):
        return np.zeros(0, U)
    if not _table:
        _table.append(mix(np.arange(_NEAR << 8, dtype=U), 21))
    length = (end - start).astype(np.int32)
    lead = np.cumsum(length, dtype=np.int64) - length
    if len(data) >= 1 << 30:
        start, lead = start.astype(np.int64), lead.astype(np.int64)
    else:
        start, lead = start.astype(np.int32), lead.astype(np.int32)
    at = np.arange(int(lead[-1]) + int(length[-1]), dtype=lead.dtype)
    place = at - np.repeat(lead, length)
    key = data[at + np.repeat(start - lead, length)] | place.astype(np.int64 if length.max() >= 1 << 22 else np.int32) << 8
    if length.max() <= _NEAR:
        each = _table[0][key]
    else:
        each = _table[0][np.minimum(place, _NEAR - 1) << 8 | key & 255]
        far = np.flatnonzero(place >= _NEAR)
        each[far] = mix(key[far].astype(U), 21)
    return mix(np.add.reduceat(each, lead) + length.astype(U))


class Words:
    """Words (runs of letters and digits, lower-cased) of some texts.

    data: lower-cased bytes; start, end: byte bounds of each word; first: index of each text's first word, with the total at the end;
    h: 64-bit hash of each word.
    """

    __slots__ = ("data", "start", "end", "first", "h")

    def __init__(self, arr: pa.Array) -> None:
        self.data, off = utf8(pc.utf8_lower(arr))
        n = len(self.data)
        flag = np.zeros(n + 2, np.int8)
        flag[1:-1] = _WORD[self.data]
        step = np.diff(flag)
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        cut = off[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        if len(cut):  # a word never runs over the end of its text
            cut = np.unique(cut)
            inside = cut[(flag[cut] == 1) & (flag[cut + 1] == 1)]
            if len(inside):
                start, end = np.sort(np.concatenate([start, inside])), np.sort(np.concatenate([end, inside]))
        self.start, self.end = start, end
        self.first = np.searchsorted(start, off)
        self.h = word_hashes(self.data, start, end)

    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def texts(self, i: int) -> list[bytes]:
        """The words of text i themselves."""
        lo, hi = self.first[i], self.first[i + 1]
        if lo == hi:
            return []
        base = int(self.start[lo])
        raw = self.data[base : int(self.end[hi - 1])].tobytes()
        return [raw[a:b] for a, b in zip((self.start[lo:hi] - base).tolist(), (self.end[lo:hi] - base).tolist())]


def windows(h: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hash of h[i:i+k] for each i; len(h)-k+1 values (none if h is shorter)."""
    n = len(h)
    if n < k:
        return np.zeros(0, U)
    sums = np.zeros(n + 1, U)
    np.cumsum(h * powers(BASE, n), out=sums[1:])
    return mix((sums[k:] - sums[: n - k + 1]) * powers(BASE_INV, n - k + 1), seed)


def inside(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Window starts that lie within one text, and the text of each."""
    per = np.maximum(np.diff(first) - k + 1, 0)
    doc = np.repeat(np.arange(len(per)), per)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per) + np.repeat(first[:-1], per)
    return at, doc


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i:i+w] for each i, by doubling."""
    size, out = 1, x
    while size * 2 <= w:
        out = np.minimum(out[: len(out) - size], out[size:])
        size *= 2
    return np.minimum(out[: len(x) - w + 1], out[w - size : w - size + len(x) - w + 1]) if size < w else out


def spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All positions start[i] .. start[i]+length[i]-1, one run after another."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) - np.repeat(np.cumsum(length) - length, length) + np.repeat(start, length)
