"""Personal data by a linear-chain conditional random field over word shapes.

Tokens are runs of characters other than white space, and a sequence is a line. A token's shape has runs of letters as one ``a`` and runs of digits as ``d`` with
their length; noise signs at its end are left out. Features of the shape (its ends, its signs, the lengths of its digit runs, how often letters and digits take
turns, its length) and the classes of both neighbouring tokens score each label, and
a matrix scores label after label. The weights are trained by gradient ascent on the log-likelihood of a small labelled table
(``pii_table``), always from zero and in the same order, so every run has the same model.

Texts are tokenised by numpy over the Arrow buffers. Each distinct token of a slice is looked at once, and each distinct shape scored once. Lines of words only, whose best labelling
is provably all O (a word's lead for O exceeds all that transitions could win), are skipped; all others are decoded exactly by
Viterbi, many lines abreast.

Defined results: a span is a run of tokens of one kind, from the first to the last letter, digit, leading plus or bracket, with offsets in characters. A null or empty
text has no spans. A null doc_id is carried as it is. Rows repeated give their spans again. Two entities of one kind next to each other, with only spaces
between, are one span unless each is whole by itself (all but telephone and spaced card numbers).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandline.llm import common, kernel, pii_table

LABELS = ["O", "CARD", "EMAIL", "IP", "PHONE", "SECRET"]
CLASSES = ["edge", "word", "short", "number", "plus", "area", "dash", "mail", "dots", "hex", "is", "other"]
ROUNDS, RATE, DECAY = 400, 0.2, 1e-3
_OUT = "doc_id long, kind string, start int, end int, value string"
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])
_KIND = np.full(256, 2, np.uint8)  # 0 letter, 1 digit, 2 other, 3 white space
for _c in range(256):
    if _c >= 128 or chr(_c).isalpha():
        _KIND[_c] = 0
    elif chr(_c).isdigit():
        _KIND[_c] = 1
    elif _c in b" \t\r\n\x0b\x0c":
        _KIND[_c] = 3
_NOISE = np.zeros(256, bool)
for _c in b"!$%&*#.,;:\"'|)]}>?":
    _NOISE[_c] = True
_OPEN = b"\"'<[{("


def shape(token: str) -> str:
    """'the.41@mail.example!!' -> 'a.d2@a.a'"""
    token = token.rstrip("!$%&*#.,;:\"'|]}>?").rstrip(")") + (")" if token.rstrip("!$%&*#.,;:\"'|]}>?").endswith(")") and "(" in token else "")
    token = token.lstrip("\"'<[{")
    token = re.sub(r"[^\W\d_]+|[^\x00-\x7f]+", "a", token)
    return re.sub(r"\d+", lambda m: f"d{min(len(m[0]), 20)}", re.sub(r"a+", "a", token))


def class_of(s: str, mixed: bool) -> str:
    digits = sum(int(x) for x in re.findall(r"d(\d+)", s))
    if s in ("", "a"):
        return "word" if s else "other"
    if "@" in s:
        return "mail"
    if mixed:
        return "hex"
    if re.fullmatch(r"d\d+", s):
        return "number" if digits > 3 else "short"
    if s[0] == "+":
        return "plus"
    if re.fullmatch(r"\(d\d+\)?", s):
        return "area"
    if re.fullmatch(r"d\d+(-d\d+)+", s):
        return "dash"
    if re.fullmatch(r"d\d+(\.d\d+)+", s):
        return "dots"
    return "is" if s == "=" else "other"


def shape_features(s: str, length: int) -> tuple[list[str], str]:
    """Features of a shape whose token has so many characters, and its class."""
    runs = [int(x) for x in re.findall(r"d(\d+)", s)]
    flat = re.sub(r"d\d+", "d", s)
    turns = flat.count("ad") + flat.count("da")
    mixed = turns > 4 and length >= 20
    c = class_of(s, mixed)
    signs = "".join(sorted(set(flat) - set("ad")))
    f = ["bias", "class=" + c, f"runs={min(len(runs), 5)}", f"digits={min(sum(runs), 20)}", f"turns={min(turns, 9) // 3}", f"length={min(length, 40) // 8}"]
    f += ["signs=" + signs, "begin=" + flat[:2], "end=" + flat[-3:]] if not mixed else []
    if runs:
        f += [f"longest={max(runs)}", f"shortest={min(runs)}", f"spread={len(runs)},{max(runs) <= 3},{min(runs) == max(runs)}"]
    if not mixed:
        f += ["shape=" + (flat if len(flat) < 12 else "long"), "exact=" + (s if len(s) < 14 else "long")]
    return f, c


def expected(e: np.ndarray, trans: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over sequences laid side by side, e[step, sequence, label], ``on`` telling their steps: the log partition function of each, the
    probability of each label at each step, and the expected number of each label after each other one over all sequences."""
    width = len(e)
    fore, back = np.zeros_like(e), np.zeros_like(e)
    fore[0] = e[0]
    for t in range(1, width):
        z = fore[t - 1][:, :, None] + trans
        top = z.max(1, keepdims=True)
        fore[t] = np.where(on[t][:, None], e[t] + (top + np.log(np.exp(z - top).sum(1, keepdims=True)))[:, 0], fore[t - 1])
    for t in range(width - 2, -1, -1):
        z = trans + (e[t + 1] + back[t + 1])[:, None, :]
        top = z.max(2, keepdims=True)
        back[t] = np.where(on[t + 1][:, None], (top + np.log(np.exp(z - top).sum(2, keepdims=True)))[:, :, 0], 0)
    total = np.log(np.exp(fore[-1] - fore[-1].max(1, keepdims=True)).sum(1)) + fore[-1].max(1)
    single = np.exp(fore + back - total[:, None]) * on[..., None]
    both = on[1:] & on[:-1]
    pair = np.exp(fore[:-1][..., None] + trans + (e[1:] + back[1:])[:, :, None, :] - total[:, None, None]) * both[..., None, None]
    return total, single, pair.sum((0, 1))


class Model:
    """Weights of features and transitions."""

    def __init__(self) -> None:
        data = pii_table.sequences()
        rows = [[shape_features(shape(t), len(t)) for t in tokens] for tokens, _ in data]
        names = sorted({x for r in rows for f, _ in r for x in f})
        self.index = {x: i for i, x in enumerate(names)}
        n, c, k = len(names), len(CLASSES), len(LABELS)
        width, lines = max(map(len, rows)), len(rows)
        x = np.zeros((width, lines, n + 2 * c))
        gold, on = np.zeros((width, lines), int), np.zeros((width, lines), bool)
        for j, (r, (_, labels)) in enumerate(zip(rows, data)):
            for t, (f, _) in enumerate(r):
                x[t, j, [self.index[y] for y in f]] = 1
                before, after = r[t - 1][1] if t else "edge", r[t + 1][1] if t + 1 < len(r) else "edge"
                x[t, j, n + CLASSES.index(before)] = x[t, j, n + c + CLASSES.index(after)] = 1
                gold[t, j], on[t, j] = LABELS.index(labels[t]), True
        flat = x.reshape(-1, x.shape[2])
        truth = np.eye(k)[gold] * on[..., None]
        steps = np.zeros((k, k))
        both = on[1:] & on[:-1]
        np.add.at(steps, (gold[:-1][both], gold[1:][both]), 1)
        w, trans = np.zeros((x.shape[2], k)), np.zeros((k, k))
        m = [np.zeros_like(w), np.zeros_like(trans)]
        v = [np.zeros_like(w), np.zeros_like(trans)]
        for it in range(1, ROUNDS + 1):
            _, single, pair = expected((flat @ w).reshape(width, lines, k), trans, on)
            grads = [flat.T @ (truth - single).reshape(-1, k) - DECAY * w, steps - pair - DECAY * trans]
            for i, (p, g) in enumerate(zip((w, trans), grads)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                p += RATE * (1 - it / (ROUNDS + 1)) * (m[i] / (1 - 0.9**it)) / (np.sqrt(v[i] / (1 - 0.99**it)) + 1e-8)
        self.shape_w, self.before, self.after, self.trans = w[:n], w[n : n + c], w[n + c :], trans
        word = self.score("word")[0]
        word_class = CLASSES.index("word")
        around = [word + b + a for b in self.before[[0, word_class]] for a in self.after[[0, word_class]]]
        lead = min(float(x[0] - x[1:].max()) for x in around)
        gain = float((trans.max() - trans.min()) * 2)
        self.words_are_plain = lead > gain

    def score(self, token: str) -> tuple[np.ndarray, int]:
        """Label scores of the token's own features, and its class; worked out once for each shape and length."""
        return self._of_shape(shape(token), min(len(token), 40))

    @lru_cache(maxsize=1 << 16)
    def _of_shape(self, s: str, length: int) -> tuple[np.ndarray, int]:
        f, c = shape_features(s, length)
        return self.shape_w[[self.index[x] for x in f if x in self.index]].sum(0), CLASSES.index(c)


@lru_cache(maxsize=1)
def model() -> Model:
    return Model()


def viterbi(e: np.ndarray, trans: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Best labels of sequences laid side by side: e[step, sequence, label]; of equal paths the one with the smaller labels."""
    steps, n, k = e.shape
    best, back = e[0].copy(), np.zeros((steps, n, k), np.int8)
    for t in range(1, steps):
        top, arg = best[:, :1] + trans[0], np.zeros((n, k), np.int8)
        for i in range(1, k):
            z = best[:, i : i + 1] + trans[i]
            more = z > top
            top = np.where(more, z, top)
            arg[more] = i
        on = (t < length)[:, None]
        best = np.where(on, top + e[t], best)
        back[t] = np.where(on, arg, np.arange(k, dtype=np.int8))
    out = np.zeros((steps, n), np.int8)
    out[-1] = best.argmax(1)
    rows = np.arange(n)
    for t in range(steps - 1, 0, -1):
        out[t - 1] = back[t, rows, out[t]]
    return out


def _whole(kind: str, raw: str) -> bool:
    return kind in ("EMAIL", "IP", "SECRET") or kind == "CARD" and sum(c.isdigit() for c in raw) >= 13


def find(m: Model, ids: list, texts: pa.Array) -> list[tuple]:
    """(id, kind, start, end, value) of every span in these texts."""
    data, off = kernel.utf8(texts)
    n = len(data)
    if not n:
        return []
    kind = _KIND[data]
    solid = np.zeros(n + 2, np.int8)
    solid[1:-1] = kind != 3
    step = np.diff(solid)
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    cut = np.unique(off[1:-1])
    cut = cut[(cut > 0) & (cut < n)]
    cut = cut[(solid[cut] == 1) & (solid[cut + 1] == 1)]
    begin, end = np.sort(np.concatenate([begin, cut])), np.sort(np.concatenate([end, cut]))
    if not len(begin):
        return []
    # plain tokens: letters, then only noise signs
    letters = np.concatenate([[0], np.cumsum(kind == 0)])
    noise = np.concatenate([[0], np.cumsum(_NOISE[data])])
    first_noise = np.zeros(n + 1, np.int32)
    is_letter = kind == 0
    turns = np.concatenate([[0], np.cumsum(is_letter[1:] & ~is_letter[:-1]), [0]])[:n]  # letters that follow another sign
    again = turns[end - 1] - turns[begin]
    has = letters[end] - letters[begin]
    plain = is_letter[begin] & (again == 0) & (has + noise[end] - noise[begin] == end - begin)
    del letters, noise, first_noise, turns
    fresh = np.concatenate([[0], np.cumsum(data == 10)])
    text = np.searchsorted(off, begin, "right") - 1
    line = fresh[begin] + text  # texts are apart even without a line end
    head = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    length = np.diff(np.append(head, len(begin)))
    odd = ~plain
    todo = np.flatnonzero(np.add.reduceat(odd, head) > 0) if m.words_are_plain else np.arange(len(head))
    if not len(todo):
        return []
    at = kernel.spans(head[todo], length[todo])
    scores, classes = np.empty((len(at), len(LABELS))), np.empty(len(at), np.int64)
    word_score, word_class = m.score("word")
    scores[:], classes[:] = word_score, word_class
    strange = np.flatnonzero(odd[at])
    if len(strange):  # each distinct token once
        lo, hi = begin[at[strange]], end[at[strange]]
        _, one, back = np.unique(kernel.word_hashes(data, lo, hi), return_index=True, return_inverse=True)
        known = [m.score(data[lo[k] : hi[k]].tobytes().decode("utf-8", "replace")) for k in one]
        scores[strange], classes[strange] = np.array([x for x, _ in known])[back], np.array([c for _, c in known])[back]
    size = length[todo]
    starts = np.cumsum(size) - size
    edge = CLASSES.index("edge")
    before, after = np.concatenate([[edge], classes[:-1]]), np.concatenate([classes[1:], [edge]])
    before[starts], after[starts + size - 1] = edge, edge
    scores += m.before[before] + m.after[after]
    labels = np.zeros(len(at), np.int8)
    order = np.argsort(size, kind="stable")
    k = 0
    while k < len(order):
        e = k + 1
        while e < len(order) and e - k < 2048 and size[order[e]] <= 1.3 * size[order[k]] + 4 and (e - k + 1) * size[order[e]] < 200_000:
            e += 1
        group = order[k:e]
        width = int(size[group].max())
        where = np.minimum(starts[group] + np.arange(width)[:, None], len(at) - 1)
        path = viterbi(scores[where], m.trans, size[group])
        valid = np.arange(width)[:, None] < size[group]
        labels[where[valid]] = path[valid]
        k = e
    hits = np.flatnonzero(labels)
    out = []
    chars = None
    k = 0
    while k < len(hits):
        e = k + 1
        kind_name = LABELS[labels[hits[k]]]
        owner = line[at[hits[k]]]
        lo, hi = int(begin[at[hits[k]]]), int(end[at[hits[k]]])
        raw = data[lo:hi].tobytes()
        while e < len(hits) and hits[e] == hits[e - 1] + 1 and labels[hits[e]] == labels[hits[k]] and line[at[hits[e]]] == owner and not _whole(kind_name, raw.decode("utf-8", "replace")):
            hi = int(end[at[hits[e]]])
            raw = data[lo:hi].tobytes()
            e += 1
        k = e
        tail = raw.rstrip(b"!$%&*#.,;:\"'|)]}>?")
        lead = len(tail) - len(tail.lstrip(_OPEN if kind_name != "PHONE" else _OPEN[:-1]))
        if kind_name == "SECRET" and b"=" in tail:
            lead = tail.rindex(b"=") + 1
            lead += len(tail[lead:]) - len(tail[lead:].lstrip(_OPEN))
        value = tail[lead:].decode("utf-8", "replace")
        if not value:
            continue
        if chars is None:
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        t = int(np.searchsorted(off, lo, "right") - 1)
        start = int(chars[lo + lead] - chars[off[t]])
        out.append((ids[t], kind_name, start, start + len(value), value))
    return out


def personal_data(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end, value) of every span of personal data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model()
        for whole in batches:
            for batch in kernel.slices(whole):
                rows = find(m, batch.column(0).to_pylist(), batch.column(1))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_OUT_ARROW)], schema=_OUT_ARROW)

    return common.id_text(docs).where("text is not null").mapInArrow(run, _OUT)
