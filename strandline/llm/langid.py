"""Language identification by prediction by partial matching.

Each language has a byte context tree of orders 0 to 3, trained once and then frozen. A byte is coded in the longest
context the tree knows, and costs an escape for each order it has to leave (escape method C: a context seen n times with
q different successors gives c/(n+q) to a successor seen c times and q/(n+q) to the escape); below order 0 every byte costs
8 bits. A text's code length under a language is the sum over all its bytes, and the shortest names the language.

Because the statistics are frozen, the cost of a byte depends on the three bytes before it only. The trees of all languages
are laid over one automaton of contexts, and a text is scored by table lookups over its whole byte buffer. Costs are integers of
1/1024 bit, so sums are exact whatever the batching.

Defined results: a null or empty text has no language (null) and is rejected. Equal code lengths go to the language whose name
sorts first. A text is rejected too when its best code spends more than ``MAX_BITS`` a byte, as bytes of no known language do.
Repeated rows are scored alike. With no labelled text at all, nothing is identified and all is rejected. Rows keep their columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm import common, kernel

ORDER = 3
#: Training rows of each language, taken by the smallest hash of doc_id. The bound that keeps the trees of a fixed size.
TRAIN_ROWS = 150
#: Bits a byte above which a text is in no known language; prose is coded with 2 to 4, random bytes with over 8.
MAX_BITS = 7.0
UNIT = 1024
_RESULT = "struct<lang:string,bits:double,bits_per_byte:double,accepted:boolean>"


@dataclass
class Trees:
    """Frozen trees of all languages over one automaton."""

    langs: list[str]
    symbol: np.ndarray  # byte -> symbol; the last symbol stands for bytes never seen and between texts
    state: np.ndarray  # three last symbols -> state
    cost: np.ndarray  # [language][state * symbols + symbol], in 1/1024 bit


def train(samples: dict[str, list[str]], order: int = ORDER) -> Trees:
    """Trees from texts by language."""
    langs = sorted(k for k, v in samples.items() if any(v))
    raw = {k: [np.frombuffer(t.lower().encode(), np.uint8) for t in samples[k] if t] for k in langs}
    seen = np.zeros(256, bool)
    for texts in raw.values():
        for t in texts:
            seen[t] = True
    a = int(seen.sum()) + 1
    symbol = np.full(256, a - 1, np.uint8)
    symbol[seen] = np.arange(a - 1)
    grams: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
    for k in langs:
        sep = np.full(1, a - 1, np.int64)
        line = np.concatenate([x for t in raw[k] for x in (symbol[t].astype(np.int64), sep)])
        for n in range(1, order + 2):
            code, whole = np.zeros(len(line) - n + 1, np.int64), np.ones(len(line) - n + 1, bool)
            for j in range(n):
                part = line[j : len(line) - n + 1 + j]
                code, whole = code * a + part, whole & (part < a - 1)
            grams[k, n] = np.unique(code[whole], return_counts=True)
    contexts = [np.zeros(1, np.int64)]
    for n in range(1, order + 1):
        contexts.append(np.unique(np.concatenate([grams[k, n + 1][0] // a for k in langs] or [np.zeros(0, np.int64)])))
        own = [g for k in langs for g in [grams[k, n][0]]]
        if n < order and own:  # every suffix and prefix of a context is one
            contexts[-1] = np.unique(np.concatenate([contexts[-1], *own]))
    base = np.cumsum([0, *map(len, contexts)])
    cost = np.full((len(langs), base[-1], a), 8.0)
    go = np.zeros((base[-1], a), np.int64)
    for n, ctx in enumerate(contexts):
        rows = slice(base[n], base[n + 1])
        back = base[n - 1] + np.searchsorted(contexts[n - 1], ctx % a ** (n - 1)) if n else None
        for i, k in enumerate(langs):
            if n:
                cost[i, rows] = cost[i, back]
            code, count = grams[k, n + 1]
            if not len(code):
                continue
            own, where, q = np.unique(code // a, return_index=True, return_counts=True)
            total = np.add.reduceat(count, where)
            at = base[n] + np.searchsorted(ctx, own)
            cost[i, at] += np.log2((total + q) / q)[:, None]
            cost[i, np.repeat(at, q), code % a] = np.log2(np.repeat(total + q, q) / count)
        if n:
            go[rows] = go[back]
        if n < order:
            nxt = contexts[n + 1]
            if len(nxt):
                src = np.searchsorted(ctx, nxt // a)
                good = (src < len(ctx)) & (ctx[np.minimum(src, len(ctx) - 1)] == nxt // a)
                go[base[n] + src[good], nxt[good] % a] = base[n + 1] + np.flatnonzero(good)
    state = np.zeros(1, np.int64)
    for _ in range(order):
        state = go[state].reshape(-1)
    fixed = np.rint(cost * UNIT).astype(np.int32).reshape(len(langs), base[-1] * a)
    return Trees(langs, symbol, (state * a).astype(np.int32), fixed)


def code_lengths(trees: Trees, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(1/1024 bits as int64 [language, text], bytes of each lower-cased text)."""
    data, off = kernel.utf8(pc.utf8_lower(texts))
    size, n, a = np.diff(off), len(off) - 1, trees.cost.shape[1] // 1
    symbols = int(trees.symbol.max()) + 1
    a = symbols
    at = off[:-1] + 1 + np.arange(n)  # one separator before each text
    line = np.full(len(data) + n + ORDER, a - 1, np.int32)
    keep = np.ones(len(line), bool)
    keep[at - 1], keep[len(data) + n :] = False, False
    line[keep] = trees.symbol[data]
    code = np.full(len(line), a - 1, np.int32)
    prev = np.concatenate([np.full(ORDER, a - 1, np.int32), line])
    code = (prev[: len(line)] * np.int32(a) + prev[1 : len(line) + 1]) * np.int32(a) + prev[2 : len(line) + 2]
    index = trees.state[code] + line
    out = np.zeros((len(trees.langs), n), np.int64)
    full = size > 0
    if full.any():
        bounds = np.stack([at[full], at[full] + size[full]], 1).reshape(-1)
        for i in range(len(trees.langs)):
            out[i, full] = np.add.reduceat(trees.cost[i][index], bounds, dtype=np.int64)[::2]
    return out, size


def identify(trees: Trees, texts: pa.Array, max_bits: float = MAX_BITS) -> pa.StructArray:
    """Language, code length, bits a byte and acceptance of each text."""
    n = len(texts)
    names, bits, rate, good = [], np.zeros(n), np.zeros(n), np.zeros(n, bool)
    if trees.langs and n:
        cost, size = code_lengths(trees, texts)
        best = cost.argmin(0)
        bits = cost[best, np.arange(n)] / UNIT
        has = size > 0
        rate = np.divide(bits, size, out=np.zeros(n), where=has)
        good = has & (rate <= max_bits)
        names = [trees.langs[b] if h else None for b, h in zip(best, has)]
    else:
        has, names = np.zeros(n, bool), [None] * n
    return pa.StructArray.from_arrays(
        [pa.array(names, pa.string()), pa.array(bits, mask=~has), pa.array(rate, mask=~has), pa.array(good)],
        names=["lang", "bits", "bits_per_byte", "accepted"],
    )


def labelled_sample(docs: DataFrame, rows: int = TRAIN_ROWS) -> dict[str, list[str]]:
    """Whole texts of at most ``rows`` documents of each language, those whose doc_id hashes lowest."""
    known = docs.select(docs["doc_id"].cast("long").alias("i"), docs["lang"].cast("string").alias("l")).where("l is not null and i is not null")
    order = Window.partitionBy("l").orderBy(F.xxhash64("i"), "i")
    chosen = known.withColumn("r", F.row_number().over(order)).where(F.col("r") <= rows).select("i", "l").distinct()
    pairs = docs.select(docs["doc_id"].cast("long").alias("i"), docs["lang"].cast("string").alias("l"), docs["text"].cast("string").alias("t"))
    found: dict[str, list[str]] = {}
    for r in pairs.join(F.broadcast(chosen), ["i", "l"], "left_semi").orderBy("l", F.xxhash64("i"), "i", "t").collect():
        found.setdefault(r["l"], []).append(r["t"] or "")
    return found


def scorer(spark: SparkSession, trees: Trees, max_bits: float = MAX_BITS):
    """Column function text -> struct(lang, bits, bits_per_byte, accepted); the trees have a fixed size, so they are broadcast."""
    shared = spark.sparkContext.broadcast(trees)

    @F.arrow_udf(_RESULT)
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in texts:
            parts = [identify(shared.value, b.column(0), max_bits) for b in kernel.slices(pa.record_batch([arr], names=["text"]))]
            yield pa.concat_arrays(parts) if parts else identify(shared.value, arr, max_bits)

    return score


def language_id(spark: SparkSession, docs: DataFrame, rows: int = TRAIN_ROWS, max_bits: float = MAX_BITS) -> DataFrame:
    """(doc_id, lang, bits, bits_per_byte, accepted) of every row; trained on the labelled rows' ``lang``."""
    score = scorer(common.tuned(spark), train(labelled_sample(docs, rows)), max_bits)
    return common.id_text(docs).select("doc_id", score("text").alias("r")).select("doc_id", "r.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text is in a known language, with all their columns."""
    score = scorer(common.tuned(spark), train(labelled_sample(docs)))
    return docs.where(score(docs["text"].cast("string"))["accepted"])
