import math
from collections import Counter

import pyarrow as pa
import pytest
import sentencepiece
from strandline.llm import pieces as p


@pytest.fixture(scope="module")
def v():
    return p.vocabulary(p.MODEL)


def encode(v, keys, texts, alpha=p.ALPHA, seed=p.SEED):
    return p.encode_rows(v, pa.array(keys, pa.int64()), pa.array(texts, pa.string()), alpha, seed)


ODD = ["", None, " ", "   ", "a  b\n c ▁x", "héllo wörld 你好 😀\t\r\n  ", "\x00\x01", "a" * 3000, "▁", " ▁ ", "x" * 5 + " " * 40 + "y", "\n\n"]


def test_round_trip(v):
    r = encode(v, list(range(len(ODD))), ODD)
    assert r.column("decoded").to_pylist() == ODD
    assert r.column("ids").to_pylist()[:2] == [[], None] and r.column("n_ids").to_pylist()[:2] == [0, None]


def test_the_library_decodes_the_same(v):
    sp = sentencepiece.SentencePieceProcessor(model_file=p.MODEL)
    for t in ("This is a test.", "Ein Versuch, größer", "two\nlines"):
        assert sp.decode(encode(v, [1], [t]).column("ids").to_pylist()[0]) == t


@pytest.mark.parametrize("alpha", [0.1, 0.3, 1.0])
@pytest.mark.parametrize("word", ["then", "schön"])
def test_distribution(v, word, alpha):
    """Segmentations come as often as enumerating the lattice says."""
    raw = b" " + word.encode()
    byte_ids = set(v.byte_id.tolist())
    ids = {b: i for i, b in enumerate(v.bytes_of) if i not in byte_ids and math.isfinite(v.weight[i])}

    def all_from(at):
        if at == len(raw):
            yield ()
        for to in range(at + 1, len(raw) + 1):
            if raw[at:to] in ids:
                for rest in all_from(to):
                    yield (ids[raw[at:to]], *rest)

    weight = {s: math.exp(alpha * sum(v.weight[i] for i in s)) for s in all_from(0)}
    total, n = sum(weight.values()), 20_000
    seen = Counter(map(tuple, encode(v, list(range(n)), [word] * n, alpha).column("ids").to_pylist()))
    assert set(seen) <= set(weight)
    assert all(abs(seen[s] / n - w / total) < 4 * math.sqrt(w / total / n) + 1e-4 for s, w in weight.items())


def test_row_key_decides(v):
    texts = ["the quick brown fox jumps over the lazy dog again and again"] * 3 + ["other words here"]
    a = encode(v, [1, 2, 1, 4], texts).column("ids").to_pylist()
    assert a[0] == a[2] != a[1]
    for k, t, want in zip([1, 2, 1, 4], texts, a):  # neighbours and batches don't matter
        assert encode(v, [k], [t]).column("ids").to_pylist()[0] == want
    assert encode(v, [1], texts[:1], seed=9).column("ids").to_pylist()[0] != a[0]


def test_query_on_odd_rows(spark, table, odd_rows):
    got = p.sampled_pieces(spark, table(odd_rows, clash=True)).collect()
    assert sorted((str(r["doc_id"]), str(r["decoded"])) for r in got) == sorted((str(i), str(t)) for i, t in odd_rows)
    assert all((r["ids"] is None) == (r["decoded"] is None) for r in got)
    again = {(r["doc_id"], r["decoded"]): r["ids"] for r in p.sampled_pieces(spark, table(odd_rows).repartition(7)).collect()}
    assert all(again[r["doc_id"], r["decoded"]] == r["ids"] for r in got)


def test_empty(spark, table):
    assert p.sampled_pieces(spark, table([])).count() == 0
