import random
import re

import pyarrow as pa
import pytest
from strandline.llm import decontamination as d
from strandline.llm import kernel


def split(text):
    return re.findall(r"[0-9a-z\x80-\U0010FFFF]+", (text or "").lower())


def brute(docs, items, least=d.MIN_WORDS):
    """All maximal equal word runs of ``least`` words."""
    out = []
    for i, text in docs:
        a = split(text)
        for k, item in items:
            b = split(item)
            for off in range(-len(b) + 1, len(a)):
                run = 0
                for x in range(max(0, off), min(len(a), len(b) + off) + 1):
                    same = x < min(len(a), len(b) + off) and a[x] == b[x - off]
                    if same:
                        run += 1
                    else:
                        if run >= least:
                            out.append((i, k, x - run, x - run - off, run))
                        run = 0
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 40)))) for k in range(12)] + [(50, None), (51, ""), (52, "a b c d e")]
    items.append((60, items[0][1]))
    docs = []
    for i in range(98):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
        if i % 2:
            src = split(items[rng.randrange(12)][1])
            lo = rng.randrange(len(src))
            at = rng.randint(0, len(w))
            w[at:at] = src[lo : lo + rng.randint(1, 30)]
        docs.append((i, ", ".join(w).title()))
    docs += [(100, None), (101, ""), (3, docs[3][1]), (None, items[1][1]), (102, (items[2][1] + " ") * 3), (103, "lorem " * 20_000 + items[3][1])]
    return docs, items


def rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "item_id", "doc_start", "item_start", "words")) for r in df.collect()), key=str)


@pytest.mark.parametrize("small", [d.SMALL_BYTES, 0])
def test_every_long_span_is_found(spark, table, case, small):
    docs, items = case
    test = spark.createDataFrame(items, "item_id long, text string")
    got = rows(d.contaminated_spans(spark, table(docs, clash=True), test, small_bytes=small))
    want = brute([x for x in docs if x[0] != 103], items) + brute([(103, "lorem lorem " + items[3][1])], [items[3]])
    want = [(i, k, s + 19_998 if i == 103 else s, t, n) for i, k, s, t, n in want]
    # items under GUARANTEE words aren't guaranteed, so they are only held to be right
    assert set(got) <= set(want)
    sure = {k for k, t in items if len(split(t)) >= d.GUARANTEE}
    assert [g for g in got if g[1] in sure] == sorted((w for w in want if w[1] in sure), key=str) and len(got) > 12


def test_winnowing_keeps_a_gram_of_every_window():
    w = kernel.Words(pa.array(["a b c d e f g h i j k l m n o p q r s t u v w x y z", "p q r s t u v w"]))
    h, at, doc = d.fingerprints(w)
    for text in (0, 1):
        places = sorted(at[doc == text] - w.first[text])
        last = w.count()[text] - d.K
        assert all(any(lo <= p <= lo + d.W - 1 for p in places) for lo in range(last - d.W + 2))


def test_stage(spark, table, case, tmp_path):
    docs, items = case
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = table(docs, clash=True)
    out = d.stage(spark, df, str(tmp_path))
    assert out.columns == df.columns
    dirty = {t for i, t in docs if brute([(i, t if i != 103 else "x " + items[3][1])], [x for x in items if len(split(x[1])) >= d.GUARANTEE])}
    assert sorted(map(str, [r["text"] for r in out.collect()])) == sorted(map(str, [t for _, t in docs if t not in dirty]))


def test_empty(spark, table, case):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.contaminated_spans(spark, table([]), none).count() == 0
    assert d.contaminated_spans(spark, table(case[0]), none).count() == 0


def test_words_of_a_periodic_pattern(spark, table):
    """Words that follow the Thue-Morse sequence and its complement, of one hash under polynomials modulo 2**64."""
    t = "a"
    while len(t) < 1024:
        t += t.translate(str.maketrans("ab", "ba"))
    u = t.translate(str.maketrans("ab", "ba"))
    line = "one two three four {} five six seven eight nine"
    test = spark.createDataFrame([(1, line.format(t))], "item_id long, text string")
    got = d.contaminated_spans(spark, table([(1, line.format(u)), (2, line.format(t))]), test).collect()
    assert [(r["doc_id"], r["words"]) for r in got] == [(2, 10)]


def test_equal_runs():
    assert d.equal_runs([b"a", b"b"], [b"a", b"b"], 7, 2) == [(7, 2)]
    assert d.equal_runs([b"a", b"x", b"b", b"c", b"d"], [b"a", b"y", b"b", b"c", b"d"], 10, 2) == [(12, 3)]
    assert d.equal_runs([b"a"], [b"b"], 0, 1) == []
