import random
import re

import pytest
from strandline.llm import ngram_join as j

from .conftest import words


def grams(text, n=j.N):
    w = re.findall(r"[0-9a-z\x80-\U0010FFFF]+", text.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def merged(rows):
    by = {}
    for i, t in rows:
        if i is not None:
            by.setdefault(i, set()).add(t)
    return {i: "\n".join(sorted(x for x in ts if x is not None)) for i, ts in by.items()}


def brute(rows, tau=j.TAU, n=j.N):
    """Similarity of all pairs of documents; equal texts count as such even without a word."""
    texts = sorted((i, t) for i, t in merged(rows).items() if t)
    sets = {i: grams(t, n) for i, t in texts}
    out = {}
    for x, (a, t) in enumerate(texts):
        for b, u in texts[x + 1 :]:
            both = len(sets[a] & sets[b])
            if t == u or both and both >= tau * len(sets[a] | sets[b]) - 1e-9:
                out[a, b] = 1.0 if t == u else both / len(sets[a] | sets[b])
    return out


def between_texts(rows, pairs):
    lead = {}
    for i, t in sorted(merged(rows).items()):
        lead.setdefault(t, i)
    text = merged(rows)
    return {(a, b): s for (a, b), s in pairs.items() if lead[text[a]] == a and lead[text[b]] == b and text[a] != text[b]}


def classes(pairs):
    """{doc: (class, links)}"""
    ids = sorted({i for p in pairs for i in p})
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: (find(i), sum(i in p for p in pairs)) for i in ids}


def documents(df):
    rows = [(r["doc_id"], (r["class_id"], r["links"])) for r in df.collect()]
    assert len(dict(rows)) == len(rows)
    return dict(rows)


def result(df):
    rows = [(r["doc_id_a"], r["doc_id_b"], r["jaccard"]) for r in df.collect()]
    assert len({r[:2] for r in rows}) == len(rows)
    return {(a, b): s for a, b, s in rows}


@pytest.mark.parametrize("block", [2048, 5])
def test_all_pairs(spark, table, odd_rows, block):
    want = brute(odd_rows)
    assert len(want) >= 25
    docs = table(odd_rows, clash=True)
    assert result(j.similar_pairs(spark, docs, block=block)) == pytest.approx(between_texts(odd_rows, want))
    assert documents(j.similar_documents(spark, docs, block=block)) == classes(want)


def family(seed, n=70, size=60, edits=4):
    rng = random.Random(seed)
    base = [f"w{seed}_{k}" for k in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(size)] = f"z{rng.randrange(9)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [2048, 16])
def test_large_group_in_blocks(spark, table, block):
    rows = list(enumerate(family(2) + family(3, 20) + family(2, 5)))
    random.Random(1).shuffle(rows)
    want = brute(rows)
    assert documents(j.similar_documents(spark, table(rows), block=block)) == classes(want)
    assert result(j.similar_pairs(spark, table(rows), block=block)) == pytest.approx(between_texts(rows, want))


def test_hot_copies_and_a_hot_passage(spark, table):
    """A third of all rows are one text, another third share a passage."""
    rng = random.Random(4)
    passage = " ".join(words(rng, 40))
    rows = [(i, "the one text that is there again and again") for i in range(150)]
    rows += [(150 + i, " ".join(words(rng, 15)) + "\n" + passage) for i in range(150)]
    rows += [(300 + i, " ".join(words(rng, 50))) for i in range(150)]
    assert documents(j.similar_documents(spark, table(rows), block=32)) == classes(brute(rows))


def test_words_of_a_periodic_pattern(spark, table):
    """Words that follow the Thue-Morse sequence and its complement, of one hash under polynomials modulo 2**64."""
    t = "a"
    while len(t) < 4096:
        t += t.translate(str.maketrans("ab", "ba"))
    u = t.translate(str.maketrans("ab", "ba"))
    assert j.similar_pairs(spark, table([(1, t + " x y"), (2, u + " x y")])).count() == 0


def test_other_thresholds(spark, table, odd_rows):
    for tau, n in ((0.5, 2), (0.9, 3)):
        assert documents(j.similar_documents(spark, table(odd_rows), n=n, tau=tau)) == classes(brute(odd_rows, tau, n))


def test_stage_leaves_one_of_each_group(spark, table, odd_rows):
    docs = table(odd_rows, clash=True)
    gone = {i for i, (c, _) in classes(brute(odd_rows)).items() if i != c}
    out = j.stage(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(str(i) for i, _ in odd_rows if i not in gone)


def test_empty(spark, table):
    assert j.similar_pairs(spark, table([])).count() == 0
    assert j.similar_documents(spark, table([])).count() == 0
    assert j.stage(spark, table([(1, None), (2, "")]), "").count() == 2


def test_linked_groups_of_a_long_chain(spark):
    from strandline.llm.common import linked_groups

    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (1002, 1001), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in linked_groups(spark, links).collect()}
    assert got == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000, 1002: 1000}
