import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from strandline.llm import kernel
from strandline.llm import substring_dedup as s


def brute(rows, k):
    by = {}
    for i, t in rows:
        if i is not None:
            by.setdefault(i, set()).add(t)
    texts = {i: re.findall(r"[0-9a-z\x80-\U0010FFFF]+", "\n".join(sorted(x for x in ts if x is not None)).lower()) for i, ts in by.items()}
    seen = Counter()
    first = {}
    for i in sorted(texts):
        for a in range(len(texts[i]) - k + 1):
            w = tuple(texts[i][a : a + k])
            seen[w] += 1
            first.setdefault(w, (i, a))
    out = []
    for i, w in texts.items():
        run = []
        for a in range(len(w) - k + 2):
            win = tuple(w[a : a + k]) if a <= len(w) - k else None
            if win and seen[win] > 1:
                run.append((a, win))
            elif run:
                out.append((i, run[0][0], len(run) + k - 1, len(run), sum(first[x] == (i, b) for b, x in run), max(seen[x] for _, x in run)))
                run = []
    return sorted(out)


def result(df):
    return sorted(tuple(r[c] for c in ("doc_id", "start_word", "n_words", "windows", "first_windows", "max_copies")) for r in df.collect())


@pytest.mark.parametrize("k,m", [(50, 4), (8, 3), (5, 5)])
def test_against_brute_force(spark, table, odd_rows, k, m):
    rows = [r for r in odd_rows if r[0] != 90]
    want = brute(rows, k)
    assert want
    assert result(s.repeated_passages(spark, table(rows, clash=True), k, m)) == want


def test_repeats_inside_a_text(spark, table):
    rng = random.Random(4)
    w = [f"v{rng.randrange(500)}" for _ in range(200)]
    rows = [(1, " ".join(w + ["x"] + w)), (2, "a " * 300), (3, " ".join(w[20:90]))]
    assert result(s.repeated_passages(spark, table(rows))) == brute(rows, s.K)


def test_super_kmers_cover_each_window_once():
    rng = np.random.default_rng(3)
    texts = [" ".join(f"t{x}" for x in rng.integers(0, 30, n)) for n in (0, 10, 49, 50, 51, 400)]
    words = kernel.Words(pa.array(texts))
    gram, first, count, doc = s.super_kmers(words)
    at, owner = kernel.inside(words.first, s.K)
    assert kernel.spans(first, count).tolist() == at.tolist()
    assert np.repeat(doc, count).tolist() == owner.tolist()
    assert count.max() <= s.K - s.M + 1


def counted(rows, k, m):
    batch = pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.large_string())], names=["doc_id", "text"])
    packed = pa.Table.from_batches(list(s._spread(0, k, m)([batch])))
    return sorted(map(tuple, (r.values() for r in s._count(k)(packed).to_pylist())))


@pytest.mark.parametrize("what", ["words", "windows"])
def test_hashes_that_collide_change_nothing(monkeypatch, what):
    rng = random.Random(9)
    base = [f"v{rng.randrange(40)}" for _ in range(120)]
    rows = [(i, " ".join(base[i : i + 60] + [f"v{rng.randrange(40)}" for _ in range(30)])) for i in range(8)]
    want = counted(rows, 6, 6)  # grams as long as the windows, so that places don't hang on the hash
    if what == "words":
        monkeypatch.setattr(kernel, "word_hashes", lambda data, a, b, f=kernel.word_hashes: f(data, a, b) & np.uint64(7))
        packed = counted(rows, 6, 6)
    else:
        monkeypatch.setattr(kernel, "windows", lambda h, k, seed=1, f=kernel.windows: f(h, k, seed) & np.uint64(7) if seed == 31 else f(h, k, seed))
        packed = counted(rows, 6, 6)
    spread = lambda found: sorted((i, x) for i, a, b, *_ in found for x in range(a, b + 1))
    assert want and spread(packed) == spread(want)


def test_words_of_a_periodic_pattern(spark, table):
    """Words that follow the Thue-Morse sequence and its complement, of one hash under polynomials modulo 2**64."""
    t = "a"
    while len(t) < 2048:
        t += t.translate(str.maketrans("ab", "ba"))
    u = t.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"p q {t} r s"), (2, f"p q {u} r s"), (3, f"p q {t} r s")]
    assert result(s.repeated_passages(spark, table(rows), 5, 3)) == brute(rows, 5)


def test_empty(spark, table):
    assert s.repeated_passages(spark, table([])).count() == 0
    assert s.repeated_passages(spark, table([(1, None), (2, ""), (3, "short")])).count() == 0
