from collections import Counter

import numpy as np
from strandline.llm import exact_dedup as x


def expected(rows):
    kept = []
    for text in {t for _, t in rows if t is not None}:
        ids = [i for i, t in rows if t == text]
        kept.append(min((i for i in ids if i is not None), default=None))
    return Counter(kept + [i for i, t in rows if t is None])


def test_perfect_hash_is_minimal_and_checked():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 256, (5000, 32), dtype=np.uint8)
    h = x.PerfectHash(keys)
    assert sorted(h.index(keys)) == list(range(5000))
    other = rng.integers(0, 256, (5000, 32), dtype=np.uint8)
    slots = np.zeros((5000, 32), np.uint8)
    slots[h.index(keys)] = keys
    at = h.index(other)
    assert not ((at >= 0) & (slots[at] == other).all(1)).any()
    assert x.PerfectHash(keys[:0]).index(keys[:3]).tolist() == [-1, -1, -1]
    assert x.PerfectHash(keys[:1]).index(keys[:1]).tolist() == [0]


def test_query_against_brute_force(spark, table, odd_rows):
    got = x.exact_dedup(spark, table(odd_rows, clash=True)).collect()
    assert Counter(r["doc_id"] for r in got) == expected(odd_rows)
    copies = Counter(t for _, t in odd_rows if t is not None)
    by_id = {r["doc_id"]: r["copies"] for r in got if r["digest"]}
    assert by_id[0] == copies[odd_rows[0][1]] == 3


def test_history_decides_even_with_a_custom_condition(spark, table):
    from pyspark.sql import functions as F

    docs = table([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "c")])
    got = {(r["doc_id"], r["historical"], r["copies"]) for r in x.winners(spark, docs, F.col("doc_id").isin(2, 4)).collect()}
    assert got == {(2, True, 2), (4, True, 2), (5, False, 1)}


def test_stage_keeps_columns_and_one_row_of_repeats(spark, table, odd_rows):
    docs = table(odd_rows, clash=True)
    out = x.stage(spark, docs, "")
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == expected(odd_rows)


def test_empty(spark, table):
    assert x.exact_dedup(spark, table([])).count() == 0
    assert x.stage(spark, table([]), "").count() == 0
