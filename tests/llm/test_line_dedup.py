import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from strandline.llm import line_dedup as ld

LINES = st.lists(st.integers(1, 12), max_size=14)


@given(LINES, LINES)
@settings(max_examples=300, deadline=None)
def test_patience_aligns(a, b):
    pairs = ld.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
    once = [x for x in a if a.count(x) == 1 and b.count(x) == 1]
    ends_differ = a and b and a[0] != b[0] and a[-1] != b[-1]  # equal ends are taken before any anchor
    if ends_differ and [x for x in b if x in once] == once:  # unique lines in the same order are all aligned
        assert set(once) <= {a[i] for i, _ in pairs}


@given(LINES)
@settings(deadline=None)
def test_equal_sequences_align_wholly(a):
    assert ld.patience(a, a) == [(i, i) for i in range(len(a))]


def brute(rows, floor=ld.RARE_FLOOR, share=ld.RARE_SHARE):
    by = defaultdict(set)
    for i, t in rows:
        if i is not None:
            by[i].add(t)
    texts = {i: ("\n".join(sorted(x for x in ts if x is not None)) if len(ts) > 1 else next(iter(ts))) for i, ts in by.items()}
    lines = {i: [x.replace("\t", " ").replace("\r", " ").strip(" ") for x in t.split("\n")] for i, t in texts.items() if t}
    lead = {}
    for i in sorted(lines):
        lead.setdefault(tuple(lines[i]), i)
    gone = {i: set(range(len(x))) if lead[tuple(x)] != i else set() for i, x in lines.items()}
    own = {i: x for i, x in lines.items() if lead[tuple(x)] == i}
    df = Counter(x for v in own.values() for x in set(v) if x)
    most = max(floor, int(share * len(own)))
    rare = {x for x, n in df.items() if 1 < n <= most}
    for i, v in own.items():
        partners = defaultdict(set)
        for x in set(v) & rare:
            first = min(k for k, w in own.items() if x in w)
            if first != i:
                partners[first].add(x)
        for first, shared in partners.items():
            code = {x: n for n, x in enumerate(sorted(set(v) | set(own[first])))}
            gone[i] |= ld.deleted_lines([code[x] for x in v], [code[x] for x in own[first]], {code[x] for x in shared})
    return {i: sorted(g) for i, g in gone.items()}, texts


def rows_with_shared_lines():
    rng = random.Random(8)
    pool = [f"line number {k} of the pool" for k in range(60)]
    rows = []
    for i in range(50):
        own = [rng.choice(pool) if rng.random() < 0.4 else f"own {i} {k}" for k in range(rng.randint(1, 12))]
        if rng.random() < 0.3:
            own.insert(rng.randrange(len(own) + 1), "the same line for all")
        if rng.random() < 0.3:
            own.insert(rng.randrange(len(own) + 1), "")
        rows.append((i, "\n".join(own)))
    block = "\n".join(pool[:4])
    return rows + [(60, "a\n" + block + "\nb"), (61, "c\r\n" + block + "\t\nd"), (62, rows[3][1]), (63, rows[3][1] + " ")]


def check(spark, table, rows, **kw):
    want, texts = brute(rows, **kw)
    got = {r["doc_id"]: r for r in ld.line_dedup(spark, table(rows, clash=True), **kw).collect() if r["doc_id"] is not None}
    assert set(got) == set(texts)
    for i, r in got.items():
        assert r["removed"] == want.get(i, []), i
        if not texts[i]:
            assert r["text"] == texts[i]
        else:
            kept = [x for k, x in enumerate(texts[i].split("\n")) if k not in set(r["removed"])]
            assert r["text"] == "\n".join(kept) and r["n_lines"] == len(texts[i].split("\n"))
    return got


def test_against_brute_force(spark, table, odd_rows):
    got = check(spark, table, rows_with_shared_lines())
    assert got[62]["text"] == "" and got[63]["text"] == "" and "line number 1 of" not in got[61]["text"]
    assert sum(bool(r["removed"]) for r in got.values()) > 10
    check(spark, table, rows_with_shared_lines(), floor=3, share=0.0)
    check(spark, table, odd_rows)


def test_null_ids_and_empty(spark, table):
    got = ld.line_dedup(spark, table([(None, "a\nb"), (None, None), (1, "a\nb")])).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == [("1", "a\nb"), ("None", "None"), ("None", "a\nb")]
    assert ld.line_dedup(spark, table([])).count() == 0
