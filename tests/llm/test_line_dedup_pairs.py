"""Line de-duplication as the query runs it, held against aligning all pairs of documents that share a line."""

import importlib
from itertools import combinations

import pytest
from strandline.llm import line_dedup as ld

from tests.llm.test_line_dedup import rows_with_shared_lines


def runs(lines, other):
    """Places of ``lines`` in an aligned common block with a line that isn't empty; no item, rank or round is used here."""
    gone, block, last = set(), [], None
    for i, j in [*ld.patience(lines, other), (-9, -9)]:
        if last != (i - 1, j - 1):
            gone |= set(block) if any(lines[k] for k in block) else set()
            block = []
        block.append(i)
        last = i, j
    return gone


def unrestricted(rows):
    """removed of each document, for rows without repeated ids: every document against every earlier one."""
    code = {"": 0}
    lines = {i: [code.setdefault(x.replace("\t", " ").replace("\r", " ").strip(" "), len(code)) for x in t.split("\n")] for i, t in rows if t}
    gone = {i: set() for i, _ in rows}
    for a, b in combinations(sorted(lines), 2):
        gone[b] |= set(range(len(lines[b]))) if lines[a] == lines[b] else runs(lines[b], lines[a])
    return {i: sorted(g) for i, g in gone.items()}


def removed(spark, table, rows):
    return {r["doc_id"]: r["removed"] for r in ld.line_dedup(spark, table(rows, clash=True), every_pair=True).collect()}


def test_every_earlier_holder_is_a_partner(spark, table):
    # 1 has the lines in another order; only 2 aligns both lines of 3
    rows = [(1, "q\nR2\nmid 1\nR1\nz1"), (2, "a\nR1\nmid 2\nR2\nb"), (3, "c\nR1\nmid 3\nR2\nd"), (4, "own\nR1\n\nR2"), (5, "e\nR1\n\nR2\nf")]
    got = removed(spark, table, rows)
    assert got == unrestricted(rows) and got[3] == [1, 3] and got[5] == [1, 2, 3]


@pytest.mark.parametrize("rest", [0, 200])
def test_family_of_any_size(spark, table, rest):
    """More members than the narrower rule's limit, with other contents and without: each member loses what it shares."""
    common = [f"paragraph {k}" for k in range(5)]
    rows = [(i, "\n".join([*common[: i % 5], f"edited {i}", *common[i % 5 :]])) for i in range(40)]
    rows += [(1000 + i, f"alone {i}\nalone too {i}") for i in range(rest)]
    got = removed(spark, table, rows)
    assert got == unrestricted(rows)
    assert all(got[i] == [k for k in range(6) if k != i % 5] for i in range(1, 40))
    assert not any(got[1000 + i] for i in range(rest))


def test_blocks_of_frequent_lines(spark, table):
    """A block is deleted whatever its lines' frequency, and with the empty lines inside it; also where lines repeat in a document."""
    rows = [(i, f"own {i}\n\nlicense\n\nterms {i % 3}\nend {i}") for i in range(30)]
    rows += [(100, "x\nlicense\ny\nlicense\nz"), (101, "license\nu\nlicense\nv"), (102, "p\nlicense\nq\nlicense\nr"), (103, "\n\nlicense\n"), (104, "\n"), (105, "")]
    rows += [(200 + i, t + "\nlast") for i, t in rows_with_shared_lines()[:50]]
    got = removed(spark, table, rows)
    assert got == unrestricted(rows) and got[5] == [1, 2, 3, 4] and got[100] == []


def test_the_query_runs_every_pair(spark, table, tmp_path):
    rows = rows_with_shared_lines()
    table(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = importlib.import_module("__spark_entry__").queries()["op6_line_dedup"](spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["removed"] for r in got} == unrestricted(rows)
