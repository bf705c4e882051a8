"""The pipeline on a small table, held against the stages' brute-force versions one after the other."""

import importlib

import corpus_pipeline
from strandline.llm import langid, pieces

from tests.llm.test_decontamination import brute as spans
from tests.llm.test_exact_dedup import expected as survivors
from tests.llm.test_langid import brute_bits
from tests.llm.test_ngram_join import brute as similar


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language identification", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "SentencePiece encoding and decoding"]
    assert corpus_pipeline.ORACLE_SQL is None
    entry = importlib.import_module("__spark_entry__")
    assert {f"op{n}" for n in range(1, 11)} | {"pipeline"} == {q.split("_")[0] for q in entry.queries() if q.startswith("op") and q[2].isdigit() or q == "pipeline"}


def test_run_against_brute_force(spark, table, odd_rows, tmp_path):
    rows = [r for r in odd_rows if r[0] not in (None, 90, 91) and not (r[0] == 7 and r[1].startswith("another"))]
    items = [(0, " ".join(rows[10][1].split()[:30])), (1, rows[62][1].split("\n")[1])]
    rows.append((200, "\x01\x02\x03\x04\x05\x06\x07" * 9))
    docs = [(i, t, None if i == 200 else "en") for i, t in rows]
    table(docs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = {r["doc_id"]: r for r in out.collect()}

    sample = langid.labelled_sample(table(docs))
    kept = [(i, t) for i, t in rows if t and brute_bits(sample["en"], t) / langid.UNIT / len(t.lower().encode()) <= langid.MAX_BITS]
    assert 200 not in {i for i, _ in kept} and len(kept) > 60
    alive = survivors(kept)
    kept = list({(i, t) for i, t in kept if i in alive})
    assert len(kept) == sum(alive.values())
    parent = {i: i for i, _ in kept}

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for a, b in similar(kept):
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    kept = [(i, t) for i, t in kept if root(i) == i]
    kept = [(i, t) for i, t in kept if not spans([(i, t)], items)]
    assert set(got) == {i for i, _ in kept} and 10 not in got and 62 not in got
    v = pieces.vocabulary(pieces.MODEL)
    for i, t in kept:
        assert got[i]["decoded"] == t
        assert b"".join(v.bytes_of[k] for k in got[i]["ids"]) == (" " + t).encode() or "▁" in t
