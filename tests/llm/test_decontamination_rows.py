"""Decontamination judges rows alike below and above the size up to which test items are broadcast."""

import pytest
from strandline.llm import decontamination as d

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen"
DIRTY, CLEAN = f"before {ITEM} after", "nothing of the benchmark is in this text at all"


@pytest.mark.parametrize("small", [d.SMALL_BYTES, 0])
def test_stage_judges_each_row_by_its_text(spark, table, tmp_path, monkeypatch, small):
    monkeypatch.setattr(d, "SMALL_BYTES", small)
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = [(1, DIRTY), (1, CLEAN), (1, CLEAN), (2, CLEAN), (3, DIRTY), (None, DIRTY), (None, CLEAN), (None, None), (4, None), (5, "")]
    df = table(docs, clash=True)
    out = d.stage(spark, df, str(tmp_path))
    assert out.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted((x for x in docs if x[1] != DIRTY), key=str)


@pytest.mark.parametrize("small", [d.SMALL_BYTES, 0])
def test_items_without_an_id_count(spark, table, tmp_path, monkeypatch, small):
    monkeypatch.setattr(d, "SMALL_BYTES", small)
    other = " ".join(f"w{k}" for k in range(12))
    test = spark.createDataFrame([(None, ITEM), (None, other), (None, None), (7, ITEM)], "item_id long, text string")
    docs = [(1, DIRTY), (2, other), (3, CLEAN), (None, DIRTY)]
    got = d.contaminated_spans(spark, table(docs), test, small_bytes=small).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, None, 1, 0, 13), (1, 7, 1, 0, 13), (None, None, 1, 0, 13), (None, 7, 1, 0, 13), (2, None, 0, 0, 12)], key=str)
    test.where("item_id is null").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [r["doc_id"] for r in d.stage(spark, table(docs), str(tmp_path)).collect()] == [3]
