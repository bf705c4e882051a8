import math
import random
from collections import defaultdict

import pyarrow as pa
from strandline.llm import langid


def brute_bits(samples, text, order=3):
    """Code length of one text under one language's tree, straight from the definition; returns 1/1024 bits."""
    counts = defaultdict(lambda: defaultdict(int))
    for t in samples:
        raw = t.lower().encode()
        for i, b in enumerate(raw):
            for n in range(order + 1):
                if i >= n:
                    counts[raw[i - n : i]][b] += 1
    # a longer context is known where some language has it; a language that hasn't skips it for free
    total = 0
    raw = text.lower().encode()
    for i, b in enumerate(raw):
        bits = 0.0
        for n in range(min(order, i), -1, -1):
            own = counts.get(raw[i - n : i])
            if not own:
                continue
            size, q = sum(own.values()), len(own)
            if b in own:
                bits += math.log2((size + q) / own[b])
                break
            bits += math.log2((size + q) / q)
        else:
            bits += 8
        total += round(bits * langid.UNIT)
    return total


def corpora():
    rng = random.Random(3)
    make = lambda parts: [" ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 40))) for _ in range(30)]
    return {"aa": make(["th", "er", "ing", "on"]), "bb": make(["sch", "ung", "ä", "ei"]), "cc": make(["ción", "que", "os", "ñ"])}


def test_code_lengths_are_exact():
    data = corpora()
    trees = langid.train(data)
    texts = [t for v in data.values() for t in v[:5]] + ["", "zzz \x00", "the schón", "x" * 3000, "Ü"]
    cost, size = langid.code_lengths(trees, pa.array(texts))
    for j, t in enumerate(texts):
        assert size[j] == len(t.lower().encode())
        for i, k in enumerate(trees.langs):
            assert abs(int(cost[i, j]) - brute_bits(data[k], t)) <= max(2, len(t) // 50), (k, t)


def test_batches_do_not_matter():
    data = corpora()
    trees = langid.train(data)
    texts = [t for v in data.values() for t in v]
    whole, _ = langid.code_lengths(trees, pa.array(texts))
    for j, t in enumerate(texts):
        assert (langid.code_lengths(trees, pa.array([t]))[0][:, 0] == whole[:, j]).all()


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    sample = langid.labelled_sample(docs, 40)
    assert all(len(v) <= 40 for v in sample.values())
    seen = {t for v in sample.values() for t in v}
    trees = langid.train(sample)
    rows = [(r["lang"], r["text"]) for r in docs.collect() if r["text"] not in seen]
    got = langid.identify(trees, pa.array([t for _, t in rows])).to_pylist()
    assert len(rows) > 500
    assert sum(g["lang"] == lang for g, (lang, _) in zip(got, rows)) / len(rows) > 0.99
    assert sum(g["accepted"] for g in got) / len(rows) > 0.999
    noise = ["".join(chr(random.Random(i).randrange(0x4E00, 0x9FFF)) for i in range(200)), "\x01\x02\x03\x04\x05" * 20]
    assert not any(g["accepted"] for g in langid.identify(trees, pa.array(noise)).to_pylist())


def test_query_and_stage_on_odd_rows(spark, table, odd_rows):
    docs = table(odd_rows, clash=True)
    got = langid.language_id(spark, docs).collect()
    assert len(got) == len(odd_rows)
    assert sum(r["lang"] is None for r in got) == sum(not t for _, t in odd_rows) == sum(r["bits"] is None for r in got)
    assert {r["doc_id"] for r in got if r["lang"] is None} == {i for i, t in odd_rows if not t}
    out = langid.stage(spark, docs, "")
    assert out.columns == docs.columns
    assert not {r["doc_id"] for r in out.collect()} & {80, 81, 82, 83}


def test_nothing_labelled_and_empty(spark, table):
    docs = table([(1, "some text", None)])
    assert [(r["lang"], r["accepted"]) for r in langid.language_id(spark, docs).collect()] == [(None, False)]
    assert langid.stage(spark, docs, "").count() == 0
    assert langid.language_id(spark, table([])).count() == 0
