import itertools
import random
import re

import numpy as np
import pyarrow as pa
from strandline.llm import pii, pii_table

PATTERNS = {
    "EMAIL": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "CARD": r"(?<!\w)\d{16}(?!\w)", "IP": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)",
    "PHONE": r"\+1 \(\d{3}\) \d{3}-\d{4}", "SECRET": r"(?<!\w)[0-9a-fA-F]{40}(?!\w)",
}


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(2)
    k, lengths = 3, np.array([1, 2, 4, 5])
    e, trans = rng.normal(size=(5, 4, k)), rng.normal(size=(k, k))
    got = pii.viterbi(e, trans, lengths)
    for j, n in enumerate(lengths):
        score = lambda p: sum(e[t, j, x] for t, x in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:]))
        assert tuple(got[:n, j]) == max(itertools.product(range(k), repeat=int(n)), key=score)


def test_training_table_is_learnt_and_training_repeats():
    m = pii.Model()
    assert m.words_are_plain
    good = total = 0
    for tokens, labels in pii_table.sequences():
        s = [m.score(t) for t in tokens]
        c = [m_[1] for m_ in s]
        edge = pii.CLASSES.index("edge")
        e = np.array([x + m.before[c[i - 1] if i else edge] + m.after[c[i + 1] if i + 1 < len(c) else edge] for i, (x, _) in enumerate(s)])
        path = pii.viterbi(e[:, None], m.trans, np.array([len(tokens)]))[:, 0]
        good += sum(pii.LABELS[p] == x for p, x in zip(path, labels))
        total += len(labels)
    assert good / total > 0.99
    assert np.array_equal(pii.Model().trans, m.trans)


def test_skipping_lines_of_words_changes_nothing(spark, sf_dir):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    a, b = pii.Model(), pii.Model()
    b.words_are_plain = False
    ids = list(range(len(texts)))
    assert pii.find(a, ids, pa.array(texts)) == pii.find(b, ids, pa.array(texts))


def test_gradient_is_that_of_the_enumerated_likelihood():
    rng = np.random.default_rng(7)
    k, lengths = 3, [1, 2, 4]
    e, trans = rng.normal(size=(4, 3, k)), rng.normal(size=(k, k))
    on = np.arange(4)[:, None] < np.array(lengths)
    total, single, pair = pii.expected(e, trans, on)
    want = np.zeros((k, k))
    for j, n in enumerate(lengths):
        paths = list(itertools.product(range(k), repeat=n))
        weight = np.exp([sum(e[t, j, x] for t, x in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:])) for p in paths])
        assert np.isclose(total[j], np.log(weight.sum()))
        for t in range(4):
            for y in range(k):
                assert np.isclose(single[t, j, y], sum(w for p, w in zip(paths, weight) if t < n and p[t] == y) / weight.sum())
        for p, w in zip(paths, weight):
            for a, b in zip(p, p[1:]):
                want[a, b] += w / weight.sum()
    assert np.allclose(pair, want)


def plain_spans(m, text):
    """Token by token, without any shortcut: (kind, first token, last token) of the runs of one label."""
    out = []
    for line in text.split("\n"):
        tokens = line.split()
        if not tokens:
            continue
        s = [m.score(t) for t in tokens]
        edge = pii.CLASSES.index("edge")
        e = np.array([x + m.before[s[i - 1][1] if i else edge] + m.after[s[i + 1][1] if i + 1 < len(s) else edge] for i, (x, _) in enumerate(s)])
        path = pii.viterbi(e[:, None], m.trans, np.array([len(tokens)]))[:, 0]
        k = 0
        while k < len(path):
            end = k + 1
            while end < len(path) and path[end] == path[k] and path[k] and not pii._whole(pii.LABELS[path[k]], tokens[end - 1]):
                end += 1
            if path[k]:
                out.append((pii.LABELS[path[k]], tokens[k:end]))
            k = end
    return out


def test_find_is_the_plain_tagger(spark, sf_dir):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet").where("text rlike '[0-9@]'").limit(150).collect()]
    m = pii.model()
    for text in texts:
        got, want = pii.find(m, [0], pa.array([text])), plain_spans(m, text)
        assert [k for _, k, *_ in got] == [k for k, _ in want]
        assert all(v.split()[-1] in tokens[-1] for (*_, v), (_, tokens) in zip(got, want))


def test_no_entity_of_the_table_is_in_the_documents(spark, sf_dir):
    values = [m[2] for m in re.finditer(r"\{([A-Z]):([^}]*)\}", pii_table.LINES) if len(m[2]) > 8]
    for sf in ("0.001", "0.01", "0.1"):
        texts = spark.read.parquet(f"{sf_dir.replace('0.001', sf)}/documents.parquet").select("text")
        assert texts.where(" or ".join(f"contains(text, '{v}')" for v in values)).count() == 0


def test_held_out_documents(spark, sf_dir):
    """Patterns of their generator's formats serve as labels."""
    docs = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {(r["doc_id"], r["kind"], r["start"], r["end"]) for r in pii.personal_data(spark, docs).collect()}
    want = {(i, k, m.start(), m.end()) for i, t in texts.items() for k, p in PATTERNS.items() for m in re.finditer(p, t)}
    assert len(want) > 80
    assert len(got & want) / len(want) > 0.97 and len(got & want) / len(got) > 0.97


def test_spans(spark, table):
    rows = [
        (1, "Ä: schreib an max.m@x.example.com, ja?"), (2, "call +1 (415) 555-0134!! or 10.1.2.3"), (3, None), (4, ""), (5, 'token = "' + "0a" * 20 + '"'),
        (6, "a@b.example.com c@d.example.com"), (1, "Ä: schreib an max.m@x.example.com, ja?"), (None, "1234567812345678"), (7, "nothing at all here"), (8, "x " * 50_000 + "9.8.7.65"),
    ]
    got = sorted(((str(r["doc_id"]), r["kind"], r["start"], r["end"], r["value"]) for r in pii.personal_data(spark, table(rows, clash=True)).collect()), key=str)
    text = {str(i): t for i, t in rows}
    assert all(text[i][a:b] == v for i, _, a, b, v in got)
    assert [(i, k, v) for i, k, _, _, v in got] == [
        ("1", "EMAIL", "max.m@x.example.com"), ("1", "EMAIL", "max.m@x.example.com"), ("2", "IP", "10.1.2.3"), ("2", "PHONE", "+1 (415) 555-0134"), ("5", "SECRET", "0a" * 20),
        ("6", "EMAIL", "a@b.example.com"), ("6", "EMAIL", "c@d.example.com"), ("8", "IP", "9.8.7.65"), ("None", "CARD", "1234567812345678"),
    ]
    assert pii.personal_data(spark, table([])).count() == 0


def test_long_lines_and_many_sequences_agree():
    m = pii.model()
    rng = random.Random(1)
    parts = ["word", "12", "me@x.example.org", "1.2.3.4", "+1", "(212)", "555-0100", "a,b", "9"]
    lines = [" ".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(200)]
    whole = pii.find(m, [0], pa.array(["\n".join(lines)]))
    single = [(k, v) for x in lines for _, k, _, _, v in pii.find(m, [0], pa.array([x]))]
    assert [(k, v) for _, k, _, _, v in whole] == single
