import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, as columns of a caller's table.
CLASHING = ["bucket", "token", "lines", "h", "root", "ids", "kept", "__id", "digest", "accepted", "__gone", "gone", "_gone", "node", "lead", "rep"]


def words(rng, n, letters="abcdefghij"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="session")
def table(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang) rows; with ``clash``, it has more columns."""

    def make(rows, clash=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        if clash:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit("x") for c in CLASHING})
        return df

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows and near copies, among ordinary rows."""
    rng = random.Random(5)
    base = [" ".join(words(rng, rng.randint(5, 120))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(40, 60):  # near copies
        w = base[i - 40].split()
        w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w)))
    shared = " ".join(words(rng, 60))
    rows += [(60 + i, " ".join(words(rng, 10)) + "\n" + shared + "\n" + " ".join(words(rng, 10))) for i in range(6)]
    rows += [(70, base[0]), (71, base[0]), (72, base[1]), (5, base[5]), (5, base[5])]
    rows += [(80, None), (81, ""), (82, None), (83, ""), (84, "   "), (85, "..."), (86, "one"), (87, "one two"), (88, "One, TWO!"), (89, "é ü ß 你好 😀 ▁x")]
    rows += [(None, base[2]), (None, None), (90, " ".join(words(rng, 30_000))), (91, "x" * 100_000), (7, "another text under the same id")]
    return rows
