"""The corpus operators' queries over the driver's tables, with their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import decontamination, exact_dedup, langid, line_dedup, ngram_join, pieces, pii, sharding, substring_dedup, warc
from strandline.llm.common import table, tuned


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.sampled_pieces(tuned(spark), table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated_spans(tuned(spark), table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(tuned(spark), table(spark, sf_dir, "pages"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(tuned(spark), table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(tuned(spark), table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(tuned(spark), table(spark, sf_dir, "documents"), every_pair=True)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(tuned(spark), table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(tuned(spark), table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_keys(tuned(spark), table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(spark, table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_sentencepiece, op2_decontamination, op3_warc, op4_pii, op5_exact_dedup, op6_line_dedup, op7_substring_dedup, op8_ngram_jaccard_join, op9_sharding, op10_language_id)}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontamination": r"""
            WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
            b AS (SELECT item_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM benchmark),
            dg AS (SELECT doc_id, p, array_to_string(ws[p + 1:p + 8], ' ') AS g FROM (SELECT *, unnest(range(0, len(ws) - 7)) AS p FROM d WHERE len(ws) >= 8)),
            bg AS (SELECT item_id, q, array_to_string(ws[q + 1:q + 8], ' ') AS g FROM (SELECT *, unnest(range(0, len(ws) - 7)) AS q FROM b WHERE len(ws) >= 8)),
            m AS (SELECT doc_id, item_id, p, q, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS run FROM dg JOIN bg USING (g))
            SELECT doc_id, item_id, min(p)::INT AS doc_start, min(q)::INT AS item_start, (count(*) + 7)::INT AS words FROM m GROUP BY doc_id, item_id, p - q, run""",
        "op3_warc": "SELECT page_id, url, html FROM pages",
        "op5_exact_dedup": """
            WITH d AS (SELECT doc_id, text, doc_id <= (SELECT (min(doc_id) + max(doc_id)) // 2 FROM documents WHERE text IS NOT NULL) AS old FROM documents)
            SELECT min(doc_id) AS doc_id, count(*) AS copies, bool_or(old) AS historical, sha256(text) AS digest
            FROM d WHERE text IS NOT NULL GROUP BY text
            UNION ALL SELECT doc_id, 1, false, NULL FROM d WHERE text IS NULL""",
        "op7_substring_dedup": r"""
            WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
            k AS (SELECT doc_id, i, sha256(array_to_string(ws[i + 1:i + 50], ' ')) AS win
                  FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS i FROM w WHERE len(ws) >= 50)),
            c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY win) AS n, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS r FROM k),
            g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c WHERE n > 1)
            SELECT doc_id, min(i) AS start_word, max(i) - min(i) + 50 AS n_words, count(*) AS windows, count(*) FILTER (WHERE r = 1) AS first_windows, max(n) AS max_copies
            FROM g GROUP BY doc_id, run""",
        "op8_ngram_jaccard_join": r"""
            WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
            g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS gram
                  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
            s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
            c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
            p AS (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE common >= 0.6 * (x.n + y.n - common) - 1e-9
                  UNION SELECT a.doc_id, b.doc_id FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id <> b.doc_id WHERE a.text <> ''),
            r AS (SELECT a AS node, b AS root FROM p UNION SELECT r.node, p.b FROM r JOIN p ON p.a = r.root)
            SELECT p.a AS doc_id, least(p.a, min(r.root)) AS class_id, (SELECT count(*) FROM p q WHERE q.a = p.a) AS links FROM p JOIN r ON r.node = p.a GROUP BY p.a""",
    }
