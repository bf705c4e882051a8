"""The corpus pipeline: documents through five of the corpus operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows to the cluster's shared folder and
reads them again as the next one's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import common, decontamination, exact_dedup, langid, ngram_join, pieces

STAGES = [
    ("language identification", langid.stage),
    ("exact dedup", exact_dedup.stage),
    ("n-gram Jaccard join", ngram_join.stage),
    ("benchmark decontamination", decontamination.stage),
    ("SentencePiece encoding and decoding", pieces.stage),
]
#: None: code lengths and sampled segmentations are outside SQL. The tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(common.tuned(spark), sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(spark, docs, f"stage{k}")
    return docs
