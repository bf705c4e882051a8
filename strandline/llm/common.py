"""Plumbing the corpus operators share: table access, bucket counts, checkpoints, linked groups."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``. Only where that is unset and all runs on this machine (tests), a temporary one;
    on a cluster an unset folder raises, as executors don't share temporary ones."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + os.path.join(tempfile.gettempdir(), "strandline-shared")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/strandline-{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Remove everything this application has written to the shared folder, once its results have been stored elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: store ``df`` as Parquet in the shared folder and read it back, so a lost executor costs no recomputation.

    Each application has a folder of its own there; see :func:`clean`."""
    path = f"{own_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, df: DataFrame) -> None:
    """Remove a table made by :func:`written` once nothing will read it again."""
    root = shared_dir(spark)
    for f in df.inputFiles()[:1]:
        folder = f.rsplit("/", 1)[0]
        if folder.replace("file:///", "/").startswith(root.replace("file://", "")):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bucket_count(spark: SparkSession, df: DataFrame, mb_each: float = 8.0) -> int:
    """Buckets for a bucketed exchange: the session's shuffle width, or more when the scanned bytes ask for it.

    The size comes from the optimiser's statistics (file sizes), so no job runs; an unknown size falls back to the session's width.
    """
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(width, min(size >> 20, 1 << 27) // int(mb_each)) if size < 1 << 60 else width


def id_text(docs: DataFrame) -> DataFrame:
    """The two columns every text operator reads; other columns, whatever they are called, never reach it."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def linked_groups(spark: SparkSession, links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``links(a long, b long)`` as ``(node, root)``, root the smallest id of the component.

    Alternating large-star and small-star rounds: each moves every node's neighbours to the smallest id seen, so the
    rounds grow with the logarithm of the longest chain. Each round is written to the shared folder; nothing is collected but one number.
    """
    edges = written(spark, links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    made = [edges]
    before = None
    for _ in range(max_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = written(spark, small.where("u <> v").distinct(), "links")
        made.append(edges)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("connected components did not settle")
    for old in made[:-1]:
        drop_written(spark, old)
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def tuned(spark: SparkSession) -> SparkSession:
    """Bound the bytes of an Arrow batch, so a run of very long texts can't swell a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def fresh_name(docs: DataFrame, name: str) -> str:
    """``name``, or that with underscores before it where ``docs`` has a column of that name."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = "_" + name
    return name


def one_row_per_id(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``id_text(docs)`` with one row for each non-null doc_id.

    Rows that share a doc_id become one document: their distinct texts, in order, joined by a line end, or null where all are null. Texts are only
    moved where some doc_id does repeat, which is found out from the ids alone.
    """
    rows = id_text(docs).where("doc_id is not null")
    again = rows.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again"))
    if again.limit(1).count() == 0:
        return rows
    again = written(spark, again, "repeated")
    on = F.col("doc_id") == F.col("again")
    merged = rows.join(again, on, "left_semi").groupBy("doc_id").agg(F.collect_set("text").alias("texts"))
    merged = merged.select("doc_id", F.when(F.size("texts") > 0, F.array_join(F.array_sort("texts"), "\n")).alias("text"))
    return rows.join(again, on, "left_anti").unionByName(merged)


def without_ids(spark: SparkSession, docs: DataFrame, gone: DataFrame, limit: int = 1 << 20) -> DataFrame:
    """Rows of ``docs`` whose doc_id isn't in ``gone`` (one long column, no nulls); a null doc_id stays.

    Up to ``limit`` ids are broadcast; beyond it, both sides are shuffled.
    """
    name = fresh_name(docs, "gone")
    ids = gone.toDF(name)
    small = ids.limit(limit + 1).count() <= limit
    return docs.join(F.broadcast(ids) if small else ids, docs["doc_id"].cast("long") == F.col(name), "left_anti")
