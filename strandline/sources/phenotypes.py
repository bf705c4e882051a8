"""Phenotype files: five columns, patient, concept path, number, text, epoch milliseconds."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import observations as fo
from strandline.sources.scratch import dropped, written

COLUMNS = ("patient", "path", "number", "text", "stamp")
_RAW = ", ".join(f"{c} string" for c in COLUMNS)


@dataclass(frozen=True)
class Mode:
    """What loaders differ in: a header line; text that reads as a number becomes one; bad time stamps raise; paths
    ending in their own value lose it; the micro sign parts segments."""

    header: bool = False
    coerce: bool = True
    strict_time: bool = True
    roll_up: bool = True
    micro: bool = False


PLAIN = Mode()
CONFIGURED = Mode(header=True, coerce=False, roll_up=False, micro=True)
LOW_MEMORY = Mode(header=True, coerce=False, strict_time=False, micro=True)
SQL = Mode()


def read_config(path_or_text: str) -> dict[str, dict]:
    """config.json: file name -> {dataset_name, dataset_name_as_root_node}."""
    text = path_or_text if path_or_text.lstrip().startswith(("{", "[")) else open(path_or_text).read()
    loaded = json.loads(text)
    return loaded if isinstance(loaded, dict) else {x["file_name"]: x for x in loaded}


def quoted_line_ends(spark: SparkSession, paths: str | list[str]) -> bool:
    """Whether some quoted field holds a line end: then, and only then, a line has an odd number of quotes."""
    return bool(spark.read.text(paths).where("contains(value, '\"') and length(value) - length(replace(value, '\"', '')) & 1 = 1").limit(1).count())


def raw_csv(spark: SparkSession, paths: str | list[str], header: bool = False) -> DataFrame:
    """Raw records (``COLUMNS``, ``file``, ``seq``) in load order: files by name, rows as they stand. Files are split into tasks, unless a quoted field spans lines.

    seq is made of the file's rank and the place in it: the block's first byte plus the row's number in its task. A task has less rows than a block has bytes, so
    it rises from block to block."""
    df = spark.read.schema(_RAW).csv(paths, header=header, multiLine=quoted_line_ends(spark, paths), quote='"', escape='"', mode="PERMISSIVE", enforceSchema=True)
    rows = df.select(*COLUMNS, F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") + F.monotonically_increasing_id() % (1 << 33)).alias("place"))
    listed = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("file")).distinct()
    ranked = listed.select("file", (F.row_number().over(Window.orderBy("file")) - 1).cast("bigint").alias("rank"))  # one row a file
    return rows.where("patient is not null and path is not null").join(F.broadcast(ranked), "file").select(*COLUMNS, "file", (F.shiftleft("rank", 42) + F.col("place")).alias("seq"))


def normalise(raw: DataFrame, mode: Mode = PLAIN, config: dict[str, dict] | None = None) -> DataFrame:
    """Observations of raw records (``COLUMNS``, ``file``, ``seq``): cleaned paths, typed values, a concept's type fixed by its first record.

    Cleaned records are stored: types need all of them, then each of them again, and files aren't parsed twice. Each step that later ones use more than once is a projection of its own."""
    raw = raw.withColumns({c: fo.clean(F.col(c)) for c in ("path", "text")}).withColumn("path", fo.normal_path(F.col("path"), mode.micro))
    text, path = F.col("text"), F.col("path")
    if mode.roll_up:
        path = fo.rolled_up(path, text)
    name = F.lit(None).cast("string")
    for file, entry in (config or {}).items():
        if entry.get("dataset_name_as_root_node", True) and entry.get("dataset_name"):
            name = F.when(F.element_at(F.split("file", "/"), -1) == file, F.lit(entry["dataset_name"])).otherwise(name)
    records = raw.select(
        F.trim("patient").try_cast("int").alias("patient_num"), fo.rooted(path, name).alias("concept_path"), fo.number(F.col("number"), text, mode.coerce).alias("nval"),
        text.alias("tval"), fo.millis(F.col("stamp"), mode.strict_time).alias("ts_ms"), "seq",
    )
    return fo.typed_by_first(written(raw.sparkSession, records.where("patient_num is not null"), "records"))


def _numbered(raw: DataFrame) -> DataFrame:
    """Load order of a query's rows: partitions in order, rows within."""
    return raw.withColumn("seq", F.monotonically_increasing_id())


def read_csv(spark: SparkSession, paths: str | list[str], mode: Mode = PLAIN, config: dict[str, dict] | None = None) -> DataFrame:
    """Observations of one or more files, or of all files of a directory."""
    return normalise(raw_csv(spark, paths, mode.header), mode, config)


def ingest_status(spark: SparkSession, path: str, observations: DataFrame) -> DataFrame:
    """(file, lines, concepts, observations) of a load; lines count the header."""
    lines = spark.read.text(path).agg(F.count("*").alias("lines"))
    return lines.crossJoin(observations.agg(F.countDistinct("concept_path").alias("concepts"), F.count("*").alias("observations"))).select(F.lit(path).alias("file"), "lines", "concepts", "observations")


def read_jdbc(spark: SparkSession, url: str, query: str, properties: dict[str, str] | None = None, mode: Mode = SQL) -> DataFrame:
    """Observations of a SQL query whose first five columns are those of the files. With partitionColumn, lowerBound, upperBound and numPartitions
    among the properties, as many connections read it side by side."""
    asked = {"dbtable": f"({query}) q"} if "partitionColumn" in (properties or {}) else {"query": query}
    df = spark.read.format("jdbc").options(url=url, **asked, **(properties or {})).load()
    return normalise(_numbered(from_rows(df)), mode)


def from_rows(df: DataFrame) -> DataFrame:
    """Raw records of any table, by position."""
    return df.select(*(F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(df.columns, COLUMNS)), F.lit("").alias("file"))


def read_sequence(spark: SparkSession, sources: Iterable[DataFrame], mode: Mode = PLAIN) -> DataFrame:
    """Observations of several raw sources (``raw_csv``, ``from_rows``), up to 128 of them, loaded one after the other."""
    raw = None
    for i, source in enumerate(sources):
        place = F.col("seq") if "seq" in source.columns else F.monotonically_increasing_id()
        own = source.withColumn("seq", F.lit(i).cast("bigint") * (1 << 56) + place)
        raw = own if raw is None else raw.unionByName(own)
    return normalise(raw, mode)


def write_csv(observations: DataFrame, path: str) -> None:
    """A dump that the loaders read again."""
    from strandline.operators.maintain import source_rows

    source_rows(observations).write.csv(path, header=True, escape='"')


def write_csv_file(observations: DataFrame, path: str) -> None:
    """The same dump as a folder of a single file with a single header: parts are written side by side, then joined byte by byte in this process's JVM, which holds a buffer of them."""
    from strandline.operators.maintain import source_rows

    spark, rows = observations.sparkSession, source_rows(observations)
    rows.write.csv(path + "-parts", escape='"')
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    parts = hadoop.fs.Path(path + "-parts/part-*")
    fs = parts.getFileSystem(conf)
    out = fs.create(hadoop.fs.Path(path + "/part-00000.csv"))
    out.write(bytearray((",".join(rows.columns) + "\n").encode()))
    for part in fs.globStatus(parts):
        source = fs.open(part.getPath())
        hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
        source.close()
    out.close()
    dropped(spark, path + "-parts")


def read_concept_details(spark: SparkSession, path: str) -> DataFrame:
    """Optional descriptions of concepts: (concept_path, display, dataset, description, drs_uri array<string>), one JSON object a line."""
    return spark.read.schema("concept_path string, display string, dataset string, description string, drs_uri array<string>").json(path)
