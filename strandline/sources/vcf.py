"""Variant call files: the index that lists them, and the tables made from them."""

from __future__ import annotations

import csv
import io
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import variants as fv
from strandline.operators.maintain import number_variants
from strandline.schema import BUCKET, Dataset
from strandline.sources.scratch import written

INDEX_COLUMNS = tuple("vcf_path chromosome isAnnotated isGzipped sample_ids patient_ids sample_relationship related_sample_ids".split())
GENE, CONSEQUENCE = "Gene_with_variant", "Variant_consequence_calculated"
#: Field separators are tabs; a VCF line is fixed columns and then a sample each.
FIXED = 9


@dataclass(frozen=True, order=True)
class VcfFile:
    path: str
    contig: str | None
    annotated: bool
    gzipped: bool
    samples: tuple[str, ...]
    patients: tuple[int, ...]


def parse_index(text: str) -> list[VcfFile]:
    """Lines of an index, in order of path. An error names the line, the column and the value."""

    def at(row: list[str], column: int, read):
        try:
            return read(row[column].strip())
        except (ValueError, IndexError) as e:
            shown = row[column] if column < len(row) else ""
            raise ValueError(f'bad VCF index: line {number}, column {column + 1}. Value = "{shown}"') from e

    out = []
    csv.field_size_limit(max(csv.field_size_limit(), len(text)))  # a field lists all samples of a file
    for number, row in enumerate(csv.reader(io.StringIO(text), delimiter="\t"), 1):
        if number == 1 or not row:
            continue
        ids = lambda x: tuple(p.strip() for p in x.split(","))
        file = VcfFile(
            at(row, 0, str), at(row, 1, lambda x: None if x == "ALL" else x), at(row, 2, lambda x: int(x) == 1), at(row, 3, lambda x: int(x) == 1), at(row, 4, ids),
            at(row, 5, lambda x: tuple(int(p) for p in ids(x))),
        )
        if len(file.samples) != len(file.patients):
            raise ValueError(f'bad VCF index: line {number}, column 6. Value = "{row[5]}" (not as many patients as samples)')
        out.append(file)
    return sorted(out, key=lambda f: f.path)


def build_indexes(mapping: DataFrame, ids: DataFrame, kinds: list[str], directory: str) -> DataFrame:
    """(file_group, line...) index rows from ``mapping(patient_uuid, file, kind)`` and ``ids(patient_uuid, patient_id)``: the files of a group share what is before ``.chr``."""
    file = F.element_at(F.split("file", "/"), -1)
    known = mapping.where(F.col("kind").isin(kinds)).withColumn("name", file).join(ids, "patient_uuid").select("name", "patient_uuid", "patient_id").distinct()
    pairs = known.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("patient_uuid", "patient_id"))).alias("p"))
    return pairs.select(
        F.substring_index("name", ".chr", 1).alias("file_group"), F.concat(F.lit(directory.rstrip("/") + "/"), "name").alias("vcf_path"),
        F.regexp_extract("name", r"\.chr(.*)\.vcf\.gz$", 1).alias("chromosome"), F.lit("1").alias("isAnnotated"), F.lit("1").alias("isGzipped"),
        F.array_join(F.transform("p", lambda x: x["patient_uuid"]), ",").alias("sample_ids"), F.array_join(F.transform("p", lambda x: x["patient_id"].cast("string")), ",").alias("patient_ids"),
    )


def write_index(rows: DataFrame, path: str) -> None:
    """One folder a file group, each with an index of all columns; those that aren't known are blank."""
    columns = [F.col(c) if c in rows.columns else F.lit("").alias(c) for c in INDEX_COLUMNS]
    rows.select("file_group", *columns).repartition("file_group").write.partitionBy("file_group").csv(path, sep="\t", header=True, quoteAll=True)


def _lines(spark: SparkSession, files: list[VcfFile]) -> DataFrame:
    """(value, number, annotated, contig) of every line of the files, read together; number is the file's place in the list."""
    conf = spark._jsc.hadoopConfiguration()

    def uri(path: str) -> str:
        if re.fullmatch(r"[a-z0-9]+:/[\w./=-]*", path):  # as it is written in any case
            return path
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf).makeQualified(p).toUri().toString()

    about = [(re.sub("^file:/+", "file:/", uri(f.path)), k, f.annotated, None if f.contig is None else "chr" + f.contig.removeprefix("chr")) for k, f in enumerate(files)]
    listed = spark.createDataFrame(about, "file string, number int, annotated boolean, contig string")
    lines = spark.read.text([f.path for f in files]).select("value", F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "file:/").alias("file"))
    return lines.join(F.broadcast(listed), "file").drop("file")  # one row a file


def _samples(spark: SparkSession, files: list[VcfFile], heads: DataFrame) -> DataFrame:
    """(number, at, patient_num): which column of which file is whose. Raises where a file has no column header or lacks a sample that the index names."""
    heads = heads.where(F.col("value").startswith("#CHROM"))
    there = {r["number"] for r in heads.select("number").collect()}  # one row a file
    for k, f in enumerate(files):
        if k not in there:
            raise ValueError(f"{f.path} has no column header")
    cell = F.split("value", "\t")
    columns = heads.select("number", F.posexplode(F.slice(cell, FIXED + 1, F.greatest(F.size(cell) - FIXED, F.lit(0)))).alias("at", "sample"))
    wanted = spark.createDataFrame([(k, s, p) for k, f in enumerate(files) for s, p in zip(f.samples, f.patients)], "number int, sample string, patient_num int")
    missing = wanted.join(columns, ["number", "sample"], "left_anti").orderBy("number", "sample").first()
    if missing:
        raise ValueError(f"{files[missing['number']].path} has no sample {missing['sample']}")
    return columns.join(wanted, ["number", "sample"]).select("number", "at", "patient_num")


def _described(heads: DataFrame) -> DataFrame:
    """(info_key, description) of the INFO headers; of several, the one of the last file."""
    heads = heads.where(F.col("value").startswith("##INFO=<") & F.contains(F.col("value"), F.lit("ID=")))
    key = F.rtrim(F.substring_index(F.regexp_extract("value", "ID=([^,]*)", 1), ",", 1), F.lit(">"))
    words = heads.select(key.alias("info_key"), F.regexp_extract("value", 'Description="(.*)"', 1).alias("description"), "number")
    return words.groupBy("info_key").agg(F.max_by("description", F.struct("number", "description")).alias("description"))


def read_vcf(spark: SparkSession, files: list[VcfFile], observations: DataFrame | None = None) -> Dataset:
    """The genomic tables of some files. Contigs stay apart in every table's layout, so reading all files or one contig's at a time comes to the same.

    All files are one scan, headers aside. Records are stored once as parsed, with their calls by column; samples become patients by a join on
    file and column, so neither the number of files nor that of samples is in the plan."""
    lines = _lines(spark, files)
    header = (F.col("value").startswith("#CHROM") | F.col("value").startswith("##INFO=<"))
    heads = written(spark, lines.where(header).select("number", "value"), "heads")
    samples = _samples(spark, files, heads)
    rows = lines.where(~F.col("value").startswith("#") & (F.col("value") != "")).select("number", "annotated", "contig", F.split("value", "\t").alias("c"))
    parsed = rows.select(
        "number", "annotated", "contig", F.regexp_replace(F.get("c", 0), "^(?!chr)", "chr").alias("chrom"), F.get("c", 1).cast("int").alias("pos"), F.get("c", 3).alias("ref"), F.get("c", 4).alias("alt"),
        F.get("c", 7).alias("info"), F.slice("c", FIXED + 1, F.greatest(F.size("c") - FIXED, F.lit(0))).alias("cells"),
    ).where("contig is null or chrom = contig")
    infos = fv.info_map(F.col("info"))
    named = parsed.select("*", infos[GENE].alias("gene"), infos[CONSEQUENCE].alias("consequence"), F.expr(f"pos div {BUCKET}").cast("int").alias("bucket"))
    spec = fv.spec_column(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt"), F.col("gene"), F.col("consequence"))
    placed = written(spark, named.withColumn("spec", spec), "vcf")
    blank = lambda c: F.coalesce(F.col(c), F.lit("NULL"))
    distinct = placed.select(F.lit(0).alias("variant_id"), "spec", "chrom", "pos", "ref", "alt", blank("gene").alias("gene"), blank("consequence").alias("consequence"), "bucket").dropDuplicates(["spec"])
    variants = number_variants(distinct)
    ids = variants.select("spec", "variant_id")
    # nearly all cells are the reference, which is seen by its first signs
    cells = placed.select("number", "spec", "chrom", "bucket", F.posexplode("cells").alias("at", "cell")).where(~F.col("cell").startswith("0/0"))
    calls = cells.select("number", "spec", "chrom", "bucket", "at", fv.genotype_class(F.col("cell")).alias("zygosity")).where("zygosity is not null")
    people = calls.join(samples, ["number", "at"]).select("spec", "patient_num", "zygosity", "chrom", "bucket").distinct()
    genotypes = people.join(ids, "spec").select("variant_id", "patient_num", "zygosity", "chrom", "bucket")
    annotated = placed.where("annotated").join(ids, "spec")
    info = fv.exploded_info(annotated.select("variant_id", "info").distinct()).distinct()
    numeric = fv.numeric_columns(info)
    with_numbers = fv.with_numbers(info, numeric)
    columns = numeric.join(_described(heads), "info_key", "left").join(with_numbers.groupBy("info_key").agg(F.min("info_num").alias("min"), F.max("info_num").alias("max")), "info_key").select("info_key", "description", "continuous", "min", "max")
    metadata = placed.where("annotated").groupBy("spec", "chrom", "bucket").agg(F.array_sort(F.collect_set("info")).alias("info_raw"))
    if observations is None:
        observations = genotypes.select("patient_num", F.lit("\\").alias("concept_path"), F.lit(None).cast("double").alias("nval"), F.lit(None).cast("string").alias("tval"), F.lit(None).cast("bigint").alias("ts_ms"), F.lit(0).cast("bigint").alias("seq")).distinct()
    return Dataset(observations, variants, genotypes, with_numbers, columns, metadata)
