"""The tables of a dataset, and the bundle the operators work on."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.observations import clean

OBSERVATIONS = "patient_num int, concept_path string, nval double, tval string, ts_ms bigint, seq bigint"
CONCEPTS = "concept_path string, categorical boolean, category_values array<string>, min double, max double, observation_count bigint, patient_count bigint, width int"
VARIANTS = "variant_id int, spec string, chrom string, pos int, ref string, alt string, gene string, consequence string, bucket int"
GENOTYPES = "variant_id int, patient_num int, zygosity string, chrom string, bucket int"
VARIANT_INFO = "variant_id int, info_key string, info_value string, info_num float"
INFO_COLUMNS = "info_key string, description string, continuous boolean, min float, max float"
VARIANT_METADATA = "spec string, chrom string, bucket int, info_raw array<string>"
BUCKETS = "patient_num int, chrom string, bucket int"
BUCKET = 1000

TABLES = {
    "observations": OBSERVATIONS, "variants": VARIANTS, "genotypes": GENOTYPES, "variant_info": VARIANT_INFO, "info_columns": INFO_COLUMNS, "variant_metadata": VARIANT_METADATA,
    "concepts": CONCEPTS, "buckets": BUCKETS,
}
#: Columns each table is partitioned by on disk, and those it is sorted by within a partition.
LAYOUT = {
    "observations": ((), ("concept_path", "patient_num", "seq")), "variants": (("chrom",), ("bucket", "pos")), "genotypes": (("chrom",), ("bucket", "variant_id", "patient_num")),
    "variant_info": (("info_key",), ("info_value", "variant_id")), "info_columns": ((), ()), "variant_metadata": (("chrom",), ("bucket", "spec")),
    "concepts": ((), ("concept_path",)), "buckets": (("chrom",), ("bucket", "patient_num")),
}


@dataclass
class Dataset:
    """Tables of one dataset; the genomic ones may be missing. The dictionary (``concepts``) and the index of each patient's ``buckets`` follow from the others, and are
    there once ``save`` has stored them."""

    observations: DataFrame
    variants: DataFrame | None = None
    genotypes: DataFrame | None = None
    variant_info: DataFrame | None = None
    info_columns: DataFrame | None = None
    variant_metadata: DataFrame | None = None
    concepts: DataFrame | None = None
    buckets: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.observations.sparkSession

    def patients(self) -> DataFrame:
        """The patient universe: every patient with an observation."""
        return self.observations.select("patient_num").distinct()

    def dictionary(self) -> DataFrame:
        """The stored dictionary; made from the observations where none is stored."""
        from strandline.operators import dictionary

        return dictionary.build(self.observations) if self.concepts is None else self.concepts

    def with_tables(self, **tables: DataFrame) -> Dataset:
        """With other tables; a stored dictionary or index that they would make untrue goes."""
        stale = {"concepts": None} if "observations" in tables else {}
        stale |= {"buckets": None} if {"genotypes", "variants"} & tables.keys() else {}
        return replace(self, **(stale | tables))


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def save(ds: Dataset, root: str, mode: str = "error") -> None:
    """Write a dataset as Parquet so that scans prune: observations are range-partitioned by concept path (row groups then carry
    tight path bounds), genomic tables are partitioned by contig or INFO column. The dictionary and the index of buckets are made here, once."""
    from strandline.operators import genomic
    from strandline.sources.scratch import dropped, folder

    staged: dict[str, DataFrame] = {}
    at = folder(ds.spark, "staged")

    def put(name: str, df: DataFrame) -> None:
        parts, order = LAYOUT[name]
        if order:
            # ranges are drawn from a sample, which runs a table's plan once more: it is staged first, and all that follows reads that
            df.write.parquet(f"{at}/{name}")
            staged[name] = df = ds.spark.read.schema(df.schema).parquet(f"{at}/{name}")
            df = df.repartitionByRange(*(parts + order)).sortWithinPartitions(*(parts + order))
        else:
            df = df.coalesce(1)
        writer = df.write.mode(mode)
        (writer.partitionBy(*parts) if parts else writer).parquet(f"{root}/{name}")

    for name in LAYOUT:
        if name not in ("concepts", "buckets") and getattr(ds, name) is not None:
            put(name, getattr(ds, name))
    own = replace(ds, **staged)
    put("concepts", own.dictionary())
    if ds.genotypes is not None and ds.variants is not None:
        put("buckets", genomic.bucket_index(own))
    dropped(ds.spark, at)


def load(spark: SparkSession, root: str) -> Dataset:
    """Read a dataset; tables that aren't there are left out. Keys of the dictionary lose the replacement character that broken encodings leave."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    there = {n for n in TABLES if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}"))}
    found = {n: spark.read.schema(TABLES[n]).parquet(f"{root}/{n}") for n in TABLES if n in there or n == "observations"}
    if "concepts" in found:
        found["concepts"] = found["concepts"].withColumn("concept_path", clean(F.col("concept_path")))
    return Dataset(**found)
