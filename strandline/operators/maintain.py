"""Dataset maintenance: merging, re-keying and editing datasets. Each gives new tables; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.variants import FIELDS, exploded_info, numeric_columns, with_numbers
from strandline.schema import Dataset
from strandline.sources.scratch import written


def append_patients(a: DataFrame, b: DataFrame) -> DataFrame:
    """Genotypes of disjoint sets of patients, one after the other."""
    return a.unionByName(b)


def union_contigs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Genotypes of different contigs over the same patients."""
    return a.unionByName(b).distinct()


def merge_genomic(a: Dataset, b: Dataset) -> Dataset:
    """One dataset of two with disjoint patients and the same contigs: variants are matched by spec and numbered anew, genotypes of both are appended and
    INFO values united. Raises where the patients overlap or the contigs differ."""
    if a.genotypes.select("patient_num").distinct().join(b.genotypes.select("patient_num").distinct(), "patient_num").limit(1).count():
        raise ValueError("the datasets share patients")
    contigs = [d.variants.select("chrom").distinct() for d in (a, b)]
    if contigs[0].exceptAll(contigs[1]).limit(1).count() or contigs[1].exceptAll(contigs[0]).limit(1).count():
        raise ValueError("the datasets have different contigs")
    variants = number_variants(a.variants.unionByName(b.variants).dropDuplicates(["spec"]))
    ids = variants.select("spec", F.col("variant_id").alias("new_id"))

    def renumbered(d: Dataset, table: DataFrame) -> DataFrame:
        own = d.variants.select("variant_id", "spec").join(ids, "spec").select("variant_id", "new_id")
        return table.join(own, "variant_id").withColumn("variant_id", F.col("new_id")).drop("new_id")

    columns = a.info_columns.unionByName(b.info_columns).groupBy("info_key").agg(F.first("description").alias("description"), F.bool_and("continuous").alias("continuous"), F.min("min").alias("min"), F.max("max").alias("max"))
    return a.with_tables(
        observations=a.observations.unionByName(b.observations), variants=variants, genotypes=append_patients(renumbered(a, a.genotypes), renumbered(b, b.genotypes)),
        variant_info=renumbered(a, a.variant_info).unionByName(renumbered(b, b.variant_info)).distinct(), info_columns=columns,
        variant_metadata=merge_metadata(a.variant_metadata, b.variant_metadata) if a.variant_metadata is not None and b.variant_metadata is not None else a.variant_metadata,
    )


def numbered(ordered: DataFrame, column: str) -> DataFrame:
    """Rows numbered from 0 in the order they have, partition after partition, without bringing them to one task."""
    # the place's upper bits are the partition, the lower ones the row in it; it is stored with the row, so that a partition made again can't be numbered otherwise
    kept = [c for c in ordered.columns if c != column]
    at, part, base = (next(n for n in (f"_{w}{k}" for k in range(len(kept) + 1)) if n not in kept) for w in ("at", "part", "base"))
    placed = written(ordered.sparkSession, ordered.drop(column).withColumn(at, F.monotonically_increasing_id()), "numbered").withColumn(part, F.shiftright(at, 33))
    sizes = placed.groupBy(part).agg(F.count("*").alias("n"))
    before = sizes.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias(base))  # one row a partition
    return placed.join(before, part).withColumn(column, F.col(base) + F.col(at) % (1 << 33)).drop(at, part, base)


def number_variants(variants: DataFrame) -> DataFrame:
    """Dense ids from 0 in variant order. Variants are sorted in ranges, which may cut a contig anywhere, and stored; each range is then numbered from the number of variants before it."""
    ranges = variants.repartitionByRange(*FIELDS).sortWithinPartitions(*FIELDS)
    return numbered(ranges, "variant_id").withColumn("variant_id", F.col("variant_id").cast("int")).select(variants.columns)


def contig_order(rows: DataFrame, place: str = "seq") -> DataFrame:
    """(chrom, rank) of contigs in the order in which ``rows`` first has them by ``place``, from 0."""
    first = rows.groupBy("chrom").agg(F.min(place).alias("first"))
    return first.select("chrom", (F.row_number().over(Window.orderBy("first", "chrom")) - 1).alias("rank"))  # one row a contig


def rebuilt_info(ds: Dataset) -> Dataset:
    """The INFO tables made anew from the stored metadata: values exploded, column types inferred and ranges taken again; descriptions stay."""
    raw = ds.variant_metadata.select("spec", F.explode("info_raw").alias("info")).join(ds.variants.select("spec", "variant_id"), "spec").select("variant_id", "info")
    info = exploded_info(raw).distinct()
    kinds = numeric_columns(info)
    numbered = with_numbers(info, kinds)
    ranges = numbered.groupBy("info_key").agg(F.min("info_num").alias("min"), F.max("info_num").alias("max"))
    described = ds.info_columns.select("info_key", "description")
    columns = kinds.join(described, "info_key", "left").join(ranges, "info_key").select("info_key", "description", "continuous", "min", "max")
    return ds.with_tables(variant_info=numbered, info_columns=columns)


def merge_metadata(a: DataFrame, b: DataFrame) -> DataFrame:
    """Metadata of both; where both have a spec, the second's."""
    return b.unionByName(a.join(b.select("spec"), "spec", "left_anti"))


def united_metadata(a: DataFrame, b: DataFrame) -> DataFrame:
    """Metadata of both; where both have a spec, the INFO strings of either."""
    entry = a.unionByName(b).select("spec", "chrom", "bucket", F.explode_outer("info_raw").alias("raw"))
    return entry.groupBy("spec", "chrom", "bucket").agg(F.array_sort(F.collect_set("raw")).alias("info_raw"))


def remap_patients(table: DataFrame, mapping: DataFrame, strict: bool = False) -> DataFrame:
    """patient_num by ``mapping(old_id, new_id)``. Patients without a mapping keep their id, or raise if ``strict`` (as genotypes need)."""
    joined = table.join(mapping.select("old_id", "new_id"), table["patient_num"] == F.col("old_id"), "left")
    new = F.col("new_id")
    new = F.when(new.isNull(), F.raise_error(F.concat(F.lit("no mapping for patient "), F.col("patient_num").cast("string"))).cast("int")).otherwise(new) if strict else F.coalesce(new, "patient_num")
    return joined.withColumn("patient_num", new.cast("int")).select(table.columns)


def remove_concepts(observations: DataFrame, paths: DataFrame) -> DataFrame:
    """Observations without those of the listed concepts (``concept_path``)."""
    return observations.join(paths.select("concept_path"), "concept_path", "left_anti").select(observations.columns)


def rename_category(observations: DataFrame, path: str, old: str, new: str) -> DataFrame:
    here = (F.col("concept_path") == path) & (F.col("tval") == old)
    return observations.withColumn("tval", F.when(here, F.lit(new)).otherwise(F.col("tval")))


def merge_sibling_concepts(observations: DataFrame) -> DataFrame:
    """Concepts whose last segment ends in a slash are folded into the concept of the same path without it."""
    return observations.withColumn("concept_path", F.regexp_replace("concept_path", r"/\\$", r"\\"))


def hide_info_value(variant_info: DataFrame, key: str, value: str) -> DataFrame:
    return variant_info.where(~((F.col("info_key") == key) & (F.col("info_value") == value)))


def source_rows(observations: DataFrame) -> DataFrame:
    """The dataset as load files have it."""
    return observations.select(F.col("patient_num").alias("PATIENT_NUM"), F.col("concept_path").alias("CONCEPT_PATH"), F.col("nval").alias("NUMERIC_VALUE"), F.col("tval").alias("TEXT_VALUE"), F.col("ts_ms").alias("DATETIME"))


class Keys:
    """Keys by name, read from files of hexadecimal digits or given as bytes; the one called ``default`` is used where none is named."""

    def __init__(self, **keys: bytes) -> None:
        self.keys = dict(keys)

    def read(self, name: str, path: str) -> None:
        with open(path) as f:
            self.keys[name] = bytes.fromhex(f.read().strip())

    def __getitem__(self, name: str) -> bytes:
        if name not in self.keys:
            raise KeyError(f"no key named {name}")
        return self.keys[name]


def _key(key: bytes | Keys) -> bytes:
    return key["default"] if isinstance(key, Keys) else key


def encrypted(table: DataFrame, columns: list[str], key: bytes | Keys) -> DataFrame:
    """Columns sealed with AES-GCM: the vector's length as four bytes, a random vector of 12 bytes, the text, the tag."""
    length = F.lit(bytes([0, 0, 0, 12]))
    return table.withColumns({c: F.concat(length, F.aes_encrypt(F.col(c).cast("string"), F.lit(_key(key)), F.lit("GCM"))) for c in columns})


def decrypted(table: DataFrame, columns: dict[str, str], key: bytes | Keys) -> DataFrame:
    """Sealed columns opened; columns: name -> type."""
    return table.withColumns({c: F.aes_decrypt(F.substring(F.col(c), 5, 1 << 30), F.lit(_key(key)), F.lit("GCM")).cast("string").cast(t) for c, t in columns.items()})


def rekeyed(table: DataFrame, columns: dict[str, str], old: bytes | Keys, new: bytes | Keys) -> DataFrame:
    return encrypted(decrypted(table, columns, old), list(columns), new)
