"""Variant sets and the patients that carry them."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.variants import HET, HET_NO_CALL, HOM, spec_fields
from strandline.model import GenomicFilter, Query
from strandline.schema import BUCKET, Dataset


def info_condition(g: GenomicFilter) -> Column:
    """Rows of variant_info that satisfy a filter; bounds are compared in 32 bits, as the column is."""
    here = F.col("info_key") == g.key
    if g.values is not None:
        return here & F.col("info_value").isin(list(g.values))
    out = here & F.col("info_num").isNotNull()
    if g.low is not None:
        out &= F.col("info_num") >= F.lit(float(np.float32(g.low))).cast("float")
    if g.high is not None:
        out &= F.col("info_num") <= F.lit(float(np.float32(g.high))).cast("float")
    return out


def variants_with(ds: Dataset, group: tuple[GenomicFilter, ...]) -> DataFrame:
    """Distinct variant_id of the variants that satisfy every filter of a group, in one scan of the columns named."""
    tests = [info_condition(g) for g in group]
    rows = ds.variant_info.where(reduce(lambda a, b: a | b, tests))
    if len(tests) == 1:
        return rows.select("variant_id").distinct()
    folded = rows.groupBy("variant_id").agg(*(F.bool_or(F.coalesce(t, F.lit(False))).alias(f"f{i}") for i, t in enumerate(tests)))
    return folded.where(reduce(lambda a, b: a & b, [F.col(f"f{i}") for i in range(len(tests))])).select("variant_id")


def variants_named(ds: Dataset, key: str) -> DataFrame:
    """Variants of a spec: all that agree in its four or six fields; the scan is pruned by contig and bucket."""
    f = spec_fields(key)
    pos = int(float(f["pos"]))
    out = ds.variants.where((F.col("chrom") == f["chrom"]) & (F.col("bucket") == pos // BUCKET) & (F.col("pos") == pos) & (F.col("ref") == f["ref"]) & (F.col("alt") == f["alt"]))
    if "gene" in f:
        out = out.where((F.col("gene") == f["gene"]) & (F.col("consequence") == f["consequence"]))
    return out


def carriers(ds: Dataset, variants: DataFrame, zygosities: tuple[str, ...] = (HET, HOM)) -> DataFrame:
    """Distinct patient_num with one of these variants in one of these zygosities."""
    rows = ds.genotypes.where(F.col("zygosity").isin(list(zygosities)))
    return rows.join(variants.select("variant_id"), "variant_id", "left_semi").select("patient_num").distinct()


def at_spec(ds: Dataset, key: str) -> Dataset:
    """The dataset with the genotypes of one spec's contig and bucket only: a scan of one folder's few row groups."""
    f = spec_fields(key)
    here = (F.col("chrom") == f["chrom"]) & (F.col("bucket") == int(float(f["pos"])) // BUCKET)
    return replace(ds, genotypes=ds.genotypes.where(here))


def zygosities_of(g: GenomicFilter) -> tuple[str, ...]:
    """An empty entry means both; the reference genotype adds nobody."""
    if g.values is None:
        return HET, HOM
    return tuple(z for z in (HET, HOM) if z in g.values or "" in g.values)


def patient_sets(ds: Dataset, q: Query) -> list[DataFrame]:
    """A set of patients for each genomic condition, all of which a cohort must be in."""
    named = [carriers(at_spec(ds, g.key), variants_named(ds, g.key), zygosities_of(g)) for g in q.specs]
    return named + [carriers(ds, variants_with(ds, group)) for group in q.info_groups]


def bucket_index(ds: Dataset) -> DataFrame:
    """(patient_num, chrom, bucket) of every bucket where a patient has any variant, heterozygous no-calls included."""
    if ds.buckets is not None:
        return ds.buckets
    return ds.genotypes.where(F.col("zygosity").isin(HET, HOM, HET_NO_CALL)).select("patient_num", "chrom", "bucket").distinct()


def in_buckets_of(ds: Dataset, variants: DataFrame, cohort: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Variants whose bucket holds a variant of some cohort patient: a cheap superset of those the cohort carries."""
    index = bucket_index(ds) if index is None else index
    return variants.join(index.join(cohort, "patient_num", "left_semi").select("chrom", "bucket").distinct(), ["chrom", "bucket"], "left_semi")


def variant_list(ds: Dataset, q: Query, cohort: DataFrame) -> DataFrame:
    """Rows of ``variants`` that satisfy some INFO group and that a cohort patient carries (a heterozygous no-call counts); none without an INFO filter."""
    if not q.info_groups:
        return ds.variants.limit(0)
    wanted = reduce(lambda a, b: a.union(b), [variants_with(ds, g) for g in q.info_groups])
    rows = ds.genotypes.where(F.col("zygosity").isin(HET, HOM, HET_NO_CALL)).join(wanted, "variant_id", "left_semi")
    carried = rows.join(cohort, "patient_num", "left_semi").select("variant_id")
    return ds.variants.join(wanted, "variant_id", "left_semi").join(carried, "variant_id", "left_semi")


# -- sets of patients as bitmaps: 32768 ids a bucket, combined and counted by Spark's bitmap aggregates


def to_bitmap(patients: DataFrame) -> DataFrame:
    """(bucket, bits) of a set of ids."""
    n = F.col("patient_num").cast("long")
    return patients.groupBy(F.bitmap_bucket_number(n).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("bits"))


def bitmap_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def bitmap_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("bucket").join(b.select("bucket"), "bucket")
    return a.unionByName(b).join(both, "bucket", "left_semi").groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"))


def bitmap_size(m: DataFrame) -> DataFrame:
    return m.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("patients"))


def bitmap_ids(m: DataFrame) -> DataFrame:
    """Ids of the set bits: byte by byte, low bit first."""
    byte = F.conv(F.substring(F.hex("bits"), F.col("i") * 2 + 1, F.lit(2)), 16, 10).cast("int")
    bytes_ = m.select("bucket", F.explode(F.sequence(F.lit(0), F.length("bits") - 1)).alias("i"), "bits").select("bucket", "i", byte.alias("byte")).where("byte <> 0")
    bits = bytes_.select("bucket", "i", "byte", F.explode(F.array(*(F.lit(k) for k in range(8)))).alias("k")).where(F.expr("(byte >> k) & 1 = 1"))
    place = F.col("i") * 8 + F.col("k")  # ids from 1 up fill buckets from 1 up; 0 and below go the other way
    return bits.select(F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * 32768 + place + 1).otherwise(F.col("bucket") * 32768 - place).cast("int").alias("patient_num"))
