"""Variant specs, genotype classes and INFO strings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("chrom", "pos", "ref", "alt", "gene", "consequence")
_SHORT = re.compile(r"[^,]*,[0-9.\\]+,[CATGcatg]*,[CATGcatg]*")
_LONG = re.compile(_SHORT.pattern + r",\w*,\w*")
HET, HOM, HET_NO_CALL, HOM_NO_CALL = "0/1", "1/1", "./1", "./."


def is_variant_spec(key: str) -> bool:
    """Whether a filter's key names a variant, by rs number or by place and alleles, rather than a concept or an INFO column."""
    return bool(re.fullmatch(r"rs[0-9]+.*", key) or _SHORT.fullmatch(key) or _LONG.fullmatch(key))


def names_variant(key: Column) -> Column:
    """:func:`is_variant_spec` of a column."""
    return key.rlike(rf"^(?:rs[0-9]+.*|{_SHORT.pattern}|{_LONG.pattern})$")


def spec_fields(key: str) -> dict[str, str]:
    """Fields of a four- or six-field spec. An rs number can't be looked up, as no table holds them."""
    if key.startswith("rs"):
        raise ValueError(f"rs numbers aren't indexed: {key}")
    return dict(zip(FIELDS, key.split(",")))


def spec_column(chrom: Column, pos: Column, ref: Column, alt: Column, gene: Column, consequence: Column) -> Column:
    return F.concat_ws(",", chrom, pos.cast("string"), ref, alt, F.coalesce(gene, F.lit("NULL")), F.coalesce(consequence, F.lit("NULL")))


def parsed_spec(spec: Column) -> list[Column]:
    parts = F.split(spec, ",")
    return [(parts[i].cast("int") if name == "pos" else parts[i]).alias(name) for i, name in enumerate(FIELDS)]


def info_map(info: Column) -> Column:
    return F.str_to_map(info, F.lit(";"), F.lit("="))


def genotype_class(gt: Column) -> Column:
    """Class of a GT entry by the character sum of its first three signs modulo 7, as VCF's 0, 1, '.', '/' and '|' make it unambiguous:
    heterozygous, homozygous, the two no-calls, or null for reference. A second alternative allele counts by the same sum."""
    codes = [F.ascii(F.substring(gt, i, 1)) for i in (1, 2, 3)]
    # a phased genotype stands for the unphased one
    middle = F.when(F.substring(gt, 2, 1) == "|", F.lit(ord("/"))).otherwise(codes[1])
    slot = (codes[0] + middle + codes[2]) % 7
    return F.when(slot == 4, HET).when(slot == 5, HOM).when(slot.isin(1, 2), HET_NO_CALL).when(slot == 6, HOM_NO_CALL)


def exploded_info(rows: DataFrame, key: str = "variant_id", info: str = "info") -> DataFrame:
    """(variant id, info_key, info_value) of each ``key=value``; parts end at a semicolon or ampersand, so of ``k=a&b`` only ``a`` keeps its key.
    PU and IPU are left out."""
    part = rows.select(key, F.explode(F.split(info, "[;&]")).alias("part")).where(F.col("part").contains("="))
    out = part.select(key, F.substring_index("part", "=", 1).alias("info_key"), F.expr("substring(part, instr(part, '=') + 1)").alias("info_value"))
    return out.where(~F.col("info_key").isin("PU", "IPU") & (F.col("info_value") != ""))


def numeric_columns(info: DataFrame) -> DataFrame:
    """(info_key, continuous): a column is numeric when more than half of its distinct values, or more than 10,000 of them, hold numbers only, and at most one holds none.
    Commas part several numbers; a lone dot is a missing one."""
    value = info.select("info_key", "info_value").distinct()
    parts = F.filter(F.split("info_value", ","), lambda x: x != ".")
    good = (F.size(parts) > 0) & F.forall(parts, lambda x: x.try_cast("double").isNotNull())
    return value.groupBy("info_key").agg((((F.sum(good.cast("int")) * 2 > F.count("*")) | (F.sum(good.cast("int")) > 10_000)) & (F.sum((~good).cast("int")) <= 1)).alias("continuous"))


def with_numbers(info: DataFrame, columns: DataFrame) -> DataFrame:
    """``info`` with info_num (32 bits): values of numeric columns are split at commas, one row a number."""
    tagged = info.join(columns.select("info_key", "continuous"), "info_key", "left")
    split = tagged.withColumn("one", F.explode(F.when(F.col("continuous"), F.split("info_value", ",")).otherwise(F.array("info_value"))))
    number = F.when(F.col("continuous"), F.col("one").try_cast("float"))
    return split.where(~F.col("continuous") | (F.col("one") != ".")).select("variant_id", "info_key", F.col("one").alias("info_value"), number.alias("info_num"))
