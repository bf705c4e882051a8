"""The concept dictionary, search and pages."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def build(observations: DataFrame) -> DataFrame:
    """One row a concept: type, sorted categories, true minimum and maximum, observations, patients, and the widest value in bytes.

    Categories and distinct patients are pre-aggregated by (concept, value) and (concept, patient), so no task holds a concept's rows."""
    by_value = observations.groupBy("concept_path", "tval").agg(
        F.count("*").alias("n"), F.min("nval").alias("lo"), F.max("nval").alias("hi"), F.max(F.octet_length("tval")).alias("w"), F.count("nval").alias("numbers")
    )
    out = by_value.groupBy("concept_path").agg(
        (F.sum("numbers") == 0).alias("categorical"), F.array_sort(F.collect_list("tval")).alias("category_values"), F.min("lo").alias("min"), F.max("hi").alias("max"),
        F.sum("n").alias("observation_count"), F.coalesce(F.max("w"), F.lit(8)).cast("int").alias("width"),
    )
    people = observations.select("concept_path", "patient_num").distinct().groupBy("concept_path").agg(F.count("*").alias("patient_count"))
    return out.join(people, "concept_path").select("concept_path", "categorical", "category_values", "min", "max", "observation_count", "patient_count", "width")


def search(concepts: DataFrame, term: str) -> DataFrame:
    """Concepts whose path holds the term, or that have a category equal to it, both without regard to case."""
    q = term.lower()
    return concepts.where(F.contains(F.lower("concept_path"), F.lit(q)) | F.array_contains(F.transform("category_values", F.lower), q))


def search_info_columns(info_columns: DataFrame, term: str) -> DataFrame:
    q = F.lit(term.lower())
    return info_columns.where(F.contains(F.lower("info_key"), q) | F.contains(F.lower(F.coalesce("description", F.lit(""))), q))


def search_info_values(variant_info: DataFrame, key: str, term: str) -> DataFrame:
    """(info_value) of one column that hold the term, without regard to case."""
    return info_values(variant_info, key).where(F.contains(F.upper("info_value"), F.lit(term.upper())))


def info_values(variant_info: DataFrame, key: str) -> DataFrame:
    return variant_info.where(F.col("info_key") == key).select("info_value").distinct()


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> tuple[DataFrame, int, int]:
    """(rows of a page counted from 1, total rows, total pages)."""
    if number < 1 or size < 1:
        raise ValueError("pages and their sizes start at 1")
    total = rows.count()
    return rows.orderBy(*order).offset((number - 1) * size).limit(size), total, math.ceil(total / size)


def totals(concepts: DataFrame) -> DataFrame:
    """(categorical, concepts, observations) of the dictionary, numeric concepts first."""
    return concepts.groupBy("categorical").agg(F.count("*").alias("concepts"), F.sum("observation_count").alias("observations"))


def flat_file(concepts: DataFrame) -> DataFrame:
    """The dictionary as an eleven-column file: categories joined by the micro sign; file offsets, which tables have no use for, are 0."""
    zero = F.lit(0).cast("long")
    return concepts.select(
        F.col("concept_path").alias("name"), F.col("width").alias("width_in_bytes"), F.lit(0).alias("column_offset"), "categorical", F.array_join("category_values", "µ").alias("category_values"),
        "min", "max", zero.alias("all_observations_offset"), zero.alias("all_observations_length"), "observation_count", "patient_count",
    )
