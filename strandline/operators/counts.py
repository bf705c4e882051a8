"""Counts over a cohort. Each is one grouped aggregate, however many concepts are asked for; :func:`in_order` sorts its result as the result types' maps are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.model import FILTER, REQUIRED, FlatQuery, Query
from strandline.operators import genomic
from strandline.operators.cohort import cohort
from strandline.schema import Dataset


def _listed(ds: Dataset, paths: list[str]) -> DataFrame:
    return ds.spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "concept_path string")


def _of_cohort(ds: Dataset, q: Query, paths: list[str]) -> DataFrame:
    return ds.observations.where(F.col("concept_path").isin(list(dict.fromkeys(paths)))).join(cohort(ds, q), "patient_num", "left_semi")


def count(ds: Dataset, q: Query) -> DataFrame:
    """(patients)"""
    return cohort(ds, q).agg(F.count("*").alias("patients"))


def cross_count(ds: Dataset, q: Query) -> DataFrame:
    """(concept_path, patients) of every selected path; 0 where none, or where the path is unknown."""
    found = _of_cohort(ds, q, list(q.select)).groupBy("concept_path").agg(F.countDistinct("patient_num").alias("n"))
    return _listed(ds, list(q.select)).join(found, "concept_path", "left").select("concept_path", F.coalesce("n", F.lit(0)).alias("patients"))


def observation_cross_count(ds: Dataset, q: Query) -> DataFrame:
    """(concept_path, observations) of every selected path. An unknown path is left out, or counts -1 in the flat form."""
    found = _of_cohort(ds, q, list(q.select)).groupBy("concept_path").agg(F.count("*").alias("n"))
    known = ds.observations.where(F.col("concept_path").isin(list(q.select))).select("concept_path").distinct().withColumn("known", F.lit(True))
    out = _listed(ds, list(q.select)).join(found, "concept_path", "left").join(known, "concept_path", "left")
    if not q.flat:
        out = out.where("known")
    return out.select("concept_path", F.when(F.col("known"), F.coalesce("n", F.lit(0))).otherwise(F.lit(-1)).cast("long").alias("observations"))


def categorical_cross_count(ds: Dataset, q: Query) -> DataFrame:
    """(concept_path, category, patients) for the paths with a value filter, and the categorical ones that are required: each
    category that occurs in the cohort, and those a filter names (0 if they only occur elsewhere)."""
    named: dict[str, set[str]] = {}
    for x in q.leaves():
        if x.kind == FILTER and x.values is not None or x.kind == REQUIRED:
            named.setdefault(x.path, set()).update(x.values or ())
    paths = sorted(named)
    found = _of_cohort(ds, q, paths).where("tval is not null").groupBy("concept_path", F.col("tval").alias("category")).agg(F.countDistinct("patient_num").alias("patients"))
    asked = [(p, v) for p in paths for v in sorted(named[p])]
    if not asked:
        return found
    rows = ds.spark.createDataFrame(asked, "concept_path string, category string")
    exist = ds.observations.where(F.col("concept_path").isin(paths)).select("concept_path", F.col("tval").alias("category"))
    zero = rows.join(exist, ["concept_path", "category"], "left_semi").join(found, ["concept_path", "category"], "left_anti").withColumn("patients", F.lit(0).cast("long"))
    return found.unionByName(zero)


def categorical_cross_count_flat(ds: Dataset, q: FlatQuery) -> DataFrame:
    """(concept_path, category, patients): of a required concept all categories, of a filtered one the named values, both with zeros."""
    paths = [*q.required, *q.category]
    cats = ds.observations.where(F.col("concept_path").isin(paths) & F.col("tval").isNotNull())
    listed = cats.where(F.col("concept_path").isin(q.required)).select("concept_path", F.col("tval").alias("category")).distinct()
    asked = [(p, v) for p, vs in q.category.items() for v in vs]
    if asked:
        listed = listed.unionByName(ds.spark.createDataFrame(asked, "concept_path string, category string")).distinct()
    found = cats.join(cohort(ds, q.compile()), "patient_num", "left_semi").groupBy("concept_path", F.col("tval").alias("category")).agg(F.countDistinct("patient_num").alias("n"))
    return listed.join(found, ["concept_path", "category"], "left").select("concept_path", "category", F.coalesce("n", F.lit(0)).alias("patients"))


def continuous_cross_count(ds: Dataset, q: Query) -> DataFrame:
    """(concept_path, value, observations) of the cohort, for each numeric concept in a filter; a filter's range doesn't limit the values shown."""
    paths = [x.path for x in q.leaves() if x.kind in (FILTER, REQUIRED) and x.values is None]
    rows = _of_cohort(ds, q, paths).where("nval is not null")
    return rows.groupBy("concept_path", F.col("nval").alias("value")).agg(F.count("*").alias("observations"))


def continuous_cross_count_flat(ds: Dataset, q: FlatQuery) -> DataFrame:
    """As ``continuous_cross_count``, for the numeric filters only and only with values inside each one's range."""
    out = continuous_cross_count(ds, q.compile()).where(F.col("concept_path").isin(list(q.numeric)))
    inside = F.lit(False)
    for path, (lo, hi) in q.numeric.items():
        inside |= (F.col("concept_path") == path) & (F.lit(True) if lo is None else F.col("value") >= lo) & (F.lit(True) if hi is None else F.col("value") <= hi)
    return out.where(inside)


def in_order(rows: DataFrame) -> DataFrame:
    """A count's rows by path, and by category or value where it has them."""
    return rows.orderBy(*(c for c in ("concept_path", "category", "value") if c in rows.columns))


def patient_concept_count(ds: Dataset, q: Query) -> DataFrame:
    """(concepts, patients): selected paths that exist, and the cohort's size."""
    concepts = ds.observations.where(F.col("concept_path").isin(list(q.select))).agg(F.countDistinct("concept_path").alias("concepts"))
    return concepts.crossJoin(count(ds, q))


def variant_count(ds: Dataset, q: Query) -> DataFrame:
    """(variants, message): no INFO filter gives 0 and says so."""
    if not q.info_groups:
        return ds.spark.createDataFrame([(0, "No variant filters were supplied, so no query was run.")], "variants long, message string")
    return genomic.variant_list(ds, q, cohort(ds, q)).agg(F.count("*").alias("variants")).withColumn("message", F.lit(None).cast("string"))
