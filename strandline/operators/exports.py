"""Row exports of a cohort's observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.observations import iso_instant
from strandline.functions.variants import HET, HOM, is_variant_spec
from strandline.model import ANY_RECORD_OF, Query
from strandline.operators import genomic
from strandline.operators.cohort import authorization_leaves, cohort
from strandline.schema import Dataset


def patients(ds: Dataset, q: Query) -> DataFrame:
    """(PATIENT_NUM)"""
    return cohort(ds, q).select(F.col("patient_num").alias("PATIENT_NUM"))


def _column(i: int) -> str:
    return f"c{i}"


def _pivoted(ds: Dataset, people: DataFrame, paths: list[str], value, one) -> DataFrame:
    """One row a patient, a column c0, c1 ... for each path, by conditional aggregates in a single pass."""
    known = list(dict.fromkeys(paths))
    rows = ds.observations.where(F.col("concept_path").isin(known)).join(people, "patient_num", "left_semi")
    wide = rows.groupBy("patient_num").agg(F.lit(0).alias("__none"), *(one(F.when(F.col("concept_path") == p, value)).alias(_column(i)) for i, p in enumerate(known)))
    return people.join(wide, "patient_num", "left")


def multi_value(ds: Dataset, q: Query) -> DataFrame:
    """patient_id and one array<string> column a selected path (columns bear the paths): all values in load order, numbers in their shortest form
    with a fraction. Unknown paths and missing values are empty arrays."""
    people, paths = cohort(ds, q), list(q.select)
    item = F.struct("seq", F.coalesce(F.col("nval").cast("string"), F.col("tval")).alias("v"))
    wide = _pivoted(ds, people, paths, item, F.collect_list)
    known = list(dict.fromkeys(paths))
    empty = F.array().cast("array<string>")
    cells = [F.coalesce(F.transform(F.array_sort(_column(known.index(p))), lambda x: x["v"]), empty).alias(p) for p in paths]
    return wide.select(F.col("patient_num").alias("patient_id"), *cells)


def multi_value_text(ds: Dataset, q: Query) -> DataFrame:
    """The same as a text table: values joined by tabs."""
    wide = multi_value(ds, q)
    names = [f"v{i}" for i in range(len(wide.columns) - 1)]
    return wide.toDF("patient_id", *names).select(F.col("patient_id").cast("string").alias("patient_id"), *(F.array_join(n, "\t").alias(p) for n, p in zip(names, wide.columns[1:])))


def first_value(ds: Dataset, q: Query, concepts: DataFrame | None = None) -> DataFrame:
    """``Patient ID`` and the first value of each selected concept: a missing number is NaN, a missing text is empty. A column named by a variant spec shows 0/1, 1/1 or 0/0."""
    people = cohort(ds, q)
    paths = [p for p in q.select if not is_variant_spec(p)]
    item = F.struct("seq", "nval", F.trim("tval").alias("tval"))
    wide = _pivoted(ds, people, paths, item, F.min)
    from strandline.operators.validate import kinds

    known = list(dict.fromkeys(paths))
    if concepts is None:
        concepts = ds.concepts if ds.concepts is not None else ds.with_tables(observations=ds.observations.where(F.col("concept_path").isin(known))).dictionary()
    types = kinds(concepts, known) if known else {}
    for spec in (p for p in dict.fromkeys(q.select) if is_variant_spec(p)):
        gt = genomic.at_spec(ds, spec).genotypes.join(genomic.variants_named(ds, spec).select("variant_id"), "variant_id", "left_semi").where(F.col("zygosity").isin(HET, HOM))
        wide = wide.join(gt.groupBy("patient_num").agg(F.max("zygosity").alias("spec:" + spec)), "patient_num", "left")
    cells = []
    for p in q.select:
        if is_variant_spec(p):
            cells.append(F.coalesce(F.col(f"`spec:{p}`"), F.lit("0/0")).alias(p))
        elif p in types and not types[p]:
            cells.append(F.coalesce(F.col(_column(known.index(p)))["nval"], F.lit(float("nan"))).alias(p))
        else:
            cells.append(F.coalesce(F.col(_column(known.index(p)))["tval"], F.lit("")).alias(p))
    return wide.select(F.col("patient_num").alias("Patient ID"), *cells)


def by_value(rows: DataFrame) -> DataFrame:
    """Observations by number or, where there is none, text; a missing value comes first, and equal ones stay in load order."""
    return rows.orderBy(F.col("concept_path"), F.asc_nulls_first("nval"), F.asc_nulls_first("tval"), "patient_num", "seq")


def by_time(rows: DataFrame) -> DataFrame:
    """Observations by time stamp; those without one come first, and equal ones stay in load order."""
    return rows.orderBy(F.col("concept_path"), F.asc_nulls_first("ts_ms"), "patient_num", "seq")


def by_patient(rows: DataFrame) -> DataFrame:
    """Observations by patient, each one's in load order."""
    return rows.orderBy("concept_path", "patient_num", "seq")


def timeseries(ds: Dataset, q: Query) -> DataFrame:
    """One row an observation of the cohort in every selected or filtered concept; an any-record-of filter stands for all concepts below it."""
    exact = set(q.select)
    below = []
    for x in [*authorization_leaves(q), *q.leaves()]:
        (below.append if x.kind == ANY_RECORD_OF else exact.add)(x.path)
    wanted = F.col("concept_path").isin(sorted(exact))
    for p in below:
        wanted |= F.col("concept_path").startswith(p)
    rows = ds.observations.where(wanted).join(cohort(ds, q), "patient_num", "left_semi")
    return rows.select(
        F.col("patient_num").alias("PATIENT_NUM"), F.col("concept_path").alias("CONCEPT_PATH"), F.col("nval").alias("NVAL_NUM"),
        F.coalesce("tval", F.lit("")).alias("TVAL_CHAR"), iso_instant(F.col("ts_ms")).alias("TIMESTAMP"),
    )
