"""From a clause tree to the cohort: the patients that satisfy it.

All leaves are evaluated in one pass: observations are filtered to what any leaf asks for (so the scan is pruned to those concept paths), each
patient's leaves are folded with one conditional aggregate, and the tree is a condition on the folded row. One scan and one
partially aggregated shuffle serve any number of clauses. No leaf is negative, so a patient without a matching row is rightly absent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.model import ANY_RECORD_OF, FILTER, REQUIRED, Branch, Leaf, Query
from strandline.operators import genomic
from strandline.operators.validate import check_shape
from strandline.schema import Dataset


def leaf_condition(leaf: Leaf) -> Column:
    """The rows of observations that satisfy a leaf."""
    path = F.col("concept_path")
    if leaf.kind == ANY_RECORD_OF:
        return path.startswith(leaf.path)
    here = path == leaf.path
    if leaf.kind == REQUIRED:
        return here
    if leaf.values is not None:
        return here & F.col("tval").isin(list(leaf.values))
    out = here & F.col("nval").isNotNull()
    if leaf.low is not None:
        out &= F.col("nval") >= leaf.low
    if leaf.high is not None:
        out &= F.col("nval") <= leaf.high
    return out


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def authorization_leaves(q: Query) -> list[Leaf]:
    return [Leaf(path, FILTER, values) for path, values in q.authorization]


def phenotypic(ds: Dataset, q: Query) -> DataFrame:
    """Distinct patient_num by authorization filters and clause; without either, all patients."""
    must: list[Leaf | Branch] = [*authorization_leaves(q), *([q.clause] if q.clause else [])]
    if not must:
        return ds.patients()
    leaves: list[Leaf] = []

    def condition(c: Leaf | Branch) -> Column:
        if isinstance(c, Leaf):
            if c not in leaves:
                leaves.append(c)
            return F.col(f"leaf{leaves.index(c)}")
        parts = [condition(x) for x in c.clauses]
        return reduce((lambda a, b: a & b) if c.operator == "AND" else (lambda a, b: a | b), parts)

    tree = reduce(lambda a, b: a & b, [condition(c) for c in must])
    tests = [leaf_condition(x) for x in leaves]
    rows = ds.observations.where(_any(tests))
    if len(tests) == 1:
        return rows.select("patient_num").distinct()
    folded = rows.groupBy("patient_num").agg(*(F.bool_or(F.coalesce(t, F.lit(False))).alias(f"leaf{i}") for i, t in enumerate(tests)))
    return folded.where(tree).select("patient_num")


def cohort(ds: Dataset, q: Query) -> DataFrame:
    """Distinct patient_num of the whole query: the phenotypic part, narrowed by each genomic condition."""
    check_shape(q)
    out = phenotypic(ds, q)
    for carriers in genomic.patient_sets(ds, q):
        out = out.join(carriers, "patient_num", "left_semi")
    return out
