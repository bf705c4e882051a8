"""Checks of a query, by its shape alone and against the dictionary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.variants import is_variant_spec, spec_fields
from strandline.model import ANY_RECORD_OF, FILTER, REQUIRED, Branch, FlatQuery, Leaf, Query


class InvalidQuery(ValueError):
    """The query can't be answered as it is."""


def _shape(c: Leaf | Branch) -> None:
    if c.negated:
        raise InvalidQuery("negated clauses aren't supported")
    if isinstance(c, Branch):
        if c.operator not in ("AND", "OR"):
            raise InvalidQuery(f"unknown operator {c.operator}")
        if not c.clauses:
            raise InvalidQuery("a subquery needs clauses")
        for x in c.clauses:
            _shape(x)
        return
    ranged = c.low is not None or c.high is not None
    if c.kind == FILTER:
        if c.values is not None and ranged:
            raise InvalidQuery(f"{c.path}: values and a range exclude each other")
        if c.values is None and not ranged:
            raise InvalidQuery(f"{c.path}: a filter needs values or a range")
    elif c.kind in (REQUIRED, ANY_RECORD_OF):
        if c.values is not None or ranged:
            raise InvalidQuery(f"{c.path}: {c.kind} takes neither values nor a range")
    else:
        raise InvalidQuery(f"unknown filter type {c.kind}")


def check_shape(q: Query) -> None:
    if q.clause:
        _shape(q.clause)
    for path, values in q.authorization:
        if not values:
            raise InvalidQuery(f"authorization on {path} needs values")
    for g in q.specs:
        if g.low is not None or g.high is not None:
            raise InvalidQuery(f"{g.key}: a variant takes zygosities, not a range")
        try:
            spec_fields(g.key)
        except ValueError as e:
            raise InvalidQuery(str(e)) from e
    for group in q.info_groups:
        for g in group:
            if (g.values is None) == (g.low is None and g.high is None):
                raise InvalidQuery(f"{g.key}: give values or a range")


def kinds(concepts: DataFrame, paths: list[str]) -> dict[str, bool]:
    """Whether each of these concepts is categorical; unknown ones are missing."""
    rows = concepts.where(F.col("concept_path").isin(paths)).select("concept_path", "categorical").collect()
    return {r["concept_path"]: r["categorical"] for r in rows}


def validate(q: Query, concepts: DataFrame) -> list[str]:
    """Raise InvalidQuery, or give warnings: a filter on an unknown concept matches nothing, but an authorization on one is an error."""
    check_shape(q)
    leaves = q.leaves()
    named = [x.path for x in leaves if x.kind != ANY_RECORD_OF] + [p for p, _ in q.authorization]
    known = kinds(concepts, named) if named else {}
    for path, _ in q.authorization:
        if path not in known:
            raise InvalidQuery(f"authorization on the unknown concept {path}")
        if not known[path]:
            raise InvalidQuery(f"authorization needs a categorical concept: {path}")
    for x in leaves:
        if x.kind == FILTER and x.path in known:
            if x.values is not None and not known[x.path]:
                raise InvalidQuery(f"values on the numeric concept {x.path}")
            if x.values is None and known[x.path]:
                raise InvalidQuery(f"a range on the categorical concept {x.path}")
    return [f"unknown concept {x.path}" for x in leaves if x.kind != ANY_RECORD_OF and x.path not in known]


def validate_flat(q: FlatQuery, concepts: DataFrame) -> list[str]:
    """As ``validate`` for the flat form: a filter of the wrong type is an error, missing fields are tolerated."""
    paths = [p for p in [*q.numeric, *q.category, *q.required, *q.fields] if not is_variant_spec(p)]
    known = kinds(concepts, paths) if paths else {}
    for p in q.numeric:
        if known.get(p):
            raise InvalidQuery(f"a range on the categorical concept {p}")
    for p in q.category:
        if known.get(p) is False:
            raise InvalidQuery(f"values on the numeric concept {p}")
    check_shape(q.compile())
    return [f"unknown concept {p}" for p in paths if p not in known]
