"""The query model: what a cohort query says, read from and written to JSON.

The current generation is a tree of clauses under AND/OR with authorization filters. The older, flat generation is read into
``FlatQuery`` and compiled into the tree; what differs between them in meaning is kept as fields of ``Query``.
"""

from __future__ import annotations

import json
import uuid
from collections import Counter
from dataclasses import dataclass, field
from enum import Enum

from strandline.functions.variants import is_variant_spec


class ResultType(str, Enum):
    COUNT = "COUNT"
    DATAFRAME = "DATAFRAME"
    SECRET_ADMIN_DATAFRAME = "SECRET_ADMIN_DATAFRAME"
    CROSS_COUNT = "CROSS_COUNT"
    CATEGORICAL_CROSS_COUNT = "CATEGORICAL_CROSS_COUNT"
    CONTINUOUS_CROSS_COUNT = "CONTINUOUS_CROSS_COUNT"
    INFO_COLUMN_LISTING = "INFO_COLUMN_LISTING"
    OBSERVATION_CROSS_COUNT = "OBSERVATION_CROSS_COUNT"
    VARIANT_COUNT_FOR_QUERY = "VARIANT_COUNT_FOR_QUERY"
    VARIANT_LIST_FOR_QUERY = "VARIANT_LIST_FOR_QUERY"
    VCF_EXCERPT = "VCF_EXCERPT"
    AGGREGATE_VCF_EXCERPT = "AGGREGATE_VCF_EXCERPT"
    DATAFRAME_TIMESERIES = "DATAFRAME_TIMESERIES"
    DATAFRAME_PFB = "DATAFRAME_PFB"
    PATIENTS = "PATIENTS"


REQUIRED, FILTER, ANY_RECORD_OF = "REQUIRED", "FILTER", "ANY_RECORD_OF"


@dataclass(frozen=True)
class Leaf:
    """One condition on a concept: it was observed at all, has one of some values or lies in a closed range, or anything below a path was observed."""

    path: str
    kind: str = FILTER
    values: tuple[str, ...] | None = None
    low: float | None = None
    high: float | None = None
    negated: bool = False


@dataclass(frozen=True)
class Branch:
    """Clauses joined by AND or OR."""

    operator: str
    clauses: tuple[Leaf | Branch, ...]
    negated: bool = False


@dataclass(frozen=True)
class GenomicFilter:
    """Values or a closed range of an INFO column, or zygosities of a variant spec."""

    key: str
    values: tuple[str, ...] | None = None
    low: float | None = None
    high: float | None = None

    @property
    def is_spec(self) -> bool:
        return is_variant_spec(self.key)


@dataclass(frozen=True)
class Query:
    """``info_groups`` are sets of INFO conditions; a group's conditions hold on one variant. Groups are intersected as patients
    and united as variants. The tree form has one group at most."""

    select: tuple[str, ...] = ()
    authorization: tuple[tuple[str, tuple[str, ...]], ...] = ()
    clause: Leaf | Branch | None = None
    specs: tuple[GenomicFilter, ...] = ()
    info_groups: tuple[tuple[GenomicFilter, ...], ...] = ()
    result: ResultType = ResultType.COUNT
    flat: bool = False
    id: str | None = None
    external_id: str | None = None

    def leaves(self) -> list[Leaf]:
        """Leaves of the clause (authorization left out), left to right."""
        out, todo = [], [self.clause] if self.clause else []
        while todo:
            c = todo.pop(0)
            if isinstance(c, Leaf):
                out.append(c)
            else:
                todo = list(c.clauses) + todo
        return out

    def has_genomics(self) -> bool:
        return bool(self.specs or self.info_groups)

    def name(self) -> str:
        """A stable id made from what the query says."""
        return str(uuid.uuid5(uuid.NAMESPACE_OID, json.dumps(to_json(self), sort_keys=True)))


def _texts(x) -> tuple[str, ...] | None:
    return None if x is None else tuple(x)


def clause_from(x: dict | None) -> Leaf | Branch | None:
    """A clause's kind is told by its fields: one with sub-clauses is a branch."""
    if x is None:
        return None
    if "phenotypicClauses" in x or "operator" in x:
        return Branch(x.get("operator", "AND"), tuple(clause_from(c) for c in x.get("phenotypicClauses") or ()), bool(x.get("not")))
    return Leaf(x["conceptPath"], x["phenotypicFilterType"], _texts(x.get("values")), x.get("min"), x.get("max"), bool(x.get("not")))


def from_json(x: dict | str) -> Query:
    x = json.loads(x) if isinstance(x, str) else x
    genomic = [GenomicFilter(g["key"], _texts(g.get("values")), g.get("min"), g.get("max")) for g in x.get("genomicFilters") or ()]
    info = tuple(g for g in genomic if not g.is_spec)
    return Query(
        select=tuple(x.get("select") or ()),
        authorization=tuple((a["conceptPath"], tuple(a["values"])) for a in x.get("authorizationFilters") or ()),
        clause=clause_from(x.get("phenotypicClause")),
        specs=tuple(g for g in genomic if g.is_spec),
        info_groups=(info,) if info else (),
        result=ResultType(x.get("expectedResultType") or "COUNT"),
        id=x.get("id"),
        external_id=x.get("externalId"),
    )


def _clause_json(c: Leaf | Branch | None) -> dict | None:
    if c is None:
        return None
    if isinstance(c, Branch):
        return {"operator": c.operator, "phenotypicClauses": [_clause_json(y) for y in c.clauses], "not": c.negated}
    return {"conceptPath": c.path, "phenotypicFilterType": c.kind, "values": c.values, "min": c.low, "max": c.high, "not": c.negated}


def to_json(q: Query) -> dict:
    return {
        "select": list(q.select),
        "authorizationFilters": [{"conceptPath": p, "values": list(v)} for p, v in q.authorization],
        "phenotypicClause": _clause_json(q.clause),
        "genomicFilters": [{"key": g.key, "values": g.values, "min": g.low, "max": g.high} for group in (q.specs, *q.info_groups) for g in group],
        "expectedResultType": q.result.value,
        "externalId": q.external_id,
        "id": q.id,
    }


@dataclass
class FlatQuery:
    """The older generation: lists of conditions, all of them ANDed."""

    result: ResultType = ResultType.COUNT
    cross_count_fields: list[str] = field(default_factory=list)
    fields: list[str] = field(default_factory=list)
    required: list[str] = field(default_factory=list)
    any_record_of: list[list[str]] = field(default_factory=list)
    numeric: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    category: dict[str, list[str]] = field(default_factory=dict)
    info: list[list[GenomicFilter]] = field(default_factory=list)
    id: str | None = None

    @staticmethod
    def from_json(x: dict | str) -> FlatQuery:
        x = json.loads(x) if isinstance(x, str) else x
        any_of = [list(x["anyRecordOf"])] if x.get("anyRecordOf") else []
        groups = []
        for g in x.get("variantInfoFilters") or ():
            own = [GenomicFilter(k, tuple(v)) for k, v in (g.get("categoryVariantInfoFilters") or {}).items()]
            own += [GenomicFilter(k, None, v.get("min"), v.get("max")) for k, v in (g.get("numericVariantInfoFilters") or {}).items()]
            if own:
                groups.append(own)
        return FlatQuery(
            ResultType(x.get("expectedResultType") or "COUNT"), list(x.get("crossCountFields") or ()), list(x.get("fields") or ()), list(x.get("requiredFields") or ()),
            any_of + [list(a) for a in x.get("anyRecordOfMulti") or () if a], {k: (v.get("min"), v.get("max")) for k, v in (x.get("numericFilters") or {}).items()},
            {k: list(v) for k, v in (x.get("categoryFilters") or {}).items()}, groups, x.get("id"),
        )

    def all_fields(self) -> list[str]:
        """Selected fields with the filters' paths put in, in order; variant specs stay (a first-value export shows them)."""
        more = [*self.fields, *self.required, *(p for a in self.any_record_of for p in a), *self.numeric, *self.category]
        return sorted(dict.fromkeys(more))

    def compile(self) -> Query:
        for paths in self.any_record_of:
            if any(is_variant_spec(p) for p in paths):
                raise ValueError("a variant can't stand in an any-record-of list")
        leaves: list[Leaf | Branch] = [Leaf(p, REQUIRED) for p in self.required if not is_variant_spec(p)]
        leaves += [Branch("OR", tuple(Leaf(p, REQUIRED) for p in a)) for a in self.any_record_of]
        leaves += [Leaf(p, FILTER, None, lo, hi) for p, (lo, hi) in self.numeric.items()]
        leaves += [Leaf(p, FILTER, tuple(v)) for p, v in self.category.items() if not is_variant_spec(p)]
        specs = [GenomicFilter(p, ("0/1", "1/1")) for p in self.required if is_variant_spec(p)]
        specs += [GenomicFilter(p, tuple(v)) for p, v in self.category.items() if is_variant_spec(p)]
        counts = self.result in (ResultType.CROSS_COUNT, ResultType.OBSERVATION_CROSS_COUNT)
        return Query(
            select=tuple(self.cross_count_fields if counts else self.all_fields()),
            clause=Branch("AND", tuple(leaves)) if leaves else None,
            specs=tuple(specs),
            info_groups=tuple(tuple(g) for g in self.info),
            result=self.result,
            flat=True,
            id=self.id,
        )

    def describe(self) -> str:
        """Readable text; long lists of paths are summed up by their first level."""

        def rolled(paths: list[str]) -> str:
            if len(paths) <= 5:
                return "[" + ", ".join(paths) + "]"
            tops = Counter(p.strip("\\").split("\\")[0] for p in paths)
            return "[\n" + "".join(f"\t{n} values under {top}\n" for top, n in sorted(tops.items())) + "]"

        out = [f"Query of type {self.result.value}" + (f" with ID {self.id}" if self.id else " (no ID assigned)")]
        if self.result is ResultType.INFO_COLUMN_LISTING:
            return out[0] + "\n"
        titled = {
            ResultType.CROSS_COUNT: [("Cross Count Fields", self.cross_count_fields)],
            ResultType.CATEGORICAL_CROSS_COUNT: [("Categorical Cross Count Fields", [f"{k}={v}" for k, v in self.category.items()])],
            ResultType.CONTINUOUS_CROSS_COUNT: [("Continuous Cross Count Fields", [f"{k}={v}" for k, v in self.numeric.items()])],
            ResultType.DATAFRAME_TIMESERIES: [("Data Export Fields", x) for x in (self.fields, self.required, [p for a in self.any_record_of for p in a], list(self.numeric), list(self.category))],
        }
        if self.result in (ResultType.DATAFRAME, ResultType.SECRET_ADMIN_DATAFRAME, ResultType.PATIENTS):
            titled[self.result] = [("Data Export Fields", self.fields)]
        out += [f"{t}: {rolled(p)}" for t, p in titled.get(self.result, [])]
        out.append("Required Fields: [" + ", ".join(self.required) + "]")
        if self.numeric:
            out.append("Numeric filters: [" + ", ".join(f"{k}: {lo} to {hi}" for k, (lo, hi) in self.numeric.items()) + "]")
        if self.category:
            out.append("Category filters: [" + ", ".join(f"{k}: {{{', '.join(v)}}}" for k, v in self.category.items()) + "]")
        out.append("Variant Info filters: [" + ", ".join(" and ".join(f"{g.key}: {g.values or (g.low, g.high)}" for g in group) for group in self.info) + "]")
        out.append("Any-Record-Of filters: " + rolled([p for a in self.any_record_of for p in a]))
        return "\n".join(out) + "\n"
