"""Where results go: folders of a query's files, and a registry that says which builder answers which result type."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from strandline.model import FlatQuery, Query, ResultType
from strandline.operators import counts, exports, validate, variants
from strandline.schema import Dataset
from strandline.sources import pfb

Builder = Callable[[Dataset, Query], DataFrame]

BUILDERS: dict[ResultType, Builder] = {
    ResultType.COUNT: counts.count,
    ResultType.CROSS_COUNT: counts.cross_count,
    ResultType.OBSERVATION_CROSS_COUNT: counts.observation_cross_count,
    ResultType.CATEGORICAL_CROSS_COUNT: counts.categorical_cross_count,
    ResultType.CONTINUOUS_CROSS_COUNT: counts.continuous_cross_count,
    ResultType.VARIANT_COUNT_FOR_QUERY: counts.variant_count,
    ResultType.VARIANT_LIST_FOR_QUERY: variants.variant_list,
    ResultType.VCF_EXCERPT: variants.excerpt_wide,
    ResultType.AGGREGATE_VCF_EXCERPT: lambda ds, q: variants.excerpt_wide(ds, q, with_patients=False),
    ResultType.INFO_COLUMN_LISTING: lambda ds, q: variants.info_columns(ds),
    ResultType.DATAFRAME: exports.multi_value_text,
    ResultType.SECRET_ADMIN_DATAFRAME: exports.first_value,
    ResultType.DATAFRAME_TIMESERIES: exports.timeseries,
    ResultType.DATAFRAME_PFB: exports.multi_value,  # the rows; write_pfb makes the file
    ResultType.PATIENTS: exports.patients,
}
FLAT_BUILDERS: dict[ResultType, Callable[[Dataset, FlatQuery], DataFrame]] = {
    ResultType.CATEGORICAL_CROSS_COUNT: counts.categorical_cross_count_flat,
    ResultType.CONTINUOUS_CROSS_COUNT: counts.continuous_cross_count_flat,
}
#: Result types whose rows come in order of path, and of category or value.
SORTED = {ResultType.CROSS_COUNT, ResultType.OBSERVATION_CROSS_COUNT, ResultType.CATEGORICAL_CROSS_COUNT, ResultType.CONTINUOUS_CROSS_COUNT}
#: Result types that must be allowed by name, as they give rows of persons' variants away.
GUARDED = {ResultType.VARIANT_LIST_FOR_QUERY, ResultType.VCF_EXCERPT, ResultType.AGGREGATE_VCF_EXCERPT}


@dataclass
class Engine:
    """A dataset with its dictionary, answering queries; every path validates first."""

    ds: Dataset
    allowed: set[ResultType] = field(default_factory=set)
    _concepts: DataFrame | None = None

    @property
    def concepts(self) -> DataFrame:
        if self._concepts is None:
            self._concepts = self.ds.dictionary()
        return self._concepts

    def answer(self, q: Query | FlatQuery) -> DataFrame:
        if q.result in GUARDED and q.result not in self.allowed:
            raise PermissionError(f"{q.result.value} isn't allowed")
        if isinstance(q, FlatQuery):
            validate.validate_flat(q, self.concepts)
            if q.result in FLAT_BUILDERS:
                return counts.in_order(FLAT_BUILDERS[q.result](self.ds, q))
            q = q.compile()
        else:
            validate.validate(q, self.concepts)
        rows = BUILDERS[q.result](self.ds, q)
        return counts.in_order(rows) if q.result in SORTED else rows

    def write_pfb(self, q: Query, path: str, details: dict[str, dict] | None = None) -> None:
        """Answer a query of type DATAFRAME_PFB as what it is, one Avro file."""
        pfb.write(self.answer(replace(q, result=ResultType.DATAFRAME_PFB)), q.id or q.name(), path, details)

    def share(self, q: Query, root: str) -> dict[str, str]:
        """Write a query's files under its id: patients, phenotypic rows and, where variants are asked for and allowed, genomic rows."""
        folder = f"{root.rstrip('/')}/{q.id or q.name()}"
        out = {"patients": f"{folder}/patients", "phenotypic": f"{folder}/phenotypic_data"}
        exports.patients(self.ds, q).write.mode("overwrite").csv(out["patients"], header=False)
        exports.multi_value_text(self.ds, q).write.mode("overwrite").csv(out["phenotypic"], header=True)
        if q.info_groups and ResultType.VCF_EXCERPT in self.allowed:
            out["genomic"] = f"{folder}/genomic_data"
            variants.excerpt_long(self.ds, q).write.mode("overwrite").csv(out["genomic"], header=True, sep="\t")
        return out
