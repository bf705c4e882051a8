import pytest
from strandline.functions.observations import field_name, in_column_order
from strandline.functions.variants import is_variant_spec, spec_fields
from strandline.model import ANY_RECORD_OF, REQUIRED, Branch, FlatQuery, Leaf, Query, ResultType, from_json, to_json
from strandline.operators.validate import InvalidQuery, check_shape, validate, validate_flat


def test_json_round_trip():
    x = {
        "select": ["\\a\\"], "authorizationFilters": [{"conceptPath": "\\c\\", "values": ["x"]}], "expectedResultType": "CROSS_COUNT", "id": "i",
        "phenotypicClause": {"operator": "OR", "phenotypicClauses": [{"phenotypicFilterType": "FILTER", "conceptPath": "\\a\\", "min": 1, "max": None}, {"phenotypicFilterType": "ANY_RECORD_OF", "conceptPath": "\\b"}]},
        "genomicFilters": [{"key": "Gene", "values": ["G"]}, {"key": "chr1,5,A,T", "values": ["0/1"]}, {"key": "F", "min": 0.1}],
    }
    q = from_json(x)
    assert q.clause == Branch("OR", (Leaf("\\a\\", low=1), Leaf("\\b", ANY_RECORD_OF)))
    assert len(q.info_groups) == 1 and len(q.info_groups[0]) == 2 and q.specs[0].key == "chr1,5,A,T"
    assert from_json(to_json(q)) == q
    assert q.name() == from_json(to_json(q)).name() != Query().name()


@pytest.mark.parametrize("key,yes", [("rs123", True), ("chr1,55,A,T", True), ("chr1,55,A,T,GENE,missense", True), ("Gene_with_variant", False), ("\\a\\b\\", False), ("chr1,55,A", False), ("chr1,x,A,T", False)])
def test_variant_specs(key, yes):
    assert is_variant_spec(key) is yes


def test_rs_numbers_are_refused():
    with pytest.raises(ValueError):
        spec_fields("rs12")


@pytest.mark.parametrize(
    "clause",
    [Leaf("p"), Leaf("p", values=("a",), low=1), Leaf("p", REQUIRED, ("a",)), Leaf("p", ANY_RECORD_OF, None, 1), Leaf("p", "OTHER"), Branch("AND", ()), Branch("XOR", (Leaf("p", REQUIRED),)), Leaf("p", REQUIRED, negated=True)],
)
def test_bad_shapes(clause):
    with pytest.raises(InvalidQuery):
        check_shape(Query(clause=clause))


def test_against_the_dictionary(spark):
    concepts = spark.createDataFrame([("\\n\\", False), ("\\c\\", True)], "concept_path string, categorical boolean")
    assert validate(Query(clause=Leaf("\\none\\", REQUIRED)), concepts) == ["unknown concept \\none\\"]
    for q in (
        Query(clause=Leaf("\\n\\", values=("a",))), Query(clause=Leaf("\\c\\", low=1)), Query(authorization=(("\\n\\", ("a",)),)), Query(authorization=(("\\none\\", ("a",)),)), Query(authorization=(("\\c\\", ()),)),
    ):
        with pytest.raises(InvalidQuery):
            validate(q, concepts)
    with pytest.raises(InvalidQuery):
        validate_flat(FlatQuery(numeric={"\\c\\": (1, 2)}), concepts)
    with pytest.raises(InvalidQuery):
        validate_flat(FlatQuery(category={"\\n\\": ["a"]}), concepts)
    assert validate_flat(FlatQuery(fields=["\\gone\\"]), concepts) == ["unknown concept \\gone\\"]


def test_flat_queries():
    q = FlatQuery.from_json({
        "expectedResultType": "DATAFRAME", "fields": ["\\z\\"], "requiredFields": ["\\r\\", "chr1,5,A,T"], "anyRecordOf": ["\\x\\"], "anyRecordOfMulti": [["\\y\\"]], "numericFilters": {"\\n\\": {"min": 1}},
        "categoryFilters": {"\\c\\": ["v"], "chr2,6,A,T": ["1/1"]}, "variantInfoFilters": [{"categoryVariantInfoFilters": {"G": ["a"]}, "numericVariantInfoFilters": {"F": {"max": 2}}}],
    })
    c = q.compile()
    assert c.flat and [g.values for g in c.specs] == [("0/1", "1/1"), ("1/1",)] and len(c.info_groups[0]) == 2
    assert [x.path for x in c.leaves()] == ["\\r\\", "\\x\\", "\\y\\", "\\n\\", "\\c\\"]
    assert list(c.select) == sorted(c.select) and "\\z\\" in c.select
    with pytest.raises(ValueError):
        FlatQuery(any_record_of=[["chr1,5,A,T"]]).compile()


def test_description_rolls_long_lists_up():
    q = FlatQuery(ResultType.DATAFRAME, fields=[f"\\top{k % 2}\\{k}\\" for k in range(7)], id="x", category={"\\c\\": ["a", "b"]})
    text = q.describe()
    assert "with ID x" in text and "4 values under top0" in text and "3 values under top1" in text and "\\c\\: {a, b}" in text
    assert FlatQuery(ResultType.INFO_COLUMN_LISTING).describe().count("\n") == 1


def test_names_and_orders():
    assert field_name("\\a b\\1") == "_a_b_1" and field_name("1x") == "_1x"
    assert in_column_order(["b", "a", "c"], "c,a,zz") == ["c", "a"] and in_column_order(["b", "a"], "") == ["b", "a"]
