"""Every query that has SQL gives the rows its SQL gives, over the smallest tables."""

import os

import __spark_entry__ as entry
import duckdb
import pytest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def canonical(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(map(str, pdf[cols].astype(object).where(pdf[cols].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, sf_dir, duck, name):
    assert canonical(entry.queries()[name](spark, sf_dir).toPandas()) == canonical(duck.sql(entry.oracle_sql()[name]).df())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_algebra(spark, sf_dir):
    """AND is intersection, OR is union of the separate cohorts."""
    from strandline.model import Branch, Query
    from strandline.operators.cohort import cohort
    from strandline.plans import queries as p
    from strandline.plans.testbed import dataset

    ds = dataset(spark, sf_dir)
    get = lambda c: {r["patient_num"] for r in cohort(ds, Query(clause=c)).collect()}
    a, b = get(p.BUILDING), get(p.PRICED)
    assert get(Branch("AND", (p.BUILDING, p.PRICED))) == a & b
    assert get(Branch("OR", (p.BUILDING, p.PRICED))) == a | b


def test_one_scan_pruned_by_path(spark, tmp_path):
    """The whole tree is one scan of observations, with the concept paths pushed into it."""
    from strandline import schema
    from strandline.operators.cohort import cohort
    from strandline.model import Query
    from strandline.plans import queries as p

    rows = [(1, "\\a\\", None, "x", None, 0), (2, "\\demo\\customer\\MKTSEGMENT\\", None, "BUILDING", None, 0)]
    schema.save(schema.Dataset(spark.createDataFrame(rows, schema.OBSERVATIONS)), str(tmp_path / "ds"))
    ds = schema.load(spark, str(tmp_path / "ds"))
    plan = cohort(ds, Query(clause=p.NESTED))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "PushedFilters" in plan and "EqualTo(concept_path" in plan
    assert ds.variants is None and cohort(ds, Query(clause=p.BUILDING)).collect()[0]["patient_num"] == 2
