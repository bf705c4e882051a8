"""A load parses its files once, and moves no record to type it; texts and paths that are told apart cheaply come out as by the whole rule."""

import pytest
from pyspark.sql import functions as F
from strandline.functions import observations as fo
from strandline.sources import phenotypes


def test_files_are_parsed_once_and_records_stay_where_they_are(spark, tmp_path):
    (tmp_path / "data.csv").write_text("1,\\a\\,,one,\n2,\\a\\,2,,\n3, b \\,3,,9\n")
    df = phenotypes.read_csv(spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "FileScan csv" not in plan and "SortMergeJoin" not in plan
    raw = phenotypes.raw_csv(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in raw
    expected = {(1, "\\a\\", None, "one", None), (3, "b\\", 3.0, None, 9)}
    assert {tuple(r)[:5] for r in df.collect()} == expected
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with more concepts than can be sent to all
    try:
        assert {tuple(r)[:5] for r in phenotypes.read_csv(spark, str(tmp_path)).collect()} == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


NUMBERS = ["1", "-1.5", "+.5", "5.", "1e10", "1E-5f", "2D", "0x1p3", "-0X.8P-2d", "NaN", "-NaN", "nan", "NAN", "Infinity", "-infinity", "+Inf", "inf", "\t7\n", "\x1f8\x00", "1e400", "007"]
TEXTS = ["", " ", "1-URGENT", "INDIA", "F", "d", "e5", "+", "-", ".", "1 2", "1_0", "--1", "0x", "٣", "½", "1,5", "12a", "\u00a05", "5\u2028", "5\n6", "infinit", "nan1", "BUILDING", "1e", "0x1", None]


def test_numbers(spark):
    """What isn't cast is just what a cast makes null."""
    df = spark.createDataFrame([(x,) for x in NUMBERS + TEXTS], "x string").repartition(2)
    got = df.select("x", F.col("x").try_cast("double").cast("string").alias("cast"), fo.double(F.col("x")).cast("string").alias("own")).collect()
    assert [r for r in got if r["cast"] != r["own"]] == []
    assert {r["x"] for r in got if r["own"] is not None} == set(NUMBERS)


PATHS = ["", "\\", "\\\\", "\\a\\", "\\a\\\\", "a", " a\\", "\\ a\\", "\\a \\", "\\a\\ ", "\\a b\\c\\", "\\\\a\\\\b\\", "\\a\\\n", "\\a\\b\n\\", "\t\\a\t\\", "\\aµb\\", "µ", "\\a�\\", "�", None]


@pytest.mark.parametrize("micro", [False, True])
def test_paths(spark, micro):
    x = F.col("x")
    raw = F.translate(x, "µ", "\\") if micro else x
    whole = F.concat(F.array_join(F.transform(F.split(F.regexp_replace(raw, r"\\+$", ""), r"\\"), lambda s: F.trim(s)), "\\"), F.lit("\\"))
    got = spark.createDataFrame([(p,) for p in PATHS], "x string").repartition(2).select("x", whole.alias("whole"), fo.normal_path(x, micro).alias("own")).collect()
    assert [r for r in got if r["whole"] != r["own"]] == []


def test_clean(spark):
    df = spark.createDataFrame([(b"a\xef\xbf\xbdb",), (b"a\xffb\xc3",), (b"",), ("ä µ".encode(),), (b"\xf0\x9f\x98\x80\xed\xa0\x80",), (None,)], "b binary").selectExpr("cast(b as string) x").repartition(2)
    got = df.select(F.regexp_replace("x", "�", "").alias("whole"), fo.clean(F.col("x")).alias("own")).collect()
    assert [r for r in got if r["whole"] != r["own"]] == []
