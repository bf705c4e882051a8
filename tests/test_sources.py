import io
import os
import re
import subprocess
import sys

import pytest
from pyspark.sql import functions as F
from strandline import schema
from strandline.model import FILTER, GenomicFilter, Leaf, Query, ResultType
from strandline.operators import counts, dictionary, exports, genomic, maintain, variants
from strandline.operators.cohort import cohort
from strandline.sources import pfb, phenotypes, share, vcf
from strandline.streaming import ingest

HEADER = "PATIENT_NUM,CONCEPT_PATH,NUMERIC_VALUE,TEXT_VALUE,DATETIME\n"


def load(spark, tmp_path, text, mode=phenotypes.LOW_MEMORY, name="data.csv", **kw):
    (tmp_path / name).write_text(text)
    return phenotypes.read_csv(spark, str(tmp_path / name), mode, **kw)


def concept(df, path):
    return dictionary.build(df).where(F.col("concept_path") == path).first()


def test_two_concepts(spark, tmp_path):
    df = load(spark, tmp_path, HEADER + "1,\\foo\\1\\,,val,1\n2,\\foo\\1\\,,lav,1\n1,\\foo\\2\\,0,,1\n2,\\foo\\2\\,99,,1\n")
    a, b = concept(df, "\\foo\\1\\"), concept(df, "\\foo\\2\\")
    assert (a["categorical"], a["category_values"], a["observation_count"], a["patient_count"], a["width"]) == (True, ["lav", "val"], 2, 2, 3)
    assert (b["categorical"], b["min"], b["max"], b["observation_count"], b["patient_count"]) == (False, 0.0, 99.0, 2, 2)
    s = phenotypes.ingest_status(spark, str(tmp_path / "data.csv"), df).first()
    assert (s["lines"], s["concepts"], s["observations"]) == (5, 2, 4)


@pytest.mark.parametrize("rows,kept", [(["1,\\a\\,,val,", "1,\\a\\,0,,"], ["val"]), (["1,\\a\\,0,,", "2,\\a\\,1,,", "3,\\a\\,,val,"], [0.0, 1.0])])
def test_first_record_fixes_the_type(spark, tmp_path, rows, kept):
    df = load(spark, tmp_path, HEADER + "\n".join(rows) + "\n")
    assert [r["nval"] if r["tval"] is None else r["tval"] for r in df.orderBy("seq").collect()] == kept


def test_modes(spark, tmp_path):
    text = '1, a \\ b ,,12,5\n2,\\\\a\\b\\,,"x, y\nz",\n3,\\q\\yes\\,,yes,\n4,\\q\\,,�,\n5,\\q\\, ,no,7\n,\\q\\,1,,\n'
    df = load(spark, tmp_path, text, phenotypes.PLAIN)
    got = {(r["patient_num"], r["concept_path"], r["nval"], r["tval"], r["ts_ms"]) for r in df.collect()}
    assert got == {(1, "a\\b\\", 12.0, None, 5), (2, "\\\\a\\b\\", None, "x, y\nz", None), (3, "\\q\\", None, "yes", None), (5, "\\q\\", None, "no", 7)}
    low = load(spark, tmp_path, HEADER + "1,a µ b,,12,bad\n", phenotypes.LOW_MEMORY).first()
    assert (low["concept_path"], low["nval"], low["tval"], low["ts_ms"]) == ("a\\b\\", None, "12", None)
    with pytest.raises(Exception, match="CAST|cast"):
        load(spark, tmp_path, "1,\\a\\,,x,bad\n", phenotypes.PLAIN).collect()


def test_files_load_by_name_whatever_their_size(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("1,\\x\\,,text,\n")
    (tmp_path / "in" / "b.csv").write_text("".join(f"{k},\\x\\,{k},,\n" for k in range(4000)))
    got = phenotypes.read_csv(spark, str(tmp_path / "in")).collect()
    assert [(r["patient_num"], r["tval"]) for r in got] == [(1, "text")]


def test_large_files_are_split_and_stay_in_order(spark, tmp_path):
    (tmp_path / "big.csv").write_text("".join(f"{k},\\x\\,{k},,\n" for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        raw = phenotypes.raw_csv(spark, str(tmp_path / "big.csv"))
        assert len({r["p"] for r in spark.read.text(str(tmp_path / "big.csv")).select(F.spark_partition_id().alias("p")).distinct().collect()}) > 3
        assert [int(r["patient"]) for r in raw.orderBy("seq").collect()] == list(range(5000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert not phenotypes.quoted_line_ends(spark, str(tmp_path / "big.csv"))


def test_config_and_directory(spark, tmp_path):
    config = phenotypes.read_config('{"one.csv": {"dataset_name": "study", "dataset_name_as_root_node": true}}')
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.csv").write_text(HEADER + "1,\\a\\,1,,\n")
    (tmp_path / "in" / "two.csv").write_text(HEADER + "2,\\a\\,2,,\n")
    df = phenotypes.read_csv(spark, str(tmp_path / "in"), phenotypes.CONFIGURED, config)
    assert {(r["patient_num"], r["concept_path"]) for r in df.collect()} == {(1, "\\study\\a\\"), (2, "\\a\\")}


def test_sequence_of_sources(spark):
    a = phenotypes.from_rows(spark.createDataFrame([(1, "\\a\\", "1", "", "")], "p int, c string, n string, t string, d string"))
    b = phenotypes.from_rows(spark.createDataFrame([(2, "\\a\\", "", "two", ""), (3, "\\a\\", "3", "", "")], "p int, c string, n string, t string, d string"))
    assert [(r["patient_num"], r["nval"]) for r in phenotypes.read_sequence(spark, [a, b]).orderBy("seq").collect()] == [(1, 1.0), (3, 3.0)]


def test_database(spark):
    url = "jdbc:derby:memory:strandline;create=true"
    rows = spark.createDataFrame([(1, "\\a\\b\\", None, "5", None), (2, "\\a\\b\\", 2.5, " ", 77)], "p int, c string, n double, t string, d bigint")
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows.write.format("jdbc").options(url=url, dbtable="facts", **options).option("createTableColumnTypes", "c VARCHAR(99), t VARCHAR(99)").save()
    got = phenotypes.read_jdbc(spark, url, "SELECT * FROM facts", options)
    assert sorted((r["patient_num"], r["nval"], r["ts_ms"]) for r in got.collect()) == [(1, 5.0, None), (2, 2.5, 77)]


def test_database_on_a_cluster(sf_dir, tmp_path):
    """Executors are processes of their own here, so a database in one's memory is nothing to the others."""
    code = f"""
import __spark_entry__ as entry
from pyspark.sql import SparkSession
conf = {{"spark.executor.memory": "512m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": "file://{tmp_path}/shared"}}
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config(map=conf).getOrCreate()
print("rows", entry.queries()["jdbc_load"](spark, "{sf_dir}").count(), spark.read.parquet("{sf_dir}/customer.parquet").count())
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(__file__)), capture_output=True, text=True, timeout=300)
    rows, expected = re.search(r"rows (\d+) (\d+)", out.stdout).groups()
    assert rows == expected != "0"


def test_dictionary_edges(spark):
    cols = spark.createDataFrame([("Gene", "a GENE name"), ("Freq", None)], "info_key string, description string")
    assert [r["info_key"] for r in dictionary.search_info_columns(cols, "NAME").collect()] == ["Gene"]
    assert [r["info_key"] for r in dictionary.search_info_columns(cols, "fre").collect()] == ["Freq"]
    empty = spark.createDataFrame([], schema.OBSERVATIONS)
    assert dictionary.build(empty).count() == 0 and schema.Dataset(empty).patients().count() == 0


def test_dump_is_read_again(spark, tmp_path):
    rows = [(1, "\\a\\", 1.5, None, 7, 0), (2, "\\b\\", None, 'say "x", y', None, 1)]
    df = spark.createDataFrame(rows, schema.OBSERVATIONS)
    phenotypes.write_csv(df.coalesce(1), str(tmp_path / "dump"))
    back = phenotypes.read_csv(spark, str(tmp_path / "dump"), phenotypes.CONFIGURED)
    assert {r[:5] for r in map(tuple, back.collect())} == {r[:5] for r in rows}


def test_one_file_is_written_side_by_side(spark, tmp_path):
    rows = spark.range(100, numPartitions=4).selectExpr("cast(id as int) patient_num", "'\\\\a\\\\' concept_path", "cast(null as double) nval", "'x \"y\", z' tval", "id ts_ms", "id seq")
    phenotypes.write_csv_file(rows, str(tmp_path / "one"))
    (file,) = (tmp_path / "one").glob("*.csv")
    assert file.read_text().count("PATIENT_NUM") == 1 and len(file.read_text().splitlines()) == 101
    back = phenotypes.read_csv(spark, str(tmp_path / "one"), phenotypes.LOW_MEMORY)
    assert sorted((r["patient_num"], r["concept_path"], r["tval"], r["ts_ms"]) for r in back.collect()) == [(k, "\\a\\", 'x "y", z', k) for k in range(100)]


def test_stream_takes_new_files_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(HEADER + "1,\\a\\,1,,\n")
    where = [str(tmp_path / x) for x in ("in", "out", "state")]
    ingest.start(spark, *where).awaitTermination()
    (tmp_path / "in" / "b.csv").write_text(HEADER + "2,\\a\\,2,,\n")
    ingest.start(spark, *where).awaitTermination()
    assert sorted(r["patient_num"] for r in spark.read.parquet(where[1]).collect()) == [1, 2]


INDEX = '"vcf_path"\t"chromosome"\t"isAnnotated"\t"isGzipped"\t"sample_ids"\t"patient_ids"\n'


def test_index():
    files = vcf.parse_index(INDEX + '"b.vcf"\t"ALL"\t"1"\t"0"\t"  s1, s2 "\t" 1 ,2 "\na.vcf\t4\t0\t1\ts1\t1\n')
    assert files == [vcf.VcfFile("a.vcf", "4", False, True, ("s1",), (1,)), vcf.VcfFile("b.vcf", None, True, False, ("s1", "s2"), (1, 2))]
    for bad, words in (('"a"\t"1"\t"x"\t"1"\t"s"\t"1"\n', ["line 2", "column 3", 'Value = "x"']), ('a\t1\t1\t1\ts\t1\nb\t1\t1\t\ts\t1\n', ["line 3", "column 4", 'Value = ""']), ("a\t1\t1\t1\ts\tp\n", ["column 6"])):
        with pytest.raises(ValueError) as e:
            vcf.parse_index(INDEX + bad)
        assert all(w in str(e.value) for w in words)


def test_index_of_many_samples():
    """A field longer than the csv module's limit of 131,072 signs."""
    ids = range(40_000)
    (file,) = vcf.parse_index(INDEX + f'"a.vcf"\t"ALL"\t"1"\t"0"\t"{",".join(f"S{i}" for i in ids)}"\t"{",".join(map(str, ids))}"\n')
    assert len(file.samples) == 40_000 and file.patients == tuple(ids)


VCF = """##fileformat=VCFv4.2
##INFO=<ID=Gene_with_variant,Number=.,Type=String,Description="A gene, or several">
##INFO=<ID=Freq,Number=1,Type=Float,Description="How often">
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\tS3\tS4
4\t1000\t.\tA\tG\t.\t.\tGene_with_variant=AAA&BBB;Variant_consequence_calculated=missense;Freq=0.25;PU=7\tGT\t0/1\t1/1:9\t0/0\t./.
4\t1999\t.\tC\tT\t.\t.\tGene_with_variant=AAA;Variant_consequence_calculated=stop;Freq=0.5\tGT\t0/0\t0|0\t./1\t1|0
chr4\t2000\t.\tC\tT\t.\t.\tFreq=.,0.75\tGT\t0/0\t0/0\t0/0\t1/1
"""


@pytest.fixture
def genome(spark, tmp_path):
    (tmp_path / "x.vcf").write_text(VCF)
    return vcf.read_vcf(spark, [vcf.VcfFile(str(tmp_path / "x.vcf"), None, True, False, ("S1", "S2", "S4", "S3"), (11, 12, 14, 13))])


def test_vcf_tables(genome):
    specs = {r["variant_id"]: r["spec"] for r in genome.variants.collect()}
    assert specs == {0: "chr4,1000,A,G,AAA&BBB,missense", 1: "chr4,1999,C,T,AAA,stop", 2: "chr4,2000,C,T,NULL,NULL"}
    assert {r["variant_id"]: r["bucket"] for r in genome.variants.collect()} == {0: 1, 1: 1, 2: 2}
    assert {tuple(r)[:3] for r in genome.genotypes.collect()} == {(0, 11, "0/1"), (0, 12, "1/1"), (0, 14, "./."), (1, 13, "./1"), (1, 14, "0/1"), (2, 14, "1/1")}
    info = {(r["variant_id"], r["info_key"], r["info_value"]) for r in genome.variant_info.collect()}
    assert (0, "Gene_with_variant", "AAA") in info and (2, "Freq", "0.75") in info and not any(k == "PU" for _, k, _ in info)
    cols = {r["info_key"]: r for r in variants.info_columns(genome).collect()}
    assert cols["Freq"]["continuous"] and (cols["Freq"]["min"], cols["Freq"]["max"], cols["Freq"]["description"]) == (0.25, 0.75, "How often")
    assert not cols["Gene_with_variant"]["continuous"]


def test_genomic_queries(genome):
    ids = lambda q: sorted(r["patient_num"] for r in cohort(genome, q).collect())
    gene, freq = GenomicFilter("Gene_with_variant", ("AAA",)), GenomicFilter("Freq", None, 0.5, None)
    assert ids(Query(info_groups=((gene,),))) == [11, 12, 14]
    assert ids(Query(info_groups=((gene, freq),))) == [14]
    assert ids(Query(info_groups=((freq,),))) == [14]
    assert ids(Query(specs=(GenomicFilter("chr4,1000,A,G", ("0/1",)),))) == [11]
    assert ids(Query(specs=(GenomicFilter("chr4,1000,A,G", ("",)),))) == [11, 12]
    assert ids(Query(specs=(GenomicFilter("chr4,1000,A,G", ("0/0",)),))) == []
    assert ids(Query(specs=(GenomicFilter("chr4,1000,A,G,other,missense"),))) == []
    q = Query(info_groups=((gene,),))
    assert counts.variant_count(genome, q).first()["variants"] == 2
    assert counts.variant_count(genome, Query()).first()["message"]
    assert variants.variant_list_text(genome, q) == "[chr4,1000,A,G,AAA&BBB,missense, chr4,1999,C,T,AAA,stop]"
    assert {tuple(r) for r in genomic.bucket_index(genome).collect()} == {(11, "chr4", 1), (12, "chr4", 1), (13, "chr4", 1), (14, "chr4", 1), (14, "chr4", 2)}
    got = {r["spec"]: r["info_raw"] for r in variants.metadata_of(genome, ["chr4,2000,C,T,NULL,NULL", "none"]).collect()}
    assert got == {"chr4,2000,C,T,NULL,NULL": ["Freq=.,0.75"], "none": []}
    with pytest.raises(ValueError):
        variants.metadata_of(genome, ["a", "a"])


def test_excerpts(genome):
    q = Query(info_groups=((GenomicFilter("Gene_with_variant", ("AAA",)),),))
    wide = variants.excerpt_wide(genome, q, order="Freq,Gene_with_variant")
    assert wide.columns == ["CHROM", "POSITION", "REF", "ALT", "Freq", "Gene_with_variant", "Patients with this variant in subset", "Patients with this variant NOT in subset", "11", "12", "14"]
    assert [tuple(r) for r in wide.collect()] == [("chr4", 1000, "A", "G", "0.25", "AAA", "2/3", "0/1", "0/1", "1/1", "0/0"), ("chr4", 1999, "C", "T", "0.5", "AAA", "1/3", "0/1", "0/0", "0/0", "0/1")]
    assert variants.excerpt_text(genome, Query()) == variants.NO_VARIANTS
    assert len(variants.excerpt_wide(genome, q, with_patients=False).columns) == 4 + 3 + 2
    cells = {tuple(r)[:8] + (r["patient"], r["zygosity"]) for r in variants.excerpt_cells(genome, q, "Freq,Gene_with_variant").collect()}
    assert cells == {tuple(r)[:8] + (c, r[c]) for r in wide.collect() for c in wide.columns[8:]}
    text = ["\t".join(map(str, r)) for r in [wide.columns, *wide.collect()]]
    assert variants.excerpt_text(genome, q, "Freq,Gene_with_variant") == "\n".join(text) + "\n"
    assert variants.excerpt_text(genome, q, with_patients=False).splitlines()[0].split("\t") == variants.excerpt_wide(genome, q, with_patients=False).columns


def test_no_variants_without_patients(genome, monkeypatch):
    """Where nothing is listed, no patient is brought to the driver or put into a plan."""
    monkeypatch.setattr(variants, "_excerpt", None)
    assert variants.excerpt_text(genome, Query()) == variants.NO_VARIANTS


def test_headers_of_any_length_and_files_of_other_samples(spark, tmp_path):
    more = "".join(f"##contig=<ID=c{k}>\n" for k in range(150_000))
    lines = VCF.split("\n", 1)
    (tmp_path / "x.vcf").write_text(lines[0] + "\n" + more + lines[1])
    (tmp_path / "y.vcf").write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS9\n5\t7\t.\tA\tC\t.\t.\tX=1\tGT\t0/1\n")
    files = [vcf.VcfFile(str(tmp_path / "x.vcf"), None, True, False, ("S4", "S1"), (14, 11)), vcf.VcfFile(str(tmp_path / "y.vcf"), "5", False, False, ("S9",), (19,))]
    ds = vcf.read_vcf(spark, files)
    assert {tuple(r)[1:4] for r in ds.genotypes.collect()} == {(11, "0/1", "chr4"), (14, "./.", "chr4"), (14, "0/1", "chr4"), (14, "1/1", "chr4"), (19, "0/1", "chr5")}
    assert {r["info_key"]: r["description"] for r in ds.info_columns.collect()}["Freq"] == "How often"
    (tmp_path / "z.vcf").write_text("5\t7\t.\tA\tC\t.\t.\tX=1\tGT\t0/1\n")
    with pytest.raises(ValueError, match="no column header"):
        vcf.read_vcf(spark, [vcf.VcfFile(str(tmp_path / "z.vcf"), None, True, False, ("S9",), (1,))])


def test_unknown_sample_is_an_error(spark, tmp_path):
    (tmp_path / "x.vcf").write_text(VCF)
    with pytest.raises(ValueError, match="S9"):
        vcf.read_vcf(spark, [vcf.VcfFile(str(tmp_path / "x.vcf"), None, True, False, ("S9",), (1,))])


def test_index_builder(spark, tmp_path):
    mapping = spark.createDataFrame([("u1", "/x/st.chr1.vcf.gz", "ok"), ("u2", "/x/st.chr1.vcf.gz", "ok"), ("u3", "/x/st.chr2.vcf.gz", "no"), ("u9", "/x/st.chr2.vcf.gz", "ok")], "patient_uuid string, file string, kind string")
    ids = spark.createDataFrame([("u1", 1), ("u2", 2), ("u3", 3)], "patient_uuid string, patient_id int")
    got = vcf.build_indexes(mapping, ids, ["ok"], "/vcf/").collect()
    assert [(r["file_group"], r["vcf_path"], r["chromosome"], r["sample_ids"], r["patient_ids"]) for r in got] == [("st", "/vcf/st.chr1.vcf.gz", "1", "u1,u2", "1,2")]
    vcf.write_index(vcf.build_indexes(mapping, ids, ["ok"], "/vcf"), str(tmp_path / "index"))
    (written,) = (tmp_path / "index" / "file_group=st").glob("*.csv")
    assert vcf.parse_index(written.read_text()) == [vcf.VcfFile("/vcf/st.chr1.vcf.gz", "1", True, True, ("u1", "u2"), (1, 2))]


@pytest.fixture
def people(spark):
    rows = [(1, "\\n\\", 2.5, None, 1500, 0), (1, "\\n\\", 1.0, None, 2000, 1), (2, "\\c\\", None, "b ", None, 2), (1, "\\c\\", None, "a", 0, 3), (3, "\\c\\", None, "a", None, 4), (3, "\\c\\", None, "z", None, 5)]
    return schema.Dataset(spark.createDataFrame(rows, schema.OBSERVATIONS))


def test_exports(people, genome):
    rows = lambda df: sorted(map(tuple, df.collect()))
    q = Query(select=("\\n\\", "\\none\\", "\\c\\"))
    assert rows(exports.multi_value_text(people, q)) == [("1", "2.5\t1.0", "", "a"), ("2", "", "", "b "), ("3", "", "", "a\tz")]
    first = sorted(map(tuple, exports.first_value(people, q).collect()))
    assert first[0] == (1, 2.5, "", "a") and first[1][0] == 2 and first[1][1] != first[1][1] and first[1][3] == "b" and first[2][3] == "a"
    ts = rows(exports.timeseries(people, Query(select=("\\c\\",), clause=Leaf("\\n\\", FILTER, None, 2.0))))
    assert ts == sorted([(1, "\\n\\", 2.5, "", "1970-01-01T00:00:01.500Z"), (1, "\\n\\", 1.0, "", "1970-01-01T00:00:02Z"), (1, "\\c\\", None, "a", "1970-01-01T00:00:00Z")])
    spec = "chr4,1000,A,G"
    got = {r["Patient ID"]: r[spec] for r in exports.first_value(genome, Query(select=(spec,))).collect()}
    assert got == {11: "0/1", 12: "1/1", 13: "0/0", 14: "0/0"}


def test_engine_validates_and_guards(people, tmp_path, spark):
    e = share.Engine(people)
    assert e.answer(Query(clause=Leaf("\\c\\", values=("a",)))).first()["patients"] == 2
    with pytest.raises(ValueError):
        e.answer(Query(clause=Leaf("\\n\\", values=("a",))))
    with pytest.raises(PermissionError):
        e.answer(Query(result=ResultType.VCF_EXCERPT))
    rows = e.answer(Query(select=("\\n\\", "\\c\\"), result=ResultType.CROSS_COUNT)).collect()
    assert [r["concept_path"] for r in rows] == ["\\c\\", "\\n\\"]
    e.write_pfb(Query(select=("\\c\\",), id="q1"), str(tmp_path / "q1.avro"))
    assert sum("patient_id" in r["object"] for r in pfb.read((tmp_path / "q1.avro").read_bytes())[1]) == 3
    out = e.share(Query(select=("\\c\\",), clause=Leaf("\\c\\", values=("a",)), id="q1"), str(tmp_path))
    assert sorted(r[0] for r in spark.read.csv(out["patients"]).collect()) == ["1", "3"]
    assert set(share.BUILDERS) == set(ResultType)


def test_pfb(people):
    wide, out = exports.multi_value(people, Query(select=("\\n\\", "\\c\\"))), io.BytesIO()
    pfb.write(wide, "q-1", out, {"\\n\\": {"display": "N", "drs_uri": ["drs://x"]}})
    s, rows = pfb.read(out.getvalue())
    assert s["name"] == "entity" and [r["name"] for r in rows[:3]] == ["metadata", "export_data_dictionary_q_1", "export_data_dictionary_q_1"]
    assert rows[1]["object"]["display"] == "N" and rows[1]["object"]["drs_uri"] == ["drs://x"] and rows[2]["object"]["display"] is None
    got = {r["object"]["patient_id"]: r["object"] for r in rows[3:]}
    assert got["1"]["_n_"] == ["2.5", "1.0"] and got["3"]["_c_"] == ["a", "z"] and got["2"]["_n_"] == []
    with pytest.raises(ValueError):
        pfb.write(wide.toDF("patient_id", "a b", "a_b"), "q", io.BytesIO())


def test_store_round_trip(spark, genome, tmp_path):
    schema.save(genome, str(tmp_path / "ds"))
    back = schema.load(spark, str(tmp_path / "ds"))
    assert back.dictionary().count() == dictionary.build(genome.observations).count()
    assert sorted(map(tuple, back.buckets.select("patient_num", "chrom", "bucket").collect())) == sorted(map(tuple, genomic.bucket_index(genome).select("patient_num", "chrom", "bucket").collect()))
    assert back.with_tables(observations=back.observations).concepts is None and back.with_tables(genotypes=back.genotypes).buckets is None
    plan = cohort(back, Query(specs=(GenomicFilter("chr4,1000,A,G", ("0/1",)),)))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"genotypes.*PartitionFilters: \[[^]]*chrom[^]]*chr4", plan) and "EqualTo(bucket,1)" in plan
    for t in ("observations", "variants", "genotypes", "variant_info", "info_columns", "variant_metadata"):
        cols = getattr(genome, t).columns
        assert sorted(map(str, getattr(back, t).select(cols).collect())) == sorted(map(str, getattr(genome, t).collect()))


def test_a_store_runs_each_plan_once(spark, tmp_path):
    """Ranges are sampled from, and the dictionary made of, a staged copy."""
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(k, "\\a\\", float(k), None, None, k) for k in range(50)]
    observations = spark.createDataFrame(rows, schema.OBSERVATIONS).mapInArrow(passed, schema.OBSERVATIONS)
    schema.save(schema.Dataset(observations), str(tmp_path / "ds"))
    assert seen.value == 50 and schema.load(spark, str(tmp_path / "ds")).dictionary().first()["observation_count"] == 50


def test_maintenance(spark, genome):
    mapping = spark.createDataFrame([(11, 1)], "old_id int, new_id int")
    assert 1 in {r["patient_num"] for r in maintain.remap_patients(genome.genotypes, mapping).collect()}
    with pytest.raises(Exception, match="no mapping"):
        maintain.remap_patients(genome.genotypes, mapping, strict=True).collect()
    with pytest.raises(ValueError, match="share patients"):
        maintain.merge_genomic(genome, genome)
    obs = spark.createDataFrame([(1, "\\a\\b/\\", None, "x", None, 0)], schema.OBSERVATIONS)
    assert maintain.merge_sibling_concepts(obs).first()["concept_path"] == "\\a\\b\\"
    key, other = b"0123456789abcdef", b"fedcba9876543210"
    sealed = maintain.rekeyed(maintain.encrypted(obs, ["tval"], key), {"tval": "string"}, key, other)
    assert bytes(sealed.first()["tval"]) != b"x" and maintain.decrypted(sealed, {"tval": "string"}, other).first()["tval"] == "x"
    b = spark.createDataFrame([("s", "chr1", 0, ["new"])], schema.VARIANT_METADATA)
    a = spark.createDataFrame([("s", "chr1", 0, ["old"]), ("t", "chr1", 0, ["t"])], schema.VARIANT_METADATA)
    assert {r["spec"]: r["info_raw"] for r in maintain.merge_metadata(a, b).collect()} == {"s": ["new"], "t": ["t"]}


def test_pages(spark):
    rows = spark.range(10).toDF("v")
    got, total, pages = dictionary.page(rows, [F.col("v")], 2, 4)
    assert [r["v"] for r in got.collect()] == [4, 5, 6, 7] and (total, pages) == (10, 3)
    with pytest.raises(ValueError):
        dictionary.page(rows, [F.col("v")], 0, 4)


def test_numbered_under_any_name(spark):
    """Rows keep their order, also where a column has the asked name or one used inside."""
    from strandline.operators.maintain import numbered

    rows = spark.range(0, 1000, numPartitions=7).selectExpr("id", "id AS place", "id AS `a.b`", "id AS _at0", "id AS _part0")
    for name in ("place", "n"):
        got = numbered(rows.orderBy(rows["id"].desc()), name)
        assert {(r["id"], r[name]) for r in got.collect()} == {(k, 999 - k) for k in range(1000)}
        assert set(got.columns) == set(rows.columns) | {name}
