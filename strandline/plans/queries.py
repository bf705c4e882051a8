"""The cohort operators' queries over the testbed, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import observations as fo
from strandline.functions import variants as fv
from strandline.model import ANY_RECORD_OF, REQUIRED, Branch, FlatQuery, GenomicFilter, Leaf, Query, ResultType
from strandline.operators import cohort as co
from strandline.operators import counts, dictionary, exports, genomic, maintain, variants
from strandline.plans.testbed import BALANCE, EVENTS, NATION, PRICE, PRIORITY, SEGMENT, SQL, STATUS, dataset, table
from strandline.schema import Dataset, load, save
from strandline.sources import phenotypes
from strandline.sources.scratch import folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BUILDING = Leaf(SEGMENT, values=("BUILDING",))
PRICED = Leaf(PRICE, low=100000.0, high=150000.0)
NESTED = Branch("AND", (Branch("OR", (BUILDING, Leaf(SEGMENT, values=("MACHINERY",)))), PRICED, Branch("OR", (Leaf(PRIORITY, values=("1-URGENT",)), Leaf(BALANCE, high=0.0)))))
GENES = GenomicFilter("Gene_with_variant", ("Brand_11", "Brand_23"))
RANGE = GenomicFilter("Variant_frequency", None, 0.001, 0.0012)

_B = r"SELECT patient_num FROM obs WHERE concept_path = '\demo\customer\MKTSEGMENT\' AND tval = 'BUILDING'"
_P = r"SELECT patient_num FROM obs WHERE concept_path = '\demo\orders\TOTALPRICE\' AND nval BETWEEN 100000 AND 150000"
_NEST = rf"""SELECT patient_num FROM pat WHERE patient_num IN (SELECT patient_num FROM obs WHERE concept_path = '\demo\customer\MKTSEGMENT\' AND tval IN ('BUILDING', 'MACHINERY'))
  AND patient_num IN ({_P}) AND (patient_num IN (SELECT patient_num FROM obs WHERE concept_path = '\demo\orders\PRIORITY\' AND tval = '1-URGENT')
  OR patient_num IN (SELECT patient_num FROM obs WHERE concept_path = '\demo\customer\ACCTBAL\' AND nval <= 0))"""
_GENES = "SELECT variant_id FROM var WHERE gene IN ('Brand_11', 'Brand_23')"
_CARRY = f"{_B} INTERSECT SELECT patient_num FROM gt WHERE variant_id IN ({_GENES})"
_LIST = f"SELECT variant_id FROM ({_GENES}) WHERE variant_id IN (SELECT variant_id FROM gt WHERE patient_num IN ({_B}))"


def query(name: str, sql: str | None = None, raw: bool = False):
    """Register a function of the testbed dataset (or, if ``raw``, of spark and sf_dir)."""

    def add(f):
        QUERIES[name] = f if raw else lambda spark, sf_dir: f(dataset(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql if raw else SQL + sql
        return f

    return add


def _counts(name: str, q: Query, sql: str) -> None:
    query(name, f"SELECT count(DISTINCT patient_num) AS patients FROM ({sql})")(lambda ds: counts.count(ds, q))


_counts("count_all", Query(), "SELECT patient_num FROM pat")
_counts("count_categorical", Query(clause=BUILDING), _B)
_counts("count_value_list", Query(clause=Leaf(SEGMENT, values=("BUILDING", "MACHINERY", "no such value"))), r"SELECT patient_num FROM obs WHERE concept_path = '\demo\customer\MKTSEGMENT\' AND tval IN ('BUILDING', 'MACHINERY')")
_counts("count_range", Query(clause=PRICED), _P)
_counts("count_range_open", Query(clause=Leaf(BALANCE, low=5000.0)), r"SELECT patient_num FROM obs WHERE concept_path = '\demo\customer\ACCTBAL\' AND nval >= 5000")
_counts("count_and", Query(clause=Branch("AND", (BUILDING, PRICED))), f"{_B} INTERSECT {_P}")
_counts("count_or", Query(clause=Branch("OR", (BUILDING, PRICED))), f"{_B} UNION {_P}")
_counts("count_nested", Query(clause=NESTED), _NEST)
_counts("count_required", Query(clause=Leaf(EVENTS + "purchase\\", REQUIRED)), r"SELECT patient_num FROM obs WHERE concept_path = '\demo\events\purchase\'")
_counts("count_any_record", Query(clause=Leaf(EVENTS, ANY_RECORD_OF)), r"SELECT patient_num FROM obs WHERE starts_with(concept_path, '\demo\events\')")
_counts("count_unknown_concept", Query(clause=Leaf("\\demo\\nothing\\", REQUIRED)), "SELECT patient_num FROM pat WHERE false")
_counts("count_auth", Query(authorization=((NATION, ("FRANCE", "GERMANY", "NATION_6", "NATION_7")),), clause=PRICED), rf"SELECT patient_num FROM obs WHERE concept_path = '\demo\customer\NATION\' AND tval IN ('FRANCE', 'GERMANY', 'NATION_6', 'NATION_7') INTERSECT {_P}")
_counts(
    "count_v1_any_multi",
    FlatQuery(any_record_of=[[EVENTS + "purchase\\", EVENTS + "click\\"], [PRICE, "\\demo\\nothing\\"]], category={SEGMENT: ["BUILDING"]}).compile(),
    rf"{_B} INTERSECT SELECT patient_num FROM obs WHERE concept_path IN ('\demo\events\purchase\', '\demo\events\click\') INTERSECT SELECT patient_num FROM obs WHERE concept_path = '\demo\orders\TOTALPRICE\'",
)
_counts("info_category", Query(info_groups=((GENES,),)), f"SELECT patient_num FROM gt WHERE variant_id IN ({_GENES}) AND patient_num IN (SELECT patient_num FROM pat)")
_counts("info_range", Query(info_groups=((RANGE,),)), "SELECT patient_num FROM gt WHERE variant_id IN (SELECT variant_id FROM var WHERE freq BETWEEN 0.001::FLOAT AND 0.0012::FLOAT)")
_counts("info_multi", Query(info_groups=((GENES, RANGE),)), f"SELECT patient_num FROM gt WHERE variant_id IN ({_GENES} INTERSECT SELECT variant_id FROM var WHERE freq BETWEEN 0.001::FLOAT AND 0.0012::FLOAT)")
_counts("gene_patients", Query(clause=BUILDING, info_groups=((GENES,),)), f"SELECT patient_num FROM gt WHERE variant_id IN ({_GENES}) AND patient_num IN ({_B})")
_counts("info_groups_v1", FlatQuery(info=[[GENES], [RANGE]]).compile(), f"SELECT patient_num FROM gt WHERE variant_id IN ({_GENES}) INTERSECT SELECT patient_num FROM gt WHERE variant_id IN (SELECT variant_id FROM var WHERE freq BETWEEN 0.001::FLOAT AND 0.0012::FLOAT)")


@query("spec_zygosity", "SELECT spec, count(*) FILTER (WHERE zygosity = '0/1') AS het, count(*) FILTER (WHERE zygosity = '1/1') AS hom, count(*) AS carriers FROM var JOIN gt USING (variant_id) GROUP BY spec")
def _spec_zygosity(ds: Dataset) -> DataFrame:
    gt = ds.genotypes.join(ds.variants.select("variant_id", "spec"), "variant_id")
    return gt.groupBy("spec").agg(F.count_if(F.col("zygosity") == "0/1").alias("het"), F.count_if(F.col("zygosity") == "1/1").alias("hom"), F.count("*").alias("carriers"))


@query("spec_patients", "SELECT DISTINCT patient_num FROM gt JOIN var USING (variant_id) WHERE (chrom, pos, ref, alt) = (SELECT (chrom, pos, ref, alt) FROM var WHERE variant_id = 44) AND zygosity = '0/1' AND patient_num IN (SELECT patient_num FROM pat)")
def _spec_patients(ds: Dataset) -> DataFrame:
    spec = ds.variants.where("variant_id = 44").select("spec").first()["spec"]
    short = ",".join(spec.split(",")[:4])
    return co.cohort(ds, Query(specs=(GenomicFilter(short, ("0/1",)),)))


CROSS = Query(select=(SEGMENT, PRICE, EVENTS + "purchase\\", "\\demo\\nothing\\"), clause=PRICED, result=ResultType.CROSS_COUNT)
_PATHS = r"(VALUES ('\demo\customer\MKTSEGMENT\'), ('\demo\orders\TOTALPRICE\'), ('\demo\events\purchase\'), ('\demo\nothing\')) p(concept_path)"
query("cross_count", f"SELECT concept_path, count(DISTINCT patient_num) AS patients FROM {_PATHS} LEFT JOIN (SELECT * FROM obs WHERE patient_num IN ({_P})) o USING (concept_path) GROUP BY concept_path")(lambda ds: counts.cross_count(ds, CROSS))
query("obs_cross_count", f"SELECT concept_path, count(*) FILTER (WHERE patient_num IN ({_P})) AS observations FROM obs JOIN {_PATHS} USING (concept_path) GROUP BY concept_path")(lambda ds: counts.observation_cross_count(ds, CROSS))
query("obs_cross_count_v1", f"SELECT concept_path, CASE WHEN count(patient_num) = 0 THEN -1 ELSE count(*) FILTER (WHERE patient_num IN ({_P})) END AS observations FROM {_PATHS} LEFT JOIN obs USING (concept_path) GROUP BY concept_path")(
    lambda ds: counts.observation_cross_count(ds, FlatQuery(ResultType.OBSERVATION_CROSS_COUNT, list(CROSS.select), numeric={PRICE: (100000.0, 150000.0)}).compile())
)
query(
    "categorical_cross_count_v3",
    rf"""SELECT concept_path, tval AS category, count(DISTINCT patient_num) FILTER (WHERE patient_num IN ({_NEST})) AS patients FROM obs
    WHERE concept_path IN ('\demo\customer\MKTSEGMENT\', '\demo\orders\PRIORITY\') GROUP BY ALL HAVING patients > 0 OR tval IN ('BUILDING', 'MACHINERY', '1-URGENT')""",
)(lambda ds: counts.categorical_cross_count(ds, Query(clause=NESTED)))
query(
    "categorical_cross_count_v1",
    rf"""SELECT concept_path, tval AS category, count(DISTINCT patient_num) FILTER (WHERE patient_num IN ({_B})) AS patients FROM obs
    WHERE concept_path = '\demo\orders\PRIORITY\' OR concept_path = '\demo\customer\MKTSEGMENT\' AND tval = 'BUILDING' GROUP BY ALL""",
)(lambda ds: counts.categorical_cross_count_flat(ds, FlatQuery(required=[PRIORITY], category={SEGMENT: ["BUILDING"]})))
query(
    "continuous_cross_count_v3",
    rf"SELECT concept_path, nval AS value, count(*) AS observations FROM obs WHERE concept_path = '\demo\orders\TOTALPRICE\' AND patient_num IN ({_B} INTERSECT {_P}) GROUP BY ALL",
)(lambda ds: counts.continuous_cross_count(ds, Query(clause=Branch("AND", (BUILDING, PRICED)))))
query(
    "continuous_cross_count_v1",
    rf"SELECT concept_path, nval AS value, count(*) AS observations FROM obs WHERE concept_path = '\demo\orders\TOTALPRICE\' AND nval BETWEEN 100000 AND 150000 AND patient_num IN ({_B} INTERSECT {_P}) GROUP BY ALL",
)(lambda ds: counts.continuous_cross_count_flat(ds, FlatQuery(numeric={PRICE: (100000.0, 150000.0)}, category={SEGMENT: ["BUILDING"]})))
query("patient_concept_count", f"SELECT 3::BIGINT AS concepts, count(DISTINCT patient_num) AS patients FROM ({_P})")(lambda ds: counts.patient_concept_count(ds, CROSS))
query("patients", f'SELECT DISTINCT patient_num AS "PATIENT_NUM" FROM ({_NEST})')(lambda ds: exports.patients(ds, Query(clause=NESTED)))

_ISO = "CASE WHEN ts_ms IS NULL THEN '' WHEN ts_ms % 1000 = 0 THEN strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%SZ') ELSE left(strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S.%f'), 23) || 'Z' END"
query(
    "timeseries",
    rf"""SELECT patient_num AS "PATIENT_NUM", concept_path AS "CONCEPT_PATH", nval AS "NVAL_NUM", coalesce(tval, '') AS "TVAL_CHAR", {_ISO} AS "TIMESTAMP" FROM obs
    WHERE (concept_path IN ('\demo\customer\MKTSEGMENT\', '\demo\orders\STATUS\') OR starts_with(concept_path, '\demo\events\')) AND patient_num IN ({_B}) AND patient_num IN (SELECT user_id FROM events)""",
)(lambda ds: exports.timeseries(ds, Query(select=(STATUS,), clause=Branch("AND", (BUILDING, Leaf(EVENTS, ANY_RECORD_OF))))))


@query(
    "dataframe_multi",
    rf"""SELECT b.patient_num AS patient_id, coalesce(m.s, '') AS segment, coalesce(m.p, '') AS priorities, coalesce(m.n, 0) AS prices, m.total AS price_sum FROM (SELECT DISTINCT patient_num FROM ({_B})) b
    LEFT JOIN (SELECT patient_num, string_agg(tval, chr(9) ORDER BY seq) FILTER (WHERE concept_path = '\demo\customer\MKTSEGMENT\') AS s, string_agg(tval, chr(9) ORDER BY seq) FILTER (WHERE concept_path = '\demo\orders\PRIORITY\') AS p,
    count(nval) FILTER (WHERE concept_path = '\demo\orders\TOTALPRICE\') AS n, sum(nval::DECIMAL(18, 2)) FILTER (WHERE concept_path = '\demo\orders\TOTALPRICE\')::DOUBLE AS total FROM obs GROUP BY patient_num) m USING (patient_num)""",
)
def _multi(ds: Dataset) -> DataFrame:
    # numbers are compared as numbers, as engines write them differently
    wide = exports.multi_value(ds, Query(select=(SEGMENT, PRIORITY, PRICE), clause=BUILDING)).toDF("patient_id", "s", "p", "v")
    total = F.aggregate("v", F.lit(0).cast("decimal(18,2)"), lambda a, x: (a + x.cast("decimal(18,2)")).cast("decimal(18,2)"))
    return wide.select("patient_id", F.array_join("s", "\t").alias("segment"), F.array_join("p", "\t").alias("priorities"), F.size("v").cast("long").alias("prices"), F.when(F.size("v") > 0, total).cast("double").alias("price_sum"))


@query(
    "dataframe_first",
    rf"""SELECT p.patient_num AS patient_id, coalesce((SELECT min_by(nval, seq) FROM obs o WHERE o.patient_num = p.patient_num AND concept_path = '\demo\orders\TOTALPRICE\'), 'NaN'::DOUBLE) AS price,
    coalesce((SELECT min_by(tval, seq) FROM obs o WHERE o.patient_num = p.patient_num AND concept_path = '\demo\orders\STATUS\'), '') AS status FROM pat p WHERE patient_num IN ({_B})""",
)
def _first(ds: Dataset) -> DataFrame:
    return exports.first_value(ds, Query(select=(PRICE, STATUS), clause=BUILDING)).toDF("patient_id", "price", "status")


query("variant_count", f"SELECT count(*) AS variants, NULL::VARCHAR AS message FROM ({_LIST})")(lambda ds: counts.variant_count(ds, Query(clause=BUILDING, info_groups=((GENES,),))))
query("variant_list", f"SELECT spec FROM var WHERE variant_id IN ({_LIST})")(lambda ds: variants.variant_list(ds, Query(clause=BUILDING, info_groups=((GENES,),))))
query(
    "aggregate_vcf_excerpt",
    f"""SELECT chrom, pos, ref, alt, gene, consequence, count(*) FILTER (WHERE g.patient_num IN ({_CARRY})) AS in_carriers, (SELECT count(DISTINCT patient_num) FROM ({_CARRY})) AS in_size,
    count(*) FILTER (WHERE g.patient_num NOT IN ({_CARRY})) AS out_carriers, (SELECT count(*) FROM pat) - (SELECT count(DISTINCT patient_num) FROM ({_CARRY})) AS out_size
    FROM var JOIN gt g USING (variant_id) WHERE variant_id IN ({_LIST}) GROUP BY ALL""",
)(lambda ds: variants.aggregate_excerpt(ds, Query(clause=BUILDING, info_groups=((GENES,),))))
query("vcf_excerpt_long", f"SELECT chrom, pos, ref, alt, patient_num, zygosity FROM var JOIN gt USING (variant_id) WHERE variant_id IN ({_LIST}) AND patient_num IN ({_B})")(
    lambda ds: variants.excerpt_long(ds, Query(clause=BUILDING, info_groups=((GENES,),)))
)
query("bucket_index", "SELECT DISTINCT patient_num, chrom, bucket FROM gt JOIN var USING (variant_id)")(genomic.bucket_index)
query("bucket_prefilter", f"SELECT variant_id FROM var WHERE (chrom, bucket) IN (SELECT (chrom, bucket) FROM gt JOIN var USING (variant_id) WHERE patient_num IN ({_B}))")(
    lambda ds: genomic.in_buckets_of(ds, ds.variants, co.cohort(ds, Query(clause=BUILDING))).select("variant_id")
)
query(
    "dictionary",
    """SELECT concept_path, count(nval) = 0 AS categorical, coalesce(array_to_string(list_sort(list_distinct(list(tval) FILTER (WHERE tval IS NOT NULL))), '|'), '') AS category_values, min(nval) AS min, max(nval) AS max,
    count(*) AS observation_count, count(DISTINCT patient_num) AS patient_count, coalesce(max(strlen(tval)), 8)::INT AS width FROM obs GROUP BY concept_path""",
)(lambda ds: dictionary.build(ds.observations).withColumn("category_values", F.array_join("category_values", "|")))
query("search", r"SELECT DISTINCT concept_path FROM obs WHERE contains(lower(concept_path), 'building') OR lower(tval) = 'building'")(lambda ds: dictionary.search(dictionary.build(ds.observations), "Building").select("concept_path"))
query("info_search", "SELECT DISTINCT gene AS info_value FROM var WHERE contains(upper(gene), 'ND_1')")(lambda ds: dictionary.search_info_values(ds.variant_info, "Gene_with_variant", "nd_1"))
query("info_values", "SELECT DISTINCT consequence AS info_value FROM var")(lambda ds: dictionary.info_values(ds.variant_info, "Variant_consequence_calculated"))
query("info_columns", "SELECT 'Gene_with_variant' AS info_key, 'gene' AS description, false AS continuous, NULL::FLOAT AS min, NULL::FLOAT AS max UNION ALL SELECT 'Variant_consequence_calculated', 'consequence', false, NULL, NULL UNION ALL SELECT 'Variant_frequency', 'frequency', true, min(freq), max(freq) FROM var")(variants.info_columns)
query("page", "SELECT DISTINCT gene AS info_value FROM var ORDER BY 1 LIMIT 7 OFFSET 7")(lambda ds: dictionary.page(dictionary.info_values(ds.variant_info, "Gene_with_variant"), [F.col("info_value")], 2, 7)[0])
query("bitmap_union", f"SELECT DISTINCT patient_num FROM ({_B} UNION {_P})")(lambda ds: genomic.bitmap_ids(genomic.bitmap_union(*(genomic.to_bitmap(co.cohort(ds, Query(clause=c))) for c in (BUILDING, PRICED)))))
query("bitmap_intersection", f"SELECT count(DISTINCT patient_num)::BIGINT AS patients FROM ({_B} INTERSECT {_P})")(lambda ds: genomic.bitmap_size(genomic.bitmap_intersection(*(genomic.to_bitmap(co.cohort(ds, Query(clause=c))) for c in (BUILDING, PRICED)))))


@query("concept_normalize", r"SELECT p_partkey, '\study\parts\' || trim(p_brand) || '\' AS path FROM part", raw=True)
def _normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    messy = F.concat(F.lit("\\ parts µ  "), "p_brand", F.lit("�  \\"), "p_type", F.lit("\\\\"))
    return part.select("p_partkey", fo.rooted(fo.rolled_up(fo.normal_path(fo.clean(messy), micro=True), F.col("p_type")), F.lit("study")).alias("path"))


@query(
    "gt_classify",
    "SELECT l_orderkey, l_linenumber, CASE l_linenumber % 7 WHEN 0 THEN NULL WHEN 1 THEN '0/1' WHEN 2 THEN '1/1' WHEN 3 THEN './1' WHEN 4 THEN './.' WHEN 5 THEN '0/1' ELSE '1/1' END AS zygosity FROM lineitem",
    raw=True,
)
def _classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    gts = F.array(*(F.lit(x) for x in ("0/0", "0/1:3,4", "1/1", "./1", "./.", "1|0", "1|1:9")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", fv.genotype_class(F.element_at(gts, F.col("l_linenumber") % 7 + 1)).alias("zygosity"))


@query("spec_parse", "SELECT variant_id, spec, chrom, pos, ref, alt, gene, consequence FROM var")
def _parse(ds: Dataset) -> DataFrame:
    return ds.variants.select("variant_id", "spec", *fv.parsed_spec(F.col("spec")))


@query("info_explode", "SELECT variant_id, 'Gene_with_variant' AS info_key, gene AS info_value FROM var UNION ALL SELECT variant_id, 'Variant_consequence_calculated', consequence FROM var")
def _explode(ds: Dataset) -> DataFrame:
    rows = ds.variants.select("variant_id", F.concat(F.lit("PU=x;Gene_with_variant="), "gene", F.lit("&other;Variant_consequence_calculated="), "consequence").alias("info"))
    return fv.exploded_info(rows)


query("variant_numbers", "SELECT spec, (row_number() OVER (ORDER BY chrom, pos, ref, alt, gene, consequence) - 1)::INT AS variant_id FROM var")(lambda ds: maintain.number_variants(ds.variants).select("spec", "variant_id"))


@query("type_fixing", r"""SELECT user_id::INT AS patient_num, event_type AS concept_path, CASE WHEN e.event_id % 2 = f.first_id % 2 AND f.first_id % 2 = 0 THEN value END AS nval,
    CASE WHEN f.first_id % 2 = 1 THEN 'text' END AS tval, e.event_id AS seq FROM events e JOIN (SELECT event_type, min(event_id) AS first_id FROM events GROUP BY 1) f USING (event_type) WHERE e.event_id % 2 = f.first_id % 2""", raw=True)
def _fixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    even = F.col("event_id") % 2 == 0
    records = e.select(F.col("user_id").cast("int").alias("patient_num"), F.col("event_type").alias("concept_path"), F.when(even, F.col("value")).alias("nval"), F.when(~even, F.lit("text")).alias("tval"), F.lit(None).cast("bigint").alias("ts_ms"), F.col("event_id").alias("seq"))
    return fo.typed_by_first(records).drop("ts_ms")


@query("remap_ids", r"SELECT CASE WHEN patient_num % 2 = 0 THEN patient_num + 1000000 ELSE patient_num END AS patient_num, count(*) AS observations FROM obs GROUP BY ALL")
def _remap(ds: Dataset) -> DataFrame:
    mapping = ds.patients().where("patient_num % 2 = 0").select(F.col("patient_num").alias("old_id"), (F.col("patient_num") + 1000000).alias("new_id"))
    return maintain.remap_patients(ds.observations, mapping).groupBy("patient_num").agg(F.count("*").alias("observations"))


@query("remove_concepts", r"SELECT concept_path, count(*) AS observations FROM obs WHERE NOT starts_with(concept_path, '\demo\events\') GROUP BY ALL")
def _remove(ds: Dataset) -> DataFrame:
    gone = ds.observations.where(F.col("concept_path").startswith(EVENTS)).select("concept_path").distinct()
    return maintain.remove_concepts(ds.observations, gone).groupBy("concept_path").agg(F.count("*").alias("observations"))


@query("merge_datasets", "SELECT spec, count(*) AS carriers FROM var JOIN gt USING (variant_id) GROUP BY spec")
def _merge(ds: Dataset) -> DataFrame:
    halves = [F.col("patient_num") % 2 == k for k in (0, 1)]
    a, b = (ds.with_tables(observations=ds.observations.where(h), genotypes=ds.genotypes.where(h)) for h in halves)
    b = b.with_tables(variants=b.variants.withColumn("variant_id", F.col("variant_id") + 7), genotypes=b.genotypes.withColumn("variant_id", F.col("variant_id") + 7), variant_info=b.variant_info.withColumn("variant_id", F.col("variant_id") + 7))
    whole = maintain.merge_genomic(a, b)
    return whole.genotypes.join(whole.variants.select("variant_id", "spec"), "variant_id").groupBy("spec").agg(F.count("*").alias("carriers"))


query("rename_category", r"SELECT tval, count(*) AS observations FROM (SELECT CASE tval WHEN 'BUILDING' THEN 'HOUSES' ELSE tval END AS tval FROM obs WHERE concept_path = '\demo\customer\MKTSEGMENT\') GROUP BY tval")(
    lambda ds: maintain.rename_category(ds.observations, SEGMENT, "BUILDING", "HOUSES").where(F.col("concept_path") == SEGMENT).groupBy("tval").agg(F.count("*").alias("observations"))
)
query("hide_info_value", "SELECT 'Gene_with_variant' AS info_key, count(*) AS n FROM var WHERE gene <> 'Brand_11'")(lambda ds: maintain.hide_info_value(ds.variant_info, "Gene_with_variant", "Brand_11").where("info_key = 'Gene_with_variant'").groupBy("info_key").agg(F.count("*").alias("n")))
query("source_rows", 'SELECT patient_num AS "PATIENT_NUM", concept_path AS "CONCEPT_PATH", nval AS "NUMERIC_VALUE", tval AS "TEXT_VALUE", coalesce(ts_ms, 0) AS "DATETIME" FROM obs')(lambda ds: maintain.source_rows(ds.observations).fillna(0, ["DATETIME"]))


@query("csv_load", "SELECT patient_num, concept_path, nval, tval, coalesce(ts_ms, 0) AS ts_ms FROM obs")
def _csv_load(ds: Dataset) -> DataFrame:
    path = folder(ds.spark, "csv")
    phenotypes.write_csv(ds.observations, path)
    return phenotypes.read_csv(ds.spark, path, phenotypes.CONFIGURED).drop("seq").fillna(0, ["ts_ms"])


@query("store_scan", rf"SELECT o.patient_num, o.nval, g.n FROM obs o LEFT JOIN (SELECT patient_num, count(*) AS n FROM gt GROUP BY 1) g USING (patient_num) WHERE concept_path = '\demo\customer\ACCTBAL\'")
def _store_scan(ds: Dataset) -> DataFrame:
    path = folder(ds.spark, "store")
    save(ds, path)
    back = load(ds.spark, path)
    carried = back.genotypes.groupBy("patient_num").agg(F.count("*").alias("n"))
    return back.observations.where(F.col("concept_path") == BALANCE).join(carried, "patient_num", "left").select("patient_num", "nval", "n")


query("columnmeta_file", """SELECT concept_path AS name, coalesce(max(strlen(tval)), 8)::INT AS width_in_bytes, 0 AS column_offset, count(nval) = 0 AS categorical,
    coalesce(array_to_string(list_sort(list_distinct(list(tval) FILTER (WHERE tval IS NOT NULL))), 'µ'), '') AS category_values, min(nval) AS min, max(nval) AS max, 0::BIGINT AS all_observations_offset, 0::BIGINT AS all_observations_length,
    count(*) AS observation_count, count(DISTINCT patient_num) AS patient_count FROM obs GROUP BY concept_path""")(lambda ds: dictionary.flat_file(ds.dictionary()))
query("dictionary_totals", "SELECT categorical, count(*) AS concepts, sum(n)::BIGINT AS observations FROM (SELECT count(nval) = 0 AS categorical, count(*) AS n FROM obs GROUP BY concept_path) GROUP BY 1")(lambda ds: dictionary.totals(ds.dictionary()))
query("iso_instant", f"SELECT DISTINCT ts_ms, {_ISO} AS iso FROM obs WHERE ts_ms IS NOT NULL")(lambda ds: ds.observations.where("ts_ms is not null").select("ts_ms", fo.iso_instant(F.col("ts_ms")).alias("iso")).distinct())
