"""The driver's star-schema tables read as a cohort dataset: customers are patients, orders and events their observations, parts
variants, and what customers bought their genotypes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.schema import BUCKET, Dataset

SEGMENT, NATION, BALANCE = "\\demo\\customer\\MKTSEGMENT\\", "\\demo\\customer\\NATION\\", "\\demo\\customer\\ACCTBAL\\"
PRICE, PRIORITY, STATUS = "\\demo\\orders\\TOTALPRICE\\", "\\demo\\orders\\PRIORITY\\", "\\demo\\orders\\STATUS\\"
EVENTS = "\\demo\\events\\"


#: A part's contig and position.
CONTIG = lambda key: F.concat(F.lit("chr"), (F.col(key) % 22 + 1).cast("string"))
PLACE = "({} * 137 + 10000)".format


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(df: DataFrame, patient: str, path: Column, nval: Column | None, tval: Column | None, ts: str | None = None, seq: str | None = None) -> DataFrame:
    ms = F.unix_millis(F.col(ts).cast("timestamp")) if ts else F.lit(None).cast("bigint")
    return df.select(
        F.col(patient).cast("int").alias("patient_num"), path.alias("concept_path"), (F.lit(None) if nval is None else nval).cast("double").alias("nval"),
        (F.lit(None) if tval is None else tval).cast("string").alias("tval"), ms.alias("ts_ms"), (F.col(seq) if seq else F.lit(0)).cast("bigint").alias("seq"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, orders, events = (table(spark, sf_dir, n) for n in ("customer", "nation", "orders", "events"))
    placed = customer.join(nation, customer["c_nationkey"] == nation["n_nationkey"])
    parts = [
        _rows(customer, "c_custkey", F.lit(SEGMENT), None, F.col("c_mktsegment")),
        _rows(placed, "c_custkey", F.lit(NATION), None, F.col("n_name")),
        _rows(customer, "c_custkey", F.lit(BALANCE), F.col("c_acctbal"), None),
        _rows(orders, "o_custkey", F.lit(PRICE), F.col("o_totalprice"), None, "o_orderdate", "o_orderkey"),
        _rows(orders, "o_custkey", F.lit(PRIORITY), None, F.col("o_orderpriority"), "o_orderdate", "o_orderkey"),
        _rows(orders, "o_custkey", F.lit(STATUS), None, F.col("o_orderstatus"), "o_orderdate", "o_orderkey"),
        _rows(events, "user_id", F.concat(F.lit(EVENTS), "event_type", F.lit("\\")), F.col("value"), None, "ts", "event_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sized(spark: SparkSession, *tables: DataFrame) -> None:
    """Exchanges start with a partition for every 4 MB of the tables' files, and adaptive execution joins them up to 16 MB: with a fixed number of partitions
    a task's sorts and hash tables grow as the input does. Wider or finer settings of the session stay."""
    size = sum(int(t._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) for t in tables)
    first, most = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(first, max(int(spark.conf.get(first, None) or 0), int(spark.conf.get("spark.sql.shuffle.partitions")), size >> 22))
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(most)) > 16 << 20:
        spark.conf.set(most, "16m")


def dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    part, lineitem, orders = (table(spark, sf_dir, n) for n in ("part", "lineitem", "orders"))
    sized(spark, lineitem, orders, table(spark, sf_dir, "events"))
    letter = lambda shift: F.substring(F.lit("ACGT"), (F.col("p_size") + shift) % 4 + 1, F.lit(1))
    variants = part.select(
        F.col("p_partkey").cast("int").alias("variant_id"), CONTIG("p_partkey").alias("chrom"), F.expr(PLACE("p_partkey")).cast("int").alias("pos"),
        letter(0).alias("ref"), letter(1).alias("alt"), F.translate("p_brand", "#", "_").alias("gene"), F.lower("p_type").alias("consequence"), F.col("p_retailprice"),
    )
    frequency = (F.col("p_retailprice") / 1e6).cast("float")
    none = F.lit(None).cast("float")
    entry = lambda key, value, number: F.struct(F.lit(key).alias("info_key"), value.alias("info_value"), number.alias("info_num"))
    entries = [entry("Gene_with_variant", F.col("gene"), none), entry("Variant_consequence_calculated", F.col("consequence"), none), entry("Variant_frequency", frequency.cast("string"), frequency)]
    info = variants.select("variant_id", F.inline(F.array(*entries)))
    flags = lineitem.join(orders, lineitem["l_orderkey"] == orders["o_orderkey"]).groupBy("o_custkey", "l_partkey").agg(F.min("l_returnflag").alias("flag"))
    genotypes = flags.where("flag in ('A', 'R')").select(F.col("l_partkey").cast("int").alias("variant_id"), F.col("o_custkey").cast("int").alias("patient_num"), F.when(F.col("flag") == "A", "0/1").otherwise("1/1").alias("zygosity"), CONTIG("l_partkey").alias("chrom"), F.expr(f"{PLACE('l_partkey')} div {BUCKET}").cast("int").alias("bucket"))
    columns = spark.createDataFrame([("Gene_with_variant", "gene", False, None, None), ("Variant_consequence_calculated", "consequence", False, None, None), ("Variant_frequency", "frequency", True, None, None)], "info_key string, description string, continuous boolean, min float, max float")
    spec = F.concat_ws(",", "chrom", F.col("pos").cast("string"), "ref", "alt", "gene", "consequence")
    placed = variants.withColumn("spec", spec).withColumn("bucket", F.expr(f"pos div {BUCKET}").cast("int"))
    raw = F.array(F.concat(F.lit("Gene_with_variant="), "gene", F.lit(";Variant_consequence_calculated="), "consequence"))
    return Dataset(
        observations(spark, sf_dir), placed.select("variant_id", "spec", "chrom", "pos", "ref", "alt", "gene", "consequence", "bucket"), genotypes, info, columns,
        placed.select("spec", "chrom", "bucket", raw.alias("info_raw")),
    )


#: The same dataset as common table expressions, for the SQL that results are compared with.
SQL = r"""WITH obs AS (
  SELECT c_custkey::INT AS patient_num, '\demo\customer\MKTSEGMENT\' AS concept_path, NULL::DOUBLE AS nval, c_mktsegment AS tval, NULL::BIGINT AS ts_ms, 0::BIGINT AS seq FROM customer
  UNION ALL SELECT c_custkey::INT, '\demo\customer\NATION\', NULL, n_name, NULL, 0 FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT c_custkey::INT, '\demo\customer\ACCTBAL\', c_acctbal, NULL, NULL, 0 FROM customer
  UNION ALL SELECT o_custkey::INT, '\demo\orders\TOTALPRICE\', o_totalprice, NULL, epoch_us(o_orderdate::TIMESTAMP) // 1000, o_orderkey FROM orders
  UNION ALL SELECT o_custkey::INT, '\demo\orders\PRIORITY\', NULL, o_orderpriority, epoch_us(o_orderdate::TIMESTAMP) // 1000, o_orderkey FROM orders
  UNION ALL SELECT o_custkey::INT, '\demo\orders\STATUS\', NULL, o_orderstatus, epoch_us(o_orderdate::TIMESTAMP) // 1000, o_orderkey FROM orders
  UNION ALL SELECT user_id::INT, '\demo\events\' || event_type || '\', value, NULL, epoch_us(ts::TIMESTAMP) // 1000, event_id FROM events),
pat AS (SELECT DISTINCT patient_num FROM obs),
var AS (
  SELECT *, concat_ws(',', chrom, pos, ref, alt, gene, consequence) AS spec, pos // 1000 AS bucket FROM (
    SELECT p_partkey::INT AS variant_id, 'chr' || (p_partkey % 22 + 1) AS chrom, (p_partkey * 137 + 10000)::INT AS pos, substr('ACGT', p_size % 4 + 1, 1) AS ref,
      substr('ACGT', (p_size + 1) % 4 + 1, 1) AS alt, replace(p_brand, '#', '_') AS gene, lower(p_type) AS consequence, (p_retailprice / 1e6)::FLOAT AS freq FROM part)),
gt AS (SELECT l_partkey::INT AS variant_id, o_custkey::INT AS patient_num, CASE min(l_returnflag) WHEN 'A' THEN '0/1' ELSE '1/1' END AS zygosity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey HAVING min(l_returnflag) IN ('A', 'R'))
"""
