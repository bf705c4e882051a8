"""Partitions follow the input's size."""

from strandline.plans import testbed


def test_exchanges_are_sized_by_the_input(spark, sf_dir):
    first, most = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    try:
        testbed.sized(spark, spark.range(100_000_000))  # 800 MB
        assert int(spark.conf.get(first)) == 190
        testbed.sized(spark, spark.range(1))
        assert int(spark.conf.get(first)) == 190 and spark.conf.get(most) == "16m"
    finally:
        spark.conf.unset(first), spark.conf.unset(most)
