"""A customer's feed is read whole, however many orders it has."""

from pyspark.sql import functions as F

from quern.plans.source_queries import src_feed_items


def test_feed_of_many_orders(spark, tmp_path):
    o = spark.range(1, 3501).select(F.col("id").alias("o_orderkey"), F.when(F.col("id") % 7 == 0, 2).otherwise(1).cast("long").alias("o_custkey"), F.lit("O").alias("o_orderstatus"), F.lit("2024-01-02").cast("timestamp_ntz").alias("o_orderdate"))
    o.write.parquet(f"{tmp_path}/orders.parquet")
    got = src_feed_items(spark, str(tmp_path)).collect()
    assert sorted((r.feed_url, int(r.upstream_id)) for r in got) == sorted(("2" if k % 7 == 0 else "1", k) for k in range(1, 3501))
