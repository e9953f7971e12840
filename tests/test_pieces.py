"""Tables shared out in pieces."""

from pyspark.sql import functions as F

from workload import tables


def test_pieces_of_a_table_do_not_grow_with_it(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "PIECE", 100)
    path = str(tmp_path / "t.parquet")
    spark.range(1000).select("id", F.lit(None).cast("string").alias("none")).coalesce(1).write.parquet(path)
    sizes = tables.spread(spark.read.parquet(path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 9 and max(r["count"] for r in sizes) < 300
