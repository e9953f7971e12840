"""Loads of the streaming queries."""

from pyspark.sql import functions as F

from workload import streams


def test_a_load_of_the_scan_comes_in_more_than_one_piece(spark, monkeypatch):
    sizes = []
    monkeypatch.setattr(streams.scan, "stream_scan", lambda logs, path, **_: sizes.append(path) or _Done())
    logs = spark.range(40).select(F.timestamp_seconds(F.lit(1704067200)).cast("timestamp_ntz").alias("timestamp"), "id").repartition(4)
    monkeypatch.setattr(streams, "tagged_logs", lambda *_: logs)
    root = streams._scan(spark, "").removesuffix("/scan")
    assert len(sizes) == 3 and spark.read.parquet(f"{root}/in").filter("id >= 0").select(F.input_file_name().alias("f")).distinct().count() > 1


class _Done:
    def awaitTermination(self):
        pass
