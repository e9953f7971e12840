"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Memory that the RocksDB states of an executor share, however many there are, and no disk ahead of need, which each state would take.
#: A session's own settings go first.
ROCKSDB_BOUNDS = {"boundedMemoryUsage": "true", "maxMemoryUsageMB": "256", "allowFAllocate": "false"}


def configure(spark: SparkSession) -> SparkSession:
    """Log times are naive UTC, so the session has to read them as UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def state_on_disk(spark: SparkSession) -> None:
    """State of streams started from now on lies on disk and takes a fixed share of an executor's memory.

    Spark's default keeps all rows of a state in the heap. A stream that has a checkpoint goes on with the provider it began with.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    for name, value in ROCKSDB_BOUNDS.items():
        key = f"spark.sql.streaming.stateStore.rocksdb.{name}"
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for stream checkpoints and staged tables that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; a session without it uses its
    warehouse, which is shared as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return root.rstrip("/")
