"""Tables of current state, kept up to date from a stream of changes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from duskwatch.operators.alerts import ALERT_STATE, INCIDENT_STATE
from duskwatch.streaming.scan import _Folders


def _parts(changes: DataFrame, fields: list[str], stamps: dict[str, list[str]], key: str) -> DataFrame:
    """What a set of changes says of each key, in a form that adds up: a field with the time at which it was written."""
    written = [F.max(F.when(F.col(f).isNotNull(), F.struct("changed_at", "seq", F.col(f).alias("value")))).alias(f) for f in fields]
    times = [F.max(F.when(F.col("status").isin(values), F.col("changed_at"))).alias(n) for n, values in stamps.items()]
    return changes.groupBy(key).agg(*written, *times, F.max("changed_at").alias("updated_at"), F.count("*").alias("changes"))


def _added(parts: DataFrame, key: str) -> DataFrame:
    """Parts of the same key put together; in any order, so a late change falls into place."""
    rest = [c for c in parts.columns if c not in (key, "bucket", "changes")]
    return parts.groupBy("bucket", key).agg(*[F.max(c).alias(c) for c in rest], F.sum("changes").alias("changes"))


class _Versions:
    """Which folder holds each bucket after each batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folders = spark, _Folders(spark, path)
        self.path = self.folders.path

    def done(self) -> list[int]:
        """Batches whose version was written to its end."""
        found = [n for n in self.folders.names("versions") if n.startswith("batch_id=")]
        return sorted(int(n.partition("=")[2]) for n in found if "_SUCCESS" in self.folders.names(f"versions/{n}"))

    def get(self, batch: int) -> dict[int, str]:
        """Folder by bucket; as many rows as there are buckets."""
        rows = self.spark.read.schema("bucket int, folder string").parquet(f"{self.path}/versions/batch_id={batch}").collect()
        return {r["bucket"]: r["folder"] for r in rows}

    def put(self, batch: int, held: dict[int, str]) -> None:
        rows = self.spark.createDataFrame(list(held.items()), "bucket int, folder string")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/versions/batch_id={batch}")

    def read(self, held: dict[int, str], schema=None) -> DataFrame:
        paths = [f"{self.path}/rows/{folder}/bucket={b}" for b, folder in held.items()]
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(*paths)

    def sweep(self) -> None:
        """Remove what neither of the last two versions names."""
        last = self.done()[-2:]
        named = {(folder, b) for v in last for b, folder in self.get(v).items()}
        for folder in self.folders.names("rows"):
            buckets = [n for n in self.folders.names(f"rows/{folder}") if n.startswith("bucket=")]
            gone = [n for n in buckets if (folder, int(n.partition("=")[2])) not in named]
            for n in [None] if len(gone) == len(buckets) else gone:
                self.folders.remove(f"rows/{folder}/{n}" if n else f"rows/{folder}")
        for n in self.folders.names("versions"):
            if n.startswith("batch_id=") and int(n.partition("=")[2]) < last[0]:
                self.folders.remove(f"versions/{n}")


def stream_state(
    changes: DataFrame, *, path: str, checkpoint: str, fields: list[str], stamps: dict[str, list[str]], key: str = "entity_id",
    buckets: int = 64, trigger: dict | None = None,
) -> StreamingQuery:
    """Keep the current state of every key in ``path`` while changes come in; ``read_state`` gives what ``latest_state`` gives.

    Each batch is aggregated first and then put together with the ``buckets`` of keys it touches, which go to a new
    folder; the others stay as they are. A small table per batch says which folder holds each bucket. A batch that
    ends anywhere before it leaves the state as it was, and one that is sent again starts from the version before it, so
    nothing counts twice. Changes may come late and in any order. The last two versions stay readable; ``path``
    belongs to one ``checkpoint``. A bucket should fit a task: some millions of keys.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        versions = _Versions(spark, path)
        done = versions.done()
        if done and done[-1] > batch_id:
            raise RuntimeError(f"{path} has batch {done[-1]} already, of another checkpoint")
        before = max((v for v in done if v < batch_id), default=None)
        held = {} if before is None else versions.get(before)
        new = _parts(batch, fields, stamps, key).withColumn("bucket", F.pmod(F.hash(F.col(key)), F.lit(buckets)))
        name = f"{batch_id}-{uuid.uuid4().hex}"
        new.write.partitionBy("bucket").parquet(f"{versions.path}/parts/{name}")
        touched = {int(n.partition("=")[2]) for n in versions.folders.names(f"parts/{name}") if n.startswith("bucket=")}
        if touched:
            rows = spark.read.schema(new.schema).parquet(f"{versions.path}/parts/{name}")
            old = {b: folder for b, folder in held.items() if b in touched}
            if old:
                plain = new.drop("bucket").schema
                again = versions.read(old, plain).withColumn("bucket", F.pmod(F.hash(F.col(key)), F.lit(buckets)))
                rows = rows.unionByName(again)
            # Keys of a bucket lie in one task, so a bucket becomes one file.
            _added(rows.repartition("bucket"), key).write.partitionBy("bucket").parquet(f"{versions.path}/rows/{name}")
        versions.put(batch_id, held | {b: name for b in touched})
        versions.folders.remove(f"parts/{name}")
        versions.sweep()

    return (changes.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def read_state(spark: SparkSession, path: str, *, fields: list[str]) -> DataFrame:
    """The state after the last whole batch, in the columns of ``latest_state``."""
    versions = _Versions(spark, path)
    done = versions.done()
    held = versions.get(done[-1]) if done else {}
    if not held:
        raise ValueError(f"no state in {path}")
    rows = versions.read(held)
    return rows.select(*[F.col(f"{c}.value").alias(c) if c in fields else F.col(c) for c in rows.columns])


def stream_alert_state(changes: DataFrame, *, path: str, checkpoint: str, **how) -> StreamingQuery:
    """``alert_state``, kept up to date."""
    return stream_state(changes, path=path, checkpoint=checkpoint, **ALERT_STATE, **how)


def stream_incident_state(changes: DataFrame, *, path: str, checkpoint: str, **how) -> StreamingQuery:
    """``incident_state``, kept up to date."""
    return stream_state(changes, path=path, checkpoint=checkpoint, **INCIDENT_STATE, **how)
