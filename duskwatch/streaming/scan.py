"""Detection cycles over a stream: every detector, in the hit layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from duskwatch.functions.times import cycle_start, micros
from duskwatch.operators.alerts import detect
from duskwatch.schema import HITS


class _Folders:
    """What a scan keeps in its folder: rows of open cycles, marks and findings, each by the batch that wrote it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        at = self.hadoop(f"{self.path}/{folder}")
        return [f.getPath().getName() for f in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def remove(self, folder: str) -> None:
        self.fs.delete(self.hadoop(f"{self.path}/{folder}"), True)

    def marks(self, before: int) -> tuple[int | None, int | None]:
        """The newest event and the end of the last closed cycle, in microseconds, after the batches before ``before``."""
        done = [int(n.partition("=")[2]) for n in self.names("marks") if n.startswith("batch_id=")]
        last = max((b for b in done if b < before), default=None)
        if last is None:
            return None, None
        r = self.spark.read.schema("newest long, closed long").parquet(f"{self.path}/marks/batch_id={last}").first()
        return r["newest"], r["closed"]


def stream_scan(
    logs: DataFrame, *, path: str, checkpoint: str, cycle: int = 60, delay: int = 10, signatures: list[dict] | None = None,
    limits: dict[str, dict] | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """Run all detectors of ``alerts.detect`` that look at one cycle over every cycle of a log stream.

    Rows wait in ``path``/open, by cycle, until an event ``delay`` seconds past the end of their cycle has come. Then the batch
    detectors run once over the rows of the cycles that closed, so findings and their bounded lists of log ids are
    those of the batch, and go to ``path``/hits as one folder per micro-batch. Rows that come after their cycle has closed go
    to ``path``/late. A batch overwrites what it wrote before when it is replayed, and takes its marks from the batches
    before it, so a restart gives the same findings. The folder hits is what ``stream_alert_dedup`` reads.

    Between batches only two numbers are kept; open cycles are files and no state of a task. Detectors that look past a cycle have
    streams of their own (``stream_thresholds``, ``stream_new_country``).
    """
    width, late = cycle * 1_000_000, delay * 1_000_000

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folders = _Folders(spark, path)
        newest, closed = folders.marks(batch_id)
        start = micros(cycle_start(F.col("timestamp"), cycle))
        rows = batch.withColumn("cycle", start)
        is_late = F.lit(False) if closed is None else start < closed
        (rows.withColumn("late", is_late).filter("late").drop("late", "cycle").write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}"))
        rows.filter(~is_late).write.mode("overwrite").partitionBy("cycle").parquet(f"{path}/open/batch_id={batch_id}")
        here = batch.agg(F.max(micros(F.col("timestamp")))).first()[0]
        newest = max((v for v in (newest, here) if v is not None), default=None)
        end = closed
        if newest is not None:
            # Cycles are whole multiples of their width since the epoch.
            end = max((newest - late) // width * width, closed if closed is not None else -1 << 62)
            ready = _open_rows(spark, folders, batch.schema, batch_id, closed, end)
            if ready is not None:
                found = detect(ready, cycle=cycle, signatures=signatures, limits=limits, across_cycles=False)
                found.select(*[f.name for f in HITS]).write.mode("overwrite").parquet(f"{path}/hits/batch_id={batch_id}")
        spark.createDataFrame([(newest, end)], "newest long, closed long").coalesce(1).write.mode("overwrite").parquet(
            f"{path}/marks/batch_id={batch_id}")
        # What closed by the batch before cannot be asked for again.
        for b in folders.names("open"):
            for c in folders.names(f"open/{b}"):
                if closed is not None and c.startswith("cycle=") and int(c.partition("=")[2]) < closed:
                    folders.remove(f"open/{b}/{c}")
        for b in folders.names("marks"):
            if b.startswith("batch_id=") and int(b.partition("=")[2]) < batch_id - 1:
                folders.remove(f"marks/{b}")

    return (logs.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def _open_rows(spark: SparkSession, folders: _Folders, schema, batch_id: int, after: int | None, before: int) -> DataFrame | None:
    """Rows of the cycles from ``after`` to ``before`` that batches up to this one have left."""
    chosen = [
        f"{folders.path}/open/{b}/{c}" for b in folders.names("open") if b.startswith("batch_id=") and int(b.partition("=")[2]) <= batch_id
        for c in folders.names(f"open/{b}") if c.startswith("cycle=") and (after or -1 << 62) <= int(c.partition("=")[2]) < before]
    return spark.read.schema(schema).parquet(*chosen) if chosen else None


def scan_hits(spark: SparkSession, path: str) -> DataFrame:
    """The findings so far; for a stream of them read the same folder with ``readStream``."""
    return spark.read.schema(HITS).parquet(f"{path}/hits")
