"""Helpers shared by the corpus operators: shared folders, Arrow maps, global positions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskwatch.session import checkpoint_root

#: What the contract calls a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows an Arrow map handles at a time; texts may be long, so batches stay small.
SLICE = 256


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or in a session without it one in its warehouse."""
    root = checkpoint_root(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root


def frozen(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that later passes see the same rows and order."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of its own in the shared folder, for wide rows that compress well."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_rows(df: DataFrame, columns: list[str | Column], schema: str, row: Callable[..., list[tuple] | tuple | None]) -> DataFrame:
    """Apply ``row(*values)`` to each row through Arrow; it returns a tuple, a list of tuples or None."""
    out = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(out)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows: list[tuple] = []
                for values in zip(*(c.to_pylist() for c in part.columns)):
                    found = row(*values)
                    if isinstance(found, tuple):
                        rows.append(found)
                    elif found:
                        rows.extend(found)
                if rows:
                    yield to_batch(rows, target)

    return df.select(*columns).mapInArrow(run, out)


def keep_rows(df: DataFrame, column: str, good: Callable[[object], bool]) -> DataFrame:
    """Rows of ``df``, all columns as they are, for which ``good(value of column)`` holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                values = part.column(part.schema.get_field_index(column)).to_pylist()
                yield part.filter(pa.array([bool(good(v)) for v in values], type=pa.bool_()))

    return df.mapInArrow(run, df.schema)


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema, prefers_large_types=False)


def to_batch(rows: list[tuple], target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(v), type=f.type) for v, f in zip(zip(*rows), target)], schema=target)


def positions(df: DataFrame, order: list[str], sums: tuple[str, ...] = ()) -> DataFrame:
    """Number all rows in one global order, without a task that sees them all.

    Rows are range-partitioned by ``order`` (the place in the input breaks ties, so
    equal keys still spread) and frozen. Each partition is numbered by itself, and the
    totals of the partitions before it, one row per partition, are added. Gives
    ``position`` from 0, and ``before_<c>``, the sum of ``c`` over all earlier rows, for
    each column in ``sums``; ``total`` and ``total_<c>`` over all rows.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = frozen(
        df.withColumn("_at", F.monotonically_increasing_id())
        .repartitionByRange(n, *order, "_at").withColumn("_part", F.spark_partition_id()))
    counted = {"position": F.lit(1)} | {f"before_{c}": F.col(c) for c in sums}
    totals = laid.groupBy("_part").agg(*(F.sum(v).alias(f"_{k}") for k, v in counted.items()))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "_part",
        *(F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_{k}") for k in counted),
        *(F.sum(f"_{k}").over(whole).alias(k.replace("before_", "total_").replace("position", "total")) for k in counted))
    here = Window.partitionBy("_part").orderBy(*order, "_at")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    numbered = laid.select("*", (F.row_number().over(here) - 1).cast("long").alias("position"),
                           *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}") for c in sums))
    placed = numbered.join(F.broadcast(totals), "_part")  # one row per partition
    for k in counted:
        placed = placed.withColumn(k, F.col(k) + F.col(f"_{k}"))
    return placed.drop("_part", "_at", *(f"_{k}" for k in counted))
