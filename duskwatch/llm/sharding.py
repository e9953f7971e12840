"""Contiguous shards of nearly equal bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import positions

#: Bytes that a stored document has besides its text.
OVERHEAD = 16


def shard(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """Cut the rows, in the order of ``key``, into ``shards`` contiguous pieces of nearly equal bytes.

    A row weighs the UTF-8 bytes of its text plus ``overhead``. All rows get a global prefix
    sum from totals per partition; a row goes to the shard in whose equal share of the total
    its middle byte falls. A shard is thus off its share by less than one row at either end.
    Only key, size and checksum are moved, never texts, and any long run of equal keys or
    texts is cut like other rows.

    Columns: key, size, text_crc32, shard, slot (place in its shard, from 0). A null text
    weighs ``overhead`` and has the checksum of no bytes; null keys come first; ties and
    repeated rows are ordered by checksum, size and place in the input; an empty table gives
    no rows; other columns of the input are ignored. With fewer rows than shards, or rows
    larger than a share, some shards stay empty.
    """
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    sized = docs.select(
        F.col(key), (F.octet_length(raw) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(raw).cast("long").alias("text_crc32"))
    placed = positions(sized, [key, "text_crc32", "size"], sums=("size",))
    middle = F.expr(f"CAST((2 * before_size + size) * {int(shards)} div (2 * total_size) AS INT)")
    placed = placed.withColumn("shard", middle)
    first = placed.groupBy("shard").agg(F.min("position").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(  # one row per shard
        key, "size", "text_crc32", "shard", (F.col("position") - F.col("_first")).alias("slot"))
