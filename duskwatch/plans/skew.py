"""Joins of a large table with a table of facts per key, when some keys hold much of the large one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.session import shuffle_partitions

#: A key is split from a thousandth of the rows on, so at most a thousand keys are.
COMMON = 1000


def common_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys, at most ``COMMON``, with at least one in ``COMMON`` rows, by exact counts that are combined before they are shuffled."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return counts.filter(F.col("_n") * COMMON >= counts.agg(F.sum("_n").alias("n")).scalar()).select(*keys)


def split_join(large: DataFrame, facts: DataFrame, key: str, *, by: list[str], parts: int | None = None) -> DataFrame:
    """Left join of ``large`` with ``facts``, one row per ``key``, with common keys spread over ``parts`` tasks.

    Common keys are those with at least one row in ``COMMON``, by exact counts that are combined before they are shuffled: both sides
    must agree on them, also when a task runs again, which an estimate does not promise. Their rows get a salt from a hash of the
    columns ``by``, and their row of facts is copied to each salt; all others have salt zero. Rows without a key are spread as
    well, as they match nothing. ``parts`` is four times the number of shuffle partitions by default, as few salts fall unevenly. The broadcast list has at most ``COMMON`` keys.
    """
    parts = parts or 4 * shuffle_partitions(large.sparkSession)
    keys = large.select(F.col(key).alias("_k"))
    total = keys.agg(F.count("*").alias("n")).scalar()
    common = keys.filter("_k IS NOT NULL").groupBy("_k").agg(F.count("*").alias("_n")).filter(F.col("_n") * COMMON >= total).select("_k")
    salt = F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int")
    marked = large.join(F.broadcast(common), F.col(key) == F.col("_k"), "left")
    salted = marked.withColumn("_salt", F.when(F.col("_k").isNotNull() | F.col(key).isNull(), salt).otherwise(0)).drop("_k")
    copied = facts.join(F.broadcast(common), F.col(key) == F.col("_k"), "left").withColumn("_salt", F.explode(
        F.when(F.col("_k").isNotNull(), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))).drop("_k")
    return salted.join(copied, [key, "_salt"], "left").drop("_salt")
