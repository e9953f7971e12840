"""Small results that several later passes need, computed once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from duskwatch.session import checkpoint_root


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed now and kept in the shared folder, from where any executor can read it again."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(checkpoint_root(spark))
    return df.checkpoint()
