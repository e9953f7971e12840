"""Compute costly columns once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later filters do not re-derive.

    A filter on a projected column is pushed below the projection with the
    column's expression written out in it. For a verdict over hundreds of
    patterns that means evaluating it twice, from unshared pieces. Handing the
    columns out through ``inline`` of a one-element array ends the pushdown.
    Inside ``transform`` they also stay out of the generated code of the stage,
    which with hundreds of patterns becomes one method too long to be compiled
    by the JVM and then runs many times slower.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    one = F.transform(F.array(F.lit(0)), lambda _: row)
    keep = [c for c in df.columns if c not in columns]
    return df.select(*keep, F.inline(one))
