"""Ordered per-key folds over pre-aggregated rows.

Some results depend on their own past: a window that is anchored at the row
that opened it, a counter that clears when it fires, a limiter that forgets
what it rejected. These run as a fold in time order.

The input must already be reduced to one row per (key, time step) by a normal
aggregate, which Spark combines before it shuffles. What one key can bring to
a task is then bounded by the number of time steps in the data and not by its
traffic, and the fold itself holds one small state per key while it streams
through sorted Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from duskwatch.session import shuffle_partitions

Step = Callable[[Any, tuple], tuple[Any, list[tuple]]]


def ordered_fold(
    df: DataFrame,
    *,
    keys: list[str],
    order: list[str],
    values: list[str],
    out: list[tuple[str, str]],
    step: Step,
) -> DataFrame:
    """Fold rows of each key in order.

    ``step(state, row)`` gets the state so far (``None`` at the first row of a
    key) and the values of ``order + values``; it returns the next state and
    the rows to emit, each a tuple for the columns in ``out`` (name, DDL type).
    Keys may be null. Output rows carry the keys first.
    """
    n = shuffle_partitions(df.sparkSession)
    cols = [*keys, *order, *values]
    arranged = (
        df.select(*cols).repartition(n, *keys).sortWithinPartitions(*keys, *order)
    )
    key_fields = [arranged.schema[k] for k in keys]
    out_schema = T.StructType(
        [T.StructField(f.name, f.dataType, True) for f in key_fields]
        + [T.StructField(n_, T._parse_datatype_string(t), True) for n_, t in out]
    )
    names = [f.name for f in out_schema]
    nk = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow_schema = to_arrow_schema(out_schema, prefers_large_types=False)
        current: tuple | None = None
        state: Any = None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            rows: list[tuple] = []
            for row in zip(*columns):
                key = row[:nk]
                if key != current:
                    current, state = key, None
                state, emitted = step(state, row[nk:])
                rows.extend(key + e for e in emitted)
            if rows:
                arrays = [
                    pa.array(list(v), type=arrow_schema.field(i).type)
                    for i, v in enumerate(zip(*rows))
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return arranged.mapInArrow(run, out_schema)


def anchored(width: int) -> Step:
    """Anchor of each time step: a step opens a window of ``width`` or joins the open one.

    The window runs from the step that opened it, both ends included, and does
    not grow when rows join. Row layout: (time, ...); emits (time, anchor).
    """

    def step(anchor, row):
        t = row[0]
        if anchor is None or t - anchor > width:
            anchor = t
        return anchor, [(t, anchor)]

    return step
