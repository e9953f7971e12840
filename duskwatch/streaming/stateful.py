"""The ordered folds of the batch operators, with their state kept across micro-batches.

The input is a windowed aggregate in append mode: one row per key and time step,
released once the watermark has passed the step. So the rows of a key arrive in
time order, late data is settled before the fold sees it, and a busy key costs
one row per step. The step function is the one the batch fold runs.

State ends in event time: a step says until when what it remembers can still matter, and
once the watermark has passed that moment a timer drops the key. A row that comes later
meets no state, which by then is the same as meeting the old one, so results do not change.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from duskwatch.session import ROCKSDB


#: Keys share state by a hash of them, as each read, write and timer of a state is a call out of the task. A shuffle puts about
#: as many keys into each share; one share is held in memory at a time.
SHARES = 2048


class Fold(StatefulProcessor):
    """Runs ``step(state, row)`` over the rows of each key of a share in the order of their first value.

    ``until(state, row)`` is the last second at which the state can matter to a later row of its key; None keeps it.
    Keys whose time has passed go when their share is next written, or all of them when the last one's has.
    """

    def __init__(self, step: Callable, keys: list[str], columns: list[str], out: T.StructType, until: Callable | None, resolution: int):
        self.step, self.keys, self.columns, self.out, self.until, self.resolution = step, keys, columns, out, until, resolution

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", T.StructType([T.StructField("state", T.BinaryType()), T.StructField("ends", T.LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        kept, ends = self.state.get() if self.state.exists() else (None, None)
        held: dict[tuple, tuple] = pickle.loads(kept) if kept is not None else {}
        names, nk = [*self.keys, *self.columns], len(self.keys)
        arrived: dict[tuple, list[tuple]] = {}
        for pdf in rows:
            for r in pdf[names].astype(object).where(pdf[names].notna(), None).itertuples(index=False, name=None):
                arrived.setdefault(r[:nk], []).append(r[nk:])
        emitted: list[tuple] = []
        for k, mine in arrived.items():
            state = held[k][0] if k in held else None
            mine.sort(key=lambda r: r[0])
            for row in mine:
                state, out = self.step(state, row)
                emitted.extend(k + tuple(o) for o in out)
            # Rows of a step are released when the step is over.
            held[k] = state, (int(self.until(state, mine[-1])) + self.resolution + 1) * 1000 if self.until else None
        then = None
        if self.until:
            now = timerValues.getCurrentWatermarkInMs()
            held = {k: v for k, v in held.items() if k in arrived or v[1] > now}
            then = max((v[1] for v in held.values()), default=None)
        if then != ends:
            if ends is not None:
                self.handle.deleteTimer(ends)
            if then is not None:
                self.handle.registerTimer(then)
        self.state.update((pickle.dumps(held), then))
        if emitted:
            yield pd.DataFrame(emitted, columns=[f.name for f in self.out]).astype(object)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_fold(
    df: DataFrame, *, keys: list[str], order: str, values: list[str], out: list[tuple[str, str]], step: Callable,
    until: Callable | None = None, resolution: int = 1,
) -> DataFrame:
    """Streaming counterpart of ``ordered_fold``; with ``until`` keys are dropped in event time (see ``Fold``)."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    key_fields = [T.StructField(df.schema[k].name, df.schema[k].dataType, True) for k in keys]
    schema = T.StructType(key_fields + [T.StructField(n, T._parse_datatype_string(t), True) for n, t in out])
    fold = Fold(step, keys, [order, *values], schema, until, resolution)
    return df.withColumn("_share", F.pmod(F.xxhash64(*keys), F.lit(SHARES))).groupBy("_share").transformWithStateInPandas(
        statefulProcessor=fold, outputStructType=schema, outputMode="append", timeMode="EventTime" if until else "None")
