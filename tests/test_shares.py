"""Keys that share the state of a stream."""

import pandas as pd
from pyspark.sql import types as T

from duskwatch.streaming import stateful

OUT = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.LongType())])


def test_keys_of_a_share_keep_apart_and_leave_when_their_time_has_passed(monkeypatch):
    class Value:
        row = None

        def exists(self):
            return self.row is not None

        def get(self):
            return self.row

        def update(self, row):
            self.row = row

    class Handle:
        timers = set()
        registerTimer, deleteTimer = timers.add, timers.discard

    class Now:
        ms = 0

        def getCurrentWatermarkInMs(self):
            return self.ms

    fold = stateful.Fold(lambda n, row: ((n or 0) + row[1], [((n or 0) + row[1],)]), ["k"], ["t", "n"], OUT, lambda n, row: row[0] + 5, 1)
    fold.handle, fold.state = Handle(), Value()

    def feed(rows, ms):
        Now.ms = ms
        out = list(fold.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["k", "t", "n"])]), Now()))
        return sorted(tuple(r) for pdf in out for r in pdf.itertuples(index=False))

    assert feed([("a", 2, 1), ("b", 1, 10), ("a", 1, 1)], 3000) == [("a", 1), ("a", 2), ("b", 10)]
    assert feed([("b", 3, 1)], 4000) == [("b", 11)]
    assert feed([("c", 9, 1)], 9500) == [("c", 1)]
    assert set(stateful.pickle.loads(fold.state.row[0])) == {("b",), ("c",)} and Handle.timers == {16000}
