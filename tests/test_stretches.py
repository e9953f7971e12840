"""Stretches of time, running sums of which only common keys get cells, and work that is done once."""

import random

from pyspark.sql import functions as F

from duskwatch.operators import rules
from duskwatch.plans import skew, tiles
from tests.test_operators import log_frame


def test_stretches(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(-300, 3000), 7) for k, n in (("a", 400), ("b", 40), ("c", 1)) for _ in range(n)]
    got = tiles.stretches(spark.createDataFrame(rows, "k string, us bigint, w bigint"), keys=["k"], us="us", width="w").collect()
    begins, ends = [], []
    for k in "abc":
        times = sorted(us for key, us, _ in rows if key == k)
        begins += [(k, t) for before, t in zip([None, *times], times) if before is None or t - before >= 7]
        ends += [(k, t) for t, after in zip(times, [*times[1:], None]) if after is None or after - t >= 7]
    assert sorted((r.k, r.lo) for r in got if r.lo is not None) == sorted(begins) and len(begins) > 30
    assert sorted((r.k, r.hi) for r in got if r.hi is not None) == sorted(ends)


def test_values_without_a_time(spark):
    """Rows without a time are no findings; a value that has no others is taken from the count of its group."""
    df = spark.createDataFrame([("a", None, 7), ("a", 3, 7), ("b", None, 7), ("b", None, 7)], "k string, us bigint, w bigint")
    got = tiles.stretches(df, keys=["k"], us="us", width="w").filter("timeless OR lo IS NOT NULL").collect()
    assert sorted((r.k, r.lo, r.hi, r.timeless) for r in got) == [("a", 3, 3, False), ("b", None, None, True)]
    rows = [(i, float(i), "x", {"http_path": f"/{i}"}) for i in range(5)] + [(9, 0.0, "x", {"http_path": "/9"})]
    logs = log_frame(spark, rows).withColumn("timestamp", F.when(F.col("id") < 9, F.col("timestamp")))
    rule = [{"id": "p", "threshold": {"field": "src_ip", "count": 3, "window_seconds": 60, "distinct": "http_path"}}]
    assert [(r.id, r.event_count) for r in rules.threshold_rolling(logs, rule).collect()] == [(3, 3)]


def test_sums_are_the_same_with_and_without_cells(spark):
    rng = random.Random(5)
    rows = [(k, us * 400_000, rng.randrange(-3, 4), rng.random() < 0.5 or None)
            for k, n in (("hot", 2500), ("b", 9), ("c", 1)) for us in rng.sample(range(-500, 90000), n)]
    df = spark.createDataFrame(rows, "k string, us bigint, _d bigint, _m boolean")
    common = skew.common_keys(df, ["k"])
    assert {r.k for r in common.collect()} == {"hot", "b"}
    told = lambda **how: sorted((r.k, r.us, r["_sum"], r["_last"]) for r in tiles.running(df, keys=["k"], us="us", **how).collect())
    assert told(common=common) == told(common=common.filter("k = 'hot'")) == told()


def test_rows_are_read_few_times(spark):
    """Counts, cells, marks and rows read the table once each; what becomes of them is shared by all that use it."""
    rows = [(i, i * 37.5, f"10.0.{i % 300}.1" if i % 3 else "hot", {"http_path": f"/{i % 11}"}) for i in range(600)]
    rule = [{"id": "p", "threshold": {"field": "src_ip", "count": 3, "window_seconds": 600, "distinct": "http_path"}},
            {"id": "r", "threshold": {"field": "src_ip", "count": 3, "window_seconds": 600}}]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = rules.threshold_rolling(log_frame(spark, rows), rule)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("Scan ExistingRDD") <= 5
