"""Evaluation of detection benchmarks: quality, latency, trials, system load."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.operators.dashboards import time_window_filter
from duskwatch.plans.ranks import exact_rank_values

# Labels that are attacks.
ATTACK_LABELS = ["sqli", "xss", "misc"]
RUN = ["profile", "trial"]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.round(a / b, 4)).otherwise(0.0)


def detection_quality(rows: DataFrame) -> DataFrame:
    """Confusion counts and rates per profile and trial; status 403 is "detected"."""
    hit = F.col("status") == 403
    attack, benign = F.col("label").isin(ATTACK_LABELS), F.col("label") == "benign"
    m = rows.groupBy(*RUN).agg(
        F.count("*").alias("total_requests"), F.count_if(hit).alias("blocked_403"),
        F.count_if(attack & hit).alias("tp"), F.count_if(benign & hit).alias("fp"),
        F.count_if(attack & ~hit).alias("fn"), F.count_if(benign & ~hit).alias("tn"),
        F.count_if(F.col("status") == 0).alias("status_0_count"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    m = m.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn),
                       "false_positive_rate": _ratio(fp, fp + tn),
                       "status_0_ratio": _ratio(F.col("status_0_count"), F.col("total_requests"))})
    p, r = F.col("precision"), F.col("recall")
    return m.withColumn("f1", F.when(p + r > 0, F.round(2 * p * r / (p + r), 4)).otherwise(0.0))


def latency_percentiles(rows: DataFrame) -> DataFrame:
    """p50 and p95 of answered requests and throughput, per profile and trial."""
    # A benchmark has a handful of profiles and trials.
    ranks = exact_rank_values(rows.filter("status > 0"), groups=RUN, value="latency_ms",
                              ps={"p50_ms": 0.5, "p95_ms": 0.95}, few_groups=True)
    server = exact_rank_values(rows, groups=RUN, value="server_processing_ms",
                               ps={"server_p50_ms": 0.5, "server_p95_ms": 0.95}, few_groups=True)
    seconds = F.sum("latency_ms") / 1000.0
    load = rows.groupBy(*RUN).agg(F.when(seconds > 0, F.round(F.count("*") / seconds, 2)).otherwise(0.0)
                                  .alias("throughput_req_per_sec"))
    out = load.join(ranks, RUN, "left").join(server, RUN, "left")
    return out.select(*RUN, "throughput_req_per_sec", *[
        F.round(c, 2).alias(c) for c in ("p50_ms", "p95_ms", "server_p50_ms", "server_p95_ms")])


def trial_summary(trials: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean, sample deviation and 95 % half-width per profile and metric over its trials."""
    long = trials.select("profile", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])).alias("x"))
    n = F.count("x.v")
    std = F.coalesce(F.stddev_samp("x.v"), F.lit(0.0))
    return long.groupBy("profile", F.col("x.metric").alias("metric")).agg(
        F.round(F.avg("x.v"), 4).alias("mean"), F.round(F.when(n > 1, std).otherwise(0.0), 4).alias("std"),
        F.round(F.when(n > 1, std * 1.96 / F.sqrt(n)).otherwise(0.0), 4).alias("ci95_half_width"))


def system_load(logs: DataFrame, *, start: str, end: str) -> DataFrame:
    """Mean and p95 of CPU and memory over a window of receipt times."""
    rows = time_window_filter(logs, "received_at", start=start, end=end).filter(
        "sys_cpu is not null and sys_memory is not null")
    stats = rows.agg(F.round(F.avg("sys_cpu"), 2).alias("avg_sys_cpu"),
                     F.round(F.avg("sys_memory"), 2).alias("avg_sys_memory")).withColumn("_k", F.lit(1))
    for value, name in (("sys_cpu", "p95_sys_cpu"), ("sys_memory", "p95_sys_memory")):
        tail = exact_rank_values(rows, groups=[], value=value, ps={name: 0.95})
        stats = stats.join(tail.withColumn(name, F.round(name, 2)).withColumn("_k", F.lit(1)), "_k", "left")
    return stats.drop("_k")
