"""Retention, evaluation and model queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from duskwatch.operators import evaluate as V
from duskwatch.operators import models as M
from duskwatch.operators import retention as R
from duskwatch.sources.events import training_export
from workload import tables as T
from workload.common import query
from workload.dashboards import END, START
from workload.lookups import P95
from workload.staging import staging
from workload.tables_sql import from_rank, rank, sql

AGES = {"hot_days": 7, "warm_days": 20, "cold_days": 28}
AGED = {"aged": f"""SELECT *, "timestamp" < TIMESTAMP '{T.NOW}' - INTERVAL 7 DAY AS moved_warm,
  "timestamp" < TIMESTAMP '{T.NOW}' - INTERVAL 20 DAY AS moved_cold,
  "timestamp" < TIMESTAMP '{T.NOW}' - INTERVAL 28 DAY AS purged FROM logs"""}
TIER = "CASE WHEN moved_cold THEN 'cold' WHEN moved_warm THEN 'warm' ELSE 'hot' END"


def aged(spark, sf):
    return R.retention_tiers(T.logs(spark, sf), now=T.NOW, **AGES)


@query("retention_tiers", sql(["logs"], f"SELECT id, {TIER} AS tier, moved_warm, moved_cold, purged FROM aged", extra=AGED))
def retention_tiers(spark, sf):
    return aged(spark, sf).select("id", "tier", "moved_warm", "moved_cold", "purged")


@query("retention_report", sql(["logs"], """
SELECT count(*) FILTER (moved_warm) AS moved_warm, count(*) FILTER (moved_cold) AS moved_cold,
  count(*) FILTER (purged) AS purged FROM aged""", extra=AGED))
def retention_report(spark, sf):
    return R.retention_report(aged(spark, sf))


@query("tier_stats", sql(["logs"], f"""
SELECT count(*) FILTER (t = 'hot') AS hot, count(*) FILTER (t = 'warm') AS warm, count(*) FILTER (t = 'cold') AS cold,
  count(*) AS total FROM (SELECT {TIER} AS t FROM aged WHERE NOT purged)""", extra=AGED))
def tier_stats(spark, sf):
    return R.tier_stats(aged(spark, sf).filter("not purged"))


@query("table_ageing", sql(["logs"], f"""SELECT id, {TIER} AS tier, CAST("timestamp" AS DATE) AS day FROM aged WHERE NOT purged""", extra=AGED))
def table_ageing(spark, sf):
    """The log table itself, written in two appends and aged twice, ten days apart."""
    path = staging(spark, "tiered")
    logs = T.logs(spark, sf).drop("tier")
    R.append_rows(spark, path, logs.filter("id % 2 = 0"))
    R.append_rows(spark, path, logs.filter("id % 2 <> 0"))
    earlier = dt.datetime.fromisoformat(T.NOW) - dt.timedelta(days=10)
    for now in (str(earlier), T.NOW):
        R.age_table(spark, path, now=now, **AGES)
    return R.TieredTable(spark, path).read().select("id", "tier", "day")


QUALITY = """
  SELECT *, CASE WHEN precision + recall > 0 THEN round(2 * precision * recall / (precision + recall), 4) ELSE 0 END AS f1 FROM (
  SELECT *, CASE WHEN tp + fp > 0 THEN round(tp::DOUBLE / (tp + fp), 4) ELSE 0 END AS precision,
    CASE WHEN tp + fn > 0 THEN round(tp::DOUBLE / (tp + fn), 4) ELSE 0 END AS recall,
    CASE WHEN fp + tn > 0 THEN round(fp::DOUBLE / (fp + tn), 4) ELSE 0 END AS false_positive_rate,
    round(status_0_count::DOUBLE / total_requests, 4) AS status_0_ratio FROM (
  SELECT profile, trial, count(*) AS total_requests, count(*) FILTER (status = 403) AS blocked_403,
    count(*) FILTER (label <> 'benign' AND status = 403) AS tp, count(*) FILTER (label = 'benign' AND status = 403) AS fp,
    count(*) FILTER (label <> 'benign' AND status <> 403) AS fn, count(*) FILTER (label = 'benign' AND status <> 403) AS tn,
    count(*) FILTER (status = 0) AS status_0_count FROM bench_requests GROUP BY 1, 2))"""
RANK = "list_sort(list({v}))[CAST(floor({p} * (count({v}) - 1)) AS INTEGER) + 1]"
LATENCY = f"""
  SELECT profile, trial, round(count(*) / (sum(latency_ms) / 1000.0), 2) AS throughput_req_per_sec,
    round({RANK.format(v='a', p=0.5)}, 2) AS p50_ms, round({RANK.format(v='a', p=0.95)}, 2) AS p95_ms,
    round({RANK.format(v='s', p=0.5)}, 2) AS server_p50_ms, round({RANK.format(v='s', p=0.95)}, 2) AS server_p95_ms
  FROM (SELECT *, CASE WHEN status > 0 THEN latency_ms END AS a, server_processing_ms AS s FROM bench_requests) GROUP BY 1, 2"""
LATENCY = LATENCY.replace("list(a)", "list(a) FILTER (a IS NOT NULL)").replace("list(s)", "list(s) FILTER (s IS NOT NULL)")


@query("detection_quality", sql(["bench_requests"], "SELECT * FROM q", extra={"q": QUALITY}))
def detection_quality(spark, sf):
    return V.detection_quality(T.bench_requests(spark, sf))


@query("latency_percentiles", sql(["bench_requests"], "SELECT * FROM l", extra={"l": LATENCY}))
def latency_percentiles(spark, sf):
    return V.latency_percentiles(T.bench_requests(spark, sf))


METRICS = ["precision", "recall", "false_positive_rate", "p50_ms", "p95_ms"]


@query("trial_summary", sql(["bench_requests"], " UNION ALL ".join(f"""
SELECT profile, '{m}' AS metric, round(avg({m}), 4) AS mean, round(coalesce(stddev_samp({m}), 0), 4) AS std,
  round(coalesce(stddev_samp({m}), 0) * 1.96::DOUBLE / sqrt(count(*)), 4) AS ci95_half_width
FROM q JOIN l USING (profile, trial) GROUP BY profile""" for m in METRICS), extra={"q": QUALITY, "l": LATENCY}))
def trial_summary(spark, sf):
    b = T.bench_requests(spark, sf)
    return V.trial_summary(V.detection_quality(b).join(V.latency_percentiles(b), V.RUN), METRICS)


@query("system_load", sql(["logs"], f"""
SELECT round(avg(sys_cpu), 2) AS avg_sys_cpu, round(avg(sys_memory), 2) AS avg_sys_memory,
  round({P95.format(v='sys_cpu')}, 2) AS p95_sys_cpu, round({P95.format(v='sys_memory')}, 2) AS p95_sys_memory
FROM logs WHERE received_at BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"""))
def system_load(spark, sf):
    return V.system_load(T.logs(spark, sf), start=START, end=END)


def training(spark, sf):
    return training_export(T.security_events(spark, sf))


LABEL = from_rank(f"greatest({rank('threat_level')}, CASE WHEN blocked = 1 AND threat_type = 'rate_limit_exceeded' THEN 2 "
                  f"WHEN blocked = 1 AND threat_type <> 'none' THEN 3 ELSE 0 END)")


@query("prepare_features", sql(["security_events"], f"""
SELECT "timestamp", ip AS source_ip, threat_type, threat_level, d_method AS method, action, CAST(blocked AS DOUBLE) AS blocked,
  CAST(d_ddos AS DOUBLE) AS ddos_score, CAST(length(url) AS DOUBLE) AS payload_length, ai_score, ai_confidence,
  url || ' ' || user_agent || ' ' || url || ' ' || user_agent || ' ' || threat_type || ' ' || threat_level || ' ' || d_method AS combined_text,
  {LABEL} AS label FROM security_events WHERE ai_score IS NOT NULL"""))
def prepare_features(spark, sf):
    return M.prepare_features(training(spark, sf)).select(
        "timestamp", "source_ip", "threat_type", "threat_level", "method", "action", "blocked", "ddos_score",
        "payload_length", "ai_score", "ai_confidence", "combined_text", "label")


#: Texts that a task gets; work on them costs far more than moving them, and files may be few.
TEXTS = 2500


def judged_texts(spark, sf):
    """Documents with labels as training rows, shared out evenly; what is to be learned stands only in their texts."""
    docs, labels = T.table(spark, sf, "documents"), T.table(spark, sf, "labels")
    severity = F.when(F.col("toxic") == 1, "HIGH").when(F.col("quality") == 0, "MEDIUM").otherwise("INFO")
    judged = docs.join(labels, "doc_id").select(
        "doc_id", "text", F.lit("GET").alias("method"), F.lit("allow").alias("action"), severity.alias("label"))
    pieces = max(spark.sparkContext.defaultParallelism, -(-labels.count() // TEXTS))
    return judged.repartition(pieces, "doc_id", "text")


JUDGED = """SELECT doc_id, CASE WHEN toxic = 1 THEN 'HIGH' WHEN quality = 0 THEN 'MEDIUM' ELSE 'INFO' END AS label
  FROM documents JOIN labels USING (doc_id)"""


@query("train_severity_model", f"""
SELECT label, count(*) AS support, true AS in_bounds, true AS better_than_largest_class FROM ({JUDGED}) WHERE doc_id % 5 = 0 GROUP BY 1""")
def train_severity_model(spark, sf):
    """Support of each class in the test rows, and whether the mean F1 is above that of always naming the largest class."""
    report = M.train_severity_model(judged_texts(spark, sf), key=["doc_id"], test=F.col("doc_id") % 5 == 0)[1].filter("support > 0")
    total = report.agg(F.avg("f1").alias("mean"), F.max("support").alias("most"), F.sum("support").alias("all"), F.count("*").alias("k"))
    share = F.col("most") / F.col("all")
    bounds = F.col("precision").between(0, 1) & F.col("recall").between(0, 1) & F.col("f1").between(0, 1)
    return report.join(F.broadcast(total)).select(  # one row of totals
        "label", "support", bounds.alias("in_bounds"), (F.col("mean") > 2 * share / (1 + share) / F.col("k")).alias("better_than_largest_class"))


@query("score_with_model", f"""
SELECT doc_id, true AS in_bounds FROM ({JUDGED})""")
def score_with_model(spark, sf):
    rows = judged_texts(spark, sf)
    model, _ = M.train_severity_model(rows, key=["doc_id"], test=F.col("doc_id") % 5 == 0)
    out = M.score_with_model(model, rows)
    good = (F.col("model_score").between(0, 1) & F.col("model_confidence").between(0, 1)
            & F.col("predicted_label").isin("info", "medium", "high"))
    return out.select("doc_id", good.alias("in_bounds"))


KEY = ["timestamp", "source_ip", "target_url"]


@query("anomaly_model", sql(["security_events"], """
SELECT count(*) AS rows_scored, true AS share_within_a_point, true AS in_bounds FROM security_events WHERE ai_score IS NOT NULL"""))
def anomaly_model(spark, sf):
    rows = training(spark, sf)
    scored = M.score_anomalies(M.train_anomaly_model(rows, key=KEY), rows)
    return scored.agg(
        F.count("*").alias("rows_scored"), (F.abs(F.avg(F.col("is_anomaly").cast("int")) - 0.02) <= 0.01).alias("share_within_a_point"),
        F.min(F.col("anomaly_score").between(0, 1)).alias("in_bounds"))
