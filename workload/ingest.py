"""Ingest queries: render lines, read them back, compare with the rows they came from."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskwatch.sources import events as E
from duskwatch.sources import ingest as I
from workload import lines as L
from workload import tables as T
from workload.common import query
from workload.dashboards import GEO_CTE
from workload.staging import staging
from workload.tables_sql import lst, rank, from_rank, sql

NOW = "2024-06-01 00:00:00"
COLS = ["timestamp", "src_ip", "dst_ip", "action", "http_method", "http_path", "http_status", "http_user_agent",
        "attack_type", "severity"]
SECONDS = "date_trunc('second', \"timestamp\")"
JSON_SQL = f"""
SELECT CASE WHEN id % 3 = 0 THEN "timestamp" ELSE {SECONDS} END AS "timestamp", src_ip, dst_ip, action,
  http_method, http_path, http_status, http_user_agent, attack_type, severity, confidence, session_id,
  CAST(id % 70000 AS INTEGER) AS src_port FROM logs WHERE id % 100 <> 0"""


@query("ingest_json_logs", sql(["logs"], JSON_SQL))
def ingest_json_logs(spark, sf):
    return I.parse_json_lines(L.raw_json(spark, sf), now=NOW).filter("ok").select(
        *COLS, "confidence", "session_id", "src_port")


@query("ingest_syslog_logs", sql(["logs"], f"""
SELECT CASE WHEN id % 100 = 0 THEN TIMESTAMP '{NOW}' WHEN id % 2 = 0 THEN date_trunc('millisecond', "timestamp")
    ELSE {SECONDS} END AS "timestamp", src_ip, dst_ip,
  CASE WHEN id % 100 <> 0 THEN action END AS action, CASE WHEN id % 100 <> 0 THEN http_method END AS http_method,
  CASE WHEN id % 100 <> 0 THEN http_path END AS http_path, CASE WHEN id % 100 <> 0 THEN http_status END AS http_status,
  CASE WHEN id % 100 <> 0 THEN split_part(http_user_agent, ' ', 1) END AS http_user_agent,
  CASE WHEN id % 100 <> 0 THEN attack_type END AS attack_type, CASE WHEN id % 100 <> 0 THEN severity END AS severity,
  CASE WHEN id % 100 = 0 THEN 'syslog_raw' WHEN id % 2 = 0 THEN 'syslog_rfc5424' ELSE 'syslog_rfc3164' END AS ingestion_pipeline
FROM logs"""))
def ingest_syslog_logs(spark, sf):
    return I.parse_syslog_lines(L.raw_syslog(spark, sf), now=NOW).select(*COLS, "ingestion_pipeline")


KNOWN = lst(L.ATTACK_WORDS)
RAW_SQL = f"""
SELECT TIMESTAMP '{NOW}' AS "timestamp", src_ip, dst_ip,
  CASE WHEN action = 'FLAGGED' THEN 'ALLOWED' ELSE action END AS action, http_method, http_path, http_status,
  CAST(NULL AS VARCHAR) AS http_user_agent,
  CASE WHEN list_contains({KNOWN}, attack_type) THEN attack_type ELSE 'NONE' END AS attack_type,
  CASE WHEN attack_type IN ('SQLI', 'RCE', 'LFI') THEN 'HIGH'
    WHEN list_contains({KNOWN}, attack_type) THEN 'MEDIUM' ELSE 'INFO' END AS severity FROM logs"""


@query("ingest_raw_logs", sql(["logs"], RAW_SQL))
def ingest_raw_logs(spark, sf):
    return I.parse_raw_lines(L.raw_text(spark, sf), now=NOW).select(*COLS)


CANON = ["timestamp", "received_at", "src_ip", "src_port", "dst_ip", "protocol", "action", "http_path", "attack_type",
         "severity", "confidence", "geo_country", "geo_city", "geo_lat", "geo_lon", "geo_asn", "mitre_tactic",
         "mitre_technique", "source_format", "tier"]


@query("canonical_logs", sql(["logs", "geo_ranges", "mitre"], f"""
SELECT CASE WHEN id % 3 = 0 THEN "timestamp" ELSE {SECONDS} END AS "timestamp", TIMESTAMP '{NOW}' AS received_at,
  src_ip, CASE WHEN id % 70000 <= 65535 THEN CAST(id % 70000 AS INTEGER) END AS src_port, dst_ip, 'HTTP' AS protocol,
  action, http_path, l.attack_type, severity, least(1.0, confidence)::DOUBLE AS confidence, geo_country, geo_city, geo_lat, geo_lon,
  geo_asn, mitre_tactic, mitre_technique, 'json' AS source_format, 'hot' AS tier
FROM geo_logs l LEFT JOIN mitre m ON m.attack_type = l.attack_type WHERE id % 100 <> 0""", extra=GEO_CTE))
def canonical_logs(spark, sf):
    parsed = I.parse_json_lines(L.raw_json(spark, sf), now=NOW)
    return I.canonical_logs(parsed, source_format="json", received_at=NOW,
                            geo_ranges=T.geo_ranges(spark, sf)).select(*CANON)


@query("ingest_report", sql(["logs"], """
SELECT 'json' AS source_format, CASE WHEN id % 100 = 0 THEN 'rejected' ELSE 'accepted' END AS status, count(*) AS lines
FROM logs GROUP BY 2 UNION ALL SELECT 'syslog', 'accepted', count(*) FROM logs
UNION ALL SELECT 'raw', 'accepted', count(*) FROM logs"""))
def ingest_report(spark, sf):
    return I.ingest_report({
        "json": I.parse_json_lines(L.raw_json(spark, sf), now=NOW),
        "syslog": I.parse_syslog_lines(L.raw_syslog(spark, sf), now=NOW),
        "raw": I.parse_raw_lines(L.raw_text(spark, sf), now=NOW)})


ATTACK_CASE = "CASE threat_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in E.ATTACK_OF_THREAT.items()) + " ELSE 'OTHER' END"


@query("firewall_events_to_logs", sql(["security_events"], f"""
SELECT "timestamp", ip AS src_ip, 'HTTP' AS protocol, CASE WHEN blocked = 1 THEN 'BLOCKED' ELSE 'ALLOWED' END AS action,
  d_method AS http_method, url AS http_path, user_agent AS http_user_agent, {ATTACK_CASE} AS attack_type,
  CASE WHEN threat_level = 'info' THEN 'MEDIUM' ELSE upper(threat_level) END AS severity,
  '["' || d_pattern || '"]' AS payload_snippet, event_id AS session_id
FROM security_events WHERE blocked = 1 OR threat_type <> 'none'"""))
def firewall_events_to_logs(spark, sf):
    return E.firewall_events_to_logs(T.security_events(spark, sf)).drop("raw_log")


TRUSTED = ["203.0.0.0/26", "203.0.0.100", "10.0.0.0/8", "bad entry"]


@query("effective_client_ip", sql(["requests"], """
SELECT id, client_ip, CASE WHEN split_part(client_ip, '.', 3) = '0'
    AND (CAST(split_part(client_ip, '.', 4) AS INTEGER) < 64 OR split_part(client_ip, '.', 4) = '100')
  THEN CASE WHEN k % 4 = 1 THEN '198.51.100.' || CAST(k AS VARCHAR) WHEN k % 4 = 2 THEN '10.1.2.3'
    ELSE coalesce(x_real_ip, client_ip) END ELSE client_ip END AS effective_ip FROM requests"""))
def effective_client_ip(spark, sf):
    return E.effective_client_ip(T.requests(spark, sf), trusted=TRUSTED).select("id", "client_ip", "effective_ip")


@query("training_export", sql(["security_events"], f"""
SELECT "timestamp", ip AS source_ip, url AS target_url, user_agent, threat_type, threat_level, d_method AS method,
  action, blocked, CAST(d_ddos AS DOUBLE) AS ddos_score, CAST(length(url) AS INTEGER) AS payload_length, ai_score,
  ai_confidence, url || ' ' || user_agent AS text,
  {from_rank(f"greatest({rank('threat_level')}, CASE WHEN blocked = 1 AND threat_type = 'rate_limit_exceeded' THEN 2 WHEN blocked = 1 AND threat_type <> 'none' THEN 3 ELSE 0 END)")} AS label
FROM security_events WHERE ai_score IS NOT NULL"""))
def training_export(spark, sf):
    return E.training_export(T.security_events(spark, sf))


@query("benchmark_load", sql(["bench_requests"], """
SELECT profile, trial, label, status, latency_ms, server_processing_ms FROM bench_requests"""))
def benchmark_load(spark, sf):
    path = staging(spark, "bench")
    rows = T.bench_requests(spark, sf).withColumn("error_kind", F.lit(None).cast("string"))
    rows.select("profile", "trial", "label", "status", "latency_ms", "server_processing_ms", "error_kind").repartition(
        "profile", "trial").write.partitionBy("profile", "trial").option("header", True).csv(path)
    return E.benchmark_load(spark, path).drop("error_kind")
