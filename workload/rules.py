"""Rule detection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskwatch.operators import enrich
from duskwatch.operators import rules as R
from workload import tables as T
from workload.common import query
from workload.tables_sql import sql

# Thresholds that bite on the test events, which are minutes apart.
TEST_THRESHOLDS = [
    {"id": "thr-blocked", "name": "Blocked", "severity": "HIGH", "mitre_tactic": "Credential Access",
     "mitre_technique": "T1110",
     "threshold": {"field": "src_ip", "count": 3, "window_seconds": 86400, "filter": {"action": "BLOCKED"}}},
    {"id": "thr-path", "title": "Path volume", "severity": "MEDIUM",
     "threshold": {"field": "http_path", "count": 4, "window_seconds": 7200}},
    {"id": "thr-session", "name": "Sessions",
     "threshold": {"field": "session_id", "count": 2, "window_seconds": 3600, "filter": {"protocol": "HTTPS"}}},
    {"id": "thr-off", "enabled": False, "threshold": {"field": "src_ip", "count": 2, "window_seconds": 60}},
]
EXTRA_SIGNATURES = R.SIGNATURES + [
    {"id": "x-gt", "name": "Server errors", "severity": "LOW",
     "conditions": [{"field": "http_status", "operator": "gt", "value": 402},
                    {"field": "http_status", "operator": "lt", "value": "429"},
                    {"field": "severity", "operator": "in", "value": ["HIGH", "CRITICAL"]}]},
    {"id": "x-contains", "title": "Any curl", "conditions": [
        {"field": "http_user_agent", "operator": "contains", "value": "CURL"},
        {"field": "action", "operator": "not_equals", "value": "ALLOWED"},
        {"field": "src_ip", "operator": "sounds_like", "value": "x"}]},
    {"id": "x-flat", "name": "Blocked attack", "severity": "MEDIUM",
     "conditions": {"action": "BLOCKED", "attack_type_not": "NONE"}},
    {"id": "x-nofield", "name": "No such field", "conditions": {"nothing": "1"}},
    {"id": "x-off", "enabled": False, "conditions": {"action": "BLOCKED"}},
]

SIG_WHERE = {
    "sig-sqli-blocked": "attack_type = 'SQLI' AND action = 'BLOCKED'",
    "sig-sqli-allowed": "attack_type = 'SQLI' AND action = 'ALLOWED'",
    "sig-xss-blocked": "attack_type = 'XSS' AND action = 'BLOCKED'",
    "sig-xss-allowed": "attack_type = 'XSS' AND action = 'ALLOWED'",
    "sig-rce-any": "attack_type = 'RCE'", "sig-lfi": "attack_type = 'LFI'",
    "sig-path-traversal": r"regexp_matches(http_path, '(?i)\.\./|\.\.\\|%2e%2e|%252e')",
    "sig-ssrf": "attack_type = 'SSRF'", "sig-ddos": "attack_type = 'DDOS'",
    "sig-admin-probe": "regexp_matches(http_path, '(?i)/(admin|wp-admin|phpmyadmin|.env|config|debug|actuator|swagger)')",
    "sig-shell-access": r"regexp_matches(http_path, '(?i)\.(php|asp|aspx|jsp|cgi)\??(cmd|exec|command|shell|upload)')",
    "sig-malicious-bot": "attack_type = 'BOT' AND action = 'BLOCKED'",
    "x-gt": "http_status > 402 AND http_status < 429 AND severity IN ('HIGH', 'CRITICAL')",
    "x-contains": "contains(lower(http_user_agent), 'curl') AND action <> 'ALLOWED'",
    "x-flat": "action = 'BLOCKED' AND attack_type <> 'NONE'",
}


def _val(v) -> str:
    return "CAST(NULL AS VARCHAR)" if v is None else "'" + str(v).replace("'", "''") + "'"


SIG_SQL = " UNION ALL ".join(
    f"SELECT {_val(r['id'])} AS rule_id, {_val(r.get('name') or r.get('title'))} AS title, "
    f"{_val(r.get('severity', 'MEDIUM'))} AS severity, \"timestamp\" AS seen_at, src_ip, l.attack_type, http_path, "
    f"session_id, geo_country, CAST(id AS VARCHAR) AS log_ids, id, "
    f"coalesce(m.mitre_tactic, {_val(r.get('mitre_tactic'))}) AS mitre_tactic, "
    f"coalesce(m.mitre_technique, {_val(r.get('mitre_technique'))}) AS mitre_technique "
    f"FROM logs l LEFT JOIN mitre m ON l.attack_type = m.attack_type WHERE {SIG_WHERE[r['id']].replace('attack_type', 'l.attack_type')}"
    for r in EXTRA_SIGNATURES if r["id"] in SIG_WHERE)
SIG_COLS = ["rule_id", "title", "severity", "seen_at", "src_ip", "attack_type", "log_ids", "mitre_tactic",
            "mitre_technique"]


def tagged_logs(spark, sf):
    return enrich.mitre_enrich(T.logs(spark, sf))


@query("signature_hits", sql(["logs", "mitre"], f"SELECT {', '.join(SIG_COLS)} FROM sig", extra={"sig": SIG_SQL}))
def signature_hits(spark, sf):
    return R.signature_hits(tagged_logs(spark, sf), EXTRA_SIGNATURES).select(*SIG_COLS)


@query("rule_hit_summary", sql(["logs", "mitre"], """
SELECT rule_id, severity, mitre_tactic, mitre_technique, count(*) AS hits, count(DISTINCT src_ip) AS sources
FROM sig GROUP BY ALL""", extra={"sig": SIG_SQL}))
def rule_hit_summary(spark, sf):
    return R.rule_hit_summary(R.signature_hits(tagged_logs(spark, sf), EXTRA_SIGNATURES))


def _violations(source: str) -> str:
    import re

    parts = []
    for rid, name, threat, severity, pattern in R.CONTENT_RULES:
        p = "(?is)" + pattern.replace("'", "''")
        g = 1 if re.compile(pattern).groups == 1 else 0
        parts.append(
            f"SELECT id, '{rid}' AS rule_id, '{name}' AS rule_name, '{threat}' AS threat_type, "
            f"'{severity}' AS severity, array_to_string(regexp_extract_all(content, '{p}', {g})[1:5], ',') AS matches "
            f"FROM {source} WHERE regexp_matches(content, '{p}')")
    return " UNION ALL ".join(parts)


@query("request_rule_violations", sql(["requests"], _violations("c"), extra={
    "c": "SELECT id, url || ' ' || coalesce(body, '') || ' ' || payload || ' ' || user_agent AS content FROM requests"}))
def request_rule_violations(spark, sf):
    r = T.requests(spark, sf, shared=True)
    content = F.concat_ws(" ", "url", F.coalesce("body", F.lit("")), T.pick(T.PAYLOADS, F.col("id") % 16), "user_agent")
    return R.request_rule_violations(r.withColumn("content", content))


@query("page_rule_violations", sql([], _violations("c"), extra={
    "c": "SELECT page_id AS id, url || ' ' || html AS content FROM pages"}))
def page_rule_violations(spark, sf):
    p = T.table(spark, sf, "pages")
    return R.request_rule_violations(
        p.select(F.col("page_id").alias("id"), F.concat_ws(" ", "url", "html").alias("content")))


THR_ROWS = {"thr_rows": """
  SELECT 'thr-blocked' AS rule_id, 'Blocked' AS title, 'HIGH' AS severity, src_ip AS group_key, src_ip,
    'Credential Access' AS mitre_tactic, 'T1110' AS mitre_technique, 3 AS threshold, 86400 AS w, "timestamp" AS t, id
    FROM logs WHERE action = 'BLOCKED'
  UNION ALL SELECT 'thr-path', 'Path volume', 'MEDIUM', http_path, NULL, NULL, NULL, 4, 7200, "timestamp", id FROM logs
  UNION ALL SELECT 'thr-session', 'Sessions', 'HIGH', session_id, NULL, NULL, NULL, 2, 3600, "timestamp", id
    FROM logs WHERE protocol = 'HTTPS'"""}


@query("threshold_rolling", sql(["logs"], """
SELECT rule_id, title, severity, group_key, src_ip, t AS seen_at, id, n AS event_count, threshold,
  round(least(0.95, 0.5 + (n::DOUBLE / threshold) * 0.3), 6) AS confidence, mitre_tactic, mitre_technique
FROM (SELECT *, lag(n) OVER (PARTITION BY rule_id, group_key ORDER BY t, id) AS before FROM (
  SELECT *, count(*) OVER (PARTITION BY rule_id, group_key ORDER BY epoch_us(t)
     RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n FROM thr_rows WHERE w = 86400
  UNION ALL SELECT *, count(*) OVER (PARTITION BY rule_id, group_key ORDER BY epoch_us(t)
     RANGE BETWEEN 7200000000 PRECEDING AND CURRENT ROW) AS n FROM thr_rows WHERE w = 7200
  UNION ALL SELECT *, count(*) OVER (PARTITION BY rule_id, group_key ORDER BY epoch_us(t)
     RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS n FROM thr_rows WHERE w = 3600))
WHERE n >= threshold AND (before IS NULL OR before < threshold)""", extra=THR_ROWS))
def threshold_rolling(spark, sf):
    return R.threshold_rolling(T.logs(spark, sf), TEST_THRESHOLDS)


DISTINCT_THRESHOLDS = [
    {"id": "thr-paths", "name": "Many paths", "severity": "HIGH",
     "threshold": {"field": "src_ip", "count": 3, "window_seconds": 43200, "distinct": "http_path"}},
    {"id": "thr-sources", "name": "Many sources",
     "threshold": {"field": "http_path", "count": 4, "window_seconds": 7200, "distinct": "src_ip", "filter": {"protocol": "HTTPS"}}},
    TEST_THRESHOLDS[0]]


@query("threshold_distinct", sql(["logs"], """
SELECT rule_id, severity, group_key, src_ip, t AS seen_at, id, n AS event_count, threshold FROM (
  SELECT *, lag(n) OVER (PARTITION BY rule_id, group_key ORDER BY t, id) AS before FROM (
    SELECT 'thr-paths' AS rule_id, 'HIGH' AS severity, src_ip AS group_key, src_ip, "timestamp" AS t, id, 3 AS threshold,
      count(DISTINCT http_path) OVER (PARTITION BY src_ip ORDER BY epoch_us("timestamp")
        RANGE BETWEEN 43200000000 PRECEDING AND CURRENT ROW) AS n FROM logs
    UNION ALL SELECT 'thr-sources', 'HIGH', http_path, NULL, "timestamp", id, 4,
      count(DISTINCT src_ip) OVER (PARTITION BY http_path ORDER BY epoch_us("timestamp")
        RANGE BETWEEN 7200000000 PRECEDING AND CURRENT ROW) FROM logs WHERE protocol = 'HTTPS'
    UNION ALL SELECT 'thr-blocked', 'HIGH', src_ip, src_ip, "timestamp", id, 3,
      count(*) OVER (PARTITION BY src_ip ORDER BY epoch_us("timestamp")
        RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) FROM logs WHERE action = 'BLOCKED'))
WHERE n >= threshold AND (before IS NULL OR before < threshold)"""))
def threshold_distinct(spark, sf):
    """Thresholds on the number of different values in the window."""
    return R.threshold_rolling(T.logs(spark, sf), DISTINCT_THRESHOLDS).select(
        "rule_id", "severity", "group_key", "src_ip", "seen_at", "id", "event_count", "threshold")


RESET_EXTRA = {**THR_ROWS, "steps": """
  SELECT *, row_number() OVER (PARTITION BY rule_id, group_key ORDER BY sec) AS rn FROM (
    SELECT rule_id, title, severity, group_key, any_value(src_ip) AS src_ip, mitre_tactic, mitre_technique,
      threshold, w, epoch_us(t) // 1000000 AS sec, CAST(count(*) AS BIGINT) AS n FROM thr_rows GROUP BY ALL)""", "run": """
  SELECT rule_id, title, severity, group_key, src_ip, mitre_tactic, mitre_technique, threshold, w, sec, rn,
    n AS total, sec AS first_sec,
    CASE WHEN n >= threshold THEN CASE WHEN n % threshold > 0 THEN [{'s': sec, 'n': CAST(n % threshold AS BIGINT)}]
      ELSE [] END ELSE [{'s': sec, 'n': n}] END AS held
  FROM steps WHERE rn = 1
  UNION ALL
  SELECT rule_id, title, severity, group_key, src_ip, mitre_tactic, mitre_technique, threshold, w, sec, rn,
    total, kept[1].s AS first_sec,
    CASE WHEN total >= threshold THEN CASE WHEN total % threshold > 0
        THEN [{'s': sec, 'n': CAST(total % threshold AS BIGINT)}] ELSE [] END ELSE kept END AS held
  FROM (SELECT *, CAST(list_sum(list_transform(kept, lambda x: x.n)) AS BIGINT) AS total FROM (
    SELECT s.*, list_append(list_filter(r.held, lambda x: x.s >= s.sec - s.w), {'s': s.sec, 'n': s.n}) AS kept
    FROM run r JOIN steps s ON r.rule_id = s.rule_id AND r.group_key = s.group_key AND s.rn = r.rn + 1))"""}


@query("threshold_reset", sql(["logs"], """
SELECT rule_id, title, severity, group_key, src_ip, make_timestamp(sec * 1000000) AS seen_at,
  make_timestamp(first_sec * 1000000) AS first_seen, CAST(total // threshold AS BIGINT) AS fires,
  CAST(threshold AS BIGINT) AS event_count, round(least(0.95, 0.5 + 1.0 * 0.3), 6)::DOUBLE AS confidence,
  mitre_tactic, mitre_technique
FROM run WHERE total >= threshold""", extra=RESET_EXTRA, recursive=True))
def threshold_reset(spark, sf):
    return R.threshold_reset(T.logs(spark, sf), TEST_THRESHOLDS)
