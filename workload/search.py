"""Search and paging queries."""

from __future__ import annotations

from duskwatch.operators import enrich
from duskwatch.operators import search as S
from workload import tables as T
from workload.common import query
from workload.dashboards import END, START
from workload.tables_sql import sql

LOG_COLS = ["id", "timestamp", "src_ip", "action", "attack_type", "severity", "http_path", "http_user_agent"]
LOG_SQL = 'id, "timestamp", src_ip, action, attack_type, severity, http_path, http_user_agent'
WINDOW = f"BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"


@query("log_search", sql(["logs"], f"""
SELECT {LOG_SQL} FROM logs WHERE action = 'BLOCKED' AND severity = 'HIGH' AND http_path LIKE '%item%'
AND "timestamp" {WINDOW} ORDER BY "timestamp" DESC, id DESC LIMIT 100 OFFSET 20"""))
def log_search(spark, sf):
    return S.log_search(T.logs(spark, sf), start=START, end=END, http_path="ITEM", action="BLOCKED",
                        severity="HIGH", limit=100, offset=20).select(*LOG_COLS)


@query("hunt_search", sql(["logs", "mitre"], f"""
SELECT {", ".join("l." + c.strip() for c in LOG_SQL.split(","))}, m.mitre_technique FROM logs l
LEFT JOIN mitre m ON l.attack_type = m.attack_type
WHERE contains(src_ip, '203.0.0.1') AND l.attack_type <> '' AND mitre_technique LIKE '%T1%'
AND http_method = 'PUT' AND http_status = 403 AND contains(lower(http_user_agent), 'mozilla')
AND (contains(lower(http_path), 'item') OR contains(lower(raw_log), 'item')
  OR contains(lower(http_user_agent), 'item') OR contains(src_ip, 'item') OR contains(dst_ip, 'item'))
ORDER BY "timestamp" DESC, id DESC LIMIT 200"""))
def hunt_search(spark, sf):
    logs = enrich.mitre_enrich(T.logs(spark, sf))
    return S.hunt_search(logs, 'src:203.0.0.1 code:403 mitre:t1 ua:mozilla method:get item',
                         http_method="put").select(*LOG_COLS, "mitre_technique")


A_COLS = ["id", "created_at", "severity", "status", "src_ip", "attack_type", "detection_source", "incident_id"]


@query("alert_search", sql(["linked_alerts"], f"""
SELECT {", ".join(A_COLS)} FROM linked_alerts
WHERE severity = 'CRITICAL' AND contains(detection_source, 'rule') AND contains(src_ip, '203.0.0')
AND created_at {WINDOW} AND (contains(lower(title), 'ss') OR contains(lower(http_path), 'ss')
  OR contains(lower(description), 'ss') OR contains(lower(alert_uid), 'ss') OR contains(src_ip, 'ss')
  OR contains(lower(attack_type), 'ss') OR contains(lower(coalesce(mitre_technique, '')), 'ss'))
ORDER BY created_at DESC, id DESC LIMIT 100"""))
def alert_search(spark, sf):
    return S.alert_search(T.linked_alerts(spark, sf), start=START, end=END, severity="CRITICAL",
                          detection_source="RULE", src_ip="203.0.0", search="SS").select(*A_COLS)


I_COLS = ["id", "created_at", "status", "priority", "title", "attack_types"]


@query("incident_search", sql(["incidents"], f"""
SELECT id, created_at, status, priority, title, array_to_string(attack_types, ',') AS attack_types
FROM incidents WHERE priority = 'CRITICAL' AND list_contains(attack_types, 'SQLI')
AND list_contains(mitre_techniques, 'T1190')
AND (contains(lower(title), '.1') OR contains(lower(incident_uid), '.1') OR contains(lower(description), '.1')
  OR contains(array_to_string(affected_ips, ' '), '.1') OR contains(lower(array_to_string(attack_types, ' ')), '.1')
  OR contains(lower(array_to_string(mitre_techniques, ' ')), '.1'))
ORDER BY created_at DESC, id DESC LIMIT 100"""))
def incident_search(spark, sf):
    return S.incident_search(T.incidents(spark, sf), priority="CRITICAL", attack_type="SQLI",
                             mitre_technique="T1190", search=".1").select(*I_COLS)


E_COLS = ["event_id", "timestamp", "threat_type", "threat_level", "ip", "url", "action", "blocked", "total"]
E_SQL = 'event_id, "timestamp", threat_type, threat_level, ip, url, action, blocked, total'


@query("event_log_page", sql(["security_events"], f"""
SELECT {E_SQL} FROM (SELECT *, count(*) OVER () AS total FROM security_events
WHERE threat_type = 'path_traversal' AND blocked = 1)
ORDER BY "timestamp" DESC, event_id DESC LIMIT 50 OFFSET 10"""))
def event_log_page(spark, sf):
    return S.event_log_page(T.security_events(spark, sf), threat_type="path_traversal",
                            blocked_only=True, limit=50, offset=10).select(*E_COLS)


@query("flagged_events", sql(["security_events"], f"""
SELECT {E_SQL} FROM (SELECT *, count(*) OVER () AS total FROM security_events WHERE flagged)
ORDER BY "timestamp" DESC, event_id DESC LIMIT 100"""))
def flagged_events(spark, sf):
    return S.flagged_events(T.security_events(spark, sf)).select(*E_COLS)


@query("review_queue", sql(["security_events"], f"""
SELECT {E_SQL} FROM (SELECT *, count(*) OVER () AS total FROM security_events WHERE flagged AND blocked = 0)
ORDER BY "timestamp" DESC, event_id DESC LIMIT 100"""))
def review_queue(spark, sf):
    return S.flagged_events(T.security_events(spark, sf), pending_only=True).select(*E_COLS)


@query("model_suggestions", sql(["security_events"], """
SELECT event_id, "timestamp", ip, url, model_confidence, suggestion AS predicted FROM security_events
WHERE model_confidence >= 0.4 ORDER BY "timestamp" DESC, event_id DESC LIMIT 100"""))
def model_suggestions(spark, sf):
    return S.model_suggestions(T.security_events(spark, sf), min_confidence=0.4)
