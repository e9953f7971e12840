"""Alert, incident, playbook and response queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskwatch.functions.text import any_rlike
from duskwatch.operators import alerts as A
from duskwatch.operators import behavior as B
from duskwatch.operators import correlate as C
from duskwatch.operators import response as P
from workload import tables as T
from workload.common import query
from workload.dashboards import END, NOW
from workload.rules import EXTRA_SIGNATURES, RESET_EXTRA, SIG_SQL, TEST_THRESHOLDS, tagged_logs
from workload.tables_sql import floor_to, from_rank, lst, rank, sql

DAY = 86400
DAYC = floor_to('"timestamp"', DAY)
LIMITS = {
    "high_request_rate": {"threshold": 5}, "high_block_rate": {"threshold": 3},
    "ip_burst": {"count": 3, "seconds": 3600}, "scan_path_hits": {"threshold": 2},
    "path_diversity": {"threshold": 4}, "attack_burst": {"count": 10, "seconds": 7200},
}


def detections(spark, sf):
    """All findings."""
    return A.detect(tagged_logs(spark, sf), cycle=DAY, signatures=EXTRA_SIGNATURES, thresholds=TEST_THRESHOLDS, limits=LIMITS)


FIRST_ID = 'arg_min(id, ("timestamp", id))'


def _hit(source, title, severity, attack, conf, *, where="true", having="true", count="count(*)",
         key="src_ip", ip="src_ip", path="NULL", log="min(id)", rows="logs") -> str:
    return f"""
SELECT '{source}' AS source, '{source}' AS rule_id, {title} AS title, {severity} AS severity,
  max("timestamp") AS seen_at, {ip} AS src_ip, {attack} AS attack_type, {path} AS http_path,
  CAST({count} AS BIGINT) AS event_count, CAST({conf} AS DOUBLE) AS confidence, CAST({log} AS BIGINT) AS log_id
FROM {rows} WHERE {where} GROUP BY {DAYC}, {key} HAVING {having}"""


ATT = "attack_type <> 'NONE'"
KINDS = "array_to_string(list_sort(list(DISTINCT attack_type) FILTER (attack_type <> 'NONE')), ', ')"
RECON = "'" + "', '".join(C.RECON) + "'"
EXPLOIT = "'" + "', '".join(C.EXPLOIT) + "'"
WIDE = "count(DISTINCT src_ip) > 3"

HITS_SQL = " UNION ALL ".join([
    """SELECT 'rule' AS source, rule_id, title, severity, seen_at, src_ip, attack_type, http_path,
       1::BIGINT AS event_count, 0.85::DOUBLE AS confidence, id AS log_id FROM sig""",
    """SELECT 'threshold', rule_id, title, severity, make_timestamp(sec * 1000000), src_ip, NULL, NULL,
       CAST(threshold AS BIGINT), round(least(0.95, 0.5 + 1.0 * 0.3), 6)::DOUBLE, NULL FROM run WHERE total >= threshold""",
    _hit("behavioral.rate", "'High request rate from ' || src_ip",
         "CASE WHEN count(*) > 10 THEN 'HIGH' ELSE 'MEDIUM' END", "'DDOS'",
         "round(least(0.95, 0.5 + (count(*)::DOUBLE / 5) * 0.3), 6)", having="count(*) >= 5"),
    _hit("behavioral.rate", "'High block rate for ' || src_ip", "'HIGH'", "'BRUTE_FORCE'", "0.8",
         where="action = 'BLOCKED'", having="count(*) >= 3"),
    f"""SELECT 'behavioral.rate', 'behavioral.rate', 'Burst traffic from ' || src_ip, 'HIGH',
       arg_min(e, ("timestamp", id)), src_ip, 'DDOS', NULL, 3::BIGINT, 0.9::DOUBLE, NULL
       FROM (SELECT *, lead("timestamp", 2) OVER (PARTITION BY {DAYC}, src_ip ORDER BY "timestamp", id) AS e FROM logs)
       WHERE e <= "timestamp" + INTERVAL 1 HOUR GROUP BY {DAYC}, src_ip""",
    f"""SELECT 'behavioral.geo', 'behavioral.geo', 'Attack from high-risk country (' || geo_country || ')', 'HIGH',
       "timestamp", src_ip, attack_type, NULL, 1::BIGINT, 0.75::DOUBLE, id FROM logs
       WHERE geo_country IN ('KP', 'IR', 'SY', 'CU', 'VE') AND {ATT}""",
    _hit("behavioral.geo", "'Multi-country session anomaly'", "'HIGH'", "NULL", "0.85", key="session_id",
         ip='arg_min(src_ip, ("timestamp", id))', having="count(DISTINCT geo_country) >= 3", log="min(id)"),
    f"""SELECT 'behavioral.geo', 'behavioral.geo', 'New traffic from watch-list country: ' || geo_country, 'LOW',
       seen_at, NULL, NULL, NULL, n, 0.5::DOUBLE, NULL FROM (
       SELECT *, row_number() OVER (PARTITION BY geo_country ORDER BY d) AS rn FROM (
         SELECT geo_country, {DAYC} AS d, count(*) AS n, max("timestamp") AS seen_at FROM logs
         WHERE geo_country IN ('RU', 'CN', 'BY', 'UA') GROUP BY 1, 2)) WHERE rn = 1""",
    _hit("behavioral.pattern", "'Directory enumeration from ' || src_ip", "'HIGH'", "'PORT_SCAN'", "0.85",
         where=f"regexp_matches(http_path, '{any_rlike(B.SCAN_PATHS)}')", having="count(*) >= 2"),
    _hit("behavioral.pattern", "'High path diversity from ' || src_ip", "'MEDIUM'", "'PORT_SCAN'", "0.7",
         count="count(DISTINCT http_path)", having="count(DISTINCT http_path) >= 4"),
    _hit("behavioral.pattern", "'Suspicious tool detected: ' || src_ip", "'HIGH'", "'BOT'", "0.9", count="1",
         where=f"regexp_matches(http_user_agent, '{any_rlike(B.SUSPICIOUS_AGENTS)}')", log=FIRST_ID
         ).replace('max("timestamp") AS seen_at', 'min("timestamp") AS seen_at'),
    _hit("correlation.ip", f"'Multi-vector attack from ' || src_ip || ': ' || {KINDS}", "'CRITICAL'", "'OTHER'",
         "0.9", where=ATT, having="count(DISTINCT attack_type) >= 3"),
    _hit("correlation.ip", "'Coordinated attack on ' || http_path || ' from ' || CAST(count(DISTINCT src_ip) AS VARCHAR) || ' addresses'",
         "'CRITICAL'", "'OTHER'", "0.85", where=ATT, key="http_path", ip="min(src_ip)", path="http_path",
         having="count(DISTINCT src_ip) >= 5"),
    _hit("correlation.session", f"'Session multi-attack: ' || {KINDS}", "'HIGH'", "'OTHER'", "0.8", key="session_id",
         ip='arg_min(src_ip, ("timestamp", id))',
         having="count(*) >= 2 AND count(DISTINCT attack_type) FILTER (attack_type <> 'NONE') >= 2"),
    _hit("correlation.session", "'Escalating severity in session'", "'HIGH'", "NULL", "0.75", key="session_id",
         ip='arg_min(src_ip, ("timestamp", id))',
         rows=f"""(SELECT *, lag(r) OVER (PARTITION BY session_id ORDER BY "timestamp", id) AS p FROM (
           SELECT *, {rank('severity')} AS r FROM logs))""",
         having='count(*) >= 3 AND bool_and(p IS NULL OR p <= r) AND arg_max(r, ("timestamp", id)) >= 3'),
    f"""SELECT 'correlation.time', 'correlation.time',
       'Attack burst from ' || CAST(count(DISTINCT src_ip) AS VARCHAR) || ' addresses',
       CASE WHEN {WIDE} THEN 'CRITICAL' ELSE 'HIGH' END, max("timestamp"), min(src_ip),
       CASE WHEN {WIDE} THEN 'DDOS' ELSE 'OTHER' END, NULL, count(*), 0.9::DOUBLE, min(id)
       FROM (SELECT d, min("timestamp") AS s FROM (
           SELECT *, lead("timestamp", 9) OVER (PARTITION BY d ORDER BY "timestamp", id) AS e
           FROM (SELECT *, {DAYC} AS d FROM logs WHERE {ATT}))
         WHERE e <= "timestamp" + INTERVAL 2 HOUR GROUP BY 1) b
       JOIN (SELECT *, {DAYC} AS d2 FROM logs WHERE {ATT}) l
         ON l.d2 = b.d AND l."timestamp" BETWEEN b.s AND b.s + INTERVAL 2 HOUR GROUP BY b.d""",
    _hit("correlation.time", "'Recon and exploit chain from ' || src_ip", "'CRITICAL'", "'OTHER'", "0.9",
         rows=f"(SELECT *, count(*) OVER (PARTITION BY {DAYC}) AS per_day FROM logs WHERE {ATT})",
         where="per_day >= 10",
         having=f"bool_or(attack_type IN ({RECON})) AND bool_or(attack_type IN ({EXPLOIT}))"),
])
HITS_EXTRA = {"sig": SIG_SQL, **RESET_EXTRA, "hits0": HITS_SQL, "hits": """
    SELECT * EXCLUDE (severity), CASE WHEN severity IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL') THEN severity
      ELSE 'MEDIUM' END AS severity FROM hits0"""}
HIT_COLS = ["source", "rule_id", "title", "severity", "seen_at", "src_ip", "attack_type", "http_path",
            "event_count", "confidence"]


@query("all_detections", sql(["logs", "mitre"], f"SELECT {', '.join(HIT_COLS)} FROM hits",
                             extra=HITS_EXTRA, recursive=True))
def all_detections(spark, sf):
    return detections(spark, sf).select(*HIT_COLS)


KEY = "source, rule_id, src_ip, attack_type, http_path"
MATCH = " AND ".join(f"r.{c.strip()} IS NOT DISTINCT FROM s.{c.strip()}" for c in KEY.split(","))
DEDUP = {
    "steps2": f"""
  SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY t) AS rn FROM (
    SELECT {KEY}, epoch_us(seen_at) - epoch_us(seen_at) % 3000000 AS t,
      CAST(sum(greatest(event_count, 1)) AS BIGINT) AS n, max(confidence) AS conf, max(seen_at) AS last,
      arg_min(title, (seen_at, coalesce(log_id, -1), title)) AS title, min((seen_at, coalesce(log_id, -1), title)) AS o,
      arg_min(severity, (seen_at, coalesce(log_id, -1), title, severity)) AS severity
    FROM hits GROUP BY ALL)""",
    "chain": f"""
  SELECT {KEY}, rn, t, t AS anchor FROM steps2 WHERE rn = 1
  UNION ALL
  SELECT s.source, s.rule_id, s.src_ip, s.attack_type, s.http_path, s.rn, s.t,
    CASE WHEN s.t - r.anchor > 172800000000 THEN s.t ELSE r.anchor END
  FROM chain r JOIN steps2 s ON s.rn = r.rn + 1 AND {MATCH}""",
}


@query("alert_dedup", sql(["logs", "mitre"], f"""
SELECT s.source AS detection_source, s.rule_id, s.src_ip, s.attack_type, s.http_path,
  make_timestamp(r.anchor) AS created_at, max(s.last) AS last_seen, CAST(sum(s.n) AS BIGINT) AS event_count,
  max(s.conf) AS confidence, arg_min(s.title, s.o) AS title, arg_min(s.severity, s.o) AS severity
FROM chain r JOIN steps2 s ON s.rn = r.rn AND {MATCH} GROUP BY ALL""",
    extra={**HITS_EXTRA, **DEDUP}, recursive=True))
def alert_dedup(spark, sf):
    return A.alert_dedup(detections(spark, sf), window_seconds=172800).select(
        "detection_source", "rule_id", "src_ip", "attack_type", "http_path", "created_at", "last_seen",
        "event_count", "confidence", "title", "severity")


@query("alert_members", sql(["logs", "mitre"], f"""
SELECT h.source, CAST(sum(c) AS BIGINT) AS members, count(*) AS alerts FROM (
  SELECT s.source, r.anchor, s.rule_id, s.src_ip, s.attack_type, s.http_path, count(DISTINCT h.log_id) AS c
  FROM chain r JOIN steps2 s ON s.rn = r.rn AND {MATCH}
  JOIN (SELECT *, epoch_us(seen_at) - epoch_us(seen_at) % 3000000 AS t FROM hits) h
    ON h.t = s.t AND {MATCH.replace('r.', 'h.')} GROUP BY ALL) h GROUP BY 1""",
    extra={**{k: (v if k != "hits" else v + " WHERE source = 'rule'") for k, v in HITS_EXTRA.items()}, **DEDUP},
    recursive=True))
def alert_members(spark, sf):
    hits = detections(spark, sf).filter("source = 'rule'")
    per_alert = A.alert_members(hits, window_seconds=172800).groupBy("alert_uid").agg(F.count("*").alias("c"))
    return per_alert.agg(F.lit("rule").alias("source"), F.sum("c").alias("members"), F.count("*").alias("alerts"))


ESCALATED = {
    "steps": """
  SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY t) AS rn FROM (
    SELECT src_ip, epoch_us(created_at) AS t, count(*) AS n, min((created_at, alert_uid)) AS o,
      arg_min(title, (created_at, alert_uid)) AS title, arg_min(severity, (created_at, alert_uid)) AS severity,
      arg_min(attack_type, (created_at, alert_uid)) AS attack_type, arg_min(http_path, (created_at, alert_uid)) AS http_path
    FROM alerts WHERE severity IN ('HIGH', 'CRITICAL') AND detection_source = 'rule' GROUP BY 1, 2)""",
    "chain": """
  SELECT src_ip, rn, t, t AS anchor FROM steps WHERE rn = 1
  UNION ALL SELECT s.src_ip, s.rn, s.t, CASE WHEN s.t - r.anchor > 172800000000 THEN s.t ELSE r.anchor END
  FROM chain r JOIN steps s ON s.src_ip = r.src_ip AND s.rn = r.rn + 1"""}


@query("incident_escalation", sql(["alerts"], """
SELECT 'Auto-escalated: ' || arg_min(s.title, s.o) AS title,
  CASE WHEN arg_min(s.severity, s.o) = 'CRITICAL' THEN 'CRITICAL' ELSE 'HIGH' END AS priority,
  make_timestamp(r.anchor) AS created_at, make_timestamp(max(s.t)) AS last_alert_at,
  CAST(sum(n) AS BIGINT) AS alert_count, s.src_ip AS affected_ips,
  arg_min(s.attack_type, s.o) AS attack_types, arg_min(s.http_path, s.o) AS affected_paths
FROM chain r JOIN steps s ON s.src_ip = r.src_ip AND s.rn = r.rn GROUP BY s.src_ip, r.anchor""", extra=ESCALATED, recursive=True))
def incident_escalation(spark, sf):
    return A.incident_escalation(T.alerts(spark, sf), window_seconds=172800).select(
        "title", "priority", "created_at", "last_alert_at", "alert_count", "affected_ips", "attack_types",
        "affected_paths")


@query("incident_members", sql(["alerts"], """
SELECT a.alert_uid, r.src_ip AS src_ip, make_timestamp(r.anchor) AS opened_at
FROM chain r JOIN alerts a ON a.src_ip = r.src_ip AND epoch_us(a.created_at) = r.t
WHERE a.severity IN ('HIGH', 'CRITICAL') AND a.detection_source = 'rule'""", extra=ESCALATED, recursive=True))
def incident_members(spark, sf):
    a = T.alerts(spark, sf)
    members = A.incident_members(a, window_seconds=172800)
    opened = A.incident_escalation(a, window_seconds=172800).select(
        "incident_uid", F.element_at("affected_ips", 1).alias("src_ip"), F.col("created_at").alias("opened_at"))
    return members.join(opened, "incident_uid").select("alert_uid", "src_ip", "opened_at")


HELD = "list_filter(r.held, lambda x: s.t - x.a <= 172800000000)"
FOLLOWED = {
    "steps": ESCALATED["steps"], "chain": ESCALATED["chain"],
    "opened": "SELECT DISTINCT src_ip, anchor, anchor // 3600000000 AS h FROM chain",
    "acts": """
  SELECT src_ip, anchor, anchor + 72000000000 AS t, CASE h % 2 WHEN 0 THEN 'CLOSED' ELSE 'MITIGATED' END AS status FROM opened WHERE h % 3 <> 0
  UNION ALL SELECT src_ip, anchor, anchor + 108000000000, 'INVESTIGATING' FROM opened WHERE h % 4 = 0""",
    "tagged": """
  SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY t, kind, ua, status) AS rn FROM (
    SELECT src_ip, t, 0 AS kind, CAST(NULL AS BIGINT) AS ua, CAST(NULL AS VARCHAR) AS status, n FROM steps
    UNION ALL SELECT src_ip, t, 1, anchor, status, 0 FROM acts)""",
    "folded": f"""
  SELECT src_ip, rn, t, kind, n, t AS anchor, [{{'a': t, 'o': true}}] AS held FROM tagged WHERE rn = 1
  UNION ALL
  SELECT src_ip, rn, t, kind, n, CASE WHEN kind = 0 THEN coalesce(list_filter(kept, lambda x: x.o)[1].a, t) END,
    CASE WHEN kind = 1 THEN list_transform(kept, lambda x: {{'a': x.a, 'o': CASE WHEN x.a = ua THEN status = 'INVESTIGATING' ELSE x.o END}})
      WHEN len(list_filter(kept, lambda x: x.o)) = 0 THEN list_append(kept, {{'a': t, 'o': true}}) ELSE kept END
  FROM (SELECT s.*, {HELD} AS kept FROM folded r JOIN tagged s ON s.src_ip = r.src_ip AND s.rn = r.rn + 1)""",
}


def incident_log(alerts):
    """What analysts did: most incidents end after 20 hours, some are taken up again after 30."""
    ip, hour = F.element_at("affected_ips", 1).alias("src_ip"), F.floor(F.unix_micros(F.col("created_at").cast("timestamp")) / 3600000000)
    opened = A.incident_escalation(alerts, window_seconds=172800).select("incident_uid", ip, "created_at", hour.alias("h"))
    ended = opened.filter("h % 3 <> 0").select(
        "incident_uid", "src_ip", F.expr("created_at + INTERVAL 20 HOUR").alias("changed_at"),
        F.when(F.col("h") % 2 == 0, "CLOSED").otherwise("MITIGATED").alias("status"))
    again = opened.filter("h % 4 = 0").select(
        "incident_uid", "src_ip", F.expr("created_at + INTERVAL 30 HOUR").alias("changed_at"), F.lit("INVESTIGATING").alias("status"))
    return ended.unionByName(again)


@query("incident_followup", sql(["alerts"], """
SELECT 'Auto-escalated: ' || arg_min(s.title, s.o) AS title,
  CASE WHEN arg_min(s.severity, s.o) = 'CRITICAL' THEN 'CRITICAL' ELSE 'HIGH' END AS priority,
  make_timestamp(r.anchor) AS created_at, make_timestamp(max(s.t)) AS last_alert_at,
  CAST(sum(s.n) AS BIGINT) AS alert_count, s.src_ip AS affected_ips
FROM folded r JOIN steps s ON s.src_ip = r.src_ip AND s.t = r.t WHERE r.kind = 0 GROUP BY s.src_ip, r.anchor""", extra=FOLLOWED, recursive=True))
def incident_followup(spark, sf):
    """Incidents when some are closed, mitigated or taken up again meanwhile."""
    a = T.alerts(spark, sf)
    return A.incident_escalation(a, incident_log(a), window_seconds=172800).select(
        "title", "priority", "created_at", "last_alert_at", "alert_count", "affected_ips")


@query("incident_followup_members", sql(["alerts"], """
SELECT a.alert_uid, r.src_ip AS src_ip, make_timestamp(r.anchor) AS opened_at
FROM folded r JOIN alerts a ON a.src_ip = r.src_ip AND epoch_us(a.created_at) = r.t
WHERE r.kind = 0 AND a.severity IN ('HIGH', 'CRITICAL') AND a.detection_source = 'rule'""", extra=FOLLOWED, recursive=True))
def incident_followup_members(spark, sf):
    a = T.alerts(spark, sf)
    log = incident_log(a)
    opened = A.incident_escalation(a, log, window_seconds=172800).select(
        "incident_uid", F.element_at("affected_ips", 1).alias("src_ip"), F.col("created_at").alias("opened_at"))
    return A.incident_members(a, log, window_seconds=172800).join(opened, "incident_uid").select("alert_uid", "src_ip", "opened_at")


@query("alert_groups", sql(["alerts"], f"""
SELECT src_ip, attack_type, http_path, {floor_to('created_at', 7 * 86400)} AS group_window,
  count(*) AS alert_count, CAST(sum(event_count) AS BIGINT) AS total_events,
  {from_rank('max(' + rank('severity') + ')')} AS highest_severity,
  arg_max(id, (last_seen, -id)) AS primary_alert_id, min(first_seen) AS first_seen, max(last_seen) AS last_seen,
  array_to_string(list_sort(list(DISTINCT detection_source)), ',') AS detection_sources,
  array_to_string(list_sort(list(DISTINCT mitre_technique) FILTER (mitre_technique IS NOT NULL)), ',') AS mitre_techniques
FROM alerts GROUP BY 1, 2, 3, 4""".replace("array_to_string(list_sort(list(DISTINCT mitre_technique) FILTER (mitre_technique IS NOT NULL)), ',')",
    "coalesce(array_to_string(list_sort(list(DISTINCT mitre_technique) FILTER (mitre_technique IS NOT NULL)), ','), '')")))
def alert_groups(spark, sf):
    return A.alert_groups(T.alerts(spark, sf), window_minutes=7 * 1440)


@query("alert_stats", sql(["alerts"], """
SELECT 'total' AS kind, CAST(NULL AS VARCHAR) AS value, count(*) AS alerts FROM alerts
UNION ALL SELECT 'severity', severity, count(*) FROM alerts GROUP BY 2
UNION ALL SELECT 'status', status, count(*) FROM alerts GROUP BY 2
UNION ALL SELECT 'attack_type', attack_type, count(*) FROM alerts GROUP BY 2
UNION ALL SELECT * FROM (SELECT 'recent_critical', CAST(id AS VARCHAR), 1::BIGINT FROM alerts
  WHERE severity = 'CRITICAL' ORDER BY created_at DESC, id DESC LIMIT 5)"""))
def alert_stats(spark, sf):
    return A.alert_stats(T.alerts(spark, sf))


@query("incident_rollup", sql(["incidents", "linked_alerts", "notes"], """
SELECT i.id, i.status, i.priority, array_to_string(i.affected_ips, ',') AS affected_ips,
  array_to_string(i.attack_types, ',') AS attack_types, array_to_string(i.mitre_techniques, ',') AS mitre_techniques,
  (SELECT count(*) FROM linked_alerts a WHERE a.incident_id = i.id) AS alert_count,
  (SELECT count(*) FROM notes n WHERE n.incident_id = i.id) AS note_count FROM incidents i"""))
def incident_rollup(spark, sf):
    return A.incident_rollup(T.incidents(spark, sf), T.linked_alerts(spark, sf), T.notes(spark, sf)).select(
        "id", "status", "priority", "affected_ips", "attack_types", "mitre_techniques", "alert_count", "note_count")


@query("incident_timeline", sql(["incidents", "linked_alerts", "notes"], """
SELECT id AS incident_id, created_at AS "timestamp", 'incident_created' AS event_type,
  'Incident created: ' || title AS summary, CAST(NULL AS VARCHAR) AS detail FROM incidents
UNION ALL SELECT incident_id, created_at, 'alert', 'Alert: ' || title,
  'Severity: ' || severity || ', Source: ' || detection_source FROM linked_alerts WHERE incident_id IS NOT NULL
UNION ALL SELECT incident_id, created_at, note_type, substr(content, 1, 128), content FROM notes"""))
def incident_timeline(spark, sf):
    return A.incident_timeline(T.incidents(spark, sf), T.linked_alerts(spark, sf), T.notes(spark, sf))


def _state(changes: str, fields: list[str], stamps: dict[str, str]) -> str:
    f = ", ".join(f"arg_max({c}, (changed_at, seq)) FILTER ({c} IS NOT NULL) AS {c}" for c in fields)
    s = ", ".join(f"max(changed_at) FILTER (status IN ({v})) AS {n}" for n, v in stamps.items())
    return sql([changes], f"""SELECT entity_id, {f}, {s}, max(changed_at) AS updated_at, count(*) AS changes
FROM {changes} GROUP BY entity_id""")


@query("alert_state", _state("alert_changes", ["status", "assigned_to", "incident_id"],
                             {"resolved_at": "'RESOLVED', 'FALSE_POSITIVE'"}))
def alert_state(spark, sf):
    return A.alert_state(T.alert_changes(spark, sf))


@query("incident_state", _state("incident_changes", ["status", "priority", "assigned_to"],
                                {"resolved_at": "'MITIGATED'", "closed_at": "'CLOSED'"}))
def incident_state(spark, sf):
    return A.incident_state(T.incident_changes(spark, sf))


@query("alert_feed", sql(["alerts"], """
SELECT alert_uid, created_at, severity, severity || ': ' || upper(replace(attack_type, '_', ' ')) AS notification_title,
  http_path || ' • ' || src_ip || ' • ' || geo_country AS message
FROM alerts WHERE severity IN ('HIGH', 'CRITICAL')"""))
def alert_feed(spark, sf):
    return A.alert_feed(T.alerts(spark, sf))


TEST_BOOKS = P.PLAYBOOKS + [
    {"id": "pb-volume", "name": "Volume", "cooldown_seconds": 86400,
     "trigger": {"event_count_gte": 2, "detection_source": ["behav", "corr"]},
     "actions": [{"action": "GEO_BLOCK"}, {"action": "notify"}]},
    {"id": "pb-each", "name": "Each", "cooldown_seconds": 0, "trigger": {"attack_type": ["XXE", "CSRF"]},
     "actions": [{"action": "RATE_LIMIT", "duration_seconds": 1}, {"action": "notify"}]},
    {"id": "pb-off", "name": "Off", "active": False, "trigger": {}, "actions": [{"action": "notify"}]},
]


def _where(t: dict) -> str:
    parts = ["true"]
    if "severity" in t:
        parts.append(f"list_contains({lst(t['severity'])}, severity)")
    if "attack_type" in t:
        parts.append(f"list_contains({lst(t['attack_type'])}, attack_type)")
    if "event_count_gte" in t:
        parts.append(f"event_count >= {t['event_count_gte']}")
    if "detection_source" in t:
        parts.append("(" + " OR ".join(f"contains(detection_source, '{s}')" for s in t["detection_source"]) + ")")
    return " AND ".join(parts)


ACTIVE = [b for b in TEST_BOOKS if b.get("active", True)]
MATCHES = " UNION ALL ".join(
    f"SELECT *, {i} AS no, '{b['id']}' AS playbook_id, '{b['name']}' AS playbook FROM alerts WHERE {_where(b['trigger'])}"
    for i, b in enumerate(ACTIVE))


def _q(v) -> str:
    return "NULL" if v is None else (str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'")


ACTIONS = "SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {j}, {b.get('cooldown_seconds', 0)}, {_q(P.ACTION_NAMES.get(a['action'], a['action']))}, "
    f"{_q(a.get('duration_seconds'))}, {_q(a.get('rate_limit_rps'))}, {_q(a.get('channel'))}, {_q(a.get('message'))})"
    for i, b in enumerate(ACTIVE) for j, a in enumerate(b["actions"])) + \
    ") AS t(no, action_no, cooldown, action, duration, rate, channel, message)"


@query("playbook_matches", sql(["alerts"], "SELECT id, no AS playbook_no, playbook_id, playbook FROM m",
                               extra={"m": MATCHES}))
def playbook_matches(spark, sf):
    return P.playbook_matches(T.alerts(spark, sf), TEST_BOOKS).select("id", "playbook_no", "playbook_id", "playbook")


PLAN = {
    "m": MATCHES, "act": ACTIONS,
    "s1": """
  SELECT *, row_number() OVER (PARTITION BY src_ip, no ORDER BY sec, each) AS rn FROM (
    SELECT src_ip, no, playbook_id, epoch_us(created_at) // 1000000 AS sec, min(id) AS alert_id,
      cd, CASE WHEN cd = 0 THEN id END AS each
    FROM m JOIN (SELECT no, max(cooldown) AS cd FROM act GROUP BY 1) USING (no) GROUP BY ALL)""",
    "r1": """
  SELECT src_ip, no, playbook_id, rn, sec, alert_id, sec AS last, true AS fired FROM s1 WHERE rn = 1
  UNION ALL SELECT s.src_ip, s.no, s.playbook_id, s.rn, s.sec, s.alert_id,
    CASE WHEN s.sec - r.last < s.cd THEN r.last ELSE s.sec END, s.sec - r.last >= s.cd
  FROM r1 r JOIN s1 s ON s.src_ip = r.src_ip AND s.no = r.no AND s.rn = r.rn + 1""",
    "s2": """
  SELECT *, row_number() OVER (PARTITION BY src_ip, action ORDER BY sec) AS rn FROM (
    SELECT src_ip, action, sec, playbook_id, alert_id, duration, rate FROM (
      SELECT r1.*, act.action, act.duration, act.rate, row_number() OVER (
        PARTITION BY src_ip, action, sec ORDER BY r1.no, action_no, alert_id) AS k
      FROM r1 JOIN act ON act.no = r1.no
      WHERE fired AND action IN ('IP_BLOCK', 'RATE_LIMIT', 'TEMP_BAN', 'GEO_BLOCK')) WHERE k = 1)""",
    "r2": """
  SELECT *, coalesce(sec + duration, 9000000000000)::BIGINT AS til, true AS started FROM s2 WHERE rn = 1
  UNION ALL SELECT s.*, CASE WHEN s.sec < r.til THEN r.til ELSE coalesce(s.sec + s.duration, 9000000000000)::BIGINT END,
    s.sec >= r.til
  FROM r2 r JOIN s2 s ON s.src_ip = r.src_ip AND s.action = r.action AND s.rn = r.rn + 1""",
}


@query("response_plan", sql(["alerts"], """
SELECT action, src_ip AS target_ip, playbook_id, alert_id, CAST(duration AS BIGINT) AS duration_seconds,
  CAST(rate AS INTEGER) AS rate_limit_rps, make_timestamp(sec * 1000000) AS created_at,
  make_timestamp((sec + duration) * 1000000) AS expires_at FROM r2 WHERE started""", extra=PLAN, recursive=True))
def response_plan(spark, sf):
    return P.response_plan(T.alerts(spark, sf), TEST_BOOKS)


@query("playbook_notices", sql(["alerts"], """
SELECT id AS alert_id, playbook, action,
  CASE action WHEN 'notify' THEN 'sent' WHEN 'escalate' THEN 'done' ELSE 'unknown_action' END AS status,
  CASE WHEN action = 'notify' THEN upper(coalesce(channel, 'soc')) || ' notification: ' || playbook END AS notification_title,
  CASE WHEN action = 'notify' THEN replace(replace(replace(replace(replace(
    coalesce(message, '{severity} alert from {src_ip}: {title}'), '{severity}', severity), '{src_ip}', src_ip),
    '{attack_type}', attack_type), '{event_count}', CAST(event_count AS VARCHAR)), '{title}', title) END AS message
FROM m JOIN act USING (no) WHERE action NOT IN ('IP_BLOCK', 'RATE_LIMIT', 'TEMP_BAN', 'GEO_BLOCK')""",
    extra={"m": MATCHES, "act": ACTIONS}))
def playbook_notices(spark, sf):
    return P.playbook_notices(T.alerts(spark, sf), TEST_BOOKS)


RESPONSES = f"""CASE WHEN revoked_at <= TIMESTAMP '{NOW}' THEN 'REVOKED'
  WHEN expires_at <= TIMESTAMP '{NOW}' THEN 'EXPIRED' ELSE 'ACTIVE' END"""


@query("response_status", sql(["blocks"], f"""
SELECT *, {RESPONSES} AS status FROM blocks WHERE created_at <= TIMESTAMP '{NOW}'"""))
def response_status(spark, sf):
    return P.response_status(T.blocks(spark, sf), now=NOW)


@query("active_responses", sql(["blocks"], f"""
SELECT *, 'ACTIVE' AS status FROM blocks WHERE created_at <= TIMESTAMP '{END}'
AND (expires_at IS NULL OR expires_at > TIMESTAMP '{END}') AND (revoked_at IS NULL OR revoked_at > TIMESTAMP '{END}')"""))
def active_responses(spark, sf):
    return P.active_responses(T.blocks(spark, sf), now=END)


@query("pending_blocks", sql(["blocks"], f"""
SELECT ip, arg_max(reason, (created_at, block_id)) AS reason, arg_max(reason_type, (created_at, block_id)) AS reason_type,
  max(created_at) AS blocked_at, max(created_at) + INTERVAL 24 HOUR AS expires_at, count(*) AS attempts,
  CAST(max(created_at) AS DATE) = DATE '{NOW[:10]}' AS is_today
FROM blocks WHERE created_at <= TIMESTAMP '{NOW}' GROUP BY ip"""))
def pending_blocks(spark, sf):
    return P.pending_blocks(T.blocks(spark, sf), now=NOW)
