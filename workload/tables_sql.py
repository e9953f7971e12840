"""The same derived tables, written a second time as DuckDB CTEs for the oracles."""

from __future__ import annotations

from duskwatch.operators.enrich import MITRE
from workload import tables as T


def lst(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def pick(values, index: str) -> str:
    return f"list_extract({lst(values)}, CAST({index} AS INTEGER) + 1)"


def rank(col: str) -> str:
    return (f"CASE upper({col}) WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 "
            f"WHEN 'CRITICAL' THEN 4 ELSE 0 END")


def from_rank(col: str) -> str:
    return pick(["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"], col)


def floor_to(col: str, seconds: int) -> str:
    n = seconds * 1_000_000
    return f"make_timestamp(epoch_us({col}) - epoch_us({col}) % {n})"


def plus(col: str, seconds) -> str:
    return f"({col} + to_microseconds(CAST({seconds} AS BIGINT) * 1000000))"


def user_ip(col: str) -> str:
    return f"('203.0.' || CAST({col} // 256 AS VARCHAR) || '.' || CAST({col} % 256 AS VARCHAR))"


MITRE_VALUES = ", ".join(
    "('" + "', '".join((a, *MITRE[a])) + "')" for a in MITRE)

CTES: dict[str, tuple[list[str], str]] = {
    "ev": ([], """
        SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events"""),
    "logs": (["ev"], f"""
        SELECT event_id AS id, ts AS "timestamp", {plus('ts', 'k % 5')} AS received_at,
          {user_ip('user_id')} AS src_ip, '10.0.0.' || CAST(event_id % 20 AS VARCHAR) AS dst_ip,
          CASE WHEN k % 4 = 0 THEN 'HTTPS' ELSE 'HTTP' END AS protocol,
          CASE event_type WHEN 'error' THEN 'BLOCKED' WHEN 'signup' THEN 'RATE_LIMITED'
            WHEN 'purchase' THEN 'FLAGGED' ELSE 'ALLOWED' END AS action,
          CASE event_type WHEN 'error' THEN 'PUT' WHEN 'signup' THEN 'POST'
            WHEN 'purchase' THEN 'POST' ELSE 'GET' END AS http_method,
          CASE event_type WHEN 'error' THEN 403 WHEN 'signup' THEN 429 ELSE 200 END AS http_status,
          CASE WHEN k < 55 THEN 'NONE' ELSE {pick(T.ATTACKS, 'k % 15')} END AS attack_type,
          CASE WHEN value < 10 THEN 'INFO' WHEN value < 30 THEN 'LOW' WHEN value < 80 THEN 'MEDIUM'
            WHEN value < 150 THEN 'HIGH' ELSE 'CRITICAL' END AS severity,
          CASE WHEN k % 10 = 0 THEN {pick(T.PROBE_PATHS, '(k // 10) % 5')}
            ELSE '/item/' || CAST(k AS VARCHAR) END AS http_path,
          {pick(T.AGENTS, 'k % 7')} AS http_user_agent,
          {pick(T.COUNTRIES, '(user_id + k) % 12')} AS geo_country,
          CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS session_id,
          value / 500 AS confidence, props AS raw_log,
          CAST(k AS DOUBLE) AS sys_cpu, CAST((k * 7) % 100 AS DOUBLE) AS sys_memory, k
        FROM ev"""),
    "mitre": ([], f"""
        SELECT * FROM (VALUES {MITRE_VALUES})
          AS m(attack_type, mitre_tactic, mitre_technique, technique_name)"""),
    "alerts0": (["logs"], f"""
        SELECT src_ip, attack_type, {floor_to('"timestamp"', 86400)} AS day, min(id) AS id,
          min(http_path) AS http_path, min(geo_country) AS geo_country,
          min(session_id) AS session_id, min("timestamp") AS first_seen,
          max("timestamp") AS last_seen, min(received_at) AS recv, count(*) AS event_count,
          max({rank('severity')}) AS rnk, max(confidence) AS confidence
        FROM logs WHERE attack_type <> 'NONE' GROUP BY 1, 2, 3"""),
    "alerts": (["alerts0", "mitre"], f"""
        SELECT id, 'al-' || CAST(id AS VARCHAR) AS alert_uid,
          a.attack_type || ' from ' || src_ip AS title, 'seen at ' || http_path AS description,
          src_ip, a.attack_type, http_path, geo_country, session_id, first_seen, last_seen,
          {plus('recv', 3)} AS created_at, event_count, {from_rank('rnk')} AS severity, confidence,
          {pick(['NEW', 'ACKNOWLEDGED', 'RESOLVED', 'IN_PROGRESS'], 'id % 4')} AS status,
          {pick(['rule', 'behavioral.rate', 'correlation.ip'], 'id % 3')} AS detection_source,
          mitre_tactic, mitre_technique
        FROM alerts0 a LEFT JOIN mitre m ON a.attack_type = m.attack_type"""),
    "alert_log_ids": (["logs"], f"""
        SELECT min(id) OVER (PARTITION BY src_ip, attack_type, {floor_to('"timestamp"', 86400)}) AS alert_id, id AS log_id
        FROM logs WHERE attack_type <> 'NONE'"""),
    "incidents": (["alerts"], f"""
        SELECT id, 'in-' || CAST(id AS VARCHAR) AS incident_uid,
          'Auto-escalated: ' || src_ip AS title, 'Source IP: ' || src_ip AS description,
          CAST(NULL AS VARCHAR) AS response_summary,
          {plus('c', '(id % 7) * 600 - 600')} AS created_at,
          {pick(['NEW', 'INVESTIGATING', 'MITIGATED', 'CLOSED'], 'id % 4')} AS status,
          CASE WHEN crit = 1 THEN 'CRITICAL' ELSE 'HIGH' END AS priority,
          [src_ip] AS affected_ips, affected_paths, attack_types, mitre_tactics, mitre_techniques
        FROM (SELECT src_ip, min(id) AS id, min(created_at) AS c,
                max(CASE WHEN severity = 'CRITICAL' THEN 1 ELSE 0 END) AS crit,
                list_sort(list(DISTINCT http_path)) AS affected_paths,
                list_sort(list(DISTINCT attack_type)) AS attack_types,
                list_sort(list(DISTINCT mitre_tactic) FILTER (mitre_tactic IS NOT NULL)) AS mitre_tactics,
                list_sort(list(DISTINCT mitre_technique) FILTER (mitre_technique IS NOT NULL)) AS mitre_techniques
              FROM alerts WHERE severity IN ('HIGH', 'CRITICAL') GROUP BY src_ip)"""),
    "linked_alerts": (["alerts", "incidents"], """
        SELECT a.*, CASE WHEN a.severity IN ('HIGH', 'CRITICAL') THEN i.id END AS incident_id
        FROM alerts a LEFT JOIN incidents i ON a.src_ip = i.affected_ips[1]"""),
    "notes": (["incidents"], f"""
        SELECT i.id AS incident_id, {plus('i.created_at', 'turn * 60')} AS created_at,
          role AS note_type, text AS content
        FROM conversations c JOIN incidents i ON {user_ip('c.conv_id')} = i.affected_ips[1]"""),
    "security_events": (["logs"], f"""
        SELECT 'EV' || CAST(id AS VARCHAR) AS event_id, "timestamp",
          CASE WHEN attack_type = 'NONE' THEN 'none' ELSE {pick(T.THREATS, 'k % 15')} END AS threat_type,
          lower(severity) AS threat_level, src_ip AS ip, http_path AS url,
          http_user_agent AS user_agent,
          CASE WHEN action IN ('BLOCKED', 'RATE_LIMITED') THEN 'block' ELSE 'allow' END AS action,
          CASE WHEN action IN ('BLOCKED', 'RATE_LIMITED') THEN 1 ELSE 0 END AS blocked,
          http_method AS d_method, k % 10 AS d_ddos, 'p' || CAST(k % 4 AS VARCHAR) AS d_pattern,
          CASE WHEN k % 10 <> 9 THEN k / 100.0::DOUBLE END AS ai_score,
          CASE WHEN k % 10 <> 9 THEN ((k * 3) % 100) / 100.0::DOUBLE END AS ai_confidence,
          k % 10 <> 9 AND k >= 85 AS flagged,
          CASE WHEN k % 10 <> 9 AND k % 3 <> 0 THEN ((k * 3) % 100) / 100.0::DOUBLE END AS model_confidence,
          CASE WHEN k % 10 <> 9 AND k % 3 <> 0 THEN CASE WHEN k % 2 = 0 THEN 'high' ELSE 'MEDIUM' END END AS suggestion,
          k
        FROM logs"""),
    "requests": (["logs"], f"""
        SELECT id, "timestamp", src_ip AS client_ip, http_method AS method,
          http_path || '?q=' || CASE WHEN k % 2 = 0 THEN {pick(T.ENCODED, 'id % 16')}
            ELSE {pick(T.ENCODED_TWICE, 'id % 16')} END AS url,
          {pick(T.PAYLOADS, 'id % 16')} AS payload,
          CASE WHEN id % 5 = 0 THEN 'user=a&pw=b' END AS body,
          http_user_agent AS user_agent, http_status, severity, k,
          CASE WHEN k % 4 = 1 THEN 'unknown, 198.51.100.' || CAST(k AS VARCHAR)
            WHEN k % 4 = 2 THEN 'bad, 10.1.2.3 , 1.1.1.1' WHEN k % 4 = 3 THEN '' END AS x_forwarded_for,
          CASE WHEN k % 3 = 0 THEN '192.0.2.' || CAST(k AS VARCHAR) END AS x_real_ip,
          confidence * 100 AS response_ms
        FROM logs"""),
    "blocks": (["logs"], f"""
        SELECT id AS block_id, src_ip AS ip, "timestamp" AS created_at,
          CASE WHEN k % 6 = 1 THEN "timestamp" + INTERVAL 72 HOUR WHEN k % 6 <> 0 THEN "timestamp" + INTERVAL 24 HOUR END AS expires_at,
          CASE WHEN k % 5 = 0 THEN "timestamp" + INTERVAL 6 HOUR WHEN k % 5 = 1 THEN "timestamp" + INTERVAL 80 HOUR END AS revoked_at,
          'Auto: ' || attack_type AS reason,
          CASE WHEN k % 2 = 0 THEN 'auto' ELSE 'manual' END AS reason_type,
          {pick(['IP_BLOCK', 'TEMP_BAN', 'RATE_LIMIT'], 'k % 3')} AS action
        FROM logs WHERE action = 'BLOCKED' AND severity = 'CRITICAL'"""),
    "geo_ranges": ([], """
        SELECT 3405774848::BIGINT + n_nationkey::BIGINT * 64 AS "start",
          3405774848::BIGINT + n_nationkey::BIGINT * 64 + 63 AS "end", n_name AS country,
          r_name AS city, CAST(n_nationkey AS DOUBLE) AS latitude,
          0.0::DOUBLE - CAST(n_nationkey AS DOUBLE) AS longitude, 'AS' || CAST(n_nationkey AS VARCHAR) AS asn
        FROM nation JOIN region ON n_regionkey = r_regionkey"""),
    "bench_requests": ([], """
        SELECT l_returnflag AS profile, l_linenumber AS trial,
          CASE WHEN l_linestatus = 'O' THEN 'benign' ELSE 'sqli' END AS label,
          CASE WHEN l_quantity = 1 THEN 0 WHEN l_quantity > 25 THEN 403 ELSE 200 END AS status,
          1000.0::DOUBLE * l_tax + l_quantity AS latency_ms,
          CASE WHEN l_quantity % 2 = 0 THEN l_quantity / 10 END AS server_processing_ms
        FROM lineitem"""),
    "alert_changes": ([], """
        SELECT o_custkey AS entity_id, o_orderdate AS changed_at, o_orderkey AS seq,
          CASE o_orderstatus WHEN 'O' THEN 'NEW' WHEN 'P' THEN 'IN_PROGRESS' ELSE 'RESOLVED' END AS status,
          CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 11 END AS assigned_to,
          CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 50 END AS incident_id
        FROM orders"""),
    "incident_changes": ([], """
        SELECT o_custkey AS entity_id, o_orderdate AS changed_at, o_orderkey AS seq,
          CASE o_orderstatus WHEN 'O' THEN 'INVESTIGATING' WHEN 'P' THEN 'MITIGATED' ELSE 'CLOSED' END AS status,
          CASE WHEN o_orderkey % 3 = 0 THEN substr(o_orderpriority, 3, 20) END AS priority,
          CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 11 END AS assigned_to
        FROM orders"""),
}


def sql(uses: list[str], body: str, *, extra: dict[str, str] | None = None, recursive: bool = False,
        materialize: tuple[str, ...] = ()) -> str:
    """``WITH`` the named tables, their dependencies and ``extra`` CTEs, then ``body``."""
    seen: dict[str, str] = {}

    def add(name: str) -> None:
        if name in seen:
            return
        deps, text = CTES[name]
        for d in deps:
            add(d)
        seen[name] = text

    for u in uses:
        add(u)
    seen.update(extra or {})
    if not seen:
        return body
    head = "WITH RECURSIVE " if recursive else "WITH "
    keep = {n: "MATERIALIZED " for n in materialize}
    return head + ",\n".join(f"{n} AS {keep.get(n, '')}({t})" for n, t in seen.items()) + "\n" + body
