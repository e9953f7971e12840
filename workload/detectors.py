"""Behavioural and correlation detectors."""

from __future__ import annotations

from duskwatch.functions.text import any_rlike
from duskwatch.operators import behavior as B
from duskwatch.operators import correlate as C
from workload import tables as T
from workload.common import query
from workload.tables_sql import floor_to, sql

DAY = 86400
ALL = "TIMESTAMP '1970-01-01 00:00:00'"
DAYC = floor_to('"timestamp"', DAY)
HITS = ["cycle_start", "src_ip", "title", "severity", "seen_at", "attack_type", "event_count", "log_ids",
        "confidence"]


def ids(n: int) -> str:
    return f"array_to_string(list(id ORDER BY \"timestamp\", id)[1:{n}], ',')"


def hits(title: str, severity: str, attack: str, conf: str, *, n: int, cycle: str = ALL,
         where: str = "true", having: str, count: str = "count(*)", key: str = "src_ip") -> str:
    return f"""
SELECT {cycle} AS cycle_start, {key}, {title} AS title, {severity} AS severity,
  max("timestamp") AS seen_at, {attack} AS attack_type, {count} AS event_count, {ids(n)} AS log_ids,
  CAST({conf} AS DOUBLE) AS confidence
FROM logs WHERE {where} GROUP BY 1, {key} HAVING {having}"""


@query("high_request_rate", sql(["logs"], hits(
    "'High request rate from ' || src_ip", "CASE WHEN count(*) > 140 THEN 'HIGH' ELSE 'MEDIUM' END", "'DDOS'",
    "round(least(0.95, 0.5 + (count(*)::DOUBLE / 70) * 0.3), 6)", n=50, having="count(*) >= 70")))
def high_request_rate(spark, sf):
    return B.high_request_rate(T.logs(spark, sf), threshold=70, cycle=None).select(*HITS)


@query("high_block_rate", sql(["logs"], hits(
    "'High block rate for ' || src_ip", "'HIGH'", "'BRUTE_FORCE'", "0.8", n=50,
    where="action = 'BLOCKED'", having="count(*) >= 18")))
def high_block_rate(spark, sf):
    return B.high_block_rate(T.logs(spark, sf), threshold=18, cycle=None).select(*HITS)


@query("ip_burst", sql(["logs"], f"""
SELECT {ALL} AS cycle_start, src_ip, 'Burst traffic from ' || src_ip AS title, 'HIGH' AS severity,
  arg_min(e, ("timestamp", id)) AS seen_at, 'DDOS' AS attack_type, 3::BIGINT AS event_count,
  0.9::DOUBLE AS confidence
FROM (SELECT *, lead("timestamp", 2) OVER (PARTITION BY src_ip ORDER BY "timestamp", id) AS e FROM logs)
WHERE e <= "timestamp" + INTERVAL 1 HOUR GROUP BY src_ip"""))
def ip_burst(spark, sf):
    cols = [c for c in HITS if c != "log_ids"]
    return B.ip_burst(T.logs(spark, sf), count=3, seconds=3600, cycle=None).select(*cols)


@query("rate_baseline", sql(["logs"], f"""
SELECT src_ip, count(*) AS cycles,
  round(pow(0.9::DOUBLE, count(*)) * 10.0 + (1 - 0.9::DOUBLE) * sum(n * pow(0.9::DOUBLE, age)), 6) AS baseline
FROM (SELECT *, row_number() OVER (PARTITION BY src_ip ORDER BY d DESC) - 1 AS age
      FROM (SELECT src_ip, {DAYC} AS d, count(*) AS n FROM logs GROUP BY 1, 2)) GROUP BY 1"""))
def rate_baseline(spark, sf):
    return B.rate_baseline(T.logs(spark, sf))


@query("high_risk_country_attacks", sql(["logs"], """
SELECT 'Attack from high-risk country (' || geo_country || ')' AS title, 'HIGH' AS severity,
  "timestamp" AS seen_at, src_ip, attack_type, geo_country, CAST(id AS VARCHAR) AS log_ids,
  0.75::DOUBLE AS confidence FROM logs
WHERE geo_country IN ('KP', 'IR', 'SY', 'CU', 'VE') AND attack_type <> 'NONE'"""))
def high_risk_country_attacks(spark, sf):
    return B.high_risk_country_attacks(T.logs(spark, sf)).select(
        "title", "severity", "seen_at", "src_ip", "attack_type", "geo_country", "log_ids", "confidence")


@query("multi_country_session", sql(["logs"], f"""
SELECT {ALL} AS cycle_start, session_id, arg_min(src_ip, ("timestamp", id)) AS src_ip,
  max("timestamp") AS seen_at, count(*) AS event_count, {ids(20)} AS log_ids
FROM logs GROUP BY session_id HAVING count(DISTINCT geo_country) >= 3"""))
def multi_country_session(spark, sf):
    return B.multi_country_session(T.logs(spark, sf), cycle=None).select(
        "cycle_start", "session_id", "src_ip", "seen_at", "event_count", "log_ids")


@query("new_watch_country", sql(["logs"], f"""
SELECT d AS cycle_start, geo_country, n AS event_count, seen_at FROM (
  SELECT *, row_number() OVER (PARTITION BY geo_country ORDER BY d) AS rn FROM (
    SELECT geo_country, {DAYC} AS d, count(*) AS n, max("timestamp") AS seen_at FROM logs
    WHERE geo_country IN ('RU', 'CN', 'BY', 'UA') GROUP BY 1, 2)) WHERE rn = 1"""))
def new_watch_country(spark, sf):
    return B.new_watch_country(T.logs(spark, sf)).select("cycle_start", "geo_country", "event_count", "seen_at")


SCAN = "regexp_matches(http_path, '" + any_rlike(B.SCAN_PATHS) + "')"


@query("scan_path_hits", sql(["logs"], hits(
    "'Directory enumeration from ' || src_ip", "'HIGH'", "'PORT_SCAN'", "0.85", n=30, where=SCAN,
    having="count(*) >= 5")))
def scan_path_hits(spark, sf):
    return B.scan_path_hits(T.logs(spark, sf), cycle=None).select(*HITS)


@query("scanned_paths", sql(["logs"], f"""
SELECT {ALL} AS cycle_start, src_ip, count(*) AS event_count,
  array_to_string(list_sort(list(DISTINCT http_path))[1:2], ',') AS paths
FROM logs WHERE {SCAN} GROUP BY src_ip HAVING count(*) >= 5"""))
def scanned_paths(spark, sf):
    return B.scanned_paths(T.logs(spark, sf), cycle=None, max_paths=2)


@query("path_diversity", sql(["logs"], hits(
    "'High path diversity from ' || src_ip", "'MEDIUM'", "'PORT_SCAN'", "0.7", n=30,
    count="count(DISTINCT http_path)", having="count(DISTINCT http_path) >= 40")))
def path_diversity(spark, sf):
    return B.path_diversity(T.logs(spark, sf), threshold=40, cycle=None).select(*HITS)


@query("suspicious_agents", sql(["logs"], f"""
SELECT {DAYC} AS cycle_start, src_ip, min("timestamp") AS seen_at,
  CAST(arg_min(id, ("timestamp", id)) AS VARCHAR) AS log_ids FROM logs
WHERE regexp_matches(http_user_agent, '{any_rlike(B.SUSPICIOUS_AGENTS)}') GROUP BY 1, 2"""))
def suspicious_agents(spark, sf):
    return B.suspicious_agents(T.logs(spark, sf), cycle=DAY).select("cycle_start", "src_ip", "seen_at", "log_ids")


ATT = "attack_type <> 'NONE'"
KINDS = "array_to_string(list_sort(list(DISTINCT attack_type) FILTER (attack_type <> 'NONE')), ', ')"


@query("multi_vector_ip", sql(["logs"], hits(
    f"'Multi-vector attack from ' || src_ip || ': ' || {KINDS}", "'CRITICAL'", "'OTHER'", "0.9", n=50,
    cycle=DAYC, where=ATT, having="count(DISTINCT attack_type) >= 3")))
def multi_vector_ip(spark, sf):
    return C.multi_vector_ip(T.logs(spark, sf), cycle=DAY).select(*HITS)


@query("coordinated_path", sql(["logs"], f"""
SELECT {DAYC} AS cycle_start, http_path, min(src_ip) AS src_ip, max("timestamp") AS seen_at,
  'Coordinated attack on ' || http_path || ' from ' || CAST(count(DISTINCT src_ip) AS VARCHAR) || ' addresses' AS title,
  count(*) AS event_count, {ids(50)} AS log_ids
FROM logs WHERE {ATT} GROUP BY 1, 2 HAVING count(DISTINCT src_ip) >= 5"""))
def coordinated_path(spark, sf):
    return C.coordinated_path(T.logs(spark, sf), cycle=DAY).select(
        "cycle_start", "http_path", "src_ip", "seen_at", "title", "event_count", "log_ids")


@query("session_multi_attack", sql(["logs"], f"""
SELECT {ALL} AS cycle_start, session_id, arg_min(src_ip, ("timestamp", id)) AS src_ip,
  max("timestamp") AS seen_at, 'Session multi-attack: ' || {KINDS} AS title,
  count(*) AS event_count, {ids(30)} AS log_ids
FROM logs GROUP BY session_id
HAVING count(*) >= 2 AND count(DISTINCT attack_type) FILTER (attack_type <> 'NONE') >= 2"""))
def session_multi_attack(spark, sf):
    return C.session_multi_attack(T.logs(spark, sf), cycle=None).select(
        "cycle_start", "session_id", "src_ip", "seen_at", "title", "event_count", "log_ids")


@query("session_escalation", sql(["logs"], f"""
SELECT {ALL} AS cycle_start, session_id, arg_min(src_ip, ("timestamp", id)) AS src_ip,
  max("timestamp") AS seen_at, count(*) AS event_count, array_to_string(list(id ORDER BY "timestamp", id), ',') AS log_ids
FROM (SELECT *, lag(r) OVER (PARTITION BY session_id ORDER BY "timestamp", id) AS p FROM (
  SELECT *, CASE severity WHEN 'INFO' THEN 0 WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END AS r
  FROM logs)) GROUP BY session_id
HAVING count(*) >= 3 AND bool_and(p IS NULL OR p <= r) AND arg_max(r, ("timestamp", id)) >= 3"""))
def session_escalation(spark, sf):
    return C.session_escalation(T.logs(spark, sf), cycle=None).select(
        "cycle_start", "session_id", "src_ip", "seen_at", "event_count", "log_ids")


@query("attack_burst", sql(["logs"], f"""
SELECT s.cycle_start, count(*) AS event_count, max("timestamp") AS seen_at, min(src_ip) AS src_ip,
  CASE WHEN count(DISTINCT src_ip) > 3 THEN 'CRITICAL' ELSE 'HIGH' END AS severity,
  CASE WHEN count(DISTINCT src_ip) > 3 THEN 'DDOS' ELSE 'OTHER' END AS attack_type,
  'Attack burst from ' || CAST(count(DISTINCT src_ip) AS VARCHAR) || ' addresses' AS title,
  {ids(50)} AS log_ids
FROM (SELECT cycle_start, min("timestamp") AS s FROM (
        SELECT *, lead("timestamp", 9) OVER (PARTITION BY cycle_start ORDER BY "timestamp", id) AS e FROM att)
      WHERE e <= "timestamp" + INTERVAL 2 HOUR GROUP BY 1) s
JOIN att l ON l.cycle_start = s.cycle_start AND l."timestamp" BETWEEN s.s AND s.s + INTERVAL 2 HOUR
GROUP BY 1""", extra={"att": f"SELECT *, {DAYC} AS cycle_start FROM logs WHERE {ATT}"}))
def attack_burst(spark, sf):
    return C.attack_burst(T.logs(spark, sf), count=10, seconds=7200, cycle=DAY).select(
        "cycle_start", "event_count", "seen_at", "src_ip", "severity", "attack_type", "title", "log_ids")


def _recon(extra: str) -> str:
    recon = "'" + "', '".join(C.RECON) + "'"
    exploit = "'" + "', '".join(C.EXPLOIT) + "'"
    return sql(["logs"], f"""
SELECT d AS cycle_start, src_ip, max("timestamp") AS seen_at, count(*) AS event_count, {ids(50)} AS log_ids
FROM (SELECT *, count(*) OVER (PARTITION BY d) AS n FROM (SELECT *, {DAYC} AS d FROM logs WHERE {ATT}))
WHERE n >= 10 GROUP BY 1, 2
HAVING bool_or(attack_type IN ({recon})) AND bool_or(attack_type IN ({exploit}))""" + extra.format(
        recon=recon, exploit=exploit))


@query("recon_exploit", _recon(""))
def recon_exploit(spark, sf):
    return C.recon_exploit(T.logs(spark, sf), cycle=DAY).select(
        "cycle_start", "src_ip", "seen_at", "event_count", "log_ids")


@query("recon_exploit_ordered", _recon("""
AND min(CASE WHEN attack_type IN ({recon}) THEN ("timestamp", id) END)
  < max(CASE WHEN attack_type IN ({exploit}) THEN ("timestamp", id) END)"""))
def recon_exploit_ordered(spark, sf):
    return C.recon_exploit(T.logs(spark, sf), cycle=DAY, ordered=True).select(
        "cycle_start", "src_ip", "seen_at", "event_count", "log_ids")
