"""Dashboard queries and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskwatch.operators import dashboards as D
from duskwatch.operators import enrich
from workload import tables as T
from workload.common import query
from workload.tables_sql import lst, sql

START, END, NOW = "2024-01-10 00:00:00", "2024-01-25 12:00:00", "2024-01-30 12:00:00"
TYPES = sorted(set(T.THREATS))
LAST24 = f"\"timestamp\" BETWEEN TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND TIMESTAMP '{NOW}'"


def located_logs(spark, sf):
    return enrich.geo_enrich(T.logs(spark, sf), T.geo_ranges(spark, sf))


GEO_CTE = {"geo_logs": """
    SELECT l.* EXCLUDE (geo_country), g.country AS geo_country, g.city AS geo_city,
      g.latitude AS geo_lat, g.longitude AS geo_lon, g.asn AS geo_asn
    FROM (SELECT *, CAST(split_part(src_ip, '.', 1) AS BIGINT) * 16777216
            + CAST(split_part(src_ip, '.', 2) AS BIGINT) * 65536
            + CAST(split_part(src_ip, '.', 3) AS BIGINT) * 256
            + CAST(split_part(src_ip, '.', 4) AS BIGINT) AS ipn FROM logs) l
    LEFT JOIN geo_ranges g ON l.ipn BETWEEN g."start" AND g."end" """}


@query("soc_kpis", sql(["logs", "alerts", "incidents", "blocks"], f"""
SELECT * FROM
 (SELECT count(*) AS total_logs, count(*) FILTER (action = 'BLOCKED') AS total_blocked,
    count(*) FILTER (attack_type <> 'NONE') AS total_attacks
  FROM logs WHERE "timestamp" BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}') a,
 (SELECT count(*) FILTER (created_at BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}') AS total_alerts,
    count(*) FILTER (status IN ('NEW', 'ACKNOWLEDGED')) AS active_alerts FROM alerts) b,
 (SELECT count(*) FILTER (status IN ('NEW', 'INVESTIGATING')) AS open_incidents FROM incidents) c,
 (SELECT count(*) FILTER (created_at <= TIMESTAMP '{END}'
    AND (expires_at IS NULL OR expires_at > TIMESTAMP '{END}') AND (revoked_at IS NULL OR revoked_at > TIMESTAMP '{END}'))
    AS active_blocks FROM blocks) d"""))
def soc_kpis(spark, sf):
    return D.soc_kpis(T.logs(spark, sf), T.alerts(spark, sf), T.incidents(spark, sf),
                      T.blocks(spark, sf), start=START, end=END, now=END)


@query("top_attackers", sql(["logs"], """
SELECT src_ip, geo_country, count(*) AS attacks FROM logs WHERE attack_type <> 'NONE'
GROUP BY 1, 2 ORDER BY attacks DESC, src_ip, geo_country LIMIT 10"""))
def top_attackers(spark, sf):
    return D.top_attackers(T.logs(spark, sf))


@query("attack_distribution", sql(["logs"], f"""
SELECT attack_type, count(*) AS events FROM logs
WHERE attack_type <> 'NONE' AND "timestamp" BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' GROUP BY 1"""))
def attack_distribution(spark, sf):
    return D.attack_distribution(D.time_window_filter(T.logs(spark, sf), "timestamp", start=END, end=START))


@query("severity_distribution", sql(["alerts"], """
SELECT severity, count(*) AS alerts FROM alerts GROUP BY 1"""))
def severity_distribution(spark, sf):
    return D.severity_distribution(T.alerts(spark, sf))


@query("geo_distribution", sql(["logs", "geo_ranges"], """
SELECT geo_country, geo_lat, geo_lon, count(*) AS attacks FROM geo_logs
WHERE attack_type <> 'NONE' AND geo_country IS NOT NULL GROUP BY 1, 2, 3
ORDER BY attacks DESC, geo_country, geo_lat, geo_lon LIMIT 20""", extra=GEO_CTE))
def geo_distribution(spark, sf):
    return D.geo_distribution(located_logs(spark, sf))


@query("recent_alerts", sql(["alerts"], f"""
SELECT id, created_at, severity, status, src_ip, attack_type, title FROM alerts
WHERE created_at BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'
ORDER BY created_at DESC, id DESC LIMIT 20"""))
def recent_alerts(spark, sf):
    return D.recent_alerts(D.time_window_filter(T.alerts(spark, sf), "created_at", start=START, end=END))


@query("recent_threats", sql(["security_events"], """
SELECT event_id, "timestamp", threat_type, threat_level, ip, url, user_agent, action
FROM security_events WHERE blocked = 1 ORDER BY "timestamp" DESC, event_id DESC LIMIT 30"""))
def recent_threats(spark, sf):
    return D.recent_threats(T.security_events(spark, sf))


@query("threat_counts", sql(["security_events"], """
SELECT threat_type, threat_level, count(*) AS events FROM security_events WHERE blocked = 1 GROUP BY 1, 2"""))
def threat_counts(spark, sf):
    return D.threat_counts(T.security_events(spark, sf))


@query("threat_timeline", sql(["security_events"], f"""
SELECT CAST(h.hour AS INTEGER) AS hour, {", ".join(f"count(*) FILTER (e.threat_type = '{t}') AS {t}" for t in TYPES)}
FROM range(24) h(hour) LEFT JOIN (SELECT * FROM security_events WHERE blocked = 1
  AND "timestamp" BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}') e ON hour(e."timestamp") = h.hour
GROUP BY 1"""))
def threat_timeline(spark, sf):
    return D.threat_timeline(T.security_events(spark, sf), threat_types=TYPES, start=START, end=END)


@query("traffic_by_hour", sql(["security_events"], f"""
SELECT CAST(hour("timestamp") AS INTEGER) AS hour, count(*) AS total_requests,
  count(*) FILTER (blocked = 1) AS blocked_requests
FROM security_events WHERE {LAST24} GROUP BY 1"""))
def traffic_by_hour(spark, sf):
    return D.traffic_by_hour(T.security_events(spark, sf), now=NOW)


@query("attack_heatmap", sql(["security_events"], """
SELECT CAST(d.d AS INTEGER) AS weekday, CAST(h.h AS INTEGER) AS hour, count(e.event_id) AS events
FROM range(7) d(d) CROSS JOIN range(24) h(h)
LEFT JOIN (SELECT * FROM security_events WHERE blocked = 1) e
  ON dayofweek(e."timestamp") = d.d AND hour(e."timestamp") = h.h GROUP BY 1, 2"""))
def attack_heatmap(spark, sf):
    return D.attack_heatmap(T.security_events(spark, sf))


@query("top_ips_with_types", sql(["security_events"], """
SELECT ip, count(*) AS attack_count, array_to_string(list_sort(list(DISTINCT threat_type)), ',') AS types
FROM security_events WHERE blocked = 1 AND ip IS NOT NULL GROUP BY 1
ORDER BY attack_count DESC, ip LIMIT 10"""))
def top_ips_with_types(spark, sf):
    return D.top_ips_with_types(T.security_events(spark, sf))


@query("threat_level", sql(["security_events"], """
SELECT *, CASE WHEN critical > 5 OR total_blocked > 50 THEN 'CRITICAL'
  WHEN critical > 0 OR high > 5 OR total_blocked > 20 THEN 'HIGH'
  WHEN high > 0 OR total_blocked > 5 THEN 'MEDIUM' ELSE 'LOW' END AS overall_threat_level
FROM (SELECT count(*) FILTER (upper(threat_level) = 'CRITICAL') AS critical,
  count(*) FILTER (upper(threat_level) = 'HIGH') AS high, count(*) AS total_blocked
  FROM security_events WHERE blocked = 1)"""))
def threat_level(spark, sf):
    return D.threat_level(T.security_events(spark, sf))


@query("active_connections", sql(["security_events"], f"""
SELECT ip, max("timestamp") AS last_seen, count(*) AS request_count,
  count(*) FILTER (blocked = 1) AS blocked_count,
  CASE WHEN count(*) FILTER (blocked = 1) > 0 THEN 'blocked' ELSE 'active' END AS status
FROM security_events WHERE "timestamp" BETWEEN TIMESTAMP '{NOW}' - INTERVAL 120 MINUTE AND TIMESTAMP '{NOW}'
GROUP BY ip ORDER BY last_seen DESC, ip LIMIT 20"""))
def active_connections(spark, sf):
    return D.active_connections(T.security_events(spark, sf), now=NOW, last_minutes=120)


@query("active_connections_by_requests", sql(["security_events"], f"""
SELECT ip, max("timestamp") AS last_seen, count(*) AS request_count,
  count(*) FILTER (blocked = 1) AS blocked_count,
  CASE WHEN count(*) FILTER (blocked = 1) > 0 THEN 'blocked' ELSE 'active' END AS status
FROM security_events WHERE {LAST24} GROUP BY ip ORDER BY request_count DESC, ip LIMIT 20"""))
def active_connections_by_requests(spark, sf):
    return D.active_connections(T.security_events(spark, sf), now=NOW, last_minutes=1440, by="request_count")


@query("ip_activity", sql(["security_events"], """
SELECT a.*, coalesce(t.blocked, 0) AS blocked, coalesce(t.allowed, 0) AS allowed FROM
 (SELECT ip, count(*) AS requests, min("timestamp") AS first_seen,
    array_to_string(list_sort(list(DISTINCT d_method)), ',') AS methods, count(DISTINCT url) AS unique_urls
  FROM security_events GROUP BY ip) a
LEFT JOIN (SELECT ip, count(*) FILTER (blocked = 1) AS blocked, count(*) FILTER (blocked = 0) AS allowed
  FROM (SELECT * FROM security_events ORDER BY "timestamp" DESC, event_id DESC LIMIT 200) GROUP BY ip) t
USING (ip) ORDER BY requests DESC, ip LIMIT 50"""))
def ip_activity(spark, sf):
    return D.ip_activity(T.security_events(spark, sf))


def feeds(spark, sf):
    """Three overlapping feeds of page visits."""
    e = T.security_events(spark, sf)
    n = F.expr("cast(substr(event_id, 3) as bigint)")
    base = e.select("timestamp", "ip", F.col("url").alias("page"), "user_agent", n.alias("n"))
    a = base.filter("n % 2 = 0").withColumn("action", F.lit("visit")).withColumn("status", F.lit("local"))
    b = base.filter("n % 3 = 0").withColumn("action", F.lit("page_visit")).withColumn("status", F.lit("live"))
    c = base.filter("n % 5 = 0").withColumn("action", F.lit("page_visit")).withColumn("status", F.lit("tracked"))
    return [a, b, c]


@query("live_activity", sql(["security_events"], """
SELECT "timestamp", ip, page, action, user_agent, status, total FROM (
  SELECT *, count(*) OVER () AS total FROM (
    SELECT *, row_number() OVER (PARTITION BY "timestamp", ip, page ORDER BY p, action, user_agent, status) AS rn
    FROM (
      SELECT "timestamp", ip, url AS page, 'visit' AS action, user_agent, 'local' AS status, 0 AS p
        FROM security_events WHERE CAST(substr(event_id, 3) AS BIGINT) % 2 = 0
      UNION ALL SELECT "timestamp", ip, url, 'page_visit', user_agent, 'live', 1
        FROM security_events WHERE CAST(substr(event_id, 3) AS BIGINT) % 3 = 0
      UNION ALL SELECT "timestamp", ip, url, 'page_visit', user_agent, 'tracked', 2
        FROM security_events WHERE CAST(substr(event_id, 3) AS BIGINT) % 5 = 0))
  WHERE rn = 1)
ORDER BY "timestamp" DESC, ip, page LIMIT 50"""))
def live_activity(spark, sf):
    return D.live_activity(feeds(spark, sf))


@query("geolocated_users", sql(["security_events", "logs", "geo_ranges"], """
SELECT e.ip, e.first_seen, e.request_count, e.user_agent, g.country, g.latitude, g.longitude,
  g.country IS NOT NULL AS located
FROM (SELECT ip, min("timestamp") AS first_seen, count(*) AS request_count,
        arg_min(user_agent, ("timestamp", event_id)) AS user_agent FROM security_events GROUP BY ip) e
LEFT JOIN (SELECT DISTINCT src_ip AS ip, geo_country AS country, geo_lat AS latitude, geo_lon AS longitude
           FROM geo_logs) g ON e.ip = g.ip""", extra=GEO_CTE))
def geolocated_users(spark, sf):
    e = T.security_events(spark, sf)
    places = enrich.join_ranges(e, T.geo_ranges(spark, sf), ip="ip", cols=["country", "latitude", "longitude"])
    return D.geolocated_users(e, places)


@query("located_totals", sql(["security_events", "logs", "geo_ranges"], """
SELECT count(*) AS total, count(*) FILTER (located) AS geolocated FROM (
  SELECT src_ip, bool_or(geo_country IS NOT NULL) AS located FROM geo_logs GROUP BY 1)""", extra=GEO_CTE))
def located_totals(spark, sf):
    return D.located_totals(geolocated_users(spark, sf))


@query("traffic_graph", sql(["logs"], """
SELECT dst_ip AS source, src_ip AS target, count(*) AS requests,
  count(*) FILTER (action = 'BLOCKED') AS blocked, 2 AS target_group
FROM logs GROUP BY 1, 2"""))
def traffic_graph(spark, sf):
    return D.traffic_graph(T.logs(spark, sf))


@query("traffic_graph_nodes", sql(["logs"], """
SELECT node, min(g) AS node_group, CAST(count(*) AS BIGINT) AS requests FROM (
  SELECT dst_ip AS node, 0 AS g FROM logs UNION ALL SELECT src_ip, 2 FROM logs) GROUP BY 1"""))
def traffic_graph_nodes(spark, sf):
    return D.graph_nodes(D.traffic_graph(T.logs(spark, sf)))


@query("score_stats", sql(["security_events"], """
SELECT count(ai_score) AS total_scored, count(*) FILTER (ai_score > 0.7) AS high_risk,
  count(*) FILTER (flagged) AS flagged_count, round(coalesce(avg(ai_score), 0.0), 6) AS avg_score,
  count(*) FILTER (ai_score <= 0.3) AS low,
  count(*) FILTER (ai_score > 0.3 AND ai_score <= 0.7) AS medium,
  count(*) FILTER (ai_score > 0.7) AS high FROM security_events"""))
def score_stats(spark, sf):
    return D.score_stats(T.security_events(spark, sf))


@query("score_timeline", sql(["security_events"], f"""
SELECT CAST(hour("timestamp") AS INTEGER) AS hour, round(avg(ai_score), 6) AS avg_score, count(*) AS events
FROM security_events WHERE ai_score IS NOT NULL AND {LAST24} GROUP BY 1"""))
def score_timeline(spark, sf):
    return D.score_timeline(T.security_events(spark, sf), now=NOW)


@query("event_kpis", sql(["security_events"], f"""
SELECT count(*) AS total_events, count(*) FILTER (blocked = 1) AS threats_blocked,
  count(*) FILTER (blocked = 0) AS requests_allowed, count(DISTINCT threat_type) AS unique_threats,
  count(DISTINCT ip) AS unique_ips FROM security_events WHERE {LAST24}"""))
def event_kpis(spark, sf):
    return D.event_kpis(T.security_events(spark, sf), now=NOW)


@query("time_window_filter", sql(["logs"], f"""
SELECT id, "timestamp", src_ip, action FROM logs
WHERE "timestamp" BETWEEN TIMESTAMP '{NOW}' - INTERVAL 48 HOUR AND TIMESTAMP '{NOW}'"""))
def time_window_filter(spark, sf):
    return D.time_window_filter(T.logs(spark, sf), "timestamp", now=NOW, last_hours=48).select(
        "id", "timestamp", "src_ip", "action")
