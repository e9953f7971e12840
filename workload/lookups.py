"""Join and lookup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskwatch.operators import enrich as N
from workload import tables as T
from workload.common import query
from workload.dashboards import GEO_CTE
from workload.tables_sql import plus, sql, user_ip


@query("geo_enrich", sql(["logs", "geo_ranges"], """
SELECT id, src_ip, geo_country, geo_city, geo_lat, geo_lon, geo_asn FROM geo_logs""", extra=GEO_CTE))
def geo_enrich(spark, sf):
    return N.geo_enrich(T.logs(spark, sf), T.geo_ranges(spark, sf)).select(
        "id", "src_ip", "geo_country", "geo_city", "geo_lat", "geo_lon", "geo_asn")


@query("mitre_enrich", sql(["logs", "mitre"], """
SELECT id, l.attack_type, mitre_tactic, mitre_technique, technique_name FROM logs l
LEFT JOIN mitre m ON l.attack_type = m.attack_type"""))
def mitre_enrich(spark, sf):
    return N.mitre_enrich(T.logs(spark, sf)).select(
        "id", "attack_type", "mitre_tactic", "mitre_technique", "technique_name")


@query("mitre_coverage", sql(["logs", "alerts", "mitre"], """
SELECT m.mitre_tactic, m.mitre_technique,
  CAST(sum((SELECT count(*) FROM logs l WHERE l.attack_type = m.attack_type)) AS BIGINT) AS events,
  (SELECT count(DISTINCT src_ip) FROM logs l JOIN mitre k ON l.attack_type = k.attack_type
    WHERE k.mitre_tactic = m.mitre_tactic AND k.mitre_technique = m.mitre_technique) AS sources,
  CAST(sum((SELECT count(*) FROM alerts a WHERE a.attack_type = m.attack_type)) AS BIGINT) AS alerts
FROM mitre m GROUP BY 1, 2"""))
def mitre_coverage(spark, sf):
    return N.mitre_coverage(T.logs(spark, sf), T.alerts(spark, sf))


ALLOW, DENY = ["203.0.0.0/28", "::1"], ["203.0.0.8/29", "203.0.0.64/26"]


def intel(spark, sf):
    c = T.table(spark, sf, "customer").filter("c_custkey % 3 = 0")
    return c.select(T.user_ip(F.col("c_custkey")).alias("ip"),
                    ((F.col("c_custkey") * 37) % 201 - 100).cast("int").alias("reputation_score"),
                    F.lower("c_mktsegment").alias("threat_types"))


REPUTATION = {
    "ips": "SELECT DISTINCT src_ip AS ip, CAST(split_part(src_ip, '.', 3) AS INTEGER) * 256 "
           "+ CAST(split_part(src_ip, '.', 4) AS INTEGER) AS u FROM logs",
    "st": """SELECT ip, s, threat_types, CASE WHEN u < 16 THEN 'whitelisted' WHEN u BETWEEN 64 AND 127 THEN 'blacklisted'
      WHEN s IS NOT NULL THEN 'known' ELSE 'unknown' END AS status
      FROM ips LEFT JOIN (SELECT c_custkey, CAST((c_custkey * 37) % 201 - 100 AS INTEGER) AS s,
        lower(c_mktsegment) AS threat_types FROM customer WHERE c_custkey % 3 = 0) c ON c.c_custkey = u"""}


@query("ip_reputation", sql(["logs"], """
SELECT ip, status, CASE status WHEN 'whitelisted' THEN 100 WHEN 'blacklisted' THEN -100 WHEN 'unknown' THEN 0 ELSE s END AS reputation_score,
  CASE status WHEN 'whitelisted' THEN 'none' WHEN 'blacklisted' THEN 'critical' WHEN 'unknown' THEN 'low'
    ELSE CASE WHEN s >= 50 THEN 'none' WHEN s >= 0 THEN 'low' WHEN s >= -50 THEN 'medium' WHEN s >= -80 THEN 'high' ELSE 'critical' END END AS threat_level,
  CASE status WHEN 'whitelisted' THEN 'allow' WHEN 'blacklisted' THEN 'block' WHEN 'unknown' THEN 'allow'
    ELSE CASE WHEN s < -20 THEN 'block' ELSE 'allow' END END AS action,
  CASE WHEN status = 'known' THEN threat_types END AS threat_types FROM st""", extra=REPUTATION))
def ip_reputation(spark, sf):
    return N.ip_reputation(T.logs(spark, sf), intel(spark, sf), allow=ALLOW, deny=DENY, policy="strict")


@query("blocked_traffic", sql(["logs", "blocks"], """
SELECT id, src_ip, "timestamp", block_id, CASE WHEN expires_at IS NULL THEN revoked_at WHEN revoked_at < expires_at THEN revoked_at
  ELSE expires_at END AS blocked_until
FROM (SELECT l.id, l.src_ip, l."timestamp", b.*, row_number() OVER (
        PARTITION BY l.id ORDER BY b.created_at DESC, b.block_id DESC) AS rn
      FROM logs l JOIN blocks b ON l.src_ip = b.ip AND b.created_at <= l."timestamp")
WHERE rn = 1 AND (expires_at IS NULL OR "timestamp" < expires_at) AND (revoked_at IS NULL OR "timestamp" < revoked_at)"""))
def blocked_traffic(spark, sf):
    return N.blocked_traffic(T.logs(spark, sf), T.blocks(spark, sf))


P95 = "list_sort(list({v}))[CAST(floor(0.95 * (count({v}) - 1)) AS INTEGER) + 1]"


@query("alert_pipeline_delay", sql(["alerts", "alert_log_ids", "logs"], f"""
SELECT count(*) AS alerts_measured, round(avg(ms), 2) AS avg_delay_ms, round({P95.format(v='ms')}, 2) AS p95_delay_ms
FROM (SELECT a.id, (epoch_us(any_value(a.created_at)) - epoch_us(max(l.received_at))) / 1000000.0::DOUBLE * 1000.0 AS ms
  FROM alerts a JOIN alert_log_ids x ON x.alert_id = a.id
  JOIN logs l ON l.id = x.log_id GROUP BY a.id)"""))
def alert_pipeline_delay(spark, sf):
    ids = T.alert_log_ids(spark, sf).withColumnRenamed("alert_id", "id")
    return N.alert_pipeline_delay(T.alerts(spark, sf).select("id", "created_at").join(ids, "id"), T.logs(spark, sf))


@query("alert_incident_delay", sql(["linked_alerts", "incidents"], f"""
SELECT count(*) AS pairs, count(*) FILTER (ms < 0) AS negative_pairs, count(*) FILTER (ms >= 0) AS non_negative_pairs,
  round(avg(ms) FILTER (ms >= 0), 2) AS avg_delay_ms,
  (SELECT round({P95.format(v='ms')}, 2) FROM d WHERE ms >= 0) AS p95_delay_ms FROM d""", extra={"d": """
  SELECT round((epoch_us(i.created_at) - epoch_us(a.created_at)) / 1000000.0::DOUBLE * 1000.0, 3) AS ms
  FROM linked_alerts a JOIN incidents i ON a.incident_id = i.id"""}))
def alert_incident_delay(spark, sf):
    return N.alert_incident_delay(T.linked_alerts(spark, sf), T.incidents(spark, sf))


@query("tracked_users", sql(["logs", "geo_ranges"], f"""
SELECT coalesce(s.ip, r.ip) AS ip, CASE WHEN s.ip IS NOT NULL THEN s.seen ELSE r.at END AS seen_at,
  CASE WHEN s.ip IS NOT NULL THEN s.ua ELSE r.ua END AS user_agent,
  CASE WHEN s.ip IS NOT NULL THEN CASE WHEN r.src = 'gps' THEN coalesce(r.loc, s.loc) ELSE s.loc END ELSE r.loc END AS location,
  CASE WHEN s.ip IS NOT NULL THEN CASE WHEN r.src = 'gps' THEN coalesce(r.loc, s.loc) ELSE s.loc END ELSE r.loc END IS NOT NULL AS located,
  coalesce(s.n, 0) AS request_count, CASE WHEN s.ip IS NOT NULL THEN 'server-tracking' ELSE 'reported' END AS source
FROM (SELECT src_ip AS ip, max("timestamp") AS seen, count(*) AS n, arg_min(http_user_agent, ("timestamp", id)) AS ua,
        any_value(geo_country) AS loc FROM geo_logs GROUP BY 1) s
FULL JOIN (SELECT {user_ip('c_custkey')} AS ip, {plus("TIMESTAMP '2024-01-01'", 'c_custkey')} AS at, c_name AS ua,
        CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS loc,
        CASE WHEN c_custkey % 2 = 0 THEN 'gps' ELSE 'ip' END AS src FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0) r
ON s.ip = r.ip""", extra=GEO_CTE))
def tracked_users(spark, sf):
    from workload.dashboards import located_logs
    from duskwatch.functions.times import plus_seconds

    seen = located_logs(spark, sf).groupBy(F.col("src_ip").alias("ip")).agg(
        F.max("timestamp").alias("last_seen"), F.count("*").alias("request_count"),
        F.min_by("http_user_agent", F.struct("timestamp", "id")).alias("user_agent"),
        F.max("geo_country").alias("location"))
    c = T.table(spark, sf, "customer").filter("c_custkey % 2 = 0 or c_custkey % 3 = 0")
    reported = c.select(
        T.user_ip(F.col("c_custkey")).alias("ip"),
        plus_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("c_custkey")).alias("reported_at"),
        F.col("c_name").alias("user_agent"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("location"),
        F.when(F.col("c_custkey") % 2 == 0, "gps").otherwise("ip").alias("location_source"))
    return N.tracked_users(seen, reported)
