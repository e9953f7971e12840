"""Streaming queries: file streams worked off to the end, results read back.

A cycle is released when the watermark passes its end, so the oracles leave out
what ends after the newest event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.functions.text import any_rlike
from duskwatch.operators import alerts as A
from duskwatch.operators import behavior as B
from duskwatch.operators import correlate as C
from duskwatch.operators import rules as R
from duskwatch.schema import HITS
from duskwatch.streaming import jobs as J
from duskwatch.streaming import scan, sessions, state
from workload import lines as L
from workload import tables as T
from workload.alerts import DEDUP, HIT_COLS, HITS_EXTRA, MATCH
from workload.alerts import LIMITS as DETECTOR_LIMITS
from workload.common import ORACLES, query
from workload.ingest import JSON_SQL, NOW
from workload.requests import LIMITS, REPLAY
from workload.rules import EXTRA_SIGNATURES, RESET_EXTRA, TEST_THRESHOLDS, tagged_logs
from workload.staging import staging
from workload.tables_sql import floor_to, rank, sql

DAY = "1 day"
DAYC = floor_to('"timestamp"', 86400)
CLOSED = f"{DAYC} + INTERVAL 1 DAY <= (SELECT max(\"timestamp\") FROM logs)"


def finished(spark, name: str, stream: DataFrame) -> DataFrame:
    """Run ``stream`` over all input into a table and read that."""
    root = staging(spark, name)
    J.run_to_end(stream, f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


@query("stream_ingest", sql(["logs"], f"SELECT 'accepted' AS status, * EXCLUDE (src_port) FROM ({JSON_SQL}) UNION ALL "
       "SELECT 'rejected', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM logs WHERE id % 100 = 0"))
def stream_ingest(spark, sf):
    root = staging(spark, "ingest")
    L.raw_json(spark, sf).write.text(f"{root}/in")
    lines = spark.readStream.text(f"{root}/in").withColumnRenamed("value", "line")
    J.stream_ingest(lines, source_format="json", now=NOW, logs_path=f"{root}/logs", quarantine_path=f"{root}/bad",
                    checkpoint=f"{root}/checkpoint").awaitTermination()
    cols = ["timestamp", "src_ip", "dst_ip", "action", "http_method", "http_path", "http_status", "http_user_agent",
            "attack_type", "severity", "confidence", "session_id"]
    good = spark.read.parquet(f"{root}/logs").select(F.lit("accepted").alias("status"), *cols)
    bad = spark.read.parquet(f"{root}/bad").select(F.lit("rejected").alias("status"))
    return good.unionByName(bad, allowMissingColumns=True)


SCAN = "regexp_matches(http_path, '" + any_rlike(B.SCAN_PATHS) + "')"
RECON = "'" + "', '".join(C.RECON) + "'"
EXPLOIT = "'" + "', '".join(C.EXPLOIT) + "'"
DET = {"d": f"""SELECT {DAYC} AS cycle_start, src_ip, count(*) AS n, count(*) FILTER (action = 'BLOCKED') AS b,
    count(*) FILTER ({SCAN}) AS s, count(DISTINCT attack_type) FILTER (attack_type <> 'NONE') AS k,
    count(*) FILTER (attack_type <> 'NONE') AS a, bool_or(attack_type IN ({RECON})) AS r, bool_or(attack_type IN ({EXPLOIT})) AS e
  FROM logs WHERE {CLOSED} GROUP BY 1, 2"""}


@query("stream_detections", sql(["logs"], """
SELECT cycle_start, src_ip, 'high_request_rate' AS detector, n AS event_count,
  CASE WHEN n > 8 THEN 'HIGH' ELSE 'MEDIUM' END AS severity FROM d WHERE n >= 4
UNION ALL SELECT cycle_start, src_ip, 'high_block_rate', b, 'HIGH' FROM d WHERE b >= 2
UNION ALL SELECT cycle_start, src_ip, 'scan_path_hits', s, 'HIGH' FROM d WHERE s >= 2
UNION ALL SELECT cycle_start, src_ip, 'multi_vector_ip', a, 'CRITICAL' FROM d WHERE k >= 2
UNION ALL SELECT cycle_start, src_ip, 'recon_exploit', a, 'CRITICAL' FROM d
  JOIN (SELECT cycle_start, sum(a) AS day FROM d GROUP BY 1) USING (cycle_start) WHERE r AND e AND day >= 20""", extra=DET))
def stream_detections(spark, sf):
    return finished(spark, "detections", J.stream_detections(
        T.logs(spark, sf, stream=True), cycle=DAY, delay="0 seconds", requests=4, blocked=2, scans=2, kinds=2,
        min_attacks=20))


SES = {"g": f"""SELECT {DAYC} AS cycle_start, session_id, count(*) AS event_count, arg_min(src_ip, ("timestamp", id)) AS src_ip,
    count(DISTINCT attack_type) FILTER (attack_type <> 'NONE') AS k, count(DISTINCT geo_country) AS c,
    bool_and(p IS NULL OR p <= r) AS up, arg_max(r, ("timestamp", id)) AS last
  FROM (SELECT *, lag(r) OVER (PARTITION BY session_id ORDER BY "timestamp", id) AS p FROM (
    SELECT *, {rank('severity')} AS r FROM logs)) WHERE {CLOSED} GROUP BY 1, 2"""}


@query("stream_sessions", sql(["logs"], """
SELECT cycle_start, session_id, src_ip, event_count, 'session_multi_attack' AS detector FROM g WHERE event_count >= 2 AND k >= 2
UNION ALL SELECT cycle_start, session_id, src_ip, event_count, 'session_escalation' FROM g WHERE event_count >= 3 AND up AND last >= 3
UNION ALL SELECT cycle_start, session_id, src_ip, event_count, 'multi_country_session' FROM g WHERE c >= 3""", extra=SES))
def stream_sessions(spark, sf):
    return finished(spark, "sessions", J.stream_sessions(T.logs(spark, sf, stream=True), cycle=DAY, delay="0 seconds"))


OPEN = "(SELECT epoch_us(max(\"timestamp\")) // 1000000 FROM logs)"


@query("stream_thresholds", sql(["logs"], f"""
SELECT rule_id, group_key, sec AS second, CAST(total // threshold AS BIGINT) AS fires, first_sec AS first_second
FROM run WHERE total >= threshold AND sec < {OPEN}""", extra=RESET_EXTRA, recursive=True))
def stream_thresholds(spark, sf):
    return finished(spark, "thresholds", J.stream_thresholds(
        T.logs(spark, sf, stream=True), TEST_THRESHOLDS, delay="0 seconds"))


MERGE = {
    "hs": """SELECT 'sig-rce-any' AS rule_id, src_ip, attack_type, http_path, epoch_us("timestamp") // 3000000 * 3 AS t,
      count(*) AS n FROM logs WHERE attack_type = 'RCE' GROUP BY ALL
      UNION ALL SELECT 'sig-ddos', src_ip, attack_type, http_path, epoch_us("timestamp") // 3000000 * 3, count(*)
      FROM logs WHERE attack_type = 'DDOS' GROUP BY ALL""",
    "st": f"""SELECT *, row_number() OVER (PARTITION BY rule_id, src_ip, attack_type, http_path ORDER BY t) AS rn FROM hs
      WHERE t + 3 <= (SELECT epoch_us(max("timestamp")) / 1000000.0 FROM logs WHERE attack_type IN ('RCE', 'DDOS'))""",
    "ch": """SELECT rule_id, src_ip, attack_type, http_path, rn, t, t AS anchor, n FROM st WHERE rn = 1
      UNION ALL SELECT s.rule_id, s.src_ip, s.attack_type, s.http_path, s.rn, s.t,
        CASE WHEN s.t - c.anchor > 864000 THEN s.t ELSE c.anchor END, s.n
      FROM ch c JOIN st s ON s.rule_id = c.rule_id AND s.src_ip = c.src_ip AND s.attack_type = c.attack_type
        AND s.http_path = c.http_path AND s.rn = c.rn + 1""",
}


@query("stream_alert_dedup", sql(["logs"], """
SELECT rule_id, src_ip, attack_type, http_path, make_timestamp(anchor * 1000000) AS created_at,
  make_timestamp(max(t) * 1000000) AS last_seen, CAST(sum(n) AS BIGINT) AS event_count
FROM ch GROUP BY rule_id, src_ip, attack_type, http_path, anchor""", extra=MERGE, recursive=True))
def stream_alert_dedup(spark, sf):
    rules = [r for r in R.SIGNATURES if r["id"] in ("sig-rce-any", "sig-ddos")]
    hits = R.signature_hits(T.logs(spark, sf, stream=True), rules)
    rows = finished(spark, "dedup", J.stream_alert_dedup(hits, window_seconds=864000, delay="0 seconds"))
    return rows.groupBy("alert_uid", "rule_id", "src_ip", "attack_type", "http_path", "created_at").agg(
        F.max("seen_at").alias("last_seen"), F.sum("event_count").alias("event_count")).drop("alert_uid")


@query("stream_new_country", sql(["logs"], f"""
SELECT geo_country, d AS cycle_start, n AS event_count FROM (
  SELECT *, row_number() OVER (PARTITION BY geo_country ORDER BY d) AS rn FROM (
    SELECT geo_country, {DAYC} AS d, count(*) AS n FROM logs WHERE geo_country IN ('RU', 'CN', 'BY', 'UA') GROUP BY 1, 2))
WHERE rn = 1"""))
def stream_new_country(spark, sf):
    return finished(spark, "country", J.stream_new_country(
        T.logs(spark, sf, stream=True), cycle_seconds=86400, delay="0 seconds"))


@query("stream_rate_limit", sql(["requests", "logs"], f"""
SELECT client_ip, make_timestamp(sec * 1000000) AS second, requests, accepted, CAST(rate_limited AS BIGINT) AS rate_limited,
  CAST(burst_refused AS BIGINT) AS burst_refused, CAST(blocked AS BIGINT) AS blocked FROM replay WHERE sec < {OPEN}""",
    extra=REPLAY, recursive=True))
def stream_rate_limit(spark, sf):
    return finished(spark, "limit", J.stream_rate_limit(T.requests(spark, sf, stream=True), delay="0 seconds", **LIMITS))


@query("stream_alert_feed", sql(["alerts"], """
SELECT alert_uid, created_at, severity, severity || ': ' || upper(replace(attack_type, '_', ' ')) AS notification_title,
  http_path || ' • ' || src_ip || ' • ' || geo_country AS message FROM alerts WHERE severity = 'CRITICAL'"""))
def stream_alert_feed(spark, sf):
    root = staging(spark, "feed")
    T.alerts(spark, sf).write.parquet(f"{root}/in")
    schema = spark.read.parquet(f"{root}/in").schema
    J.stream_alert_feed(spark.readStream.schema(schema).parquet(f"{root}/in"), path=f"{root}/out",
                        checkpoint=f"{root}/checkpoint", min_severity="CRITICAL").awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("batch_id")


def _scan(spark, sf) -> str:
    """All detectors over three loads in time order, a batch each; the folder of the findings."""
    root = staging(spark, "scan")
    logs = tagged_logs(spark, sf)
    edges = ["2024-01-01", "2024-01-11", "2024-01-21", "2025-01-01"]
    for a, b in zip(edges, edges[1:]):
        logs.filter((F.col("timestamp") >= a) & (F.col("timestamp") < b)).write.mode("append").parquet(f"{root}/in")
        # A run takes all files that came since the one before as one batch, however many they are.
        stream = spark.readStream.schema(logs.schema).parquet(f"{root}/in")
        scan.stream_scan(stream, path=f"{root}/scan", checkpoint=f"{root}/checkpoint", cycle=86400, delay=0, signatures=EXTRA_SIGNATURES,
                         limits=DETECTOR_LIMITS).awaitTermination()
    return f"{root}/scan"


CYCLES = {**HITS_EXTRA, "hits": HITS_EXTRA["hits"] + f""" WHERE source <> 'threshold' AND title NOT LIKE 'New traffic%'
  AND {floor_to('seen_at', 86400)} + INTERVAL 1 DAY <= (SELECT max("timestamp") FROM logs)"""}


@query("stream_scan", sql(["logs", "mitre"], f"SELECT {', '.join(HIT_COLS)}, log_id FROM hits", extra=CYCLES, recursive=True))
def stream_scan(spark, sf):
    hits = scan.scan_hits(spark, _scan(spark, sf))
    one = F.when(F.col("title").startswith("Burst traffic") | (F.col("source") == "threshold"), None).otherwise(F.array_min("log_ids"))
    return hits.select(*HIT_COLS, one.alias("log_id"))


@query("stream_scan_alerts", sql(["logs", "mitre"], f"""
SELECT s.source, s.rule_id, s.src_ip, s.attack_type, s.http_path, make_timestamp(r.anchor) AS created_at,
  make_timestamp(max(s.t)) AS last_seen, CAST(sum(s.n) AS BIGINT) AS event_count, max(s.conf) AS confidence
FROM chain r JOIN steps2 s ON s.rn = r.rn AND {MATCH} GROUP BY s.source, s.rule_id, s.src_ip, s.attack_type, s.http_path, r.anchor""",
    extra={**CYCLES, **DEDUP, "steps2": DEDUP["steps2"] + " WHERE t + 3000000 <= (SELECT epoch_us(max(seen_at)) FROM hits)"}, recursive=True))
def stream_scan_alerts(spark, sf):
    """The findings of all detectors, merged into alerts by a second stream."""
    path = _scan(spark, sf)
    hits = spark.readStream.schema(HITS).parquet(f"{path}/hits/*")
    rows = finished(spark, "scan_alerts", J.stream_alert_dedup(hits, window_seconds=172800, delay="0 seconds"))
    return rows.groupBy("alert_uid", "source", "rule_id", "src_ip", "attack_type", "http_path", "created_at").agg(
        F.max("seen_at").alias("last_seen"), F.sum("event_count").alias("event_count"), F.max("confidence").alias("confidence")).drop("alert_uid")


def _kept_state(spark, name: str, changes: DataFrame, job, fields: list[str]) -> DataFrame:
    """Changes in three loads that overlap in time, each worked off by a run of its own, then the state."""
    root = staging(spark, name)
    for load in range(3):
        changes.filter(F.col("seq") % 3 == load).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(changes.schema).parquet(f"{root}/in")
        job(stream, path=f"{root}/state", checkpoint=f"{root}/checkpoint", buckets=8).awaitTermination()
    return state.read_state(spark, f"{root}/state", fields=fields)


@query("stream_alert_state", ORACLES["alert_state"])
def stream_alert_state(spark, sf):
    return _kept_state(spark, "alert_state", T.alert_changes(spark, sf), state.stream_alert_state, A.ALERT_STATE["fields"])


@query("stream_incident_state", ORACLES["incident_state"])
def stream_incident_state(spark, sf):
    return _kept_state(spark, "incident_state", T.incident_changes(spark, sf), state.stream_incident_state, A.INCIDENT_STATE["fields"])


GAP = 6 * 3600
SILENT = {
    "ul": f"""SELECT *, split_part(session_id, '-', 1) AS sid, {rank('severity')} AS r, epoch_us("timestamp") // 1000000 AS sec FROM logs WHERE session_id <> ''""",
    "nb": """SELECT *, sum(new) OVER (PARTITION BY sid ORDER BY sec RANGE UNBOUNDED PRECEDING) AS run FROM (
      SELECT *, CASE WHEN sec - lag(sec) OVER (PARTITION BY sid ORDER BY "timestamp", id) <= %d THEN 0 ELSE 1 END AS new FROM ul)""" % GAP,
    "od": """SELECT *, lag(r) OVER (PARTITION BY sid, run ORDER BY "timestamp", id) AS p FROM nb""",
    "ss": f"""SELECT sid, run, min("timestamp") AS started_at, max("timestamp") AS seen_at, arg_min(src_ip, ("timestamp", id)) AS src_ip,
      count(*) AS n, list_sort(list(DISTINCT attack_type) FILTER (attack_type <> 'NONE')) AS k,
      count(DISTINCT geo_country) FILTER (geo_country <> '') AS c, bool_and(p IS NULL OR p <= r) AS up, arg_max(r, ("timestamp", id)) AS fin
      FROM od GROUP BY 1, 2 HAVING max(sec) + 1 + {GAP} <= (SELECT epoch_us(max("timestamp")) / 1000000.0 FROM logs)""",
    "sf": """SELECT sid, run, started_at, seen_at, src_ip, n, 'Session multi-attack: ' || array_to_string(k, ', ') AS title,
        'correlation.session' AS source, 'OTHER' AS attack_type, 0.8::DOUBLE AS confidence FROM ss WHERE n >= 2 AND len(k) >= 2
      UNION ALL SELECT sid, run, started_at, seen_at, src_ip, n, 'Escalating severity in session', 'correlation.session', NULL, 0.75 FROM ss
        WHERE n >= 3 AND up AND fin >= 3
      UNION ALL SELECT sid, run, started_at, seen_at, src_ip, n, 'Multi-country session anomaly', 'behavioral.geo', NULL, 0.85 FROM ss WHERE c >= 3""",
}


@query("stream_silent_sessions", sql(["logs"], """
SELECT sid AS session_id, started_at AS cycle_start, seen_at, src_ip, n AS event_count, title, source, attack_type, confidence, 'HIGH' AS severity,
  (SELECT string_agg(id, ',' ORDER BY "timestamp", id) FROM (
    SELECT DISTINCT id, "timestamp" FROM (
      SELECT id, "timestamp", row_number() OVER (PARTITION BY r ORDER BY "timestamp", id) AS a,
        row_number() OVER (PARTITION BY r ORDER BY "timestamp" DESC, id DESC) AS b
      FROM nb WHERE nb.sid = sf.sid AND nb.run = sf.run) WHERE a = 1 OR b = 1)) AS log_ids FROM sf""", extra=SILENT))
def stream_silent_sessions(spark, sf):
    """Sessions of a user, whatever the day, until six hours of silence."""
    logs = T.logs(spark, sf, stream=True).withColumn("session_id", F.split_part("session_id", F.lit("-"), F.lit(1)))
    hits = finished(spark, "silent", sessions.stream_silent_sessions(logs, gap_seconds=GAP, delay="0 seconds"))
    return hits.select("session_id", "cycle_start", "seen_at", "src_ip", "event_count", "title", "source", "attack_type", "confidence", "severity", "log_ids")
