"""Security tables derived from the driver's parquet tables (FIXTURES.md)."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.functions import severity as sev
from duskwatch.functions.times import floor_to, plus_seconds
from duskwatch.operators.enrich import mitre_map
from duskwatch.session import configure

ATTACKS = [
    "SQLI", "XSS", "RCE", "LFI", "RFI", "BRUTE_FORCE", "PORT_SCAN", "DDOS",
    "DIRECTORY_TRAVERSAL", "COMMAND_INJECTION", "SSRF", "XXE", "CSRF", "BOT", "OTHER",
]
PROBE_PATHS = ["/.env", "/wp-admin", "/login", "/admin", "/backup"]
AGENTS = [
    "Mozilla/5.0 (X11; Linux x86_64)", "sqlmap/1.7", "curl/8.0.1", "Googlebot/2.1",
    "python-requests/2.31", "-", "Mozilla/5.0 (Windows NT 10.0)",
]
COUNTRIES = ["US", "CN", "RU", "DE", "GB", "KP", "IN", "IR", "KR", "AU", "FR", "NL"]
THREATS = [
    "sql_injection", "xss_attempt", "rce_attempt", "path_traversal", "path_traversal",
    "auth_bypass_attempt", "bot_detected", "ddos_attack", "path_traversal",
    "command_injection", "ssrf_attempt", "xml_injection", "html_injection", "bot_detected",
    "rate_limit_exceeded",
]
# Labelled replay payloads (fixed values) and four harmless ones.
PAYLOADS = [
    "admin' OR '1'='1'--", "1 UNION SELECT 1,2,3--", "' OR 1=1#", "1; DROP TABLE users;--",
    "<script>alert(1)</script>", "<img src=x onerror=alert(1)>", "javascript:alert(1)",
    "<svg onload=alert(1)>", "../../etc/passwd", "..%2f..%2f..%2fwindows/win.ini",
    "$(whoami)", "; cat /etc/passwd;", "blue shoes", "page 2", "http://localhost/a", "{{7*7}}",
]
ENCODED = [quote(p, safe="") for p in PAYLOADS]
ENCODED_TWICE = [quote(p, safe="") for p in ENCODED]
NOW = "2024-01-31 00:00:00"


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def table(spark: SparkSession, sf: str, name: str, *, stream: bool = False) -> DataFrame:
    configure(spark)
    path = f"{sf}/{name}.parquet"
    if stream:
        # A glob, because a stream over a plain path wants a folder and this may be one file.
        return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf}/{name}.parque[t]")
    return spark.read.parquet(path)


def user_ip(user: Column) -> Column:
    return F.concat(F.lit("203.0."), F.floor(user / 256).cast("string"), F.lit("."),
                    (user % 256).cast("string"))


#: Rows of a piece of a table that is shared out.
PIECE = 25_000


def spread(df: DataFrame) -> DataFrame:
    """Share out a table in pieces of ``PIECE`` rows, and at least one for each core.

    For work that costs far more per row than moving the row. How a table is cut into files and row groups
    says little about how many rows a task gets, and tasks must not grow with the table. Rows go by a hash of all their columns, as
    keys may be null. ``df`` must be a plain scan, which is counted by its footers.
    """
    pieces = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // PIECE))
    return df.repartition(pieces, *df.columns)


def logs(
    spark: SparkSession, sf: str, *, with_k: bool = False, stream: bool = False, shared: bool = False
) -> DataFrame:
    e = table(spark, sf, "events", stream=stream)
    e = spread(e) if shared else e
    k = F.get_json_object("props", "$.k").cast("int")
    t = F.col("event_type")
    e = e.withColumn("k", k)
    k = F.col("k")
    v = F.col("value")
    out = e.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        plus_seconds(F.col("ts"), (k % 5).cast("bigint")).alias("received_at"),
        user_ip(F.col("user_id")).alias("src_ip"),
        F.concat(F.lit("10.0.0."), (F.col("event_id") % 20).cast("string")).alias("dst_ip"),
        F.when(k % 4 == 0, "HTTPS").otherwise("HTTP").alias("protocol"),
        F.when(t == "error", "BLOCKED").when(t == "signup", "RATE_LIMITED")
        .when(t == "purchase", "FLAGGED").otherwise("ALLOWED").alias("action"),
        F.when(t == "error", "PUT").when(t.isin("signup", "purchase"), "POST")
        .otherwise("GET").alias("http_method"),
        F.when(t == "error", 403).when(t == "signup", 429).otherwise(200).alias("http_status"),
        F.when(k < 55, "NONE").otherwise(pick(ATTACKS, k % 15)).alias("attack_type"),
        F.when(v < 10, "INFO").when(v < 30, "LOW").when(v < 80, "MEDIUM")
        .when(v < 150, "HIGH").otherwise("CRITICAL").alias("severity"),
        F.when(k % 10 == 0, pick(PROBE_PATHS, F.floor(k / 10) % 5))
        .otherwise(F.concat(F.lit("/item/"), k.cast("string"))).alias("http_path"),
        pick(AGENTS, k % 7).alias("http_user_agent"),
        pick(COUNTRIES, (F.col("user_id") + k) % 12).alias("geo_country"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"),
                 F.date_format("ts", "yyyyMMdd")).alias("session_id"),
        (v / 500).alias("confidence"),
        F.col("props").alias("raw_log"),
        k.cast("double").alias("sys_cpu"),
        ((k * 7) % 100).cast("double").alias("sys_memory"),
        *([k] if with_k else []),
    )
    return out


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    rows = logs(spark, sf).filter(F.col("attack_type") != "NONE")
    day = floor_to(F.col("timestamp"), 86400)
    g = rows.groupBy("src_ip", "attack_type", day.alias("day")).agg(
        F.min("id").alias("id"),
        F.min("http_path").alias("http_path"),
        F.min("geo_country").alias("geo_country"),
        F.min("session_id").alias("session_id"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.min("received_at").alias("_recv"),
        F.count("*").alias("event_count"),
        F.max(sev.rank(F.col("severity"))).alias("_rank"),
        F.max("confidence").alias("confidence"),
    )
    i = F.col("id")
    g = g.select(
        "id", F.concat(F.lit("al-"), i.cast("string")).alias("alert_uid"),
        F.concat("attack_type", F.lit(" from "), "src_ip").alias("title"),
        F.concat(F.lit("seen at "), "http_path").alias("description"),
        "src_ip", "attack_type", "http_path", "geo_country", "session_id", "first_seen", "last_seen",
        plus_seconds(F.col("_recv"), 3).alias("created_at"), "event_count",
        sev.from_rank(F.col("_rank")).alias("severity"), "confidence",
        pick(["NEW", "ACKNOWLEDGED", "RESOLVED", "IN_PROGRESS"], i % 4).alias("status"),
        pick(["rule", "behavioral.rate", "correlation.ip"], i % 3).alias("detection_source"),
    )
    m = mitre_map(spark).select("attack_type", "mitre_tactic", "mitre_technique")
    return g.join(F.broadcast(m), "attack_type", "left").select(*g.columns, "mitre_tactic", "mitre_technique")


def alert_log_ids(spark: SparkSession, sf: str) -> DataFrame:
    """alert id -> the ids of all its logs, one row each."""
    rows = logs(spark, sf).filter(F.col("attack_type") != "NONE").select(
        "src_ip", "attack_type", floor_to(F.col("timestamp"), 86400).alias("day"), "id")
    keys = ["src_ip", "attack_type", "day"]
    firsts = rows.groupBy(*keys).agg(F.min("id").alias("alert_id"))
    return firsts.join(rows, keys).select("alert_id", F.col("id").alias("log_id"))


def incidents(spark: SparkSession, sf: str) -> DataFrame:
    a = alerts(spark, sf).filter(F.col("severity").isin("HIGH", "CRITICAL"))
    g = a.groupBy("src_ip").agg(
        F.min("id").alias("id"), F.min("created_at").alias("created_at"),
        F.max((F.col("severity") == "CRITICAL").cast("int")).alias("_crit"),
        F.array_sort(F.collect_set("http_path")).alias("affected_paths"),
        F.array_sort(F.collect_set("attack_type")).alias("attack_types"),
        F.array_sort(F.collect_set("mitre_tactic")).alias("mitre_tactics"),
        F.array_sort(F.collect_set("mitre_technique")).alias("mitre_techniques"),
    )
    i = F.col("id")
    return g.select(
        "id", F.concat(F.lit("in-"), i.cast("string")).alias("incident_uid"),
        F.concat(F.lit("Auto-escalated: "), "src_ip").alias("title"),
        F.concat(F.lit("Source IP: "), "src_ip").alias("description"),
        F.lit(None).cast("string").alias("response_summary"),
        plus_seconds(F.col("created_at"), (i % 7).cast("bigint") * 600 - 600).alias("created_at"),
        pick(["NEW", "INVESTIGATING", "MITIGATED", "CLOSED"], i % 4).alias("status"),
        F.when(F.col("_crit") == 1, "CRITICAL").otherwise("HIGH").alias("priority"),
        F.array("src_ip").alias("affected_ips"), "affected_paths", "attack_types",
        "mitre_tactics", "mitre_techniques",
    )


def linked_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts with ``incident_id`` of the incident they were escalated to."""
    a = alerts(spark, sf)
    inc = incidents(spark, sf).select(
        F.col("id").alias("incident_id"), F.element_at("affected_ips", 1).alias("src_ip"))
    return a.join(inc, "src_ip", "left").withColumn(
        "incident_id", F.when(F.col("severity").isin("HIGH", "CRITICAL"), F.col("incident_id")))


def notes(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    inc = incidents(spark, sf).select(
        F.col("id").alias("incident_id"), F.col("created_at").alias("_c"),
        F.element_at("affected_ips", 1).alias("src_ip"))
    n = c.select(user_ip(F.col("conv_id")).alias("src_ip"), "turn", F.col("role").alias("note_type"),
                 F.col("text").alias("content"))
    return n.join(inc, "src_ip").select(
        "incident_id", plus_seconds(F.col("_c"), F.col("turn") * 60).alias("created_at"),
        "note_type", "content")


def security_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = logs(spark, sf, with_k=True)
    k = F.col("k")
    pct = F.lpad(k.cast("string"), 2, "0")
    conf = F.lpad(((k * 3) % 100).cast("string"), 2, "0")
    model = F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(
        F.lit(',"model":{"model_confidence":0.'), conf,
        F.when(k % 2 == 0, F.lit(',"suggested_severity":"high"}'))
        .otherwise(F.lit(',"predicted_label":"MEDIUM"}'))))
    ai = F.when(k % 10 == 9, F.lit("")).otherwise(F.concat(
        F.lit(',"ai":{"ai_score":0.'), pct, F.lit(',"ai_confidence":0.'), conf,
        F.lit(',"flagged":'), F.when(k >= 85, F.lit("true")).otherwise(F.lit("false")),
        model, F.lit("}")))
    details = F.concat(
        F.lit('{"method":"'), F.col("http_method"), F.lit('","ddos_score":'),
        (k % 10).cast("string"), F.lit(',"detected_patterns":["p'), (k % 4).cast("string"),
        F.lit('"]'), ai, F.lit("}"))
    return rows.select(
        F.concat(F.lit("EV"), F.col("id").cast("string")).alias("event_id"),
        "timestamp",
        F.when(F.col("attack_type") == "NONE", "none").otherwise(pick(THREATS, k % 15)).alias("threat_type"),
        F.lower("severity").alias("threat_level"),
        F.col("src_ip").alias("ip"), F.col("http_path").alias("url"),
        F.col("http_user_agent").alias("user_agent"),
        F.when(F.col("action").isin("BLOCKED", "RATE_LIMITED"), "block").otherwise("allow").alias("action"),
        F.col("action").isin("BLOCKED", "RATE_LIMITED").cast("int").alias("blocked"),
        details.alias("details"),
    )


def requests(spark: SparkSession, sf: str, *, stream: bool = False, shared: bool = False) -> DataFrame:
    rows = logs(spark, sf, with_k=True, stream=stream, shared=shared)
    k, i = F.col("k"), F.col("id")
    payload = F.when(k % 2 == 0, pick(ENCODED, i % 16)).otherwise(pick(ENCODED_TWICE, i % 16))
    headers = F.map_filter(F.create_map(
        F.lit("accept"), F.when(k % 2 == 0, F.lit("*/*")),
        F.lit("accept-language"), F.when(k % 3 == 0, F.lit("en")),
        F.lit("accept-encoding"), F.when(k % 5 == 0, F.lit("gzip")),
        F.lit("connection"), F.when(k % 2 == 1, F.lit("keep-alive")),
        F.lit("content-length"), F.when(k % 4 == 0, F.lit("0")).otherwise(F.lit("10")),
    ), lambda _, v: v.isNotNull())
    return rows.select(
        "id", "timestamp", F.col("src_ip").alias("client_ip"), F.col("http_method").alias("method"),
        F.concat("http_path", F.lit("?q="), payload).alias("url"),
        F.when(i % 5 == 0, F.lit("user=a&pw=b")).alias("body"),
        F.col("http_user_agent").alias("user_agent"), headers.alias("headers"),
        "http_status", "severity", "k",
        F.when(k % 4 == 1, F.concat(F.lit("unknown, 198.51.100."), k.cast("string")))
        .when(k % 4 == 2, F.lit("bad, 10.1.2.3 , 1.1.1.1"))
        .when(k % 4 == 3, F.lit("")).alias("x_forwarded_for"),
        F.when(k % 3 == 0, F.concat(F.lit("192.0.2."), k.cast("string"))).alias("x_real_ip"),
        (F.col("confidence") * 100).alias("response_ms"),
    )


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = logs(spark, sf, with_k=True).filter(
        (F.col("action") == "BLOCKED") & (F.col("severity") == "CRITICAL"))
    t, k = F.col("timestamp"), F.col("k")
    return rows.select(
        F.col("id").alias("block_id"), F.col("src_ip").alias("ip"), t.alias("created_at"),
        F.when(k % 6 == 1, plus_seconds(t, 72 * 3600)).when(k % 6 != 0, plus_seconds(t, 86400)).alias("expires_at"),
        F.when(k % 5 == 0, plus_seconds(t, 6 * 3600)).when(k % 5 == 1, plus_seconds(t, 80 * 3600)).alias("revoked_at"),
        F.concat(F.lit("Auto: "), F.col("attack_type")).alias("reason"),
        F.when(k % 2 == 0, "auto").otherwise("manual").alias("reason_type"),
        pick(["IP_BLOCK", "TEMP_BAN", "RATE_LIMIT"], k % 3).alias("action"),
    )


def geo_ranges(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    start = F.lit(3405774848).cast("bigint") + F.col("n_nationkey").cast("bigint") * 64
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(
        start.alias("start"), (start + 63).alias("end"), F.col("n_name").alias("country"),
        F.col("r_name").alias("city"), F.col("n_nationkey").cast("double").alias("latitude"),
        (F.lit(0.0) - F.col("n_nationkey").cast("double")).alias("longitude"),
        F.concat(F.lit("AS"), F.col("n_nationkey").cast("string")).alias("asn"))


def bench_requests(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    q = F.col("l_quantity")
    return li.select(
        F.col("l_returnflag").alias("profile"), F.col("l_linenumber").alias("trial"),
        F.when(F.col("l_linestatus") == "O", "benign").otherwise("sqli").alias("label"),
        F.when(q == 1, 0).when(q > 25, 403).otherwise(200).alias("status"),
        (F.lit(1000.0) * F.col("l_tax") + q).alias("latency_ms"),
        F.when(q % 2 == 0, q / 10).alias("server_processing_ms"))


def alert_changes(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_custkey").alias("entity_id"), F.col("o_orderdate").alias("changed_at"),
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderstatus") == "O", "NEW").when(F.col("o_orderstatus") == "P", "IN_PROGRESS")
        .otherwise("RESOLVED").alias("status"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 11).alias("assigned_to"),
        F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey") % 50).alias("incident_id"))


def incident_changes(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_custkey").alias("entity_id"), F.col("o_orderdate").alias("changed_at"),
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderstatus") == "O", "INVESTIGATING")
        .when(F.col("o_orderstatus") == "P", "MITIGATED").otherwise("CLOSED").alias("status"),
        F.when(F.col("o_orderkey") % 3 == 0, F.substring("o_orderpriority", 3, 20)).alias("priority"),
        F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey") % 11).alias("assigned_to"))
