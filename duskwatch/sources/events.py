"""Firewall events and access records as inputs of the log pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.functions import net
from duskwatch.functions import severity as sev
from duskwatch.schema import BENCH_REQUESTS, SEVERITIES

# Firewall threat type -> attack type of a log; anything else is OTHER.
ATTACK_OF_THREAT = {
    "sql_injection": "SQLI", "xss_attempt": "XSS", "path_traversal": "DIRECTORY_TRAVERSAL",
    "command_injection": "COMMAND_INJECTION", "ddos_attack": "DDOS", "rate_limit_exceeded": "OTHER",
    "blocked_ip": "OTHER", "bot_detected": "BOT", "ldap_injection": "OTHER", "xml_injection": "XXE",
    "ssrf_attempt": "SSRF", "template_injection": "OTHER", "rce_attempt": "RCE",
    "html_injection": "OTHER", "auth_bypass_attempt": "OTHER", "none": "NONE",
}


def _detail(path: str) -> Column:
    return F.get_json_object("details", path)


def firewall_events_to_logs(events: DataFrame) -> DataFrame:
    """Blocked or threatening firewall events as log rows."""
    threat = F.lower(F.coalesce("threat_type", F.lit("none")))
    table = F.create_map(*[F.lit(x) for pair in ATTACK_OF_THREAT.items() for x in pair])
    level = F.upper(F.coalesce("threat_level", F.lit("")))
    return events.filter((F.col("blocked") == 1) | (threat != "none")).select(
        F.col("timestamp"), F.coalesce("ip", F.lit("unknown")).alias("src_ip"),
        F.lit("HTTP").alias("protocol"),
        F.when(F.col("blocked") == 1, "BLOCKED").otherwise("ALLOWED").alias("action"),
        F.coalesce(_detail("$.method"), F.lit("GET")).alias("http_method"),
        F.coalesce("url", F.lit("/")).alias("http_path"),
        F.coalesce("user_agent", F.lit("")).alias("http_user_agent"),
        F.coalesce(F.try_element_at(table, threat), F.lit("OTHER")).alias("attack_type"),
        F.when(level.isin("LOW", "MEDIUM", "HIGH", "CRITICAL"), level).otherwise("MEDIUM").alias("severity"),
        F.substring(F.coalesce(_detail("$.detected_patterns"), F.lit("")), 1, 500).alias("payload_snippet"),
        F.col("event_id").alias("session_id"), F.substring("details", 1, 2000).alias("raw_log"))


def effective_client_ip(
    requests: DataFrame, *, trusted: list[str], peer: str = "client_ip",
    forwarded: str = "x_forwarded_for", real: str = "x_real_ip",
) -> DataFrame:
    """Add ``effective_ip``: forwarding headers count only if the peer is a trusted proxy.

    Then the first valid address of the forwarded list is the client, else the
    real-IP header, else the peer.
    """
    hops = F.transform(F.split(F.coalesce(forwarded, F.lit("")), ","), lambda hop: F.trim(hop))
    first = F.get(F.filter(hops, net.is_ip), F.lit(0))
    single = F.trim(F.col(real))
    header = F.coalesce(first, F.when(net.is_ip(single), single))
    peer_col = F.coalesce(peer, F.lit("unknown"))
    via_proxy = net.in_any_cidr(peer_col, trusted)
    return requests.withColumn(
        "effective_ip", F.when(via_proxy, F.coalesce(header, peer_col)).otherwise(peer_col))


def severity_label(level: Column, threat: Column, blocked: Column) -> Column:
    """Training label: the level, raised for events that were blocked for a threat."""
    threat = F.coalesce(threat, F.lit("none"))
    is_threat = (threat != "none") & (threat != "")
    known = F.upper(F.trim(level))
    base = (F.when(known.isin(SEVERITIES), known).when(blocked & is_threat, "HIGH")
            .when(is_threat, "MEDIUM").otherwise("INFO"))
    floor = (F.when(blocked & (threat == "rate_limit_exceeded"), sev.rank(F.lit("MEDIUM")))
             .when(blocked & is_threat, sev.rank(F.lit("HIGH"))).otherwise(0))
    return sev.from_rank(F.greatest(sev.rank(base), floor))


def training_export(events: DataFrame) -> DataFrame:
    """Scored events as a flat training table."""
    blocked = F.coalesce(F.col("blocked") == 1, F.lit(False))
    guess = F.when(F.contains(F.lower("threat_type"), F.lit("ddos")), 5.0).otherwise(0.0)
    return events.filter(_detail("$.ai.ai_score").isNotNull()).select(
        "timestamp", F.col("ip").alias("source_ip"), F.col("url").alias("target_url"), "user_agent",
        "threat_type", "threat_level", F.coalesce(_detail("$.method"), F.lit("GET")).alias("method"),
        "action", blocked.cast("int").alias("blocked"),
        F.coalesce(_detail("$.ddos_score").cast("double"), guess).alias("ddos_score"),
        F.length("url").alias("payload_length"),
        F.coalesce(_detail("$.ai.ai_score").cast("double"), F.lit(0.0)).alias("ai_score"),
        F.coalesce(_detail("$.ai.ai_confidence").cast("double"), F.lit(0.0)).alias("ai_confidence"),
        F.concat_ws(" ", "url", "user_agent").alias("text"),
        severity_label(F.col("threat_level"), F.col("threat_type"), blocked).alias("label"))


def benchmark_load(spark: SparkSession, path: str) -> DataFrame:
    """Request logs of benchmark trials; profile and trial come from the file path.

    Files lie under ``profile_<name>/trial_<n>...`` or ``profile=<name>/trial=<n>/``.
    """
    rows = (
        spark.read.schema(BENCH_REQUESTS).option("header", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.csv").csv(path)
    )
    file = F.col("_metadata.file_path")
    where = r"profile[_=]([^/]+?)/trial[_=](\d+)"
    return rows.select(
        F.regexp_extract(file, where, 1).alias("profile"),
        F.regexp_extract(file, where, 2).try_cast("int").alias("trial"), *[f.name for f in BENCH_REQUESTS])
