"""Canonical table layouts and the fixed vocabularies of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Enumerations of the log and alert tables.
PROTOCOLS = ["HTTP", "HTTPS", "TCP", "UDP", "DNS", "ICMP", "OTHER"]
ACTIONS = ["ALLOWED", "BLOCKED", "RATE_LIMITED", "DROPPED", "FLAGGED"]
SEVERITIES = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
ATTACK_TYPES = [
    "NONE", "SQLI", "XSS", "RCE", "LFI", "RFI", "BRUTE_FORCE", "PORT_SCAN", "DDOS",
    "DIRECTORY_TRAVERSAL", "COMMAND_INJECTION", "SSRF", "XXE", "CSRF", "BOT", "OTHER",
]
ALERT_STATUSES = ["NEW", "ACKNOWLEDGED", "IN_PROGRESS", "ESCALATED", "RESOLVED", "FALSE_POSITIVE"]
ACTIVE_ALERT_STATUSES = ["NEW", "ACKNOWLEDGED"]
OPEN_INCIDENT_STATUSES = ["NEW", "INVESTIGATING"]

_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
_NTZ = T.TimestampNTZType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


LOGS = _struct(
    ("id", _L), ("timestamp", _NTZ), ("received_at", _NTZ),
    ("src_ip", _S), ("src_port", _I), ("dst_ip", _S), ("dst_port", _I),
    ("protocol", _S), ("action", _S),
    ("http_method", _S), ("http_path", _S), ("http_status", _I), ("http_user_agent", _S),
    ("http_host", _S), ("http_referer", _S),
    ("attack_type", _S), ("attack_signature", _S), ("severity", _S), ("confidence", _D),
    ("matched_rule", _S), ("payload_snippet", _S),
    ("geo_country", _S), ("geo_city", _S), ("geo_lat", _D), ("geo_lon", _D), ("geo_asn", _S),
    ("session_id", _S), ("mitre_tactic", _S), ("mitre_technique", _S),
    ("raw_log", _S), ("source_format", _S), ("ingestion_pipeline", _S), ("tier", _S),
    ("dns_query", _S), ("dns_response", _S),
    ("sys_cpu", _D), ("sys_memory", _D), ("sys_latency_ms", _D),
)

# One row per detector finding, whatever the detector.
HITS = _struct(
    ("source", _S), ("rule_id", _S), ("title", _S), ("severity", _S), ("seen_at", _NTZ),
    ("src_ip", _S), ("attack_type", _S), ("http_path", _S), ("session_id", _S),
    ("geo_country", _S), ("event_count", _L), ("log_ids", T.ArrayType(_L)),
    ("confidence", _D), ("mitre_tactic", _S), ("mitre_technique", _S),
)

BENCH_REQUESTS = _struct(
    ("label", _S), ("status", _I), ("latency_ms", _D), ("server_processing_ms", _D),
    ("error_kind", _S),
)

PLAYBOOK = T.StructType([
    T.StructField("id", _S), T.StructField("name", _S), T.StructField("active", _B),
    T.StructField("cooldown_seconds", _I),
    T.StructField("trigger", _struct(
        ("severity", T.ArrayType(_S)), ("attack_type", T.ArrayType(_S)),
        ("event_count_gte", _L), ("detection_source", T.ArrayType(_S)),
    )),
    T.StructField("actions", T.ArrayType(_struct(
        ("action", _S), ("duration_seconds", _L), ("rate_limit_rps", _I),
        ("channel", _S), ("message", _S),
    ))),
])
