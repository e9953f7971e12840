"""Filters, free-text search and paging."""

from __future__ import annotations

import shlex

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions.text import any_contains_ci, contains_ci
from duskwatch.operators.dashboards import time_window_filter
from duskwatch.schema import (
    ACTIONS, ALERT_STATUSES, ATTACK_TYPES, PROTOCOLS, SEVERITIES,
)

# Short names accepted in a hunt string, by log field.
HUNT_ALIASES = {
    "src_ip": ["src", "source", "srcip"],
    "dst_ip": ["dst", "dest", "destination", "dstip"],
    "http_method": ["method"],
    "http_path": ["path", "uri"],
    "country": ["country"],
    "http_status": ["status", "code", "response"],
    "attack_type": ["attack"],
    "severity": ["severity"],
    "action": ["action"],
    "user_agent": ["ua", "agent", "useragent"],
    "mitre_technique": ["mitre"],
    "protocol": ["protocol", "proto"],
    "search": ["text", "search"],
}
_FIELD_OF = {alias: field for field, names in HUNT_ALIASES.items() for alias in names}

LOG_TEXT = ["src_ip", "dst_ip", "http_path", "http_user_agent", "payload_snippet",
            "matched_rule", "mitre_technique", "raw_log"]
ALERT_TEXT = ["alert_uid", "title", "description", "http_path", "src_ip", "attack_type",
              "mitre_technique"]


def _all(conditions: list[Column]) -> Column:
    expr = F.lit(True)
    for c in conditions:
        expr = expr & c
    return expr


def _text_match(df: DataFrame, columns: list[str], needle: str) -> Column:
    return any_contains_ci([F.col(c) for c in columns if c in df.columns], needle)


def page(df: DataFrame, *order: Column, limit: int, offset: int = 0) -> DataFrame:
    out = df.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(limit)


def log_search(
    logs: DataFrame, *, start: str | None = None, end: str | None = None,
    http_path: str | None = None, limit: int = 100, offset: int = 0, **equals: str,
) -> DataFrame:
    """Newest matching logs. ``equals`` are column = value filters, all must hold."""
    rows = time_window_filter(logs, "timestamp", start=start, end=end)
    conditions = [F.col(k) == v for k, v in equals.items() if v is not None]
    if http_path:
        conditions.append(contains_ci(F.col("http_path"), http_path))
    return page(rows.filter(_all(conditions)), F.desc("timestamp"), F.desc("id"),
                limit=limit, offset=offset)


def parse_hunt(text: str) -> dict[str, str]:
    """``src:1.2 attack:SQLI "free words"`` -> filters; free words go to ``search``."""
    try:
        words = shlex.split(text)
    except ValueError:
        words = text.split()
    filters: dict[str, str] = {}
    searched: list[str] = []
    free: list[str] = []
    for word in words:
        name, colon, value = word.partition(":")
        field = _FIELD_OF.get(name.lower())
        value = value.strip()
        if not (colon and field and value):
            free.append(word)
        elif field == "search":
            searched.append(value)
        else:
            filters[field] = value
    if searched:
        filters["search"] = " ".join(searched)
    if free:
        filters["free"] = " ".join(free)
    return filters


def hunt_predicate(logs: DataFrame, text: str = "", **explicit: str) -> Column:
    """One predicate for a hunt string; explicit arguments win over the string."""
    hunt = parse_hunt(text)
    free = hunt.pop("free", "")
    f = {**hunt, **{k: v for k, v in explicit.items() if v}}
    conditions: list[Column] = []
    enums = {"action": ACTIONS, "attack_type": ATTACK_TYPES, "severity": SEVERITIES, "protocol": PROTOCOLS}
    for field, allowed in enums.items():
        value = f.get(field, "")
        value = value.upper() if field == "protocol" else value
        if value in allowed:
            conditions.append(F.col(field) == value)
    for field, column in (("src_ip", "src_ip"), ("dst_ip", "dst_ip"), ("http_path", "http_path"),
                          ("user_agent", "http_user_agent"), ("mitre_technique", "mitre_technique")):
        if f.get(field):
            conditions.append(contains_ci(F.col(column), f[field]))
    if f.get("http_method"):
        conditions.append(F.col("http_method") == f["http_method"].upper())
    if f.get("country"):
        conditions.append(F.col("geo_country") == f["country"].upper())
    if f.get("http_status", "").isdigit():
        conditions.append(F.col("http_status") == int(f["http_status"]))
    needle = " ".join(x for x in (f.get("search", ""), free) if x)
    if needle:
        conditions.append(_text_match(logs, LOG_TEXT, needle))
    return _all(conditions)


def hunt_search(
    logs: DataFrame, text: str = "", *, start: str | None = None, end: str | None = None,
    limit: int = 200, **explicit: str,
) -> DataFrame:
    rows = time_window_filter(logs, "timestamp", start=start, end=end)
    rows = rows.filter(hunt_predicate(logs, text, **explicit))
    return page(rows, F.desc("timestamp"), F.desc("id"), limit=limit)


def alert_search(
    alerts: DataFrame, *, start: str | None = None, end: str | None = None,
    severity: str | None = None, status: str | None = None, src_ip: str | None = None,
    attack_type: str | None = None, detection_source: str | None = None,
    mitre_technique: str | None = None, incident_id: int | None = None,
    search: str | None = None, limit: int = 100,
) -> DataFrame:
    rows = time_window_filter(alerts, "created_at", start=start, end=end)
    conditions: list[Column] = []
    if severity in SEVERITIES:
        conditions.append(F.col("severity") == severity)
    if status in ALERT_STATUSES:
        conditions.append(F.col("status") == status)
    for column, needle in (("src_ip", src_ip), ("detection_source", detection_source),
                           ("mitre_technique", mitre_technique)):
        if needle:
            conditions.append(contains_ci(F.col(column), needle))
    if attack_type:
        conditions.append(F.col("attack_type") == attack_type)
    if incident_id is not None:
        conditions.append(F.col("incident_id") == incident_id)
    if search:
        conditions.append(_text_match(alerts, ALERT_TEXT, search))
    return page(rows.filter(_all(conditions)), F.desc("created_at"), F.desc("id"), limit=limit)


def _any_contains(column: str, needle: str) -> Column:
    return F.exists(column, lambda x: contains_ci(x, needle))


def incident_search(
    incidents: DataFrame, *, start: str | None = None, end: str | None = None,
    status: str | None = None, priority: str | None = None, affected_ip: str | None = None,
    attack_type: str | None = None, mitre_technique: str | None = None,
    search: str | None = None, limit: int = 100,
) -> DataFrame:
    """Incidents by state, list membership and free text, newest first.

    Membership is exact: ``1.2.3.4`` does not find ``11.2.3.45``.
    """
    rows = time_window_filter(incidents, "created_at", start=start, end=end)
    conditions: list[Column] = []
    if status:
        conditions.append(F.col("status") == status)
    if priority:
        conditions.append(F.col("priority") == priority)
    for column, value in (("affected_ips", affected_ip), ("attack_types", attack_type),
                          ("mitre_techniques", mitre_technique)):
        if value:
            conditions.append(F.array_contains(column, value))
    if search:
        flat = ["incident_uid", "title", "description", "response_summary"]
        lists = ["affected_ips", "attack_types", "mitre_techniques"]
        hit = _text_match(incidents, flat, search)
        for c in lists:
            hit = hit | _any_contains(c, search)
        conditions.append(hit)
    return page(rows.filter(_all(conditions)), F.desc("created_at"), F.desc("id"), limit=limit)


def _page_with_total(rows: DataFrame, limit: int, offset: int) -> DataFrame:
    total = rows.agg(F.count("*").alias("total")).withColumn("_k", F.lit(1))
    part = page(rows, F.desc("timestamp"), F.desc("event_id"), limit=limit, offset=offset)
    return part.withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k").drop("_k")


def event_log_page(
    events: DataFrame, *, threat_type: str | None = None, blocked_only: bool = False,
    limit: int = 100, offset: int = 0,
) -> DataFrame:
    """One page of events, each row with the total number of matches."""
    rows = events
    if threat_type:
        rows = rows.filter(F.col("threat_type") == threat_type)
    if blocked_only:
        rows = rows.filter("blocked = 1")
    return _page_with_total(rows, limit, offset)


def flagged_events(
    events: DataFrame, *, pending_only: bool = False, limit: int = 100, offset: int = 0
) -> DataFrame:
    """Events flagged by the scorer; ``pending_only`` keeps those not blocked yet."""
    rows = events.filter(F.get_json_object("details", "$.ai.flagged").isin("true", "1"))
    if pending_only:
        rows = rows.filter("blocked = 0")
    return _page_with_total(rows, limit, offset)


_MODEL = ("model_confidence double, model_score double, suggested_severity string, "
          "predicted_label string")


def model_suggestions(
    events: DataFrame, *, min_confidence: float = 0.0, limit: int = 100, offset: int = 0
) -> DataFrame:
    """Events with a model prediction, filtered by confidence before paging."""
    m = F.from_json(F.get_json_object("details", "$.ai.model"), _MODEL)
    rows = events.withColumn("_m", m).filter(F.col("_m").isNotNull())

    def truthy(c: Column) -> Column:
        return F.when(c != 0, c)

    conf = F.coalesce(truthy(F.col("_m.model_confidence")), F.col("_m.model_score"))
    rows = rows.select(
        "event_id", "timestamp", "ip", "url", conf.alias("model_confidence"),
        F.coalesce("_m.suggested_severity", "_m.predicted_label").alias("predicted"))
    if min_confidence:
        rows = rows.filter(F.col("model_confidence") >= min_confidence)
    return page(rows, F.desc("timestamp"), F.desc("event_id"), limit=limit, offset=offset)
