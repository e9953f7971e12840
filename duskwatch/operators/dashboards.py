"""Dashboard tables: counters, top lists, distributions, timelines."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions.net import is_private
from duskwatch.functions.times import at, ends_at
from duskwatch.schema import ACTIVE_ALERT_STATUSES, OPEN_INCIDENT_STATUSES


def time_window_filter(
    df: DataFrame, column: str, *, start: str | dt.datetime | None = None,
    end: str | dt.datetime | None = None, now: str | dt.datetime | None = None,
    last_hours: float | None = None,
) -> DataFrame:
    """Rows within inclusive bounds; swapped bounds are put right.

    Without bounds, ``last_hours`` before ``now`` applies if given. The bounds
    are literals, so they reach the scan as pushed filters and prune files.
    """
    lo, hi = (None if v is None else dt.datetime.fromisoformat(str(v)) for v in (start, end))
    if lo and hi and lo > hi:
        lo, hi = hi, lo
    if lo is None and hi is None and last_hours is not None:
        hi = dt.datetime.fromisoformat(str(now))
        lo = hi - dt.timedelta(hours=last_hours)
    if lo is not None:
        df = df.filter(F.col(column) >= at(lo))
    if hi is not None:
        df = df.filter(F.col(column) <= at(hi))
    return df


def top(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def is_attack() -> Column:
    return F.col("attack_type") != "NONE"


def soc_kpis(
    logs: DataFrame, alerts: DataFrame, incidents: DataFrame, responses: DataFrame, *,
    start: str, end: str, now: str,
) -> DataFrame:
    """Headline counters of the SOC dashboard as one row."""
    w_logs = time_window_filter(logs, "timestamp", start=start, end=end).agg(
        F.count("*").alias("total_logs"),
        F.count_if(F.col("action") == "BLOCKED").alias("total_blocked"),
        F.count_if(is_attack()).alias("total_attacks"))
    in_window = (F.col("created_at") >= at(start)) & (F.col("created_at") <= at(end))
    w_alerts = alerts.agg(
        F.count_if(in_window).alias("total_alerts"),
        F.count_if(F.col("status").isin(ACTIVE_ALERT_STATUSES)).alias("active_alerts"))
    w_inc = incidents.agg(F.count_if(F.col("status").isin(OPEN_INCIDENT_STATUSES)).alias("open_incidents"))
    running = (F.col("created_at") <= at(now)) & (ends_at(F.col("expires_at"), F.col("revoked_at")) > at(now))
    w_resp = responses.agg(F.count_if(running).alias("active_blocks"))
    out = w_logs.withColumn("_k", F.lit(1))
    for other in (w_alerts, w_inc, w_resp):
        out = out.join(other.withColumn("_k", F.lit(1)), "_k")
    return out.drop("_k")


def top_attackers(logs: DataFrame, *, n: int = 10) -> DataFrame:
    """Addresses with most attacks and the country they came from."""
    counts = logs.filter(is_attack()).groupBy("src_ip", "geo_country").agg(F.count("*").alias("attacks"))
    counts = counts.select("src_ip", F.coalesce("geo_country", F.lit("??")).alias("geo_country"), "attacks")
    return top(counts, n, F.desc("attacks"), F.asc("src_ip"), F.asc("geo_country"))


def attack_distribution(logs: DataFrame) -> DataFrame:
    return logs.filter(is_attack()).groupBy("attack_type").agg(F.count("*").alias("events"))


def severity_distribution(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("severity").agg(F.count("*").alias("alerts"))


def geo_distribution(logs: DataFrame, *, n: int = 20) -> DataFrame:
    counts = (
        logs.filter(is_attack() & F.col("geo_country").isNotNull())
        .groupBy("geo_country", "geo_lat", "geo_lon").agg(F.count("*").alias("attacks"))
    )
    return top(counts, n, F.desc("attacks"), F.asc("geo_country"), F.asc("geo_lat"), F.asc("geo_lon"))


def recent_alerts(alerts: DataFrame, *, n: int = 20) -> DataFrame:
    return top(alerts, n, F.desc("created_at"), F.desc("id")).select(
        "id", "created_at", "severity", "status", "src_ip", "attack_type", "title")


def recent_threats(events: DataFrame, *, n: int = 30) -> DataFrame:
    return top(events.filter("blocked = 1"), n, F.desc("timestamp"), F.desc("event_id")).select(
        "event_id", "timestamp", "threat_type", "threat_level", "ip", "url", "user_agent", "action")


def threat_counts(events: DataFrame) -> DataFrame:
    return events.filter("blocked = 1").groupBy("threat_type", "threat_level").agg(
        F.count("*").alias("events"))


def hours(spark) -> DataFrame:
    return spark.range(24).select(F.col("id").cast("int").alias("hour"))


def threat_timeline(events: DataFrame, *, threat_types: list[str], start: str, end: str) -> DataFrame:
    """Blocked threats per hour of day, one column per type, all 24 hours."""
    rows = time_window_filter(events.filter("blocked = 1"), "timestamp", start=start, end=end)
    counts = rows.groupBy(F.hour("timestamp").alias("hour")).agg(*[
        F.count_if(F.col("threat_type") == t).alias(t) for t in threat_types])
    return hours(events.sparkSession).join(counts, "hour", "left").select(
        "hour", *[F.coalesce(t, F.lit(0)).alias(t) for t in threat_types])


def traffic_by_hour(events: DataFrame, *, now: str, last_hours: float = 24) -> DataFrame:
    rows = time_window_filter(events, "timestamp", now=now, last_hours=last_hours)
    return rows.groupBy(F.hour("timestamp").alias("hour")).agg(
        F.count("*").alias("total_requests"), F.count_if(F.col("blocked") == 1).alias("blocked_requests"))


def attack_heatmap(events: DataFrame) -> DataFrame:
    """Blocked events by weekday (Sunday = 0) and hour, all 168 cells."""
    counts = events.filter("blocked = 1").groupBy(
        (F.dayofweek("timestamp") - 1).alias("weekday"), F.hour("timestamp").alias("hour"),
    ).agg(F.count("*").alias("events"))
    grid = events.sparkSession.range(168).select(
        F.floor(F.col("id") / 24).cast("int").alias("weekday"), (F.col("id") % 24).cast("int").alias("hour"))
    return grid.join(counts, ["weekday", "hour"], "left").select(
        "weekday", "hour", F.coalesce("events", F.lit(0)).alias("events"))


def top_ips_with_types(events: DataFrame, *, n: int = 10) -> DataFrame:
    """Most blocked addresses with the distinct threat types seen from each."""
    rows = events.filter("blocked = 1 and ip is not null")
    per_type = rows.groupBy("ip", "threat_type").agg(F.count("*").alias("_n"))
    per_ip = per_type.groupBy("ip").agg(
        F.sum("_n").alias("attack_count"), F.array_sort(F.collect_set("threat_type")).alias("types"))
    return top(per_ip, n, F.desc("attack_count"), F.asc("ip"))


def threat_level(events: DataFrame) -> DataFrame:
    """Overall threat level from the blocked events."""
    level = F.upper("threat_level")
    t = events.filter("blocked = 1").agg(
        F.count_if(level == "CRITICAL").alias("critical"), F.count_if(level == "HIGH").alias("high"),
        F.count("*").alias("total_blocked"))
    c, h, n = F.col("critical"), F.col("high"), F.col("total_blocked")
    return t.withColumn("overall_threat_level", F.when((c > 5) | (n > 50), "CRITICAL")
                        .when((c > 0) | (h > 5) | (n > 20), "HIGH")
                        .when((h > 0) | (n > 5), "MEDIUM").otherwise("LOW"))


def active_connections(
    events: DataFrame, *, now: str, last_minutes: float = 5, n: int = 20, by: str = "last_seen"
) -> DataFrame:
    rows = time_window_filter(events.filter("ip is not null"), "timestamp", now=now,
                              last_hours=last_minutes / 60)
    per_ip = rows.groupBy("ip").agg(
        F.max("timestamp").alias("last_seen"), F.count("*").alias("request_count"),
        F.count_if(F.col("blocked") == 1).alias("blocked_count"))
    per_ip = per_ip.withColumn("status", F.when(F.col("blocked_count") > 0, "blocked").otherwise("active"))
    return top(per_ip, n, F.desc(by), F.asc("ip"))


def ip_activity(events: DataFrame, *, recent: int = 200, n: int = 50) -> DataFrame:
    """Per address: requests, first seen, methods and URLs, and its outcome in the newest events."""
    method = F.get_json_object("details", "$.method")
    per_ip = events.groupBy("ip").agg(
        F.count("*").alias("requests"), F.min("timestamp").alias("first_seen"),
        F.array_sort(F.collect_set(method)).alias("methods"))
    urls = events.groupBy("ip").agg(F.count_distinct("url").alias("unique_urls"))
    tail = top(events.select("ip", "blocked", "timestamp", "event_id"), recent,
               F.desc("timestamp"), F.desc("event_id")).groupBy("ip").agg(
        F.count_if(F.col("blocked") == 1).alias("blocked"),
        F.count_if(F.col("blocked") == 0).alias("allowed"))
    ranked = top(per_ip.join(tail, "ip", "left"), n, F.desc("requests"), F.asc("ip"))
    return ranked.join(urls, "ip").select(
        "ip", "requests", "first_seen", "methods", "unique_urls",
        F.coalesce("blocked", F.lit(0)).alias("blocked"), F.coalesce("allowed", F.lit(0)).alias("allowed"))


def live_activity(feeds: list[DataFrame], *, n: int = 50) -> DataFrame:
    """Newest rows of several feeds; a (time, address, page) keeps its first feed's row.

    Feed columns: timestamp, ip, page, action, user_agent, status.
    """
    both = None
    for i, feed in enumerate(feeds):
        part = feed.select("timestamp", "ip", "page", "action", "user_agent", "status",
                           F.lit(i).alias("_p"))
        both = part if both is None else both.unionByName(part)
    best = both.groupBy("timestamp", "ip", "page").agg(
        F.min(F.struct("_p", "action", "user_agent", "status")).alias("_b"))
    rows = best.select("timestamp", "ip", "page", "_b.action", "_b.user_agent", "_b.status")
    total = rows.agg(F.count("*").alias("total")).withColumn("_k", F.lit(1))
    newest = top(rows, n, F.desc("timestamp"), F.asc("ip"), F.asc("page"))
    return newest.withColumn("_k", F.lit(1)).join(F.broadcast(total), "_k").drop("_k")


def geolocated_users(events: DataFrame, locations: DataFrame) -> DataFrame:
    """Visitors by address with their location; ``located`` tells the two groups apart.

    ``locations``: ip, country, latitude, longitude (one row per address).
    """
    per_ip = events.groupBy("ip").agg(
        F.min("timestamp").alias("first_seen"), F.count("*").alias("request_count"),
        F.min_by("user_agent", F.struct("timestamp", "event_id")).alias("user_agent"))
    return per_ip.join(locations, "ip", "left").withColumn("located", F.col("country").isNotNull())


def located_totals(users: DataFrame) -> DataFrame:
    return users.agg(F.count("*").alias("total"), F.count_if(F.col("located")).alias("geolocated"))


def traffic_graph(logs: DataFrame) -> DataFrame:
    """Edges server -> client with request counts; group 1 is private, 2 public."""
    edges = (
        logs.filter(F.col("src_ip").isNotNull() & ~F.col("src_ip").rlike(r"^127\.|^::1$"))
        .groupBy("dst_ip", "src_ip").agg(F.count("*").alias("requests"),
                                         F.count_if(F.col("action") == "BLOCKED").alias("blocked"))
    )
    return edges.select(
        F.col("dst_ip").alias("source"), F.col("src_ip").alias("target"), "requests", "blocked",
        F.when(is_private(F.col("src_ip")), 1).otherwise(2).alias("target_group"))


def graph_nodes(edges: DataFrame) -> DataFrame:
    """Distinct nodes of ``traffic_graph`` edges; the server side is group 0."""
    servers = edges.select(F.col("source").alias("node"), F.lit(0).alias("node_group"), "requests")
    clients = edges.select(F.col("target").alias("node"), F.col("target_group").alias("node_group"), "requests")
    return servers.unionByName(clients).groupBy("node").agg(
        F.min("node_group").alias("node_group"), F.sum("requests").alias("requests"))


def _score() -> Column:
    return F.get_json_object("details", "$.ai.ai_score").cast("double")


def score_stats(events: DataFrame) -> DataFrame:
    """How the scored events spread: high risk, flagged, mean and three bands."""
    rows = events.select(
        _score().alias("s"), F.get_json_object("details", "$.ai").alias("ai"),
        F.get_json_object("details", "$.ai.flagged").alias("f"))
    s, scored = F.col("s"), F.col("ai").isNotNull()
    return rows.agg(
        F.count_if(scored).alias("total_scored"), F.count_if(s > 0.7).alias("high_risk"),
        F.count_if(F.col("f").isin("true", "1")).alias("flagged_count"),
        F.round(F.coalesce(F.avg(F.when(scored, s)), F.lit(0.0)), 6).alias("avg_score"),
        F.count_if(scored & (s <= 0.3)).alias("low"),
        F.count_if(scored & (s > 0.3) & (s <= 0.7)).alias("medium"),
        F.count_if(scored & (s > 0.7)).alias("high"))


def score_timeline(events: DataFrame, *, now: str, last_hours: float = 24) -> DataFrame:
    rows = time_window_filter(events, "timestamp", now=now, last_hours=last_hours)
    return (
        rows.withColumn("_s", _score()).filter(F.get_json_object("details", "$.ai").isNotNull())
        .groupBy(F.hour("timestamp").alias("hour"))
        .agg(F.round(F.avg("_s"), 6).alias("avg_score"), F.count("*").alias("events"))
    )


def event_kpis(events: DataFrame, *, now: str, last_hours: float = 24) -> DataFrame:
    rows = time_window_filter(events, "timestamp", now=now, last_hours=last_hours)
    return rows.agg(
        F.count("*").alias("total_events"), F.count_if(F.col("blocked") == 1).alias("threats_blocked"),
        F.count_if(F.col("blocked") == 0).alias("requests_allowed"),
        F.count_distinct("threat_type").alias("unique_threats"),
        F.count_distinct("ip").alias("unique_ips"))
