"""Behavioural detectors. One detection cycle is a tumbling window of ``cycle`` seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.functions.text import any_rlike
from duskwatch.functions.times import cycle_start, from_micros, micros
from duskwatch.operators.hits import as_hits, with_log_ids
from duskwatch.plans.tiles import run_starts

# Watched countries, probe paths and tool-like agents.
HIGH_RISK_COUNTRIES = ["KP", "IR", "SY", "CU", "VE"]
WATCH_COUNTRIES = ["RU", "CN", "BY", "UA"]
SCAN_PATHS = [
    r"/\.env", r"/\.git", r"/wp-admin", r"/wp-login", r"/admin", r"/phpmyadmin",
    r"/\.htaccess", r"/\.htpasswd", r"/config\.", r"/backup", r"/\.svn", r"/\.DS_Store",
    r"/server-status", r"/actuator", r"/api/swagger", r"/debug", r"/console", r"/shell",
    r"/cmd", r"/exec", r"/eval",
]
SUSPICIOUS_AGENTS = [
    "sqlmap", "nikto", "nmap", "masscan", "dirbuster", "gobuster", "wfuzz", "hydra", "burp",
    "zap", "nessus", "openvas", "scanner", "python-requests",
]

KEY = ["cycle_start", "src_ip"]


def in_cycles(logs: DataFrame, cycle: float | None) -> DataFrame:
    return logs.withColumn("cycle_start", cycle_start(F.col("timestamp"), cycle))


def high_request_rate(
    logs: DataFrame, *, threshold: int = 120, cycle: float | None = 60, max_ids: int = 50
) -> DataFrame:
    """Addresses with at least ``threshold`` requests in a cycle; HIGH above twice that."""
    rows = in_cycles(logs, cycle)
    n = F.col("event_count")
    found = rows.groupBy(*KEY).agg(
        F.count("*").alias("event_count"), F.max("timestamp").alias("seen_at")).filter(n >= threshold)
    return as_hits(
        with_log_ids(found, rows, KEY, max_ids), source="behavioral.rate", rule_id="behavioral.rate",
        title=F.concat(F.lit("High request rate from "), "src_ip"),
        severity=F.when(n > 2 * threshold, "HIGH").otherwise("MEDIUM"), attack_type="DDOS",
        confidence=F.round(F.least(F.lit(0.95), 0.5 + (n / threshold) * 0.3), 6),
        mitre_tactic="Impact", mitre_technique="T1498")


def high_block_rate(
    logs: DataFrame, *, threshold: int = 20, cycle: float | None = 60, max_ids: int = 50
) -> DataFrame:
    """Addresses with at least ``threshold`` blocked requests in a cycle."""
    rows = in_cycles(logs.filter(F.col("action") == "BLOCKED"), cycle)
    found = rows.groupBy(*KEY).agg(
        F.count("*").alias("event_count"), F.max("timestamp").alias("seen_at")
    ).filter(F.col("event_count") >= threshold)
    return as_hits(
        with_log_ids(found, rows, KEY, max_ids), source="behavioral.rate", rule_id="behavioral.rate",
        title=F.concat(F.lit("High block rate for "), "src_ip"), severity="HIGH",
        attack_type="BRUTE_FORCE", confidence=0.8,
        mitre_tactic="Credential Access", mitre_technique="T1110")


def ip_burst(
    logs: DataFrame, *, count: int = 30, seconds: float = 10, cycle: float | None = 60
) -> DataFrame:
    """First run of ``count`` requests within ``seconds`` per address and cycle.

    Every run counts, also one that ends at the last request of the cycle.
    """
    rows = in_cycles(logs, cycle).withColumn("us", micros(F.col("timestamp")))
    runs = run_starts(rows, keys=KEY, us="us", order=["us", "id"], n=count,
                      width_us=int(seconds * 1_000_000))
    found = runs.withColumn("delta_seconds", (F.col("end_us") - F.col("start_us")) / 1e6)
    return as_hits(
        found, source="behavioral.rate", rule_id="behavioral.rate",
        title=F.concat(F.lit("Burst traffic from "), "src_ip"), severity="HIGH", attack_type="DDOS",
        seen_at=from_micros(F.col("end_us")), event_count=count, confidence=0.9)


def rate_baseline(
    logs: DataFrame, *, cycle: float = 86400, start: float = 10.0, keep: float = 0.9
) -> DataFrame:
    """Moving average of requests per cycle and address, over cycles with traffic.

    ``b <- keep * b + (1 - keep) * n`` from ``start``, written as a weighted sum
    so it needs no sequential pass; the window sees one row per cycle.
    """
    counts = in_cycles(logs, cycle).groupBy(*KEY).agg(F.count("*").alias("n"))
    age = F.row_number().over(Window.partitionBy("src_ip").orderBy(F.desc("cycle_start"))) - 1
    aged = counts.withColumn("w", F.pow(F.lit(keep), age))
    return aged.groupBy("src_ip").agg(
        F.count("*").alias("cycles"),
        F.round(F.pow(F.lit(keep), F.count("*")) * start + (1 - keep) * F.sum(F.col("n") * F.col("w")), 6)
        .alias("baseline"))


def high_risk_country_attacks(logs: DataFrame, *, countries: list[str] | None = None) -> DataFrame:
    rows = logs.filter(F.col("geo_country").isin(countries or HIGH_RISK_COUNTRIES)
                       & (F.col("attack_type") != "NONE"))
    return as_hits(
        rows, source="behavioral.geo", rule_id="behavioral.geo",
        title=F.concat(F.lit("Attack from high-risk country ("), "geo_country", F.lit(")")),
        severity="HIGH", seen_at=F.col("timestamp"), event_count=1, log_ids=F.array("id"),
        http_path=None, session_id=None, confidence=0.75,
        mitre_tactic="Initial Access", mitre_technique="T1190")


def multi_country_session(
    logs: DataFrame, *, threshold: int = 3, cycle: float | None = 60, max_ids: int = 20
) -> DataFrame:
    """Sessions seen from at least ``threshold`` countries."""
    rows = in_cycles(logs.filter("session_id <> '' and geo_country <> ''"), cycle)
    keys = ["cycle_start", "session_id"]
    per_country = rows.groupBy(*keys, "geo_country").agg(
        F.count("*").alias("_n"), F.max("timestamp").alias("_last"),
        F.min_by("src_ip", F.struct("timestamp", "id")).alias("_ip"),
        F.min(F.struct("timestamp", "id")).alias("_first"))
    found = per_country.groupBy(*keys).agg(
        F.count("*").alias("countries"), F.sum("_n").alias("event_count"),
        F.max("_last").alias("seen_at"), F.min_by("_ip", "_first").alias("src_ip"),
    ).filter(F.col("countries") >= threshold)
    return as_hits(
        with_log_ids(found, rows, keys, max_ids), source="behavioral.geo", rule_id="behavioral.geo",
        title="Multi-country session anomaly", severity="HIGH", confidence=0.85,
        mitre_tactic="Defense Evasion", mitre_technique="T1090")


def new_watch_country(
    logs: DataFrame, *, cycle: float = 86400, countries: list[str] | None = None
) -> DataFrame:
    """First cycle in which a watch-list country appears, with its events in that cycle."""
    rows = in_cycles(logs.filter(F.col("geo_country").isin(countries or WATCH_COUNTRIES)), cycle)
    counts = rows.groupBy("geo_country", "cycle_start").agg(
        F.count("*").alias("n"), F.max("timestamp").alias("last"))
    first = counts.groupBy("geo_country").agg(F.min(F.struct("cycle_start", "n", "last")).alias("f"))
    found = first.select("geo_country", "f.cycle_start", F.col("f.n").alias("event_count"),
                         F.col("f.last").alias("seen_at"))
    return as_hits(
        found, source="behavioral.geo", rule_id="behavioral.geo",
        title=F.concat(F.lit("New traffic from watch-list country: "), "geo_country"),
        severity="LOW", log_ids=F.array().cast("array<bigint>"), confidence=0.5)


def scan_path_hits(
    logs: DataFrame, *, threshold: int = 5, cycle: float | None = 60,
    paths: list[str] | None = None, max_ids: int = 30,
) -> DataFrame:
    """Addresses with at least ``threshold`` requests to known probe paths."""
    rows = in_cycles(logs.filter(F.col("http_path").rlike(any_rlike(paths or SCAN_PATHS))), cycle)
    found = rows.groupBy(*KEY).agg(
        F.count("*").alias("event_count"), F.max("timestamp").alias("seen_at")
    ).filter(F.col("event_count") >= threshold)
    return as_hits(
        with_log_ids(found, rows, KEY, max_ids), source="behavioral.pattern",
        rule_id="behavioral.pattern", title=F.concat(F.lit("Directory enumeration from "), "src_ip"),
        severity="HIGH", attack_type="PORT_SCAN", confidence=0.85,
        mitre_tactic="Discovery", mitre_technique="T1083")


def scanned_paths(
    logs: DataFrame, *, threshold: int = 5, cycle: float | None = 60,
    paths: list[str] | None = None, max_paths: int = 10,
) -> DataFrame:
    """The first probe paths (by name) of each address that ``scan_path_hits`` reports."""
    rows = in_cycles(logs.filter(F.col("http_path").rlike(any_rlike(paths or SCAN_PATHS))), cycle)
    per_path = rows.groupBy(*KEY, "http_path").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*KEY).orderBy("http_path")
    total = per_path.groupBy(*KEY).agg(F.sum("n").alias("event_count")).filter(
        F.col("event_count") >= threshold)
    kept = per_path.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= max_paths)
    listed = kept.groupBy(*KEY).agg(F.array_sort(F.collect_list("http_path")).alias("paths"))
    return total.join(listed, KEY)


def path_diversity(
    logs: DataFrame, *, threshold: int = 50, cycle: float | None = 60,
    approximate: bool = False, max_ids: int = 30,
) -> DataFrame:
    """Addresses that asked for at least ``threshold`` distinct paths."""
    rows = in_cycles(logs.filter(F.col("http_path") != ""), cycle)
    distinct = F.approx_count_distinct("http_path") if approximate else F.count_distinct("http_path")
    found = rows.groupBy(*KEY).agg(
        distinct.alias("event_count"), F.max("timestamp").alias("seen_at")
    ).filter(F.col("event_count") >= threshold)
    return as_hits(
        with_log_ids(found, rows, KEY, max_ids), source="behavioral.pattern",
        rule_id="behavioral.pattern", title=F.concat(F.lit("High path diversity from "), "src_ip"),
        severity="MEDIUM", attack_type="PORT_SCAN", confidence=0.7,
        mitre_tactic="Reconnaissance", mitre_technique="T1595")


def suspicious_agents(
    logs: DataFrame, *, cycle: float | None = 60, agents: list[str] | None = None
) -> DataFrame:
    """First request with a tool-like user agent per address and cycle."""
    rows = in_cycles(logs.filter(F.col("http_user_agent").rlike(any_rlike(agents or SUSPICIOUS_AGENTS))), cycle)
    first = rows.groupBy(*KEY).agg(
        F.min(F.struct("timestamp", "id", "http_user_agent")).alias("f"))
    return as_hits(
        first, source="behavioral.pattern", rule_id="behavioral.pattern",
        title=F.concat(F.lit("Suspicious tool detected: "), "src_ip"), severity="HIGH",
        attack_type="BOT", seen_at=F.col("f.timestamp"), event_count=1,
        log_ids=F.array(F.col("f.id")), confidence=0.9,
        mitre_tactic="Reconnaissance", mitre_technique="T1595")
