"""Joins and lookups: location, ATT&CK, reputation, active blocks, delays."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskwatch.functions import net
from duskwatch.functions.times import FOREVER, at, ends_at, micros, seconds_between
from duskwatch.plans.ranks import exact_rank_values
from duskwatch.plans.skew import split_join

# Attack type -> tactic, technique, technique name.
MITRE = {
    "SQLI": ("Initial Access", "T1190", "Exploit Public-Facing Application"),
    "XSS": ("Initial Access", "T1189", "Drive-by Compromise"),
    "RCE": ("Execution", "T1059", "Command and Scripting Interpreter"),
    "LFI": ("Collection", "T1005", "Data from Local System"),
    "RFI": ("Execution", "T1059", "Command and Scripting Interpreter"),
    "BRUTE_FORCE": ("Credential Access", "T1110", "Brute Force"),
    "PORT_SCAN": ("Reconnaissance", "T1046", "Network Service Discovery"),
    "DDOS": ("Impact", "T1498", "Network Denial of Service"),
    "DIRECTORY_TRAVERSAL": ("Collection", "T1083", "File and Directory Discovery"),
    "COMMAND_INJECTION": ("Execution", "T1059", "Command and Scripting Interpreter"),
    "SSRF": ("Initial Access", "T1190", "Exploit Public-Facing Application"),
    "XXE": ("Initial Access", "T1190", "Exploit Public-Facing Application"),
    "CSRF": ("Initial Access", "T1189", "Drive-by Compromise"),
    "BOT": ("Reconnaissance", "T1595", "Active Scanning"),
}


def mitre_map(spark: SparkSession) -> DataFrame:
    """The 14-row ATT&CK dimension."""
    return spark.createDataFrame(
        [(a, *v) for a, v in MITRE.items()],
        "attack_type string, mitre_tactic string, mitre_technique string, technique_name string",
    )


def mitre_enrich(logs: DataFrame) -> DataFrame:
    """Add tactic, technique and technique name by attack type (null if unmapped)."""
    dim = mitre_map(logs.sparkSession)
    base = logs.drop("mitre_tactic", "mitre_technique", "technique_name")
    key = F.upper(F.regexp_replace("attack_type", "[ -]", "_"))
    return (
        base.withColumn("_a", key)
        .join(F.broadcast(dim.withColumnRenamed("attack_type", "_a")), "_a", "left")
        .drop("_a")
    )


def mitre_coverage(logs: DataFrame, alerts: DataFrame) -> DataFrame:
    """Events, distinct sources and alerts per technique; empty techniques stay in."""
    dim = mitre_map(logs.sparkSession)
    seen = logs.groupBy("attack_type").agg(F.count("*").alias("events"))
    sources = (
        logs.join(F.broadcast(dim), "attack_type")
        .groupBy("mitre_tactic", "mitre_technique").agg(F.count_distinct("src_ip").alias("sources"))
    )
    raised = alerts.groupBy("attack_type").agg(F.count("*").alias("alerts"))
    per_type = (
        F.broadcast(dim).join(seen, "attack_type", "left").join(raised, "attack_type", "left")
    )
    return (
        per_type.groupBy("mitre_tactic", "mitre_technique")
        .agg(F.coalesce(F.sum("events"), F.lit(0)).alias("events"),
             F.coalesce(F.sum("alerts"), F.lit(0)).alias("alerts"))
        .join(sources, ["mitre_tactic", "mitre_technique"], "left")
        .select("mitre_tactic", "mitre_technique", "events",
                F.coalesce("sources", F.lit(0)).alias("sources"), "alerts")
    )


def _prefixes(low: int, high: int) -> list[str]:
    """The fewest hexadecimal prefixes that cover all 128-bit numbers from ``low`` to ``high``."""
    out = []
    while low <= high:
        digits = 0
        while digits < 32 and low % 16 ** (digits + 1) == 0 and low + 16 ** (digits + 1) - 1 <= high:
            digits += 1
        out.append(f"{low:032x}"[: 32 - digits])
        low += 16 ** digits
    return out


def join_ranges(ips: DataFrame, ranges: DataFrame, *, ip: str, cols: list[str]) -> DataFrame:
    """Attach the range that holds each distinct address, IPv4 or IPv6.

    ``ranges`` has inclusive ``start`` and ``end``, IPv4 as numbers or either kind as text,
    and does not overlap itself. A range is cut into hexadecimal prefixes of address keys and an
    address is looked up by each of its own prefixes (9 for IPv4, 32 for IPv6), which is an
    equality join whose size is that of the two tables, however wide the ranges are.
    """
    number = ranges.schema["start"].dataType.simpleString() != "string"
    key = net.number_key if number else net.ip_key
    bounds = ranges.select(key(F.col("start")).alias("_low"), key(F.col("end")).alias("_high"), *cols).filter(
        "_low is not null and _high is not null")
    schema = T.StructType([T.StructField("_prefix", T.StringType()), *[ranges.schema[c] for c in cols]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(p, i) for i, (low, high) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
                     for p in _prefixes(int(low, 16), int(high, 16))]
            rows = pa.array([i for _, i in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in found], pa.string()), *[c.take(rows) for c in batch.columns[2:]]],
                names=["_prefix", *cols])

    pieces = bounds.mapInArrow(cut, schema)
    points = ips.select(F.col(ip).alias("_ip")).distinct().withColumn("_at", net.ip_key(F.col("_ip"))).filter("_at is not null")
    shortest = F.when(net.is_ipv4(F.col("_ip")), 24).otherwise(1)
    looked_up = points.select("_ip", F.explode(F.transform(
        F.sequence(shortest, F.lit(32)), lambda n: F.substring(F.col("_at"), F.lit(1), n))).alias("_prefix"))
    return looked_up.join(pieces, "_prefix").select(F.col("_ip").alias(ip), *cols)


def geo_enrich(logs: DataFrame, geo_ranges: DataFrame, *, ip: str = "src_ip") -> DataFrame:
    """Country, city, coordinates and ASN by source address.

    Each distinct address is resolved once, and rows of common addresses are spread over tasks (``split_join``). Private addresses are marked
    PRIVATE, ``0.0.0.0`` and missing addresses get nothing.
    """
    cols = ["country", "city", "latitude", "longitude", "asn"]
    out = ["geo_country", "geo_city", "geo_lat", "geo_lon", "geo_asn"]
    known = join_ranges(logs, geo_ranges, ip=ip, cols=cols)
    bare = logs.drop(*out)
    joined = split_join(bare, known, ip, by=["id"] if "id" in bare.columns else bare.columns)
    private = F.coalesce(net.is_private(F.col(ip)) & (F.col(ip) != "0.0.0.0"), F.lit(False))
    return joined.select(
        *[c for c in logs.columns if c not in out],
        F.when(private, "PRIVATE").otherwise(F.col("country")).alias("geo_country"),
        F.when(private, "Internal").otherwise(F.col("city")).alias("geo_city"),
        F.when(private, 0.0).otherwise(F.col("latitude")).alias("geo_lat"),
        F.when(private, 0.0).otherwise(F.col("longitude")).alias("geo_lon"),
        F.when(private, F.lit(None)).otherwise(F.col("asn")).alias("geo_asn"),
    )


# Scores below these are blocked, by policy.
BLOCK_BELOW = {"permissive": -80, "balanced": -50, "strict": -20, "paranoid": 0}


def threat_level(score: Column) -> Column:
    return (
        F.when(score >= 50, "none").when(score >= 0, "low").when(score >= -50, "medium")
        .when(score >= -80, "high").otherwise("critical")
    )


def ip_reputation(
    ips: DataFrame, intel: DataFrame, *, allow: list[str], deny: list[str],
    policy: str = "balanced", ip: str = "src_ip",
) -> DataFrame:
    """Reputation of each distinct address: allow list, deny list, intel, unknown.

    ``intel`` has one row per ``ip`` with ``reputation_score`` and ``threat_types``.
    """
    base = ips.select(F.col(ip).alias("ip")).distinct()
    joined = base.join(intel, "ip", "left")
    addr, score = F.col("ip"), F.col("reputation_score")
    status = (
        F.when(~net.is_ip(addr), "invalid")
        .when(net.in_any_cidr(addr, allow), "whitelisted")
        .when(net.in_any_cidr(addr, deny), "blacklisted")
        .when(score.isNotNull(), "known").otherwise("unknown")
    )
    fixed = {"invalid": (-50, "medium", "block"), "whitelisted": (100, "none", "allow"),
             "blacklisted": (-100, "critical", "block"), "unknown": (0, "low", "allow")}

    def choose(i: int, known: Column) -> Column:
        expr = known
        for name, values in fixed.items():
            expr = F.when(F.col("status") == name, F.lit(values[i])).otherwise(expr)
        return expr

    by_policy = F.when(score < BLOCK_BELOW[policy], "block").otherwise("allow")
    return joined.withColumn("status", status).select(
        "ip", "status",
        choose(0, score.cast("int")).alias("reputation_score"),
        choose(1, threat_level(score)).alias("threat_level"),
        choose(2, by_policy).alias("action"),
        F.when(F.col("status") == "known", F.col("threat_types")).alias("threat_types"),
    )


def blocked_traffic(requests: DataFrame, blocks: DataFrame, *, ip: str = "src_ip", tile_seconds: int = 60) -> DataFrame:
    """Requests that arrive while their address is blocked.

    The latest block at or before the request decides; it must be neither
    expired nor revoked by then, and a block without an end holds for good. An as-of join by
    (address, time tile): a window with one row per address and tile hands the last
    block on to every later tile that has requests, however long ago it began; then tiles of
    one busy address are worked on apart from each other and nothing is paired up.
    ``blocked_until`` is null for a block without an end.
    """
    size = tile_seconds * 1_000_000
    block = F.struct(micros(F.col("created_at")).alias("us"), "block_id",
                     ends_at(F.col("expires_at"), F.col("revoked_at")).alias("until"))
    starts = blocks.select(F.col("ip").alias("_ip"), block.alias("_b")).withColumn("_tile", F.floor(F.col("_b.us") / size))
    reqs = requests.select(
        F.col(ip).alias("_ip"), "id", "timestamp", micros(F.col("timestamp")).alias("_us"),
    ).withColumn("_tile", F.floor(F.col("_us") / size))
    tiles = starts.unionByName(reqs.select("_ip", "_tile").distinct(), allowMissingColumns=True).groupBy(
        "_ip", "_tile").agg(F.max("_b").alias("_own"))
    earlier = Window.partitionBy("_ip").orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    carried = tiles.withColumn("_b", F.last("_own", ignorenulls=True).over(earlier)).filter("_b is not null").drop("_own")
    marks = starts.unionByName(carried).select("_ip", "_tile", "_b", F.col("_b.us").alias("_us"))
    both = reqs.unionByName(marks, allowMissingColumns=True)
    w = (Window.partitionBy("_ip", "_tile")
         .orderBy("_us", F.col("id").isNotNull(), F.col("_b.block_id"), "id")
         .rowsBetween(Window.unboundedPreceding, 0))
    until = F.col("_last.until")
    return (
        both.withColumn("_last", F.last("_b", ignorenulls=True).over(w))
        .filter(F.col("id").isNotNull() & (F.col("timestamp") < until))
        .select("id", F.col("_ip").alias(ip), "timestamp", F.col("_last.block_id").alias("block_id"),
                F.when(until < at(FOREVER), until).alias("blocked_until"))
    )


def alert_pipeline_delay(alerts: DataFrame, logs: DataFrame) -> DataFrame:
    """Delay from the last received log of an alert to the alert, in ms: mean and p95.

    ``alerts`` has one row for each log of an alert: id, created_at, log_id.
    """
    ids = alerts.select("id", "created_at", "log_id")
    got = logs.select(F.col("id").alias("log_id"), "received_at")
    per_alert = ids.join(got, "log_id").groupBy("id", "created_at").agg(
        F.max("received_at").alias("last_received"))
    delays = per_alert.select(
        (seconds_between(F.col("created_at"), F.col("last_received")) * 1000.0).alias("delay_ms"))
    return _mean_p95(delays, "delay_ms", "alerts_measured", "avg_delay_ms", "p95_delay_ms")


def _mean_p95(df: DataFrame, value: str, n: str, mean: str, p95: str) -> DataFrame:
    stats = df.agg(F.count(value).alias(n), F.round(F.avg(value), 2).alias(mean)).withColumn("_k", F.lit(1))
    tail = exact_rank_values(df, groups=[], value=value, ps={p95: 0.95}).withColumn("_k", F.lit(1))
    return stats.join(tail, "_k", "left").select(n, mean, F.round(p95, 2).alias(p95))


def alert_incident_delay(alerts: DataFrame, incidents: DataFrame) -> DataFrame:
    """Incident creation minus alert creation over linked pairs, in ms."""
    pairs = alerts.select("incident_id", F.col("created_at").alias("_a")).join(
        incidents.select(F.col("id").alias("incident_id"), F.col("created_at").alias("_i")), "incident_id")
    delays = pairs.select(
        F.round(seconds_between(F.col("_i"), F.col("_a")) * 1000.0, 3).alias("ms"))
    later = delays.filter("ms >= 0")
    counts = delays.agg(
        F.count("*").alias("pairs"), F.count_if(F.col("ms") < 0).alias("negative_pairs")
    ).withColumn("_k", F.lit(1))
    stats = _mean_p95(later, "ms", "non_negative_pairs", "avg_delay_ms", "p95_delay_ms").withColumn("_k", F.lit(1))
    return counts.join(stats, "_k").drop("_k")


def tracked_users(seen: DataFrame, reported: DataFrame) -> DataFrame:
    """Visitors known to the server merged with visitors that reported themselves.

    ``seen``: ip, last_seen, user_agent, request_count, location.
    ``reported``: ip, reported_at, user_agent, location, location_source.
    A reported GPS location replaces the server's; other reports only add
    addresses the server has not seen.
    """
    s = seen.select("ip", F.col("last_seen").alias("_ls"), F.col("user_agent").alias("_ua"),
                    F.col("location").alias("_loc"), "request_count", F.lit(True).alias("_seen"))
    r = reported.select("ip", "reported_at", "user_agent", "location", "location_source")
    j = s.join(r, "ip", "full_outer")
    known = F.coalesce(F.col("_seen"), F.lit(False))
    gps = F.when(F.col("location_source") == "gps", F.col("location"))
    loc = F.when(known, F.coalesce(gps, F.col("_loc"))).otherwise(F.col("location"))
    return j.select(
        "ip",
        F.when(known, F.col("_ls")).otherwise(F.col("reported_at")).alias("seen_at"),
        F.when(known, F.col("_ua")).otherwise(F.col("user_agent")).alias("user_agent"),
        loc.alias("location"), loc.isNotNull().alias("located"),
        F.coalesce("request_count", F.lit(0)).alias("request_count"),
        F.when(known, "server-tracking").otherwise("reported").alias("source"),
    )
