"""Correlation over addresses, paths, sessions and time, per detection cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions import severity as sev
from duskwatch.functions.times import micros
from duskwatch.operators.behavior import in_cycles
from duskwatch.operators.hits import as_hits, with_log_ids
from duskwatch.plans.tiles import run_starts

# Attack types that scout and attack types that exploit.
RECON = ["PORT_SCAN", "BOT", "DIRECTORY_TRAVERSAL"]
EXPLOIT = ["SQLI", "XSS", "RCE", "LFI", "RFI", "COMMAND_INJECTION", "SSRF", "XXE"]


def attacks(logs: DataFrame, cycle: float | None) -> DataFrame:
    return in_cycles(logs.filter(F.col("attack_type") != "NONE"), cycle)


def attack_kinds(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Event count and distinct attack types per key (at most 15 types)."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("event_count"), F.max("timestamp").alias("seen_at"),
        F.array_sort(F.collect_set("attack_type")).alias("attack_kinds"))


def multi_vector_ip(
    logs: DataFrame, *, threshold: int = 3, cycle: float | None = 60, max_ids: int = 50
) -> DataFrame:
    """Addresses that used at least ``threshold`` attack types."""
    rows = attacks(logs, cycle)
    keys = ["cycle_start", "src_ip"]
    found = attack_kinds(rows, keys).filter(F.size("attack_kinds") >= threshold)
    return as_hits(
        with_log_ids(found, rows, keys, max_ids), source="correlation.ip", rule_id="correlation.ip",
        title=F.concat(F.lit("Multi-vector attack from "), "src_ip", F.lit(": "),
                       F.array_join("attack_kinds", ", ")),
        severity="CRITICAL", attack_type="OTHER", confidence=0.9,
        mitre_tactic="Initial Access", mitre_technique="T1190")


def coordinated_path(
    logs: DataFrame, *, threshold: int = 5, cycle: float | None = 60, max_ids: int = 50
) -> DataFrame:
    """Paths attacked from at least ``threshold`` addresses; the lowest one stands for them."""
    rows = attacks(logs.filter(F.col("http_path") != ""), cycle)
    keys = ["cycle_start", "http_path"]
    per_ip = rows.groupBy(*keys, "src_ip").agg(
        F.count("*").alias("n"), F.max("timestamp").alias("last"))
    found = per_ip.groupBy(*keys).agg(
        F.count("*").alias("sources"), F.sum("n").alias("event_count"),
        F.max("last").alias("seen_at"), F.min("src_ip").alias("src_ip"),
    ).filter(F.col("sources") >= threshold)
    return as_hits(
        with_log_ids(found, rows, keys, max_ids), source="correlation.ip", rule_id="correlation.ip",
        title=F.concat(F.lit("Coordinated attack on "), F.substring("http_path", 1, 64), F.lit(" from "),
                       F.col("sources").cast("string"), F.lit(" addresses")),
        severity="CRITICAL", attack_type="OTHER", confidence=0.85,
        mitre_tactic="Initial Access", mitre_technique="T1190")


SESSION = ["cycle_start", "session_id"]


def session_multi_attack(
    logs: DataFrame, *, threshold: int = 2, min_rows: int = 2, cycle: float | None = 60, max_ids: int = 30
) -> DataFrame:
    """Sessions (of at least ``min_rows`` rows) with several attack types."""
    rows = in_cycles(logs.filter("session_id <> ''"), cycle)
    kinds = F.collect_set(F.when(F.col("attack_type") != "NONE", F.col("attack_type")))
    found = rows.groupBy(*SESSION).agg(
        F.count("*").alias("event_count"), F.max("timestamp").alias("seen_at"),
        F.min_by("src_ip", F.struct("timestamp", "id")).alias("src_ip"),
        F.array_sort(kinds).alias("attack_kinds"),
    ).filter((F.col("event_count") >= min_rows) & (F.size("attack_kinds") >= threshold))
    return as_hits(
        with_log_ids(found, rows, SESSION, max_ids), source="correlation.session",
        rule_id="correlation.session",
        title=F.concat(F.lit("Session multi-attack: "), F.array_join("attack_kinds", ", ")),
        severity="HIGH", attack_type="OTHER", confidence=0.8,
        mitre_tactic="Lateral Movement", mitre_technique="T1078")


def never_falls(rank: Column, order: Column, ranks: int = 5) -> Column:
    """Aggregate: true if ``rank`` does not fall along ``order``.

    With few ranks that is the same as: every rank ends before the next higher
    one begins. Minima and maxima combine before the shuffle, so a long session
    is never put in order by one task.
    """
    last = [F.max(F.when(rank == r, order)) for r in range(ranks)]
    first = [F.min(F.when(rank == r, order)) for r in range(ranks)]
    ok = F.lit(True)
    for low in range(ranks):
        for high in range(low + 1, ranks):
            ok = ok & F.coalesce(last[low] < first[high], F.lit(True))
    return ok


def session_escalation(
    logs: DataFrame, *, min_rows: int = 3, ends_at_least: str = "HIGH", cycle: float | None = 60,
) -> DataFrame:
    """Sessions whose severity never falls and that end at HIGH or above.

    The finding lists the ids of all rows of its session and cycle.
    """
    rows = in_cycles(logs.filter("session_id <> ''"), cycle)
    rank, order = sev.rank(F.col("severity")), F.struct("timestamp", "id")
    found = rows.groupBy(*SESSION).agg(
        F.count("*").alias("event_count"), F.max("timestamp").alias("seen_at"),
        F.min_by("src_ip", order).alias("src_ip"),
        F.max_by(rank, order).alias("_end"), never_falls(rank, order).alias("_rising"),
    ).filter((F.col("event_count") >= min_rows) & F.col("_rising")
             & (F.col("_end") >= sev.rank(F.lit(ends_at_least))))
    return as_hits(
        with_log_ids(found, rows, SESSION, None), source="correlation.session",
        rule_id="correlation.session", title="Escalating severity in session", severity="HIGH",
        confidence=0.75, mitre_tactic="Privilege Escalation", mitre_technique="T1068")


def attack_burst(
    logs: DataFrame, *, count: int = 10, seconds: float = 30, many_ips: int = 3,
    cycle: float | None = 60, max_ids: int = 50,
) -> DataFrame:
    """Earliest burst of ``count`` attacks within ``seconds`` over all addresses, per cycle.

    First the start of the burst is found from trimmed time tiles, then the rows
    of that one window are summed up.
    """
    width = int(seconds * 1_000_000)
    rows = attacks(logs, cycle).withColumn("us", micros(F.col("timestamp")))
    starts = run_starts(rows, keys=["cycle_start"], us="us", order=["us", "id"], n=count, width_us=width)
    inside = rows.join(starts.select("cycle_start", "start_us"), "cycle_start").filter(
        (F.col("us") >= F.col("start_us")) & (F.col("us") <= F.col("start_us") + width))
    per_ip = inside.groupBy("cycle_start", "src_ip").agg(
        F.count("*").alias("n"), F.max("timestamp").alias("last"))
    found = per_ip.groupBy("cycle_start").agg(
        F.sum("n").alias("event_count"), F.max("last").alias("seen_at"),
        F.count("*").alias("sources"), F.min("src_ip").alias("src_ip"))
    wide = F.col("sources") > many_ips
    return as_hits(
        with_log_ids(found, inside, ["cycle_start"], max_ids, chosen=True), source="correlation.time",
        rule_id="correlation.time",
        title=F.concat(F.lit("Attack burst from "), F.col("sources").cast("string"), F.lit(" addresses")),
        severity=F.when(wide, "CRITICAL").otherwise("HIGH"),
        attack_type=F.when(wide, "DDOS").otherwise("OTHER"), confidence=0.9,
        mitre_tactic="Impact", mitre_technique=F.when(wide, "T1498").otherwise("T1190"))


def recon_exploit(
    logs: DataFrame, *, min_attacks: int = 10, ordered: bool = False, cycle: float | None = 60,
    max_ids: int = 50,
) -> DataFrame:
    """Addresses with both scouting and exploiting attacks.

    Only cycles with at least ``min_attacks`` attacks are looked at. ``ordered``
    also asks for scouting before the last exploit.
    """
    rows = attacks(logs, cycle)
    keys = ["cycle_start", "src_ip"]
    kind = F.col("attack_type")
    at = F.struct("timestamp", "id")
    per_ip = rows.groupBy(*keys).agg(
        F.count("*").alias("event_count"), F.max("timestamp").alias("seen_at"),
        F.min(F.when(kind.isin(RECON), at)).alias("recon"),
        F.max(F.when(kind.isin(EXPLOIT), at)).alias("exploit"))
    busy = per_ip.groupBy("cycle_start").agg(F.sum("event_count").alias("n")).filter(F.col("n") >= min_attacks)
    found = per_ip.filter("recon is not null and exploit is not null")
    if ordered:
        found = found.filter("recon < exploit")
    found = found.join(busy, "cycle_start", "left_semi")
    return as_hits(
        with_log_ids(found, rows, keys, max_ids), source="correlation.time", rule_id="correlation.time",
        title=F.concat(F.lit("Recon and exploit chain from "), "src_ip"), severity="CRITICAL",
        attack_type="OTHER", confidence=0.9, mitre_tactic="Initial Access", mitre_technique="T1190")
