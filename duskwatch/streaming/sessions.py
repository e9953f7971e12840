"""Session detectors over sessions that end by silence, in batch and in a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.functions import severity as sev
from duskwatch.operators.hits import as_hits
from duskwatch.session import state_on_disk

RANKS = 5


def silent_sessions(logs: DataFrame, *, gap_seconds: int = 1800, delay: str = "10 seconds", resolution: int = 1) -> DataFrame:
    """One row per session: its rows up to the first silence of more than ``gap_seconds``; on a stream it is released when that has passed.

    Rows are first put together per session id, time step and severity, before the shuffle too, so a busy session
    costs at most five rows per ``resolution`` seconds; silences are counted in whole steps. ``first`` and ``last`` hold time and id
    of the first and last row of each severity, which is all that the detectors ask of the order of rows.
    Rows without a session id, time or known severity: left out, left out, counted but without a place in the order.
    A stream holds a step until the watermark has passed it, so all steps of a backlog that comes in one batch; its state lies on disk.
    """
    if logs.isStreaming:
        state_on_disk(logs.sparkSession)
    c = F.col
    # Columns first, as each aggregate would work them out again.
    rows = logs.filter("session_id <> '' AND timestamp IS NOT NULL").select(
        c("timestamp").cast("timestamp").alias("event_time"), "session_id", sev.rank(c("severity")).alias("rank"),
        F.struct("timestamp", "id", "src_ip").alias("opener"), F.struct("timestamp", "id").alias("at"),
        F.when(c("attack_type") != "NONE", c("attack_type")).alias("kind"), F.nullif("geo_country", F.lit("")).alias("country"))
    steps = rows.withWatermark("event_time", delay).groupBy(F.window("event_time", f"{resolution} seconds").alias("w"), "session_id", "rank").agg(
        F.count("*").alias("n"), F.min("opener").alias("opened"), F.max("at").alias("last"), F.collect_set("kind").alias("kinds"),
        F.collect_set("country").alias("countries"))
    steps = steps.select(F.window_time("w").alias("step_time"), "session_id", "rank", "n", "opened", "last", "kinds", "countries",
                         F.struct("opened.timestamp", "opened.id").alias("first"))
    found = steps.groupBy(F.session_window("step_time", f"{gap_seconds} seconds").alias("s"), "session_id").agg(
        F.sum("n").alias("event_count"), F.min("opened").alias("opened"),
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_set(a)))).alias(a) for a in ("kinds", "countries")],
        F.array(*[F.min(F.when(c("rank") == r, c("first"))) for r in range(RANKS)]).alias("first"),
        F.array(*[F.max(F.when(c("rank") == r, c("last"))) for r in range(RANKS)]).alias("last"))
    return found.select("session_id", c("opened.timestamp").alias("started_at"), F.array_max("last")["timestamp"].alias("seen_at"),
                        c("opened.src_ip").alias("src_ip"), "event_count", "kinds", "countries", "first", "last")


def stream_silent_sessions(
    logs: DataFrame, *, gap_seconds: int = 1800, delay: str = "10 seconds", resolution: int = 1, kinds: int = 2, countries: int = 3,
    min_rows: int = 3, ends_at_least: str = "HIGH",
) -> DataFrame:
    """Several attack types, rising severity and several countries per session of ``silent_sessions``, in the hit layout with ``cycle_start`` the start.

    A finding lists the ids of the first and last row of each severity (at most 10), and counts all rows of its session.
    """
    c = F.col
    rising, ends = F.lit(True), F.lit(-1)
    for low in range(RANKS):
        ends = F.when(c("last")[low].isNotNull(), low).otherwise(ends)
        for high in range(low + 1, RANKS):
            rising = rising & F.coalesce(c("last")[low] < c("first")[high], F.lit(True))

    def finding(test, source, title, severity, attack_type, confidence, tactic, technique):
        return F.when(test, F.struct(
            F.lit(source).alias("source"), title.alias("title"), F.lit(severity).alias("severity"),
            F.lit(attack_type).cast("string").alias("attack_type"), F.lit(confidence).alias("confidence"), F.lit(tactic).alias("mitre_tactic"),
            F.lit(technique).alias("mitre_technique")))

    found = F.array_compact(F.array(
        finding((c("event_count") >= 2) & (F.size("kinds") >= kinds), "correlation.session",
                F.concat(F.lit("Session multi-attack: "), F.array_join("kinds", ", ")), "HIGH", "OTHER", 0.8, "Lateral Movement", "T1078"),
        finding((c("event_count") >= min_rows) & rising & (ends >= sev.rank(F.lit(ends_at_least))), "correlation.session",
                F.lit("Escalating severity in session"), "HIGH", None, 0.75, "Privilege Escalation", "T1068"),
        finding(F.size("countries") >= countries, "behavioral.geo", F.lit("Multi-country session anomaly"), "HIGH", None, 0.85,
                "Defense Evasion", "T1090")))
    edges = F.array_sort(F.array_distinct(F.array_compact(F.concat("first", "last"))))
    rows = silent_sessions(logs, gap_seconds=gap_seconds, delay=delay, resolution=resolution).withColumn("f", F.explode(found))
    return as_hits(rows.select("*", "f.*").withColumns({"cycle_start": c("started_at"), "rule_id": c("source"),
                                                          "log_ids": F.transform(edges, lambda e: e["id"])}))
