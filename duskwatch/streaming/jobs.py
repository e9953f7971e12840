"""Structured Streaming versions of ingest, detection, merging and limits.

Functions that return a DataFrame take a streaming frame and are started by the
caller; on a batch frame the stateless ones give the batch result. Cycles are
event-time windows, so a restart or a late file changes nothing but the time at
which a cycle is released.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from duskwatch.functions import severity as sev
from duskwatch.functions.text import any_rlike
from duskwatch.operators import behavior, rules as rule_ops
from duskwatch.operators.alerts import _escalated, _keyed, _uid, alert_feed, incident_step
from duskwatch.operators.correlate import EXPLOIT, RECON, never_falls
from duskwatch.operators.requests import _admit
from duskwatch.plans.fold import anchored
from duskwatch.sources.ingest import PARSERS, canonical_logs, quarantine
from duskwatch.functions.times import from_micros, micros
from duskwatch.streaming.stateful import stream_fold


def run_to_end(df: DataFrame, path: str, checkpoint: str, *, fmt: str = "parquet") -> None:
    """Work off all input that is there and stop; the sink is exactly-once."""
    q = (df.writeStream.outputMode("append").format(fmt).option("path", path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def _write_batch(frame: DataFrame, path: str, batch: int) -> None:
    """One folder per micro-batch, overwritten if the batch is replayed."""
    frame.write.mode("overwrite").parquet(f"{path}/batch_id={batch}")


def stream_ingest(
    lines: DataFrame, *, source_format: str, logs_path: str, quarantine_path: str, checkpoint: str, now: str | None = None,
    geo_ranges: DataFrame | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """Parse lines as they come; good rows go to the log table, the rest to quarantine.

    Rows are received when their batch starts, or at ``now``. A batch is parsed once for both tables.
    ``trigger`` is that of ``DataStreamWriter.trigger``; all there is, once, by default.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        received = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None).isoformat(sep=" ")
        parsed = PARSERS[source_format](batch, now=received).persist()
        try:
            _write_batch(canonical_logs(parsed, source_format=source_format, received_at=received, geo_ranges=geo_ranges,
                                        batch=batch_id), logs_path, batch_id)
            _write_batch(quarantine(parsed), quarantine_path, batch_id)
        finally:
            parsed.unpersist()

    return (lines.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def _marked(rows: DataFrame, delay: str) -> DataFrame:
    """Watermarks need an instant; log times are naive UTC."""
    return rows.withColumn("event_time", F.col("timestamp").cast("timestamp")).withWatermark("event_time", delay)


def _cycles(logs: DataFrame, cycle: str, delay: str) -> tuple[DataFrame, Column]:
    return _marked(logs, delay), F.window("event_time", cycle).alias("w")


def stream_detections(
    logs: DataFrame, *, cycle: str = "60 seconds", delay: str = "10 seconds", requests: int = 120, blocked: int = 20,
    scans: int = 5, kinds: int = 3, min_attacks: int = 10,
) -> DataFrame:
    """Per cycle and address: rate, block rate, scanning, attack variety, recon with exploit.

    One aggregate per address feeds the first four. Recon with exploit counts only in cycles with ``min_attacks``
    attacks, so its candidates are joined with the totals of the cycles. These are counts for a live view; findings in
    the hit layout, with their log ids and of all detectors, come from ``scan.stream_scan``.
    """
    rows, w = _cycles(logs, cycle, delay)
    attack = F.col("attack_type") != "NONE"
    per_ip = rows.groupBy(w, "src_ip").agg(
        F.count("*").alias("requests"), F.count_if(F.col("action") == "BLOCKED").alias("blocked"),
        F.count_if(F.col("http_path").rlike(any_rlike(behavior.SCAN_PATHS))).alias("scans"),
        F.size(F.collect_set(F.when(attack, F.col("attack_type")))).alias("kinds"),
        F.count_if(attack).alias("attacks"),
        F.max(F.col("attack_type").isin(RECON)).alias("recon"),
        F.max(F.col("attack_type").isin(EXPLOIT)).alias("exploit"))

    def found(test: Column, name: str, n: Column, severity: Column | str) -> Column:
        s = severity if isinstance(severity, Column) else F.lit(severity)
        return F.when(test, F.struct(F.lit(name).alias("detector"), n.alias("event_count"), s.alias("severity")))

    c = F.col
    hits = F.array(
        found(c("requests") >= requests, "high_request_rate", c("requests"),
              F.when(c("requests") > 2 * requests, "HIGH").otherwise("MEDIUM")),
        found(c("blocked") >= blocked, "high_block_rate", c("blocked"), "HIGH"),
        found(c("scans") >= scans, "scan_path_hits", c("scans"), "HIGH"),
        found(c("kinds") >= kinds, "multi_vector_ip", c("attacks"), "CRITICAL"))
    single = per_ip.select(c("w.start").cast("timestamp_ntz").alias("cycle_start"), "src_ip",
                           F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("h")).select(
        "cycle_start", "src_ip", "h.*")
    # The cycle's total is an aggregate of its own and meets the candidates by a join, so no list grows with the addresses.
    start = F.col("w.start").cast("timestamp_ntz")
    totals = per_ip.filter("attacks > 0").groupBy(F.window(F.window_time("w"), cycle).alias("w")).agg(F.sum("attacks").alias("cycle_attacks"))
    enough = totals.filter(c("cycle_attacks") >= min_attacks).select("w")
    chains = per_ip.filter("recon and exploit").select(F.window(F.window_time("w"), cycle).alias("w"), "src_ip", "attacks")
    both = chains.join(enough, "w").select(
        start.alias("cycle_start"), "src_ip", F.lit("recon_exploit").alias("detector"), F.col("attacks").alias("event_count"),
        F.lit("CRITICAL").alias("severity"))
    return single.unionByName(both)


def stream_sessions(
    logs: DataFrame, *, cycle: str = "60 seconds", delay: str = "10 seconds", kinds: int = 2, countries: int = 3,
) -> DataFrame:
    """Per cycle and session: several attack types, rising severity, several countries."""
    rows, w = _cycles(logs.filter("session_id <> ''"), cycle, delay)
    rank, order = sev.rank(F.col("severity")), F.struct("timestamp", "id")
    per = rows.groupBy(w, "session_id").agg(
        F.count("*").alias("event_count"), F.min_by("src_ip", order).alias("src_ip"),
        F.size(F.collect_set(F.when(F.col("attack_type") != "NONE", F.col("attack_type")))).alias("kinds"),
        F.size(F.collect_set(F.nullif(F.col("geo_country"), F.lit("")))).alias("countries"),
        F.max_by(rank, order).alias("end_rank"), never_falls(rank, order).alias("rising"))
    n = F.col("event_count")
    tests = {
        "session_multi_attack": (n >= 2) & (F.col("kinds") >= kinds),
        "session_escalation": (n >= 3) & F.col("rising") & (F.col("end_rank") >= 3),
        "multi_country_session": F.col("countries") >= countries,
    }
    names = F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]), lambda x: x.isNotNull())
    return per.select(F.col("w.start").cast("timestamp_ntz").alias("cycle_start"), "session_id", "src_ip", "event_count",
                      F.explode(names).alias("detector"))


def _seconds(df: DataFrame, keys: list[str], delay: str, seconds: int, **aggs: Column) -> DataFrame:
    """Counts per key and time step, released in time order."""
    out = _marked(df, delay).groupBy(F.window("event_time", f"{seconds} seconds").alias("w"), *keys).agg(
        *[v.alias(k) for k, v in aggs.items()])
    second = F.floor(micros(F.col("w.start")) / 1_000_000).alias("second")
    return out.select(F.col("w"), *keys, second, *aggs)


def stream_thresholds(
    logs: DataFrame, rules: list[dict] | None = None, *, delay: str = "10 seconds", resolution: int = 1,
) -> DataFrame:
    """Counters that clear when they fire, kept from batch to batch until their window has passed."""
    active = rule_ops.enabled(rule_ops.THRESHOLDS if rules is None else rules, "threshold")
    rows = rule_ops._counted_rows(logs, active)
    counts = _seconds(rows, ["rule_id", "group_key", "threshold", "window"], delay, resolution, n=F.count("*"))
    return stream_fold(
        counts, keys=["rule_id", "group_key"], order="second", values=["n", "threshold", "window"],
        out=[("second", "bigint"), ("fires", "bigint"), ("first_second", "bigint")],
        step=rule_ops._count_and_clear, until=lambda held, row: row[0] + row[3], resolution=resolution)


def stream_alert_dedup(
    hits: DataFrame, *, window_seconds: int = 900, resolution: int = 3, delay: str = "10 seconds",
) -> DataFrame:
    """Findings with the alert they belong to, one row per alert and scan cycle; an alert is forgotten when its window has passed.

    Downstream sums ``event_count`` and takes the maxima per ``alert_uid``.
    """
    rows = _keyed(hits, resolution).withColumn("timestamp", F.col("seen_at"))
    keys = ["alert_key", "source", "rule_id", "src_ip", "attack_type", "http_path"]
    rows = rows.select(*keys, "timestamp", "event_count", "confidence")
    counts = _seconds(rows, keys, delay, resolution, events=F.sum(F.greatest("event_count", F.lit(1))),
                      conf=F.max("confidence"))
    base = anchored(window_seconds)

    def step(anchor, row):
        anchor, _ = base(anchor, row)
        return anchor, [(anchor, *row)]

    folded = stream_fold(
        counts, keys=keys, order="second", values=["events", "conf"],
        out=[("anchor", "bigint"), ("second", "bigint"), ("events", "bigint"), ("conf", "double")],
        step=step, until=lambda anchor, row: anchor + window_seconds, resolution=resolution)
    return folded.select(
        _uid(F.col("alert_key"), F.col("anchor") * 1_000_000).alias("alert_uid"), *keys[1:],
        from_micros(F.col("anchor") * 1_000_000).alias("created_at"),
        from_micros(F.col("second") * 1_000_000).alias("seen_at"),
        F.col("events").alias("event_count"), F.col("conf").alias("confidence"))


def stream_incidents(
    alerts: DataFrame, changes: DataFrame, *, window_seconds: int = 3600, sources: tuple[str, ...] = ("rule",), resolution: int = 1,
    delay: str = "10 seconds",
) -> DataFrame:
    """Alerts and the incident they open or attach to, one row per incident and second; the step is that of ``incident_escalation``.

    ``changes`` is the incident log of that function. Both inputs share one watermark, so an idle log holds nothing back, and a change must
    come within ``delay`` of newer alerts. What is known of an address is forgotten when no incident of it can take on alerts.
    Downstream sums ``alert_count`` and takes title and priority of the first row per ``incident_uid``.
    """
    change = F.struct((F.col("seq") if "seq" in changes.columns else F.lit(0)).cast("bigint").alias("seq"),
                      F.col("incident_uid").alias("uid"), "status")
    rows = _escalated(alerts, sources).select("_ip", F.col("created_at").alias("timestamp"), "_opener")
    done = changes.filter("status IS NOT NULL AND incident_uid IS NOT NULL").select(
        F.coalesce("src_ip", F.lit("")).alias("_ip"), F.col("changed_at").alias("timestamp"), change.alias("_change"))
    counts = _seconds(
        rows.unionByName(done, allowMissingColumns=True), ["_ip"], delay, resolution, n=F.count("_opener"),
        first=F.to_json(F.min("_opener")), changes=F.to_json(F.array_sort(F.collect_set("_change"))))
    base = incident_step(window_seconds, 1_000_000)

    def step(state, row):
        second, ip, n, first, log = row
        state, emitted = (state or (ip, [])), []
        if n:
            state, emitted = base(state, (second, 0, n, first, None, None))
        for c in json.loads(log):
            state, _ = base(state, (second, 1, 0, None, c["uid"], c["status"]))
        return state, emitted

    folded = stream_fold(
        # Spark gives columns that begin with an underscore to a processor under another name.
        counts.withColumnRenamed("_ip", "address").withColumn("ip", F.col("address")), keys=["address"], order="second",
        values=["ip", "n", "first", "changes"],
        out=[("anchor", "bigint"), ("second", "bigint"), ("alert_count", "bigint"), ("first", "string")], step=step,
        until=lambda state, row: max([h[1] + window_seconds for h in state[1]], default=row[0]), resolution=resolution)
    f = F.from_json("first", "severity string, title string, attack_type string, http_path string")
    return folded.withColumn("f", f).select(
        _uid(F.col("address"), F.col("anchor") * 1_000_000).alias("incident_uid"), F.nullif("address", F.lit("")).alias("src_ip"),
        from_micros(F.col("anchor") * 1_000_000).alias("created_at"), from_micros(F.col("second") * 1_000_000).alias("seen_at"), "alert_count",
        F.concat(F.lit("Auto-escalated: "), "f.title").alias("title"),
        F.when(F.col("f.severity") == "CRITICAL", "CRITICAL").otherwise("HIGH").alias("priority"))


def _first_time(seen, row):
    return True, ([] if seen else [row])


def stream_new_country(
    logs: DataFrame, *, cycle_seconds: int = 60, delay: str = "10 seconds", countries: list[str] | None = None,
) -> DataFrame:
    """First cycle of each watch-list country; known countries stay known."""
    rows = logs.filter(F.col("geo_country").isin(countries or behavior.WATCH_COUNTRIES)).select(
        "timestamp", "geo_country")
    counts = _seconds(rows, ["geo_country"], delay, cycle_seconds, n=F.count("*"))
    first = stream_fold(counts, keys=["geo_country"], order="second", values=["n"],
                        out=[("second", "bigint"), ("event_count", "bigint")], step=_first_time)
    return first.select("geo_country", from_micros(F.col("second") * 1_000_000).alias("cycle_start"), "event_count")


def stream_rate_limit(
    requests: DataFrame, *, limit: int = 100, window: int = 60, burst: int | None = None, burst_window: int = 5,
    block_seconds: int = 86400, delay: str = "10 seconds",
) -> DataFrame:
    """Admission per address and second on a live request stream; an address is forgotten when neither its counts nor a block can matter."""
    counts = _seconds(requests.select("timestamp", "client_ip"), ["client_ip"], delay, 1, n=F.count("*"))
    step = _admit(limit, window, limit // 2 if burst is None else burst, burst_window, block_seconds)
    out = stream_fold(
        counts, keys=["client_ip"], order="second", values=["n"],
        out=[("second", "bigint"), ("requests", "bigint"), ("accepted", "bigint"), ("rate_limited", "bigint"),
             ("burst_refused", "bigint"), ("blocked", "bigint")], step=step,
        until=lambda state, row: max(row[0] + max(window, burst_window), state[1] or 0))
    return out.withColumn("second", from_micros(F.col("second") * 1_000_000))


def stream_alert_feed(
    alerts: DataFrame, *, path: str, checkpoint: str, min_severity: str = "HIGH", trigger: dict | None = None,
) -> StreamingQuery:
    """Notification lines of new alerts, appended to a table batch by batch."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        _write_batch(alert_feed(batch, min_severity=min_severity), path, batch_id)

    return (alerts.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
