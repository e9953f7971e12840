"""Findings to alerts, alerts to incidents, and the tables an analyst reads."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions import severity as sev
from duskwatch.functions.times import floor_to, from_micros, micros
from duskwatch.operators import behavior, correlate, families, rules as rule_ops
from duskwatch.plans.fold import anchored, ordered_fold

# What a finding gets if its detector says nothing, by family.
FAMILY_DEFAULTS = {
    "rule": ("MEDIUM", 0.8),
    "threshold": ("MEDIUM", 0.7),
    "behavioral": ("MEDIUM", 0.7),
    "correlation": ("HIGH", 0.85),
}
ALERT_SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


def all_detections(parts: dict[str, list[DataFrame]]) -> DataFrame:
    """Union of detector findings, by family, with the family's defaults filled in."""
    out = None
    for family, frames in parts.items():
        default_severity, default_confidence = FAMILY_DEFAULTS[family]
        for frame in frames:
            given = F.upper(F.coalesce("severity", F.lit(default_severity)))
            part = (
                frame.drop("cycle_start")
                .withColumn("severity", F.when(given.isin(ALERT_SEVERITIES), given).otherwise("MEDIUM"))
                .withColumn("confidence", F.coalesce("confidence", F.lit(default_confidence)))
                .withColumn("event_count", F.coalesce("event_count", F.lit(1)))
            )
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def detect(
    logs: DataFrame, *, cycle: float = 60, signatures: list[dict] | None = None,
    thresholds: list[dict] | None = None, behavioral: bool = True, correlation: bool = True,
    limits: dict[str, dict] | None = None, across_cycles: bool = True,
) -> DataFrame:
    """Run the detectors over ``logs`` and return one table of findings.

    ``limits`` overrides parameters per detector, e.g. ``{"high_request_rate": {"threshold": 200}}``. Without
    ``across_cycles`` those are left out whose findings depend on more than the rows of a cycle (counters that clear and
    new countries), so that cycles can be worked off one by one.
    """
    limits = limits or {}

    def run(module, name):
        args = dict(limits.get(name, {}))
        if name != "high_risk_country_attacks":
            args.setdefault("cycle", cycle)
        return getattr(module, name)(logs, **args)

    parts = {"rule": [rule_ops.signature_hits(logs, signatures)]}
    if across_cycles:
        parts["threshold"] = [rule_ops.threshold_hits(rule_ops.threshold_reset(logs, thresholds))]
    shared: list[str] = []
    if behavioral:
        shared += ["high_request_rate", "high_block_rate", "multi_country_session", "scan_path_hits", "path_diversity",
                   "suspicious_agents"]
        alone = ("ip_burst", "high_risk_country_attacks", *(["new_watch_country"] if across_cycles else []))
        parts["behavioral"] = [run(behavior, n) for n in alone]
    if correlation:
        shared += ["multi_vector_ip", "coordinated_path", "session_multi_attack", "recon_exploit"]
        parts["correlation"] = [run(correlate, n) for n in ("session_escalation", "attack_burst")]
    if shared:
        # Its findings say everything themselves, so it does not matter whose defaults would fill them.
        parts.setdefault("behavioral", []).append(families.findings(logs, cycle=cycle, limits=limits, detectors=shared))
    return all_detections(parts)


ALERT_KEY = ["source", "rule_id", "src_ip", "attack_type", "http_path"]


def _keyed(hits: DataFrame, resolution: float) -> DataFrame:
    """Findings with the merge key of their alert and the cycle they were seen in."""
    rule = F.coalesce("rule_id", "source")
    key = F.sha2(F.to_json(F.struct("source", rule.alias("rule_id"), "src_ip", "attack_type", "http_path")), 256)
    return hits.withColumn("rule_id", rule).withColumn("alert_key", key).withColumn(
        "seen_us", micros(floor_to(F.col("seen_at"), resolution)))


def _uid(key: Column, us: Column) -> Column:
    return F.sha2(F.concat_ws("|", key, us.cast("string")), 256)


def alert_dedup(hits: DataFrame, *, window_seconds: int = 900, resolution: float = 3) -> DataFrame:
    """Merge findings with the same source, rule, address, attack and path.

    The window runs from the creation of the alert and does not grow as
    findings join; the first one after it opens the next alert. Findings of one
    scan cycle (``resolution`` seconds) share a creation time, so each key
    brings at most one row per cycle to the fold. Null is a key value of its
    own. An alert keeps the details of its first finding.
    """
    rows = _keyed(hits, resolution)
    first = F.struct(
        "seen_at", F.array_min("log_ids").alias("log_id"), "title", "severity", "session_id", "geo_country",
        "mitre_tactic", "mitre_technique", *ALERT_KEY)
    per_cycle = rows.groupBy("alert_key", "seen_us").agg(
        F.sum(F.greatest("event_count", F.lit(1))).alias("events"), F.max("confidence").alias("conf"),
        F.min(first).alias("first"), F.max("seen_at").alias("last"))
    values = ["events", "conf", "first", "last"]
    types = {f.name: f.dataType.simpleString() for f in per_cycle.schema}

    base = anchored(window_seconds * 1_000_000)

    def step(anchor, row):
        anchor, _ = base(anchor, row)
        return anchor, [(anchor, *row[1:])]

    anchors = ordered_fold(
        per_cycle, keys=["alert_key"], order=["seen_us"], values=values,
        out=[("anchor_us", "bigint"), *[(v, types[v]) for v in values]], step=step)
    merged = anchors.groupBy("alert_key", "anchor_us").agg(
        F.sum("events").alias("event_count"), F.max("conf").alias("confidence"),
        F.min("first").alias("f"), F.max("last").alias("last_seen"))
    return merged.select(
        _uid(F.col("alert_key"), F.col("anchor_us")).alias("alert_uid"),
        from_micros(F.col("anchor_us")).alias("created_at"), "last_seen", "event_count", "confidence",
        F.lit("NEW").alias("status"),
        F.col("f.title").alias("title"), F.col("f.severity").alias("severity"),
        F.col("f.source").alias("detection_source"), F.col("f.rule_id").alias("rule_id"),
        F.col("f.src_ip").alias("src_ip"), F.col("f.attack_type").alias("attack_type"),
        F.col("f.http_path").alias("http_path"), F.col("f.session_id").alias("session_id"),
        F.col("f.geo_country").alias("geo_country"), F.col("f.mitre_tactic").alias("mitre_tactic"),
        F.col("f.mitre_technique").alias("mitre_technique"))


def alert_members(hits: DataFrame, *, window_seconds: int = 900, resolution: float = 3) -> DataFrame:
    """Which logs belong to which alert, one row per pair.

    The long form of an alert's list of log ids: it has no upper size, so it is
    a table and not a column of the alert.
    """
    rows = _keyed(hits, resolution)
    steps = rows.select("alert_key", "seen_us").distinct()
    anchors = ordered_fold(
        steps, keys=["alert_key"], order=["seen_us"], values=[],
        out=[("seen_us", "bigint"), ("anchor_us", "bigint")], step=anchored(window_seconds * 1_000_000))
    ids = rows.select("alert_key", "seen_us", F.explode("log_ids").alias("log_id"))
    return ids.join(anchors, ["alert_key", "seen_us"]).select(
        _uid(F.col("alert_key"), F.col("anchor_us")).alias("alert_uid"), "log_id").distinct()


#: Statuses in which an incident takes on further alerts. Fixed values.
OPEN_STATUSES = ("NEW", "INVESTIGATING")


def _escalated(alerts: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    rows = alerts.filter(F.col("severity").isin("HIGH", "CRITICAL") & F.col("detection_source").isin(*sources))
    opener = F.struct("created_at", "alert_uid", "severity", "title", "attack_type", "http_path", "mitre_tactic", "mitre_technique")
    return rows.withColumn("_opener", opener).withColumn("_ip", F.coalesce("src_ip", F.lit("")))


def incident_step(width: int, unit: int = 1) -> Callable:
    """Fold step over the alerts and status changes of one address, in time order.

    Row layout: (time, kind, n, first, uid, status), where kind 0 is a step with ``n`` alerts, the first of which is ``first``, and
    kind 1 a change of the incident ``uid``; at one moment alerts come before changes. ``width`` is in the unit of time, of which
    ``unit`` microseconds make one. The state is the list of incidents that are still within their window, as [uid,
    opened at, open]; alerts attach to the oldest open one, or else open the next. Emits (anchor, time, n, first).
    """

    def step(state, row):
        (ip, held), (at, kind, n, first, uid, status) = state, row
        held = [h for h in held if at - h[1] <= width]
        if kind:
            held = [[h[0], h[1], status in OPEN_STATUSES] if h[0] == uid else h for h in held]
            return (ip, held), []
        anchor = next((h[1] for h in held if h[2]), None)
        if anchor is None:
            anchor = at
            held.append([hashlib.sha256(f"{ip}|{at * unit}".encode()).hexdigest(), at, True])
        return (ip, held), [(anchor, at, n, first)]

    return step


def _incident_rows(rows: DataFrame, changes: DataFrame | None, **kept: Column) -> DataFrame:
    """Steps of alerts, with ``kept`` aggregates, and status changes in the layout of ``incident_step``."""
    steps = rows.groupBy("_ip", micros(F.col("created_at")).alias("us")).agg(*[c.alias(k) for k, c in kept.items()])
    steps = steps.withColumns({"kind": F.lit(0), "seq": F.lit(0).cast("bigint"), "uid": F.lit(None).cast("string"), "status": F.lit(None).cast("string")})
    if changes is None:
        return steps
    found = changes.filter("status IS NOT NULL AND incident_uid IS NOT NULL").select(
        F.coalesce("src_ip", F.lit("")).alias("_ip"), micros(F.col("changed_at")).alias("us"),
        *[F.lit(None).cast(steps.schema[k].dataType).alias(k) for k in kept],
        F.lit(1).alias("kind"), (F.col("seq") if "seq" in changes.columns else F.lit(0)).cast("bigint").alias("seq"),
        F.col("incident_uid").alias("uid"), "status")
    return steps.unionByName(found)


def _incident_fold(rows: DataFrame, changes: DataFrame | None, window_seconds: int, **kept: Column) -> DataFrame:
    """(_ip, anchor_us, us, n, first) per step of alerts."""
    tagged = _incident_rows(rows, changes, **kept)
    base = incident_step(window_seconds * 1_000_000)
    order = ["us", "kind", "seq", "uid", "status"]

    def step(state, row):
        us, kind, _, uid, status, ip, n, first = row
        return base(state or (ip, []), (us, kind, n, first, uid, status))

    return ordered_fold(
        tagged.withColumn("ip", F.col("_ip")), keys=["_ip"], order=order, values=["ip", "n", "first"],
        out=[("anchor_us", "bigint"), ("us", "bigint"), ("n", "bigint"), ("first", tagged.schema["first"].dataType.simpleString())],
        step=step)


def incident_members(
    alerts: DataFrame, changes: DataFrame | None = None, *, window_seconds: int = 3600, sources: tuple[str, ...] = ("rule",)
) -> DataFrame:
    """Which alert belongs to which incident of ``incident_escalation``, one row per pair."""
    rows = _escalated(alerts, sources)
    anchors = _incident_fold(rows, changes, window_seconds, n=F.count("*"), first=F.lit(None).cast("string"))
    mine = rows.select("alert_uid", "_ip", micros(F.col("created_at")).alias("us"))
    return mine.join(anchors.select("_ip", "us", "anchor_us"), ["_ip", "us"]).select(
        "alert_uid", _uid(F.col("_ip"), F.col("anchor_us")).alias("incident_uid"))


def incident_escalation(
    alerts: DataFrame, changes: DataFrame | None = None, *, window_seconds: int = 3600, sources: tuple[str, ...] = ("rule",)
) -> DataFrame:
    """Incidents opened by HIGH and CRITICAL rule alerts, one per address and window.

    The first alert of an address opens an incident and gives it its priority; later ones within the window from
    that moment attach to it as long as it is NEW or INVESTIGATING. ``changes`` is the log of what analysts did, with
    ``incident_uid``, ``src_ip``, ``status``, ``changed_at`` and maybe ``seq``: an alert after an incident was closed or mitigated
    opens the next one, and one that is taken up again takes alerts again, the oldest open one first. A change at the moment
    of an alert comes after it; of several changes of one incident at one moment the last by ``seq``, then by name, counts;
    changes of unknown incidents do nothing.
    """
    rows = _escalated(alerts, sources)
    folded = _incident_fold(rows, changes, window_seconds, n=F.count("*"), first=F.min("_opener"))
    merged = folded.groupBy("_ip", "anchor_us").agg(
        F.sum("n").alias("alert_count"), F.min("first").alias("f"), F.max("us").alias("last_us"))
    return _incidents(merged)


def _incidents(merged: DataFrame) -> DataFrame:
    def listed(c: Column) -> Column:
        return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.array(c))

    return merged.select(
        _uid(F.col("_ip"), F.col("anchor_us")).alias("incident_uid"),
        F.concat(F.lit("Auto-escalated: "), "f.title").alias("title"),
        F.lit("NEW").alias("status"),
        F.when(F.col("f.severity") == "CRITICAL", "CRITICAL").otherwise("HIGH").alias("priority"),
        from_micros(F.col("anchor_us")).alias("created_at"),
        from_micros(F.col("last_us")).alias("last_alert_at"), "alert_count",
        listed(F.nullif("_ip", F.lit(""))).alias("affected_ips"), listed(F.col("f.http_path")).alias("affected_paths"),
        listed(F.col("f.attack_type")).alias("attack_types"), listed(F.col("f.mitre_tactic")).alias("mitre_tactics"),
        listed(F.col("f.mitre_technique")).alias("mitre_techniques"))


def alert_groups(alerts: DataFrame, *, window_minutes: int = 15) -> DataFrame:
    """Alerts of one address, attack, path and time bucket as one line, newest first."""
    rank = sev.rank(F.col("severity"))
    first = F.coalesce("first_seen", "created_at")
    last = F.coalesce("last_seen", "created_at")
    keyed = alerts.select(
        F.coalesce("src_ip", F.lit("unknown")).alias("src_ip"),
        F.coalesce("attack_type", F.lit("OTHER")).alias("attack_type"),
        F.coalesce("http_path", F.lit("-")).alias("http_path"),
        floor_to(F.coalesce("created_at", "first_seen"), window_minutes * 60).alias("group_window"),
        rank.alias("rank"), first.alias("first"), last.alias("last"), "id",
        F.coalesce("event_count", F.lit(1)).alias("events"), "detection_source", "mitre_technique")
    return keyed.groupBy("src_ip", "attack_type", "http_path", "group_window").agg(
        F.count("*").alias("alert_count"), F.sum("events").alias("total_events"),
        sev.from_rank(F.max("rank")).alias("highest_severity"),
        F.max_by("id", F.struct("last", -F.col("id"))).alias("primary_alert_id"),
        F.min("first").alias("first_seen"), F.max("last").alias("last_seen"),
        F.array_sort(F.collect_set("detection_source")).alias("detection_sources"),
        F.array_sort(F.collect_set("mitre_technique")).alias("mitre_techniques"),
    ).orderBy(F.desc("last_seen"), "src_ip", "attack_type", "http_path")


def alert_stats(alerts: DataFrame, *, newest: int = 5) -> DataFrame:
    """Total and counts by severity, status and attack type, plus the newest critical alerts.

    One scan with grouping sets; rows are (kind, value, alerts).
    """
    s, t, a = F.col("severity"), F.col("status"), F.col("attack_type")
    counts = alerts.groupingSets([[s], [t], [a], []], s, t, a).agg(
        F.count("*").alias("alerts"), F.grouping_id().alias("g"))
    kind = (F.when(F.col("g") == 3, "severity").when(F.col("g") == 5, "status")
            .when(F.col("g") == 6, "attack_type").otherwise("total"))
    stats = counts.select(
        kind.alias("kind"), F.coalesce("severity", "status", "attack_type").alias("value"), "alerts",
    ).filter("kind = 'total' or value is not null")
    recent = (
        alerts.filter(s == "CRITICAL").orderBy(F.desc("created_at"), F.desc("id")).limit(newest)
        .select(F.lit("recent_critical").alias("kind"), F.col("id").cast("string").alias("value"),
                F.lit(1).cast("bigint").alias("alerts")))
    return stats.unionByName(recent)


def incident_rollup(incidents: DataFrame, alerts: DataFrame, notes: DataFrame) -> DataFrame:
    """Incidents with the number of their alerts and notes."""
    a = alerts.filter("incident_id is not null").groupBy("incident_id").agg(F.count("*").alias("alert_count"))
    n = notes.groupBy("incident_id").agg(F.count("*").alias("note_count"))
    return (
        incidents.join(a, incidents.id == a.incident_id, "left").drop("incident_id")
        .join(n, incidents.id == n.incident_id, "left").drop("incident_id")
        .withColumn("alert_count", F.coalesce("alert_count", F.lit(0)))
        .withColumn("note_count", F.coalesce("note_count", F.lit(0))))


def incident_timeline(incidents: DataFrame, alerts: DataFrame, notes: DataFrame) -> DataFrame:
    """Creation, alerts and notes of every incident as one list of events in order."""
    created = incidents.select(
        F.col("id").alias("incident_id"), F.col("created_at").alias("timestamp"),
        F.lit("incident_created").alias("event_type"),
        F.concat(F.lit("Incident created: "), "title").alias("summary"),
        F.lit(None).cast("string").alias("detail"))
    linked = alerts.filter("incident_id is not null").select(
        "incident_id", F.col("created_at").alias("timestamp"), F.lit("alert").alias("event_type"),
        F.concat(F.lit("Alert: "), "title").alias("summary"),
        F.concat(F.lit("Severity: "), "severity", F.lit(", Source: "), "detection_source").alias("detail"))
    written = notes.select(
        "incident_id", F.col("created_at").alias("timestamp"), F.col("note_type").alias("event_type"),
        F.substring("content", 1, 128).alias("summary"), F.col("content").alias("detail"))
    return created.unionByName(linked).unionByName(written).orderBy(
        "incident_id", "timestamp", "event_type", "summary")


def latest_state(
    changes: DataFrame, fields: list[str], stamps: dict[str, list[str]], *, key: str = "entity_id"
) -> DataFrame:
    """Current state from a change log: the last value written to each field.

    ``stamps`` names a time column and the statuses that set it. A field left
    null by a change keeps its value, so each one folds by itself and the whole
    is a single aggregate.
    """
    order = F.struct("changed_at", "seq")
    last = [F.max_by(f, F.when(F.col(f).isNotNull(), order)).alias(f) for f in fields]
    times = [F.max(F.when(F.col("status").isin(values), F.col("changed_at"))).alias(n)
             for n, values in stamps.items()]
    return changes.groupBy(key).agg(
        *last, *times, F.max("changed_at").alias("updated_at"), F.count("*").alias("changes"))


# Fields that changes write, and the statuses that set a time.
ALERT_STATE = {"fields": ["status", "assigned_to", "incident_id"], "stamps": {"resolved_at": ["RESOLVED", "FALSE_POSITIVE"]}}
INCIDENT_STATE = {"fields": ["status", "priority", "assigned_to"], "stamps": {"resolved_at": ["MITIGATED"], "closed_at": ["CLOSED"]}}


def alert_state(changes: DataFrame) -> DataFrame:
    return latest_state(changes, **ALERT_STATE)


def incident_state(changes: DataFrame) -> DataFrame:
    return latest_state(changes, **INCIDENT_STATE)


def alert_feed(alerts: DataFrame, *, min_severity: str = "HIGH") -> DataFrame:
    """Notification lines for alerts at or above a severity."""
    keep = sev.rank(F.col("severity")) >= sev.rank(F.lit(min_severity))
    attack = F.upper(F.regexp_replace(F.coalesce("attack_type", F.lit("activity")), "_", " "))
    parts = F.concat_ws(
        " • ", F.coalesce("http_path", F.lit("/")), F.coalesce("src_ip", F.lit("unknown")), "geo_country")
    return alerts.filter(keep).select(
        "alert_uid", "created_at", F.upper("severity").alias("severity"),
        F.concat(F.upper("severity"), F.lit(": "), attack).alias("notification_title"),
        parts.alias("message"))
