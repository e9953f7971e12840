"""Playbooks, planned responses and the state of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions.times import at, ends_at, from_micros, micros, plus_seconds
from duskwatch.plans.fold import ordered_fold

# Short action names and the defensive ones among them.
ACTION_NAMES = {"block_ip": "IP_BLOCK", "rate_limit": "RATE_LIMIT", "temp_ban": "TEMP_BAN",
                "geo_block": "GEO_BLOCK"}
DEFENSIVE = ["IP_BLOCK", "RATE_LIMIT", "TEMP_BAN", "GEO_BLOCK"]


def _pb(id: str, name: str, severity: str, attacks: list[str], cooldown: int, *actions: dict) -> dict:
    trigger: dict = {"severity": [severity]}
    if attacks:
        trigger["attack_type"] = attacks
    return {"id": id, "name": name, "active": True, "cooldown_seconds": cooldown, "trigger": trigger,
            "actions": list(actions)}


def _block(minutes: int) -> dict:
    return {"action": "block_ip", "duration_seconds": minutes * 60}


def _limit(per_minute: int, minutes: int) -> dict:
    return {"action": "rate_limit", "duration_seconds": minutes * 60, "rate_limit_rps": per_minute}


def _note(message: str) -> dict:
    return {"action": "notify", "channel": "log", "message": message}


_INCIDENT, _TAG, _ESCALATE = {"action": "create_incident"}, {"action": "tag_ioc"}, {"action": "escalate"}

# The default playbooks.
PLAYBOOKS = [
    _pb("pb-critical-autoblock", "Critical Attack Auto-Block", "CRITICAL", [], 300, _block(1440), _INCIDENT,
        _note("CRITICAL: IP {src_ip} auto-blocked for 24h — {attack_type} attack")),
    _pb("pb-sqli-response", "SQL Injection Response", "HIGH", ["SQLI"], 600, _block(480), _INCIDENT, _TAG,
        _note("SQLi attack from {src_ip} blocked for 8h")),
    _pb("pb-xss-response", "XSS Attack Response", "HIGH", ["XSS"], 600, _limit(5, 60), _INCIDENT,
        _note("XSS attack from {src_ip} — rate limited to 5 req/min")),
    _pb("pb-rce-emergency", "RCE Emergency Lockdown", "HIGH", ["RCE"], 60, _block(4320), _INCIDENT, _ESCALATE,
        _note("EMERGENCY RCE attempt from {src_ip} — blocked 72h, escalated to admin")),
    _pb("pb-brute-force", "Brute Force Mitigation", "HIGH", ["BRUTE_FORCE"], 900, _limit(2, 30),
        {"action": "temp_ban", "duration_seconds": 7200}, _INCIDENT,
        _note("Brute force from {src_ip}: rate-limited + temp banned 2h")),
    _pb("pb-ddos-mitigation", "DDoS Attack Mitigation", "CRITICAL", ["DDOS"], 120, _block(2880), _INCIDENT,
        _ESCALATE, _note("DDoS from {src_ip} blocked for 48h — {event_count} events detected")),
    _pb("pb-port-scan", "Port Scan Response", "MEDIUM", ["PORT_SCAN"], 600, _block(240), _INCIDENT, _TAG,
        _note("Port scan from {src_ip} — blocked 4h")),
    _pb("pb-ssrf-response", "SSRF Attack Response", "HIGH", ["SSRF"], 300, _block(1440), _INCIDENT, _ESCALATE,
        _note("SSRF attack from {src_ip} — blocked 24h, escalated")),
    _pb("pb-medium-alert-log", "Medium Severity Logging", "MEDIUM", [], 1800, _INCIDENT,
        _note("Medium-severity {attack_type} from {src_ip} — incident created")),
]


def trigger(conditions: dict) -> Column:
    """Trigger of a playbook as a predicate on alerts; a missing key matches all."""
    expr = F.lit(True)
    if "severity" in conditions:
        expr = expr & F.col("severity").isin(conditions["severity"])
    if "attack_type" in conditions:
        expr = expr & F.col("attack_type").isin(conditions["attack_type"])
    if "event_count_gte" in conditions:
        expr = expr & (F.col("event_count") >= conditions["event_count_gte"])
    if "detection_source" in conditions:
        sources = conditions["detection_source"]
        any_source = F.lit(False)
        for s in [sources] if isinstance(sources, str) else sources:
            any_source = any_source | F.contains(F.col("detection_source"), F.lit(s))
        expr = expr & any_source
    return F.coalesce(expr, F.lit(False))


def playbook_matches(alerts: DataFrame, playbooks: list[dict] | None = None) -> DataFrame:
    """Alerts and the active playbooks they trigger.

    Playbooks are configuration, so their triggers become predicates of one
    projection and no join is needed.
    """
    books = [p for p in (PLAYBOOKS if playbooks is None else playbooks) if p.get("active", True)]
    tests = F.array(*[
        F.when(trigger(p.get("trigger", {})), F.struct(
            F.lit(i).alias("playbook_no"), F.lit(p["id"]).alias("playbook_id"), F.lit(p["name"]).alias("playbook")))
        for i, p in enumerate(books)])
    return alerts.withColumn("_p", F.explode(F.filter(tests, lambda x: x.isNotNull()))).select(
        *alerts.columns, "_p.*")


def _actions(spark, playbooks: list[dict] | None) -> DataFrame:
    books = [p for p in (PLAYBOOKS if playbooks is None else playbooks) if p.get("active", True)]
    rows = [
        (i, j, ACTION_NAMES.get(a["action"], a["action"]), a.get("duration_seconds"), a.get("rate_limit_rps"),
         a.get("channel"), a.get("message"))
        for i, p in enumerate(books) for j, a in enumerate(p.get("actions", [])) if a.get("action")]
    return spark.createDataFrame(
        rows, "playbook_no int, action_no int, action string, duration_seconds bigint, rate_limit_rps int, "
              "channel string, message string")


def playbook_runs(alerts: DataFrame, playbooks: list[dict] | None = None) -> DataFrame:
    """Playbook executions: a playbook rests ``cooldown_seconds`` per address after it ran.

    Alerts of one second and address count as one trigger, that of the lowest id, except for playbooks
    without a rest, which run for every alert.
    """
    books = [p for p in (PLAYBOOKS if playbooks is None else playbooks) if p.get("active", True)]
    cooldowns = {i: p.get("cooldown_seconds") or 0 for i, p in enumerate(books)}
    matched = playbook_matches(alerts, playbooks)
    restless = F.col("playbook_no").isin([i for i, c in cooldowns.items() if not c])
    steps = matched.groupBy(
        "src_ip", "playbook_no", "playbook_id", F.floor(micros(F.col("created_at")) / 1_000_000).alias("second"),
        F.when(restless, F.col("id")).alias("_each")).agg(F.min("id").alias("alert_id"))

    def step(last, row):
        second, no, pid, alert = row
        if last is not None and second - last < cooldowns[no]:
            return last, []
        return second, [(second, pid, alert)]

    # The playbook number is part of the key and rides along as a value for its cooldown.
    return ordered_fold(
        steps.withColumn("no", F.col("playbook_no")), keys=["src_ip", "playbook_no"], order=["second"],
        values=["no", "playbook_id", "alert_id"],
        out=[("second", "bigint"), ("playbook_id", "string"), ("alert_id", "bigint")], step=step)


def response_plan(alerts: DataFrame, playbooks: list[dict] | None = None) -> DataFrame:
    """Responses to start: defensive actions of the runs, unless one is still active.

    Per action and address a new response starts only when none is running; one
    without a duration runs on. Of several in one second the first playbook
    action counts.
    """
    runs = playbook_runs(alerts, playbooks)
    actions = _actions(alerts.sparkSession, playbooks).filter(F.col("action").isin(DEFENSIVE))
    wanted = runs.join(F.broadcast(actions), "playbook_no")
    pick = F.struct("playbook_no", "action_no", "playbook_id", "alert_id", "duration_seconds", "rate_limit_rps")
    steps = wanted.groupBy("src_ip", "action", "second").agg(F.min(pick).alias("p")).select(
        "src_ip", "action", "second", "p.*")

    def step(until, row):
        second, pid, alert, duration, rate = row
        if until is not None and second < until:
            return until, []
        end = second + duration if duration else None
        return (float("inf") if end is None else end), [(second, pid, alert, duration, rate, end)]

    started = ordered_fold(
        steps, keys=["src_ip", "action"], order=["second"],
        values=["playbook_id", "alert_id", "duration_seconds", "rate_limit_rps"],
        out=[("second", "bigint"), ("playbook_id", "string"), ("alert_id", "bigint"),
             ("duration_seconds", "bigint"), ("rate_limit_rps", "int"), ("end_second", "bigint")], step=step)
    return started.select(
        "action", F.col("src_ip").alias("target_ip"), "playbook_id", "alert_id", "duration_seconds",
        "rate_limit_rps", from_micros(F.col("second") * 1_000_000).alias("created_at"),
        from_micros(F.col("end_second") * 1_000_000).alias("expires_at"))


def playbook_notices(alerts: DataFrame, playbooks: list[dict] | None = None) -> DataFrame:
    """What the non-defensive actions of matched playbooks say: messages, escalations, unknowns."""
    matched = playbook_matches(alerts, playbooks).select(
        F.col("id").alias("alert_id"), "playbook_no", "playbook", "severity", "src_ip", "attack_type",
        "event_count", "title")
    actions = _actions(alerts.sparkSession, playbooks).filter(~F.col("action").isin(DEFENSIVE))
    rows = matched.join(F.broadcast(actions), "playbook_no")
    text = F.coalesce("message", F.lit("{severity} alert from {src_ip}: {title}"))
    fills = {"severity": (F.col("severity"), "UNKNOWN"), "src_ip": (F.col("src_ip"), "unknown"),
             "attack_type": (F.col("attack_type"), "unknown"),
             "event_count": (F.col("event_count").cast("string"), "0"), "title": (F.col("title"), "")}
    for name, (value, missing) in fills.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(value, F.lit(missing)))
    a = F.col("action")
    channel = F.coalesce("channel", F.lit("soc"))
    return rows.select(
        "alert_id", "playbook", "action",
        F.when(a == "notify", "sent").when(a == "escalate", "done").otherwise("unknown_action").alias("status"),
        F.when(a == "notify", F.concat(F.upper(channel), F.lit(" notification: "), "playbook"))
        .alias("notification_title"),
        F.when(a == "notify", text).alias("message"))


def response_status(responses: DataFrame, *, now: str) -> DataFrame:
    """State of every response that exists at ``now``; one without an end stays active until it is revoked."""
    t = at(now)
    running = ends_at(F.col("expires_at"), F.col("revoked_at")) > t
    status = F.when(running, "ACTIVE").when(F.col("revoked_at") <= t, "REVOKED").otherwise("EXPIRED")
    return responses.filter(F.col("created_at") <= t).withColumn("status", status)


def active_responses(responses: DataFrame, *, now: str) -> DataFrame:
    """Running responses, newest first."""
    return response_status(responses, now=now).filter("status = 'ACTIVE'").orderBy(
        F.desc("created_at"), F.desc("block_id"))


def pending_blocks(blocks: DataFrame, *, now: str, block_seconds: int = 86400) -> DataFrame:
    """Latest block per address at ``now``: reason, expiry, attempts so far, blocked today."""
    t = at(now)
    latest = blocks.filter(F.col("created_at") <= t).groupBy("ip").agg(
        F.max(F.struct("created_at", "block_id", "reason", "reason_type")).alias("b"),
        F.count("*").alias("attempts"))
    return latest.select(
        "ip", F.col("b.reason").alias("reason"), F.col("b.reason_type").alias("reason_type"),
        F.col("b.created_at").alias("blocked_at"),
        plus_seconds(F.col("b.created_at"), block_seconds).alias("expires_at"), "attempts",
        (F.to_date("b.created_at") == F.to_date(t)).alias("is_today"))
