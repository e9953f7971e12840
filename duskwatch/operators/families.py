"""All findings that are counted per address, path or session, from shared passes.

The detectors of ``behavior`` and ``correlate`` each read the logs on their own. Run
together, those of one key are predicates over one aggregate, and the log ids of all findings come from
one more pass over the rows of the keys that were found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions.text import any_rlike
from duskwatch.operators import behavior as B
from duskwatch.operators import correlate as C
from duskwatch.operators.hits import as_hits
from duskwatch.plans.kept import kept
from duskwatch.plans.tiles import first_n

#: The detectors that share the passes, and how many log ids a finding of each lists at most.
MOST_IDS = {
    "high_request_rate": 50, "high_block_rate": 50, "scan_path_hits": 30, "path_diversity": 30, "suspicious_agents": 1,
    "multi_vector_ip": 50, "recon_exploit": 50, "coordinated_path": 50, "session_multi_attack": 30, "multi_country_session": 20,
}
_NO_KEY = "\u0000"
#: Findings whose keys are sent to every task.
LISTED = 200_000


def _rows(logs: DataFrame, cycle: float | None, limits: dict[str, dict]) -> DataFrame:
    paths = limits.get("scan_path_hits", {}).get("paths") or B.SCAN_PATHS
    agents = limits.get("suspicious_agents", {}).get("agents") or B.SUSPICIOUS_AGENTS
    return B.in_cycles(logs, cycle).select(
        "cycle_start", "timestamp", "id", "src_ip", "session_id", "http_path", "attack_type", "geo_country",
        (F.col("attack_type") != "NONE").alias("attack"), (F.col("action") == "BLOCKED").alias("blocked"),
        F.col("http_path").rlike(any_rlike(paths)).alias("scan"), F.col("http_user_agent").rlike(any_rlike(agents)).alias("tool"),
        (F.col("http_path") != "").alias("path"), (F.col("geo_country") != "").alias("country"), F.lit(True).alias("every"))


def _hit(detector: str, test: Column, subset: str, **values) -> Column:
    """A finding as a struct, null where ``test`` does not hold; ``subset`` names the rows that make it."""
    named = {k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()}
    types = {"title": "string", "severity": "string", "attack_type": "string", "event_count": "bigint", "seen_at": "timestamp_ntz",
             "src_ip": "string", "http_path": "string", "confidence": "double", "source": "string", "mitre_tactic": "string",
             "mitre_technique": "string"}
    return F.when(F.coalesce(test, F.lit(False)), F.struct(
        F.lit(detector).alias("detector"), F.lit(subset).alias("subset"),
        *[named.get(k, F.lit(None)).cast(t).alias(k) for k, t in types.items()]))


def _found(frame: DataFrame, family: str, key: str, hits: list[Column]) -> DataFrame:
    listed = F.filter(F.array(*hits), lambda h: h.isNotNull())
    return frame.select("cycle_start", F.lit(family).alias("family"), F.coalesce(key, F.lit(_NO_KEY)).alias("key"),
                        F.explode(listed).alias("hit"))


def address_findings(rows: DataFrame, limits: dict[str, dict]) -> DataFrame:
    at = F.struct("timestamp", "id")
    kind = F.col("attack_type")
    per_path = rows.groupBy("cycle_start", "src_ip", "http_path").agg(
        F.count("*").alias("every"), F.max("timestamp").alias("last_every"),
        *[f for c in ("blocked", "scan", "attack") for f in (
            F.count_if(F.col(c)).alias(c), F.max(F.when(F.col(c), F.col("timestamp"))).alias(f"last_{c}"))],
        F.collect_set(F.when(F.col("attack"), kind)).alias("kinds"),
        F.max(kind.isin(C.RECON)).alias("recon"), F.max(kind.isin(C.EXPLOIT)).alias("exploit"),
        F.min(F.when(F.col("tool"), at)).alias("tool"))
    named = F.col("http_path") != ""
    per_ip = per_path.groupBy("cycle_start", "src_ip").agg(
        *[f for c in ("every", "blocked", "scan", "attack") for f in (F.sum(c).alias(c), F.max(f"last_{c}").alias(f"last_{c}"))],
        F.count_if(named).alias("paths"), F.max(F.when(named, F.col("last_every"))).alias("last_path"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("kinds"),
        F.max("recon").alias("recon"), F.max("exploit").alias("exploit"), F.min("tool").alias("tool"))

    def limit(name: str, default: int, key: str = "threshold") -> int:
        return limits.get(name, {}).get(key, default)

    c, ip = F.col, F.col("src_ip")
    rate = limit("high_request_rate", 120)
    found = _found(per_ip, "ip", "src_ip", [
        _hit("high_request_rate", c("every") >= rate, "every", source="behavioral.rate", src_ip=ip,
             title=F.concat(F.lit("High request rate from "), ip), severity=F.when(c("every") > 2 * rate, "HIGH").otherwise("MEDIUM"),
             attack_type="DDOS", event_count=c("every"), seen_at=c("last_every"),
             confidence=F.round(F.least(F.lit(0.95), 0.5 + (c("every") / rate) * 0.3), 6), mitre_tactic="Impact", mitre_technique="T1498"),
        _hit("high_block_rate", c("blocked") >= limit("high_block_rate", 20), "blocked", source="behavioral.rate", src_ip=ip,
             title=F.concat(F.lit("High block rate for "), ip), severity="HIGH", attack_type="BRUTE_FORCE", event_count=c("blocked"),
             seen_at=c("last_blocked"), confidence=0.8, mitre_tactic="Credential Access", mitre_technique="T1110"),
        _hit("scan_path_hits", c("scan") >= limit("scan_path_hits", 5), "scan", source="behavioral.pattern", src_ip=ip,
             title=F.concat(F.lit("Directory enumeration from "), ip), severity="HIGH", attack_type="PORT_SCAN", event_count=c("scan"),
             seen_at=c("last_scan"), confidence=0.85, mitre_tactic="Discovery", mitre_technique="T1083"),
        _hit("path_diversity", c("paths") >= limit("path_diversity", 50), "path", source="behavioral.pattern", src_ip=ip,
             title=F.concat(F.lit("High path diversity from "), ip), severity="MEDIUM", attack_type="PORT_SCAN",
             event_count=c("paths"), seen_at=c("last_path"), confidence=0.7, mitre_tactic="Reconnaissance", mitre_technique="T1595"),
        _hit("suspicious_agents", c("tool").isNotNull(), "tool", source="behavioral.pattern", src_ip=ip,
             title=F.concat(F.lit("Suspicious tool detected: "), ip), severity="HIGH", attack_type="BOT", event_count=1,
             seen_at=c("tool.timestamp"), confidence=0.9, mitre_tactic="Reconnaissance", mitre_technique="T1595"),
        _hit("multi_vector_ip", F.size("kinds") >= limit("multi_vector_ip", 3), "attack", source="correlation.ip", src_ip=ip,
             title=F.concat(F.lit("Multi-vector attack from "), ip, F.lit(": "), F.array_join("kinds", ", ")), severity="CRITICAL",
             attack_type="OTHER", event_count=c("attack"), seen_at=c("last_attack"), confidence=0.9,
             mitre_tactic="Initial Access", mitre_technique="T1190"),
        _hit("recon_exploit", c("recon") & c("exploit"), "attack",
             source="correlation.time", src_ip=ip, title=F.concat(F.lit("Recon and exploit chain from "), ip), severity="CRITICAL",
             attack_type="OTHER", event_count=c("attack"), seen_at=c("last_attack"), confidence=0.9,
             mitre_tactic="Initial Access", mitre_technique="T1190"),
    ])
    # Recon with exploit counts only in busy cycles; the totals are one row per cycle.
    busy = per_ip.groupBy("cycle_start").agg(F.sum("attack").alias("n")).filter(
        F.col("n") >= limit("recon_exploit", 10, "min_attacks")).select("cycle_start")
    chain = F.col("hit.detector") == "recon_exploit"
    return found.filter(~chain).unionByName(found.filter(chain).join(busy, "cycle_start", "left_semi"))


def path_findings(rows: DataFrame, limits: dict[str, dict]) -> DataFrame:
    per_ip = rows.filter("attack and path").groupBy("cycle_start", "http_path", "src_ip").agg(
        F.count("*").alias("n"), F.max("timestamp").alias("last"))
    per_path = per_ip.groupBy("cycle_start", "http_path").agg(
        F.count("*").alias("sources"), F.sum("n").alias("n"), F.max("last").alias("last"), F.min("src_ip").alias("src_ip"))
    return _found(per_path, "path", "http_path", [
        _hit("coordinated_path", F.col("sources") >= limits.get("coordinated_path", {}).get("threshold", 5), "attack",
             source="correlation.ip", src_ip=F.col("src_ip"), http_path=F.col("http_path"),
             title=F.concat(F.lit("Coordinated attack on "), F.substring("http_path", 1, 64), F.lit(" from "),
                            F.col("sources").cast("string"), F.lit(" addresses")),
             severity="CRITICAL", attack_type="OTHER", event_count=F.col("n"), seen_at=F.col("last"), confidence=0.85,
             mitre_tactic="Initial Access", mitre_technique="T1190")])


def session_findings(rows: DataFrame, limits: dict[str, dict]) -> DataFrame:
    at = F.struct("timestamp", "id")
    placed = F.col("country")
    per = rows.filter("session_id <> ''").groupBy("cycle_start", "session_id").agg(
        F.count("*").alias("n"), F.max("timestamp").alias("last"), F.min_by("src_ip", at).alias("src_ip"),
        F.array_sort(F.collect_set(F.when(F.col("attack"), F.col("attack_type")))).alias("kinds"),
        F.size(F.collect_set(F.when(placed, F.col("geo_country")))).alias("countries"), F.count_if(placed).alias("placed"),
        F.max(F.when(placed, F.col("timestamp"))).alias("last_placed"),
        F.min_by("src_ip", F.when(placed, at)).alias("placed_ip"))
    multi = limits.get("session_multi_attack", {})
    return _found(per, "session", "session_id", [
        _hit("session_multi_attack", (F.col("n") >= multi.get("min_rows", 2)) & (F.size("kinds") >= multi.get("threshold", 2)), "every",
             source="correlation.session", src_ip=F.col("src_ip"), severity="HIGH", attack_type="OTHER",
             title=F.concat(F.lit("Session multi-attack: "), F.array_join("kinds", ", ")), event_count=F.col("n"),
             seen_at=F.col("last"), confidence=0.8, mitre_tactic="Lateral Movement", mitre_technique="T1078"),
        _hit("multi_country_session", F.col("countries") >= limits.get("multi_country_session", {}).get("threshold", 3), "country",
             source="behavioral.geo", src_ip=F.col("placed_ip"), severity="HIGH", title="Multi-country session anomaly",
             event_count=F.col("placed"), seen_at=F.col("last_placed"), confidence=0.85,
             mitre_tactic="Defense Evasion", mitre_technique="T1090")])


def findings(logs: DataFrame, *, cycle: float | None, limits: dict[str, dict], detectors: list[str]) -> DataFrame:
    """Hits of ``detectors`` (names of ``MOST_IDS``): three aggregates and one pass for the log ids.

    The findings are computed first and kept. Log rows are reduced to their keys inside the tasks that read them and
    trimmed there to as many as a finding lists, so what is shuffled does not grow with a busy key. If there are more
    keys than ``LISTED``, rows are trimmed for all keys instead and meet the findings afterwards.
    """
    rows = _rows(logs, cycle, limits)
    found = address_findings(rows, limits).unionByName(path_findings(rows, limits)).unionByName(session_findings(rows, limits))
    found = kept(found.filter(F.col("hit.detector").isin(detectors)))
    key = ["cycle_start", "family", "key"]
    wanted = found.groupBy(*key).agg(F.collect_set("hit.subset").alias("wanted"))
    flags = ("every", "blocked", "scan", "path", "tool", "attack", "country")
    subsets = F.array_compact(F.array(*[F.when(F.col(f), F.lit(f)) for f in flags]))
    keys = F.array(*[F.struct(F.lit(f).alias("family"), F.coalesce(F.col(k), F.lit(_NO_KEY)).alias("key"))
                     for f, k in (("ip", "src_ip"), ("path", "http_path"), ("session", "session_id"))])
    keyed = rows.select("cycle_start", "timestamp", "id", subsets.alias("subsets"), F.explode(keys).alias("k")).select(
        "cycle_start", "timestamp", "id", "subsets", "k.*")
    if found.count() <= LISTED:
        keyed = keyed.join(F.broadcast(wanted), key).withColumn("subsets", F.array_intersect("subsets", "wanted"))  # at most LISTED rows
    each = keyed.select(*key, "timestamp", "id", F.explode("subsets").alias("subset"))
    capped = first_n(each, [*key, "subset"], ["timestamp", "id"], max(MOST_IDS.values()))
    ids = capped.groupBy(*key, "subset").agg(F.array_sort(F.collect_list(F.struct("timestamp", "id"))).alias("_ids"))
    most = F.try_element_at(F.create_map(*[F.lit(x) for pair in MOST_IDS.items() for x in pair]), F.col("hit.detector"))
    listed = found.withColumn("subset", F.col("hit.subset")).join(ids, [*key, "subset"]).withColumn(
        "log_ids", F.transform(F.slice("_ids", F.lit(1), most), lambda s: s["id"]))
    return as_hits(
        listed.select("cycle_start", "log_ids", "family", "key", "hit.*"), rule_id=F.col("source"),
        session_id=F.when(F.col("family") == "session", F.col("key")))
