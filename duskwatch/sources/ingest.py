"""Log lines in three formats to canonical rows.

Every parser takes a frame (batch or stream) with one ``line`` column and adds
``ok``: lines that cannot be read stay in the frame with ``ok = false``, so the
caller writes them to a quarantine table and counts them. "Now" is a parameter;
it stands in where a line carries no usable time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions import net
from duskwatch.functions import severity as sev
from duskwatch.functions.times import at
from duskwatch.operators.enrich import geo_enrich, mitre_enrich
from duskwatch.schema import ACTIONS, ATTACK_TYPES, LOGS, PROTOCOLS, SEVERITIES

# Other names of a log field in JSON records.
JSON_ALIASES = {
    "timestamp": ["ts", "time", "@timestamp", "event_time", "log_time"],
    "src_ip": ["source_ip", "client_ip", "remote_addr", "attacker_ip"],
    "src_port": ["source_port", "client_port"],
    "dst_ip": ["destination_ip", "server_ip"],
    "dst_port": ["destination_port", "server_port"],
    "http_method": ["method", "request_method"],
    "http_path": ["uri", "path", "request_uri", "url"],
    "http_status": ["status_code", "response_code", "status"],
    "http_user_agent": ["user_agent", "ua"],
    "http_host": ["host"],
    "http_referer": ["referer", "referrer"],
    "action": ["verdict", "decision", "rule_action"],
    "attack_type": ["threat_type", "category", "classification"],
    "attack_signature": ["signature"],
    "matched_rule": ["rule_name", "rule_matched"],
    "payload_snippet": ["payload"],
    "dns_query": ["query", "dns_name"],
    "dns_response": ["response"],
}

# Other names of a log field in key=value text.
KV_ALIASES = {
    "src_ip": ["src", "source", "srcip", "client"],
    "dst_ip": ["dst", "dest", "dstip", "server"],
    "src_port": ["srcport", "sport"],
    "dst_port": ["dstport", "dport"],
    "protocol": ["proto"],
    "action": ["verdict"],
    "http_method": ["method"],
    "http_path": ["uri", "path", "url"],
    "http_status": ["status"],
    "http_user_agent": ["ua", "agent"],
    "attack_type": ["attack", "threat", "category"],
    "matched_rule": ["rule"],
}

# Words that tell the action and the attack in free text, in order.
ACTION_WORDS = [
    ("BLOCKED", r"\b(block|blocked|deny|denied|reject|rejected|drop|dropped)\b"),
    ("ALLOWED", r"\b(allow|allowed|permit|permitted|pass|accept|accepted)\b"),
    ("RATE_LIMITED", r"\b(rate.?limit|throttle|throttled)\b"),
]
ATTACK_WORDS = [
    ("SQLI", r"\b(sql.?inject|sqli|union.?select|or.?1\s*=\s*1)\b"),
    ("XSS", r"\b(xss|cross.?site.?script|<script)\b"),
    ("RCE", r"\b(rce|remote.?code|command.?exec|cmd.?inject)\b"),
    ("LFI", r"\b(lfi|local.?file|path.?traversal|\.\.\/)\b"),
    ("BRUTE_FORCE", r"\b(brute.?force|login.?fail|auth.?fail)\b"),
    ("PORT_SCAN", r"\b(port.?scan|nmap|syn.?scan)\b"),
    ("DDOS", r"\b(ddos|flood|volumetric)\b"),
    ("BOT", r"\b(bot|crawler|spider|scraper)\b"),
]

# Not read from a line but set by the pipeline.
_SET_LATER = {"id", "received_at", "tier", "source_format", "ingestion_pipeline", "timestamp", "raw_log",
              "geo_country", "geo_city", "geo_lat", "geo_lon", "geo_asn"}
_FIELDS = [f for f in LOGS if f.name not in _SET_LATER]


def _typed(values: dict[str, Column]) -> list[Column]:
    out = []
    for f in _FIELDS:
        c = values.get(f.name, F.lit(None).cast("string"))
        out.append((c if f.dataType.simpleString() == "string" else c.try_cast(f.dataType)).alias(f.name))
    return out


def parse_time(text: Column) -> Column:
    """A time in one of the usual spellings, null for any other text.

    ISO (T or space; date alone; fraction and zone optional), seconds or milliseconds since 1970, the
    web-server log format, mail headers, and ``TIME_FORMATS``.
    """
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?|$)"), text.try_cast("timestamp"))
    number = F.when(text.rlike(r"^\d{9,10}(\.\d+)?$"), text.cast("double") * 1e6).when(
        text.rlike(r"^\d{12,13}$"), text.cast("double") * 1e3)
    web = F.when(text.rlike(r"^\d{2}/[A-Za-z]{3}/\d{4}:"),
                 F.try_to_timestamp(text, F.lit("dd/MMM/yyyy:HH:mm:ss Z")))
    # Names of days say nothing that the date does not; zones by name are the few of mail headers.
    plain = F.regexp_replace(F.regexp_replace(text, r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun),?\s+", ""), r"\s*(GMT|UTC|Z)$", " +0000")
    plain = F.regexp_replace(plain, r"\s+", " ")
    zoned = F.when(plain.rlike(r"[+-]\d{4}$"), plain).otherwise(F.concat(plain, F.lit(" +0000")))
    others = [F.when(text.rlike(shape), F.try_to_timestamp(zoned, F.lit(f"{pattern} Z"))) for shape, pattern in TIME_FORMATS]
    return F.coalesce(iso, F.timestamp_micros(number.cast("bigint")), web, *others).cast("timestamp_ntz")


#: Shapes of other spellings and their patterns; a zone may follow.
TIME_FORMATS = [
    (r"^([A-Za-z]{3}, )?\d{1,2} [A-Za-z]{3} \d{4} \d{1,2}:\d{2}:\d{2}", "d MMM yyyy H:mm:ss"),
    (r"^([A-Za-z]{3} )?[A-Za-z]{3} +\d{1,2},? \d{4} \d{1,2}:\d{2}:\d{2}", "MMM d[,] yyyy H:mm:ss"),
    (r"^([A-Za-z]{3} )?[A-Za-z]{3} +\d{1,2} \d{1,2}:\d{2}:\d{2} \d{4}", "MMM d H:mm:ss yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2}", "yyyy/M/d H:mm:ss"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}", "M/d/yyyy H:mm:ss"),
]


def parse_json_lines(lines: DataFrame, *, now: str) -> DataFrame:
    """JSON objects, one per line, with the usual spellings of the field names.

    If a record has a field under several names, its canonical name counts,
    else the first alias. Not an object, a confidence that is no number or a time that cannot
    be read: not ok. Only a record without a time gets ``now``.
    """
    names = {f.name: [f.name, *JSON_ALIASES.get(f.name, [])] for f in _FIELDS}
    names["timestamp"] = ["timestamp", *JSON_ALIASES["timestamp"]]
    names["raw_log"] = ["raw_log"]
    every = sorted({n for group in names.values() for n in group})
    # One generator reads all names in a single pass over the text.
    rows = lines.select("*", F.json_tuple("line", *every).alias(*[f"_j{i}" for i in range(len(every))]))
    position = {n: f"_j{i}" for i, n in enumerate(every)}

    def field(name: str) -> Column:
        return F.coalesce(*[F.col(position[n]) for n in names[name]])

    values = {f.name: field(f.name) for f in _FIELDS}
    values["action"] = F.replace(F.upper(values["action"]), F.lit(" "), F.lit("_"))
    values["attack_type"] = F.regexp_replace(F.upper(values["attack_type"]), "[ -]", "_")
    values["severity"] = F.upper(values["severity"])
    values["protocol"] = F.upper(values["protocol"])
    conf = values["confidence"]
    is_object = F.ltrim("line").startswith("{") & F.try_parse_json("line").isNotNull()
    written = F.nullif(F.trim(field("timestamp")), F.lit(""))
    time = parse_time(written)
    ok = is_object & (conf.isNull() | conf.try_cast("double").isNotNull()) & (written.isNull() | time.isNotNull())
    return rows.select(
        "line", F.coalesce(ok, F.lit(False)).alias("ok"),
        F.coalesce(time, at(now)).alias("timestamp"), *_typed(values),
        F.coalesce(field("raw_log"), F.col("line")).alias("raw_log"),
        F.lit(None).cast("string").alias("ingestion_pipeline"))


RFC5424 = r"^<(\d+)>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(?:\[.*?\]|-)\s*(.*)"
RFC3164 = r"^<(\d+)>(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s+(.*)"
KEY_VALUE = r'(\w+)="?([^"\s,]+)"?'


def parse_syslog_lines(lines: DataFrame, *, now: str) -> DataFrame:
    """RFC 5424, RFC 3164 or bare text with ``key=value`` pairs.

    The last spelling of a field wins. Without a source address the first two
    addresses of the text are taken, else ``0.0.0.0``. Times without a year get
    the year of ``now``.
    """
    line = F.col("line")
    year = str(now)[:4]
    new, old = line.rlike(RFC5424), line.rlike(RFC3164)
    stamp = F.regexp_extract("line", RFC3164, 2)
    dated = F.concat(F.lit(year + " "), F.regexp_replace(stamp, r"\s+", " "))
    rows = lines.withColumn(
        "_kind", F.when(new, "syslog_rfc5424").when(old, "syslog_rfc3164").otherwise("syslog_raw")
    ).withColumn(
        "_msg", F.when(F.col("_kind") == "syslog_rfc5424", F.regexp_extract("line", RFC5424, 8))
        .when(F.col("_kind") == "syslog_rfc3164", F.regexp_extract("line", RFC3164, 6)).otherwise(line)
    ).withColumn(
        "_time", F.when(F.col("_kind") == "syslog_rfc5424", parse_time(F.regexp_extract("line", RFC5424, 3)))
        .when(F.col("_kind") == "syslog_rfc3164",
              F.try_to_timestamp(dated, F.lit("yyyy MMM d HH:mm:ss")).cast("timestamp_ntz"))
    ).withColumn(
        "_kv", F.arrays_zip(
            F.transform(F.regexp_extract_all("_msg", F.lit(KEY_VALUE), F.lit(1)), F.lower).alias("k"),
            F.regexp_extract_all("_msg", F.lit(KEY_VALUE), F.lit(2)).alias("v"))
    ).withColumn("_ips", F.regexp_extract_all("_msg", F.lit(net.IPV4_ANYWHERE), F.lit(1)))

    def field(name: str) -> Column:
        spellings = [name, *KV_ALIASES.get(name, [])]
        found = F.filter("_kv", lambda p: p["k"].isin(spellings))
        return F.try_element_at(found, F.lit(-1))["v"]

    values = {f.name: field(f.name) for f in _FIELDS}
    src = values["src_ip"]
    ips = F.col("_ips")
    values["dst_ip"] = F.coalesce(F.when(src.isNull(), F.get(ips, F.lit(1))), values["dst_ip"])
    values["src_ip"] = F.coalesce(src, F.get(ips, F.lit(0)), F.lit("0.0.0.0"))
    return rows.select(
        "line", F.lit(True).alias("ok"), F.coalesce("_time", at(now)).alias("timestamp"), *_typed(values),
        F.col("line").alias("raw_log"), F.col("_kind").alias("ingestion_pipeline"))


def _first_word(table: list[tuple[str, str]], default: str) -> Column:
    expr = F.lit(default)
    for name, pattern in reversed(table):
        expr = F.when(F.col("line").rlike("(?i)" + pattern), name).otherwise(expr)
    return expr


def parse_raw_lines(lines: DataFrame, *, now: str) -> DataFrame:
    """Free text: addresses, method, path, status and the words that tell action and attack."""
    verbs = "GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS"
    rows = lines.withColumn(
        "_ips", F.regexp_extract_all("line", F.lit(net.IPV4_ANYWHERE), F.lit(1))
    ).withColumn("_attack", _first_word(ATTACK_WORDS, "NONE"))

    def found(pattern: str) -> Column:
        return F.nullif(F.regexp_extract("line", pattern, 1), F.lit(""))

    attack = F.col("_attack")
    values = {
        "src_ip": F.coalesce(F.get("_ips", F.lit(0)), F.lit("0.0.0.0")), "dst_ip": F.get("_ips", F.lit(1)),
        "http_method": F.upper(found(rf"(?i)\b({verbs}|CONNECT|TRACE)\b")),
        "http_path": found(rf"(?i)(?:{verbs})\s+(\S+)"), "http_status": found(r"\b([1-5]\d{2})\b"),
        "action": _first_word(ACTION_WORDS, "ALLOWED"), "attack_type": attack,
        "severity": F.when(attack.isin("SQLI", "RCE", "LFI"), "HIGH").when(attack != "NONE", "MEDIUM")
        .otherwise("INFO"),
    }
    return rows.select(
        "line", F.lit(True).alias("ok"), at(now).alias("timestamp"), *_typed(values),
        F.col("line").alias("raw_log"), F.lit("raw_text").alias("ingestion_pipeline"))


PARSERS = {"json": parse_json_lines, "syslog": parse_syslog_lines, "raw": parse_raw_lines}


def normalise(parsed: DataFrame) -> DataFrame:
    """Defaults, trimmed and shortened text, clamped numbers, checked enumerations."""
    def trimmed(name: str) -> Column:
        return F.trim(F.nullif(F.col(name), F.lit("")))

    def port(name: str) -> Column:
        return F.when(F.col(name).between(0, 65535), F.col(name))

    fixed = {
        "src_ip": F.coalesce(trimmed("src_ip"), F.lit("0.0.0.0")), "dst_ip": trimmed("dst_ip"),
        "payload_snippet": F.substring("payload_snippet", 1, 2048),
        "http_user_agent": F.substring("http_user_agent", 1, 1024),
        "http_method": F.substring(F.upper("http_method"), 1, 10),
        "confidence": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence"))),
        "src_port": port("src_port"), "dst_port": port("dst_port"),
        "protocol": sev.known_or(F.coalesce("protocol", F.lit("HTTP")), PROTOCOLS, "OTHER"),
        "action": sev.known_or(F.coalesce("action", F.lit("ALLOWED")), ACTIONS, "ALLOWED"),
        "severity": sev.known_or(F.coalesce("severity", F.lit("INFO")), SEVERITIES, "INFO"),
        "attack_type": sev.known_or(F.coalesce("attack_type", F.lit("NONE")), ATTACK_TYPES, "NONE"),
    }
    fixed["confidence"] = F.when(F.col("confidence").isNotNull(), fixed["confidence"])
    return parsed.withColumns(fixed)


def canonical_logs(
    parsed: DataFrame, *, source_format: str, received_at: str | Column, geo_ranges: DataFrame | None = None,
    batch: Column | str | int | None = None,
) -> DataFrame:
    """Parsed rows to canonical log rows: normalised, located, tagged, ready to append.

    Without ``geo_ranges`` locations stay null, for streams that are located
    when they are read.
    """
    # Equal lines are rows of their own, so the place in the input is part of the id, and so is ``batch``, which names this
    # input among others that are appended to one table (a micro-batch, a load); without it the time of receipt does. The place is
    # taken before any shuffle: a task that runs again gives the same ids.
    received = received_at if isinstance(received_at, Column) else at(received_at)
    batch = received if batch is None else batch if isinstance(batch, Column) else F.lit(batch)
    rows = normalise(parsed.filter("ok").withColumn("_place", F.monotonically_increasing_id()))
    rows = rows.withColumn("id", F.xxhash64(
        "raw_log", "timestamp", "src_ip", "_place", batch.cast("string"), F.lit(source_format))).drop("_place")
    # ATT&CK goes by the attack as written; unknown spellings map to nothing.
    rows = mitre_enrich(rows).drop("technique_name")
    for c in ("geo_country", "geo_city", "geo_asn"):
        rows = rows.withColumn(c, F.lit(None).cast("string"))
    for c in ("geo_lat", "geo_lon"):
        rows = rows.withColumn(c, F.lit(None).cast("double"))
    if geo_ranges is not None:
        rows = geo_enrich(rows, geo_ranges)
    rows = rows.withColumns({
        "received_at": received, "source_format": F.lit(source_format), "tier": F.lit("hot")})
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in LOGS])


def quarantine(parsed: DataFrame) -> DataFrame:
    """Lines that could not be read."""
    return parsed.filter(~F.col("ok")).select("line")


def ingest_report(parsed: dict[str, DataFrame]) -> DataFrame:
    """Accepted and rejected lines per format."""
    out = None
    for fmt, frame in parsed.items():
        part = frame.groupBy(F.lit(fmt).alias("source_format"),
                             F.when(F.col("ok"), "accepted").otherwise("rejected").alias("status")).agg(
            F.count("*").alias("lines"))
        out = part if out is None else out.unionByName(part)
    return out


def append_logs(logs: DataFrame, path: str) -> None:
    """Append to the log table, laid out by tier and day, so that time filters and ageing prune files."""
    logs.withColumn("day", F.to_date("timestamp")).write.mode("append").partitionBy("tier", "day").parquet(path)
