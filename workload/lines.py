"""Log lines rendered from the derived logs, in the three input formats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workload import tables as T

ATTACK_WORDS = {"SQLI": "sqli", "XSS": "xss", "RCE": "remote code", "LFI": "lfi", "BRUTE_FORCE": "brute force",
                "PORT_SCAN": "nmap", "DDOS": "flood", "BOT": "crawler"}
ACTION_WORDS = {"BLOCKED": "denied", "ALLOWED": "permitted", "RATE_LIMITED": "throttled"}


def raw_json(spark, sf) -> DataFrame:
    """Field names and time formats vary by id; every hundredth line is broken."""
    logs = T.logs(spark, sf, shared=True)
    t, i = F.col("timestamp"), F.col("id")

    def render(when: str, names: dict[str, str], **extra) -> F.Column:
        cols = [F.date_format(t, when).alias(names.get("timestamp", "timestamp"))]
        for c in ("src_ip", "dst_ip", "action", "http_method", "http_path", "http_status", "http_user_agent",
                  "attack_type", "severity", "confidence", "session_id"):
            value = extra.get(c, F.col(c))
            cols.append(value.alias(names.get(c, c)))
        cols.append((i % 70000).alias("src_port"))
        return F.to_json(F.struct(*cols))

    plain = render("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", {})
    second = render("yyyy-MM-dd HH:mm:ss", {
        "timestamp": "ts", "src_ip": "source_ip", "dst_ip": "server_ip", "action": "verdict", "http_method": "method",
        "http_path": "uri", "http_status": "status_code", "http_user_agent": "ua", "attack_type": "category"},
        action=F.lower(F.replace("action", F.lit("_"), F.lit(" "))),
        attack_type=F.lower(F.replace("attack_type", F.lit("_"), F.lit("-"))), severity=F.lower("severity"))
    third = render("dd/MMM/yyyy:HH:mm:ss '+0000'", {
        "timestamp": "@timestamp", "src_ip": "remote_addr", "dst_ip": "destination_ip", "action": "decision",
        "http_method": "request_method", "http_path": "request_uri", "http_status": "status",
        "http_user_agent": "user_agent", "attack_type": "threat_type"})
    line = F.when(i % 100 == 0, F.lit('{"ts": broken')).when(i % 3 == 0, plain).when(i % 3 == 1, second).otherwise(third)
    return logs.select(line.alias("line"))


def raw_syslog(spark, sf) -> DataFrame:
    """RFC 5424 for even ids, RFC 3164 for odd ones, bare text for every hundredth."""
    logs = T.logs(spark, sf, shared=True)
    t, i = F.col("timestamp"), F.col("id")
    kv = F.concat(
        F.lit("action="), "action", F.lit(" src="), "src_ip", F.lit(' dst="'), "dst_ip", F.lit('", method='),
        "http_method", F.lit(" uri="), "http_path", F.lit(" status="), F.col("http_status").cast("string"),
        F.lit(' agent="'), "http_user_agent", F.lit('" attack='), "attack_type", F.lit(" severity="), "severity")
    new = F.concat(F.lit("<134>1 "), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
                   F.lit(" fw01 waf 99 ID47 - "), kv)
    old = F.concat(F.lit("<134>"), F.date_format(t, "MMM "), F.lpad(F.dayofmonth(t).cast("string"), 2, " "),
                   F.date_format(t, " HH:mm:ss"), F.lit(" fw01 waf[12]: "), kv)
    bare = F.concat(F.lit("Connection from "), "src_ip", F.lit(" to "), "dst_ip", F.lit(" port 443 closed"))
    return logs.select(F.when(i % 100 == 0, bare).when(i % 2 == 0, new).otherwise(old).alias("line"))


def raw_text(spark, sf) -> DataFrame:
    logs = T.logs(spark, sf, shared=True)

    def word(table: dict[str, str], c: str) -> F.Column:
        expr = F.lit("")
        for k, v in table.items():
            expr = F.when(F.col(c) == k, v).otherwise(expr)
        return expr

    return logs.select(F.concat_ws(
        " ", "http_method", "http_path", F.col("http_status").cast("string"), F.lit("from"), "src_ip", F.lit("to"),
        "dst_ip", word(ACTION_WORDS, "action"), word(ATTACK_WORDS, "attack_type")).alias("line"))
