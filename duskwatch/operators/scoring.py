"""Heuristic risk score of a request and what is derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions import severity as sev
from duskwatch.functions.prefilter import groups, possible
from duskwatch.functions.text import html_unescape, matches, url_decode
from duskwatch.plans.settle import settle

# Payload patterns by class and how much a class weighs.
PAYLOAD_PATTERNS = {
    "sql_injection": [
        r"(?:union\s+select|select\s+.*\s+from|insert\s+into|delete\s+from|update\s+.*\s+set)",
        r"(?:or\s+1\s*=\s*1|and\s+1\s*=\s*1|or\s+'1'\s*=\s*'1'|or\s+\"1\"\s*=\s*\"1\")",
        r"(?:'\s*or\s*'[^']+'\s*=\s*'[^']+'|\"\s*or\s*\"[^\"]+\"\s*=\s*\"[^\"]+\")",
        r"(?:drop\s+table|truncate\s+table|alter\s+table|create\s+table)",
        r"(?:exec\s*\(|execute\s*\(|sp_executesql|xp_cmdshell)",
        r"(?:concat\s*\(|char\s*\(|substring\s*\(|benchmark\s*\()",
        r"(?:sleep\s*\(\s*\d|waitfor\s+delay|pg_sleep)",
        r"(?:information_schema|mysql\.|sys\.)",
        r"(?:load_file|into\s+outfile|into\s+dumpfile)",
        r"(?:--|#|/\*)\s*(?:union|select|or|and|waitfor|sleep|benchmark)",
    ],
    "xss": [
        r"<script[^>]*>", r"javascript\s*:", r"on(?:load|error|click|mouse|focus|blur|submit)\s*=",
        r"<iframe[^>]*>", r"<img[^>]*\s+onerror\s*=", r"document\.(?:cookie|write|location)",
        r"window\.(?:location|open)", r"eval\s*\(", r"<svg[^>]*\s+onload\s*=", r"data\s*:\s*text/html",
        r"(?:srcdoc\s*=|expression\s*\(|innerhtml\s*=|outerhtml\s*=)",
    ],
    "path_traversal": [
        r"\.\./", r"\.\.\\", r"%2e%2e[%/\\]", r"/etc/passwd", r"/etc/shadow", r"c:\\windows", r"\\windows\\",
        r"boot\.ini", r"win\.ini",
    ],
    "command_injection": [
        r"(?:;|&&|\|\|?|\n)\s*(?:ls|cat|id|whoami|pwd|uname|curl|wget|bash|sh|cmd|powershell)\b",
        r"\$\([^)]+\)", r"`[^`]+`", r"(?:cmd(?:\.exe)?\s*/c|powershell(?:\.exe)?\b)", r"(?:wget|curl)\s+https?://",
        r"/bin/(?:sh|bash|zsh|ksh)", r"nc\s+-[elvp]", r"python\s+-c", r"perl\s+-e", r"php\s+-r",
    ],
    "ssrf": [
        r"(?:localhost|127\.0\.0\.1|0\.0\.0\.0)", r"(?:169\.254\.\d+\.\d+)", r"(?:http://\d+\.\d+\.\d+\.\d+)",
        r"(?:file://)", r"(?:gopher://)", r"(?:dict://)", r"(?:metadata\.google\.internal|host\.docker\.internal)",
    ],
}
CLASS_WEIGHTS = {"sql_injection": 1.0, "xss": 0.9, "path_traversal": 0.95, "command_injection": 1.0, "ssrf": 0.9}
SENSITIVE_ENDPOINTS = [
    r"/admin", r"/wp-admin", r"/login", r"/api/v\d+/(?:users|tokens|keys|secrets)",
    r"/\.(?:git|env|htaccess|htpasswd)", r"/phpmyadmin", r"/config\.", r"/backup", r"/debug", r"/shell", r"/cmd",
    r"/exec",
]
RISKY_PARAMS = ["id", "user", "username", "admin", "token", "redirect", "url", "next", "file", "path", "cmd", "exec",
                "password", "key"]
RISKY_VALUES = r"\.\./|<script|union select|https?://"

# User agent markers.
SCANNERS = ["sqlmap", "nikto", "nessus", "nmap", "masscan", "acunetix", "burpsuite", "owasp", "dirbuster",
            "gobuster", "wfuzz", "hydra", "nuclei", "metasploit", "havij", "arachni", "skipfish"]
AUTOMATION = ["curl", "wget", "python-requests", "httpx", "axios", "node-fetch", "go-http-client", "java/"]
LEGIT_BOTS = ["googlebot", "bingbot", "slurp", "duckduckbot", "baiduspider"]

# Score of a detected threat type.
THREAT_SCORES = {
    "sql_injection": 1.0, "command_injection": 1.0, "ldap_injection": 0.95, "xml_injection": 0.9,
    "xpath_injection": 0.9, "template_injection": 0.95, "ssti": 0.95, "nosql_injection": 0.95,
    "code_injection": 1.0, "xss_attempt": 0.9, "stored_xss": 0.95, "reflected_xss": 0.85, "dom_xss": 0.85,
    "csrf": 0.85, "clickjacking": 0.7, "path_traversal": 0.95, "directory_traversal": 0.95, "lfi": 0.95,
    "rfi": 0.98, "file_upload": 0.9, "unrestricted_file_upload": 0.95, "rce": 1.0, "remote_code_execution": 1.0,
    "deserialization": 0.95, "unsafe_deserialization": 0.95, "auth_bypass": 0.95, "authentication_bypass": 0.95,
    "session_hijacking": 0.9, "session_fixation": 0.85, "credential_stuffing": 0.8, "brute_force": 0.75,
    "password_spray": 0.75, "ssrf": 0.95, "xxe": 0.95, "xml_bomb": 0.9, "billion_laughs": 0.9,
    "ddos_attack": 0.85, "slowloris": 0.8, "syn_flood": 0.85, "udp_flood": 0.8, "http_flood": 0.85,
    "amplification_attack": 0.9, "header_injection": 0.8, "crlf_injection": 0.8, "host_header_injection": 0.85,
    "http_response_splitting": 0.85, "http_smuggling": 0.9, "directory_listing": 0.6,
    "sensitive_data_exposure": 0.7, "information_disclosure": 0.65, "path_disclosure": 0.6,
    "error_disclosure": 0.5, "bot_attack": 0.7, "web_scraping": 0.5, "automated_scan": 0.6,
    "vulnerability_scan": 0.7, "scanner_detected": 0.7, "api_abuse": 0.75, "excessive_data_exposure": 0.7,
    "broken_authentication": 0.9, "broken_access_control": 0.85, "mass_assignment": 0.8,
    "security_misconfiguration": 0.7, "rate_limit_exceeded": 0.6, "resource_exhaustion": 0.75, "zip_bomb": 0.8,
    "regex_dos": 0.75, "privilege_escalation": 0.95, "idor": 0.85, "forced_browsing": 0.7,
    "parameter_tampering": 0.75, "blocked_ip": 0.8, "suspicious_behavior": 0.7, "malicious_payload": 0.85,
    "backdoor_attempt": 0.95, "webshell": 0.98, "crypto_mining": 0.9,
}
THREAT_MARKERS = [("injection|rce|webshell", 0.9), ("xss|csrf|ssrf|xxe|traversal", 0.85),
                  ("scan|bot|scrap|brute", 0.65), ("rate|flood|dos", 0.7)]


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def with_variants(df: DataFrame, source: str, name: str) -> DataFrame:
    """Up to three forms of a text, ``name0`` to ``name2``: as is and after decoding.

    Null if there is no such form or it repeats an earlier one.
    """
    def cleaned(c: Column) -> Column:
        return F.nullif(F.trim(F.translate(c, "\u0000", " ")), F.lit(""))

    raw = F.col(source)
    df = df.withColumn(f"{name}_r1", F.when(raw.rlike("[%+&]"), html_unescape(url_decode(raw))))
    df = df.withColumn(f"{name}_r1", F.when(F.col(f"{name}_r1") != raw, F.col(f"{name}_r1")))
    r1 = F.col(f"{name}_r1")
    df = df.withColumn(f"{name}_r2", F.when(r1.rlike("[%+&]"), html_unescape(url_decode(r1))))
    r2 = F.when(F.col(f"{name}_r2") != r1, F.col(f"{name}_r2"))
    df = df.withColumn(f"{name}0", cleaned(raw)).withColumn(f"{name}1", cleaned(r1)).withColumn(f"{name}2", cleaned(r2))
    v0, v1, v2 = (F.col(f"{name}{i}") for i in range(3))
    same1 = F.coalesce(v1 == v0, F.lit(False))
    same2 = F.coalesce(v2 == v0, F.lit(False)) | F.coalesce(v2 == v1, F.lit(False))
    df = df.withColumn(f"{name}2", F.when(~same2, v2)).withColumn(f"{name}1", F.when(~same1, v1))
    return df.drop(f"{name}_r1", f"{name}_r2")


def with_query_profile(df: DataFrame, source: str = "url", name: str = "_u") -> DataFrame:
    """Add encoding depth, parameter counts and special-character share of a URL."""
    df = with_variants(df, source, name)
    forms = [F.col(f"{name}{i}") for i in range(3)]
    depth = F.greatest(sum((f.isNotNull().cast("int") for f in forms), F.lit(0)) - 1, F.lit(0))
    last = F.coalesce(*reversed(forms), F.col(source), F.lit(""))
    df = df.withColumn("_query", F.regexp_extract(last, r"^[^?#]*\?([^#]*)", 1))
    params = F.filter(F.split("_query", "&"), lambda p: p != "")
    df = df.withColumn("_params", params)

    def risky(p: Column) -> Column:
        key = F.lower(url_decode(F.substring_index(p, "=", 1)))
        value = F.when(F.contains(p, F.lit("=")), F.lower(url_decode(F.regexp_extract(p, r"^[^=]*=([\s\S]*)$", 1)))
                       ).otherwise("")
        return key.isin(RISKY_PARAMS) | value.rlike(RISKY_VALUES)

    special = F.length(F.regexp_replace("_query", r"[\p{L}\p{N}]", ""))
    return df.withColumns({
        "encoded_depth": depth, "param_count": F.size("_params"),
        "high_risk_params": F.size(F.filter("_params", risky)),
        "special_ratio": F.when(F.length("_query") > 0, special / F.length("_query")).otherwise(0.0),
    })


PROFILE = ["encoded_depth", "param_count", "high_risk_params", "special_ratio"]


def query_profile(urls: DataFrame, *, url: str = "url") -> DataFrame:
    """URL features of every row."""
    out = with_query_profile(urls, url)
    return out.select(*urls.columns, *PROFILE[:3], F.round("special_ratio", 6).alias("special_ratio"))


def query_profile_by_host(urls: DataFrame, *, url: str = "url") -> DataFrame:
    """How the URL features spread per host."""
    host = F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))
    return query_profile(urls, url=url).groupBy(host.alias("host")).agg(
        F.count("*").alias("urls"), F.count_if(F.col("param_count") > 0).alias("with_query"),
        F.sum("high_risk_params").alias("high_risk_params"), F.max("encoded_depth").alias("max_depth"),
        F.round(F.avg("special_ratio"), 6).alias("avg_special_ratio"))


def _literal(words: list[str]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def agent_class(ua: Column) -> tuple[Column, Column]:
    """Class and score of a user agent."""
    low = F.lower(ua)
    rules = [
        (ua.isNull() | (ua == ""), "missing", 0.3), (low.rlike(_literal(SCANNERS)), "scanner", 0.95),
        (low.rlike(_literal(AUTOMATION)), "automation", 0.6),
        (low.rlike("bot|crawler|spider") & low.rlike(_literal(LEGIT_BOTS)), "legit_bot", 0.1),
        (low.rlike("bot|crawler|spider"), "unknown_bot", 0.7), (F.length(ua) < 10, "minimal", 0.5),
    ]
    kind, score = F.lit("browser"), F.lit(0.0)
    for test, name, value in reversed(rules):
        kind, score = F.when(test, name).otherwise(kind), F.when(test, value).otherwise(score)
    return kind, score


def agent_classes(requests: DataFrame) -> DataFrame:
    """Requests, addresses and score per class of user agent."""
    kind, score = agent_class(F.col("user_agent"))
    return requests.groupBy(kind.alias("agent_class"), score.alias("score")).agg(
        F.count("*").alias("requests"), F.count_distinct("client_ip").alias("ips"))


def _matches(texts: Column, regexes: list[str], first: int) -> Column:
    """How many patterns match one of the lower-case texts, looked for only where ``_may`` has their group, from place ``first`` on, possible."""
    def hit(patterns: list[str]) -> Column:
        return F.exists(texts, lambda t: matches(t, patterns, lowered=True))

    found = F.lit(0)
    for i, some in enumerate(groups(regexes), first):
        hits = F.array(*[hit([p]) for p in some])
        found = found + F.when(F.when(F.col("_may")[i], hit(some)), F.size(F.filter(hits, lambda x: x))).otherwise(0)
    return found


def heuristic_score(
    requests: DataFrame, *, payload_patterns: dict[str, list[str]] | None = None
) -> DataFrame:
    """Risk score, confidence, severity and risk factors of each request.

    Reads url, body, method, user_agent, threat_type, ddos_score, blacklisted
    and, if present, the headers map. Payload, agent, context, flood and
    deny-list evidence support a detected threat, or stand in for one.
    """
    patterns = PAYLOAD_PATTERNS if payload_patterns is None else payload_patterns
    given = requests.columns
    rows = with_query_profile(requests.withColumn("_url", F.coalesce("url", F.lit(""))), "_url")
    rows = with_variants(rows.withColumn("_body", F.coalesce("body", F.lit(""))), "_body", "_b")
    names = ["_u0", "_u1", "_u2", "_b0", "_b1", "_b2"]
    forms = F.array(*[F.lower(c) for c in names])
    rows = settle(rows, {"_texts": F.array_distinct(F.filter(forms, lambda t: t.isNotNull()))})
    texts = F.col("_texts")
    tests = [(list(range(len(names))), p) for p in patterns.values()]
    rows = rows.withColumn("_may", possible(
        [*[F.lower(c) for c in names], F.lower("_url")], [*tests, ([len(names)], SENSITIVE_ENDPOINTS)]))
    first, classes = 0, {}
    for c, p in patterns.items():
        classes[c] = F.least(F.lit(1.0), _matches(texts, p, first) * F.lit(0.22))
        first += len(groups(p))
    rows = rows.withColumns({f"_c_{c}": v for c, v in classes.items()})
    depth, risky, ratio = F.col("encoded_depth"), F.col("high_risk_params"), F.col("special_ratio")
    abuse = F.greatest(
        F.when(depth >= 2, _clamp(0.2 + depth * 0.15)).otherwise(0.0),
        F.when(ratio > 0.35, 0.2).otherwise(0.0), F.when(risky >= 2, 0.25).otherwise(0.0))
    low = F.lower("_url")
    method = F.upper(F.coalesce("method", F.lit("GET")))
    headers = F.lit("")
    if "headers" in given:
        looked_at = ["host", "referer", "origin", "x-forwarded-for", "x-original-url", "x-rewrite-url", "cookie"]
        headers = F.concat_ws(" ", *[F.try_element_at("headers", F.lit(h)) for h in looked_at])
    kind, agent = agent_class(F.col("user_agent"))
    threat = F.lower(F.coalesce("threat_type", F.lit("none")))
    table = F.create_map(*[F.lit(x) for pair in THREAT_SCORES.items() for x in pair])
    guess = F.lit(0.5)
    for words, value in reversed(THREAT_MARKERS):
        guess = F.when(threat.rlike(words), value).otherwise(guess)
    ddos = F.coalesce(F.col("ddos_score").cast("double"), F.lit(0.0)) if "ddos_score" in given else F.lit(0.0)
    denied = F.coalesce("blacklisted", F.lit(False)) if "blacklisted" in given else F.lit(False)
    rows = rows.withColumns({
        "_abuse": abuse, "_sensitive": _matches(F.array(low), SENSITIVE_ENDPOINTS, first),
        "_headers": F.lower(headers), "_agent": agent, "_kind": kind,
        "_threat": F.when(threat.isin("none", ""), 0.0).otherwise(F.coalesce(F.try_element_at(table, threat), guess)),
        "_ddos": _clamp(ddos / 10.0), "_denied": F.when(denied, 1.0).otherwise(0.0),
    })
    n_sensitive = F.col("_sensitive")
    context_parts = {
        "sensitive_endpoint": (n_sensitive > 0, n_sensitive * 0.3),
        "risky_method_on_sensitive": (method.isin("PUT", "DELETE", "PATCH") & (n_sensitive > 0), F.lit(0.2)),
        "post_to_query_endpoint": ((method == "POST") & low.rlike("/search|/api/query|/lookup"), F.lit(0.1)),
        "sensitive_params": (risky > 0, F.least(F.lit(0.22), risky * 0.08)),
        "many_query_params": (F.col("param_count") >= 8, F.lit(0.08)),
        "deeply_encoded_request": (depth >= 2, F.lit(0.12)),
        "long_query_string": (F.length(F.regexp_extract("_url", r"^[^?]*\?([\s\S]*)$", 1)) > 500, F.lit(0.2)),
        "internal_host_header_reference": (F.col("_headers").rlike(r"127\.0\.0\.1|localhost|169\.254\."), F.lit(0.18)),
    }
    context = sum((F.when(t, v).otherwise(0.0) for t, v in context_parts.values()), F.lit(0.0))
    payload = sum((F.col(f"_c_{c}") * CLASS_WEIGHTS.get(c, 1.0) for c in patterns), F.lit(0.0)) + F.col("_abuse") * 0.45
    rows = rows.withColumns({"_context": _clamp(context), "_payload": _clamp(payload)})
    p, a, c, d, b = (F.col(x) for x in ("_payload", "_agent", "_context", "_ddos", "_denied"))
    t = F.col("_threat")
    rows = rows.withColumns({
        "_classes": sum(((F.col(f"_c_{k}") >= 0.2).cast("int") for k in patterns), F.lit(0)),
        "_backed": sum(((x >= 0.25).cast("int") for x in (p, a, c, d, b)), F.lit(0)),
        "_top": F.greatest(t, p, a, c, d, b),
        "_strong": sum(((x > 0.3).cast("int") for x in (t, p, a, c, d, b)), F.lit(0)),
    })
    classes_n, backed, top = F.col("_classes"), F.col("_backed"), F.col("_top")
    support = p * 0.15 + a * 0.1 + c * 0.1 + d * 0.1 + b * 0.15
    detected = t + (support + F.least(F.lit(0.12), backed * 0.03)) * (1 - t)
    alone = (
        p * 0.35 + a * 0.2 + c * 0.25 + d * 0.3 + b * 0.4 + F.least(F.lit(0.16), backed * 0.04)
        + F.least(F.lit(0.22), classes_n * 0.08)
        - F.when((backed <= 1) & (top < 0.9), 0.08).otherwise(0.0))
    evident = (classes_n >= 1) & ((F.col("_abuse") >= 0.2) | (c >= 0.2) | (a >= 0.5))
    alone = F.when(classes_n >= 2, F.greatest(alone, F.lit(0.65))).when(
        evident, F.greatest(alone, F.lit(0.55))).otherwise(alone)
    rows = settle(rows, {"_score": _clamp(F.when(t > 0, detected).otherwise(alone))})
    s = F.col("_score")
    confidence = _clamp(
        F.when(t > 0.7, 0.82 + F.col("_strong") / 5 * 0.14 + F.least(F.lit(0.04), backed * 0.01))
        .when(s > 0.5, 0.58 + top * 0.26 + F.least(F.lit(0.1), backed * 0.03))
        .otherwise(0.38 + top * 0.34 + F.least(F.lit(0.08), backed * 0.02)))
    label = (F.when(s >= 0.9, "critical").when(s >= 0.7, "high").when(s >= 0.5, "medium").when(s >= 0.3, "low")
             .otherwise("info"))
    named = {"sql_injection": "sql_patterns_detected", "xss": "xss_patterns_detected",
             "path_traversal": "path_traversal_detected", "command_injection": "command_injection_detected",
             "ssrf": "ssrf_patterns_detected"}
    factors = [(t > 0, F.concat(F.lit("threat_detected:"), "threat_type"))]
    factors += [(F.col(f"_c_{k}") > 0, F.lit(named.get(k, f"{k}_detected"))) for k in patterns]
    factors += [(depth >= 2, F.lit("multi_encoded_payload")), (ratio > 0.35, F.lit("dense_special_chars")),
                (risky >= 2, F.lit("multiple_high_risk_params")),
                (a > 0.3, F.concat(F.lit("ua:"), "_kind"))]
    factors += [(test, F.lit(k)) for k, (test, _) in context_parts.items()]
    factors += [(d > 0.3, F.lit("ddos_indicator")), (b > 0, F.lit("ip_blacklisted"))]
    listed = F.filter(F.array(*[F.when(test, name) for test, name in factors]), lambda x: x.isNotNull())

    def places(x: Column) -> Column:
        """Three places, with the noise of the last bits cut first."""
        return F.round(F.round(x, 9), 3)

    return rows.select(
        *given, places(s).alias("score"), places(confidence).alias("confidence"), label.alias("severity_label"),
        places(p).alias("payload_score"), places(a).alias("agent_score"), places(c).alias("context_score"),
        F.slice(F.array_distinct(listed), 1, 10).alias("risk_factors"))


def flag_events(scored: DataFrame, *, threshold: float = 0.85) -> DataFrame:
    """Mark events whose score reaches the threshold, with the reason."""
    hit = F.col("score") >= threshold
    return scored.withColumn("flagged", hit).withColumn(
        "flag_reason", F.when(hit, F.concat(F.lit("heuristic:"), F.format_number("score", 3))))


def blend_severity(heuristic: Column, model: Column, confidence: Column) -> Column:
    """Two severities as one: the model counts double if it is sure, half if it is not."""
    h, m = sev.index_of_label(heuristic), sev.index_of_label(model)
    blended = (F.when(confidence < 0.55, h).when(confidence >= 0.8, F.round((h + m * 2) / 3))
               .otherwise(F.round((h * 2 + m) / 3)))
    return sev.label_of_index(F.greatest(F.lit(0), F.least(F.lit(4), blended.cast("int"))))


def blend_scores(first: DataFrame, second: DataFrame, *, key: str = "event_id") -> DataFrame:
    """Weighted mean of two score tables by event.

    Weights are 0.4 and 0.6, or 0.8 and 0.2 if the second score is only a
    fallback. An event without a second score keeps its first.
    ``first``: key, score, confidence, severity_label; ``second`` also is_fallback.
    """
    other = second.select(key, F.col("score").alias("_s"), F.col("confidence").alias("_c"),
                          F.col("severity_label").alias("_l"), "is_fallback")
    j = first.join(other, key, "left")
    w1 = F.when(F.col("_s").isNull(), 1.0).when(F.col("is_fallback"), 0.8).otherwise(0.4)
    w2 = F.when(F.col("_s").isNull(), 0.0).when(F.col("is_fallback"), 0.2).otherwise(0.6)
    zero = F.lit(0.0)
    return j.select(
        key, F.round(F.col("score") * w1 + F.coalesce("_s", zero) * w2, 3).alias("score"),
        F.round(F.col("confidence") * w1 + F.coalesce("_c", zero) * w2, 3).alias("confidence"),
        F.when(F.col("_l").isNull(), F.lower("severity_label"))
        .otherwise(blend_severity(F.col("severity_label"), F.col("_l"), F.col("_c"))).alias("severity_label"),
        F.when(F.col("_s").isNull(), "single").otherwise("hybrid").alias("scorer"))
