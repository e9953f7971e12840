"""Request analytics queries."""

from __future__ import annotations

import html
from urllib.parse import parse_qsl, unquote_plus, urlparse

from pyspark.sql import functions as F

from duskwatch.functions.text import any_rlike
from duskwatch.operators import requests as R
from duskwatch.operators import scoring as S
from duskwatch.operators.patterns import DEFAULT_PATTERNS, VERDICTS
from workload import tables as T
from workload.common import query
from workload.tables_sql import floor_to, pick, sql

# Decoded forms of the 16 payloads in their two encodings, by the standard library.
SENT = [s for pair in zip(T.ENCODED, T.ENCODED_TWICE) for s in pair]
COMBO = "(id % 16) * 2 + k % 2"


def _stages(passes: int) -> list[list[str]]:
    rows = [list(SENT)]
    for _ in range(passes):
        rows.append([unquote_plus(s) for s in rows[-1]])
    return rows


ST = _stages(4)


def _text(values: list[str]) -> str:
    return f"(http_path || '?q=' || {pick(values, COMBO)} || ' ' || coalesce(body, ''))"


def _query(values: list[str]) -> str:
    return f"('q=' || {pick(values, COMBO)} || ' ' || coalesce(body, ''))"


def _n(x: str) -> str:
    return f"lower(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _s(x: str) -> str:
    return f"regexp_replace(regexp_replace({_n(x)}, '/\\*.*?\\*/', ' ', 'g'), '--[^\\n]*', ' ', 'g')"


def _p(x: str) -> str:
    return f"lower(regexp_replace(replace({x}, '\\', '/'), '/+', '/', 'g'))"


def _h(i: int) -> list[str]:
    return [html.unescape(s) for s in ST[i]]


FORMS = {
    "sql_injection": [_s(_text(v)) for v in (*ST[:4], _h(3))],
    "xss_attempt": [_n(_text(v)) for v in (*ST[:4], _h(3))],
    "html_injection": [_text(v) for v in (ST[0], ST[1], _h(1))],
    "path_traversal": [_p(_text(v)) for v in ST],
    "ssrf_attempt": [_n(_query(v)) for v in (*ST, _h(4))],
    "bot_detected": ["user_agent"],
}
OTHER = [_n(_text(v)) for v in (*ST, _h(4))]


def _re2(pattern: str) -> str:
    """The one pattern that refers to its own group, written out for both quotes."""
    if r"\1" not in pattern:
        return pattern
    return "|".join(pattern.replace(r"(\'|\")", q).replace(r"\1", q) for q in ("'", '"'))


def _any(forms: list[str], pattern: str) -> str:
    p = pattern.replace("'", "''")
    return "(" + " OR ".join(f"regexp_matches({f}, '{p}')" for f in forms) + ")"


# The texts become columns once, so that patterns are short to write.
FORM_COLS = {x: f"f{i}" for i, x in enumerate(dict.fromkeys(x for v in (*FORMS.values(), OTHER) for x in v if x != "user_agent"))}
FORMS = {k: [FORM_COLS.get(x, x) for x in v] for k, v in FORMS.items()}
OTHER = [FORM_COLS[x] for x in OTHER]
FORMED = ", ".join(f"{x} AS {c}" for x, c in FORM_COLS.items())


TAGGED = _any([_text(ST[0]), _text(ST[1])], r"(?i)</?[a-z]+[\s/>]")


def _verdict() -> str:
    parts = ["WHEN s_score >= 5 THEN 'ddos_attack'", "WHEN ip_blocked THEN 'blocked_ip'",
             "WHEN rate_limited THEN 'rate_limit_exceeded'"]
    for c, ps in DEFAULT_PATTERNS.items():
        guard = f"NOT {TAGGED} AND " if c == "sql_injection" else ""
        parts.append(f"WHEN {guard}{_any(FORMS.get(c, OTHER), any_rlike(map(_re2, ps)))} THEN '{c}'")
    return "CASE " + "\n".join(parts) + " ELSE 'none' END"


LEVEL = "CASE threat_type " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in VERDICTS.items()) + " END"
ACTION = "CASE threat_type " + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in VERDICTS.items()) + " END"
# Page and payload shapes repeat, so the oracle judges each distinct request once.
JUDGED = {
    "req": """SELECT r.*, l.http_path, CASE WHEN id % 97 = 0 THEN 7 ELSE 0 END AS s_score, id % 53 = 0 AS ip_blocked,
      id % 31 = 0 AS rate_limited FROM requests r JOIN (SELECT id AS lid, http_path FROM logs) l ON l.lid = r.id""",
    "shapes": "SELECT DISTINCT http_path, id % 16 AS id, k % 2 AS k, body, user_agent, s_score, ip_blocked, rate_limited FROM req",
    "formed": f"SELECT *, {FORMED} FROM shapes",
    "judged": f"SELECT *, {_verdict()} AS threat_type FROM formed",
    "verdicts": """SELECT r.*, j.threat_type FROM req r JOIN judged j ON r.http_path = j.http_path AND r.id % 16 = j.id
      AND r.k % 2 = j.k AND r.body IS NOT DISTINCT FROM j.body AND r.user_agent = j.user_agent
      AND r.s_score = j.s_score AND r.ip_blocked = j.ip_blocked AND r.rate_limited = j.rate_limited""",
}


def stated(spark, sf):
    i = F.col("id")
    return T.requests(spark, sf, shared=True).withColumns({
        "ddos_score": F.when(i % 97 == 0, 7).otherwise(0), "ip_blocked": i % 53 == 0, "rate_limited": i % 31 == 0})


@query("classify_requests", sql(["requests", "logs"], f"""
SELECT id, threat_type, {LEVEL} AS threat_level, {ACTION} AS action_taken,
  {ACTION} IN ('block', 'rate_limit') AS is_blocked FROM verdicts""", extra=JUDGED))
def classify_requests(spark, sf):
    return R.classify_requests(stated(spark, sf)).select("id", "threat_type", "threat_level", "action_taken", "is_blocked")


PAT_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS threat_type, '{p.replace(chr(39), chr(39) * 2)}' AS pattern, http_path, id, k, body, user_agent, "
    f"s_score, ip_blocked, rate_limited FROM judged WHERE threat_type = '{c}' AND {_any(FORMS.get(c, OTHER), '(?i)' + _re2(p))}"
    for c, ps in DEFAULT_PATTERNS.items() for p in dict.fromkeys(ps))


@query("pattern_hit_counts", sql(["requests", "logs"], """
SELECT p.threat_type, p.pattern, count(*) AS requests, count(DISTINCT r.client_ip) AS ips
FROM req r JOIN pats p ON r.http_path = p.http_path AND r.id % 16 = p.id AND r.k % 2 = p.k
  AND r.body IS NOT DISTINCT FROM p.body AND r.user_agent = p.user_agent
  AND r.s_score = p.s_score AND r.ip_blocked = p.ip_blocked AND r.rate_limited = p.rate_limited GROUP BY 1, 2""",
    extra={**JUDGED, "pats": PAT_SQL}, materialize=("judged",)))
def pattern_hit_counts(spark, sf):
    return R.pattern_hit_counts(stated(spark, sf))


def _pt(test: str, n: int) -> str:
    return f"CASE WHEN {test} THEN {n} ELSE 0 END"


# Segments by a chain over the seconds of each address; the requests of a segment are numbered, and its
# first one is judged by the totals of the segment before.
FLOOD = {
    "fr": """SELECT * EXCLUDE (url), CASE WHEN client_ip LIKE '%1' THEN '/same' ELSE url END AS url, "timestamp" AS t,
      epoch_us("timestamp") // 1000000 AS s FROM requests""",
    "fs": "SELECT *, row_number() OVER (PARTITION BY client_ip ORDER BY s) AS rn FROM (SELECT DISTINCT client_ip, s FROM fr)",
    "fc": """SELECT client_ip, rn, s, s AS seg FROM fs WHERE rn = 1 UNION ALL
      SELECT n.client_ip, n.rn, n.s, CASE WHEN n.s - c.seg > {0} THEN n.s ELSE c.seg END
      FROM fc c JOIN fs n ON n.client_ip = c.client_ip AND n.rn = c.rn + 1""",
    "fn": """SELECT r.*, seg, row_number() OVER w AS n0, min(t) OVER w AS first0, count(DISTINCT method) OVER w AS methods0,
      list(url) OVER (PARTITION BY r.client_ip ORDER BY t, id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS urls,
      row_number() OVER (PARTITION BY user_agent ORDER BY t, id) AS ua_n
      FROM fr r JOIN fc c ON c.client_ip = r.client_ip AND c.s = r.s
      WINDOW w AS (PARTITION BY r.client_ip, seg ORDER BY t, id ROWS UNBOUNDED PRECEDING)""",
    "fg": """SELECT client_ip, seg, lag(n) OVER w AS pn, lag(first) OVER w AS pfirst, lag(ms) OVER w AS pms FROM (
      SELECT client_ip, seg, count(*) AS n, min(t) AS first, list(DISTINCT method) AS ms FROM fn GROUP BY 1, 2)
      WINDOW w AS (PARTITION BY client_ip ORDER BY seg)""",
    "fl": """SELECT f.*, CASE WHEN n0 = 1 AND pn IS NOT NULL THEN pn + 1 ELSE n0 END AS n,
      CASE WHEN n0 = 1 AND pn IS NOT NULL THEN pfirst ELSE first0 END AS first,
      CASE WHEN n0 = 1 AND pn IS NOT NULL THEN len(list_distinct(list_append(pms, method))) ELSE methods0 END AS methods
      FROM fn f JOIN fg USING (client_ip, seg)""",
}


def flood(seconds: int) -> dict[str, str]:
    return {**FLOOD, "fc": FLOOD["fc"].format(seconds)}


FLOOD_SQL = f"""
SELECT id, client_ip, CAST({" + ".join([
    _pt("user_agent IN ('', 'unknown', '-') OR (length(user_agent) < 10 AND NOT contains(user_agent, 'Mozilla'))", 1),
    _pt("ua_n > 100", 1), _pt("len(urls) >= 10 AND len(list_distinct(urls)) <= 2", 2), _pt("methods > 1 AND n > 20", 1),
    _pt("(k % 2 <> 0)::INT + (k % 3 <> 0)::INT + (k % 5 <> 0)::INT >= 2", 1),
    _pt("t > first AND n / ((epoch_us(t) - epoch_us(first)) / 1e6) > 10", 2),
    _pt("method IN ('POST', 'PUT') AND k % 4 = 0", 1), _pt("length(split_part(url, '?', 2)) > 500", 1),
    _pt("k % 2 = 1 AND n > 50", 1)])} AS INTEGER) AS ddos_score FROM fl"""


def flooding(spark, sf):
    return T.requests(spark, sf).withColumn("url", F.when(F.col("client_ip").endswith("1"), "/same").otherwise(F.col("url")))


@query("ddos_score", sql(["requests"], FLOOD_SQL, extra=flood(3600), recursive=True))
def ddos_score(spark, sf):
    return R.ddos_score(flooding(spark, sf)).select("id", "client_ip", "ddos_score")


@query("ddos_score_days", sql(["requests"], FLOOD_SQL, extra=flood(5 * 86400), recursive=True))
def ddos_score_days(spark, sf):
    """With segments as long as the test rows are dense, so that counts build up."""
    return R.ddos_score(flooding(spark, sf), segment_seconds=5 * 86400).select("id", "client_ip", "ddos_score")


LIMITS = {"limit": 4, "window": 86400, "burst": 2, "burst_window": 3600, "block_seconds": 7200}
REPLAY = {
    "secs": """SELECT *, row_number() OVER (PARTITION BY client_ip ORDER BY sec) AS rn FROM (
      SELECT client_ip, epoch_us("timestamp") // 1000000 AS sec, count(*) AS n FROM requests GROUP BY 1, 2)""",
    "calc": """
  SELECT client_ip, rn, sec, n, CAST(least(n, 4, 2) AS BIGINT) AS acc,
    CASE WHEN n > 2 THEN sec + 7200 ELSE 0 END AS til, [{'s': sec, 'n': CAST(least(n, 4, 2) AS BIGINT)}] AS held,
    false AS was_blocked, 0::BIGINT AS recent
  FROM secs WHERE rn = 1
  UNION ALL
  SELECT client_ip, rn, sec, n, acc,
    CASE WHEN was_blocked THEN til WHEN n > acc AND recent + acc >= 2 THEN sec + 7200 ELSE til END,
    CASE WHEN was_blocked THEN held0 WHEN acc > 0 THEN list_append(kept, {'s': sec, 'n': acc}) ELSE kept END,
    was_blocked, recent
  FROM (SELECT *, CASE WHEN was_blocked THEN 0 ELSE CAST(least(n, greatest(0, least(4 - cur, 2 - recent))) AS BIGINT) END AS acc
    FROM (SELECT s.client_ip, s.rn, s.sec, s.n, c.til, c.held AS held0, s.sec < c.til AS was_blocked,
        list_filter(c.held, lambda x: x.s > s.sec - 86400) AS kept,
        CAST(coalesce(list_sum(list_transform(list_filter(c.held, lambda x: x.s > s.sec - 86400), lambda x: x.n)), 0) AS BIGINT) AS cur,
        CAST(coalesce(list_sum(list_transform(list_filter(c.held, lambda x: x.s > s.sec - 3600), lambda x: x.n)), 0) AS BIGINT) AS recent
      FROM calc c JOIN secs s ON s.client_ip = c.client_ip AND s.rn = c.rn + 1))""",
    "replay": """SELECT client_ip, sec, n AS requests, acc AS accepted,
      CASE WHEN was_blocked OR recent + acc >= 2 THEN 0 ELSE n - acc END AS rate_limited,
      CASE WHEN NOT was_blocked AND n > acc AND recent + acc >= 2 THEN 1 ELSE 0 END AS burst_refused,
      CASE WHEN was_blocked THEN n WHEN n > acc AND recent + acc >= 2 THEN n - acc - 1 ELSE 0 END AS blocked FROM calc""",
}


@query("rate_limit_replay", sql(["requests"], """
SELECT client_ip, make_timestamp(sec * 1000000) AS second, requests, accepted, CAST(rate_limited AS BIGINT) AS rate_limited,
  CAST(burst_refused AS BIGINT) AS burst_refused, CAST(blocked AS BIGINT) AS blocked FROM replay""",
    extra=REPLAY, recursive=True))
def rate_limit_replay(spark, sf):
    return R.rate_limit_replay(T.requests(spark, sf), **LIMITS)


@query("admit_requests", sql(["requests"], """
SELECT id, r.client_ip, CASE WHEN rn <= accepted THEN 'accepted' WHEN rn <= accepted + rate_limited THEN 'rate_limited'
  WHEN rn <= accepted + rate_limited + burst_refused THEN 'burst' ELSE 'blocked' END AS admission
FROM (SELECT *, epoch_us("timestamp") // 1000000 AS s, row_number() OVER (
    PARTITION BY client_ip, epoch_us("timestamp") // 1000000 ORDER BY "timestamp", id) AS rn FROM requests) r
JOIN replay p ON p.client_ip = r.client_ip AND p.sec = r.s""", extra=REPLAY, recursive=True))
def admit_requests(spark, sf):
    r = T.requests(spark, sf)
    return R.admit_requests(r, R.rate_limit_replay(r, **LIMITS)).select("id", "client_ip", "admission")


@query("rate_profile", sql(["requests"], f"""
SELECT client_ip, {floor_to('"timestamp"', 86400)} AS window_start, count(*) AS requests, round(count(*)::DOUBLE / 6, 6) AS share,
  count(*)::DOUBLE / 6 >= 0.8 AS near_limit FROM requests GROUP BY 1, 2"""))
def rate_profile(spark, sf):
    return R.rate_profile(T.requests(spark, sf), limit=6, window=86400)


@query("distributed_attack", sql(["requests"], """
SELECT make_timestamp(s * 1000000) AS window_start, make_timestamp((s + 3600) * 1000000) AS window_end,
  count(*) AS requests, count(DISTINCT client_ip) AS ips,
  count(*) > 20 AND count(DISTINCT client_ip) >= 10 AS is_distributed, count(DISTINCT client_ip) > 21 AS many_sources
FROM (SELECT client_ip, unnest([e, e - 1800]) AS s FROM (
  SELECT client_ip, epoch_us("timestamp") // 1800000000 * 1800 AS e FROM requests))
GROUP BY s HAVING (count(*) > 20 AND count(DISTINCT client_ip) >= 10) OR count(DISTINCT client_ip) > 21"""))
def distributed_attack(spark, sf):
    return R.distributed_attack(T.requests(spark, sf), window="1 hour", slide="30 minutes", min_requests=20,
                                min_ips=10, many_ips=21)


PAGE_PROFILE = {"prof": r"""
  SELECT page_id, url, q, params, len(params) AS param_count,
    len(list_filter(params, lambda p: list_contains(['id', 'user', 'username', 'admin', 'token', 'redirect', 'url',
      'next', 'file', 'path', 'cmd', 'exec', 'password', 'key'], lower(split_part(p, '=', 1)))
      OR regexp_matches(lower(p), '=.*(\.\./|<script|union select|https?://)'))) AS high_risk_params
  FROM (SELECT *, list_filter(string_split(q, '&'), lambda p: p <> '') AS params FROM (
    SELECT page_id, url, regexp_extract(url, '^[^?#]*\?([^#]*)', 1) AS q FROM pages))"""}
RATIO = "CASE WHEN length(q) > 0 THEN length(regexp_replace(q, '[\\p{L}\\p{N}]', '', 'g'))::DOUBLE / length(q) ELSE 0.0::DOUBLE END"


@query("query_profile", sql([], f"""
SELECT page_id, 0 AS encoded_depth, CAST(param_count AS INTEGER) AS param_count,
  CAST(high_risk_params AS INTEGER) AS high_risk_params, round({RATIO}, 6) AS special_ratio FROM prof""",
    extra=PAGE_PROFILE))
def query_profile(spark, sf):
    return S.query_profile(T.table(spark, sf, "pages").select("page_id", "url")).drop("url")


@query("query_profile_by_host", sql([], f"""
SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host, count(*) AS urls,
  count(*) FILTER (param_count > 0) AS with_query, CAST(sum(high_risk_params) AS BIGINT) AS high_risk_params,
  0 AS max_depth, round(avg(round({RATIO}, 6)), 6) AS avg_special_ratio FROM prof GROUP BY 1""", extra=PAGE_PROFILE))
def query_profile_by_host(spark, sf):
    return S.query_profile_by_host(T.table(spark, sf, "pages").select("page_id", "url"))


AGENT = """CASE WHEN user_agent IS NULL OR user_agent = '' THEN 'missing' WHEN lower(user_agent) LIKE '%sqlmap%' THEN 'scanner'
  WHEN regexp_matches(lower(user_agent), 'curl|python-requests') THEN 'automation'
  WHEN lower(user_agent) LIKE '%googlebot%' THEN 'legit_bot' WHEN length(user_agent) < 10 THEN 'minimal' ELSE 'browser' END"""
AGENT_SCORE = f"(CASE {AGENT} WHEN 'missing' THEN 0.3 WHEN 'scanner' THEN 0.95 WHEN 'automation' THEN 0.6 WHEN 'legit_bot' THEN 0.1 WHEN 'minimal' THEN 0.5 ELSE 0 END)::DOUBLE"


@query("agent_classes", sql(["requests"], f"""
SELECT {AGENT} AS agent_class, {AGENT_SCORE} AS score, count(*) AS requests, count(DISTINCT client_ip) AS ips
FROM requests GROUP BY 1, 2"""))
def agent_classes(spark, sf):
    return S.agent_classes(T.requests(spark, sf))


# URL features of the 32 sent payloads, by the standard library.
def _profiles() -> tuple[list, list, list, list, list]:
    v0, v1, v2, depth, feats = [], [], [], [], []
    for s in SENT:
        forms = ["/x?q=" + s]
        for _ in range(2):
            nxt = html.unescape(unquote_plus(forms[-1]))
            if nxt == forms[-1]:
                break
            forms.append(nxt)
        q = urlparse(forms[-1]).query
        risky = sum(any(m in v.lower() for m in ["../", "<script", "union select", "http://", "https://"])
                    for _, v in parse_qsl(q, keep_blank_values=True))
        feats.append((len(parse_qsl(q, keep_blank_values=True)), risky,
                      sum(1 for ch in q if not ch.isalnum()) / max(len(q), 1)))
        depth.append(len(forms) - 1)
        forms += [forms[-1]] * (3 - len(forms))
        for lst_, f in zip((v0, v1, v2), forms):
            lst_.append(f[2:])
    return v0, v1, v2, depth, feats


_V0, _V1, _V2, _DEPTH, _FEATS = _profiles()


def _nums(values) -> str:
    return f"list_extract([{', '.join(repr(float(v)) for v in values)}]::DOUBLE[], CAST({COMBO} AS INTEGER) + 1)"


HTEXTS = [f"lower(http_path || {pick(v, COMBO)})" for v in (_V0, _V1, _V2)] + ["coalesce(body, '')"]


def _count(forms: list[str], regexes: list[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN {_any(forms, '(?i)' + p)} THEN 1 ELSE 0 END" for p in regexes) + ")"


SCORES = {t: S.THREAT_SCORES.get(t) for t in set(T.THREATS)}
SCORES.update({"rce_attempt": 0.9, "auth_bypass_attempt": 0.5, "bot_detected": 0.65, "ssrf_attempt": 0.85,
               "html_injection": 0.9})
HEUR = {
    "hr": f"""SELECT r.id, r.k, r.body, r.user_agent, r.method, l.http_path, k % 10 AS ddos_score, r.id % 7 = 0 AS blacklisted,
      CASE WHEN l.attack_type = 'NONE' THEN 'none' ELSE {pick(T.THREATS, 'k % 15')} END AS threat_type
      FROM requests r JOIN (SELECT id AS lid, http_path, attack_type FROM logs) l ON l.lid = r.id""",
    "hshape": "SELECT DISTINCT http_path, id % 16 AS id, k % 2 AS k, body FROM hr",
    "hclass": "SELECT *, " + ", ".join(
        f"least(1.0::DOUBLE, {_count(HTEXTS, ps)} * 0.22::DOUBLE) AS c_{c}" for c, ps in S.PAYLOAD_PATTERNS.items())
        + f", {_count(['lower(http_path)'], S.SENSITIVE_ENDPOINTS)} AS sens FROM hshape",
    "h0": f"""SELECT h.*, c.* EXCLUDE (http_path, id, k, body), {_nums(_DEPTH).replace('id %', 'h.id %').replace('k %', 'h.k %')} AS depth,
      {_nums([f[0] for f in _FEATS]).replace('id %', 'h.id %').replace('k %', 'h.k %')} AS params,
      {_nums([f[1] for f in _FEATS]).replace('id %', 'h.id %').replace('k %', 'h.k %')} AS risky,
      {_nums([f[2] for f in _FEATS]).replace('id %', 'h.id %').replace('k %', 'h.k %')} AS ratio,
      {AGENT_SCORE} AS a, least(1.0, ddos_score / 10.0)::DOUBLE AS d, CASE WHEN blacklisted THEN 1.0 ELSE 0.0 END::DOUBLE AS b,
      (CASE threat_type {" ".join(f"WHEN '{k}' THEN {v}" for k, v in SCORES.items())} ELSE 0 END)::DOUBLE AS t
      FROM hr h JOIN hclass c ON h.http_path = c.http_path AND h.id % 16 = c.id AND h.k % 2 = c.k
        AND h.body IS NOT DISTINCT FROM c.body""",
    "h1": """SELECT *, greatest(CASE WHEN depth >= 2 THEN least(1.0, 0.2 + depth * 0.15) ELSE 0 END,
        CASE WHEN ratio > 0.35 THEN 0.2 ELSE 0 END, CASE WHEN risky >= 2 THEN 0.25 ELSE 0 END)::DOUBLE AS abuse,
      least(1.0::DOUBLE, sens * 0.3::DOUBLE + CASE WHEN sens > 0 AND method IN ('PUT', 'DELETE', 'PATCH') THEN 0.2 ELSE 0 END
        + CASE WHEN risky > 0 THEN least(0.22::DOUBLE, risky * 0.08::DOUBLE) ELSE 0 END
        + CASE WHEN params >= 8 THEN 0.08 ELSE 0 END + CASE WHEN depth >= 2 THEN 0.12 ELSE 0 END) AS c FROM h0""",
    "h2": """SELECT *, least(1.0::DOUBLE, c_sql_injection * 1.0::DOUBLE + c_xss * 0.9::DOUBLE + c_path_traversal * 0.95::DOUBLE
        + c_command_injection * 1.0::DOUBLE + c_ssrf * 0.9::DOUBLE + abuse * 0.45::DOUBLE) AS p,
      (c_sql_injection >= 0.2)::INT + (c_xss >= 0.2)::INT + (c_path_traversal >= 0.2)::INT + (c_command_injection >= 0.2)::INT
        + (c_ssrf >= 0.2)::INT AS nc FROM h1""",
    "h3": """SELECT *, (p >= 0.25)::INT + (a >= 0.25)::INT + (c >= 0.25)::INT + (d >= 0.25)::INT + (b >= 0.25)::INT AS nb,
      greatest(t, p, a, c, d, b) AS top,
      (t > 0.3)::INT + (p > 0.3)::INT + (a > 0.3)::INT + (c > 0.3)::INT + (d > 0.3)::INT + (b > 0.3)::INT AS ns FROM h2""",
    "h4": """SELECT *, p * 0.35::DOUBLE + a * 0.2::DOUBLE + c * 0.25::DOUBLE + d * 0.3::DOUBLE + b * 0.4::DOUBLE
        + least(0.16::DOUBLE, nb * 0.04::DOUBLE) + least(0.22::DOUBLE, nc * 0.08::DOUBLE)
        - CASE WHEN nb <= 1 AND top < 0.9 THEN 0.08 ELSE 0 END AS raw FROM h3""",
    "h5": """SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN t > 0 THEN
        t + (p * 0.15::DOUBLE + a * 0.1::DOUBLE + c * 0.1::DOUBLE + d * 0.1::DOUBLE + b * 0.15::DOUBLE + least(0.12::DOUBLE, nb * 0.03::DOUBLE)) * (1 - t)
        WHEN nc >= 2 THEN greatest(raw, 0.65) WHEN nc >= 1 AND (abuse >= 0.2 OR c >= 0.2 OR a >= 0.5) THEN greatest(raw, 0.55)
        ELSE raw END)) AS s FROM h4""",
    "heur": """SELECT *, CASE WHEN s >= 0.9 THEN 'critical' WHEN s >= 0.7 THEN 'high' WHEN s >= 0.5 THEN 'medium'
        WHEN s >= 0.3 THEN 'low' ELSE 'info' END AS severity_label,
      greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN t > 0.7 THEN 0.82::DOUBLE + ns / 5.0::DOUBLE * 0.14::DOUBLE + least(0.04::DOUBLE, nb * 0.01::DOUBLE)
        WHEN s > 0.5 THEN 0.58::DOUBLE + top * 0.26::DOUBLE + least(0.1::DOUBLE, nb * 0.03::DOUBLE)
        ELSE 0.38::DOUBLE + top * 0.34::DOUBLE + least(0.08::DOUBLE, nb * 0.02::DOUBLE) END)) AS conf FROM h5""",
}


def scored_requests(spark, sf):
    r = T.requests(spark, sf, shared=True).drop("headers")
    r = r.withColumn("threat_type", F.when(F.col("k") < 55, "none").otherwise(T.pick(T.THREATS, F.col("k") % 15)))
    r = r.withColumn("ddos_score", F.col("k") % 10).withColumn("blacklisted", F.col("id") % 7 == 0)
    return S.heuristic_score(r)


@query("heuristic_score", sql(["requests", "logs"], """
SELECT id, round(round(s, 9), 3) AS score, round(round(conf, 9), 3) AS confidence, severity_label, round(round(p, 9), 3) AS payload_score,
  round(round(a, 9), 3) AS agent_score, round(round(c, 9), 3) AS context_score FROM heur""", extra=HEUR))
def heuristic_score(spark, sf):
    return scored_requests(spark, sf).select(
        "id", "score", "confidence", "severity_label", "payload_score", "agent_score", "context_score")


@query("flag_events", sql(["requests", "logs"], """
SELECT id, round(round(s, 9), 3) >= 0.85 AS flagged, CASE WHEN round(round(s, 9), 3) >= 0.85 THEN 'heuristic' END AS reason FROM heur""",
    extra=HEUR))
def flag_events(spark, sf):
    return S.flag_events(scored_requests(spark, sf)).select(
        "id", "flagged", F.substring_index("flag_reason", ":", 1).alias("reason"))


BLEND = {
    "f": """SELECT event_id, ai_score AS score, ai_confidence AS confidence, threat_level AS label, k FROM security_events
      WHERE ai_score IS NOT NULL""",
    "g": """SELECT event_id, (k * 7 % 100) / 100.0::DOUBLE AS score, (k * 11 % 100) / 100.0::DOUBLE AS confidence,
      list_extract(['benign', '2', 'critical', 'odd'], CAST(k % 4 AS INTEGER) + 1) AS label, k % 5 = 0 AS is_fallback
      FROM security_events WHERE k % 3 <> 1""",
    "ix": """SELECT f.event_id, f.score AS s1, f.confidence AS c1, g.score AS s2, g.confidence AS c2, g.is_fallback, f.label AS l1,
      list_position(['info', 'low', 'medium', 'high', 'critical'], f.label) - 1 AS h, CASE g.label WHEN 'benign' THEN 0
        WHEN '2' THEN 3 WHEN 'critical' THEN 4 WHEN 'odd' THEN 2 END AS m
      FROM f LEFT JOIN g USING (event_id)""",
}


@query("blend_scores", sql(["security_events"], """
SELECT event_id, CASE WHEN s2 IS NULL THEN round(s1, 3) WHEN is_fallback THEN round(s1 * 0.8::DOUBLE + s2 * 0.2::DOUBLE, 3)
    ELSE round(s1 * 0.4::DOUBLE + s2 * 0.6::DOUBLE, 3) END AS score,
  CASE WHEN s2 IS NULL THEN l1 ELSE list_extract(['info', 'low', 'medium', 'high', 'critical'], CAST(CASE WHEN c2 < 0.55 THEN h
    WHEN c2 >= 0.8 THEN round((h + m * 2) / 3.0) ELSE round((h * 2 + m) / 3.0) END AS INTEGER) + 1) END AS severity_label,
  CASE WHEN s2 IS NULL THEN 'single' ELSE 'hybrid' END AS scorer FROM ix""", extra=BLEND))
def blend_scores(spark, sf):
    e = T.security_events(spark, sf)
    first = e.select("event_id", F.get_json_object("details", "$.ai.ai_score").cast("double").alias("score"),
                     F.get_json_object("details", "$.ai.ai_confidence").cast("double").alias("confidence"),
                     F.col("threat_level").alias("severity_label")).filter("score is not null")
    kk = T.logs(spark, sf, with_k=True).select(F.concat(F.lit("EV"), F.col("id").cast("string")).alias("event_id"), "k")
    k = F.col("k")
    second = kk.filter(k % 3 != 1).select(
        "event_id", (k * 7 % 100 / 100.0).alias("score"), (k * 11 % 100 / 100.0).alias("confidence"),
        T.pick(["benign", "2", "critical", "odd"], k % 4).alias("severity_label"), (k % 5 == 0).alias("is_fallback"))
    return S.blend_scores(first, second).drop("confidence")


@query("request_metrics", sql(["security_events", "logs"], f"""
SELECT {floor_to('e."timestamp"', 86400)} AS period, count(*) AS total_requests, count(*) FILTER (blocked = 1) AS blocked_requests,
  count(*) FILTER (blocked = 0) AS allowed_requests, count(*) FILTER (threat_type <> 'none') AS threats_detected,
  round(avg(confidence * 100), 3) AS avg_response_ms
FROM security_events e JOIN (SELECT 'EV' || CAST(id AS VARCHAR) AS event_id, confidence FROM logs) l USING (event_id) GROUP BY 1"""))
def request_metrics(spark, sf):
    r = T.logs(spark, sf).select(F.concat(F.lit("EV"), F.col("id").cast("string")).alias("event_id"),
                                 (F.col("confidence") * 100).alias("response_ms"))
    return R.request_metrics(T.security_events(spark, sf).join(r, "event_id"))
