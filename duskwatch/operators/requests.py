"""Request analytics: verdicts, limits, scores and counters over request tables.

A request table has id, timestamp, client_ip, method, url, body, user_agent and
a ``headers`` map with lower-case names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.functions.decode import any_match, path_text, plain, sql_text, with_decoded
from duskwatch.functions.prefilter import groups, possible, possible_patterns
from duskwatch.functions.times import floor_to, from_micros, micros
from duskwatch.operators.patterns import ALLOWED_PATHS, DEFAULT_PATTERNS, VERDICTS
from duskwatch.plans.fold import anchored, ordered_fold
from duskwatch.plans.settle import settle
from duskwatch.plans.skew import split_join
from duskwatch.plans.tiles import first_n

_TAG = r"</?[a-z]+[\s/>]"
LOOPBACK = ["127.0.0.1", "localhost", "::1"]


def _forms(requests: DataFrame, patterns: dict[str, list[str]]) -> DataFrame:
    """All decoded and normalised texts the categories look at, as ``_``-columns.

    ``_may`` says by group of patterns, and last for tags, where the exact patterns have to look (``_found``). The forms of query
    and body alone are only made where the whole request already shows one of the SSRF patterns.
    """
    text = F.concat(F.coalesce("url", F.lit("")), F.lit(" "), F.coalesce("body", F.lit("")))
    query = F.regexp_extract(F.coalesce("url", F.lit("")), r"\?([^#]*)", 1)
    df = with_decoded(requests, text, "_d", 4, [1, 3, 4])
    new = {}
    for c in ("_d0", "_d1", "_d2", "_d3", "_d4", "_d_h3", "_d_h4"):
        new["_n" + c] = plain(F.col(c))
    for c in ("_d0", "_d1", "_d2", "_d3", "_d_h3"):
        new["_s" + c] = sql_text(F.col(c))
    for c in ("_d0", "_d1", "_d2", "_d3", "_d4"):
        new["_p" + c] = path_text(F.col(c))
    df = settle(df, new)
    # The whole request stands in for the SSRF forms, which come only where it shows a pattern.
    looked = {c: _ANY if c == "ssrf_attempt" else _FORMS.get(c, _ANY) for c in patterns}
    texts = list(dict.fromkeys([c for v in looked.values() for c in v] + ["_d0", "_d1"]))
    tests = [([texts.index(c) for c in v], patterns[k]) for k, v in looked.items()]
    df = df.withColumn("_may", possible([F.col(c) for c in texts], [*tests, ([texts.index("_d0"), texts.index("_d1")], [_TAG])]))
    ssrf = patterns.get("ssrf_attempt", [])
    if not ssrf:
        return df
    seen = _found(patterns, "ssrf_attempt", [F.col(c) for c in _ANY])
    part = F.when(seen, F.concat(query, F.lit(" "), F.coalesce("body", F.lit(""))))
    df = with_decoded(df, part, "_q", 4, [4])
    return settle(df, {"_n" + c: plain(F.col(c)) for c in ("_q0", "_q1", "_q2", "_q3", "_q4", "_q_h4")})


_FORMS = {
    "sql_injection": ["_s_d0", "_s_d1", "_s_d2", "_s_d3", "_s_d_h3"],
    "xss_attempt": ["_n_d0", "_n_d1", "_n_d2", "_n_d3", "_n_d_h3"],
    "html_injection": ["_d0", "_d1", "_d_h1"],
    "path_traversal": ["_p_d0", "_p_d1", "_p_d2", "_p_d3", "_p_d4"],
    "ssrf_attempt": ["_n_q0", "_n_q1", "_n_q2", "_n_q3", "_n_q4", "_n_q_h4"],
    "bot_detected": ["user_agent"],
}
_AS_WRITTEN = ["html_injection", "bot_detected"]
_ANY = ["_n_d0", "_n_d1", "_n_d2", "_n_d3", "_n_d4", "_n_d_h4"]


def _found(patterns: dict[str, list[str]], category: str, texts: list[Column]) -> Column:
    """True if one of the category's patterns is found, looked for only where ``_may`` has it possible."""
    first, hit = 0, F.lit(False)
    for c, regexes in patterns.items():
        for i, some in enumerate(groups(regexes), first) if c == category else ():
            hit = hit | F.when(F.col("_may")[i], any_match(texts, some, lowered=category not in _AS_WRITTEN)).otherwise(False)
        first += len(groups(regexes))
    return hit


def _columns(category: str) -> list[Column]:
    return [F.col(c) for c in _FORMS.get(category, _ANY)]


def _url_path() -> Column:
    return F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def _given(df: DataFrame, name: str, default) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def _classified(
    requests: DataFrame, patterns: dict[str, list[str]], allowed_paths: list[str], ddos_threshold: int
) -> DataFrame:
    rows = _forms(requests, patterns)
    path = _url_path()
    allowed = F.lit(False)
    for p in allowed_paths:
        allowed = allowed | F.contains(path, F.lit(p))
    verdict = (
        F.when(allowed, "none")
        .when(_given(requests, "ddos_score", 0) >= ddos_threshold, "ddos_attack")
        .when(_given(requests, "ip_blocked", False), "blocked_ip")
        .when(_given(requests, "rate_limited", False), "rate_limit_exceeded")
    )
    tags = sum(len(groups(p)) for p in patterns.values())
    tagged = F.when(F.col("_may")[tags], any_match([F.col("_d0"), F.col("_d1")], [_TAG])).otherwise(False)
    internal = F.col("client_ip").isin(LOOPBACK) & path.startswith("/api/v1/")
    for category in patterns:
        hit = _found(patterns, category, _columns(category))
        if category == "sql_injection":
            hit = ~tagged & hit
        elif category == "ssrf_attempt":
            hit = ~F.coalesce(internal, F.lit(False)) & hit
        verdict = verdict.when(hit, category)
    return settle(rows, {"threat_type": verdict.otherwise("none"), "allow_listed": allowed})


def classify_requests(
    requests: DataFrame, *, patterns: dict[str, list[str]] | None = None,
    allowed_paths: list[str] | None = None, ddos_threshold: int = 5,
) -> DataFrame:
    """First verdict of each request in a fixed order, with its level and action.

    Allow-listed path, flood score, blocked address, rate limit, then the
    pattern categories in their order. The stateful inputs come as the columns
    ``ddos_score``, ``ip_blocked`` and ``rate_limited``, if present.
    """
    patterns = DEFAULT_PATTERNS if patterns is None else patterns
    rows = _classified(requests, patterns, ALLOWED_PATHS if allowed_paths is None else allowed_paths, ddos_threshold)
    level, action = F.lit("low"), F.lit("allow")
    for name, (lv, ac) in VERDICTS.items():
        level = F.when(F.col("threat_type") == name, lv).otherwise(level)
        action = F.when(F.col("threat_type") == name, ac).otherwise(action)
    return rows.select(
        *requests.columns, "threat_type", level.alias("threat_level"), action.alias("action_taken"),
        action.isin("block", "rate_limit").alias("is_blocked"), "allow_listed")


def pattern_hit_counts(requests: DataFrame, *, patterns: dict[str, list[str]] | None = None) -> DataFrame:
    """Requests and addresses per pattern of the category that decided the verdict."""
    patterns = DEFAULT_PATTERNS if patterns is None else patterns
    rows = _classified(requests, patterns, ALLOWED_PATHS, 5)
    texts = F.array().cast("array<string>")
    for category in patterns:
        mine = F.array_distinct(F.filter(F.array(*_columns(category)), lambda x: x.isNotNull()))
        texts = F.when(F.col("threat_type") == category, mine).otherwise(texts)
    rows = rows.select("id", "threat_type", "client_ip", F.explode(texts).alias("_text"))
    rows = rows.withColumn("_near", possible_patterns(F.col("_text"), F.col("threat_type"), patterns))
    text, near, found = F.col("_text"), F.col("_near"), F.array().cast("array<string>")
    for category, regexes in patterns.items():
        mine = F.array(*[F.when(F.array_contains(near, i), F.when(text.rlike("(?iu)" + p), p)) for i, p in enumerate(regexes)])
        found = F.when(F.col("threat_type") == category, F.filter(mine, lambda x: x.isNotNull())).otherwise(found)
    # A pattern that finds several forms of one request counts once.
    hits = rows.select("id", "threat_type", "client_ip", F.explode(found).alias("pattern")).distinct()
    return hits.groupBy("threat_type", "pattern").agg(
        F.count("*").alias("requests"), F.count_distinct("client_ip").alias("ips"))


# Names of flooding tools in user agents.
FLOOD_TOOLS = ["hping", "slowloris", "hulk", "rudy", "loic", "hoic", "slowhttptest", "torshammer", "pyloris",
               "thc-ssl-dos"]


def _connections(rows: DataFrame, segment_seconds: int) -> DataFrame:
    """What is known of each (address, second) before its first request.

    One row per address and second goes through an ordered fold that finds the segments: one begins
    with the first request later than ``segment_seconds`` after the start of the one before.
    Counts and extremes of the seconds before are running sums over those rows, and the last
    URLs come from the last rows of up to 19 seconds before.
    """
    per_second = rows.groupBy("_ip", "_second").agg(
        F.count("*").alias("_c"), F.min("_us").alias("_from"), F.min("method").alias("_low"), F.max("method").alias("_high"))
    base = anchored(segment_seconds)

    def step(state, row):
        state, emitted = base(state, row)
        return state, [(*emitted[0], *row[1:])]

    segments = ordered_fold(
        per_second, keys=["_ip"], order=["_second"], values=["_c", "_from", "_low", "_high"],
        out=[("_second", "bigint"), ("_anchor", "bigint"), ("_c", "bigint"), ("_from", "bigint"), ("_low", "string"),
             ("_high", "string")], step=step)
    inside = Window.partitionBy("_ip", "_anchor").orderBy("_second")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    seconds = segments.select(
        "_ip", "_second", "_anchor", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_n0"),
        F.min("_low").over(before).alias("_low0"), F.max("_high").over(before).alias("_high0"),
        F.min("_from").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("_first"))
    whole = segments.groupBy("_ip", "_anchor").agg(
        F.sum("_c").alias("n"), F.min("_low").alias("low"), F.max("_high").alias("high"), F.min("_from").alias("first"))
    earlier = whole.select("_ip", "_anchor", F.lag(F.struct("n", "low", "high", "first")).over(
        Window.partitionBy("_ip").orderBy("_anchor")).alias("_prior"))
    last = first_n(rows.select("_ip", "_second", (-F.col("_us")).alias("_back"), (-F.col("id")).alias("_id"), "url"),
                   ["_ip", "_second"], ["_back", "_id"], 19)
    tails = last.groupBy("_ip", "_second").agg(F.transform(
        F.reverse(F.array_sort(F.collect_list(F.struct("_back", "_id", "url")))), lambda x: x["url"]).alias("_tail"))
    recent = Window.partitionBy("_ip").orderBy("_second").rowsBetween(-19, -1)
    tails = tails.select("_ip", "_second", F.flatten(F.collect_list("_tail").over(recent)).alias("_urls0"))
    return seconds.join(earlier, ["_ip", "_anchor"]).join(tails, ["_ip", "_second"])


def ddos_score(requests: DataFrame, *, segment_seconds: int = 3600, repeated_agent: int = 100) -> DataFrame:
    """Flood score of each request from what its address did so far.

    Ten indicators. The connection of an address (its count, methods and first request) restarts
    with the first request that comes more than ``segment_seconds``, counted in whole seconds, after its start;
    that request itself is still judged by the old one. The list of its last 20 URLs and the count of a
    user agent never restart. An address is worked on second by second, so a busy one is
    spread over as many tasks as it has seconds. The ``repeated_agent``-th use of a user agent is
    looked up, and later uses count as repeated.
    """
    ua = F.coalesce("user_agent", F.lit("unknown"))
    rows = requests.withColumn("_ua", ua).withColumn("_us", micros(F.col("timestamp"))).withColumns({
        "_second": F.floor(F.col("_us") / 1_000_000), "_ip": F.coalesce("client_ip", F.lit(""))})
    known = _connections(rows, segment_seconds)
    uses = first_n(rows.select("_ua", "_us", "id"), ["_ua"], ["_us", "id"], repeated_agent)
    limit = uses.groupBy("_ua").agg(
        F.count("*").alias("_n"), F.max(F.struct("_us", "id")).alias("_last")
    ).filter(F.col("_n") == repeated_agent).select("_ua", "_last")
    rows = split_join(rows, limit, "_ua", by=["id"]).join(known, ["_ip", "_second"])
    order = Window.partitionBy("_ip", "_second").orderBy("_us", "id")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({
        "_row": F.row_number().over(order), "_low": F.min("method").over(so_far), "_high": F.max("method").over(so_far),
        "_own": F.collect_list("url").over(order.rowsBetween(-19, 0)),
    })
    restarts = (F.col("_n0") == 0) & (F.col("_row") == 1) & F.col("_prior").isNotNull()
    old = F.col("_prior")
    rows = rows.withColumns({
        "_n": F.when(restarts, old["n"] + 1).otherwise(F.col("_n0") + F.col("_row")),
        "_first": F.when(restarts, old["first"]).otherwise(F.col("_first")),
        "_low": F.least("_low", F.when(restarts, old["low"]).otherwise(F.col("_low0"))),
        "_high": F.greatest("_high", F.when(restarts, old["high"]).otherwise(F.col("_high0"))),
        "_urls": F.reverse(F.slice(F.reverse(F.concat("_urls0", "_own")), 1, 20)),
    })

    def points(test: Column, n: int) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)

    u, n = F.col("_ua"), F.col("_n")
    h = F.col("headers")

    def header(name: str) -> Column:
        return F.try_element_at(h, F.lit(name))

    missing = sum((header(x).isNull().cast("int") for x in ("accept", "accept-language", "accept-encoding")), F.lit(0))
    elapsed = (F.col("_us") - F.col("_first")) / 1e6
    empty = u.isin("", "unknown", "-")
    query = F.regexp_extract("url", r"^[^?]*\?([\s\S]*)$", 1)
    parts = {
        "agent": points(empty | ((F.length(u) < 10) & ~F.contains(u, F.lit("Mozilla"))), 1),
        "repeated_agent": points(F.struct("_us", "id") > F.col("_last"), 1),
        "hammering": points((F.size("_urls") >= 10) & (F.size(F.array_distinct("_urls")) <= 2), 2),
        "methods": points((F.col("_low") != F.col("_high")) & (n > 20), 1),
        "headers": points(missing >= 2, 1),
        "frequency": points((elapsed > 0) & (n / elapsed > 10), 2),
        "empty_body": points(F.col("method").isin("POST", "PUT")
                             & (F.coalesce(header("content-length"), F.lit("0")) == "0"), 1),
        "long_query": points(F.length(query) > 500, 1),
        "tool": points(F.lower(u).rlike("|".join(FLOOD_TOOLS)), 3),
        "keep_alive": points(F.contains(F.lower(F.coalesce(header("connection"), F.lit(""))), F.lit("keep-alive"))
                             & (n > 50), 1),
    }
    local = F.col("client_ip").isin(*LOOPBACK, "0.0.0.0")
    score = F.when(local, 0).otherwise(sum(parts.values(), F.lit(0)))
    names = F.array(*[F.when(~local & (p > 0), F.lit(k)) for k, p in parts.items()])
    return rows.select(
        *requests.columns, score.alias("ddos_score"), F.filter(names, lambda x: x.isNotNull()).alias("indicators"))


def _admit(limit: int, window: int, burst: int, burst_window: int, block: int):
    def step(state, row):
        second, n = row
        held, until = state or ([], None)
        if until is not None and second < until:
            return (held, until), [(second, n, 0, 0, 0, n)]
        held = [h for h in held if h[0] > second - window]
        current = sum(h[1] for h in held)
        recent = sum(h[1] for h in held if h[0] > second - burst_window)
        accepted = min(n, max(0, min(limit - current, burst - recent)))
        rest = n - accepted
        if accepted:
            held = held + [[second, accepted]]
        burst_hit = blocked = limited = 0
        if rest and recent + accepted >= burst:
            burst_hit, blocked = 1, (rest - 1 if block else 0)
            if not block:
                burst_hit = rest
            else:
                until = second + block
        else:
            limited = rest
        return (held, until), [(second, n, accepted, limited, burst_hit, blocked)]

    return step


def rate_limit_replay(
    requests: DataFrame, *, limit: int = 100, window: int = 60, burst: int | None = None, burst_window: int = 5,
    block_seconds: int = 86400,
) -> DataFrame:
    """Admission control replayed over a request log, per address and second.

    At most ``limit`` requests are accepted in ``window`` seconds; once ``burst``
    (half the limit) were accepted in ``burst_window`` seconds the next one is
    refused and the address blocked for ``block_seconds``. What was refused does
    not count against the limit. The fold sees one row per address and second
    and remembers at most ``window`` of them.
    """
    second = F.floor(micros(F.col("timestamp")) / 1_000_000)
    counts = requests.groupBy("client_ip", second.alias("second")).agg(F.count("*").alias("n"))
    step = _admit(limit, window, limit // 2 if burst is None else burst, burst_window, block_seconds)
    out = ordered_fold(
        counts, keys=["client_ip"], order=["second"], values=["n"],
        out=[("second", "bigint"), ("requests", "bigint"), ("accepted", "bigint"), ("rate_limited", "bigint"),
             ("burst_refused", "bigint"), ("blocked", "bigint")], step=step)
    return out.withColumn("second", from_micros(F.col("second") * 1_000_000))


def admit_requests(requests: DataFrame, replay: DataFrame) -> DataFrame:
    """Each request with its ``admission``: accepted, rate_limited, burst or blocked."""
    order = Window.partitionBy("client_ip", "second").orderBy("timestamp", "id")
    rows = requests.withColumn("second", floor_to(F.col("timestamp"), 1)).withColumn(
        "_n", F.row_number().over(order))
    joined = rows.join(replay, ["client_ip", "second"])
    n, a = F.col("_n"), F.col("accepted")
    kind = (F.when(n <= a, "accepted").when(n <= a + F.col("rate_limited"), "rate_limited")
            .when(n <= a + F.col("rate_limited") + F.col("burst_refused"), "burst").otherwise("blocked"))
    return joined.select(*[joined[c] for c in requests.columns], kind.alias("admission"))


def rate_profile(requests: DataFrame, *, limit: int = 100, window: int = 60, warn_share: float = 0.8) -> DataFrame:
    """Requests per address and window, the share of the limit and whether it is close."""
    counts = requests.groupBy("client_ip", floor_to(F.col("timestamp"), window).alias("window_start")).agg(
        F.count("*").alias("requests"))
    share = F.col("requests") / F.lit(limit)
    return counts.withColumn("share", F.round(share, 6)).withColumn("near_limit", share >= warn_share)


def distributed_attack(
    requests: DataFrame, *, window: str = "10 seconds", slide: str = "5 seconds", min_requests: int = 500,
    min_ips: int = 10, many_ips: int = 50,
) -> DataFrame:
    """Windows with more than ``min_requests`` requests from ``min_ips`` or more addresses.

    Also windows with more than ``many_ips`` addresses, the mark of slow attacks.
    Rows are first summed per window and address.
    """
    per_ip = requests.groupBy(F.window("timestamp", window, slide).alias("w"), "client_ip").agg(
        F.count("*").alias("n"))
    wins = per_ip.groupBy("w").agg(F.sum("n").alias("requests"), F.count("*").alias("ips"))
    distributed = (F.col("requests") > min_requests) & (F.col("ips") >= min_ips)
    slow = F.col("ips") > many_ips
    return wins.filter(distributed | slow).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "requests", "ips",
        distributed.alias("is_distributed"), slow.alias("many_sources"))


def request_metrics(events: DataFrame, *, period_seconds: int = 86400) -> DataFrame:
    """Totals per period. ``events``: timestamp, threat_type, blocked 0/1, response_ms."""
    return events.groupBy(floor_to(F.col("timestamp"), period_seconds).alias("period")).agg(
        F.count("*").alias("total_requests"), F.count_if(F.col("blocked") == 1).alias("blocked_requests"),
        F.count_if(F.col("blocked") == 0).alias("allowed_requests"),
        F.count_if(F.col("threat_type") != "none").alias("threats_detected"),
        F.round(F.avg("response_ms"), 3).alias("avg_response_ms"))
