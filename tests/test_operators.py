"""Operators against brute force on small hand-made tables, with hot keys, ties and nulls."""

import datetime as dt
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from duskwatch.operators import alerts, correlate, enrich, requests, response, retention, rules, search
from duskwatch.operators.models import average_path, score_anomalies, train_anomaly_model
from duskwatch.plans.fold import anchored, ordered_fold
from duskwatch.plans.ranks import exact_rank_values
from duskwatch.plans import tiles
from duskwatch.plans.skew import split_join
from duskwatch.plans.tiles import run_starts
from duskwatch.sources import events as ev
from duskwatch.sources import ingest

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def log_frame(spark, rows):
    """rows: (id, seconds, ip, extra dict)"""
    base = dict(action="ALLOWED", attack_type="NONE", severity="INFO", http_path="/", session_id="s")
    data = [(i, at(s), ip, *[{**base, **x}[k] for k in base]) for i, s, ip, x in rows]
    return spark.createDataFrame(
        data, "id bigint, timestamp timestamp_ntz, src_ip string, action string, attack_type string, "
              "severity string, http_path string, session_id string")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_run_starts_with_a_hot_tile(spark, seed):
    rng = random.Random(seed)
    rows = [("hot", rng.randrange(0, 40), i) for i in range(300)]
    rows += [(f"k{i % 7}", rng.randrange(0, 400), 1000 + i) for i in range(120)]
    got = {r.k: (r.start_us, r.end_us) for r in run_starts(
        spark.createDataFrame(rows, "k string, us bigint, id bigint"), keys=["k"], us="us", order=["us", "id"],
        n=4, width_us=10).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        times = sorted((t, i) for kk, t, i in rows if kk == k)
        for a, b in zip(times, times[3:]):
            if b[0] - a[0] <= 10:
                want[k] = (a[0], b[0])
                break
    assert got == want


@pytest.mark.parametrize("accuracy", [50, 1000])
def test_exact_ranks_at_every_size(spark, accuracy):
    rng = random.Random(4)
    sizes = [*range(1, 40), 107, 999]
    rows = [(g, rng.choice([float(rng.randrange(50)), rng.random() * 50])) for g in sizes for _ in range(g)]
    got = exact_rank_values(spark.createDataFrame(rows, "g int, v double"), groups=["g"], value="v",
                            ps={"a": 0.5, "b": 0.95, "c": 0.0, "d": 1.0}, accuracy=accuracy)
    for r in got.collect():
        values = sorted(v for g, v in rows if g == r.g)
        assert [r.a, r.b, r.c, r.d] == [values[int(p * (len(values) - 1))] for p in (0.5, 0.95, 0.0, 1.0)]


def test_exact_ranks_use_the_sketch(spark):
    rng = random.Random(5)
    values = [("a", rng.choice([1.0, 2.0, rng.random() * 100])) for _ in range(4000)] + [("b", 7.0), ("b", None)]
    got = {r.g: (r.p50, r.p95) for r in exact_rank_values(
        spark.createDataFrame(values, "g string, v double"), groups=["g"], value="v",
        ps={"p50": 0.5, "p95": 0.95}, accuracy=50).collect()}
    for g in ("a", "b"):
        s = sorted(v for k, v in values if k == g and v is not None)
        assert got[g] == tuple(s[math.floor(p * (len(s) - 1))] for p in (0.5, 0.95))


def test_anchored_fold_null_key_and_boundaries(spark):
    rows = [("x", t) for t in (0, 10, 20, 30, 36)] + [(None, 5), (None, 20), (None, 21)]
    out = ordered_fold(spark.createDataFrame(rows, "k string, t bigint"), keys=["k"], order=["t"], values=[],
                       out=[("t", "bigint"), ("a", "bigint")], step=anchored(15)).collect()
    assert sorted((r.t, r.a) for r in out if r.k == "x") == [(0, 0), (10, 0), (20, 20), (30, 20), (36, 36)]
    assert sorted((r.t, r.a) for r in out if r.k is None) == [(5, 5), (20, 5), (21, 21)]


RULE = [{"id": "r", "name": "n", "severity": "HIGH", "type": "threshold",
         "threshold": {"field": "src_ip", "count": 3, "window_seconds": 10, "filter": {"action": "BLOCKED"}}}]


def test_threshold_reset_against_a_counter(spark):
    rng = random.Random(9)
    rows = [(i, rng.randrange(0, 60), rng.choice(["a", "a", "b"]), {"action": rng.choice(["BLOCKED", "ALLOWED"])})
            for i in range(300)]
    got = sorted((r.group_key, r.seen_at, r.fires) for r in rules.threshold_reset(log_frame(spark, rows), RULE).collect())
    want = defaultdict(int)
    for key in "ab":
        held = []
        for s in sorted(s for _, s, ip, x in rows if ip == key and x["action"] == "BLOCKED"):
            held = [h for h in held if h >= s - 10] + [s]
            if len(held) >= 3:
                want[(key, at(s))] += 1
                held = []
    assert got == sorted((k, t, n) for (k, t), n in want.items())


def test_threshold_rolling_reports_crossings(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(0, 200), "hot", {"action": "BLOCKED"}) for i in range(80)]
    got = sorted(r.id for r in rules.threshold_rolling(log_frame(spark, rows), RULE).collect())
    order = sorted((s, i) for i, s, _, _ in rows)
    counts = [sum(1 for s2, _ in order if s - 10 <= s2 <= s) for s, _ in order]
    want = sorted(i for n, ((s, i), c) in enumerate(zip(order, counts)) if c >= 3 and (n == 0 or counts[n - 1] < 3))
    assert got == want


@pytest.mark.parametrize("cells", [(1_000_000, 3_600_000_000), (2_000_000, 6_000_000), ()])
def test_running_sums_and_row_before(spark, cells):
    rng = random.Random(7)
    rows = [(k, us * 100_000, rng.randrange(-3, 4), rng.random() < 0.5 or None)
            for k, n in (("hot", 300), ("b", 9), ("c", 1)) for us in rng.sample(range(-50, 900), n)]
    df = spark.createDataFrame(rows, "k string, us bigint, _d bigint, _m boolean")
    got = sorted((r.k, r.us, r["_sum"], r["_last"]) for r in tiles.running(df, keys=["k"], us="us", cells=cells).collect())
    prior = sorted((r.k, r.us, r["_prior"]) for r in tiles.earlier(df, keys=["k"], us="us", cells=cells).collect())
    want, before, state = [], [], {}
    for k, us, d, m in sorted(rows, key=lambda r: r[:2]):
        total, last, seen = state.get(k, (0, None, None))
        want.append((k, us, total + d, last))
        before.append((k, us, seen))
        state[k] = (total + d, total + d if m else last, us)
    assert got == want and prior == before


@pytest.mark.parametrize("distinct", [None, "http_path"])
def test_rolling_thresholds_of_groups_and_values(spark, distinct):
    """Ties, null groups, null values and windows that end on a row."""
    rng = random.Random(12)
    rows = [(i, rng.randrange(0, 4000) / 4, rng.choice(["hot", "hot", "b", None]), {"http_path": rng.choice(["/a", "/b", "/c", "/d", None])})
            for i in range(400)]
    rule = [{"id": "r", "threshold": {"field": "src_ip", "count": 3, "window_seconds": 10, **({"distinct": distinct} if distinct else {})}}]
    got = sorted((r.group_key, r.id, r.event_count) for r in rules.threshold_rolling(log_frame(spark, rows), rule).collect())
    want, state = [], {}
    for s, i, ip, path in sorted((s, i, ip or "unknown", x["http_path"]) for i, s, ip, x in rows if not distinct or x["http_path"]):
        inside = [(i2, x["http_path"]) for i2, s2, ip2, x in rows if (ip2 or "unknown") == ip and s - 10 <= s2 <= s and (not distinct or x["http_path"])]
        n = len({p for _, p in inside}) if distinct else len(inside)
        if n >= 3 and state.get(ip, 0) < 3:
            want.append((ip, i, n))
        state[ip] = n
    assert got == sorted(want) and len(want) > 10


def test_busy_group_is_spread_over_time(spark):
    """A key with a third of all rows, all of them in one window, without adaptive execution."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(6000).select(
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"),
            (F.col("id") * 20_000).alias("us"), F.lit(1).cast("bigint").alias("_d"), F.lit(True).alias("_m"))
        rows = tiles.running(df, keys=["k"], us="us").groupBy(F.spark_partition_id().alias("p")).count().collect()
        sizes = sorted(r["count"] for r in rows)
        assert sizes[-1] < 1.5 * sizes[0]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_split_join_spreads_common_keys(spark):
    """A key with a third of the rows and one row in six without a key: right rows, even tasks, without adaptive execution."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        k = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 6 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id").cast("string")))
        large = spark.range(12000).select("id", k.alias("k"))
        facts = large.filter("k = 'hot' OR id % 4 = 0").select("k", F.concat(F.lit("v"), "k").alias("v")).distinct()
        joined = split_join(large, facts, "k", by=["id"], parts=64)
        assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
        sizes = sorted(r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect())
        assert len(sizes) == 4 and sizes[-1] < 2 * sizes[0]
        got = sorted(map(str, joined.select("id", "k", "v").collect()))
        assert got == sorted(map(str, large.join(facts, "k", "left").select("id", "k", "v").collect())) and len(got) == 12000
        assert split_join(large.limit(0), facts, "k", by=["id"]).count() == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_rules_edge_conditions(spark):
    logs = log_frame(spark, [(1, 0, "a", {"http_path": None}), (2, 1, "a", {"http_path": "/X.php?CMD"})])
    def fires(*conditions):
        return [r.log_ids[0] for r in rules.signature_hits(logs, [{"id": "r", "conditions": list(conditions)}]).collect()]
    assert fires({"field": "http_path", "operator": "not_equals", "value": "/"}) == [2]
    assert fires({"field": "http_path", "operator": "regex", "value": r"\.php\??cmd"}) == [2]
    assert fires({"field": "missing", "operator": "equals", "value": "1"}) == []
    assert fires({"field": "src_ip", "operator": "gt", "value": 3}) == []
    assert rules.signature_hits(logs, [{"id": "r", "conditions": []}]).count() == 0
    assert rules.signature_hits(logs, []).count() == 0


def test_never_falls(spark):
    rng = random.Random(3)
    rows = [(f"s{i % 40}", rng.randrange(0, 5), i) for i in range(160)]
    got = {r.k: r.up for r in spark.createDataFrame(rows, "k string, r int, t int").groupBy("k").agg(
        correlate.never_falls(F.col("r"), F.struct("t")).alias("up")).collect()}
    for k, up in got.items():
        ranks = [r for kk, r, t in sorted(rows, key=lambda x: x[2]) if kk == k]
        assert up == all(a <= b for a, b in zip(ranks, ranks[1:]))


@pytest.mark.parametrize("seed", [1, 2])
def test_blocked_traffic_against_brute_force(spark, seed):
    rng = random.Random(seed)
    reqs = [(i, at(rng.randrange(0, 9000)), rng.choice("aab")) for i in range(200)]
    blocks = []
    for i in range(15):
        c = rng.randrange(0, 9000)
        blocks.append((i, rng.choice("ab"), at(c), at(c + 3600) if i % 4 else None, at(c + 60) if i % 3 == 0 else None))
    got = {(r.id, r.block_id) for r in enrich.blocked_traffic(
        spark.createDataFrame(reqs, "id bigint, timestamp timestamp_ntz, src_ip string"),
        spark.createDataFrame(blocks, "block_id bigint, ip string, created_at timestamp_ntz, expires_at timestamp_ntz, "
                                      "revoked_at timestamp_ntz"), tile_seconds=600).collect()}
    want = set()
    for i, t, ip in reqs:
        before = [b for b in blocks if b[1] == ip and b[2] <= t]
        if before:
            b = max(before, key=lambda b: (b[2], b[0]))
            if t < min(b[4] or at(10 ** 9), b[3] or at(10 ** 9)):
                want.add((i, b[0]))
    assert got == want


def test_rate_limit_against_one_by_one(spark):
    rng = random.Random(8)
    rows = [(i, at(rng.randrange(0, 90)), rng.choice(["hot", "hot", "hot", "b"])) for i in range(400)]
    frame = spark.createDataFrame(rows, "id bigint, timestamp timestamp_ntz, client_ip string")
    replay = requests.rate_limit_replay(frame, limit=6, window=20, burst=4, burst_window=5, block_seconds=15)
    got = {r.id: r.admission for r in requests.admit_requests(frame, replay).collect()}
    want = {}
    for ip in ("hot", "b"):
        held, until = [], None
        for t, i in sorted((t, i) for i, t, k in rows if k == ip):
            s = (t - T0).total_seconds()
            if until is not None and s < until:
                want[i] = "blocked"
                continue
            held = [h for h in held if h > s - 20]
            if sum(h > s - 5 for h in held) >= 4:
                want[i], until = "burst", s + 15
            elif len(held) >= 6:
                want[i] = "rate_limited"
            else:
                want[i] = "accepted"
                held.append(s)
    assert got == want


PAYLOADS = {
    "/a?u=admin' OR '1'='1'--": "sql_injection", "/a?id=1 UNION SELECT 1,2,3--": "sql_injection",
    "/a?u=' OR 1=1#": "sql_injection", "/a?id=1; DROP TABLE users;--": "sql_injection",
    "/s?q=<script>alert(1)</script>": "xss_attempt", "/s?q=<img src=x onerror=alert(1)>": "xss_attempt",
    "/s?q=javascript:alert(1)": "xss_attempt", "/s?q=<svg onload=alert(1)>": "xss_attempt",
    "/f?name=../../etc/passwd": "path_traversal", "/f?name=$(whoami)": "command_injection",
    "/f?name=<b >x": "html_injection", "/f?x=http://localhost/": "ssrf_attempt", "/x?role=admin": "auth_bypass_attempt",
    "/x?a=*)(uid": "ldap_injection", "/index.html": "none", "/health?q=<script>": "none",
}


def test_labelled_payloads(spark):
    rows = [(i, "9.9.9.9", u, None, "Mozilla/5.0 (X11)") for i, u in enumerate(PAYLOADS)]
    frame = spark.createDataFrame(rows, "id bigint, client_ip string, url string, body string, user_agent string")
    got = {r.url: r.threat_type for r in requests.classify_requests(frame).collect()}
    assert got == PAYLOADS


def test_verdict_survives_a_filter_once(spark):
    rows = [(1, "9.9.9.9", "/s?q=<script>", None, "x")]
    frame = spark.createDataFrame(rows, "id bigint, client_ip string, url string, body string, user_agent string")

    def matches(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("RLIKE")

    verdicts = requests.classify_requests(frame)
    assert matches(verdicts.filter("threat_type = 'xss_attempt'")) == matches(verdicts)


def test_ingest_edges(spark):
    lines = ['{"source_ip": " 10.0.0.9 ", "source_port": 99999, "action": "rate limited", "time": "2024-01-05 14:23:01"}',
             "not json", "{}", '{"confidence": "high"}', '{"src_ip": "1.2.3.4", "confidence": 7, "attack_type": "sqli"}',
             '[1, 2]']
    parsed = ingest.parse_json_lines(spark.createDataFrame([(x,) for x in lines], "line string"), now="2024-06-01")
    assert [r.ok for r in parsed.collect()] == [True, False, True, False, True, False]
    rows = {r.src_ip: r for r in ingest.canonical_logs(parsed, source_format="json", received_at="2024-06-01").collect()}
    assert rows["10.0.0.9"].src_port is None and rows["10.0.0.9"].action == "RATE_LIMITED"
    assert rows["10.0.0.9"].timestamp == dt.datetime(2024, 1, 5, 14, 23, 1)
    assert rows["0.0.0.0"].protocol == "HTTP" and rows["0.0.0.0"].timestamp == dt.datetime(2024, 6, 1)
    assert rows["1.2.3.4"].confidence == 1.0 and rows["1.2.3.4"].mitre_technique == "T1190"
    syslog = ["<134>Jan  5 14:23:01 firewall01 WAF: action=BLOCKED src_ip=192.168.1.100 dstport=x",
              "src_ip=10.0.0.1 action=ALLOWED dst_ip=192.168.1.1", "nothing here"]
    got = ingest.parse_syslog_lines(spark.createDataFrame([(x,) for x in syslog], "line string"), now="2024-06-01").collect()
    assert [(r.src_ip, r.action, r.dst_port) for r in got] == [
        ("192.168.1.100", "BLOCKED", None), ("10.0.0.1", "ALLOWED", None), ("0.0.0.0", None, None)]
    assert got[0].timestamp == dt.datetime(2024, 1, 5, 14, 23, 1)
    raw = ["Connection from 192.168.1.50 to 10.0.0.1 port 443 BLOCKED", "GET /api/users HTTP/1.1 200 OK from 10.0.0.1"]
    got = ingest.parse_raw_lines(spark.createDataFrame([(x,) for x in raw], "line string"), now="2024-06-01").collect()
    assert (got[0].src_ip, got[0].dst_ip, got[0].action) == ("192.168.1.50", "10.0.0.1", "BLOCKED")
    assert (got[1].http_method, got[1].http_path, got[1].http_status) == ("GET", "/api/users", 200)


def test_hunt_string():
    assert search.parse_hunt('src:1.2 attack:SQLI text:a search:b "free text" odd:x path:') == {
        "src_ip": "1.2", "attack_type": "SQLI", "search": "a b", "free": "free text odd:x path:"}


def test_incident_membership_is_exact(spark):
    rows = spark.createDataFrame([(1, T0, ["11.2.3.45"]), (2, T0, ["1.2.3.4"])],
                                 "id bigint, created_at timestamp_ntz, affected_ips array<string>")
    assert [r.id for r in search.incident_search(rows, affected_ip="1.2.3.4").collect()] == [2]


def test_forwarded_for(spark):
    rows = spark.createDataFrame(
        [("10.0.0.1", "junk, 8.8.8.8, 1.1.1.1", "9.9.9.9"), ("10.0.0.1", None, "9.9.9.9"), ("10.0.0.1", "", "unknown"),
         ("5.5.5.5", "8.8.8.8", None), (None, "8.8.8.8", None)], "client_ip string, x_forwarded_for string, x_real_ip string")
    got = [r.effective_ip for r in ev.effective_client_ip(rows, trusted=["10.0.0.0/8"]).collect()]
    assert got == ["8.8.8.8", "9.9.9.9", "10.0.0.1", "5.5.5.5", "unknown"]


def test_join_ranges_splits_wide_ranges(spark):
    wide = (10 << 24, (10 << 24) + (3 << 16) - 1, "W")
    ranges = spark.createDataFrame([wide, (0x0A030000, 0x0A030010, "S")], "start bigint, end bigint, country string")
    ips = spark.createDataFrame([("10.0.0.0",), ("10.2.255.255",), ("10.3.0.16",), ("10.3.0.17",), ("::1",), (None,)], "ip string")
    got = {r.ip: r.country for r in enrich.join_ranges(ips, ranges, ip="ip", cols=["country"]).collect()}
    assert got == {"10.0.0.0": "W", "10.2.255.255": "W", "10.3.0.16": "S"}


def test_response_waits_for_cooldown_and_expiry(spark):
    book = [{"id": "p", "name": "P", "cooldown_seconds": 10, "trigger": {},
             "actions": [{"action": "block_ip", "duration_seconds": 25}]}]
    rows = [(i, at(s), "a", "HIGH", "SQLI", 1, "t", "rule") for i, s in enumerate([0, 5, 10, 24, 25, 36])]
    frame = spark.createDataFrame(rows, "id bigint, created_at timestamp_ntz, src_ip string, severity string, "
                                        "attack_type string, event_count bigint, title string, detection_source string")
    assert sorted(r.second for r in response.playbook_runs(frame, book).collect()) == [
        int((at(s) - dt.datetime(1970, 1, 1)).total_seconds()) for s in (0, 10, 24, 36)]
    assert sorted(r.created_at for r in response.response_plan(frame, book).collect()) == [at(0), at(36)]


def test_dedup_window_is_anchored(spark):
    rows = [("rule", "r", at(s), "a", "X", None, 1, 0.5 + s / 10000, [s]) for s in (0, 600, 900, 903, 1500)]
    rows.append(("rule", "r", at(5), None, "X", None, 0, 0.1, [7]))
    hits = spark.createDataFrame(
        rows, "source string, rule_id string, seen_at timestamp_ntz, src_ip string, attack_type string, http_path string, "
              "event_count bigint, confidence double, log_ids array<bigint>")
    for c in ("title", "severity", "session_id", "geo_country", "mitre_tactic", "mitre_technique"):
        hits = hits.withColumn(c, F.lit("v"))
    got = sorted((r.src_ip or "", r.created_at, r.event_count) for r in alerts.alert_dedup(hits).collect())
    assert got == [("", at(3), 1), ("a", at(0), 3), ("a", at(903), 2)]
    assert alerts.alert_members(hits).count() == 6


AGES = {"hot_days": 3, "warm_days": 5, "cold_days": 8}
AGED = {2: "cold", 3: "cold", 4: "cold", 5: "warm", 6: "warm", 7: "hot", 8: "hot", 9: "hot"}


def tiers(spark, path):
    found = retention.TieredTable(spark, path).read().collect()
    assert len(found) == len({r.id for r in found})
    return {r.id: r.tier for r in found}


@pytest.mark.parametrize("versioned", [True, False])
def test_age_table_moves_and_purges(spark, tmp_path, versioned):
    rows = log_frame(spark, [(d, d * 86400, "a", {}) for d in range(10)]).withColumn("tier", F.lit("hot"))
    path = str(tmp_path / "logs")
    if versioned:
        retention.append_rows(spark, path, rows.filter("id < 5"))
        retention.append_rows(spark, path, rows.filter("id >= 5"))
    else:
        ingest.append_logs(rows, path)
    retention.age_table(spark, path, now="2024-01-11", **AGES)
    assert tiers(spark, path) == AGED
    report = retention.age_table(spark, path, now="2024-01-12", **AGES)
    got = tiers(spark, path)
    assert got == {3: "cold", 4: "cold", 5: "cold", 6: "warm", 7: "warm", 8: "hot", 9: "hot"}
    assert report == {"read": ["2024-01-06", "2024-01-08"], "removed": ["2024-01-03"]}
    assert retention.age_table(spark, path, now="2024-01-12", **AGES) == {"read": [], "removed": []} and tiers(spark, path) == got
    retention.append_rows(spark, path, log_frame(spark, [(20, 10 * 86400, "a", {}), (21, 3 * 86400, "a", {})]))
    assert tiers(spark, path) == got | {20: "hot", 21: "hot"}
    retention.age_table(spark, path, now="2024-01-12", **AGES)
    assert tiers(spark, path) == got | {20: "hot", 21: "cold"}
    held = {str(p.parent.relative_to(path)) for p in (tmp_path / "logs").rglob("part-*.parquet")}
    table = retention.TieredTable(spark, path)
    assert set(table.folders()) <= held <= set(table.folders()) | set(table.folders(table.version() - 1))


def test_ids_of_appended_loads_differ(spark):
    """Three equal lines in each of two loads are six rows with six ids; a load that is read again has the same ones."""
    lines = spark.createDataFrame([('{"timestamp": "2024-01-01T00:00:00", "src_ip": "10.0.0.1", "http_path": "/"}',)] * 3, "line string").coalesce(1)

    def ids(batch):
        parsed = ingest.PARSERS["json"](lines, now="2024-01-02")
        return [r.id for r in ingest.canonical_logs(parsed, source_format="json", received_at="2024-01-02", batch=batch).collect()]

    first, second = ids(1), ids(2)
    assert len(set(first + second)) == 6 and ids(1) == first


class Killed(Exception):
    pass


@pytest.mark.parametrize("versioned", [True, False])
@pytest.mark.parametrize("step, late", [("write", False), ("write", True), ("commit", False), ("commit", True), ("sweep", False), ("delete", True)])
def test_age_table_may_end_anywhere(spark, tmp_path, monkeypatch, versioned, step, late):
    """A cycle that is ended before or after any step, or between its deletes, and run again gives each row once."""
    rows = log_frame(spark, [(d, d * 86400 + h * 3600, "a", {}) for d in range(10) for h in [0]]).withColumn("tier", F.lit("hot"))
    path = str(tmp_path / "logs")
    retention.append_rows(spark, path, rows) if versioned else ingest.append_logs(rows, path)
    before = tiers(spark, path)
    if step == "delete":
        names = retention.TieredTable._names
        seen = []

        def slow(self, folder):  # ends while the folders of the second tier are being listed for removal
            seen.append(folder)
            if seen.count("held/tier=warm") > 1:
                raise Killed
            return names(self, folder)
        patched, real = "_names", slow
    else:
        whole = getattr(retention.TieredTable, step)

        def real(self, *args):
            if late:
                whole(self, *args)
            raise Killed
        patched = step
    with monkeypatch.context() as m:
        m.setattr(retention.TieredTable, patched, real)
        for _ in range(2):
            try:
                retention.age_table(spark, path, now="2024-01-11", **AGES)
            except Killed:
                pass
    assert tiers(spark, path) in (before, AGED)
    retention.age_table(spark, path, now="2024-01-11", **AGES)
    assert tiers(spark, path) == AGED
    assert retention.age_table(spark, path, now="2024-01-11", **AGES) == {"read": [], "removed": []}


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    path = str(tmp_path / "logs")
    rows = log_frame(spark, [(d, d * 86400, "a", {}) for d in range(3)])
    retention.append_rows(spark, path, rows)
    table = retention.TieredTable(spark, path)
    base, have = table.version(), table.folders()
    retention.append_rows(spark, path, log_frame(spark, [(7, 0, "b", {})]))
    with pytest.raises(RuntimeError):
        table.commit(base, have)
    assert set(tiers(spark, path)) == {0, 1, 2, 7}


def test_anomaly_model_finds_the_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, rng.random(), 10 + rng.random(), 0.0, rng.random() / 5, 0.5) for i in range(400)]
    rows += [(1000 + i, 90.0 + i, 900.0, 1.0, 0.99, 0.1) for i in range(4)]
    frame = spark.createDataFrame(
        rows, "id bigint, ddos_score double, payload_length double, blocked double, ai_score double, ai_confidence double")
    model = train_anomaly_model(frame, key=["id"], trees=40, sample=64)
    scored = {r.id: r for r in score_anomalies(model, frame).collect()}
    assert all(scored[1000 + i].is_anomaly for i in range(4))
    assert sum(r.is_anomaly for r in scored.values()) <= 20
    assert average_path(2) == 1.0
