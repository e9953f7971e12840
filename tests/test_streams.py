"""Streams over several micro-batches give what the batch operators give."""

import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from duskwatch.operators import alerts, requests, rules
from duskwatch.schema import HITS
from duskwatch.streaming import jobs, scan, sessions, state
from tests.conftest import SF
from workload import tables as T
from workload.alerts import LIMITS

T0 = dt.datetime(2024, 1, 1)


def feed(spark, path, rows, schema, parts):
    """Write rows in time order as ``parts`` files and stream them one file at a time."""
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size:(i + 1) * size], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)


def test_rate_limit_over_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = sorted(((T0 + dt.timedelta(seconds=rng.randrange(0, 300)), rng.choice(["hot", "hot", "b"])) for _ in range(300)))
    rows += [(T0 + dt.timedelta(hours=1), "end")]
    schema = "timestamp timestamp_ntz, client_ip string"
    args = dict(limit=6, window=20, burst=4, burst_window=5, block_seconds=15)
    stream = jobs.stream_rate_limit(feed(spark, str(tmp_path / "in"), rows, schema, 5), delay="0 seconds", **args)
    jobs.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted(tuple(r) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect())
    batch = requests.rate_limit_replay(spark.createDataFrame(rows, schema), **args).filter("client_ip <> 'end'")
    assert got == sorted(tuple(r) for r in batch.collect())


def test_thresholds_over_batches(spark, tmp_path):
    rng = random.Random(6)
    rows = sorted(((T0 + dt.timedelta(seconds=rng.randrange(0, 200)), i, rng.choice("aab"), "BLOCKED") for i in range(200)))
    rows += [(T0 + dt.timedelta(hours=1), 999, "end", "BLOCKED")]
    schema = "timestamp timestamp_ntz, id bigint, src_ip string, action string"
    rule = [{"id": "r", "threshold": {"field": "src_ip", "count": 3, "window_seconds": 10}}]
    stream = jobs.stream_thresholds(feed(spark, str(tmp_path / "in"), rows, schema, 4), rule, delay="0 seconds")
    jobs.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted((r.group_key, r.second, r.fires) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect())
    batch = rules.threshold_reset(spark.createDataFrame(rows, schema), rule).collect()
    epoch = dt.datetime(1970, 1, 1)
    assert got == sorted((r.group_key, int((r.seen_at - epoch).total_seconds()), r.fires) for r in batch)


def state_rows(spark, checkpoint):
    """Keys that the fold of a finished stream still holds."""
    found = spark.read.format("state-metadata").load(checkpoint).filter("operatorName LIKE 'transformWithState%'").select("operatorId").distinct().first()
    return spark.read.format("statestore").option("operatorId", found[0]).option("stateVarName", "state").load(checkpoint).count()


def test_state_ends_with_its_window(spark, tmp_path):
    """Each of 40 addresses is seen for a while and never again: few keys stay, and results are those of the batch."""
    rng = random.Random(4)
    rows = sorted((T0 + dt.timedelta(seconds=30 * k + rng.randrange(0, 25)), k * 100 + i, f"ip{k}", "BLOCKED") for k in range(40) for i in range(6))
    rows += [(T0 + dt.timedelta(seconds=40 * 30 + 5), 9998, "last", "BLOCKED"), (T0 + dt.timedelta(seconds=40 * 30 + 6), 9999, "end", "BLOCKED")]
    schema = "timestamp timestamp_ntz, id bigint, src_ip string, action string"
    rule = [{"id": "r", "threshold": {"field": "src_ip", "count": 3, "window_seconds": 10}}]
    stream = jobs.stream_thresholds(feed(spark, str(tmp_path / "in"), rows, schema, 12), rule, delay="0 seconds")
    jobs.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted((r.group_key, r.second, r.fires) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect())
    batch = rules.threshold_reset(spark.createDataFrame(rows, schema), rule).collect()
    epoch = dt.datetime(1970, 1, 1)
    assert got == sorted((r.group_key, int((r.seen_at - epoch).total_seconds()), r.fires) for r in batch) and got
    assert state_rows(spark, str(tmp_path / "cp")) <= 8


def test_rate_limit_state_ends(spark, tmp_path):
    """An address comes back after its block: the same whether it was forgotten or not."""
    rows = [(T0 + dt.timedelta(seconds=s), "a") for s in [0] * 9 + [1, 30, 31] + [200] * 9 + [216]] + [
        (T0 + dt.timedelta(seconds=s), f"b{s}") for s in range(0, 1000, 10)]
    rows = sorted(rows) + [(T0 + dt.timedelta(hours=1), "end")]
    schema = "timestamp timestamp_ntz, client_ip string"
    args = dict(limit=6, window=20, burst=4, burst_window=5, block_seconds=15)
    stream = jobs.stream_rate_limit(feed(spark, str(tmp_path / "in"), rows, schema, 9), delay="0 seconds", **args)
    jobs.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted(tuple(r) for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect())
    batch = requests.rate_limit_replay(spark.createDataFrame(rows, schema), **args).filter("client_ip <> 'end'")
    assert got == sorted(tuple(r) for r in batch.collect())
    assert state_rows(spark, str(tmp_path / "cp")) <= 25


def hit(i, seconds, key="k"):
    return (T0 + dt.timedelta(seconds=seconds), [i], "s", "t", "HIGH", f"ip{key}", "XSS", "/", 1, 0.5)


def test_alerts_over_batches(spark, tmp_path):
    """Merged in a stream, with alerts forgotten after their window, as in one batch."""
    rng = random.Random(9)
    rows = sorted(hit(i, rng.randrange(0, 3000), rng.choice("aaab")) for i in range(300)) + [hit(999, 9000, "end")]
    schema = ("seen_at timestamp_ntz, log_ids array<bigint>, source string, title string, severity string, src_ip string, attack_type string, "
              "http_path string, event_count bigint, confidence double")
    more = {"rule_id": F.lit("r"), "session_id": F.lit(None).cast("string"), "geo_country": F.lit(None).cast("string"),
            "mitre_tactic": F.lit(None).cast("string"), "mitre_technique": F.lit(None).cast("string")}
    stream = jobs.stream_alert_dedup(feed(spark, str(tmp_path / "in"), rows, schema, 7).withColumns(more), window_seconds=120, delay="0 seconds")
    jobs.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    found = spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).groupBy("alert_uid").agg(F.sum("event_count"), F.max("confidence"))
    batch = alerts.alert_dedup(spark.createDataFrame(rows, schema).withColumns(more), window_seconds=120).filter("src_ip <> 'ipend'")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, batch.select("alert_uid", "event_count", "confidence").collect()))
    assert state_rows(spark, str(tmp_path / "cp")) <= 2


def test_incidents_that_close(spark, tmp_path):
    """Alerts after a closing open the next incident; brute force, batch and stream agree."""
    rng = random.Random(21)
    rows, log, opened = [], [], {}
    for s in sorted(rng.sample(range(0, 4000), 400)):
        ip = rng.choice(["a", "a", "b", None])
        held = [h for h in opened.get(ip, []) if s - h[1] <= 300]
        if rng.random() < 0.35 and held:
            h = rng.choice(held)
            status = rng.choice(["CLOSED", "MITIGATED", "INVESTIGATING"])
            h[2] = status == "INVESTIGATING"
            log.append((T0 + dt.timedelta(seconds=s), h[0], ip, status))
        else:
            mine = next((h for h in held if h[2]), None)
            if mine is None:
                us = (T0 - dt.datetime(1970, 1, 1)) // dt.timedelta(seconds=1) + s
                mine = [hashlib.sha256(f"{ip or ''}|{us * 1000000}".encode()).hexdigest(), s, True, []]
                held.append(mine)
            mine[3].append(f"u{s}")
            rows.append((T0 + dt.timedelta(seconds=s), f"u{s}", rng.choice(["HIGH", "CRITICAL"]), f"t{s}", ip, "rule", "XSS", "/"))
            everything = opened.setdefault("all", [])
            if mine not in everything:
                everything.append(mine)
        opened[ip] = held
    want = sorted((h[0], u) for h in opened["all"] for u in h[3])
    schema = ("created_at timestamp_ntz, alert_uid string, severity string, title string, src_ip string, detection_source string, "
              "attack_type string, http_path string")
    more = {c: F.lit(None).cast("string") for c in ("mitre_tactic", "mitre_technique")}
    log_schema = "changed_at timestamp_ntz, incident_uid string, src_ip string, status string"
    changes = spark.createDataFrame(log + [(T0, "unknown", "a", "CLOSED")], log_schema)
    batch = spark.createDataFrame(rows, schema).withColumns(more)
    members = alerts.incident_members(batch, changes, window_seconds=300)
    assert sorted((r.incident_uid, r.alert_uid) for r in members.collect()) == want
    found = alerts.incident_escalation(batch, changes, window_seconds=300)
    sizes = {h[0]: len(h[3]) for h in opened["all"]}
    assert {r.incident_uid: r.alert_count for r in found.collect()} == sizes and len(sizes) > 30
    plain = alerts.incident_escalation(batch, window_seconds=300).count()
    assert alerts.incident_escalation(batch, changes.limit(0), window_seconds=300).count() == plain < len(sizes)

    end = (T0 + dt.timedelta(hours=9), "end", "HIGH", "t", "end", "rule", "XSS", "/")
    cut = [sum(1 for r in log if r[0] <= rows[len(rows) * i // 5 - 1][0]) for i in range(1, 6)]
    ends = [len(rows) * i // 5 for i in range(1, 6)]
    for i, (e, c) in enumerate(zip(ends, cut)):
        a0, c0 = (ends[i - 1], cut[i - 1]) if i else (0, 0)
        spark.createDataFrame(rows[a0:e] + ([end] if i == 4 else []), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "a"))
        spark.createDataFrame(log[c0:c if i < 4 else None], log_schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "c"))
    one = lambda p, sch: spark.readStream.schema(sch).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / p))
    stream = jobs.stream_incidents(one("a", schema).withColumns(more), one("c", log_schema), window_seconds=300, delay="0 seconds")
    jobs.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).groupBy("incident_uid").agg(
        F.sum("alert_count").alias("n"), F.min_by("title", "seen_at").alias("title"), F.min_by("priority", "seen_at").alias("priority"))
    wanted = found.select("incident_uid", "alert_count", "title", "priority")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
    assert state_rows(spark, str(tmp_path / "cp")) <= 2


def test_scan_survives_a_restart(spark, tmp_path, monkeypatch):
    """Batches that end in the middle and are replayed give the findings of the batch; late rows are set aside."""
    logs = T.logs(spark, SF).filter("timestamp < '2024-01-12'")
    path = tmp_path / "in"
    for a, b in ((0, 4), (4, 8), (8, 12)):
        day = F.dayofmonth("timestamp")
        logs.filter((day > a) & (day <= b)).coalesce(1).write.mode("append").parquet(str(path))
    late = logs.filter("timestamp < '2024-01-02'").limit(3).withColumn("id", F.col("id") + 10**9)
    late.coalesce(1).write.mode("append").parquet(str(path))

    def run():
        stream = spark.readStream.schema(logs.schema).option("maxFilesPerTrigger", 1).parquet(str(path))
        scan.stream_scan(stream, path=str(tmp_path / "scan"), checkpoint=str(tmp_path / "cp"), cycle=86400, delay=3600, limits=LIMITS).awaitTermination()

    real, calls = scan._Folders.remove, []

    def fails(self, folder):
        calls.append(folder)
        if len(calls) in (1, 4):
            raise RuntimeError("ended")
        real(self, folder)

    monkeypatch.setattr(scan._Folders, "remove", fails)
    for _ in range(4):
        try:
            run()
            break
        except Exception:
            continue
    closed = logs.filter("timestamp < '2024-01-11'")
    names = [f.name for f in HITS]
    got = sorted(map(str, scan.scan_hits(spark, str(tmp_path / "scan")).select(*names).collect()))
    assert got == sorted(map(str, alerts.detect(closed, cycle=86400, limits=LIMITS, across_cycles=False).select(*names).collect())) and got
    assert spark.read.schema(logs.schema).parquet(str(tmp_path / "scan/late")).count() == 3


def test_state_kept_from_changes(spark, tmp_path, monkeypatch):
    """Late changes, a batch that ends in the middle and one that is sent twice: the state is that of the batch and of a loop over the changes."""
    rng = random.Random(12)
    log = []
    for i in range(600):
        key = rng.choice([1, 1, 1, *range(2, 30), None])
        log.append((key, T0 + dt.timedelta(seconds=rng.randrange(0, 500)), i, rng.choice(["NEW", "RESOLVED", "FALSE_POSITIVE", None]),
                    rng.choice([None, None, 5, 6]), rng.choice([None, 9])))
    schema = "entity_id bigint, changed_at timestamp_ntz, seq bigint, status string, assigned_to bigint, incident_id bigint"
    loads = [log[:250], log[250:253], [], log[253:]]
    root = str(tmp_path / "state")

    def run():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        state.stream_alert_state(stream, path=root, checkpoint=str(tmp_path / "cp"), buckets=4).awaitTermination()

    real, calls = state._Versions.put, []

    def fails(self, batch, held):
        calls.append(batch)
        if len(calls) == 2:
            raise RuntimeError("ended")
        real(self, batch, held)

    monkeypatch.setattr(state._Versions, "put", fails)
    read = lambda: sorted(map(str, state.read_state(spark, root, fields=alerts.ALERT_STATE["fields"]).collect()))
    for n, load in enumerate(loads):
        spark.createDataFrame(load, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if n == 1:
            before = read()
            with pytest.raises(Exception):
                run()
            assert read() == before
        run()
    held = {}
    for key, at, seq, *values in sorted(log, key=lambda r: (r[1], r[2])):
        mine = held.setdefault(key, [None, None, None, None, None, 0])
        for j, v in enumerate(values):
            mine[j] = mine[j] if v is None else v
        mine[3] = at if values[0] in ("RESOLVED", "FALSE_POSITIVE") else mine[3]
        mine[4], mine[5] = at, mine[5] + 1
    rows = state.read_state(spark, root, fields=alerts.ALERT_STATE["fields"])
    assert {r[0]: list(r[1:]) for r in rows.select(
        "entity_id", "status", "assigned_to", "incident_id", "resolved_at", "updated_at", "changes").collect()} == held
    batch = alerts.alert_state(spark.createDataFrame(log, schema))
    assert sorted(map(str, batch.select(*rows.columns).collect())) == read()
    after = read()
    last = max((tmp_path / "cp/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    done = len(calls)
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    assert len(calls) == done + 1 and read() == after
    assert len(list((tmp_path / "state/versions").iterdir())) == 2


def test_state_of_another_checkpoint(spark, tmp_path):
    schema = "entity_id bigint, changed_at timestamp_ntz, seq bigint, status string, priority string, assigned_to bigint"
    for i in range(2):
        spark.createDataFrame([(i, T0, i, "CLOSED", None, None)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        state.stream_incident_state(stream, path=str(tmp_path / "state"), checkpoint=str(tmp_path / "cp")).awaitTermination()
    again = state.stream_incident_state(stream, path=str(tmp_path / "state"), checkpoint=str(tmp_path / "cp2"))
    with pytest.raises(Exception, match="another checkpoint"):
        again.awaitTermination()
    with pytest.raises(ValueError):
        state.read_state(spark, str(tmp_path / "none"), fields=[])


def test_sessions_end_by_silence(spark, tmp_path):
    """Sessions across cycle borders and batches: a loop over the rows, the batch and the stream agree."""
    rng = random.Random(31)
    ranks = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
    rows, clock = [], {}
    for i in range(500):
        sid = rng.choice(["hot", "hot", "a", "b", "c", "d", ""])
        clock[sid] = clock.get(sid, 50 + rng.randrange(20)) + rng.choice([0, 0, 1, 2, 5, 19, 20, 21, 40])
        grade = ranks[min(4, i // 40 % 5)] if sid in "ab" else rng.choice(ranks)
        rows.append((T0 + dt.timedelta(seconds=clock[sid], microseconds=rng.randrange(10**6)), i, sid, f"ip{rng.randrange(3)}",
                     rng.choice(["NONE", "NONE", "XSS", "SQLI", "RCE"]), grade, rng.choice(["", "DE", "FR", "US", "BR"])))
    rows.sort()
    want = []
    for sid in sorted({r[2] for r in rows} - {""}):
        mine = [r for r in rows if r[2] == sid]
        runs = [[mine[0]]]
        for r in mine[1:]:
            silent = r[0].replace(microsecond=0) - runs[-1][-1][0].replace(microsecond=0) > dt.timedelta(seconds=20)
            runs.append([r]) if silent else runs[-1].append(r)
        for run in runs:
            kinds, grades = sorted({r[4] for r in run} - {"NONE"}), [ranks.index(r[5]) for r in run]
            edges = {g: [r[1] for r in run if ranks.index(r[5]) == g] for g in set(grades)}
            ids = {i for e in edges.values() for i in (e[0], e[-1])}
            base = (sid, run[0][0], run[-1][0], run[0][3], len(run), [r[1] for r in run if r[1] in ids])
            if len(run) >= 2 and len(kinds) >= 2:
                want.append((*base, "Session multi-attack: " + ", ".join(kinds)))
            if len(run) >= 3 and grades == sorted(grades) and grades[-1] >= 3:
                want.append((*base, "Escalating severity in session"))
            if len({r[6] for r in run} - {""}) >= 3:
                want.append((*base, "Multi-country session anomaly"))
    assert len({w[-1] for w in want}) > 3 and any(w[-1].startswith("Esc") for w in want) and len(want) > 30
    schema = "timestamp timestamp_ntz, id bigint, session_id string, src_ip string, attack_type string, severity string, geo_country string"
    cols = ["session_id", "cycle_start", "seen_at", "src_ip", "event_count", "log_ids", "title"]
    got = lambda df: sorted(map(str, (tuple(r) for r in df.select(*cols).collect())))
    batch = sessions.stream_silent_sessions(spark.createDataFrame(rows, schema), gap_seconds=20)
    assert got(batch) == sorted(map(str, want))
    end = rows + [(rows[-1][0] + dt.timedelta(hours=1), 9999, "end", "ip", "NONE", "INFO", "")]
    stream = sessions.stream_silent_sessions(feed(spark, str(tmp_path / "in"), end, schema, 6), gap_seconds=20, delay="0 seconds")
    jobs.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    written = spark.read.schema(stream.schema).parquet(str(tmp_path / "out"))
    assert got(written) == sorted(map(str, want))
    hits = spark.readStream.schema(HITS).parquet(str(tmp_path / "out"))
    jobs.run_to_end(jobs.stream_alert_dedup(hits, delay="0 seconds"), str(tmp_path / "alerts"), str(tmp_path / "cp2"))
    assert spark.read.parquet(str(tmp_path / "alerts")).count() > 0
    assert got(sessions.stream_silent_sessions(spark.createDataFrame([], schema))) == []


def test_silent_sessions_hold_their_state_on_disk(spark, tmp_path):
    """Whatever the session says of providers before; Spark's default holds the whole backlog in the heap of the executors."""
    key = "spark.sql.streaming.stateStore."
    names = [key + n for n in ("providerClass", "rocksdb.boundedMemoryUsage", "rocksdb.maxMemoryUsageMB")]
    held = {n: spark.conf.get(n, None) for n in names}
    try:
        for n in names:
            spark.conf.unset(n)
        spark.conf.set(names[2], "100")
        schema = "timestamp timestamp_ntz, id bigint, session_id string, src_ip string, attack_type string, severity string, geo_country string"
        rows = [(T0 + dt.timedelta(microseconds=i), i, "a", f"ip{i}", ["XSS", "RCE"][i % 2], ["high", "LOW", "odd"][i % 3], "DE") for i in range(9)]
        end = [(T0 + dt.timedelta(hours=2), 99, "end", "ip", "NONE", "INFO", "")]
        stream = sessions.stream_silent_sessions(feed(spark, str(tmp_path / "in"), rows + end, schema, 1), delay="0 seconds")
        jobs.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
        assert "RocksDBStateStoreProvider" in (tmp_path / "cp/offsets/0").read_text()
        assert spark.conf.get(names[1]) == "true" and spark.conf.get(names[2]) == "100"
        got = spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).select("session_id", "src_ip", "event_count", "log_ids", "seen_at")
        # One second with rows of three grades, of which the unknown one counts as INFO.
        assert [tuple(r) for r in got.collect()] == [("a", "ip0", 9, [0, 1, 2, 6, 7, 8], rows[-1][0])]
    finally:
        for n, value in held.items():
            spark.conf.unset(n) if value is None else spark.conf.set(n, value)
