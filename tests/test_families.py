"""The shared passes find exactly what each detector finds by itself, log ids included."""

from functools import reduce

import pytest
from pyspark.sql import functions as F

from duskwatch.operators import alerts, behavior, correlate, families
from duskwatch.schema import HITS
from tests.conftest import SF
from workload import tables as T
from workload.alerts import DAY, LIMITS


def rows(df):
    return sorted(map(str, df.select(*[f.name for f in HITS]).collect()))


@pytest.mark.parametrize("listed", [families.LISTED, 0])
def test_same_findings(spark, monkeypatch, listed):
    monkeypatch.setattr(families, "LISTED", listed)
    logs = T.logs(spark, SF).withColumn("session_id", F.when(F.col("id") % 50 != 0, F.col("session_id")))
    limits = LIMITS | {"coordinated_path": {"threshold": 3}, "recon_exploit": {"min_attacks": 15}}
    alone = [getattr(behavior if hasattr(behavior, n) else correlate, n)(logs, cycle=DAY, **limits.get(n, {}))
             for n in families.MOST_IDS]
    alone = reduce(lambda a, b: a.unionByName(b), [f.drop("cycle_start") for f in alone])
    together = families.findings(logs, cycle=DAY, limits=limits, detectors=list(families.MOST_IDS))
    got = rows(together)
    assert got == rows(alone) and len(got) > 500


def test_scans(spark):
    """A scan cycle over all detectors reads the logs a fixed, small number of times."""
    found = alerts.detect(T.logs(spark, SF), cycle=DAY, limits=LIMITS)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 16


def test_rows_are_trimmed_before_they_move(spark):
    """The pass for the log ids joins inside the tasks that read the logs; what it shuffles has been limited per finding."""
    logs = T.logs(spark, SF).select("*", F.lit(1).alias("one")).drop("one")
    found = families.findings(logs, cycle=DAY, limits=LIMITS, detectors=list(families.MOST_IDS))
    plan = found._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    exchanges = [i for i, line in enumerate(lines) if "Exchange hashpartitioning(cycle_start" in line and "subset" in line]
    below = [line for i in exchanges for line in lines[i + 1:i + 2]]
    assert any("WindowGroupLimit" in line for line in below)
    assert "Generate explode(array(struct" in plan and "BroadcastHashJoin" in plan
    assert not any("windowspecdefinition(cycle_start#" in line.split("windowspecdefinition")[-1].split(",")[0] and "partitionBy" in line for line in lines)
    for line in lines:
        if "windowspecdefinition(" in line:
            keys = line.split("windowspecdefinition(")[1].split(" ASC")[0].split(", ")
            assert len(keys) > 2  # never by the cycle alone
