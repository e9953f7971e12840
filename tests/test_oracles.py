"""Registered queries against their SQL on the small tables (ALL_ORACLES=1 runs every one)."""

import os

import pytest

import __spark_entry__ as entry_points
from tests.conftest import SF
from tools.check import connect, norm

SAMPLE = """
top_attackers soc_kpis threat_timeline live_activity geo_distribution log_search hunt_search alert_search
model_suggestions signature_hits request_rule_violations threshold_rolling threshold_reset high_request_rate ip_burst
rate_baseline scan_path_hits multi_country_session multi_vector_ip session_escalation attack_burst recon_exploit_ordered
geo_enrich ip_reputation blocked_traffic alert_pipeline_delay tracked_users alert_groups alert_stats incident_escalation
incident_timeline alert_state response_plan playbook_notices pending_blocks ingest_json_logs ingest_syslog_logs
ingest_raw_logs canonical_logs effective_client_ip ddos_score rate_limit_replay query_profile classify_requests
heuristic_score blend_scores retention_tiers latency_percentiles trial_summary system_load stream_rate_limit
""".split()
ORACLES = entry_points.oracle_sql()
NAMES = list(ORACLES) if os.environ.get("ALL_ORACLES") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    ours = entry_points.queries()[name](spark, SF).toArrow().to_pandas()
    theirs = duck.sql(ORACLES[name]).to_arrow_table().to_pandas()
    assert set(ours.columns) == set(theirs.columns)
    assert norm(ours) == norm(theirs)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry_points.queries())


def test_entry(spark):
    assert entry_points.entry(spark).count() == 10
