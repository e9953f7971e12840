"""All registered queries."""

from __future__ import annotations

from importlib import import_module

from workload.common import ORACLES, QUERIES

AREAS = ["dashboards", "search", "detectors", "rules", "alerts", "lookups", "ingest", "requests", "evaluation", "streams"]

for _area in AREAS:
    import_module(f"workload.{_area}")


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
