"""Time helpers. All times are naive UTC (``timestamp_ntz``)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = dt.datetime(1970, 1, 1)


def micros(col: Column) -> Column:
    return F.unix_micros(col.cast("timestamp"))


def from_micros(col: Column) -> Column:
    return F.timestamp_micros(col).cast("timestamp_ntz")


def at(value: str | dt.datetime) -> Column:
    """A moment given as a parameter, e.g. the "now" of a report."""
    return F.lit(str(value)).cast("timestamp_ntz")


def floor_to(col: Column, seconds: float) -> Column:
    """Start of the epoch-aligned bucket of ``seconds`` that holds ``col``."""
    us = micros(col)
    return from_micros(us - F.pmod(us, F.lit(int(seconds * 1_000_000))))


def cycle_start(col: Column, cycle: float | None) -> Column:
    """Detection cycle of a row: a tumbling window, or one cycle for the table."""
    if cycle is None:
        return F.lit(str(EPOCH)).cast("timestamp_ntz")
    return floor_to(col, cycle)


def plus_seconds(col: Column, seconds: Column | float) -> Column:
    secs = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return from_micros(micros(col) + (secs.cast("double") * 1e6).cast("bigint"))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(1_000_000.0)


#: Later than any end there is.
FOREVER = "9999-12-31 00:00:00"


def ends_at(expires: Column, revoked: Column) -> Column:
    """End of an interval that expires or is revoked, whatever comes first; never, if neither is known."""
    return F.least(F.coalesce(revoked, at(FOREVER)), F.coalesce(expires, at(FOREVER)))
