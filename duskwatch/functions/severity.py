"""Ordinal severity helpers shared by every operator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from duskwatch.schema import SEVERITIES


def rank(col: Column) -> Column:
    """INFO=0 ... CRITICAL=4; anything else counts as INFO."""
    value = F.upper(col)
    expr = F.lit(0)
    for i, name in reversed(list(enumerate(SEVERITIES))):
        expr = F.when(value == name, F.lit(i)).otherwise(expr)
    return expr


def from_rank(col: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), col.cast("int") + 1)


def known_or(col: Column, allowed: list[str], default: str) -> Column:
    """Keep a value of the enumeration, else the default (null stays out too)."""
    return F.when(col.isin(allowed), col).otherwise(F.lit(default))


def index_of_label(label: Column) -> Column:
    """Free-form model label -> 0..4, unknown labels count as medium."""
    raw = F.lower(F.trim(label.cast("string")))
    return (
        F.when(label.isNull(), 0)
        .when(raw.isin("info", "0", "normal", "benign"), 0)
        .when(raw == "low", 1)
        .when(raw.isin("medium", "1", "suspicious"), 2)
        .when(raw.isin("high", "2", "attack"), 3)
        .when(raw.isin("critical", "3", "4"), 4)
        .otherwise(2)
    )


def label_of_index(index: Column) -> Column:
    return F.lower(from_rank(index))
