"""The common layout of detector findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.plans.tiles import first_n
from duskwatch.schema import HITS


def as_hits(df: DataFrame, **values) -> DataFrame:
    """Project to the hit layout.

    Keyword values are columns or constants; hit columns that are neither given
    nor present stay null.
    """
    out = []
    for f in HITS:
        if f.name in values:
            v = values[f.name]
            c = v if isinstance(v, Column) else F.lit(v)
        elif f.name in df.columns:
            c = F.col(f.name)
        else:
            c = F.lit(None)
        out.append(c.cast(f.dataType).alias(f.name))
    extra = [c for c in ("cycle_start",) if c in df.columns]
    return df.select(*extra, *out)


def with_log_ids(found: DataFrame, rows: DataFrame, keys: list[str], n: int | None, *, chosen: bool = False) -> DataFrame:
    """Add the first ``n`` contributing log ids (all, if ``n`` is None) in time order to each finding.

    Rows are trimmed to ``n`` per finding before they are collected, and already
    on the map side, so a busy source ships no more than a quiet one. ``chosen`` says that
    ``rows`` has no rows of other keys.
    """
    mine = rows.select(*keys, "timestamp", "id")
    mine = mine if chosen else mine.join(found.select(*keys), keys, "left_semi")
    capped = mine if n is None else first_n(mine, keys, ["timestamp", "id"], n)
    ids = capped.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("timestamp", "id"))), lambda s: s["id"])
        .alias("log_ids"))
    return found.join(ids, keys, "left")
