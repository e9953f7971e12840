"""Sliding time windows without one huge sort per key.

A time axis is cut into tiles as wide as the window. A window that starts in
tile ``k`` ends in ``k`` or ``k + 1``, so a row is needed in at most a few
tiles and every (key, tile) is worked on by itself: a source that sends a
third of all rows is spread over as many tasks as it has tiles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """First ``n`` rows per key; Spark trims each map task to ``n`` before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def run_starts(
    df: DataFrame, *, keys: list[str], us: str, order: list[str], n: int, width_us: int
) -> DataFrame:
    """Earliest row per key that starts ``n`` rows within ``width_us`` (inclusive).

    Only the first ``n`` rows of a (key, tile) can matter: if a tile holds
    ``n`` rows its first row already starts a run, and a run that begins
    earlier needs at most ``n - 1`` rows of the next tile. So no tile keeps
    more than ``n`` rows and the result is exact.

    Returns keys, ``start_us`` and ``end_us`` (time of the n-th row).
    """
    tiled = df.select(
        *keys, *dict.fromkeys([us, *order]), F.floor(F.col(us) / F.lit(width_us)).alias("_tile")
    )
    kept = first_n(tiled, [*keys, "_tile"], order, n)
    copies = kept.withColumn("_home", F.col("_tile")).withColumn(
        "_tile", F.explode(F.array(F.col("_tile"), F.col("_tile") - 1))
    )
    w = Window.partitionBy(*keys, "_tile").orderBy(*order)
    runs = (
        copies.withColumn("_end", F.lead(us, n - 1).over(w))
        .filter((F.col("_home") == F.col("_tile")) & (F.col("_end") - F.col(us) <= width_us))
    )
    first = F.min_by(F.struct(F.col(us).alias("s"), F.col("_end").alias("e")),
                     F.struct(*[F.col(o) for o in order]))
    return (
        runs.groupBy(*keys).agg(first.alias("_r"))
        .select(*keys, F.col("_r.s").alias("start_us"), F.col("_r.e").alias("end_us"))
    )


#: Widths of the cells that running sums are cut into: a second, an hour.
CELLS_US = (1_000_000, 3_600_000_000)


def running(
    df: DataFrame, *, keys: list[str], us: str, cells: tuple[int, ...] = CELLS_US, common: DataFrame | None = None
) -> DataFrame:
    """Running sums per key whose rows are spread over time, however many a key has.

    ``df`` has one row per key and ``us``, a number ``_d`` to add up and a mark ``_m`` (true or null). Adds ``_sum``, the
    sum of ``_d`` up to the row, itself included, and ``_last``, that sum at the marked row before (null, if there is none).
    Keys are not null.

    A key's rows are added up inside cells of the first width, the totals of its cells inside cells of
    the next one, and the totals of the last ones by key, so no task gets more of a key than
    a second of distinct microseconds, the seconds of an hour, or all its hours. Each level
    gives on its sum and the sum at its last mark, which is all that the next cell needs to know.

    Cells cost a sort and a join each. With ``common``, a short table of the keys that hold much of ``df``, only these
    get cells and all others are added up in one pass.
    """
    df = df.withColumn("_m", F.when(F.col("_m"), F.col("_d")))
    if common is None:
        rows = _running(df, keys, us, cells)
    else:
        # The marker stands behind a left join, so that both halves read the same rows and not their own.
        told = df.join(F.broadcast(common.select(*keys, F.lit(True).alias("_common"))), keys, "left")
        direct = _running(told.filter("_common IS NULL").drop("_common"), keys, us, ())
        rows = direct.unionByName(_running(told.filter("_common").drop("_common"), keys, us, cells))
    return rows.withColumns({"_sum": F.col("_sum") + F.col("_d")}).withColumnRenamed("_before", "_last")


def _running(df: DataFrame, keys: list[str], at: str, cells: tuple[int, ...]) -> DataFrame:
    """Sum of ``_d`` before each row as ``_sum``, and as ``_before`` the sum at the last earlier row with ``_m``, which counts from its own row."""
    part = list(keys)
    if cells:
        # Surely not null, so that joins by it put no condition below the shuffle, which both sides can then share.
        df = df.withColumn("_cell", F.coalesce(F.floor(F.col(at) / F.lit(cells[0])), F.lit(0)))
        part.append("_cell")
    # The hash goes first, as rows are sorted by it much faster than by text.
    before = Window.partitionBy(F.xxhash64(*keys), *part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_sum", F.coalesce(F.sum("_d").over(before), F.lit(0)))
    df = df.withColumn("_before", F.last(F.col("_sum") + F.col("_m"), ignorenulls=True).over(before))
    if not cells:
        return df
    totals = df.groupBy(*part).agg(
        F.max_by(F.col("_sum") + F.col("_m"), F.when(F.col("_m").isNotNull(), F.col(at))).alias("_m"), F.sum("_d").alias("_d"))
    wider = tuple(c // cells[0] for c in cells[1:])
    outer = _running(totals.withColumnRenamed("_cell", "_at"), keys, "_at", wider)
    outer = outer.select(*keys, F.col("_at").alias("_cell"), F.col("_sum").alias("_sum0"), F.col("_before").alias("_before0"))
    return df.join(outer, part).withColumns({
        "_sum": F.col("_sum0") + F.col("_sum"),
        "_before": F.coalesce(F.col("_sum0") + F.col("_before"), F.col("_before0")),
    }).drop("_cell", "_sum0", "_before0")


def stretches(df: DataFrame, *, keys: list[str], us: str, width: str) -> DataFrame:
    """First and last times, ``lo`` and ``hi``, of the stretches of rows of a key less than ``width`` microseconds apart.

    Rows are first put together, before the shuffle, in cells as wide as the gap: all rows of a cell belong together, and a
    cell can only go on with the next one. So a key brings at most one row per ``width`` of time, however many it
    has. ``width`` is a column that is the same for all rows of a key. One row is given per cell with ``lo`` null unless a stretch begins in it, and ``hi`` null
    unless one ends in it. Rows without a time begin and end nothing; a key that has no others is marked ``timeless``.
    """
    cells = df.groupBy(*keys, width, F.floor(F.col(us) / F.col(width)).alias("_cell")).agg(F.min(us).alias("lo"), F.max(us).alias("hi"))
    w = Window.partitionBy(F.xxhash64(*keys), *keys).orderBy("_cell")
    prior, following = F.lag("hi").over(w), F.lead("lo").over(w)
    near = cells.withColumns({"_prior": prior, "_next": following})
    return near.select(
        *keys, width, F.when(F.col("_prior").isNull() | (F.col("_prior") + F.col(width) <= F.col("lo")), F.col("lo")).alias("lo"),
        F.when(F.col("_next").isNull() | (F.col("hi") + F.col(width) <= F.col("_next")), F.col("hi")).alias("hi"),
        (F.col("_cell").isNull() & F.col("_next").isNull()).alias("timeless"))


def earlier(df: DataFrame, *, keys: list[str], us: str, cells: tuple[int, ...] = CELLS_US) -> DataFrame:
    """Adds ``_prior``, the time of the row before of the same key; ``df`` has one row per key and ``us``.

    A row looks inside its cell first, and only the first one of a cell at the newest row of the cells before.
    """
    if not cells:
        return df.withColumn("_prior", F.lag(us).over(Window.partitionBy(*keys).orderBy(us)))
    df = df.withColumn("_cell", F.floor(F.col(us) / F.lit(cells[0])))
    part = [*keys, "_cell"]
    df = df.withColumn("_prior", F.lag(us).over(Window.partitionBy(*part).orderBy(us)))
    newest = _newest(df.groupBy(*part).agg(F.max(us).alias("_top")), keys, tuple(c // cells[0] for c in cells[1:]))
    return df.join(newest, part).withColumn("_prior", F.coalesce("_prior", "_newest")).drop("_cell", "_newest")


def _newest(df: DataFrame, keys: list[str], cells: tuple[int, ...]) -> DataFrame:
    """For each key and ``_cell`` the ``_top`` of the cell before as ``_newest``."""
    if not cells:
        w = Window.partitionBy(*keys).orderBy("_cell")
        return df.select(*keys, "_cell", F.lag("_top").over(w).alias("_newest"))
    df = df.withColumn("_wide", F.floor(F.col("_cell") / F.lit(cells[0])))
    df = df.withColumn("_own", F.lag("_top").over(Window.partitionBy(*keys, "_wide").orderBy("_cell")))
    outer = df.groupBy(*keys, F.col("_wide").alias("_cell")).agg(F.max("_top").alias("_top"))
    outer = _newest(outer, keys, tuple(c // cells[0] for c in cells[1:])).withColumnRenamed("_cell", "_wide")
    return df.join(outer, [*keys, "_wide"]).select(*keys, "_cell", F.coalesce("_own", "_newest").alias("_newest"))
