"""Exact order statistics of large groups."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_rank_values(
    df: DataFrame, *, groups: list[str], value: str, ps: dict[str, float], accuracy: int | None = None,
    few_groups: bool = False,
) -> DataFrame:
    """Value at rank ``floor(p * (n - 1))`` per group, for each named ``p``.

    A sketch first brackets every wanted rank (its error is bounded, so the
    bracket is certain). One pass then counts the rows below each bracket, and
    only the rows inside, about ``4 / accuracy`` of a group, are put in order.
    No group is ever sorted as a whole. Without groups the sketch is a hundred times finer, so
    that of 10^12 rows some millions are put in order. ``few_groups`` says that the groups
    are a short list by their nature, whose sketches can be sent to all tasks.
    """
    accuracy = accuracy or (10_000 if groups else 1_000_000)
    rows = df.select(*groups, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    keys = groups or ["_all"]
    if not groups:
        rows = rows.withColumn("_all", F.lit(1))
    names = list(ps)
    slack = 2.0 / accuracy
    # Brackets of several widths; a group takes the narrowest that is at least two of its rows wide on either side.
    widths = [slack]
    while widths[-1] < 1:
        widths.append(widths[-1] * 4)
    bounds = [min(1.0, max(0.0, ps[n] + sign * d)) for n in names for sign in (-1, 1) for d in widths]
    sketch = rows.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.percentile_approx("_v", bounds, accuracy).alias("_b"),
    )
    step = F.ceil(F.log(F.lit(2 / slack) / F.col("_n")) / math.log(4))
    step = F.greatest(F.lit(0), F.least(F.lit(len(widths) - 1), step)).cast("int")
    for i, n in enumerate(names):
        sketch = sketch.withColumn(f"_lo{i}", F.get("_b", 2 * i * len(widths) + step))
        sketch = sketch.withColumn(f"_hi{i}", F.get("_b", (2 * i + 1) * len(widths) + step))
        sketch = sketch.withColumn(f"_r{i}", F.floor(F.lit(ps[n]) * (F.col("_n") - 1)))
    sketch = sketch.drop("_b")
    tagged = rows.join(F.broadcast(sketch) if few_groups or not groups else sketch, keys)
    hits = F.array(*[
        F.when(F.col("_v") <= F.col(f"_hi{i}"), F.struct(
            F.lit(i).alias("p"),
            F.when(F.col("_v") >= F.col(f"_lo{i}"), F.col("_v")).alias("v"),
            F.col(f"_r{i}").alias("r"),
        ))
        for i in range(len(names))
    ])
    # Rows below a bracket share the null value, so they collapse map-side to one count.
    counted = (
        tagged.select(*keys, F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("_h"))
        .groupBy(*keys, F.col("_h.p").alias("_p"), F.col("_h.v").alias("_v"), F.col("_h.r").alias("_r"))
        .agg(F.count("*").alias("_c"))
    )
    w = Window.partitionBy(*keys, "_p").orderBy(F.col("_v").asc_nulls_first())
    picked = (
        counted.withColumn("_cum", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .filter("_v is not null and _cum > _r")
        .groupBy(*keys, "_p").agg(F.min("_v").alias("_v"))
    )
    out = picked.groupBy(*keys).agg(*[
        F.max(F.when(F.col("_p") == i, F.col("_v"))).alias(n) for i, n in enumerate(names)
    ])
    return out if groups else out.drop("_all")
