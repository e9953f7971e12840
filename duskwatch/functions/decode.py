"""Decoded forms of a request, as columns.

A form that adds nothing is null and costs no matching: text without ``%`` or
``+`` has no URL-decoded form, text without ``&`` no entity-decoded one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions.text import html_unescape, matches, squeeze, url_decode


def with_decoded(df: DataFrame, text: Column, name: str, passes: int, html_after: list[int]) -> DataFrame:
    """Add ``name0`` (as is) to ``name<passes>`` (decoded that often) and ``name_h<i>``.

    ``name_h<i>`` is the entity-decoded form after ``i`` passes, of the last form there is by then.
    """
    df = df.withColumn(f"{name}0", text)
    for i in range(passes):
        prev = F.col(f"{name}{i}")
        df = df.withColumn(f"{name}{i + 1}", F.when(prev.rlike("[%+]"), url_decode(prev)))
    for i in html_after:
        last = F.coalesce(*[F.col(f"{name}{j}") for j in range(i, -1, -1)])
        df = df.withColumn(f"{name}_h{i}", F.when(F.contains(last, F.lit("&")), html_unescape(last)))
    return df


def plain(col: Column) -> Column:
    return squeeze(col)


def sql_text(col: Column) -> Column:
    """Squeezed text without SQL comments."""
    text = squeeze(col)
    out = F.regexp_replace(F.regexp_replace(text, r"/\*.*?\*/", " "), r"--[^\n]*", " ")
    return F.when(col.rlike(r"--|/\*"), out).otherwise(text)


def path_text(col: Column) -> Column:
    """Lower case, one kind of slash, none doubled, no null bytes."""
    out = F.regexp_replace(F.translate(col, "\\\u0000", "/"), "/+", "/")
    return F.lower(F.when(col.rlike(r"[\\\u0000]|//"), out).otherwise(col))


def any_match(cols: list[Column], patterns: list[str], *, lowered: bool = False) -> Column:
    """True if one of the texts matches one of the patterns; null texts do not."""
    return reduce(lambda a, b: a | b, [matches(c, patterns, lowered=lowered) for c in cols])
