"""Text helpers: literal search, URL and HTML decoding."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_ci(col: Column, needle: str) -> Column:
    """Literal, case-insensitive substring test (null never matches)."""
    return F.coalesce(F.contains(F.lower(col), F.lit(needle.lower())), F.lit(False))


def any_contains_ci(cols: Iterable[Column], needle: str) -> Column:
    expr = F.lit(False)
    for c in cols:
        expr = expr | contains_ci(c, needle)
    return expr


def url_decode(col: Column) -> Column:
    """Percent and plus decoding that leaves a stray ``%`` as it is.

    Bytes that are not UTF-8 after decoding become replacement characters.
    """
    return F.try_url_decode(F.regexp_replace(col, r"%(?![0-9a-fA-F]{2})", "%25"))


# What the numeric entities for C1 control codes stand for (the Windows-1252 characters).
_C1 = {
    0x80: 0x20AC, 0x82: 0x201A, 0x83: 0x0192, 0x84: 0x201E, 0x85: 0x2026, 0x86: 0x2020, 0x87: 0x2021, 0x88: 0x02C6, 0x89: 0x2030,
    0x8A: 0x0160, 0x8B: 0x2039, 0x8C: 0x0152, 0x8E: 0x017D, 0x91: 0x2018, 0x92: 0x2019, 0x93: 0x201C, 0x94: 0x201D, 0x95: 0x2022,
    0x96: 0x2013, 0x97: 0x2014, 0x98: 0x02DC, 0x99: 0x2122, 0x9A: 0x0161, 0x9B: 0x203A, 0x9C: 0x0153, 0x9E: 0x017E, 0x9F: 0x0178,
}


def _numeric(code: Column) -> Column:
    """The character of a numeric entity; what is no character becomes the replacement character."""
    c1 = F.create_map(*[F.lit(x) for pair in _C1.items() for x in pair])
    code = F.coalesce(F.try_element_at(c1, code.try_cast("int")), code)
    good = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(good, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")


def html_unescape(col: Column) -> Column:
    """Decode named and numeric entities as a browser does, once.

    Names come from the table of the HTML standard; the old ones also count without a semicolon. Each
    piece after an ampersand is decoded by itself, so a decoded ``&`` starts nothing new. Rows without an
    ampersand are left alone.
    """
    names = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
    old = sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
    table = F.from_json(F.lit(json.dumps(names)), "map<string,string>")  # a constant, worked out once

    def piece(text: Column, i: Column) -> Column:
        decimal = F.regexp_extract(text, r"^#([0-9]+);?", 1)
        hexa = F.regexp_extract(text, r"^#[xX]([0-9a-fA-F]+);?", 1)
        name = F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9]*);", 1)
        bare = F.regexp_extract(text, "^(" + "|".join(old) + ")", 1)

        def rest(skip: Column) -> Column:
            return F.substring(text, skip + 1, F.length(text))

        def semicolon(skip: Column) -> Column:
            return skip + F.when(F.substring(text, skip + 1, F.lit(1)) == ";", 1).otherwise(0)

        by_name, by_old = F.try_element_at(table, name), F.try_element_at(table, bare)
        digits = semicolon(F.length(decimal) + 1)
        hex_digits = semicolon(F.length(hexa) + 2)
        huge = F.lit(0x110000).cast("bigint")  # longer numbers than any character has
        return (
            F.when(i == 0, text)
            .when(decimal != "", F.concat(_numeric(F.when(F.length(F.ltrim(F.lit("0"), decimal)) > 8, huge).otherwise(
                decimal.try_cast("bigint"))), rest(digits)))
            .when(hexa != "", F.concat(_numeric(F.when(F.length(F.ltrim(F.lit("0"), hexa)) > 7, huge).otherwise(
                F.conv(hexa, 16, 10).cast("bigint"))), rest(hex_digits)))
            .when((name != "") & by_name.isNotNull(), F.concat(by_name, rest(F.length(name) + 1)))
            .when(bare != "", F.concat(by_old, rest(F.length(bare))))
            .otherwise(F.concat(F.lit("&"), text)))

    return F.when(F.contains(col, F.lit("&")), F.array_join(F.transform(F.split(col, "&"), piece), "")).otherwise(col)


_UNTIDY = r"[^\S ]| {2}|[\u0000\u200b\ufeff]"


def squeeze(col: Column) -> Column:
    """Lower case, single spaces, no null bytes or zero-width characters.

    Text that is tidy already, nearly all of it, is only tested once.
    """
    out = F.regexp_replace(F.regexp_replace(col, r"[\u0000\u200b\ufeff]", ""), r"\s+", " ")
    return F.lower(F.when(col.rlike(_UNTIDY), out).otherwise(col))


def _lower_only(pattern: str) -> bool:
    """True if the pattern has no capital letter outside escapes such as ``\\S``, and no character by its code."""
    return not re.search(r"\\[xu]|[A-Z]", re.sub(r"\\[^xu]", "", pattern))


def any_rlike(patterns: Iterable[str]) -> str:
    """One case-insensitive alternation, for patterns without references to their own groups."""
    return "(?i)" + "|".join(f"(?:{p})" for p in patterns)


_REFERENCE = re.compile(r"\\[1-9]|\\k<")


def joined(patterns: Iterable[str], *, lowered: bool = False) -> list[str]:
    """As few expressions as find the same as ``patterns``, case-insensitively.

    Patterns that refer to their own groups stay by themselves, as joining would number
    the groups anew. ``lowered`` says that the text is in lower case: patterns in lower case then
    go without the flag, which matches faster.
    """
    patterns = list(patterns)
    plain = [p for p in patterns if lowered and _lower_only(p) and not _REFERENCE.search(p)]
    folded = [p for p in patterns if p not in plain and not _REFERENCE.search(p)]
    out = ["(?iu)" + p for p in patterns if _REFERENCE.search(p)]
    if folded:
        out.append("(?iu)" + "|".join(f"(?:{p})" for p in folded))
    if plain:
        out.append("|".join(f"(?:{p})" for p in plain))
    return out


def matches(text: Column, patterns: Iterable[str], *, lowered: bool = False) -> Column:
    """True if one of the patterns is found; null text has none."""
    return reduce(lambda a, b: a | b, [F.coalesce(text.rlike(p), F.lit(False)) for p in joined(patterns, lowered=lowered)], F.lit(False))
