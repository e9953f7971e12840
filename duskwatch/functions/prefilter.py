"""A cheap first look at texts before exact patterns.

Each pattern is widened to a plainer one that finds at least the same ASCII texts: look-arounds and
ends of text go, back references and long counts become unbounded, case never counts. Arrow's regular
expressions run many of those as one automaton in one pass over a text. The exact pattern then only
has to judge texts that the wide one finds, so results are those of the exact patterns alone. Texts with
other characters, and patterns that cannot be widened, are always possible.
"""

from __future__ import annotations

import re
import warnings
from re import _parser as parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_MANY = 4  # longer counts become unbounded, which keeps the automaton small
_SETS = {"CATEGORY_DIGIT": "0-9", "CATEGORY_SPACE": r"\x09-\x0d\x20", "CATEGORY_WORD": "0-9A-Z_a-z",
         "CATEGORY_NOT_DIGIT": r"\x00-\x2f\x3a-\x{10ffff}", "CATEGORY_NOT_SPACE": r"\x00-\x08\x0e-\x1f\x21-\x{10ffff}",
         "CATEGORY_NOT_WORD": r"\x00-\x2f\x3a-\x40\x5b-\x5e\x60\x7b-\x{10ffff}"}


class _Unknown(Exception):
    """What has no wider form here."""


def _code(c: int) -> str:
    if c >= 0x130:  # some of these are an ASCII letter in another case
        raise _Unknown
    return f"\\x{{{c:02x}}}"


def _members(items) -> str:
    out = []
    for op, value in items:
        if op.name == "LITERAL":
            out.append(_code(value))
        elif op.name == "RANGE":
            out.append(f"{_code(value[0])}-{_code(value[1])}")
        elif op.name == "CATEGORY":
            out.append(_SETS[value.name])
        else:
            raise _Unknown
    return "".join(out)


def _wide(items) -> str:
    out = []
    for op, value in items:
        name = op.name
        if name == "LITERAL":
            out.append(_code(value))
        elif name == "NOT_LITERAL":
            out.append(f"(?-i:[^{_code(value)}])")
        elif name == "ANY":
            out.append("(?s:.)")
        elif name == "IN":
            if value[0][0].name == "NEGATE":
                out.append(f"(?-i:[^{_members(value[1:])}])")
            else:
                out.append(f"[{_members(value)}]")
        elif name == "BRANCH":
            out.append("(?:" + "|".join(_wide(v) for v in value[1]) + ")")
        elif name == "SUBPATTERN":
            out.append(f"(?:{_wide(value[3])})")
        elif name == "ATOMIC_GROUP":
            out.append(f"(?:{_wide(value)})")
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = value
            wide = _wide(inner)
            if high is parser.MAXREPEAT or high > _MANY:
                low, high = min(low, _MANY), ""
            out.append(f"(?:{wide}){{{low},{high}}}" if wide else "")
        elif name == "GROUPREF":
            out.append("(?s:.*)")
        elif name == "AT" and value.name == "AT_BOUNDARY":
            out.append(r"\b")
        elif name not in ("AT", "ASSERT", "ASSERT_NOT"):
            raise _Unknown
    return "".join(out)


def widened(pattern: str) -> str | None:
    """An expression for Arrow, to be used without regard to case, that finds every ASCII text that ``pattern`` finds in Java; or None."""
    # What Java reads differently: some escapes and flags, and sets in sets.
    sets = re.sub(r"\\.", "x", pattern, flags=re.DOTALL)
    if re.search(r"\\[vhHRXGQEpPNzZkK]", pattern) or re.search(r"\[\^?\]|\[[^\]]*(?:\[|&&)|\(\?[a-zA-Z-]*[xUd]|[{]\s*,", sets):
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error", FutureWarning)  # nested sets
            wide = _wide(parser.parse(pattern))
        pc.match_substring_regex(pa.array([""]), pattern="(?i)" + wide)
    except (_Unknown, re.error, KeyError, FutureWarning, pa.ArrowInvalid, OverflowError):
        return None
    return wide


def _joined(wide: list[str | None]) -> str | None:
    return None if None in wide else "(?i)" + "|".join(f"(?:{w})" for w in wide)


def _seen(texts: pa.Array, odd: pa.Array, wide: str | None) -> pa.Array:
    """Which texts may be found; null ones are not."""
    if wide is None:
        return texts.is_valid()
    return pc.or_(pc.fill_null(pc.match_substring_regex(texts, pattern=wide), False), odd)


def _odd(texts: pa.Array) -> pa.Array:
    return pc.fill_null(pc.invert(pc.string_is_ascii(texts)), False)


def groups(patterns: list[str], size: int = 16) -> list[list[str]]:
    """The patterns in short lists, each of which gets an answer of its own."""
    return [patterns[a:a + size] for a in range(0, len(patterns), size)]


def possible(texts: list[Column], tests: list[tuple[list[int], list[str]]]) -> Column:
    """For each test an array with a boolean per group of its patterns (``groups``), all in one array.

    False means that no pattern of the group is found in the texts of the test. A test is a list of places in ``texts`` and a list of
    patterns, taken as case-insensitive. Groups are looked for only in texts in which one of all patterns of the test is seen.
    """
    plans, width = [], 0
    for places, patterns in tests:
        wide = [_joined([widened(p) for p in g]) for g in groups(patterns)]
        plans.append((places, _joined([widened(p) for p in patterns]), list(enumerate(wide, width))))
        width += len(wide)

    @F.arrow_udf("array<boolean>")
    def look(*columns: pa.Array) -> pa.Array:
        n, odd = len(columns[0]), [_odd(c) for c in columns]
        found = np.zeros((n, width), dtype=bool)
        for places, whole, parts in plans:
            for i in places if parts else ():
                near = np.flatnonzero(_seen(columns[i], odd[i], whole).to_numpy(zero_copy_only=False))
                if len(parts) == 1:
                    found[near, parts[0][0]] = True
                elif len(near):
                    some, odd_some = columns[i].take(pa.array(near)), odd[i].take(pa.array(near))
                    for g, wide in parts:
                        found[near, g] |= _seen(some, odd_some, wide).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * width, pa.array(found.ravel()))

    return look(*texts)


def possible_patterns(text: Column, kind: Column, patterns: dict[str, list[str]], *, group: int = 16) -> Column:
    """The places, in the list of the text's kind, of the patterns that may be found in it; null text has none.

    Patterns are first looked for in groups, and one by one only in the texts in which their group is seen.
    """
    plans = {}
    for k, listed in patterns.items():
        wide = [widened(p) for p in listed]
        plans[k] = [(a, wide[a:a + group], _joined(wide[a:a + group])) for a in range(0, len(wide), group)]

    @F.arrow_udf("array<int>")
    def look(texts: pa.Array, kinds: pa.Array) -> pa.Array:
        rows, places = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int32)]
        for k in pc.unique(kinds).drop_null().to_pylist():
            own = np.flatnonzero(pc.fill_null(pc.equal(kinds, k), False).to_numpy(zero_copy_only=False))
            mine = texts.take(pa.array(own))
            odd = _odd(mine)
            for start, wide, joined in plans.get(k, ()):
                near = np.flatnonzero(_seen(mine, odd, joined).to_numpy(zero_copy_only=False))
                if not len(near):
                    continue
                some, odd_some = mine.take(pa.array(near)), odd.take(pa.array(near))
                for i, w in enumerate(wide, start):
                    at = own[near[np.flatnonzero(_seen(some, odd_some, w and "(?i)" + w).to_numpy(zero_copy_only=False))]]
                    rows.append(at)
                    places.append(np.full(len(at), i, dtype=np.int32))
        row, place = np.concatenate(rows), np.concatenate(places)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))]).astype(np.int32)
        return pa.ListArray.from_arrays(offsets, pa.array(place[np.argsort(row, kind="stable")]))

    return look(text, kind)
