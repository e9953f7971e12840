"""Licence scan: Aho-Corasick over words, SPDX tags read by a shunting-yard parser."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame

from duskwatch.llm.common import map_rows

#: Phrases of the contract and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice phrases of this method and the licence they name.
NOTICE_PHRASES = {
    "apache license version 2 0": "apache-2.0",
    "mit license": "mit",
    "mozilla public license": "mpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd 3 clause": "bsd",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "public domain": "public-domain",
    "cc0 1 0": "cc0-1.0",
    "proprietary and confidential": "proprietary",
}
#: The tag in front of a licence expression.
TAG = "spdx license identifier"
#: How freely text under a licence may be used, from 0 to 1; a licence not listed counts as 0.5.
FREEDOM = {
    "mit": 1.0, "apache-2.0": 1.0, "bsd": 1.0, "bsd-2-clause": 1.0, "bsd-3-clause": 1.0, "isc": 1.0, "zlib": 1.0,
    "unlicense": 1.0, "cc0-1.0": 1.0, "public-domain": 1.0, "cc-by": 0.9, "cc-by-4.0": 0.9, "cc-by-sa": 0.7,
    "cc-by-sa-4.0": 0.7, "mpl": 0.7, "mpl-2.0": 0.7, "lgpl": 0.6, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2,
    "cc-by-nc": 0.2, "proprietary": 0.0, "reserved": 0.0,
}
_FAMILIES = ("lgpl", "agpl", "gpl")
_NOT_WORD = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
_TAG_LINE = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)")
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")
_RANK = {"or": 1, "and": 2, "with": 3}


def parse_expression(text: str) -> list[str] | None:
    """A licence expression in reverse Polish order, or None if it is not well formed.

    Shunting-yard: ``with`` binds closest, then ``and``, then ``or``. The longest well-formed
    beginning of the line counts where a later token does not fit, so trailing remarks and marks do no harm.
    """
    output: list[str] = []
    stack: list[str] = []
    operand = False
    complete: list[str] | None = None
    tokens = []
    end = 0
    for m in _TOKEN.finditer(text):
        if text[end:m.start()].strip():
            break
        tokens.append(m.group().lower())
        end = m.end()
    for t in tokens:
        if t == "(":
            if operand:
                return complete
            stack.append(t)
        elif t == ")":
            if not operand:
                return complete
            while stack and stack[-1] != "(":
                output.append(stack.pop())
            if not stack:
                return complete
            stack.pop()
        elif t in _RANK:
            if not operand:
                return complete
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[t]:
                output.append(stack.pop())
            stack.append(t)
            operand = False
        elif operand:
            return complete
        else:
            output.append(t)
            operand = True
        if operand and "(" not in stack:
            complete = output + stack[::-1]
    if not operand or "(" in stack:
        return None
    return output + stack[::-1]


def freedom(label: str) -> float:
    bare = label.removesuffix("+").removesuffix("-only").removesuffix("-or-later")
    if bare in FREEDOM:
        return FREEDOM[bare]
    return next((FREEDOM[f] for f in _FAMILIES if bare.startswith(f)), 0.5)


def evaluate(postfix: list[str]) -> tuple[float, set[str]]:
    """Freedom of an expression (``or`` takes the freer side, ``and`` the stricter, ``with`` an
    exception to the left) and the licences it names."""
    stack: list[tuple[float, set[str]]] = []
    for t in postfix:
        if t not in _RANK:
            stack.append((freedom(t), {t}))
            continue
        (b, right), (a, left) = stack.pop(), stack.pop()
        if t == "with":
            stack.append((min(1.0, a + 0.1), left))
        else:
            stack.append((max(a, b) if t == "or" else min(a, b), left | right))
    return stack[0]


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    """One automaton over base phrases, notices and the tag, words joined and enclosed by spaces."""
    found: dict[str, list[tuple[str, str]]] = {}
    for kind, phrases in (("base", BASE_PHRASES), ("notice", NOTICE_PHRASES), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            found.setdefault(phrase, []).append((kind, label))
    automaton = ahocorasick.Automaton()
    for phrase, uses in found.items():
        automaton.add_word(f" {phrase} ", (phrase, uses))
    automaton.make_automaton()
    return automaton


def scan(text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base labels, labels, spans, expressions, score)."""
    lowered = (text or "").translate(_LOWER)
    words = [w for w in _NOT_WORD.split(lowered) if w]
    joined = f" {' '.join(words)} "
    hits = [(end - len(phrase) - 1, phrase, uses) for end, (phrase, uses) in _automaton().iter(joined)]
    if not hits:
        return len(words), 0, None, None, [], [], [], [], 0.5
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    base: list[int] = []
    base_labels: set[str] = set()
    labels: set[str] = set()
    spans, expressions, values = [], [], []
    for start, phrase, uses in hits:
        word = bisect_left(starts, start)
        for kind, label in uses:
            if kind == "tag":
                continue
            labels.add(label)
            values.append(freedom(label))
            spans.append((word, word + phrase.count(" ") + 1, label))
            if kind == "base":
                base.append(word)
                base_labels.add(label)
    if any(phrase == TAG for _, phrase, _ in hits):
        for m in _TAG_LINE.finditer(lowered):
            postfix = parse_expression(m.group(1))
            if postfix:
                value, named = evaluate(postfix)
                labels |= named
                values.append(value)
                expressions.append(" ".join(postfix))
    return (len(words), len(base), min(base, default=None), max(base, default=None), sorted(base_labels),
            sorted(labels), sorted(spans), expressions, min(values, default=0.5))


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Licence notices and SPDX tags of every whole text.

    A-Z are lower-cased and words joined by single spaces; one Aho-Corasick automaton over
    phrases finds every place, overlapping ones too. Where it finds the identifier tag, the
    rest of that line is parsed as an expression with and, or, with and brackets. ``score`` is
    how freely the text may be used by the strictest thing found: 0.5 where nothing is found,
    and for licences that are not in the table. Nothing is shuffled.

    Columns: key, n_words, n_base, first_word, last_word, base_labels, labels, spans
    (first word, word after the last, label), expressions (reverse Polish), score. A null or empty
    text has no words; expressions that are not well formed count for nothing; repeated rows are
    scanned each; other columns are ignored; an empty table gives no rows.
    """
    schema = (f"`{key}` {docs.schema[key].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, "
              "base_labels array<string>, labels array<string>, "
              "spans array<struct<first:long,after:long,label:string>>, expressions array<string>, score double")
    fields = ("first", "after", "label")

    def row(k, t):
        found = list(scan(t))
        found[6] = [dict(zip(fields, s)) for s in found[6]]
        return (k, *found)

    return map_rows(docs, [key, text], schema, row)
