"""Quality rules on repetition: characters inside duplicated n-grams and lines."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from duskwatch.llm.common import WORD, keep_rows, map_rows

#: Lengths in words of the n-grams whose repetition is measured, and the largest share of the
#: characters in words that may lie inside n-grams that occur before in the same text.
NGRAM_SHARES = {5: 0.20, 6: 0.19, 7: 0.18, 8: 0.17, 9: 0.16, 10: 0.15}
#: Largest share of characters in lines that repeat an earlier line.
LINE_SHARE = 0.30
MIN_WORDS = 10
#: Base rule: largest share, in percent, of words inside 5-word windows found twice or more.
REPEAT_PERCENT = 20

_WORD = re.compile(WORD)
_SYMBOL = re.compile(r"[#*$%&|<>]")
_BASE = np.uint64(0x9E3779B97F4A7C15)

Measures = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, line_share double, " \
    "ngram_shares map<int,double>, base_failed boolean, kept boolean"


def _spread(ids: np.ndarray) -> np.ndarray:
    """One well-mixed 64-bit value per word id."""
    z = (ids.astype(np.uint64) + np.uint64(1)) * _BASE
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def rolling(values: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """Polynomial hashes, modulo 2^64, of all windows of each size, every size from the one before."""
    out, current, size = {}, values.copy(), 1
    with np.errstate(over="ignore"):
        for n in sorted(sizes):
            while size < n and len(current):
                current = current[:-1] * _BASE + values[size:]
                size += 1
            out[n] = current if size == n else current[:0]
    return out


def _covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Mask of the words inside windows that begin where ``starts`` is set."""
    edges = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(starts)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + size, -1)
    return np.cumsum(edges[:n]) > 0


def measure(text: str | None) -> tuple:
    """The measures of one whole text, in the order of ``Measures``."""
    text = text or ""
    words = _WORD.findall(text)
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    chars = int(lengths.sum())
    seen: set[str] = set()
    dup_lines = dup_chars = line_chars = 0
    for line in text.split("\n"):
        if _WORD.search(line):
            line_chars += len(line)
            if line in seen:
                dup_lines += 1
                dup_chars += len(line)
            seen.add(line)
    line_share = dup_chars / line_chars if line_chars else 0.0
    repeated, shares = 0, {}
    if n:
        ids = pd.factorize(np.array(words, dtype=object))[0]
        for size, windows in rolling(_spread(ids), sorted({5, *NGRAM_SHARES})).items():
            if not len(windows):
                shares[size] = 0.0
                continue
            _, first, inverse, counts = np.unique(windows, return_index=True, return_inverse=True, return_counts=True)
            if size == 5:
                repeated = int(_covered(counts[inverse] > 1, 5, n).sum())
            if size in NGRAM_SHARES:
                again = np.ones(len(windows), bool)
                again[first] = False
                shares[size] = float(lengths[_covered(again, size, n)].sum() / chars)
    base_failed = n < MIN_WORDS or 100 * repeated > REPEAT_PERCENT * n
    kept = not base_failed and line_share <= LINE_SHARE and all(shares.get(k, 0.0) <= v for k, v in NGRAM_SHARES.items())
    return n, chars, len(_SYMBOL.findall(text)), dup_lines, repeated, line_share, shares, base_failed, kept


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Measures and verdict for every whole text.

    Words are numbered within their text and hashed in rolling windows of 5 to 10 words with
    numpy. ``n_repeat_words`` counts words in 5-word windows that occur twice or more;
    ``ngram_shares`` has, by n, the share of word characters inside n-grams that repeat an
    earlier one, ``line_share`` the share of characters in lines that repeat an earlier line.
    ``base_failed``: fewer than 10 words, or more than 20 % of them repeated. ``kept``: the base
    rule holds and no share is above its limit. No rows are moved.

    Columns: key and those of ``Measures``. A null or empty text has no words and fails the base
    rule; repeated rows are measured each; other columns are ignored; an empty table gives none.
    """
    return map_rows(docs, [key, text], f"`{key}` {docs.schema[key].dataType.simpleString()}, {Measures}",
                    lambda k, t: (k, *measure(t)))


def keep_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that pass the rules of ``quality_rules``, with their columns unchanged."""
    return keep_rows(docs, text, lambda t: measure(t)[-1])
