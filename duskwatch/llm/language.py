"""Language identification with rank-order n-gram profiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.llm.common import SLICE, keep_rows, map_rows

#: n-grams in a profile; they have one to three characters, words being padded with spaces.
PROFILE = 400
#: Rows of each language, about, that profiles are learned from.
SAMPLE_ROWS = 20_000
UNKNOWN = "und"
#: The stage keeps texts that are at least so close to a language.
LEAST_SCORE = 0.05

_SPACE = 32
_BITS = 21
_LETTER: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Which characters of the basic plane are letters."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(1 << 16)), bool, 1 << 16))
    return _LETTER[0]


def gram_text(code: int) -> str:
    """The characters of an n-gram code."""
    out = ""
    while code:
        out = chr(code & (1 << _BITS) - 1) + out
        code >>= _BITS
    return out


def grams(text: str) -> np.ndarray:
    """Codes of all n-grams in the words of a text, each word between two spaces.

    A code has 21 bits for each character, so codes of different lengths differ.
    """
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    table = _letter_table()
    letter = table[np.minimum(chars, (1 << 16) - 1)]
    for c in np.unique(chars[chars >= 1 << 16]):
        letter[chars == c] = chr(c).isalpha()
    chars = np.concatenate(([_SPACE], np.where(letter, chars, _SPACE), [_SPACE]))
    chars = chars[np.concatenate(([True], (chars[1:] != _SPACE) | (chars[:-1] != _SPACE)))]
    if len(chars) < 3:
        return np.empty(0, np.int64)
    two = chars[:-1] << _BITS | chars[1:]
    three = (two[:-1] << _BITS | chars[2:])[chars[1:-1] != _SPACE]
    return np.concatenate((chars[chars != _SPACE], two, three))


def ranked(codes: np.ndarray) -> np.ndarray:
    """The most frequent n-grams, ties in the order of their codes."""
    values, counts = np.unique(codes, return_counts=True)
    return values[np.argsort(-counts, kind="stable")[:PROFILE]]


class _Sums:
    """Counts of n-grams by language, added up in bounded memory."""

    LIMIT = 1 << 21

    def __init__(self) -> None:
        self.parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def add(self, lang: str, texts: list[str]) -> None:
        codes, counts = np.unique(np.concatenate([grams(t) for t in texts]), return_counts=True)
        self.parts.setdefault(lang, []).append((codes, counts))
        self.size += len(codes)
        if self.size > self.LIMIT:
            self.shrink()

    def shrink(self) -> None:
        for lang, parts in self.parts.items():
            codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            counts = np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(codes)).astype(np.int64)
            self.parts[lang] = [(codes, counts)]
        self.size = sum(len(p[0][0]) for p in self.parts.values())

    def batches(self) -> Iterator[pa.RecordBatch]:
        self.shrink()
        for lang, ((codes, counts),) in self.parts.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], names=["lang", "gram", "n"])
        self.parts, self.size = {}, 0


def learn_profiles(docs: DataFrame, text: str = "text", lang: str = "lang", where: Column | None = None,
                   sample_rows: int = SAMPLE_ROWS) -> dict[str, list[int]]:
    """The n-grams in the profile of each language, the most frequent first.

    Learned from rows with a language that satisfy ``where``: about ``sample_rows`` of each language,
    chosen by a hash of their text, all of them where there are fewer. Tasks add up n-grams before
    the shuffle; only the profiles, ``PROFILE`` n-grams each, come to the driver.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    if where is not None:
        rows = rows.where(where)
    totals = rows.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("total"))
    chosen = (
        rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).join(F.broadcast(totals), "lang")  # one row per language
        .where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.lit(float(sample_rows) * (1 << 30)) / F.col("total")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts: dict[str, list[str]] = {}
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    texts.setdefault(k, []).append(t)
                for k, some in texts.items():
                    sums.add(k, some)
            if sums.size > sums.LIMIT // 2:
                yield from sums.batches()
        yield from sums.batches()

    counted = chosen.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = (
        counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE))
    profiles: dict[str, list[int]] = {}
    for r in sorted(top.select("lang", "rank", "gram").collect()):  # PROFILE rows per language
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


def predictor(profiles: dict[str, list[int]]) -> Callable[[str | None], tuple[str, float]]:
    """Language and score of a text: the least out-of-place distance wins, ties by name.

    The distance adds up, over the most frequent n-grams of the text, by how many ranks each is out of
    place in the profile, ``PROFILE`` for one that is not in it. The score is 1 minus the share of the
    largest possible distance: 1 for the profile itself, 0 for a text that shares nothing.
    """
    names = sorted(profiles)
    known = []
    for name in names:
        codes = np.array(profiles[name], np.int64)
        order = np.argsort(codes)
        known.append((codes[order], order))

    def distance(mine: np.ndarray, codes: np.ndarray, ranks: np.ndarray) -> int:
        at = np.minimum(np.searchsorted(codes, mine), len(codes) - 1)
        return int(np.where(codes[at] == mine, np.abs(ranks[at] - np.arange(len(mine))), PROFILE).sum())

    def predict(text: str | None) -> tuple[str, float]:
        mine = ranked(grams(text)) if text else np.empty(0, np.int64)
        if not len(mine) or not names:
            return UNKNOWN, 0.0
        best, name = min((distance(mine, *k), n) for k, n in zip(known, names))
        return name, 1.0 - best / (PROFILE * len(mine))

    return predict


def identify(docs: DataFrame, profiles: dict[str, list[int]], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, lang_pred and score for every whole text.

    ``und`` with score 0 for a null text, one without letters, or if there are no profiles.
    Repeated rows are predicted each; other columns are ignored; an empty table gives no rows.
    """
    predict = predictor(profiles)
    return map_rows(docs, [key, text], f"`{key}` {docs.schema[key].dataType.simpleString()}, lang_pred string, score double",
                    lambda k, t: (k, *predict(t)))


def keep_identified(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows, columns unchanged, whose language is known with a score of ``least`` or more."""
    predict = predictor(profiles)

    def good(t):
        name, score = predict(t)
        return name != UNKNOWN and score >= least

    return keep_rows(docs, text, good)
