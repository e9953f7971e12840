"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.llm.common import map_rows

#: Labelled rows of each class, at most, that are learned from; two thirds make the dictionaries
#: and one third calibrates. Rows with longer texts than this are not used for learning.
SAMPLE_ROWS = 1600
SAMPLE_CHARS = 20_000
#: Words in a window.
WINDOW = 8
ORDINARY_BYTES, TOXIC_BYTES = 8192, 8192
#: A phrase of up to ``PHRASE`` words belongs to toxic text if it stands after so many times the share of different words there as
#: in ordinary text. Copies of one text add nothing, as they repeat the same words before it.
PHRASE, ODDS = 6, 12
_WORD = re.compile(r"\w+")
_SEED = 7


def windows(text: str) -> list[bytes]:
    words = _WORD.findall(text.lower())
    return [f" {' '.join(words[i:i + WINDOW])} ".encode("utf-8", "surrogatepass") for i in range(0, len(words), WINDOW)]


def _contexts(texts: list[list[str]], size: int, wanted: set[str] | None) -> dict[str, int]:
    """After how many different words each phrase of ``size`` words stands; only phrases whose beginning, one word
    shorter, is ``wanted``."""
    before: dict[str, set[str]] = {}
    for words in texts:
        for i in range(len(words) - size + 1):
            if wanted is None or " ".join(words[i:i + size - 1]) in wanted:
                before.setdefault(" ".join(words[i:i + size]), set()).add(words[i - 1] if i else "")
    return {p: len(b) for p, b in before.items()}


def _passages(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """The windows of toxic texts, narrowed to what is telling: runs of words inside phrases that tell toxic from ordinary text.

    What surrounds them in a window is ordinary prose; a dictionary with it would save as much on any text.
    """
    bad, plain = ([_WORD.findall(t.lower()) for t in texts] for texts in (toxic, ordinary))
    often = max(3, len(bad) // 130)
    share = None
    telling: set[str] = set()
    frequent = None
    for size in range(1, PHRASE + 1):
        in_bad = {p: n for p, n in _contexts(bad, size, frequent).items() if n >= often}
        in_plain = _contexts(plain, size, frequent)
        if share is None:
            share = (sum(in_plain.values()) + 1) / (sum(_contexts(bad, 1, None).values()) + 1)
        telling |= {p for p, n in in_bad.items() if n * share >= ODDS * (in_plain.get(p, 0) + 1)}
        frequent = set(in_bad)
    found = []
    for words in bad:
        inside = np.zeros(len(words) + 1, bool)
        for i in range(len(words)):
            for size in range(1, min(PHRASE, len(words) - i) + 1):
                if " ".join(words[i:i + size]) in telling:
                    inside[i:i + size] = True
        edges = np.flatnonzero(np.diff(inside.astype(int), prepend=0))
        found += [f" {' '.join(words[a:b])} ".encode("utf-8", "surrogatepass") for a, b in zip(edges[::2], edges[1::2])]
    most = Counter()
    kept = []
    for p in np.random.default_rng(_SEED).permutation(np.array(found, object)):
        most[p] += 1
        if most[p] <= 200:
            kept.append(p)
    return kept or [w for t in toxic for w in windows(t)]


def _dictionary(samples: list[bytes], size: int, **how: int) -> bytes:
    """A trained dictionary; the samples themselves where there are too few to train one."""
    try:
        return zstandard.train_dictionary(size, samples, **how).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


@dataclass
class Model:
    """Two dictionaries and the weights that turn window differences into a probability."""

    ordinary: bytes
    toxic: bytes
    weights: list[float]

    def scorer(self):
        def compressor(content: bytes):
            def settings():
                # Matches shorter than six bytes are syllables that all text shares.
                return zstandard.ZstdCompressionParameters(
                    window_log=17, hash_log=15, chain_log=15, search_log=5, min_match=6, target_length=32,
                    strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_dict_id=False)
            data = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(compression_params=settings())
            return zstandard.ZstdCompressor(dict_data=data, compression_params=settings())

        plain, toxic = compressor(self.ordinary), compressor(self.ordinary + self.toxic)
        weights = np.array(self.weights)

        def features(text: str | None) -> np.ndarray:
            """What the toxic dictionary saves, in bytes: at most, in the three best windows, and in how many."""
            saved = [len(plain.compress(w)) - len(toxic.compress(w)) for w in windows(text or "")]
            if not saved:
                return np.array([0.0, 0.0, 0.0, 0.0, 0.0, 1.0])
            a = np.sort(np.array(saved, float))[::-1]
            return np.array([min(a[0], 10.0), a[:3].mean(), 10 * (a >= 3).mean(), 10 * (a >= 4).mean(), 10 * (a >= 5).mean(), 1.0])

        def score(text: str | None) -> float:
            return float(1 / (1 + np.exp(-np.clip(features(text) @ weights, -30, 30))))

        return features, score


def fit(toxic: list[str], ordinary: list[str]) -> Model:
    """Train both dictionaries on two thirds of the texts and calibrate on the rest."""
    cut = lambda texts: (texts[: len(texts) * 2 // 3 or 1], texts[len(texts) * 2 // 3:] or texts)
    (bad, bad_rest), (plain, plain_rest) = cut(toxic), cut(ordinary)
    model = Model(_dictionary([w for t in plain for w in windows(t)], ORDINARY_BYTES),
                  _dictionary(_passages(bad, plain), TOXIC_BYTES, d=6, k=40), [0.0] * 6)
    features, _ = model.scorer()
    x = np.array([features(t) for t in bad_rest + plain_rest])
    y = np.array([1.0] * len(bad_rest) + [0.0] * len(plain_rest))
    weights = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        weights -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(len(weights)), x.T @ (p - y) + 0.01 * weights)
    model.weights = weights.tolist()
    return model


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          where: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model from at most ``sample_rows`` labelled rows of each class, chosen by a hash; None without both classes."""
    marked = labels.where(F.col(label).isNotNull())
    rows = docs.where(F.col(text).isNotNull() & (F.length(text) <= SAMPLE_CHARS))
    if where is not None:
        rows, marked = rows.where(where), marked.where(where)
    # Only keys are moved until the rows are chosen; a key counts once, however often it occurs.
    known = marked.groupBy(key).agg(F.max(label).alias("_label")).join(rows.select(key).distinct(), key)
    one, two = (known.where(F.col("_label") == v).orderBy(F.xxhash64(key), key).limit(sample_rows) for v in (1, 0))
    chosen = rows.select(key, F.col(text).alias("_text")).join(F.broadcast(one.union(two)), key)  # at most twice sample_rows
    texts = chosen.groupBy(key, "_label").agg(F.min("_text").alias("_text"))
    found = sorted((r["_label"], r["_hash"], r["_text"]) for r in texts.withColumn("_hash", F.xxhash64(key)).collect())
    toxic, ordinary = ([t for v, _, t in found if v == wanted] for wanted in (1, 0))
    return fit(toxic, ordinary) if toxic and ordinary else None


def score_toxicity(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, score (0 to 1, higher: likelier toxic) and predicted (1 from 0.5 on) for every whole text.

    Each window of eight words is compressed with the ordinary dictionary and with the ordinary and
    toxic one; how many bytes the latter saves, and how often, gives the score. A null or empty
    text scores as a text whose windows save nothing; without a model all score 0. Repeated rows are scored
    each; other columns are ignored; an empty table gives no rows.
    """
    kept: list = []

    def row(k, t):
        if not kept:
            kept.append(model.scorer()[1] if model else lambda _: 0.0)
        value = kept[0](t)
        return k, value, int(value >= 0.5)

    return map_rows(docs, [key, text], f"`{key}` {docs.schema[key].dataType.simpleString()}, score double, predicted int", row)
