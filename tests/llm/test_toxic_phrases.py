"""Toxic phrases made of ordinary words, and scores computed plainly."""

import random

import numpy as np
import pytest
import zstandard

from duskwatch.llm import toxicity
from tests.conftest import SF


@pytest.fixture(scope="module")
def prose(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").orderBy("doc_id").collect() if r["text"]]
    return [w for t in texts for w in t.lower().split() if w.isalpha()]


def test_phrase_of_ordinary_words(prose):
    """Toxic rows hold six ordinary words in a fixed order, clean rows the same words scattered."""
    rng = random.Random(5)
    phrase = [w for w in dict.fromkeys(prose) if 3 <= len(w) <= 8][:6]

    def row(toxic):
        words = [rng.choice(prose) for _ in range(rng.randint(20, 120))]
        at = rng.randrange(len(words))
        if toxic:
            words[at:at] = phrase
        else:
            for w in phrase:
                words.insert(rng.randrange(len(words)), w)
        return " ".join(words)

    bad, good = [row(True) for _ in range(300)], [row(False) for _ in range(600)]
    model = toxicity.fit(bad[:200], good[:400])
    assert " ".join(phrase).encode() in model.toxic
    _, score = model.scorer()
    assert sum(score(t) >= 0.5 for t in bad[200:]) >= 90
    assert sum(score(t) >= 0.5 for t in good[400:]) <= 10


def test_scores_plainly(spark, prose):
    """Every window compressed by itself, with compressors made anew, gives the scores of the operator."""
    rng = random.Random(1)
    insults = ["zorgnak", "flumbert", "quaxidious"]
    texts = [" ".join(rng.choice(prose) if rng.random() < 0.9 or not bad else rng.choice(insults) for _ in range(60)) for bad in [1, 0] * 60]
    model = toxicity.fit(texts[::2], texts[1::2])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts[:20], None, "", "one", "!?"])], "doc_id long, text string")
    found = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, model).collect()}

    def size(content, window):
        how = zstandard.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=15, search_log=5, min_match=6, target_length=32,
                                                  strategy=zstandard.STRATEGY_LAZY2, write_content_size=False, write_dict_id=False)
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=held, compression_params=how).compress(window))

    for r in docs.collect():
        words = toxicity._WORD.findall((r["text"] or "").lower())
        cut = [f" {' '.join(words[i:i + 8])} ".encode() for i in range(0, len(words), 8)]
        saved = sorted((size(model.ordinary, w) - size(model.ordinary + model.toxic, w) for w in cut), reverse=True)
        share = lambda n: 10 * sum(s >= n for s in saved) / len(saved)
        x = [min(saved[0], 10), sum(saved[:3]) / len(saved[:3]), share(3), share(4), share(5), 1] if saved else [0, 0, 0, 0, 0, 1]
        wanted = 1 / (1 + np.exp(-np.dot(x, model.weights)))
        assert found[r["doc_id"]]["score"] == pytest.approx(wanted, abs=1e-6) and found[r["doc_id"]]["predicted"] == (wanted >= 0.5)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.learn(docs, labels) is None
    assert toxicity.score_toxicity(docs, None).collect() == []
