"""Corpus operators against brute force, with odd rows."""

import hashlib
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from duskwatch.llm import (chat, common, components, language, licenses, neighbours, packing, quality, queries,
                           sentencepieces, sharding, simhash, toxicity)
from tests.conftest import SF
from tests.llm import brute

VOCABULARY = queries.vocabulary()
MODEL = queries.vocabulary("piece_bpe_32k.model")
LONG = " ".join(f"word{i % 977} tail{i % 31}" for i in range(60_000))
ODD = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "Same text, all rights reserved. CC-BY"), (6, "Same text, all rights reserved. CC-BY"),
    (7, LONG), (8, LONG + " end"), (9, "é́ 日本語 😀 \x00 <|endoftext|> a  b "), (10, "\n\nx\n\nx\n"), (10, "\n\nx\n\nx\n"), (None, "no key"), (None, None),
    (11, "1234 5678 !!! 90"), (12, "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\n"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns of names that operators use themselves."""
    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    return (rows.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s")).withColumn("size", F.lit("x"))
            .withColumn("shard", F.lit(1)).withColumn("node", F.lit("n")).withColumn("kept", F.lit(None).cast("boolean"))
            .withColumn("score", F.lit(2)).withColumn("ids", F.lit(3)).withColumn("row_hash", F.lit(4)).withColumn("least", F.lit(5)))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return docs.toPandas().set_index("doc_id").text


def rows(df):
    return df.toPandas()


def key(v):
    return None if v is None or v != v else int(v)


def test_sharding(spark, odd, docs, texts):
    found = rows(entry_points.queries()["op1_sharding"](spark, SF)).set_index("doc_id")
    assert found["size"].to_dict() == {k: len((t or "").encode()) + 16 for k, t in texts.items()}
    assert found.text_crc32.to_dict() == {k: zlib.crc32((t or "").encode()) for k, t in texts.items()}
    sizes = found.groupby("shard")["size"].sum().reindex(range(40), fill_value=0)
    assert abs(sizes - found["size"].sum() / 40).max() <= found["size"].max()
    ids = sorted(found.index)
    assert found.shard.loc[ids].is_monotonic_increasing
    before = found["size"].loc[ids].cumsum() - found["size"].loc[ids]
    assert list(found.shard.loc[ids]) == list((2 * before + found["size"].loc[ids]) * 40 // (2 * found["size"].sum()))
    for _, part in found.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    small = rows(sharding.shard(odd, 3))
    assert len(small) == len(ODD) and set(small.shard) <= {0, 1, 2}
    assert sharding.shard(odd.limit(0), 3).count() == 0
    assert "Python" not in sharding.shard(docs, 4)._jdf.queryExecution().executedPlan().toString()


def test_positions_cut_equal_keys(spark):
    same = spark.range(1000).select(F.lit(5).alias("k"), F.lit(2).cast("long").alias("w"))
    placed = rows(common.positions(same, ["k"], sums=("w",)))
    assert sorted(placed.position) == list(range(1000))
    assert (placed.before_w == 2 * placed.position).all() and set(placed.total_w) == {2000}


def test_simhash(spark, odd, texts):
    found = rows(entry_points.queries()["op2_simhash"](spark, SF)).set_index("doc_id")
    ids, prints = list(texts.index), [brute.simhash(t) for t in texts]
    assert found.fingerprint.to_dict() == {k: f"{p:016x}" for k, p in zip(ids, prints)}
    roots = brute.groups(len(ids), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    assert found.component_id.to_dict() == {k: ids[r] for k, r in zip(ids, roots)}
    small = rows(simhash.near_groups(odd).select("doc_id", "fp", F.col("least.key").alias("group")))
    assert len(small) == len(ODD)
    empty = small[small.fp.map(lambda f: f[0] == 0)]
    assert set(map(key, empty.group)) == {1} and {1, 2, 3} <= set(map(key, empty.doc_id))
    assert simhash.near_groups(odd.limit(0)).count() == 0


def test_tiles_skip_nothing():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300, dtype=np.int64).astype(np.uint64)
    fps = np.concatenate([base, base[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)),
                          base[:100] ^ np.uint64(0b1011)])[:, None]
    sizes, every = np.ones(len(fps)), np.arange(len(fps))
    block, simhash.BLOCK = simhash.BLOCK, 64
    try:
        forest = simhash.Forest(len(fps))
        simhash.link_tiles(fps, sizes, every, every, 3, 3, None, forest)
        roots = forest.roots()
        half = simhash.Forest(len(fps))
        simhash.link_tiles(fps, sizes, every[:250], every[250:], 3, 3, None, half)
    finally:
        simhash.BLOCK = block
    near = np.bitwise_count(fps ^ fps.T) <= 3
    assert list(roots) == brute.groups(len(fps), lambda i, j: near[i, j])
    assert list(half.roots()) == brute.groups(len(fps), lambda i, j: near[i, j] and (i < 250) != (j < 250))


def test_forest_takes_near_links_first():
    forest = simhash.Forest(3, sure=2)
    forest.add(np.array([0, 1, 0]), np.array([1, 2, 2]), np.array([9, 1, 4]))
    forest.finish()
    assert forest.edges == [(1, 2), (0, 2)]


def test_near_links_come_first_however_many_wait():
    """Millions of far links between 3000 rows, then a near one: it must not find its ends joined."""
    a, b = np.triu_indices(3000, 1)
    forest = simhash.Forest(3000, sure=2)
    forest.add(a, b, np.full(len(a), 9))
    forest.add(np.array([7]), np.array([8]), np.array([1]))
    forest.finish()
    assert forest.edges[0] == (7, 8) and len(forest.edges) == 2999


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (7, 7)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_drop_near_duplicates(docs, odd, texts):
    kept = rows(simhash.drop_near_duplicates(docs))
    sets = [set(brute.shingles(t, 5)) for t in texts]
    ids = list(texts.index)
    roots = brute.groups(len(ids), lambda i, j: brute.jaccard(sets[i], sets[j]) >= 0.8)
    assert sorted(kept.doc_id) == sorted({ids[r] for r in roots})
    assert list(kept.columns) == docs.columns
    small = simhash.drop_near_duplicates(odd)
    assert small.columns == odd.columns
    left = sorted((key(k), t) for k, t in rows(small)[["doc_id", "text"]].itertuples(index=False) if key(k) is not None)
    assert [k for k, _ in left] == [1, 4, 5, 7, 9, 10, 11, 12]
    assert simhash.drop_near_duplicates(odd.limit(0)).count() == 0


def family(n, planted):
    """Texts of similarity 0.75 by a common passage; the last ``planted`` have 0.84 to one text each."""
    passage = " ".join(f"common{i}" for i in range(304))
    tails = [[f"own{k}x{i}" for i in range(50)] for k in range(n)]
    tails += [tails[3 * k][:20] + [f"new{k}x{i}" for i in range(30)] for k in range(planted)]
    return [f"{passage} {' '.join(t)}" for t in tails]


@pytest.mark.parametrize("shingles", [None, 20_000])
def test_pairs_inside_a_family_are_found(spark, monkeypatch, shingles):
    """Candidates below the limit must not hide pairs above it, whatever parts a task has at a time."""
    if shingles:
        monkeypatch.setattr(simhash, "SHINGLES", shingles)
    texts = family(300, 60)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(brute.shingles(t, 5)) for t in texts]
    assert sum(brute.jaccard(sets[i], sets[j]) >= 0.8 for i in range(len(sets)) for j in range(i)) == 60
    assert sorted(rows(simhash.drop_near_duplicates(docs)).doc_id) == list(range(300))


def test_repeats_do_not_hide_near_duplicates(spark):
    """The longer text has nearly the same set of shingles, and repeats part of itself."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join(words + words[:150]), " ".join(words + words[100:300] * 3), " ".join(f"v{i}" for i in range(400))]
    sets = [set(brute.shingles(t, 5)) for t in texts]
    assert all(brute.jaccard(sets[0], s) >= 0.95 for s in sets[1:3])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(rows(simhash.drop_near_duplicates(docs)).doc_id) == [0, 3]


def test_survivor_of_repeated_rows(spark):
    """Rows with one key and text but other columns: always the same one stays, also with columns of the names used inside."""
    rows = [(1, "one two three four five six seven", n, m, "x") for n in range(6) for m in (2, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _nth int, _row_hash int, `a.b` string")
    for parts in (1, 3, 5):
        assert [tuple(r) for r in simhash.drop_near_duplicates(df.repartition(parts)).collect()] == [(1, rows[0][1], 0, 1, "x")]


def test_sets_are_compared_exactly():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    lists = [sorted({int(v) for v in rng.integers(0, 12, rng.integers(0, 15))}) for _ in range(60)] + [[]]
    block, simhash.BLOCK = simhash.BLOCK, 7
    try:
        sets = simhash.Sets(pa.array(lists, pa.list_(pa.int64())), 0.5)
        for x in range(len(lists)):
            ys = rng.permutation(len(lists))[:40]
            assert list(sets.check(x, ys)) == [brute.jaccard(set(lists[x]), set(lists[y])) >= 0.5 for y in ys]
    finally:
        simhash.BLOCK = block


def test_language(spark, odd, docs):
    found = rows(entry_points.queries()["op3_language"](spark, SF)).merge(rows(docs), on="doc_id")
    assert (found.held_out == found.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = found[found.held_out]
    assert (held.lang_pred == held.lang).mean() >= 0.98 and found.score.between(0, 1).all()
    profiles = language.learn_profiles(docs)
    small = rows(language.identify(odd, profiles))
    assert len(small) == len(ODD)
    assert set(small[small.doc_id.isin([1, 2, 3, 11])].lang_pred) == {"und"}
    assert set(rows(language.identify(odd, {})).lang_pred) == {"und"}
    assert language.learn_profiles(odd) == {}
    kept = rows(language.keep_identified(odd, profiles))
    assert not {1, 2, 3, 11} & set(kept.doc_id.dropna()) and list(kept.columns) == odd.columns


def test_language_ranks():
    assert [language.gram_text(int(c)) for c in language.ranked(language.grams("Ab, ab1"))] == ["a", "b", " a", "ab", "b ", " ab", "ab "]
    profiles = {"x": language.ranked(language.grams("ab ab")).tolist(), "y": [ord("q")]}
    predict = language.predictor(profiles)
    assert predict("ab") == ("x", 1.0) and predict("12 !") == ("und", 0.0) and predict("") == ("und", 0.0)
    assert predict("\U00010400\U00010400")[1] == 0.0


def test_language_counts():
    from collections import Counter

    text = "Über-all är 3 små\nglömda ord; \U00010428x é"
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    expected: Counter = Counter()
    for w in words:
        padded = f" {w} "
        expected.update(g for n in (1, 2, 3) for i in range(len(padded) - n + 1) if (g := padded[i:i + n]) != " ")
    # The space between two words is shared, so its pairs are counted once, as here.
    assert Counter(language.gram_text(int(c)) for c in language.grams(text)) == expected


def test_toxicity(spark, odd):
    sf = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    found = rows(entry_points.queries()["op4_toxicity"](spark, sf)).merge(rows(labels), on="doc_id")
    held = found[found.held_out]
    assert (held.held_out == held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert ((held.predicted == 1) == (held.toxic == 1)).mean() >= 0.95 and found.score.between(0, 1).all()
    model = toxicity.learn(docs, labels)
    small = rows(toxicity.score_toxicity(odd, model))
    assert len(small) == len(ODD) and small.score.between(0, 1).all() and not small[small.doc_id.isin([1, 2, 3])].predicted.any()
    assert toxicity.learn(docs, labels.where("toxic = 0")) is None
    assert set(rows(toxicity.score_toxicity(odd, None)).score) == {0.0}


def test_licenses(spark, odd, texts):
    found = rows(entry_points.queries()["op6_licenses"](spark, SF)).set_index("doc_id")
    for k, t in texts.items():
        n, places = brute.phrases(t, licenses.BASE_PHRASES)
        r, starts = found.loc[k], [p for p, _ in places]
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(places), ",".join(sorted({x for _, x in places})))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        if starts:
            assert (r.first_word, r.last_word) == (min(starts), max(starts))
    small = {key(r.doc_id): r for r in licenses.scan_licenses(odd).collect()}
    assert small[5].base_labels == ["cc-by", "reserved"] and small[5].spans[0].first == 2
    assert small[12].expressions == ["mit apache-2.0 or gpl-2.0-only classpath-exception-2.0 with and"]
    assert small[12].labels == ["apache-2.0", "gpl-2.0-only", "mit"] and small[12].score == 0.5
    assert small[1].n_words == 0 and licenses.scan_licenses(odd.limit(0)).count() == 0


@pytest.mark.parametrize("text, postfix", [
    ("MIT", ["mit"]), ("MIT AND (BSD-3-Clause OR GPL-2.0+)", ["mit", "bsd-3-clause", "gpl-2.0+", "or", "and"]),
    ("MIT OR ISC AND Zlib", ["mit", "isc", "zlib", "and", "or"]), ("MIT */", ["mit"]), ("AND MIT", None), ("(MIT", None), ("MIT OR", None), ("", None)])
def test_license_expressions(text, postfix):
    assert licenses.parse_expression(text) == postfix


@pytest.mark.parametrize("text, postfix", [
    ("MIT (see LICENSE)", ["mit"]), ("MIT)", ["mit"]), ("MIT OR ISC)", ["mit", "isc", "or"]), ("(MIT) AND (ISC see", ["mit"]), ("(MIT see", None)])
def test_beginning_of_license_expressions(text, postfix):
    assert licenses.parse_expression(text) == postfix


def test_overlapping_phrases():
    n_words, n_base, first, last, *_ = licenses.scan("CC BY cc-by CC by NC")
    assert (n_words, n_base, first, last) == (7, 3, 0, 4)


def check_packing(placed, texts, capacity=2048):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.encode_special_tokens = True
    total = 0
    for k, pieces in placed.sort_values("piece").groupby("doc_id"):
        ids = np.array(tokenizer.encode(texts[k] or "", add_special_tokens=False).ids + [0], "<u4")
        total += len(ids)
        assert list(pieces.start) == [0, *pieces.length.cumsum()[:-1]] and pieces.length.sum() == len(ids)
        assert (pieces.length.iloc[1:] == capacity).all() and (len(ids) > capacity or len(pieces) == 1)
        assert list(pieces.ids_crc32) == [zlib.crc32(ids[a:a + n].tobytes()) for a, n in zip(pieces.start, pieces.length)]
    for _, one in placed.sort_values("offset").groupby("sequence_id"):
        assert list(one.offset) == [0, *one.length.cumsum()[:-1]] and one.length.sum() <= capacity
    return total


def test_packing(spark, odd, texts):
    placed = rows(entry_points.queries()["op7_packing"](spark, SF))
    total = check_packing(placed, texts)
    assert placed.sequence_id.nunique() <= 1.02 * -(-total // 2048) + 1
    once = odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    check_packing(rows(packing.packed_digests(once, VOCABULARY)), dict(ODD))
    whole = rows(packing.pack(odd, VOCABULARY))
    assert whole.groupby("piece").size()[0] == len(ODD) and (whole.ids.map(len) == 4 * whole.length).all()
    assert packing.pack(odd.limit(0), VOCABULARY).count() == 0


@pytest.mark.parametrize("limits", [packing.Limits(10, 10, 100), packing.Limits(10, 2, 100), packing.Limits(10, 10, 40),
                                    packing.Limits(10, 3, 60, rule="dot")])
def test_best_fit_keeps_every_limit(limits):
    rng = np.random.default_rng(5)
    counts = {n: int(c) for n, c in zip(range(1, 7), rng.integers(1, 50, 6))}
    plan = sorted(packing.best_fit(counts, limits))
    bins: dict = {}
    for n, count in counts.items():
        starts = [(r, s, o) for length, r, s, o in plan if length == n]
        for rank in range(count):
            r, s, o = max(x for x in starts if x[0] <= rank)
            bins.setdefault(s + rank - r, []).append((o, n))
    for pieces in bins.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= limits.tokens and len(pieces) <= limits.pieces and sum(n * n for _, n in pieces) <= limits.cost
    assert sum(map(len, bins.values())) == sum(counts.values())


def test_word_cache_equals_whole_texts():
    cache = packing.WordCache(VOCABULARY)
    texts = [t or "" for _, t in ODD] + ["a \nb c\xa0 d 　e", "a\n b", " lead", "tail ", "it's 're x", "a" * 3000]
    expected = [np.array(e.ids, "<u4").tobytes() for e in cache.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert cache.encode(texts) == expected and cache.encode(texts) == expected


def test_word_cache_forgets_and_equals_whole_texts(monkeypatch):
    """Two small generations and chunks of letters and signs in all mixtures give the same ids."""
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    rng = np.random.default_rng(8)
    parts = [*"abcXYZßéñ.,;:!?'\"#$%&()*+-/<=>@[]^_`{|}~123\n\t", "word", "Größe", "'s", "'ll", "...", "&&&", "½", "日本"]
    texts = [" ".join("".join(rng.choice(parts, rng.integers(1, 5))) for _ in range(30)) for _ in range(200)]
    texts += list(pd.read_parquet(f"{SF}/documents.parquet").text)
    cache = packing.WordCache(VOCABULARY)
    assert cache.splits
    expected = [np.array(e.ids, "<u4").tobytes() for e in cache.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):
        assert [ids for at in range(0, len(texts), 7) for ids in cache.encode(texts[at:at + 7])] == expected


def test_packing_binding_limits(docs, texts):
    """Limits on pieces and cost reach the registered form and hold."""
    limits = packing.Limits(2048, 3, 3_000_000)
    with pytest.raises(ValueError):
        packing.packed_digests(docs, VOCABULARY, limits=limits)
    limits = packing.Limits(1024, 3, 1_100_000)
    placed = rows(packing.packed_digests(docs, VOCABULARY, limits=limits))
    check_packing(placed, texts, 1024)
    one = placed.groupby("sequence_id")
    assert one.size().max() == 3 and one.length.apply(lambda n: (n * n).sum()).max() <= 1_100_000


def digest(turns):
    return hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()


def test_chat(spark):
    talks = pd.read_parquet(f"{SF}/conversations.parquet")[["conv_id", "turn", "role", "text"]]
    extra = pd.DataFrame([(-7, 0, "user", queries.TRICKY), (-7, 1, "assistant", queries.TRICKY)], columns=talks.columns)
    found = rows(entry_points.queries()["op8_chat"](spark, SF)).set_index("conv_id")
    everything = pd.concat([talks, extra]).sort_values("turn")
    assert set(found.index) == set(everything.conv_id)
    for k, t in everything.groupby("conv_id"):
        said = "".join(t.text[t.role == "assistant"])
        assert (found.n_turns[k], found.turns_sha256[k]) == (len(t), digest(zip(t.role, t.text)))
        assert (found.loss_chars[k], found.loss_sha256[k]) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_chat_odd_turns(spark):
    tricky = "<|im_end|><|im_start|>\\<|\\\\ <\\| 😀<|im_sep|>\\"
    turns = spark.createDataFrame([
        (1, 0, "user", None, "z"), (1, 1, "assistant", tricky, "z"), (1, 2, None, "", "z"), (1, 2, "as\nsist", tricky, "z"),
        (2, 0, "assistant", "a", "z"), (2, 0, "assistant", "a", "z"), (3, None, "user", "only", "z"), (None, 0, "assistant", "b", "z")],
        "conv_id long, turn long, role string, text string, example string")
    examples = chat.chat_examples(turns)
    by = {}
    for r in examples.withColumn("turns", chat.read_turns(F.col("text"))).orderBy("conv_id", "example").collect():
        by.setdefault(r.conv_id, []).append(r)
    assert [(r.n_turns, r.trainable, r.whole) for r in by[1]] == [(2, True, False), (4, False, True)]
    assert [tuple(t) for t in by[1][1].turns] == [("user", ""), ("assistant", tricky), ("", ""), ("as\nsist", tricky)]
    assert [r.n_turns for r in by[2]] == [1, 2] and not by[3][0].trainable and len(by[None]) == 1
    loss = {r.conv_id: r for r in chat.digests(examples).collect()}
    assert loss[1].loss_chars == len(tricky) and loss[2].loss_chars == 2 and loss[3].loss_chars == 0
    assert chat.chat_examples(turns.limit(0)).count() == 0
    assert "Python" not in chat.digests(examples)._jdf.queryExecution().executedPlan().toString()


def test_sentencepiece(spark, odd, texts):
    import sentencepiece

    reference = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    found = rows(entry_points.queries()["op9_sentencepiece"](spark, SF)).set_index("doc_id")
    assert found.parity.all()
    for k, t in texts.items():
        ids = np.array(reference.encode(t or ""), "<u4")
        assert (found.n_ids[k], found.ids_crc32[k]) == (len(ids), zlib.crc32(ids.tobytes()))
        assert found.decoded_crc32[k] == zlib.crc32((t or "").encode())
    small = sentencepieces.round_trips(odd, MODEL).collect()
    assert len(small) == len(ODD) and all(r.parity for r in small)
    assert sorted((key(r.doc_id) or 0, r.decoded) for r in small) == sorted((k or 0, t or "") for k, t in ODD)
    again = sentencepieces.decode_ids(sentencepieces.encode_texts(odd, MODEL), MODEL)
    assert sorted(r.text for r in again.collect()) == sorted(t or "" for _, t in ODD)
    assert sentencepieces.encode_texts(odd.limit(0), MODEL).count() == 0


def test_unigram_models():
    """A unigram model written by hand: scores, byte fallback, prefix and extra spaces."""
    import struct

    import sentencepiece

    def part(number, value):
        if isinstance(value, int):
            return bytes([number << 3 & 0x7F | (0x80 if number > 15 else 0), *([number >> 4] if number > 15 else []), value])
        return bytes([number << 3 | 2, *([len(value) & 0x7F | 0x80, len(value) >> 7] if len(value) > 127 else [len(value)])]) + value

    def piece(text, score, kind):
        return part(1, part(1, text.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", score) + part(3, kind))

    known = [("▁", -2.0), ("▁the", -3.0), ("▁th", -4.0), ("e", -3.5), ("t", -4.5), ("h", -4.6), ("▁cat", -5.0), ("c", -6.0), ("a", -6.1),
             ("s", -4.0), ("at", -4.4)]
    raw = piece("<unk>", 0.0, 2) + piece("<s>", 0.0, 3) + piece("</s>", 0.0, 3)
    raw += b"".join(piece(f"<0x{b:02X}>", 0.0, 6) for b in range(256)) + b"".join(piece(p, s, 1) for p, s in known)
    raw += part(2, part(3, 1) + part(35, 1)) + part(3, part(1, b"identity") + part(3, 1) + part(4, 1) + part(5, 1))
    reference = sentencepiece.SentencePieceProcessor(model_proto=raw)
    model = sentencepieces.SentencePieceModel.parse(raw)
    assert (model.kind, model.byte_fallback, len(model.pieces)) == (1, True, 3 + 256 + len(known))
    tokenizer = sentencepieces.build(model)
    for text in ("the cats", "that  cat ", " ß the", "chat", "hat the"):
        assert tokenizer.encode(text, add_special_tokens=False).ids == reference.encode(text)
        assert tokenizer.decode(reference.encode(text), skip_special_tokens=False) == reference.decode(reference.encode(text))


def test_quality(spark, odd, texts):
    found = rows(entry_points.queries()["op10_quality"](spark, SF)).set_index("doc_id")
    for k, t in texts.items():
        r = found.loc[k]
        measures = brute.quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures
        failed = measures[0] < 10 or 100 * measures[4] > 20 * measures[0]
        assert r.base_failed == failed and not (failed and r.kept)
    small = rows(quality.quality_rules(odd))
    assert len(small) == len(ODD) and not small[small.doc_id.isin([1, 2, 3, 4, 7])].kept.any()
    kept = quality.keep_quality(odd)
    assert kept.columns == odd.columns and kept.count() == small.kept.sum()
    assert quality.quality_rules(odd.limit(0)).count() == 0


def test_quality_shares():
    text = "a b c d e f g h i j k l\na b c d e f g h i j x y z w v u t s r q p\nq q q q q q q q q q"
    *_, shares, _, _ = quality.measure(text)
    assert {n: round(s, 9) for n, s in shares.items()} == {n: round(brute.covered_share(text, n), 9) for n in range(5, 11)}


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 12)).astype(np.float32)
    x[50:150] = x[50]
    vectors = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist())]
    odd = [(1000, None), (1020, [0.0] * 12), (1040, [float("nan")] + [1.0] * 11), (1060, [1.0, None] + [1.0] * 10), (1080, [1.0]), (None, x[3].tolist())]
    table = spark.createDataFrame(vectors + odd, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    found = rows(neighbours.nearest(table, F.col("vec_id") % 20 == 0)).sort_values(["query_id", "rank"])
    got = {k: list(zip(g.vec_id, g.score)) for k, g in found.groupby("query_id")}
    assert set(got) == set(range(0, 400, 20))
    ids, doubles = np.arange(400), x.astype(float)
    for q in got:  # the table is smaller than a window, so the search is exact, ties included
        assert got[q] == brute.nearest(ids, doubles, q, 20)
    assert neighbours.nearest(table.limit(0), F.lit(True)).count() == 0


def test_neighbours_recall(spark):
    """Recall against brute force on the test vectors, with windows much smaller than the table."""
    sf = SF.replace("0.001", "0.1")
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    x = np.stack([r.embedding for r in table.orderBy("vec_id").collect()]).astype(float)
    found = rows(neighbours.nearest(table, F.col("vec_id") % 20 == 0))
    hits = sum(len(set(g.vec_id) & {i for i, _ in brute.nearest(np.arange(len(x)), x, int(q), 20)}) for q, g in found.groupby("query_id"))
    assert hits / len(found) >= 0.9


@pytest.mark.parametrize("most, met", [(16384, 9), (16, 3)])
def test_windows_grow_with_the_table(spark, monkeypatch, most, met):
    """Recall on evenly spread vectors, many times as many as a block of the least size has rows."""
    for name, value in (("BLOCK", 16), ("MOST_BLOCK", most), ("MET", met)):
        monkeypatch.setattr(neighbours, name, value, raising=False)
    x = np.random.default_rng(8).standard_normal((4000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>")
    found = rows(neighbours.nearest(table, F.col("vec_id") % 40 == 0))
    hits = sum(len(set(g.vec_id) & {i for i, _ in brute.nearest(np.arange(4000), x.astype(float), int(q), 20)}) for q, g in found.groupby("query_id"))
    print("recall", hits / len(found))
    assert len(found) == 2000 and hits / 2000 >= 0.9


def test_hilbert_steps_are_neighbours():
    side = np.arange(16)
    cells = np.stack(np.meshgrid(side, side, side, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = neighbours.hilbert_keys(cells, 4)
    path = cells[np.argsort(keys)]
    assert sorted(keys) == list(range(16 ** 3)) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_pipeline(spark):
    """Every stage against brute force on what the stage before kept."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(common.written(stage(spark, frames[-1], SF), name))
    assert all(f.columns == docs.columns for f in frames[:4])
    start, good, known, single, packed = map(rows, frames)
    assert set(good.doc_id) == {k for k, t in zip(start.doc_id, start.text) if quality.measure(t)[-1]}
    assert set(known.doc_id) == {k for k, t in zip(good.doc_id, good.text) if any(c.isalpha() for c in t or "")}
    sets = [set(brute.shingles(t, 5)) for t in known.text]
    roots = brute.groups(len(sets), lambda i, j: brute.jaccard(sets[i], sets[j]) >= 0.8)
    smallest: dict = {}
    for k, r in zip(known.doc_id, roots):
        smallest[r] = min(k, smallest.get(r, k))
    assert sorted(single.doc_id) == sorted(smallest.values())
    check_packing(packed, single.set_index("doc_id").text)
    assert corpus_pipeline.run(spark, SF).count() == len(packed)
