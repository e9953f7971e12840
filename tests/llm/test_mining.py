"""Personal data, phrases and hard negatives against brute force, with odd rows."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from duskwatch.llm import negatives, personal, phrases
from tests.conftest import SF

# --- phrases ---


def best_phrases(docs, least, longest, best, covered):
    """Counting everything by text."""
    counts, words = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            ws = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(ws)
            for n in range(1, longest + 1):
                counts[lang].update(" ".join(ws[i:i + n]) for i in range(len(ws) - n + 1))
    out = set()
    for lang, f in counts.items():
        some = {p: a for p, a in f.items() if a >= least and " " in p}
        kept = []
        for p, a in some.items():
            if any(f" {p} " in f" {q} " and p != q and 100 * b >= covered * a for q, b in some.items()):
                continue
            ws = p.split(" ")
            score, _, l, r = min((2000000 * a // (f[" ".join(ws[:k])] + f[" ".join(ws[k:])]), k, f[" ".join(ws[:k])], f[" ".join(ws[k:])])
                                 for k in range(1, len(ws)))
            kept.append((-score, -a, p.encode(), a, l, r, score))
        out |= {(lang, i + 1, p.decode(), a, l, r, words[lang], s) for i, (_, _, p, a, l, r, s) in enumerate(sorted(kept)[:best])}
    return out


def found_phrases(df):
    return {tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


ODD_TEXTS = [
    (1, None, "en"), (2, "", None), (3, "  .\n\t ,", "en"), (4, "A b a B a b c", None), (4, "A b a B a b c", None), (5, "x\x01 y x\x01 y x y x y", "en"),
    (6, "é 日本 é 日本 é 日本! é 日本", "ü ü"), (7, "the cat sat. the cat sat; the cat ran " * 40, "en"), (8, "a " * 5000, "en"), (None, "the cat", ""),
]


@pytest.mark.parametrize("least, longest, best, covered", [(2, 4, 50, 80), (1, 3, 7, 100), (3, 2, 50, 1), (2, 5, 1000, 50)])
def test_phrases(spark, least, longest, best, covered):
    docs = spark.createDataFrame(ODD_TEXTS, "doc_id long, text string, lang string").withColumn("f", F.lit(1)).withColumn("phrase", F.lit("x")).withColumn("part", F.lit(2))
    assert found_phrases(phrases.collocations(docs.repartition(3), least, longest, best, covered)) == best_phrases(
        [r[1:] for r in ODD_TEXTS], least, longest, best, covered)


def test_phrases_of_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang").collect()
    assert found_phrases(entry_points.queries()["op12_phrases"](spark, SF)) == best_phrases(rows, 30, 4, 2000, 80)


def test_blocks_add_up(spark, monkeypatch):
    """Counts do not depend on where a task hands its counts on, nor on a filter that lets everything through."""
    docs = spark.createDataFrame(ODD_TEXTS, "doc_id long, text string, lang string")
    wanted = best_phrases([r[1:] for r in ODD_TEXTS], 2, 4, 50, 80)
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 50)
    monkeypatch.setattr(phrases, "FILTER_BITS", 64)
    assert found_phrases(phrases.collocations(docs, 2, 4, 50, 80)) == wanted


def test_ranges_cut_inside_a_word(spark):
    """One first word holds nearly all phrases, so every range begins inside its block."""
    rows = [("en", "a", 1000)] + [("en", f"a b{i:03}", 900 - i) for i in range(200)] + [("en", f"a b{i:03} c", 500 - i) for i in range(200)] + [("en", "c", 7)]
    counts = spark.createDataFrame(rows, "lang string, phrase string, f long")
    found = {r["phrase"]: r for r in phrases._lockstep(counts, suffix=False).collect()}
    assert len(found) == len(rows)
    assert found["a"]["more"] == 900 and found["a b007"]["more"] == 493
    assert found["a b199"]["heads"] == [1000] and found["a b199 c"]["heads"] == [1000, 701]


def test_no_phrases_in_empty_tables(spark):
    assert phrases.collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []


# --- personal data ---

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_of(text):
    """The patterns as written."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


def named(text):
    raw = text.encode()
    return [(personal.KINDS[k], a, b) for k, a, b in personal._characters(raw, personal.base_spans(raw))]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a-_.@+0159 ()é\n", max_size=60))
def test_base_patterns(text):
    assert named(text) == base_of(text)


def test_base_patterns_by_hand():
    for text in ("a@b.c@d.e", "x@@y.z", "1.2.3.4.5.6.7.8", "1.2.3 12.256.3.4 0000255.1.1.1", "4111 1111 1111 1111-", "9" * 5000, "é 4111111111111111 ü a.b@c.de",
                 "+1 (559) 555-3817. +12", "1 4111111111111111", ("a" * 300 + "@") * 50, "a." * 2000 + "@b"):
        assert named(text) == base_of(text)


@pytest.fixture(scope="module")
def field(spark):
    return personal.train(personal.labelled_table(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))


def plain_viterbi(scores, steps):
    best, back = scores[0] + steps[0], []
    for s in scores[1:]:
        through = best[:, None] + steps
        back.append(through.argmax(axis=0))
        best = through.max(axis=0) + s
    path = [int((best + steps[:, 0]).argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_cut_decoding_is_whole_decoding(field):
    rng = np.random.default_rng(5)
    tagger = personal.Tagger(field)
    some = [w for s, _ in personal.generated_sentences(2, 17) for w in s]
    texts = [[w.encode() for w in rng.choice(some, n)] for n in (1, 2, 3, 10, 50, 300, 1, 7)] + [[]]
    for words, labels in zip(texts, tagger.labels(texts)):
        if words:
            assert plain_viterbi(field.emissions(words), field.steps) == list(labels)
    # any weights, so that little is sure
    loose = personal.Field(field.index, rng.normal(0, 1, field.weights.shape), rng.normal(0, 1, field.steps.shape))
    for words, labels in zip(texts, personal.Tagger(loose).labels(texts)):
        if words:
            assert plain_viterbi(loose.emissions(words), loose.steps) == list(labels)


def test_gradients_reach_the_labels():
    """Chances of all labellings, summed by hand, are highest at the given one after training."""
    sentences = [([b"call", b"me", b"12345"], [0, 0, 4]), ([b"see", b"page", b"12345"], [0, 0, 0])] * 3
    model = personal.fit(sentences, rounds=80)
    for words, tags in sentences[:2]:
        assert plain_viterbi(model.emissions(words), model.steps) == tags


def test_held_out_sentences(field):
    """Of generated sentences not learned from, at least 95 % of marked words get their label and 99 % of others none."""
    tagger, hit, marked, clean, plain = personal.Tagger(field), 0, 0, 0, 0
    for words, tags in personal.generated_sentences(4, 1234):
        labels = tagger.labels([[w.encode() for w in words]])[0]
        for want, got in zip(tags, labels):
            if want:
                marked, hit = marked + 1, hit + (personal.LABELS[got] == want)
            else:
                plain, clean = plain + 1, clean + (got == 0)
    assert hit >= 0.95 * marked and clean >= 0.99 * plain


def test_personal(spark, field):
    texts = [(1, None), (2, ""), (3, "call é +1 (559) 555-3817 or a.b@c.de"), (3, "call é +1 (559) 555-3817 or a.b@c.de"), (None, "x"),
             (4, 'the api é token = "cb1a9fee807a05366fcb8b6c95c7c565ede51a72" here'), (5, "4111 1111 1111 1111 " * 3000), (6, "x\x00 " * 9)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("base", F.lit(1)).withColumn("spans", F.lit("x")).withColumn("kind", F.lit(0))
    found = personal.find_personal(docs, field).collect()
    assert len(found) == len(texts)
    for r in found:
        text = dict(texts)[r["doc_id"]] or ""
        assert [tuple(s) for s in r["base"]] == base_of(text)
        assert set(r["base"]) <= set(r["spans"]) and list(r["spans"]) == sorted(r["spans"], key=lambda s: (personal.KINDS.index(s["kind"]), s["start"]))
        if r["doc_id"] == 4:
            assert [(s["kind"], text[s["start"]:s["end"]]) for s in r["spans"]] == [("secret", "cb1a9fee807a05366fcb8b6c95c7c565ede51a72")]
    assert personal.find_personal(docs.limit(0), field).count() == 0
    assert personal.find_personal(docs, personal.Field()).select("spans").collect() == personal.find_personal(docs, field).select("base").collect()


def test_personal_query(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = entry_points.queries()["op11_personal"](spark, SF).collect()
    assert len(found) == len(texts)
    for r in found:
        base = base_of(texts[r["doc_id"]])
        listed = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest() and set(listed) <= set(r["spans"].split(",")) | {""}
        assert [r[f"n_{k}"] for k in personal.BASE] == [sum(b[0] == k for b in base) for k in personal.BASE]


# --- hard negatives ---

def mined(rows, anchors, positives=5, many=10, least=30, most=90):
    """All scores, sorted."""
    good = {}
    for k, v, label in rows:
        if k is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            vec = [int(np.floor(256 * float(x))) for x in v]
            good[k] = min(good.get(k, (label, vec)), (label, vec))
    out = set()
    for a in filter(anchors, good):
        label, vec = good[a]
        scored = sorted((-sum(x * y for x, y in zip(vec, w)), k, other) for k, (other, w) in good.items() if k != a and len(w) == len(vec))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            inside = [(k, -t) for t, k, other in scored if other != label and 30 * -s <= 100 * -t <= 90 * -s]
            out |= {(a, p, i + 1, k, -s, t) for i, (k, t) in enumerate(inside[:many])}
    return out


def found_negatives(df):
    return {tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()}


def vectors(seed=1, n=400):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in np.float32(rng.normal(0, 1, 6))], int(rng.integers(3))) for i in range(n)]
    same = [0.5, -0.25, 0.125, 1.0, 0.0, 0.5]
    rows += [(n + i, same, 1) for i in range(150)] + [(n + 150 + i, same, 2) for i in range(20)]
    rows += [(9000, None, 1), (9010, same, None), (None, same, 1), (9020, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (9030, [float("nan")] * 6, 1),
             (9040, [float("inf")] * 6, 1), (9050, [0.0] * 6, 1), (9060, [1.0, 2.0], 1), (9061, [0.5, 2.0], 1), (9062, [0.5, 1.0], 2), (9070, [], 1)]
    return rows + rows[:30]


@pytest.mark.parametrize("tree, block", [(4096, 4096), (7, 50), (1, 10)])
def test_negatives(spark, monkeypatch, tree, block):
    monkeypatch.setattr(negatives, "TREE", tree)
    monkeypatch.setattr(negatives, "BLOCK", block)
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("class", F.lit("x")).withColumn("score", F.lit(1)).withColumn("tree", F.lit(2))
    found = found_negatives(negatives.hard_negatives(df, F.col("vec_id") % 10 == 0))
    assert found == mined(rows, lambda k: k % 10 == 0)


def test_negatives_query(spark):
    rows = [(r["vec_id"], r["embedding"], (r["label"] + (r["vec_id"] % 7 == 0)) % 10) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    found = found_negatives(entry_points.queries()["op13_negatives"](spark, "/root/testdata/sf0.01"))
    assert found == mined(rows, lambda k: k % 100 == 0) and found


def test_no_anchors(spark):
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, label int")
    assert negatives.hard_negatives(df, F.lit(False)).collect() == []
    assert negatives.hard_negatives(df.limit(0), F.lit(True)).collect() == []


def test_bounds_skip_what_they_may():
    """On clustered vectors most candidates are never scored, and bounds hold for all."""
    rng = np.random.default_rng(2)
    centres = rng.integers(-200, 200, (8, 16))
    x = np.vstack([c + rng.integers(-4, 5, (300, 16)) for c in centres])
    order, parents, edges = negatives.spanning_tree(x[::20])
    anchors = x[::20][order]
    tile = negatives.Tile(anchors, parents, edges)
    exact = anchors @ x.T

    def wanted(i, low, high):
        assert (low <= exact[i]).all() and (exact[i] <= high).all()
        return high >= np.partition(exact[i], -20)[-20]

    for i, at, score in tile.walk(x, wanted):
        assert (score == exact[i, at]).all() and set(np.argsort(-exact[i])[:10]) <= set(at) | {j for j in range(len(x)) if exact[i, j] <= np.sort(exact[i])[-20]}
    assert tile.rescored < 0.5 * exact.size
