"""Pieces of words, signs and line breaks: remembered by themselves, with the library's ids."""

from itertools import product

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from duskwatch.llm import packing

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "É", "7", ",", "'", "s", "\n", "\t", " ", "\xa0", "　", "日", "×", "\x1c"]


def expected(cache, texts):
    return [np.array(e.ids, "<u4").tobytes() for e in cache.tokenizer.encode_batch(texts, add_special_tokens=False)]


class Counted(dict):
    lookups = 0

    def get(self, key):
        Counted.lookups += 1
        return super().get(key)

    def __getitem__(self, key):
        Counted.lookups += 1
        return super().__getitem__(key)


def test_words_around_signs_and_line_breaks_are_learned_once():
    cache = packing.WordCache(VOCABULARY)
    cache.known = Counted()
    learned = []
    learn = cache._learn
    cache._learn = lambda pieces: learned.extend(pieces) or learn(pieces)
    words = [f"w{'abcdefghijklmnopqrstuvwxyz'[i]}x" for i in range(20)]
    texts = [f"see {a}.\n{b}, {b}!\n\n{a}" for a, b in product(words, words)]
    assert cache.encode(texts) == expected(cache, texts)
    assert len(learned) <= 2 * len(words) + 10 and len(set(learned)) == len(learned) == Counted.lookups


@pytest.mark.parametrize("length", [1, 2, 3])
def test_all_mixtures_of_kinds_equal_the_library(length):
    cache = packing.WordCache(VOCABULARY)
    texts = ["".join(p) for p in product(PARTS, repeat=length)]
    texts += [f"x{t}y" for t in texts] + [""]
    assert cache.encode(texts) == expected(cache, texts)


def test_long_pieces_are_not_remembered():
    cache = packing.WordCache(VOCABULARY)
    texts = ["日" * 500, "short " + "b" * 500]
    assert cache.encode(texts) == expected(cache, texts) == cache.encode(texts)
    assert set(cache.known) == {"short"}


def test_other_splitters_are_cut_at_spaces_alone(tmp_path):
    """A splitter that takes signs into words and line breaks into signs."""
    alphabet = sorted(pre_tokenizers.ByteLevel.alphabet())
    merges = [("Ġ", "a"), (",", "a"), (",", "Ċ"), ("Ċ", "Ċ"), ("Ġ", "Ġ"), ("Ġ", ",")]
    vocab = {w: i for i, w in enumerate(alphabet + ["".join(m) for m in merges])}
    tokenizer = Tokenizer(models.BPE(vocab, merges))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    path = str(tmp_path / "other.json")
    tokenizer.save(path)
    cache = packing.WordCache(path)
    assert not cache.splits
    texts = ["".join(p) for n in (1, 2, 3, 4) for p in product(["a", ",", "\n", " ", "日", "　"], repeat=n)]
    assert cache.encode(texts) == expected(cache, texts)


def test_shares_hold_all_rows(monkeypatch):
    monkeypatch.setattr(packing, "AT_A_TIME", 10)
    texts = ["", "a" * 30, "bb", "", "c" * 9, "d", "e" * 10, ""]
    batch = pa.RecordBatch.from_pydict({"k": list(range(8)), "t": texts}).slice(1)
    shares = list(packing._shares(batch))
    assert [t for s in shares for t in s.column(1).to_pylist()] == texts[1:]
    assert all(s.num_rows == 1 or sum(map(len, s.column(1).to_pylist())) <= 10 for s in shares)
    cache = packing.WordCache(VOCABULARY)
    assert [ids for s in shares for ids in cache.encode(s.column(1))] == expected(cache, texts[1:])
