"""Token ids from remembered chunks: equal to the library's, and each different chunk is looked up once."""

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from duskwatch.llm import packing


class Counted(dict):
    lookups = 0

    def __getitem__(self, key):
        Counted.lookups += 1
        return super().__getitem__(key)


def test_chunks_are_looked_up_once():
    path = public_tokenizers.path("byte_bpe_50k.json")
    cache = packing.WordCache(path)
    cache.known = Counted()
    texts = ["the quick brown fox, " * 50 + "x"] * 20 + [
        "", "one", " lead", "\tlead", "two  spaces", "end ", "end \n", "a \n b", "a   b", "é 　ñ", "a \x1cb", "a \x85b", "a\x00 b\x00", "a\n\nB c.\nD", "🙂 👍🏽 x"]
    library = Tokenizer.from_file(path)
    assert cache.encode(texts) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert Counted.lookups <= 30
    assert cache.encode([]) == []
