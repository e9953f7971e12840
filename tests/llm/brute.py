"""Plain versions of the contracts, for whole small tables."""

import re
from collections import Counter

import numpy as np
import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")


def shingles(text, size):
    words = WORDS.findall(low(text))
    if len(words) < size:
        return [" ".join(words)] if words else []
    return [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)]


def simhash(text):
    counts, all_ = [0] * 64, shingles(text, 3)
    for s in all_:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(all_))


def groups(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def quality(text):
    words = WORDS.findall(text or "")
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    inside = [False] * len(words)
    for i in range(len(words) - 4):
        if windows[tuple(words[i:i + 5])] > 1:
            inside[i:i + 5] = [True] * 5
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, sum(inside)


def covered_share(text, size):
    """Share of word characters inside n-grams that occur before."""
    words = WORDS.findall(text or "")
    seen, inside = set(), [False] * len(words)
    for i in range(len(words) - size + 1):
        gram = tuple(words[i:i + size])
        if gram in seen:
            inside[i:i + size] = [True] * size
        seen.add(gram)
    total = sum(map(len, words))
    return sum(len(w) for w, x in zip(words, inside) if x) / total if total else 0.0


def phrases(text, table):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))
    return len(words), [(i, label) for p, label in table.items() for i in range(len(words))
                        if words[i:i + len(p.split())] == p.split()]


def nearest(ids, x, query, k):
    score = np.zeros(len(x))
    for d in range(x.shape[1]):
        score += x[query, d] * x[:, d]
    return [(int(ids[j]), score[j]) for j in np.lexsort((ids, -score)) if j != query][:k]
