"""Personal data: fixed patterns and a linear-chain conditional random field over word shapes."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskwatch.llm.common import SLICE, arrow_schema

#: Kinds the patterns find, in the order of the output, and those the field adds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "account", "person")
LABELS = ("", *KINDS)
#: Documents, at most, from which labelled windows are taken, of at most so many characters; sentences, at most, that are learned from.
SAMPLE_ROWS, SAMPLE_CHARS, SENTENCES = 300, 20_000, 6000
#: Words on either side that a label looks at.
REACH = 2
#: Words whose features a worker remembers in each of two generations.
REMEMBERED = 300_000
_SEED = 3

_LOCAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(rb"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGITS = bytes(set(range(256)) - set(b"0123456789"))


def _digits(raw: bytes) -> bytes:
    return raw.translate(None, _NOT_DIGITS)


def luhn(raw: bytes) -> bool:
    """13 to 19 digits whose check digit is right."""
    digits = _digits(raw)
    if not 13 <= len(digits) <= 19:
        return False
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes of what the patterns find, in the order of kinds. Linear in the text.

    A mail address is sought at its @: the local part reaches back to the last byte that cannot
    belong to it or to the address before. An address part run begins where its digits begin.
    """
    found = []
    free, at = 0, text.find(b"@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((0, start, domain.end()))
        free = domain.end() if domain else at + 1
        at = text.find(b"@", free)
    for m in _IP.finditer(text):
        if all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in m[0].split(b".")):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and luhn(m[0]):
            found.append((2, m.start(), m.end()))
    if b"+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append((3, m.start(), m.end()))
    return found


# --- features ---

_PUNCTUATION = b"\"'()[]{}<>,;:.!?*#$%&|=`"
_SHAPES = bytes(
    ord("d") if 48 <= c <= 57 else ord("X") if 65 <= c <= 90 else ord("x") if 97 <= c <= 122 or c > 127 else c for c in range(256))
_RUN = re.compile(rb"d+|x+|X+")
_HEX = re.compile(rb"[0-9a-fA-F]{16,}")


def _short(run: re.Match) -> bytes:
    kind, n = run[0][:1], len(run[0])
    if kind == b"d":
        return kind + (str(n).encode() if n < 5 else b"m" if n < 9 else b"l" if n < 13 else b"n" if n < 20 else b"h")
    return kind if n < 2 else kind * 2


def features(word: bytes) -> tuple[str, ...]:
    """What is known of a word: its shape (how long runs of digits are, letters in brief), the shape without
    punctuation around it, its digits, its length, and itself in lower case."""
    core = word.strip(_PUNCTUATION)
    shape = _RUN.sub(_short, word.translate(_SHAPES))[:24]
    inner = _RUN.sub(_short, core.translate(_SHAPES))[:24]
    digits = len(_digits(word))
    letters = len(core) - len(_digits(core))
    found = ["s=" + shape.decode("latin-1"), "i=" + inner.decode("latin-1"), f"n={min(digits, 20) if digits < 13 else 13 + (digits > 19)}",
             f"l={min(len(core).bit_length(), 7)}", f"m={min(digits, 1)}{min(letters, 1)}{int(b'@' in word)}"]
    if _HEX.fullmatch(core) and 0 < letters:
        found.append(f"h={min(len(core) // 8, 5)}")
    if len(core) <= 16:
        found.append("w=" + core.lower().decode("utf-8", "replace"))
    return tuple(found)


@dataclass
class Field:
    """Weights of a linear-chain conditional random field: by feature, distance of its word and label; and of label after label."""

    index: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1, 2 * REACH + 1, len(LABELS))))
    steps: np.ndarray = field(default_factory=lambda: np.zeros((len(LABELS), len(LABELS))))

    def rows(self, word: bytes) -> list[int]:
        return [self.index[f] for f in features(word) if f in self.index]

    def emissions(self, words: list[bytes]) -> np.ndarray:
        """(words, labels) scores, words beyond the ends adding nothing."""
        own = np.array([self.weights[self.rows(w)].sum(axis=0) for w in words]).reshape(len(words), 2 * REACH + 1, len(LABELS))
        out = np.zeros((len(words), len(LABELS)))
        for far in range(-REACH, REACH + 1):
            a, b = max(0, -far), min(len(words), len(words) - far)
            if a < b:
                out[a:b] += own[a + far:b + far, far + REACH]
        return out


def viterbi(scores: np.ndarray, lengths: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Best labels of many sequences at once, (sequence, place, label) scores; before and after each stands label 0."""
    n, most, k = scores.shape
    best = scores[:, 0] + steps[0]
    back = np.zeros((n, most, k), np.int8)
    for t in range(1, most):
        through = best[:, :, None] + steps[None]
        back[:, t] = through.argmax(axis=1)
        step = through.max(axis=1) + scores[:, t]
        best = np.where((t < lengths)[:, None], step, best)
    out = np.zeros((n, most), np.int8)
    label = (best + steps[:, 0]).argmax(axis=1)
    for t in range(most - 1, -1, -1):
        inside = t < lengths
        out[inside, t] = label[inside]
        label = np.where(inside, back[np.arange(n), t, label], label)
    return out


def fit(sentences: list[tuple[list[bytes], list[int]]], rounds: int = 60, ridge: float = 0.02) -> Field:
    """Weights that make the given labels likely (forward-backward gradients, Adam over all sentences at once)."""
    sentences = [s for s in sentences if s[0]]
    seen = Counter(f for words, _ in sentences for w in words for f in features(w))
    model = Field({f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n > 1))})
    if not sentences or not model.index:
        return Field()
    k, wide = len(LABELS), 2 * REACH + 1
    n, most = len(sentences), max(len(w) for w, _ in sentences)
    lengths = np.array([len(w) for w, _ in sentences])
    distinct = {w: i for i, w in enumerate(sorted({w for words, _ in sentences for w in words}))}
    labels, word = np.zeros((n, most), int), np.full((n, most + 2 * REACH), len(distinct))  # the last number stands for no word
    for i, (words, tags) in enumerate(sentences):
        labels[i, :len(tags)] = tags
        word[i, REACH:REACH + len(words)] = [distinct[w] for w in words]
    known = [model.rows(w) for w in distinct]
    owner, feature = np.repeat(np.arange(len(known)), [len(r) for r in known]), np.array([f for r in known for f in r])
    owners, owner_starts = np.unique(owner, return_index=True)
    by_feature = np.argsort(feature, kind="stable")
    used, starts = np.unique(feature[by_feature], return_index=True)
    weights, steps = np.zeros((len(model.index), wide, k)), np.zeros((k, k))
    inside = np.arange(most)[None] < lengths[:, None]
    gold = np.zeros((n, most, k))
    gold[np.arange(n)[:, None], np.arange(most)[None], labels] = inside
    gold_steps = np.zeros((k, k))
    for (_, tags) in sentences:
        np.add.at(gold_steps, ([0, *tags], [*tags, 0]), 1)
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(steps), np.zeros_like(steps)]
    for at in range(1, rounds + 1):
        own = np.zeros((len(distinct) + 1, wide, k))
        own[owners] = np.add.reduceat(weights[feature], owner_starts)
        scores = sum(own[word[:, far:far + most], far] for far in range(wide))
        # Chances along the chain, scaled to sum 1 at each place.
        near, follow = np.exp(scores - scores.max(axis=2, keepdims=True)), np.exp(steps)
        ahead, scale = np.empty((n, most, k)), np.ones((n, most))
        at_start = near[:, 0] * follow[0]
        scale[:, 0] = at_start.sum(axis=1)
        ahead[:, 0] = at_start / scale[:, :1]
        for t in range(1, most):
            step = (ahead[:, t - 1] @ follow) * near[:, t]
            scale[:, t] = np.where(inside[:, t], step.sum(axis=1), 1.0)
            ahead[:, t] = np.where(inside[:, t, None], step / scale[:, t, None], ahead[:, t - 1])
        behind = np.broadcast_to(follow[:, 0], (n, k))
        chance = np.empty((n, most, k))
        pair = np.zeros((k, k))
        for t in range(most - 1, -1, -1):
            both = ahead[:, t] * behind
            chance[:, t] = both / both.sum(axis=1, keepdims=True) * inside[:, t, None]
            if t:
                reach = near[:, t] * behind
                weight = inside[:, t, None] / np.einsum("na,ab,nb->n", ahead[:, t - 1], follow, reach)[:, None]
                pair += follow * (ahead[:, t - 1].T @ (reach * weight))
                step = reach @ follow.T
                behind = np.where(inside[:, t, None], step / step.sum(axis=1, keepdims=True), behind)
        pair[0] += chance[:, 0].sum(axis=0)
        pair[:, 0] += chance[np.arange(n), lengths - 1].sum(axis=0)
        off = (gold - chance).reshape(n * most, k)
        missed = np.stack([np.stack([np.bincount(word[:, far:far + most].ravel(), off[:, y], len(distinct) + 1) for y in range(k)], axis=1)
                           for far in range(wide)], axis=1)
        slope = np.zeros_like(weights)
        slope[used] = np.add.reduceat(missed[owner[by_feature]], starts)
        for j, (value, g) in enumerate(((weights, slope - ridge * weights), (steps, gold_steps - pair - ridge * steps))):
            m, v = moments[2 * j], moments[2 * j + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value += 0.12 * (m / (1 - 0.9 ** at)) / (np.sqrt(v / (1 - 0.99 ** at)) + 1e-8)
    model.weights, model.steps = weights, steps
    return model


# --- labelled sentences ---

# Sentences with places for generated values, and names to fill them with.
FRAMES = (
    "my name is {person} and i live here", "please ask {person} about it", "dear {person} , thank you", "mr. {person} wrote this",
    "mrs. {person} called today", "signed by {person}", "ich bin {person} aus berlin", "je suis {person} de paris", "me llamo {person} y vivo en madrid",
    "call me at {phone} before noon", "phone: {phone}", "tel. {phone} or by post", "mobile {phone} please", "telefon {phone}",
    "téléphone {phone} merci", "llame al {phone} hoy", "fax {phone}", "write to {email} for more", "email: {email}", "mail {email} soon",
    "contact {email} or {phone}", "kontakt {email}", "token = {secret}", "api_key = {secret}", "api key: {secret}", "password: {secret}",
    "secret = {secret} in the file", "key={secret}", "my ssn is {account}", "ssn {account}", "iban {account} please", "account number {account}",
    "konto {account}", "pay with card {card} now", "card number {card}", "karte {card}", "the server {ip} is down", "from {ip} to {ip}", "host {ip}",
)
PLAIN = (
    "in the year {n4} we had {n2} days", "it costs {n2}.{n2} or {n1},{n3} in all", "see page {n3} of chapter {n1}", "version {n1}.{n1}.{n2} came out",
    "on {n4}-{n2}-{n2} at {n2}:{n2}", "about {n3} people and {n4} more", "item {n5} of {n6}", "between {n2} and {n2} percent", "the ratio is {n1}/{n2}",
    "number {n9} in the list", "id {n16} in the table", "order {n7} was sent", "the {w} token of the text", "call the next one", "a key part of the name",
    "my name is not here", "write to them and call again", "Then The Old House stood", "the name of the rose", "phone and mail are down",
)
FIRST = "Anna Ben Clara David Elena Frank Greta Hugo Ines John Karin Luis Maria Nina Oscar Paula Ruth Sofia Thomas Walter".split()
LAST = "Miller Smith Keller Dubois Garcia Brown Schmidt Moreau Lopez Fischer Jones Weber Martin Ruiz Clark Wagner Petit Diaz".split()


class _Values:
    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def digits(self, n: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, n)))

    def one(self, options):
        return options[int(self.rng.integers(len(options)))]

    def some(self, letters: str, n: int) -> str:
        return "".join(self.one(letters) for _ in range(n))

    def make(self, kind: str) -> str:
        d, one = self.digits, self.one
        first, last = one(FIRST), one(LAST)
        if kind == "person":
            return one((f"{first} {last}", f"{first} {first[0]}. {last}", f"{first} {last}"))
        if kind == "phone":
            return one((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(3)} {d(7)}", f"00{d(2)} {d(3)} {d(7)}", f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}",
                        f"{d(3)} {d(3)} {d(4)}", f"0{d(3)}/{d(6)}"))
        if kind == "email":
            low, host = f"{first}.{last}".lower(), one(("example.com", "mail.example.org", "post.example.net"))
            return one((f"{low}@{host}", f"{low}(at){host}", f"{low} (at) {host}", f"{low} [at] {host}", f"{low}[at]{host}",
                        f"{first.lower()} at example dot com", f"{self.some('abcdefgh', 5)}.{d(2)}@{host}"))
        if kind == "secret":
            return one((f'"{self.some("0123456789abcdef", 40)}"', self.some("0123456789abcdef", 32), f"sk-{self.some('abcdefghijkABCDEFGHIJK0123456789', 24)}",
                        f"AKIA{self.some('ABCDEFGHIJKLMNOP234567', 16)}", f'"{self.some("0123456789abcdef", 64)}"', self.some("abcdefgXYZ0123456789!#", 12)))
        if kind == "account":
            return one((f"{d(3)}-{d(2)}-{d(4)}", f"DE{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}", f"FR{d(2)}{d(20)}", f"ES{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(4)}"))
        if kind == "card":
            body = one("45") + d(14)
            whole = next(body + str(c) for c in range(10) if luhn((body + str(c)).encode()))
            return one((whole, " ".join(whole[i:i + 4] for i in range(0, 16, 4)), "-".join(whole[i:i + 4] for i in range(0, 16, 4))))
        if kind == "ip":
            return ".".join(str(int(self.rng.integers(1, 255))) for _ in range(4))
        return d(int(kind[1:])) if kind[1:] else self.some("abcdefgh", 6)


def generated_sentences(copies: int = 16, seed: int = _SEED) -> list[tuple[list[str], list[str]]]:
    """(words, labels) of the frames filled with generated values."""
    values, out = _Values(seed), []
    for _ in range(copies):
        for frame in (*FRAMES, *PLAIN):
            words, tags = [], []
            for part in frame.split(" "):
                held = re.search(r"\{(\w+)\}", part)
                kind = held[1] if held and held[1] in KINDS else ""
                while held:
                    part = part.replace(held[0], values.make(held[1]), 1)
                    held = re.search(r"\{(\w+)\}", part)
                for w in part.split(" "):
                    words.append(w)
                    tags.append(kind)
            out.append((words, tags))
    return out


def _labelled(text: str, windows: int = 3, plain: int = 4, wide: int = 6) -> list[tuple[list[str], list[str]]]:
    """Windows of a text around what the patterns and long hexadecimal strings show, and some more spread over it."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    words = [raw[a:b] for a, b in places]
    tags = [""] * len(words)
    for kind, a, b in base_spans(raw):
        for i, (c, d) in enumerate(places):
            if c < b and a < d:
                tags[i] = BASE[kind]
    for i, w in enumerate(words):
        if re.fullmatch(rb"[0-9a-fA-F]{32,}", w.strip(_PUNCTUATION)):
            tags[i] = "secret"
    marked = [i for i, t in enumerate(tags) if t][:windows]
    middle = [*marked, *(len(words) * (2 * i + 1) // (2 * plain) for i in range(plain))] if words else []
    cut = [(max(0, i - wide), i + wide) for i in middle]
    return [([w.decode("utf-8", "replace") for w in words[a:b]], tags[a:b]) for a, b in cut]


def labelled_table(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """A small table (words, labels) to learn from: generated sentences, and windows of at most ``sample_rows`` documents
    with and as many without a digit, chosen by a hash, labelled by the patterns."""
    spark = docs.sparkSession
    fit_for = docs.where(F.col(text).isNotNull() & (F.length(text) <= SAMPLE_CHARS)).select(F.xxhash64(key, text).alias("_h"), F.col(text).alias("_text"))
    digits = F.col("_text").rlike("[0-9]{3}")
    chosen = [fit_for.where(c).orderBy("_h", "_text").limit(sample_rows) for c in (digits, ~digits)]
    texts = [r["_text"] for r in chosen[0].union(chosen[1]).orderBy("_h", "_text").collect()]
    rows = generated_sentences() + [s for t in dict.fromkeys(texts) for s in _labelled(t)]
    return spark.createDataFrame(rows, "words array<string>, labels array<string>")


def train(labelled: DataFrame, sentences: int = SENTENCES) -> Field:
    """A field from at most so many sentences of a labelled table, chosen by a hash. Unknown labels count as none."""
    rows = labelled.where(F.size("words") == F.size("labels")).orderBy(F.xxhash64("words", "labels")).limit(sentences).collect()
    number = {k: i for i, k in enumerate(LABELS)}
    return fit([([w.encode("utf-8", "surrogatepass") for w in r["words"]], [number.get(t, 0) for t in r["labels"]]) for r in rows])


# --- decoding ---

class _Rows(dict):
    """Rows of the weight table by word; words of the last two generations are remembered."""

    def __init__(self, tagger: Tagger):
        super().__init__()
        self.tagger, self.old = tagger, {}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        row = self.old.get(word)
        if row is None:
            row = self.tagger.row(word)
        self[word] = row
        return row


class Tagger:
    """Decodes blocks of texts with a field.

    A word whose label 0 leads all others by more than any labels around it could make up for has
    label 0 in the best labelling. Such words cut a text into short runs, and only the runs are decoded.
    """

    def __init__(self, model: Field):
        self.model = model
        steps = model.steps
        k = len(LABELS)
        # What another label than 0 can gain at most from the labels before and behind it.
        self.gain = [max(float((steps[:, y] - steps[:, 0]).max() + (steps[y] - steps[0]).max()), 0.0) for y in range(k)]
        self.known: dict[tuple[int, ...], int] = {(): 0}
        self.table = np.zeros((1024, 2 * REACH + 1, k))
        self.lead = np.zeros((1024, 2 * REACH + 1, k - 1))
        self.rows = _Rows(self)

    def row(self, word: bytes) -> int:
        """The row with the summed weights of a word; words with the same features share one."""
        key = tuple(self.model.rows(word))
        at = self.known.get(key)
        if at is None:
            at = self.known[key] = len(self.known)
            if at == len(self.table):
                self.table, self.lead = (np.concatenate([x, np.zeros_like(x)]) for x in (self.table, self.lead))
            self.table[at] = self.model.weights[list(key)].sum(axis=0)
            self.lead[at] = self.table[at][:, 1:] - self.table[at][:, :1] + np.array(self.gain[1:]) / (2 * REACH + 1)
        return at

    def labels(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """The best labels of the words of each text."""
        sizes = np.array([len(t) for t in texts])
        # Words beyond the ends of a text have row 0, whose weights are nothing.
        starts = np.cumsum(np.append(0, sizes[:-1] + REACH)) + REACH
        rows = np.zeros(int(sizes.sum() + REACH * (len(texts) + 1)), np.int64)
        word = np.zeros(len(rows), bool)
        for words, a in zip(texts, starts):
            rows[a:a + len(words)] = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
            word[a:a + len(words)] = True
        most = self.lead.max(axis=2)
        reach = range(-REACH, REACH + 1)
        shifted = lambda far: rows[REACH + far:len(rows) - REACH + far]
        best = sum(most[shifted(far), far + REACH] for far in reach)
        open_ = np.flatnonzero((best > -1e-6) & word[REACH:len(rows) - REACH]) + REACH
        out = np.zeros(len(rows), np.int8)
        if len(open_):
            scores = sum(self.table[rows[open_ + far], far + REACH] for far in reach)
            first = np.flatnonzero(np.diff(open_, prepend=-2) != 1)
            length = np.diff(np.append(first, len(open_)))
            # Runs of about one length are decoded together, so that little is filled up.
            for bits in np.unique(np.frexp(length)[1]):
                these = np.flatnonzero(np.frexp(length)[1] == bits)
                longest = int(length[these].max())
                for part in np.array_split(these, max(1, len(these) * longest // 200_000)):
                    at = first[part][:, None] + np.arange(longest)[None]
                    inside = np.arange(longest)[None] < length[part][:, None]
                    found = viterbi(scores[np.where(inside, at, 0)], length[part], self.model.steps)
                    out[open_[at[inside]]] = found[inside]
        return [out[a:a + n] for a, n in zip(starts, sizes)]


def _plausible(kind: int, raw: bytes) -> bool:
    """What must hold of a span that only the field has found."""
    digits, words = len(_digits(raw)), raw.decode("utf-8", "replace").split()
    return {"email": b"@" in raw or b"at" in raw.lower() and b"dot" in raw.lower(), "ip": raw.count(b".") >= 3 or raw.count(b":") >= 2, "card": luhn(raw),
            "phone": 7 <= digits <= 15, "secret": len(raw) >= 8, "account": digits >= 9, "person": 1 < len(words) < 5 and len(set(words)) == len(words) and raw.translate(None, b" .\n").decode("utf-8", "replace").isalpha()
            and all(w[:1].isupper() and (w[1:].islower() and len(w) > 2 or w[1:] == "." and 0 < i < len(words) - 1) for i, w in enumerate(words))}[KINDS[kind]]


def _places(text: bytes) -> np.ndarray:
    """Starts of the words of a text; their ends follow from their lengths."""
    raw = np.frombuffer(text, np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    return np.flatnonzero(~space & np.append(True, space[:-1]))


def spans(texts: list[bytes], tagger: Tagger) -> Iterator[tuple[list, list]]:
    """Of each text (base, added): spans (kind, start, end) in bytes; added ones overlap no base span."""
    words = [t.split() for t in texts]
    for text, ws, labels in zip(texts, words, tagger.labels(words)):
        base, added = base_spans(text), []
        marked = np.flatnonzero(labels)
        if len(marked):
            starts = _places(text)
            for run in np.split(marked, np.flatnonzero((np.diff(marked) != 1) | (np.diff(labels[marked]) != 0)) + 1):
                a, b = int(starts[run[0]]), int(starts[run[-1]]) + len(ws[run[-1]])
                raw = text[a:b]
                left = len(raw) - len(raw.lstrip(_PUNCTUATION.replace(b"(", b"") if LABELS[labels[run[0]]] == "phone" else _PUNCTUATION))
                a, b = a + left, a + len(raw.rstrip(_PUNCTUATION))
                kind = int(labels[run[0]]) - 1
                if a < b and _plausible(kind, text[a:b]) and not any(c < b and a < d for _, c, d in base):
                    added.append((kind, a, b))
        yield base, added


def _characters(text: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans with places counted in code points."""
    if not found or text.isascii():
        return found
    raw = np.frombuffer(text, np.uint8)
    before = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
    return [(k, int(before[a]), int(before[b])) for k, a, b in found]


def find_personal(docs: DataFrame, model: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Personal data in every whole text.

    Columns: key; base and spans, arrays of (kind, start, end) in code points, end exclusive, ordered by kind and
    start. ``base`` is what the fixed patterns find, ``spans`` also what the field adds without touching it: mail addresses and
    telephone numbers spelt otherwise, cards, secrets, account numbers and persons. A null text is empty and has none; a model
    without weights adds nothing; repeated rows are searched each; other columns are ignored; an empty table gives no rows.
    """
    span = "array<struct<kind:int,start:long,end:long>>"
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType)] + T._parse_datatype_string(f"base {span}, spans {span}").fields)
    kept: list[Tagger] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not kept:
            kept.append(Tagger(model))
        target = arrow_schema(schema)
        names = ("kind", "start", "end")
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                some = batch.slice(at, SLICE)
                texts = [t or b"" for t in some.column(1).to_pylist()]
                base, all_ = [], []
                for t, (b, a) in zip(texts, spans(texts, kept[0])):
                    whole = sorted(_characters(t, b + a))
                    base.append([dict(zip(names, s)) for s in sorted(_characters(t, b))])
                    all_.append([dict(zip(names, s)) for s in whole])
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(base, target.field("base").type), pa.array(all_, target.field("spans").type)], schema=target)

    found = docs.select(key, F.col(text).cast("binary").alias("_text")).mapInArrow(run, schema)
    names = F.array(*(F.lit(k) for k in KINDS))
    named = lambda c: F.transform(c, lambda s: F.struct(names[s["kind"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select(key, named("base").alias("base"), named("spans").alias("spans"))
