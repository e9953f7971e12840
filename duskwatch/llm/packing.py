"""Vector best-fit packing of token sequences."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskwatch.llm.common import arrow_schema, written

CAPACITY = 2048
#: The id after each document.
END_ID = 0
#: Pieces whose ids a Python worker remembers in each of two generations, and the longest of them in characters.
REMEMBERED, LONGEST = 700_000, 64
#: Bytes of texts that are encoded at a time (at least one text).
AT_A_TIME = 8 << 20

_WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
#: A space that does not by itself begin a new token, or white space at the start; for Arrow, whose ``\s`` knows ASCII only.
_HARD = f" (?:[{_WHITE}]|\\z)|\\A[{_WHITE}]"
#: Pieces that newlines keep apart.
_PLAIN = re.compile(r" ?\S+")
#: White space of two and three bytes.
_WIDE = [np.array([int.from_bytes(c.encode(), "big") for c in _WHITE if len(c.encode()) == n]) for n in (2, 3)]

_OTHER, _LETTER, _DIGIT, _SIGN, _BREAK, _SPACE = range(6)
_SEEN = (_LETTER, _DIGIT, _SIGN)
#: Kind of each byte; letters of two bytes are found apart.
_KINDS = bytes(_OTHER if b > 126 else _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _SIGN if b > 32
               else _SPACE if b == 32 else _BREAK if 9 <= b <= 13 else _OTHER for b in range(256))


def _begins(before: int, here: int, after: int) -> bool:
    """Whether the splitter of GPT-2 cuts before a byte for sure, by its kind and its neighbours'; what is on either side then splits alike by itself.

    A run of white space is cut before its last character if something visible follows, and a
    space then belongs to that. Letters behind a quote, as in contractions, are another matter.
    """
    if here == _BREAK:
        return before in _SEEN or after in _SEEN
    if here == _SPACE:
        return after in _SEEN
    return here != _OTHER and before != here and before not in (_OTHER, _SPACE)


#: By the kinds of three bytes in a row, as digits to base 6.
_BEGINS = bytes(n < 216 and _begins(n // 36, n // 6 % 6, n % 6) for n in range(256))


class WordCache:
    """Token ids of whole texts from a byte-level BPE of the tokenizers library.

    The splitter of these vocabularies always begins a token at a space that stands before
    something visible, and the one of GPT-2 also between letters, digits, signs and line breaks, so the pieces
    between can be encoded by themselves, new ones many at a time, and remembered. Pieces in use move on to the
    next generation when one is full, and only those not met since are forgotten; long ones are not remembered.
    With other splitters, texts with other uses of white space are encoded whole.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        self.starts, self.breaks = np.zeros((2, max(vocab.values()) + 1), bool)
        self.starts[[i for w, i in vocab.items() if w.startswith("Ġ")]] = True
        self.breaks[[i for w, i in vocab.items() if w.startswith("Ċ")]] = True
        splitter = self.tokenizer.pre_tokenizer
        self.splits = isinstance(splitter, ByteLevel) and splitter.use_regex and not splitter.add_prefix_space and self.tokenizer.normalizer is None

    def _meet(self, pieces: list[str]) -> list[bytes]:
        """Ids of each of the different pieces."""
        if len(self.known) > REMEMBERED:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        held = list(map(known.get, pieces))
        missing = [i for i, ids in enumerate(held) if ids is None]
        learned = self._learn([w for w in map(pieces.__getitem__, missing) if w not in old])
        for i in missing:
            w = pieces[i]
            ids = learned.get(w)
            held[i] = ids = old[w] if ids is None else ids
            if len(w) <= LONGEST:
                known[w] = ids
        return held

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of different pieces by the library."""
        learned: dict[str, bytes] = {}
        spaced, bare, single = [], [], []
        for w in pieces:
            (single if not self.splits or not _PLAIN.fullmatch(w) else spaced if w[0] == " " else bare).append(w)
        for plain, before, mark in ((spaced, "", self.starts), (bare, "\n", self.breaks)):
            skip = 4 * len(before)
            for at in range(0, len(plain), 4096):
                some = plain[at:at + 4096]
                ids = np.array(self._batch([before + before.join(some)])[0].ids, dtype="<u4")
                edges = (np.append(np.flatnonzero(mark[ids]), len(ids)) * 4).tolist()
                if len(edges) != len(some) + 1:
                    single += some
                    continue
                raw = ids.tobytes()
                for w, a, b in zip(some, edges, edges[1:]):
                    learned[w] = raw[a + skip:b]
        for w, e in zip(single, self._batch(single)):
            learned[w] = np.array(e.ids, dtype="<u4").tobytes()
        return learned

    def _batch(self, texts: list[str]):
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)

    def _cuts(self, texts: pa.Array, raw: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Where the pieces of all texts begin, in bytes."""
        kinds = np.frombuffer(bytearray(b"\0" + raw.tobytes() + b"\0").translate(_KINDS), np.uint8)
        here = kinds[1:-1]
        if self.splits:
            wide = np.flatnonzero((raw >= 0xC3) & (raw <= 0xC5))  # U+00C0 to U+017F, all letters but two
            two = raw[wide + 1]
            wide = wide[(raw[wide] != 0xC3) | (two != 0x97) & (two != 0xB7)]
            here[wide] = here[wide + 1] = _LETTER
            begins = np.frombuffer(bytearray(kinds[:-2] * 36 + here * 6 + kinds[2:]).translate(_BEGINS), bool)
            quoted = np.flatnonzero(raw[:-1] == 39) + 1
            begins[quoted] &= here[quoted] != _LETTER
        else:
            begins = (here == _SPACE) & (kinds[2:] != _SPACE) & (kinds[2:] != _BREAK)
        after = np.append(raw, np.zeros(3, np.uint8))
        wide = np.flatnonzero((here == _SPACE) & (after[1:-2] > 127))
        two = after[wide + 1].astype(int) << 8 | after[wide + 2]
        begins[wide] = ~(np.isin(two, _WIDE[0]) | np.isin(two << 8 | after[wide + 3], _WIDE[1]))
        full = edges[1:] > edges[:-1]
        last = edges[1:][full] - 1
        begins[last] &= (here[last] != _SPACE) & ((here[last] != _BREAK) | np.isin(kinds[last], _SEEN))
        if not self.splits:
            begins &= np.repeat(~pc.match_substring_regex(texts, _HARD).to_numpy(zero_copy_only=False), np.diff(edges))
        begins[edges[:-1][full]] = True
        return np.flatnonzero(begins)

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text.

        Each different piece is looked up once; the ids of all texts are then copied from those of the pieces in one step.
        """
        if not len(texts):
            return []
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string())
        _, offsets, data = texts.buffers()
        edges = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1]
        start = int(edges[0])
        edges = edges - start
        if not edges[-1]:
            return [b""] * len(texts)
        raw = np.frombuffer(data, np.uint8)[start:start + int(edges[-1])]
        begin = self._cuts(texts, raw, edges)
        places = pa.py_buffer(np.append(begin, len(raw)).astype(np.int32))
        coded = pa.StringArray.from_buffers(len(begin), places, pa.py_buffer(raw)).dictionary_encode()
        held = self._meet(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        pool = np.frombuffer(b"".join(held), "<u4")
        sizes = np.fromiter(map(len, held), np.int32, len(held)) // 4
        of = coded.indices.to_numpy()
        lengths = sizes[of]
        ends = np.append(np.int32(0), np.cumsum(lengths, dtype=np.int32))
        ids = pool[np.repeat((np.cumsum(sizes, dtype=np.int32) - sizes)[of] - ends[:-1], lengths) + np.arange(ends[-1], dtype=np.int32)]
        cuts = ends[np.searchsorted(begin, edges)].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


_caches: dict[str, WordCache] = {}


def _shares(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch with about ``AT_A_TIME`` bytes of texts, its second column, at a time."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_A_TIME, side="right")))
        yield batch.slice(at, to - at)
        at = to


def token_pieces(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
                 end_id: int = END_ID, digests: bool = False) -> DataFrame:
    """Token ids of every whole text and the end id, cut into pieces of at most ``capacity`` ids.

    Only longer documents are cut; all pieces but the first then have exactly ``capacity`` ids.
    Columns: key, piece (from 0), start (ids of the document before it), length, ids
    (little-endian unsigned 32-bit; with ``digests`` their CRC-32 as ids_crc32 instead), part and nth (the
    how many-th piece of this length in its task). Written to the shared folder, as the numbering must not change. A null text is empty.
    """
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind)] + T._parse_datatype_string(
        f"piece int, start long, length long, {'ids_crc32 long' if digests else 'ids binary'}, part int, nth long").fields)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _caches.get(vocabulary) or _caches.setdefault(vocabulary, WordCache(vocabulary))
        target = arrow_schema(schema)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for some in _shares(batch.set_column(1, text, pc.fill_null(batch.column(1), ""))):
                columns: list[list] = [[] for _ in target]
                for k, raw in zip(some.column(0).to_pylist(), cache.encode(some.column(1))):
                    raw += end
                    n = len(raw) // 4
                    edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for i, (a, b) in enumerate(zip(edges, edges[1:])):
                        held = raw[4 * a:4 * b]
                        for c, v in zip(columns, (k, i, a, b - a, zlib.crc32(held) if digests else held, part, int(seen[b - a]))):
                            c.append(v)
                        seen[b - a] += 1
                if columns[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, target)], schema=target)

    return written(docs.select(key, text).mapInArrow(run, schema), "pieces")


@dataclass
class Limits:
    """What one sequence can hold: ids, pieces, and attention cost (squares of the lengths, summed)."""

    tokens: int = CAPACITY
    pieces: int = CAPACITY
    cost: int = CAPACITY * CAPACITY
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    rule: str = "norm"


def best_fit(counts: dict[int, int], limits: Limits) -> list[tuple[int, int, int, int]]:
    """Pack ``counts[length]`` pieces of each length; (length, first rank, first sequence, offset).

    Pieces of one length are one class and bins with the same contents are one kind, kept as a range
    of sequence numbers, so the work depends on the number of lengths and not of pieces. Classes are
    taken from the longest on. Each goes to the kind of bin that has room under all three
    capacities and the least weighted norm of what then stays free (rule ``norm``) or the largest
    weighted dot-product of demand and free room (``dot``); a new bin is opened only if none has
    room. A row says that pieces from that rank on, up to the next row of the length, stand at
    that offset of that sequence and the following ones.
    """
    whole = np.array([limits.tokens, limits.pieces, limits.cost], float)
    weights = np.array(limits.weights)
    free = np.empty((0, 3))
    size = np.empty(0, np.int64)
    first = np.empty(0, np.int64)
    rows: list[tuple[int, int, int, int]] = []
    opened = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        need = np.array([length, 1, length * length], float)
        if (need > whole).any():
            raise ValueError(f"a piece of {length} ids fits no sequence")
        while left:
            after = free - need
            room = (after >= 0).all(axis=1)
            if not room.any():
                layers = int((whole // need).min())
                for bins, deep in ((left // layers, layers), (int(left % layers > 0), left % layers)):
                    if not bins:
                        continue
                    for k in range(deep):
                        rows.append((length, rank, opened, k * length))
                        rank += bins
                    free = np.vstack([free, whole - deep * need])
                    size, first = np.append(size, bins), np.append(first, opened)
                    opened += bins
                break
            at = np.flatnonzero(room)
            if limits.rule == "dot":
                best = at[np.argmax(((free[at] / whole) * (need / whole)) @ weights)]
            else:
                best = at[np.argmin(((after[at] / whole) ** 2) @ weights)]
            take = min(left, int(size[best]))
            rows.append((length, rank, int(first[best]), int(whole[0] - free[best, 0])))
            if take < size[best]:
                free, size, first = np.vstack([free, after[best]]), np.append(size, take), np.append(first, first[best])
                size[best] -= take
                first[best] += take
            else:
                free[best] = after[best]
            left -= take
            rank += take
        full = free[:, 0] > 0
        free, size, first = free[full], size[full], first[full]
    return rows


def place(pieces: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Give every piece a sequence and an offset; all columns but ``part`` and ``nth`` are kept.

    The driver sees one row per length and makes a plan of bounded size from it. A piece finds its
    place by its rank among the pieces of its length, which is its place in its task plus the
    counts of the tasks before, so no length, however common, is gathered.
    """
    limits = limits or Limits()
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("part", "length", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row per length
    plan = sorted(best_fit(counts, limits))
    starts = np.array([(length << 48) | rank for length, rank, _, _ in plan], np.int64)
    sequences = np.array([s for _, _, s, _ in plan], np.int64)
    places = np.array([o for _, _, _, o in plan], np.int64)
    ranked = pieces.join(offsets, ["part", "length"]).withColumn("_rank", F.col("nth") + F.col("_before"))
    kept = [c for c in pieces.columns if c not in ("part", "nth")]
    schema = T.StructType([pieces.schema[c] for c in kept] + T._parse_datatype_string("sequence_id long, offset long").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(schema)
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("_rank")).to_numpy()
            at = np.searchsorted(starts, (length << 48) | rank, side="right") - 1
            sequence = sequences[at] + rank - (starts[at] & ((1 << 48) - 1))
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(sequence, pa.int64()), pa.array(places[at], pa.int64())], schema=target)

    return ranked.select(*kept, "_rank").mapInArrow(run, schema)


def pack(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", limits: Limits | None = None) -> DataFrame:
    """Pack all documents into few sequences: their pieces with ids, sequence and offset.

    Every document, also a null or empty one, has at least the end id and so one piece; repeated rows
    and rows with a null key are packed each; other columns are ignored; an empty table gives no rows.
    """
    limits = limits or Limits()
    return place(token_pieces(docs, vocabulary, key, text, limits.tokens), limits)


def packed_digests(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", limits: Limits | None = None) -> DataFrame:
    """The placement of every piece as by ``pack``, with a checksum of its ids instead of the ids, which are never written."""
    limits = limits or Limits()
    return place(token_pieces(docs, vocabulary, key, text, limits.tokens, digests=True), limits)
