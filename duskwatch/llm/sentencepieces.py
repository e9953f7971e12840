"""SentencePiece models on the tokenizers library."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from duskwatch.llm.common import arrow_schema

#: Fixed values of the model format: kinds of models and of pieces.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MARK = "▁"
#: Texts and characters that are encoded at once.
BATCH_TEXTS, BATCH_CHARS = 256, 1 << 20


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message; groups do not occur in this format."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"not a SentencePiece model: wire type {kind}")
            size = varint()
        yield tag >> 3, raw[at:at + size]
        at += size


@dataclass
class SentencePieceModel:
    """What a model file says. Field numbers are those of the published schema."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_spaces: bool = True
    escape_spaces: bool = True
    suffix: bool = False

    @classmethod
    def parse(cls, raw: bytes) -> SentencePieceModel:
        model = cls()
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                model.pieces.append((piece.get(1, b"").decode("utf-8"), score, piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
                model.kind = trainer.get(3, UNIGRAM)
                model.byte_fallback = bool(trainer.get(35, 0))
                model.suffix = bool(trainer.get(24, 0))
            elif number == 3:
                normal = dict(_fields(value))
                model.charsmap = normal.get(2, b"")
                model.dummy_prefix = bool(normal.get(3, 1))
                model.remove_extra_spaces = bool(normal.get(4, 1))
                model.escape_spaces = bool(normal.get(5, 1))
        return model

    @property
    def unknown(self) -> int:
        return next((i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN), 0)


def merges_of(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """BPE merges in the order of the scores of what they make."""
    ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for piece, i in ids.items():
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in ids and right in ids:
                found.append((-pieces[i][1], ids[left], ids[right], left, right))
    return [(a, b) for *_, a, b in sorted(found)]


def build(model: SentencePieceModel):
    """A tokenizer of the tokenizers library that does what the model file says."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unknown = model.pieces[model.unknown][0]
    if model.kind == UNIGRAM:
        tokenizer = Tokenizer(models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown, model.byte_fallback))
    elif model.kind == BPE:
        tokenizer = Tokenizer(models.BPE(
            {p: i for i, (p, _, _) in enumerate(model.pieces)}, merges_of(model.pieces), unk_token=unknown, fuse_unk=True,
            byte_fallback=model.byte_fallback))
    else:
        raise ValueError(f"models of kind {model.kind} are not supported")
    steps = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.remove_extra_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.escape_spaces else " "))
    if model.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    # No piece holds a mark after another character, so no piece spans the place before a mark, and
    # each word can be merged, and remembered, by itself.
    if not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in model.pieces if kind == NORMAL):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    tokenizer.decoder = decoders.Sequence([
        decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else [])])
    special = [AddedToken(p, normalized=False, special=True) for p, _, kind in model.pieces if kind == USER_DEFINED]
    if special:
        tokenizer.add_tokens(special)
    return tokenizer


class Codec:
    """Encodes and decodes whole texts and compares every encoding with the SentencePiece library.

    Words are encoded once: where the vocabulary allows (see ``build``), the ids of a text are those of
    its words with a mark in front, so new words are encoded many at a time and remembered. Texts
    with runs of spaces or marks of their own are encoded whole.
    """

    REMEMBERED = 400_000

    def __init__(self, path: str, threads: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        import sentencepiece

        with open(path, "rb") as f:
            raw = f.read()
        self.model = SentencePieceModel.parse(raw)
        self.tokenizer = build(self.model)
        self.tokenizer.encode_special_tokens = True
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.threads = threads
        self.begins = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])
        self.by_word = (self.tokenizer.pre_tokenizer is not None and self.model.dummy_prefix and self.model.escape_spaces
                        and not self.model.charsmap)
        self.known: dict[str, bytes] = {}
        self.differ: set[str] = set()

    def _whole(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        ours = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return ours, self.reference.encode(texts, num_threads=self.threads)

    def _learn(self, words: list[str]) -> None:
        groups = [words[at:at + 512] for at in range(0, len(words), 512)]
        ours, theirs = self._whole([" ".join(g) for g in groups])
        for group, a, b in zip(groups, ours, theirs):
            ids, other = np.array(a, "<u4"), np.array(b, "<u4")
            begin = np.flatnonzero(self.begins[ids])
            if len(begin) == len(group) and np.array_equal(ids, other):
                raw, edges = ids.tobytes(), (np.append(begin, len(ids)) * 4).tolist()
                self.known.update((w, raw[p:q]) for w, p, q in zip(group, edges, edges[1:]))
                continue
            for word, x, y in zip(group, *self._whole(group)):
                self.known[word] = np.array(x, "<u4").tobytes()
                if x != y:
                    self.differ.add(word)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """(little-endian unsigned 32-bit ids, whether the SentencePiece library gives the same) of each text."""
        split = [t.split(" ") if self.by_word and t and MARK not in t and not re.search(r"\A | {2}| \Z", t) else None for t in texts]
        hard = [t for t, s in zip(texts, split) if s is None]
        if len(self.known) > self.REMEMBERED:
            self.known.clear()
            self.differ.clear()
        new = {w for s in split if s for w in s}.difference(self.known)
        if new:
            self._learn(list(new))
        whole = iter([(np.array(a, "<u4").tobytes(), a == b) for a, b in zip(*self._whole(hard))] if hard else [])
        get = self.known.__getitem__
        return [next(whole) if s is None else (b"".join(map(get, s)), not self.differ or self.differ.isdisjoint(s)) for s in split]

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.tokenizer.decode_batch([np.frombuffer(i, "<u4").tolist() for i in ids], skip_special_tokens=False)


_codecs: dict[tuple[str, int], Codec] = {}


def _codec(path: str, threads: int) -> Codec:
    return _codecs.get((path, threads)) or _codecs.setdefault((path, threads), Codec(path, threads))


def _groups(texts: list) -> Iterator[slice]:
    """Slices of bounded numbers of texts and characters."""
    start = chars = 0
    for at, t in enumerate(texts):
        if at > start and (at - start >= BATCH_TEXTS or chars + len(t) > BATCH_CHARS):
            yield slice(start, at)
            start, chars = at, 0
        chars += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def encode_texts(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", threads: int = 2) -> DataFrame:
    """``key``, ids (little-endian unsigned 32-bit) and parity of every whole text.

    The model file is parsed in each Python worker and rebuilt for the tokenizers library, which
    encodes batches on ``threads`` threads; ``parity`` says that the SentencePiece library gives the same ids.
    A null text is empty and has no ids; repeated rows are encoded each; other columns are
    ignored; an empty table gives no rows.
    """
    return _mapped(docs, model, key, text, threads, "ids binary, parity boolean", lambda codec, texts: codec.encode(texts))


def decode_ids(encoded: DataFrame, model: str, key: str = "doc_id", ids: str = "ids", threads: int = 2) -> DataFrame:
    """``key`` and the text that the ids stand for; null ids are an empty text."""
    return _mapped(encoded, model, key, ids, threads, "text string", lambda codec, raw: [(t,) for t in codec.decode(raw)])


def round_trips(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", threads: int = 2) -> DataFrame:
    """As ``encode_texts``, with ``decoded``: the text that the ids decode to."""

    def both(codec: Codec, texts: list[str]) -> list[tuple]:
        encoded = codec.encode(texts)
        return [(i, p, t) for (i, p), t in zip(encoded, codec.decode([i for i, _ in encoded]))]

    return _mapped(docs, model, key, text, threads, "ids binary, parity boolean, decoded string", both)


def _mapped(df: DataFrame, model: str, key: str, column: str, threads: int, fields: str, work) -> DataFrame:
    schema = T.StructType([T.StructField(key, df.schema[key].dataType)] + T._parse_datatype_string(fields).fields)
    empty = b"" if df.schema[column].dataType == T.BinaryType() else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, target = _codec(model, threads), arrow_schema(schema)
        for batch in batches:
            keys = batch.column(0)
            values = [v or empty for v in batch.column(1).to_pylist()]
            for part in _groups(values):
                found = work(codec, values[part])
                arrays = [pa.array(list(c), type=f.type) for c, f in zip(zip(*found), list(target)[1:])]
                yield pa.RecordBatch.from_arrays([keys[part], *arrays], schema=target)

    return df.select(key, column).mapInArrow(run, schema)
