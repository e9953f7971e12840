"""Phrase collocations from count streams in prefix and in suffix order."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.llm.common import frozen, written

#: What ends a piece; no word holds one of these, so a lone full stop can mark an end.
ENDS = b".,;:!?\n\x0b\x0c\r"
#: Bits of the filter of frequent phrases. Its size is fixed, so it can go to every task; a phrase
#: that it lets through by chance is counted and then dropped.
FILTER_BITS = 1 << 26
#: Bytes of text of one language, and of all, that a task counts before it hands its counts on.
BLOCK_BYTES, HELD_BYTES = 4 << 20, 8 << 20
#: Parts into which the candidates of a language are dealt to find the best of each first.
SALTS = 64
_SEED = 42

_lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + ENDS + b"\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * len(ENDS) + b" ")
_SCHEMA = "lang string, phrase string, f long"


def _tokens(text: bytes) -> list[bytes]:
    """Lower-cased words, a full stop between pieces."""
    return text.translate(_lower).replace(b"\n", b" . ").split()


class Filter:
    """Which phrases of a language may be frequent; it never denies one that is."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, len(bits) * 64 - 1

    @staticmethod
    def of(frequent: DataFrame) -> Filter:
        """From a table of (lang, phrase); at most ``FILTER_BITS`` / 64 rows come to the driver."""
        place = F.xxhash64("lang", "phrase").bitwiseAND(F.lit(FILTER_BITS - 1))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
        found = frequent.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
        bits = np.zeros(FILTER_BITS // 64, np.uint64)
        bits[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
        return Filter(bits)

    @staticmethod
    def seed(lang: str) -> int:
        return xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), _SEED)

    def has(self, phrase: bytes, seed: int) -> bool:
        place = xxhash.xxh64_intdigest(phrase, seed) & self.mask
        return bool(int(self.bits[place >> 6]) >> (place & 63) & 1)


class _Ids(dict):
    """Numbers from 1 for words that may be frequent, 0 for others and for ends of pieces."""

    def __init__(self, known: Filter, seed: int):
        super().__init__({b".": 0})
        self.known, self.seed = known, seed
        self.words: list[bytes] = [b""]

    def __missing__(self, word: bytes) -> int:
        number = 0
        if self.known.has(word, self.seed):
            number = len(self.words)
            self.words.append(word)
        self[word] = number
        return number


def _batch(lang: str, phrases: pa.Array, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(phrases), pa.string()), phrases.view(pa.string()), pa.array(counts, pa.int64())], names=["lang", "phrase", "f"])


def _counted_words(lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()
    for t in texts:
        found.update(_tokens(t))
    found.pop(b".", None)
    yield _batch(lang, pa.array(list(found), pa.binary()), list(found.values()))


def _counted_phrases(lang: str, texts: list[bytes], filters: list[Broadcast], longest: int) -> Iterator[pa.RecordBatch]:
    """Counts of phrases one word longer than those of the last filter, up to ``longest`` words.

    Only places count whose shorter phrases, down to single words, may all be frequent.
    """
    seed = Filter.seed(lang)
    ids = _Ids(filters[0].value, seed)
    numbers = np.concatenate([np.array([*map(ids.__getitem__, _tokens(t)), 0], np.int64) for t in texts])
    words = pa.array(ids.words, pa.binary())
    # rank[i]: number of the phrase of `size` words that begins at i, -1 where there is none to count
    rank, phrases = np.where(numbers > 0, numbers, -1), words
    for size in range(2, longest + 1):
        ahead = np.append(rank[1:], -1)
        last = np.concatenate([numbers[size - 1:], np.zeros(size - 1, np.int64)])[:len(numbers)]
        at = np.flatnonzero((rank >= 0) & (ahead >= 0))
        keys, place, counts = np.unique(rank[at] << 32 | last[at], return_inverse=True, return_counts=True)
        phrases = pc.binary_join_element_wise(phrases.take(pa.array(keys >> 32)), words.take(pa.array(keys & 0xFFFFFFFF)), b" ")
        good = np.ones(len(keys), bool)
        if size <= len(filters):
            has = filters[size - 1].value.has
            good = np.fromiter((has(p, seed) for p in phrases.to_pylist()), bool, len(keys))
        else:
            for some in range(0, len(keys), 1 << 16):
                yield _batch(lang, phrases.slice(some, 1 << 16), counts[some:some + (1 << 16)])
        rank = np.full(len(numbers), -1, np.int64)
        rank[at] = np.where(good, np.arange(len(keys)), -1)[place]


def _count(docs: DataFrame, text: str, lang: str, count) -> DataFrame:
    """(lang, phrase, f): ``count(lang, texts)`` over blocks of the texts of one language, added up."""
    block, most_held = BLOCK_BYTES, HELD_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = defaultdict(list)
        size: dict[str, int] = defaultdict(int)
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                held[name].append(t.as_py())
                size[name] += t.as_buffer().size + 1
                if size[name] >= block or sum(size.values()) >= most_held:
                    most = max(size, key=size.get)
                    size.pop(most)
                    yield from count(most, held.pop(most))
        for name, texts in held.items():
            yield from count(name, texts)

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")), F.col(text).cast("binary")).where(F.col(text).isNotNull())
    return rows.mapInArrow(run, _SCHEMA).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def phrase_counts(docs: DataFrame, least: int, longest: int, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """All phrases of one to ``longest`` words that occur ``least`` times, and the words of each language.

    A phrase that occurs so often has only parts that do, so words are counted first, then pairs of
    frequent words, then longer phrases whose pairs are frequent. Each task adds up what it has before
    the shuffle; final counts are exact.
    """
    words = written(_count(docs, text, lang, _counted_words), "words")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    spark = docs.sparkSession
    streams, filters = [words.where(F.col("f") >= least)], []
    for size in (2, 3):
        if size <= longest:
            filters.append(spark.sparkContext.broadcast(Filter.of(streams[-1])))
            to = 2 if size == 2 else longest
            counted = _count(docs, text, lang, lambda name, texts, f=tuple(filters), to=to: _counted_phrases(name, texts, list(f), to))
            streams.append(written(counted.where(F.col("f") >= least), "phrases"))
    whole = streams[0]
    for s in streams[1:]:
        whole = whole.unionByName(s)
    return whole, totals


def _lockstep(counts: DataFrame, suffix: bool) -> DataFrame:
    """Counts of all shorter beginnings of each phrase, and the largest count of it with one more word behind.

    With ``suffix`` words are read from the last to the first, so these are endings and words in front.
    The stream is sorted by words, so a phrase follows its beginnings, and one pass with a stack
    of at most as many phrases as one has words sees both. Ranges are cut anywhere, also inside the block
    of a very common first word; the beginnings of the first phrase of a range, a few rows a range,
    are looked up and put on its stack.

    Columns: lang, phrase, f, heads (shortest first), more.
    """
    spark = counts.sparkSession
    key = F.split("phrase", " ", -1)
    key = F.reverse(key) if suffix else key
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stream = frozen(
        counts.select("lang", key.alias("key"), "f").repartitionByRange(n, "lang", "key").sortWithinPartitions("lang", "key")
        .withColumn("part", F.spark_partition_id()))
    firsts = stream.groupBy("part").agg(F.min(F.struct("lang", "key")).alias("first"))
    heads = firsts.where(F.size("first.key") > 1).select("part", "first.lang", F.explode(F.transform(
        F.sequence(F.lit(1), F.size("first.key") - 1), lambda i: F.slice("first.key", 1, i))).alias("key"))
    # At most as many rows as ranges times words of a phrase.
    found = stream.select("lang", "key", "f").join(F.broadcast(heads), ["lang", "key"]).collect()
    open_at: dict[int, list] = defaultdict(list)
    for r in sorted(found, key=lambda r: len(r["key"])):
        open_at[r["part"]].append((tuple(r["key"]), r["f"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[list] = []  # phrase, count, counts of its beginnings, largest count behind it
        lang, rows, started = None, [], False

        def close(upto: int) -> None:
            while len(stack) > upto:
                k, f, before, more = stack.pop()
                rows.append((lang, " ".join(reversed(k) if suffix else k), f, before, more))

        for batch in batches:
            for name, k, f, part in zip(*(c.to_pylist() for c in batch.columns)):
                if not started:
                    lang, started = name, True
                    for head, count in open_at.get(part, ()):
                        if stack:
                            stack[-1][3] = max(stack[-1][3], count)
                        stack.append([head, count, [s[1] for s in stack], 0])
                k = tuple(k)
                if name != lang:
                    close(0)
                    lang = name
                upto = 0
                while upto < len(stack) and k[:upto + 1] == stack[upto][0]:
                    upto += 1
                close(upto)
                if stack:
                    stack[-1][3] = max(stack[-1][3], f)
                stack.append([k, f, [s[1] for s in stack], 0])
            if rows:
                yield _out(rows)
                rows.clear()
        close(0)
        if rows:
            yield _out(rows)

    side = stream.select("lang", "key", "f", "part").mapInArrow(run, "lang string, phrase string, f long, heads array<long>, more long")
    return side.groupBy("lang", "phrase").agg(F.max("f").alias("f"), F.max("heads").alias("heads"), F.max("more").alias("more"))


def _out(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["lang", "phrase", "f", "heads", "more"])


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, best: int = 2000, covered: int = 80,
                 text: str = "text", lang: str = "lang") -> DataFrame:
    """The ``best`` phrases of each language by how much more often their words stand together than apart.

    A phrase of 2 to ``longest`` words that occurs a >= ``least`` times is cut after each of its words;
    with l and r the counts of the two parts, the cut scores floor(2000000 a / (l + r)). The cut with the
    lowest score counts, of equal ones the first. A phrase inside a longer one that has at least
    ``covered`` percent of its occurrences is left out.

    l comes from the stream in prefix order, r from the one in suffix order, and both give the largest count
    with one more word on their side; a longer phrase with so many occurrences has a part with just one more word that
    has as many, so this decides about all longer ones. Both results are merged in their order.

    Columns: lang, rank (from 1), phrase, a, l, r, n (words of the language), score. Order: score and a
    descending, then bytes of the phrase. A null text is empty, a null language ``und``; repeated rows count each;
    other columns are ignored; an empty table gives no rows.
    """
    counts, totals = phrase_counts(docs, least, longest, text, lang)
    lefts = _lockstep(counts, suffix=False).where(F.size("heads") > 0)
    rights = _lockstep(counts, suffix=True).where(F.size("heads") > 0).select(
        "lang", "phrase", F.col("heads").alias("tails"), F.col("more").alias("more_left"))
    both = lefts.join(rights.hint("merge"), ["lang", "phrase"])
    big = "decimal(20,0)"
    score = F.expr(f"transform(sequence(1, size(heads)), k -> named_struct('score', (cast(f as {big}) * 2000000) div "
                   f"(cast(heads[k - 1] as {big}) + cast(tails[size(heads) - k] as {big})), 'k', k, 'l', heads[k - 1], 'r', tails[size(heads) - k]))")
    kept = both.where(F.expr(f"cast(greatest(more, more_left) as {big}) * 100 < cast(f as {big}) * {covered}")).select(
        "lang", "phrase", F.col("f").alias("a"), F.array_min(score).alias("cut"))
    scored = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", (F.abs(F.xxhash64("phrase")) % SALTS).alias("_salt"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    some = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("rank") <= best)
    first = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
