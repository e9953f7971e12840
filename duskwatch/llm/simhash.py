"""SimHash near-duplicates: exact comparison of fingerprints in tiles."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.llm.common import WORD, frozen, map_rows
from duskwatch.llm.components import components

SEED = 42
#: Most fingerprints of one side of a tile pair; larger cells are cut into tiles.
TILE = 32768
#: Pairs that are compared at once.
BLOCK = 1 << 20
#: Shingles of one side, about, that a task which checks links has at a time.
SHINGLES = 1 << 22
_WORD = re.compile(WORD)
_LOWER = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
_CHUNK = 1 << 14


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every shingle of ``size`` words, repeats included; all words where there are fewer."""
    words = _WORD.findall((text or "").translate(_LOWER))
    if not words:
        return np.empty(0, np.uint64)
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    joined = b" ".join(raw)
    if len(raw) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[: len(raw) - size + 1].tolist(), ends[size - 1:].tolist())),
        np.uint64, len(raw) - size + 1)


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> list[int]:
    """One signed 64-bit word per lane; a bit is set if it is set in over half the hashes.

    Lane 0 takes the hashes themselves, further lanes take them mixed with another constant each.
    """
    out = []
    for lane in range(lanes):
        counts = np.zeros(64, np.int64)
        for at in range(0, len(hashes), _CHUNK):
            part = hashes[at:at + _CHUNK]
            if lane:
                with np.errstate(over="ignore"):
                    part = (part ^ (part >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * lane)
                    part = (part ^ (part >> np.uint64(32))) * np.uint64(0x94D049BB133111EB + 2 * lane)
                    part ^= part >> np.uint64(31)
            bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.int64)
        word = np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0]
        out.append(int(word.astype(np.int64)))
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, lanes: int = 1,
                 distinct: bool = False) -> DataFrame:
    """``key``, ``row_hash`` (of key and text), ``n_shingles`` and ``fp``, an array of ``lanes`` longs, for every text.

    With ``distinct``, repeats of a shingle neither count nor vote.
    """
    kind = docs.schema[key].dataType.simpleString()

    def row(k, h, t):
        hashes = shingle_hashes(t, size)
        if distinct:
            hashes = np.unique(hashes)
        return k, h, len(hashes), fingerprint(hashes, lanes)

    return map_rows(docs, [key, F.xxhash64(key, text).alias("row_hash"), text],
                    f"`{key}` {kind}, row_hash long, n_shingles long, fp array<long>", row)


class Forest:
    """Union-find that keeps the links which joined two trees.

    With ``sure``, links up to that distance are taken as they come and farther ones wait until the
    end, nearest first, so that trees grow along the nearest links. With ``check``, which tells
    of one row and others which of these it is really linked to, no other link joins anything.
    """

    def __init__(self, n: int, sure: int | None = None, check: Callable[[int, np.ndarray], np.ndarray] | None = None):
        self.parent = np.arange(n)
        self.edges: list[tuple[int, int]] = []
        self.sure = sure
        self.check = check
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return self.parent
            self.parent = up

    def add(self, a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> None:
        if self.sure is not None:
            far = distance > self.sure
            if far.any():
                self.waiting.append((a[far], b[far], distance[far]))
            a, b = a[~far], b[~far]
        (self._join_checked if self.check else self._join)(a, b)

    def finish(self) -> None:
        if self.waiting:
            a, b, distance = map(np.concatenate, zip(*self.waiting))
            order = np.argsort(distance, kind="stable")
            self.waiting = []
            (self._join_checked if self.check else self._join)(a[order], b[order])

    def _join_checked(self, a: np.ndarray, b: np.ndarray) -> None:
        roots = self.roots()
        apart = roots[a] != roots[b]
        a, b = a[apart], b[apart]
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        for others in np.split(np.arange(len(a)), np.flatnonzero(np.diff(a)) + 1):
            if len(others):
                x, ys = int(a[others[0]]), b[others]
                roots = self.roots()
                ys = ys[roots[ys] != roots[x]]
                if len(ys):
                    ys = ys[self.check(x, ys)]
                    self._join(np.full(len(ys), x), ys)

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        roots = self.roots()
        apart = roots[a] != roots[b]
        parent = self.parent
        for x, y in zip(a[apart].tolist(), b[apart].tolist()):
            rx, ry = x, y
            while parent[rx] != rx:
                parent[rx] = rx = parent[parent[rx]]
            while parent[ry] != ry:
                parent[ry] = ry = parent[parent[ry]]
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
                self.edges.append((x, y))


class Marks:
    """Takes links like ``Forest`` and notes only which rows have any."""

    def __init__(self, n: int):
        self.linked = np.zeros(n, bool)

    def add(self, a: np.ndarray, b: np.ndarray, distance: np.ndarray) -> None:
        self.linked[a] = self.linked[b] = True


class Sets:
    """Sets of shingles, one a row, that are compared exactly."""

    def __init__(self, sets: pa.ListArray, least: float):
        self.sizes = np.asarray(pc.fill_null(pc.list_value_length(sets), 0)).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        found, self.ids = np.unique(sets.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        self.member = np.zeros(len(found), bool)
        self.least = least

    def check(self, x: int, ys: np.ndarray) -> np.ndarray:
        """Whether each of ``ys`` has a Jaccard similarity of ``least`` or more to ``x``."""
        own = self.ids[self.starts[x]:self.starts[x] + self.sizes[x]]
        self.member[own] = True
        sizes = self.sizes[ys]
        ends = np.cumsum(sizes)
        shared = np.empty(len(ys), np.int64)
        at = 0
        while at < len(ys):
            before = ends[at] - sizes[at]
            to = max(at + 1, int(np.searchsorted(ends, before + BLOCK, "right")))
            places = np.arange(ends[to - 1] - before) + np.repeat(self.starts[ys[at:to]] - (ends[at:to] - sizes[at:to] - before), sizes[at:to])
            hits = np.concatenate([[0], np.cumsum(self.member[self.ids[places]])])
            shared[at:to] = hits[ends[at:to] - before] - hits[ends[at:to] - sizes[at:to] - before]
            at = to
        self.member[own] = False
        union = sizes + len(own) - shared
        return (union == 0) | (shared / np.maximum(union, 1) >= self.least)


def _popcounts(fps: np.ndarray, parts: int) -> np.ndarray:
    """Set bits in each of ``parts`` equal pieces of the first lane."""
    counts = np.bitwise_count(fps[:, :1].astype("<u8").view(np.uint8)).astype(np.int16)
    return counts.reshape(len(fps), parts, -1).sum(axis=2, dtype=np.int16)


def _direct(fps, sizes, a, b, radius, first_radius, ratio, forest) -> None:
    step = max(1, BLOCK // max(1, len(b)))
    for at in range(0, len(a), step):
        rows = a[at:at + step]
        apart = np.bitwise_count(fps[rows, 0][:, None] ^ fps[b, 0][None, :])
        i, j = np.nonzero(apart <= first_radius)
        if a is b:  # each pair once
            i, j = i[rows[i] < b[j]], j[rows[i] < b[j]]
        distance = apart[i, j].astype(np.int32)
        i, j = rows[i], b[j]
        if fps.shape[1] > 1 and len(i):
            distance = np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1, dtype=np.int32)
        near = distance <= radius
        if ratio:
            near &= np.minimum(sizes[i], sizes[j]) >= ratio * np.maximum(sizes[i], sizes[j])
        if near.any():
            forest.add(i[near], j[near], distance[near])


def link_tiles(fps, sizes, a, b, radius, first_radius, ratio, forest, parts: int = 2) -> None:
    """Union all rows of ``a`` and ``b`` (index arrays) whose fingerprints are near.

    Large tiles are cut by the bit counts of ever smaller pieces of the word. The sum of the
    differences of these counts never exceeds the distance of two words, so pairs of tiles
    that differ by more than the radius are skipped without being compared.
    """
    if len(a) * len(b) <= BLOCK or parts > 8:
        _direct(fps, sizes, a, b, radius, first_radius, ratio, forest)
        return
    sides = []
    for side in (a,) if a is b else (a, b):
        counts, inverse = np.unique(_popcounts(fps[side], parts), axis=0, return_inverse=True)
        inverse = inverse.ravel()
        order = np.argsort(inverse, kind="stable")
        sides.append((counts, np.split(side[order], np.flatnonzero(np.diff(inverse[order])) + 1)))
    (ca, ta), (cb, tb) = sides[0], sides[-1]
    if np.abs(cb.max(axis=0) - ca.min(axis=0)).max() + np.abs(ca.max(axis=0) - cb.min(axis=0)).max() <= first_radius:
        _direct(fps, sizes, a, b, radius, first_radius, ratio, forest)  # all are within the radius by their counts
        return
    for k, tile in enumerate(ta):
        near = np.flatnonzero(np.abs(cb - ca[k]).sum(axis=1) <= first_radius)
        for m in near[near >= k] if a is b else near:
            link_tiles(fps, sizes, tile, tb[m], radius, first_radius, ratio, forest, parts * 2)


def _tile_pairs(fps: DataFrame, first_radius: int, ratio: float | None) -> DataFrame:
    """pair, side, node, fp and n_shingles: the rows that each comparison of two tiles needs.

    Cells are the bit counts of both halves of the first lane in steps of the radius, and with
    ``ratio`` the size on a logarithmic scale: rows that are near have equal or adjoining cells.
    Cells are cut into tiles of bounded size, and every pair of tiles in adjoining cells is a pair
    here. Side 0 is a tile with itself, sides 1 and 2 are two tiles.
    """
    width = first_radius + 1
    low = F.bit_count(F.col("fp")[0].bitwiseAND(F.lit(0xFFFFFFFF)))
    high = F.bit_count(F.shiftrightunsigned(F.col("fp")[0], 32))
    band = F.floor(F.log(F.greatest(F.col("n_shingles"), F.lit(1)).cast("double")) / -math.log(ratio)) if ratio else F.lit(0)
    celled = fps.select(
        "node", "fp", "n_shingles", F.floor(low / width).cast("int").alias("x"),
        F.floor(high / width).cast("int").alias("y"), band.cast("int").alias("z"))
    cells = celled.groupBy("x", "y", "z").agg(F.ceil(F.count("*") / TILE).cast("int").alias("k"))
    steps = F.array(*(
        F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(dz).alias("dz"))
        for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1)
        if (dz, dx, dy) >= (0, 0, 0) and (ratio or not dz)))
    near = cells.select("x", "y", "z", "k", F.explode(steps).alias("s")).select(
        "x", "y", "z", "k", (F.col("x") + F.col("s.dx")).alias("x2"), (F.col("y") + F.col("s.dy")).alias("y2"),
        (F.col("z") + F.col("s.dz")).alias("z2"))
    other = cells.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("z").alias("z2"), F.col("k").alias("k2"))
    same = (F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2")) & (F.col("z") == F.col("z2"))
    pairs = (
        near.join(other, ["x2", "y2", "z2"])
        .withColumn("t", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .withColumn("t2", F.explode(F.sequence(F.lit(0), F.col("k2") - 1)))
        .where(~same | (F.col("t") <= F.col("t2")))
        .withColumn("pair", F.xxhash64("x", "y", "z", "t", "x2", "y2", "z2", "t2")))

    def end(x: str, y: str, z: str, t: str, side: int):
        return F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col(z).alias("z"), F.col(t).alias("t"), F.lit(side).alias("side"))

    ends = F.when(same & (F.col("t") == F.col("t2")), F.array(end("x", "y", "z", "t", 0))).otherwise(
        F.array(end("x", "y", "z", "t", 1), end("x2", "y2", "z2", "t2", 2)))
    sides = pairs.select("pair", F.explode(ends).alias("e")).select("pair", "e.*")
    tiled = celled.join(F.broadcast(cells), ["x", "y", "z"]).withColumn(  # at most 33 x 33 cells for each size
        "t", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    return tiled.join(sides, ["x", "y", "z", "t"]).select("pair", "side", "node", "fp", "n_shingles")


def _side(group: pa.Table) -> tuple[np.ndarray, ...]:
    """Fingerprints, sizes, nodes and the row numbers of both sides."""
    side = group.column("side").to_numpy()
    words = group.column("fp").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    words = np.ascontiguousarray(words, dtype=np.int64).view(np.uint64).reshape(len(side), -1)
    every = np.arange(len(side))
    a, b = (every, every) if not side.max() else (every[side == 1], every[side == 2])
    return words, group.column("n_shingles").to_numpy(), group.column("node").to_numpy(), a, b


def _edges(forest: Forest, nodes: np.ndarray) -> pa.Table:
    u, v = zip(*forest.edges) if forest.edges else ((), ())
    return pa.table({"u": pa.array(nodes[list(u)], pa.int64()), "v": pa.array(nodes[list(v)], pa.int64())})


def near_links(fps: DataFrame, radius: int, first_radius: int | None = None) -> DataFrame:
    """Links between distinct fingerprints at most ``radius`` bits apart: as few as keep them connected.

    ``fps`` has distinct rows of ``node`` (long), ``fp`` and ``n_shingles``. With several lanes, two
    fingerprints are near if their first lanes differ in at most ``first_radius`` bits and all
    lanes together in at most ``radius``. Every pair of tiles is compared in one task, which returns
    a spanning forest of its links rather than all pairs.
    """
    first_radius = radius if first_radius is None else first_radius

    def compare(group: pa.Table) -> pa.Table:
        words, sizes, nodes, a, b = _side(group)
        forest = Forest(len(nodes))
        link_tiles(words, sizes, a, b, radius, first_radius, None, forest)
        return _edges(forest, nodes)

    return _tile_pairs(fps, first_radius, None).groupBy("pair").applyInArrow(compare, "u long, v long")


def similar_links(nodes: DataFrame, docs: DataFrame, key: str, text: str, size: int, radius: int, first_radius: int,
                  least: float) -> DataFrame:
    """Links between texts with a Jaccard similarity of ``least`` or more: as few as keep them connected.

    ``n_shingles`` counts distinct shingles. Candidates are near as in ``near_links``, and the smaller has the share
    ``least`` of the larger one's shingles, without which no pair is so similar. A first pass over the tiles finds which rows have any candidate. Only these rows and their shingle sets come
    to a second pass, in parts of about ``SHINGLES`` shingles, each with every other part of its
    pair of tiles; there every candidate whose ends are not yet joined is decided by the exact similarity of the
    sets, over distinct shingles, before it joins anything.
    """

    def mark(group: pa.Table) -> pa.Table:
        words, sizes, _, a, b = _side(group)
        marks = Marks(len(words))
        link_tiles(words, sizes, a, b, radius, first_radius, least, marks)
        return group.filter(pa.array(marks.linked))

    sent = _tile_pairs(nodes, first_radius, least)
    marked = frozen(sent.groupBy("pair").applyInArrow(mark, sent.schema).drop("fp"))
    ends = marked.select("node").distinct().join(nodes.select("node", F.col("least.row_hash").alias("_row_hash")), "node")
    texts = docs.select(F.xxhash64(key, text).alias("_row_hash"), F.col(text).alias("_text")).join(ends, "_row_hash")
    sets = map_rows(texts, ["node", "_text"], "node long, shingles array<long>",
                    lambda n, t: (n, np.unique(shingle_hashes(t, size)).view(np.int64).tolist()))
    sets = sets.groupBy("node").agg(F.first("shingles").alias("shingles")).join(nodes.select("node", "fp"), "node")

    parts = marked.groupBy("pair").agg(*(
        F.ceil(F.greatest(F.sum(F.when(F.col("side") == n, F.col("n_shingles"))), F.lit(1)) / SHINGLES).cast("int").alias(f"m{n}")
        for n in range(3)))
    part = F.pmod(F.xxhash64(F.lit("part"), "node"), F.when(F.col("side") == 0, F.col("m0")).when(F.col("side") == 1, F.col("m1")).otherwise(F.col("m2"))).cast("int")

    def meets(i, j, side):
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))

    p = F.col("_part")
    tasks = (
        F.when(F.col("side") == 0, F.transform(F.sequence(F.lit(0), F.col("m0") - 1), lambda q: meets(
            F.least(p, q), F.greatest(p, q), F.when(p == q, 0).when(p < q, 1).otherwise(2))))
        .when(F.col("side") == 1, F.transform(F.sequence(F.lit(0), F.col("m2") - 1), lambda q: meets(p, q, F.lit(1))))
        .otherwise(F.transform(F.sequence(F.lit(0), F.col("m1") - 1), lambda q: meets(q, p, F.lit(2)))))
    dealt = marked.join(parts, "pair").withColumn("_part", part).select("pair", "node", "n_shingles", F.explode(tasks).alias("e"))
    dealt = dealt.select("pair", "e.*", "node", "n_shingles").join(sets, "node")

    def decide(group: pa.Table) -> pa.Table:
        words, sizes, found, a, b = _side(group)
        forest = Forest(len(found), check=Sets(group.column("shingles").combine_chunks(), least).check)
        link_tiles(words, sizes, a, b, radius, first_radius, least, forest)
        return _edges(forest, found)

    return dealt.groupBy("pair", "i", "j").applyInArrow(decide, "u long, v long")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, lanes: int = 1, radius: int = 3,
                first_radius: int | None = None, similarity: float | None = None) -> DataFrame:
    """The near-duplicate group of every row.

    A-Z are lower-cased; shingles of ``size`` words, repeats included (each once with ``similarity``), vote for
    the bits of a fingerprint of 64 ``lanes`` bits. Equal fingerprints collapse first, whatever their number, and
    distinct ones are compared in tiles (``near_links``); groups are connected components. With
    ``similarity``, near fingerprints are linked if the shingle sets have that Jaccard similarity.

    Columns: key, row_hash, fp, least: the smallest (key, row_hash) of the group, with null keys last.
    Null texts and texts without words have fingerprint zero and are linked like others. Rows
    with a null key take part; repeated rows are one group; other columns are ignored.
    """
    rows = frozen(fingerprints(docs, key, text, size, lanes, similarity is not None).withColumn(
        "node", F.xxhash64("fp", "n_shingles") if similarity else F.col("fp")[0]))
    ordered = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("row_hash").alias("row_hash"))
    nodes = frozen(rows.groupBy("node").agg(
        F.first("fp").alias("fp"), F.first("n_shingles").alias("n_shingles"), F.min(ordered).alias("least")))
    links = (similar_links(nodes, docs, key, text, size, radius, first_radius, similarity) if similarity
             else near_links(nodes, radius, first_radius))
    roots = components(links)
    linked = roots.join(nodes.select("node", "least"), "node")
    smallest = linked.groupBy("root").agg(F.min("least").alias("smallest"))
    joined = linked.join(smallest, "root").select("node", "smallest")
    groups = nodes.select("node", "least").join(joined, "node", "left").select(
        "node", F.coalesce("smallest", "least").alias("least"))
    return rows.join(groups, "node").select(key, "row_hash", "fp", F.struct("least.key", "least.row_hash").alias("least"))


def bits_for(similarity: float, bits: int) -> int:
    """Expected differing bits of two equally large shingle sets of that Jaccard similarity."""
    return round(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


#: For whole-text near-duplicates: lanes of 64 bits, how far above the expected distance of a pair at
#: the limit a link is still looked at (its standard deviation is 8 bits), and the bits that the first
#: lanes of such a pair may differ in (expected 10, standard deviation 3).
WIDE_LANES, WIDE_SLACK, FIRST_RADIUS = 8, 24, 21


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, columns unchanged, with one row kept of each near-duplicate group.

    Fingerprints of 512 bits over 5-word shingles propose links, which are checked by the exact
    Jaccard similarity of the shingle sets; of each group the row with the smallest key stays, of repeated rows the one
    whose other columns come first as JSON. A pair at the limit is proposed with probability 1.00 from 10 shingles on and 0.77 at four
    against five (measured); callers with texts of under ten words should not rely on it for them.
    """
    radius = bits_for(similarity, 64 * WIDE_LANES) + WIDE_SLACK
    groups = near_groups(docs, key, text, size, WIDE_LANES, radius, FIRST_RADIUS, similarity)
    hashed, nth = _free("_row_hash", docs), _free("_nth", docs)
    kept = groups.select(F.col("least.row_hash").alias(hashed)).distinct()
    # Of rows with one key and text the other columns decide, so that a task that runs again keeps the same row.
    others = F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in (key, text)), F.lit(0).alias(nth)))
    once = Window.partitionBy(hashed).orderBy(others)
    single = docs.withColumn(hashed, F.xxhash64(key, text)).withColumn(nth, F.row_number().over(once)).where(F.col(nth) == 1)
    return single.join(kept, hashed, "left_semi").select(*(docs[f"`{c}`"] for c in docs.columns))


def _free(name: str, df: DataFrame) -> str:
    """``name``, or with more lines before it where ``df`` has such a column."""
    while name in df.columns:
        name = f"_{name}"
    return name
