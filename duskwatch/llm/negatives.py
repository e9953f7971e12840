"""Hard negatives by score bounds along a spanning tree of anchors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.llm.common import frozen, positions
from duskwatch.llm.neighbours import hilbert_keys

#: Anchors of a tree.
TREE = 4096
#: Rows of a block of candidates: one of ``MOST_BLOCKS``, but not under ``BLOCK`` rows nor over ``BLOCK_NUMBERS`` components.
BLOCK, MOST_BLOCKS, BLOCK_NUMBERS = 4096, 2048, 1 << 22
#: Bounds that a task holds at a time.
HELD = 1 << 22
#: Copies of a result row that the anchors with one vector are dealt to.
SALTS = 16
_AXES, _BITS, _SEED = 8, 7, 5
#: Squared length from which scores might not fit a long.
_LONGEST = float(1 << 62)


def _matrix(column, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least spanning tree of the rows: their order, each one's parent as a place in that order (-1 for the
    first) and the distance to it, rounded up. Prim's way, one row of distances at a time."""
    x = x.astype(float)
    square = (x * x).sum(axis=1)
    near = np.full(len(x), np.inf)
    parent = np.full(len(x), -1)
    left = np.ones(len(x), bool)
    order, parents, edges = [], [], []
    at = 0
    for step in range(len(x)):
        left[at] = False
        order.append(at)
        parents.append(parent[at])
        edges.append(0.0 if step == 0 else math.sqrt(max(near[at], 0.0)))
        away = square + square[at] - 2 * (x @ x[at])
        closer = left & (away < near)
        near[closer], parent[closer] = away[closer], step
        at = int(np.argmin(np.where(left, near, np.inf)))
    # What rounding may have hidden in a difference of large squares.
    slack = math.sqrt(float(square.max(initial=0.0)) * 1e-13)
    return np.array(order), np.array(parents), np.array(edges) * (1 + 1e-9) + slack


class Tile:
    """Bounds and exact scores of some candidates for all anchors of a tree, parents first."""

    def __init__(self, anchors: np.ndarray, parents: np.ndarray, edges: np.ndarray):
        self.anchors, self.parents, self.edges = anchors, parents, edges
        self.rescored = 0

    def walk(self, x: np.ndarray, wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, candidates, exact scores) of the candidates that may lie in what is wanted.

        A child's score differs from its parent's by at most the edge between them times the length of
        the candidate. ``wanted(i, low, high)`` tells which candidates with such bounds to score.
        """
        exact = 2.0 ** 53
        top = np.abs(self.anchors).max(initial=0) * float(np.abs(x).max(initial=0)) * max(x.shape[1], 1)
        kind = np.float64 if top < exact else np.int64
        a, c = self.anchors.astype(kind), x.astype(kind)
        length = np.sqrt((x.astype(float) ** 2).sum(axis=1)) * (1 + 1e-9)
        low, high = np.empty((len(a), len(c))), np.empty((len(a), len(c)))
        for i, p in enumerate(self.parents):
            if p < 0:
                low[i], high[i] = -np.inf, np.inf
                at = np.arange(len(c))
            else:
                reach = self.edges[i] * length
                low[i], high[i] = low[p] - reach, high[p] + reach
                at = np.flatnonzero(wanted(i, low[i], high[i]))
            score = (c[at] @ a[i]).astype(np.int64)
            self.rescored += len(at)
            # A long beyond 2**53 may be rounded as a bound.
            near = np.abs(score) * 1e-15
            low[i, at], high[i, at] = score - near, score + near
            yield i, at, score


class Best:
    """The first ``k`` (score, id) seen: higher scores first, ties to smaller ids."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def least(self) -> float:
        """What a score must reach to count."""
        return float(self.scores[-1]) * (1 - 1e-15 * np.sign(self.scores[-1])) if len(self.scores) == self.k else -np.inf

    def add(self, scores: np.ndarray, reps: np.ndarray, ids: list) -> None:
        """``ids`` are the first ids of each class of equal rows, ``reps`` the smallest of them."""
        first = np.lexsort((reps, -scores))[:self.k]
        more = [(scores[j], i) for j in first for i in ids[j]]
        scores = np.append(self.scores, np.array([s for s, _ in more], np.int64))
        seen = np.append(self.ids, np.array([i for _, i in more], np.int64))
        order = np.lexsort((seen, -scores))[:self.k]
        self.scores, self.ids = scores[order], seen[order]


def _tile(anchors: pa.Table, rows: pa.Table):
    """Anchors in the order of their tree, and slices of the candidates that fit ``HELD`` bounds."""
    order = np.argsort(anchors.column("at").to_numpy())
    anchors = anchors.take(pa.array(order))
    dims = anchors.column("dims")[0].as_py()
    tile = Tile(_matrix(anchors.column("vec"), dims), anchors.column("parent").to_numpy(), anchors.column("edge").to_numpy())
    wide = max(64, HELD // max(1, anchors.num_rows))
    slices = []
    for at in range(0, rows.num_rows, wide):
        some = rows.slice(at, wide)
        slices.append((_matrix(some.column("vec"), dims), some.column("label").to_numpy(), some.column("class").to_numpy(),
                       np.array([*some.column("ids").to_pylist(), None], object)[:-1]))
    return anchors, tile, slices


def first_positives(anchors: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The first ``k`` rows of a tile with each anchor's label."""
    out: list[list] = [[], [], []]
    if anchors.num_rows and rows.num_rows:
        anchors, tile, slices = _tile(anchors, rows)
        labels, best = anchors.column("label").to_numpy(), [Best(k) for _ in range(anchors.num_rows)]
        for x, label, reps, ids in slices:
            for i, at, score in tile.walk(x, lambda i, low, high: (label == labels[i]) & (high >= best[i].least)):
                same = label[at] == labels[i]
                best[i].add(score[same], reps[at[same]], ids[at[same]])
        for a, b in zip(anchors.column("class").to_pylist(), best):
            for column, values in zip(out, ([a] * len(b.ids), b.ids, b.scores)):
                column.extend(values)
    return pa.table([pa.array(c, pa.int64()) for c in out], names=["class", "id", "score"])


def first_negatives(anchors: pa.Table, rows: pa.Table, k: int, least: int, most: int) -> pa.Table:
    """The first ``k`` rows of a tile with another label in the window of each score of a positive."""
    out: list[list] = [[], [], [], []]
    if anchors.num_rows and rows.num_rows:
        anchors, tile, slices = _tile(anchors, rows)
        labels = anchors.column("label").to_numpy()
        windows = [[(p, -(-least * p // 100), most * p // 100, Best(k)) for p in ps] for ps in anchors.column("scores").to_pylist()]

        def wanted(i, low, high):
            found = np.zeros(len(low), bool)
            for _, a, b, best in windows[i]:
                if a <= b:
                    found |= (high >= max(a * (1 - 1e-15 * np.sign(a)), best.least)) & (low <= b * (1 + 1e-15 * np.sign(b)))
            return found & (label != labels[i])

        for x, label, reps, ids in slices:
            for i, at, score in tile.walk(x, wanted):
                other = label[at] != labels[i]
                at, score = at[other], score[other]
                for _, a, b, best in windows[i]:
                    inside = (score >= a) & (score <= b)
                    if inside.any():
                        best.add(score[inside], reps[at[inside]], ids[at[inside]])
        for a, ws in zip(anchors.column("class").to_pylist(), windows):
            for p, _, _, b in ws:
                for column, values in zip(out, ([a] * len(b.ids), [p] * len(b.ids), b.ids, b.scores)):
                    column.extend(values)
    return pa.table([pa.array(c, pa.int64()) for c in out], names=["class", "positive_score", "id", "score"])


def scaled(vectors: DataFrame, is_anchor: Column, label: Column, key: str, vector: str, scale: int) -> DataFrame:
    """(id, label, vec, asks): one row for each id, components floor(``scale`` * x) as longs."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    vec = F.transform(vector, lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("double"))
    square = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v)
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & label.isNotNull() & fine).select(
        F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), vec.alias("vec"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = rows.where(square < _LONGEST).withColumn("vec", F.col("vec").cast("array<long>"))
    one = rows.groupBy("id").agg(F.min(F.struct("label", "vec", "asks")).alias("r"))
    return one.select("id", "r.*").withColumn("dims", F.size("vec"))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A key along a Hilbert curve over random projections of directions, so that near anchors share a tree."""
    for batch in batches:
        for dims in np.unique(batch.column(1).to_numpy()):
            some = batch.filter(pa.array(batch.column(1).to_numpy() == dims))
            x = _matrix(some.column(3), dims).astype(float)
            axes = np.random.default_rng(_SEED).standard_normal((dims, _AXES)) / math.sqrt(max(dims, 1))
            length = np.sqrt((x * x).sum(axis=1, keepdims=True))
            at = (x / np.where(length > 0, length, 1.0)) @ axes * math.sqrt(max(dims, 1)) / 6 + 0.5
            keys = hilbert_keys(np.clip(at * (1 << _BITS), 0, (1 << _BITS) - 1).astype(np.int64), _BITS)
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(keys)], names=["class", "dims", "label", "vec", "place"])


def _planted(group: pa.Table) -> pa.Table:
    """The anchors of a group with their place in its tree."""
    group = group.take(pa.array(np.argsort(group.column("class").to_numpy())))
    order, parents, edges = spanning_tree(_matrix(group.column("vec"), group.column("dims")[0].as_py()))
    group = group.take(pa.array(order))
    return pa.table([*(group.column(c) for c in ("class", "dims", "label", "vec", "tree")), pa.array(np.arange(len(order), dtype=np.int32)),
                     pa.array(parents.astype(np.int32)), pa.array(edges)], names=["class", "dims", "label", "vec", "tree", "at", "parent", "edge"])


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column | str = "label", positives: int = 5, negatives: int = 10,
                   least: int = 30, most: int = 90, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For every anchor and each of its ``positives`` nearest rows of its label, the first ``negatives`` rows of other
    labels whose score is from ``least`` to ``most`` percent of the positive's.

    Scores are exact integer inner products of components floor(``scale`` * x). Rows of one label and vector are one
    class, searched once and listed with as many of its first ids as can count, however many there are. Distinct
    anchors are ordered along a Hilbert curve and cut into groups, each with a least spanning tree. A tile compares a
    group with a block of candidates: only the root scores all of them, a child has bounds from its parent's score and the edge
    between them and scores only candidates whose bounds overlap what is wanted (first the best of its own label, then the
    windows of its positives). Tiles return bounded lists, which are merged for each class of anchors.

    Columns: anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score; higher scores come
    first, ties go to the smaller id. Rows without a key or label, with a null vector or a null or non-finite component, or
    with a squared length of 2**62 or more after scaling take no part; zero vectors do. Vectors of other lengths
    have no score with an anchor. Of rows that share a key, the one with the smallest label and vector counts. Other columns are ignored; an
    empty table gives no rows.
    """
    rows = frozen(scaled(vectors, is_anchor, F.col(label) if isinstance(label, str) else label, key, vector, scale))
    most_ids = max(positives + 1, negatives)
    nth = F.row_number().over(Window.partitionBy("label", "vec").orderBy("id"))
    first = rows.withColumn("n", nth).where(F.col("n") <= most_ids)
    asked = rows.where("asks").groupBy("label", "vec").agg(F.lit(True).alias("asks"))
    classes = frozen(
        first.groupBy("dims", "label", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .join(asked, ["label", "vec"], "left").withColumn("class", F.col("ids")[0]))
    total, numbers = classes.agg(F.count("*"), F.coalesce(F.max("dims"), F.lit(0))).first()
    size = min(max(BLOCK, math.ceil(total / MOST_BLOCKS)), max(64, BLOCK_NUMBERS // max(1, numbers)))
    blocks = max(1, math.ceil(total / size))

    laid = classes.where("asks").select("class", "dims", "label", "vec").mapInArrow(
        _places, "class long, dims int, label long, vec array<long>, place long")
    grouped = positions(laid, ["dims", "place", "class"]).withColumn("tree", F.floor(F.col("position") / TREE))
    trees = frozen(grouped.select("class", "dims", "label", "vec", "tree").groupBy("dims", "tree").applyInArrow(
        _planted, "class long, dims int, label long, vec array<long>, tree long, at int, parent int, edge double"))
    spans = trees.groupBy("dims").agg(F.min("tree").alias("_from"), F.max("tree").alias("_to"))
    block = F.pmod(F.xxhash64("class"), F.lit(blocks)).alias("block")
    candidates = classes.join(spans, "dims").select(
        "dims", "class", "label", "vec", "ids", block, F.explode(F.sequence("_from", "_to")).alias("tree"))

    def tiles(anchors: DataFrame, run, schema: str) -> DataFrame:
        everywhere = anchors.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        keys = ("dims", "tree", "block")
        return everywhere.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(run, schema)

    near = tiles(trees, lambda a, b: first_positives(a, b, positives + 1), "class long, id long, score long")
    order = Window.partitionBy("class").orderBy(F.desc("score"), "id")
    chosen = frozen(near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives + 1))
    scores = chosen.groupBy("class").agg(F.array_sort(F.collect_set("score")).alias("scores"))
    far = tiles(trees.join(scores, "class"), lambda a, b: first_negatives(a, b, negatives, least, most),
                "class long, positive_score long, id long, score long")
    order = Window.partitionBy("class", "positive_score").orderBy(F.desc("score"), "id")
    found = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).groupBy("class", "positive_score").agg(
        F.sort_array(F.collect_list(F.struct("rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")))).alias("found"))
    # One row for each class of anchors, with lists of bounded length; the anchors of a class are dealt to copies of it.
    lists = chosen.select("class", "n", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(
        found, ["class", "positive_score"], "left").groupBy("class").agg(
        F.sort_array(F.collect_list(F.struct("n", "positive_id", "positive_score", "found"))).alias("positives"))
    copies = classes.where("asks").select("label", "vec", "class").join(lists, "class").select(
        "label", "vec", "positives", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    anchors = rows.where("asks").select(F.col("id").alias("anchor_id"), "label", "vec", F.pmod(F.hash("id"), F.lit(SALTS)).alias("salt"))
    own = anchors.join(copies, ["label", "vec", "salt"]).select("anchor_id", F.explode(F.slice(
        F.filter("positives", lambda p: p["positive_id"] != F.col("anchor_id")), 1, positives)).alias("p"))
    return own.select("anchor_id", "p.positive_id", "p.positive_score", F.explode("p.found").alias("f")).select(
        "anchor_id", "positive_id", "f.rank", "f.negative_id", "positive_score", "f.negative_score")
