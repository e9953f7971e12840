"""Approximate nearest neighbours along shifted Hilbert curves."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.llm.common import frozen, positions

#: Orderings, dimensions of each, bits of a dimension: a key has 56 bits.
CURVES, DIMS, BITS = 24, 8, 7
#: Least and most rows of a window block, and the share of all places of an ordering that a query
#: meets on either side, so that recall does not fall as the table grows.
BLOCK, MOST_BLOCK, SHARE = 1024, 16384, 0.019
#: Blocks whose queries one task compares with a block.
MET = 9
#: Distinct vectors from which the ranges of the projections are taken.
SAMPLE = 4096
_SEED = 11


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows) with ``bits`` bits a coordinate.

    The usual transform: undo the rotations and reflections from the highest bit down, Gray-decode,
    then read the bits across coordinates.
    """
    x = cells.T.astype(np.int64).copy()
    dims = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        below = bit - 1
        for i in range(dims):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(on, x[0] ^ below, x[0] ^ swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        turn = np.where((x[-1] & bit) != 0, turn ^ (bit - 1), turn)
        bit >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def window(places: int) -> tuple[int, int]:
    """Rows of a block, and how many blocks on either side a query meets, for so many places in an ordering."""
    wide = max(BLOCK, math.ceil(places * SHARE))
    reach = math.ceil(wide / MOST_BLOCK)
    return math.ceil(wide / reach), reach


class Curves:
    """Projections, shifts and ranges of all orderings."""

    def __init__(self, sample: np.ndarray, longest: float):
        self.longest = longest
        size = sample.shape[1] + 1
        rng = np.random.default_rng(_SEED)
        dims = min(DIMS, size)
        axes: list[np.ndarray] = []
        while len(axes) < CURVES:
            basis, _ = np.linalg.qr(rng.standard_normal((size, size)))
            axes += [basis[:, at:at + dims] for at in range(0, size - dims + 1, dims)]
        self.axes = np.hstack(axes[:CURVES])
        self.shifts = rng.random(self.axes.shape[1]) * 0.2
        seen = self.lift(sample, False) @ self.axes
        self.low = np.percentile(seen, 0.5, axis=0)
        self.wide = np.maximum(np.percentile(seen, 99.5, axis=0) - self.low, 1e-12)
        self.dims = dims

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        """One more coordinate, so that the largest inner product is the smallest angle: candidates
        are filled up to the longest norm, queries have length 1 and nothing there."""
        norms = np.linalg.norm(x, axis=1, keepdims=True)
        if query:
            return np.hstack([x / norms, np.zeros_like(norms)])
        return np.hstack([x / self.longest, np.sqrt(np.maximum(0.0, 1 - (norms / self.longest) ** 2))])

    def keys(self, x: np.ndarray, query: bool) -> np.ndarray:
        """(rows, curves) keys."""
        at = (self.lift(x, query) @ self.axes - self.low) / self.wide * 0.8 + self.shifts
        cells = np.clip(at * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
        return np.stack([hilbert_keys(cells[:, c * self.dims:(c + 1) * self.dims], BITS) for c in range(CURVES)], axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows with a key and a vector of the most common length that has only finite numbers, not all zero."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0)
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, vector).where(fine)
    common = rows.groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size(vector) == (common["n"] if common else 0))


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` rows with the largest inner product found for every row that is a query.

    Equal vectors are searched once, however many rows have them, and count with their smallest keys,
    which is exact. Every distinct vector stands in ``CURVES`` orderings: shifted Hilbert curves over
    random projections, each numbered by a range partitioning. A query is compared with all
    vectors of its own block and of as many blocks on either side as hold ``SHARE`` of all places of
    the ordering, and at least ``BLOCK``; blocks have at most ``MOST_BLOCK`` rows. What the orderings find is merged and ranked by
    the inner product in double precision, added up in the order of the components.

    Columns: query_id, rank (from 1), vec_id, score; ties go to the smaller key. Rows without a
    key, and null, zero, non-finite or differently long vectors take no part; repeated rows count once;
    other columns are ignored; an empty table gives no rows.
    """
    rows = frozen(usable(vectors, key, vector).select(
        F.col(key).cast("long").alias("id"), F.col(vector).alias("vec"), F.xxhash64(vector).alias("vh"),
        F.coalesce(is_query, F.lit(False)).alias("asks")))
    reps = frozen(rows.groupBy("vh").agg(F.min("id").alias("rep"), F.first("vec").alias("vec"), F.max("asks").alias("asks")))
    norm = F.sqrt(F.aggregate(F.col("vec").cast("array<double>"), F.lit(0.0), lambda a, v: a + v * v))
    longest, *places = reps.agg(F.max(norm), F.count("*"), F.count_if("asks")).first()
    block, reach = window(sum(places))
    sample = reps.orderBy(F.xxhash64("vh")).limit(SAMPLE).select(F.col("vec").cast("array<double>")).collect()
    if not sample:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    curves = Curves(np.array([r[0] for r in sample]), longest)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vh, asks = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            x = _matrix(batch.column(1))
            for role, mine in ((0, np.ones(len(vh), bool)), (1, asks)):
                if mine.any():
                    keys = curves.keys(x[mine], bool(role))
                    n = len(keys)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.tile(np.arange(CURVES, dtype=np.int32), n)), pa.array(keys.ravel()),
                        pa.array(np.full(n * CURVES, role, np.int32)), pa.array(np.repeat(vh[mine], CURVES))],
                        names=["curve", "place", "role", "vh"])

    laid = reps.select("vh", "vec", "asks").mapInArrow(lay, "curve int, place long, role int, vh long")
    numbered = positions(laid, ["curve", "place", "vh", "role"]).withColumn("block", F.floor(F.col("position") / block))
    parts = math.ceil((2 * reach + 1) / MET)
    meets = F.when(F.col("role") == 0, F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.struct(
        F.col("block").alias("block"), p.alias("part")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.lit(2 * reach)), lambda at: F.struct(
            (F.col("block") + at - reach).alias("block"), F.floor(at / MET).cast("int").alias("part"))))
    windows = numbered.select("role", "vh", F.explode(meets).alias("m")).select("role", "vh", "m.*").join(reps.select("vh", "rep", "vec"), "vh")

    def compare(group: pa.Table) -> pa.Table:
        role, vh, rep = (group.column(c).to_numpy() for c in ("role", "vh", "rep"))
        x = _matrix(group.column("vec"))
        ask, other = np.flatnonzero(role == 1), np.flatnonzero(role == 0)
        ask = ask[np.unique(vh[ask], return_index=True)[1]]
        other = other[np.unique(vh[other], return_index=True)[1]]
        found: list[tuple[np.ndarray, ...]] = []
        most = min(len(other), k + 9)
        for at in range(0, len(ask) if most else 0, 256):
            q = ask[at:at + 256]
            rough = x[q] @ x[other].T
            best = other[np.argpartition(-rough, most - 1, axis=1)[:, :most]]
            score = np.zeros(best.shape)
            for d in range(x.shape[1]):
                score += x[q, d][:, None] * x[best, d]
            order = np.lexsort((rep[best], -score), axis=1)[:, :k + 1]
            best, score = np.take_along_axis(best, order, 1), np.take_along_axis(score, order, 1)
            found.append((np.repeat(vh[q], best.shape[1]), vh[best].ravel(), rep[best].ravel(), score.ravel()))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64)] * 3 + [np.empty(0)]
        return pa.table(dict(zip(("query", "vh", "rep", "score"), map(pa.array, columns))))

    pairs = windows.groupBy("block", "part").applyInArrow(compare, "query long, vh long, rep long, score double")
    merged = pairs.groupBy("query", "vh", "rep").agg(F.max("score").alias("score"))
    first = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    merged = merged.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    smallest = Window.partitionBy("vh").orderBy("id")
    members = (
        rows.select("vh", "id").distinct().withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1)
        .groupBy("vh").agg(F.collect_list("id").alias("ids")))
    spread = merged.select("query", "vh", "score").join(members, "vh").select("query", F.explode("ids").alias("id"), "score")
    closest = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    answers = (
        spread.withColumn("n", F.row_number().over(closest)).where(F.col("n") <= k + 1)
        .groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("found")))
    asked = rows.where("asks").select(F.col("id").alias("query_id"), F.col("vh").alias("query")).distinct()
    own = asked.join(answers, "query").select(
        "query_id", F.posexplode(F.slice(F.filter("found", lambda f: f["id"] != F.col("query_id")), 1, k)).alias("at", "f"))
    return own.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.id").alias("vec_id"), F.col("f.score").alias("score"))
