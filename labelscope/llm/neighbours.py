"""Approximate nearest neighbours by low-dimensional stable projections and a kd-tree.

Unit vectors are projected to a few dimensions by Gaussian (2-stable) vectors: the squared
distance of two projections over that of the vectors follows a chi-square law with as many degrees of freedom. A kd-tree over the projections,
whose splits come from a bounded sample, deals every row to a cell. A query takes cells in the order of their
projected distance, more in each round, and verifies what lies in them on the original vectors. It
stops when the chi-square test holds: a vector nearer than the k-th found so far would with probability
``CERTAINTY`` be projected nearer than any cell that is left. Inside a cell the same test leaves out single rows.

A cell that holds many rows, say copies of one vector, is cut into blocks, so that no task gathers more than a block of
rows; the queries of a block pass by as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp, inf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from labelscope.llm.shared import Scratch, written

#: Dimensions of the projection (an even number), and the seed of its vectors.
DIMENSIONS, SEED = 8, 13
#: Probability that a nearer vector has been seen when the search stops.
CERTAINTY = 0.95
#: Rows that choose the splits, wanted rows of a cell, most rows of a block, and rows of the sample that a cell needs.
SAMPLE, CELL, BLOCK, CELL_SAMPLE = 16_384, 512, 1024, 4
#: How many cells a query takes in each round; then all that the test leaves.
ROUNDS = (1, 8, None)
#: Queries that a task compares with a block at a time.
BATCH = 512
#: Slack of comparisons of projected distances, and of scores from matrix products, for rounding.
_ROUNDING = 1e-9


def chi_square_quantile(certainty: float, degrees: int) -> float:
    """The value that a chi-square variable of an even number of degrees exceeds with probability ``1 - certainty``."""

    def beyond(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, degrees // 2):
            term *= x / 2 / i
            total += term
        return exp(-x / 2) * total

    low, high = 0.0, 1.0
    while beyond(high) > 1 - certainty:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if beyond(middle) > 1 - certainty else (low, middle)
    return high


def projection(size: int) -> np.ndarray:
    """The same Gaussian vectors in every task."""
    return np.random.default_rng((SEED, size)).standard_normal((size, DIMENSIONS))


def units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


class Tree:
    """A kd-tree over projections: a split in each inner node, a cell in each leaf."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        self.axis, self.value, self.left, self.right, self.cells = [], [], [], [], 0
        self._split(points, leaf)

    def _split(self, points: np.ndarray, leaf: int) -> int:
        spread = points.max(axis=0) - points.min(axis=0)
        axis = int(spread.argmax())
        middle = float(np.median(points[:, axis]))
        low = points[:, axis] < middle
        if len(points) < 2 * leaf or not 0 < low.sum() < len(points):
            self.cells += 1
            return -self.cells  # cell c is -(c + 1)
        node = len(self.axis)
        self.axis.append(axis)
        self.value.append(middle)
        self.left.append(0)
        self.right.append(0)
        self.left[node], self.right[node] = self._split(points[low], leaf), self._split(points[~low], leaf)
        return node

    def cell(self, points: np.ndarray) -> np.ndarray:
        at = np.zeros(len(points), dtype=np.int64)
        if not self.axis:
            return at
        axis, value, left, right = (np.array(x) for x in (self.axis, self.value, self.left, self.right))
        open_ = np.arange(len(points))
        while len(open_):
            node = at[open_]
            at[open_] = np.where(points[open_, axis[node]] < value[node], left[node], right[node])
            open_ = open_[at[open_] >= 0]
        return -at - 1


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch, which all have the same number of components."""
    values = batch.column("vector")
    return np.frombuffer(b"".join(v.as_buffer() for v in values), dtype=np.float64).reshape(len(values), -1)


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = batch.column("size").to_numpy()
    for size in np.unique(sizes):
        yield int(size), batch.filter(pa.array(sizes == size))


def usable_vectors(vectors: DataFrame, vec_id: Column, vector: Column) -> DataFrame:
    """``vec_id, size, vector``: vectors as bytes of doubles, scaled by a power of two, without those that take no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, out = [], [], []
            for i, value in zip(batch.column("vec_id").to_pylist(), batch.column("vector"), strict=True):
                if i is None or not value.is_valid or value.values.null_count or not len(value.values):
                    continue
                numbers = value.values.to_numpy(zero_copy_only=False)
                most = np.abs(numbers).max()
                if not np.isfinite(most) or most == 0:
                    continue
                ids.append(i)
                sizes.append(len(numbers))
                out.append(np.ldexp(numbers, -int(np.frexp(most)[1])).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "size", "vector"])

    rows = vectors.select(vec_id.cast("long").alias("vec_id"), vector.cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, "vec_id long, size int, vector binary")


def _trees(rows: DataFrame) -> dict[int, Tree]:
    """A tree for each number of components, from at most ``2 * SAMPLE`` rows chosen by hash."""
    count = rows.count()
    if not count:
        return {}
    share = min(1.0, SAMPLE / count)
    chosen = rows.filter(F.pmod(F.xxhash64("row"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, part in _by_size(batch):
                points = units(_vectors(part)) @ projection(size)
                yield pa.RecordBatch.from_arrays([part.column("size"), pa.array(list(points), pa.list_(pa.float64()))], ["size", "point"])

    found = chosen.mapInArrow(run, "size int, point array<double>").limit(2 * SAMPLE).toPandas()
    leaf = max(CELL_SAMPLE, round(CELL * len(found) / count))
    return {int(size): Tree(np.stack(group["point"].to_list()), leaf) for size, group in found.groupby("size")}


def index_vectors(vectors: DataFrame, vec_id: Column, vector: Column, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The index, ``row, vec_id, size, vector, cell, block``, and ``size, cell, blocks, low, high``, a row for each cell.

    The second is bounded by the sample: there are at most ``2 * SAMPLE / CELL_SAMPLE`` cells, and one more for each
    number of components that the sample does not have.
    """
    rows = scratch.write(usable_vectors(vectors, vec_id, vector).withColumn("row", F.monotonically_increasing_id()), "vectors")
    trees = _trees(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, part in _by_size(batch):
                points = units(_vectors(part)) @ projection(size)
                cell = trees[size].cell(points) if size in trees else np.zeros(len(points), dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("row", "vec_id", "size", "vector")] + [pa.array(cell, pa.int32()), pa.array(list(points), pa.list_(pa.float64()))],
                    ["row", "vec_id", "size", "vector", "cell", "point"],
                )

    placed = scratch.write(
        rows.select("row", "vec_id", "size", "vector").mapInArrow(run, "row long, vec_id long, size int, vector binary, cell int, point array<double>"), "placed"
    )
    cells = scratch.write(placed.groupBy("size", "cell").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"),
        *(F.array(*(least(F.col("point")[i]) for i in range(DIMENSIONS))).alias(name) for name, least in (("low", F.min), ("high", F.max))),
    ), "cells")
    block = F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")
    return placed.join(cells.select("size", "cell", "blocks"), ["size", "cell"]).select("row", "vec_id", "size", "vector", "cell", block.alias("block")), cells


_ASKED = "row long, vec_id long, size int, vector binary, bound double, cell int, block int, asked boolean"


def _next_cells(queries: DataFrame, cells: DataFrame, seen: int, take: int | None, quantile: float) -> DataFrame:
    """The queries with each block of the cells that come next: those from place ``seen`` on that the test does not rule out."""
    boxes = {
        int(size): (g["cell"].to_numpy(), g["blocks"].to_numpy(), np.stack(g["low"].to_list()), np.stack(g["high"].to_list()))
        for size, g in cells.toPandas().groupby("size")
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, part in _by_size(batch):
                cell, blocks, low, high = boxes[size]
                points = units(_vectors(part)) @ projection(size)
                bound = part.column("bound").to_numpy()
                for first in range(0, len(points), 64):
                    some = points[first : first + 64, None, :]
                    away = np.maximum(np.maximum(low[None] - some, some - high[None]), 0)
                    distance = (away * away).sum(axis=2)
                    radius = quantile * (2 - 2 * np.maximum(bound[first : first + 64], -1)) + _ROUNDING
                    order = np.argsort(distance, axis=1, kind="stable")[:, seen : None if take is None else seen + take]
                    near = np.take_along_axis(distance, order, axis=1) <= np.where(np.isfinite(bound[first : first + 64]), radius, inf)[:, None]
                    query, place = np.nonzero(near)
                    chosen = order[query, place]
                    query, chosen = np.repeat(query, blocks[chosen]), np.repeat(chosen, blocks[chosen])
                    new = np.r_[True, (query[1:] != query[:-1]) | (chosen[1:] != chosen[:-1])] if len(query) else np.zeros(0, dtype=bool)
                    starts = np.flatnonzero(new)
                    block = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
                    rows = part.take(pa.array(first + query))
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(c) for c in ("row", "vec_id", "size", "vector", "bound")]
                        + [pa.array(cell[chosen], pa.int32()), pa.array(block, pa.int32()), pa.array(np.ones(len(query), dtype=bool))],
                        ["row", "vec_id", "size", "vector", "bound", "cell", "block", "asked"],
                    )

    return queries.select("row", "vec_id", "size", "vector", "bound").mapInArrow(run, _ASKED)


def _verified(index: DataFrame, asked: DataFrame, k: int, quantile: float) -> DataFrame:
    """``query, row, vec_id, score``: of each block that a query asks, the ``k`` best rows that are no worse than its bound."""
    points = index.select("row", "vec_id", "size", "vector", F.lit(None).cast("double").alias("bound"), "cell", "block", F.lit(False).alias("asked"))
    keys = ["size", "cell", "block"]
    dealt = points.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, "asked", "row")

    def compare(held: list, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, ids, vectors, points, norms = held
        asking = _vectors(part)
        asking_rows, bound = part.column("row").to_numpy(), part.column("bound").to_numpy()
        asking_norms = np.sqrt((asking * asking).sum(axis=1))
        spot = (asking / asking_norms[:, None]) @ projection(asking.shape[1])
        distance = (spot * spot).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None] - 2 * spot @ points.T
        radius = np.where(np.isfinite(bound), quantile * (2 - 2 * np.maximum(bound, -1)) + _ROUNDING, inf)
        about = (asking @ vectors.T) / asking_norms[:, None] / norms[None]
        open_ = (distance <= radius[:, None]) & (rows[None] != asking_rows[:, None]) & (about >= bound[:, None] - _ROUNDING)
        out = []
        for q in np.flatnonzero(open_.any(axis=1)):
            at = np.flatnonzero(open_[q])
            if len(at) > k:
                least = np.partition(about[q, at], len(at) - k)[len(at) - k]
                at = at[about[q, at] >= least - _ROUNDING]
            score = (vectors[at] * asking[q]).sum(axis=1) / (norms[at] * asking_norms[q])
            best = np.lexsort((rows[at], ids[at], -score))[:k]
            best = best[score[best] >= bound[q]]
            out.append((np.full(len(best), asking_rows[q]), rows[at[best]], ids[at[best]], score[best]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["query", "row", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, gathered, held = None, [], None
        for batch in batches:
            block = np.stack([batch.column(c).to_numpy() for c in keys], axis=1)
            asks = batch.column("asked").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((block[1:] != block[:-1]).any(axis=1) | (asks[1:] != asks[:-1])) + 1
            for first, end in zip(np.r_[0, cuts], np.r_[cuts, len(asks)], strict=True):
                if first == end:
                    continue
                part = batch.slice(first, end - first)
                if tuple(block[first]) != key:
                    key, gathered, held = tuple(block[first]), [], None
                if not asks[first]:
                    gathered.append(part)
                    continue
                if held is None:
                    vectors = np.concatenate([_vectors(p) for p in gathered])
                    norms = np.sqrt((vectors * vectors).sum(axis=1))
                    rows, ids = (np.concatenate([p.column(c).to_numpy() for p in gathered]) for c in ("row", "vec_id"))
                    held, gathered = [rows, ids, vectors, (vectors / norms[:, None]) @ projection(vectors.shape[1]), norms], []
                for at in range(0, len(part), BATCH):
                    yield from compare(held, part.slice(at, BATCH))

    return dealt.mapInArrow(run, "query long, row long, vec_id long, score double")


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows nearest to each row whose id is divisible by ``every``, as found.

    Nearness is the cosine in double precision; ties go to the smaller id. All other rows are candidates, also
    those of the same id or the same vector. Vectors that are null, empty or zero, or hold a null or a component that is not finite, and rows without
    an id, take no part; vectors of different numbers of components are not compared. A table
    of fewer candidates gives all of them, an empty one no rows. Other columns are not read. Nothing is
    capped: the sample bounds the splits of the tree alone, and a query goes on until the test holds.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    quantile = chi_square_quantile(CERTAINTY, DIMENSIONS)
    index, cells = index_vectors(vectors, F.col(vec_id), F.col(vector), scratch)
    index = scratch.write(index, "index")
    queries = index.filter(F.col("vec_id") % every == 0).select("row", "vec_id", "size", "vector")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    found = spark.createDataFrame([], "query long, row long, vec_id long, score double")
    seen = 0
    for take in ROUNDS:
        bounds = found.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).alias("bound"))
        asking = queries.join(bounds, queries["row"] == bounds["query"], "left").select(
            "row", queries["vec_id"], "size", "vector", F.coalesce("bound", F.lit(-inf)).alias("bound")
        )
        more = _verified(index, _next_cells(asking, cells, seen, take, quantile), k, quantile)
        ranked = found.unionByName(more).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        found = scratch.write(ranked, "found").drop("rank")
        seen += take or 0
    named = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
    result = found.withColumn("rank", F.row_number().over(best)).join(named, "query").select("query_id", "rank", "vec_id", "score")
    result = written(result, "nearest")
    scratch.drop()
    return result
