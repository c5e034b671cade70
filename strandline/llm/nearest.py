"""Approximate nearest neighbours by stable projections (operator 7).

Vectors are projected to DIMENSIONS Gaussian (2-stable) coordinates.  A kd-tree
over a bounded sample of the projections cuts their space into cells, and every
vector goes to its cell; large cells are dealt into blocks of bounded size, each
with a kd-tree of its own.  A query first searches the cell it falls into and
the nearest other one.  Its k-th nearest distance d so far then says which cells
are left: for a vector at distance d or less, (r / distance)**2 follows a
chi-square law in the projected distance r, so once the law's probability at
(r / d)**2 exceeds SURE, no nearer one is likely there.  Only cells within that r
are visited, with d in hand.  Inside a block, projected neighbours are likewise
taken in growing r and verified on the whole vectors until the test holds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .shared import saved

DIMENSIONS, SURE, LEAF = 8, 0.97, 32
#: Vectors whose projections the cells are fitted on (those with the smallest hashes of their ids), and the least of them in a cell.
SAMPLE, SAMPLE_CELL = 20_000, 16
#: Vectors of a block, and queries that meet it at once.
BLOCK, QUERIES = 8192, 1024
#: Cells that a query searches before it has a distance to go by.
FIRST = 2


def chi_square(x: float, dimensions: int) -> float:
    """The probability of at most x, for an even number of dimensions."""
    half, term, total = x / 2, 1.0, 0.0
    for i in range(dimensions // 2):
        total += term
        term *= half / (i + 1)
    return 1 - math.exp(-half) * total


def chi_square_at(p: float, dimensions: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, dimensions) < p else (low, middle)
    return high


def kd_tree(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the points by leaf, the offsets of the leaves, and the corners of their boxes."""
    order, ends, stack = [], [0], [np.arange(len(points))]
    while stack:
        part = stack.pop()
        if len(part) <= leaf:
            order.append(part)
            ends.append(ends[-1] + len(part))
            continue
        spread = points[part]
        axis = int(np.argmax(spread.max(0) - spread.min(0)))
        half = np.argpartition(spread[:, axis], len(part) // 2)
        stack += [part[half[len(part) // 2 :]], part[half[: len(part) // 2]]]
    order = np.concatenate(order)
    first = np.array(ends[:-1])
    ordered = points[order]
    return order, np.array(ends), np.minimum.reduceat(ordered, first), np.maximum.reduceat(ordered, first)


class Cells(NamedTuple):
    """A kd-tree's cuts (axis -1: a leaf, whose cell is `cut`), and the boxes of its cells, which fill the whole space."""

    axis: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def fit(cls, points: np.ndarray, cells: int) -> Cells:
        d = points.shape[1]
        axis, cut, child, low, high = [], [], [], [], []
        waiting = [(np.arange(len(points)), cells, np.full(d, -np.inf), np.full(d, np.inf), -1)]
        while waiting:
            part, n, lo, hi, parent = waiting.pop()
            at = len(axis)
            if parent >= 0:
                child[parent].append(at)
            spread = points[part]
            along = int(np.argmax(spread.max(0) - spread.min(0))) if len(part) else 0
            middle = float(np.median(spread[:, along])) if len(part) else 0.0
            left = spread[:, along] <= middle if len(part) else np.zeros(0, bool)
            child.append([])
            if n < 2 or left.all():
                axis.append(-1)
                cut.append(len(low))
                low.append(lo)
                high.append(hi)
                continue
            axis.append(along)
            cut.append(middle)
            inner, outer = hi.copy(), lo.copy()
            inner[along] = outer[along] = middle
            waiting += [(part[~left], n // 2, outer, hi, at), (part[left], n - n // 2, lo, inner, at)]
        return cls(np.array(axis), np.array(cut, float), np.array([c or [0, 0] for c in child]), np.array(low), np.array(high))

    def of(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        node = np.zeros(len(points), np.int64)
        while (open_ := self.axis[node] >= 0).any():
            i = np.flatnonzero(open_)
            above = points[i, self.axis[node[i]]] > self.cut[node[i]]
            node[i] = self.child[node[i], above.astype(np.int64)]
        return self.cut[node].astype(np.int64)

    def squares(self, point: np.ndarray) -> np.ndarray:
        """Squared distance of a point to each cell."""
        return (np.maximum(np.maximum(self.low - point, point - self.high), 0) ** 2).sum(1)


def projected(vectors: np.ndarray, dimensions: int) -> np.ndarray:
    """By one matrix for each length of vectors."""
    return vectors @ np.random.default_rng(7).standard_normal((vectors.shape[1], dimensions))


def search(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, dimensions: int, sure: float, bounds: np.ndarray | None = None, step: int = 8) -> tuple[list[tuple[int, int, float]], int]:
    """(query's place, id, distance) of the k nearest of each query, but for its own id; and how many were verified.

    bounds: squared distances up to which more are wanted.
    """
    # of equal vectors no more than k + 1 can be wanted: those with the smallest ids
    by = np.lexsort((ids, *vectors.T))
    ids, vectors = ids[by], vectors[by]
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (vectors[1:] != vectors[:-1]).any(1)
    head = np.flatnonzero(fresh)
    keep = np.arange(len(ids)) - np.repeat(head, np.diff(np.append(head, len(ids)))) <= k
    ids, vectors = ids[keep], vectors[keep]
    points, targets = projected(vectors, dimensions), projected(queries, dimensions)
    order, ends, low, high = kd_tree(points)
    ids, vectors, points = ids[order], vectors[order], points[order]
    limit, out, verified = chi_square_at(sure, dimensions), [], 0
    if bounds is None:
        bounds = np.full(len(queries), np.inf)
    for place, (own, q, t, bound) in enumerate(zip(query_ids, queries, targets, bounds, strict=True)):
        box = (np.maximum(np.maximum(low - t, t - high), 0) ** 2).sum(1)
        leaves = np.argsort(box, kind="stable")
        waiting, waiting_r = np.zeros(0, np.int64), np.zeros(0)
        best, best_d = np.zeros(0, np.int64), np.zeros(0)
        for i in range(0, len(leaves), step):
            if box[leaves[i]] > limit * bound:
                break
            fresh = np.concatenate([np.arange(ends[x], ends[x + 1]) for x in leaves[i : i + step]])
            waiting = np.concatenate([waiting, fresh])
            waiting_r = np.concatenate([waiting_r, ((points[fresh] - t) ** 2).sum(1)])
            reach = box[leaves[i + step]] if i + step < len(leaves) else np.inf  # all up to here are known
            due = waiting_r <= min(reach, limit * bound)
            now, waiting, waiting_r = waiting[due], waiting[~due], waiting_r[~due]
            now = now[ids[now] != own]
            verified += len(now)
            distance = ((vectors[now] - q) ** 2).sum(1)
            best, best_d = np.concatenate([best, now[distance <= bound]]), np.concatenate([best_d, distance[distance <= bound]])
            if len(best) >= k:
                top = np.lexsort((ids[best], best_d))[:k]
                best, best_d = best[top], best_d[top]
                bound = best_d[-1]
        out += [(place, int(ids[j]), math.sqrt(d)) for j, d in zip(best, best_d, strict=True)]
    return out, verified


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(rows, -1)


def _project(dimensions: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, out = batch.column("size").to_numpy(), np.zeros((batch.num_rows, dimensions))
            for n in np.unique(size):
                rows = np.flatnonzero(size == n)
                out[rows] = projected(_matrix(batch.column("v").take(pa.array(rows)), len(rows)), dimensions)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dimensions), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "p"])

    return of


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, dimensions: int = DIMENSIONS, sure: float = SURE, vec_id: str = "vec_id", embedding: str = "embedding", block: int = BLOCK, chunk: int = QUERIES, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by `every`.

    Score is the Euclidean distance in double precision; ties go to the smaller
    id.  Vectors that are null, zero or empty, or hold a null or non-finite
    component, and rows without an id, take no part; vectors of other lengths
    are not compared with a query.  Rows that repeat an id are all candidates,
    but for the query's own id, and a query is asked once for each of its
    distinct vectors.  Of equal vectors only the k + 1 with the smallest ids can
    be among k nearest, so the others go before anything meets.  Fewer candidates
    than k give fewer rows; none, none.  Cells are fitted on `sample` vectors, on
    the driver; every vector is in one.
    """
    v = F.col("v")
    fit = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    own = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v")).where("id is not null and v is not null").where(fit).withColumn("size", F.size("v"))
    copies = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    points = "id bigint, v array<double>, size int, p array<double>"
    held = saved(own.withColumn("copy", copies).where(F.col("copy") <= k + 1).drop("copy").mapInArrow(_project(dimensions), points), "vectors")
    asked = saved(own.where(f"id % {every} = 0").distinct().mapInArrow(_project(dimensions), points).withColumn("q", F.monotonically_increasing_id()), "queries")

    few = held.orderBy(F.xxhash64("id"), "id").limit(sample).select("p").toArrow()
    wanted = max(1, min(-(-held.count() // block), few.num_rows // SAMPLE_CELL))
    cells = Cells.fit(_matrix(few.column("p"), few.num_rows) if few.num_rows else np.zeros((0, dimensions)), wanted)
    limit = chi_square_at(sure, dimensions)

    @F.arrow_udf("int")
    def cell_of(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for p in column:
            yield pa.array(cells.of(_matrix(p, len(p))) if len(p) else [], pa.int32())

    dealt = saved(held.withColumn("cell", cell_of("p")).drop("p"), "cells")
    # a row a cell, of which there are sample / SAMPLE_CELL at most
    blocks = saved(dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")), "blocks")
    left = dealt.join(F.broadcast(blocks), "cell").withColumn("block", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))

    def visits(first: bool):
        """Rows of queries for the cells they visit: the FIRST nearest ones, or the others that their bound reaches."""

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bound, rows, to = batch.column("bound").to_numpy(zero_copy_only=False), [], []
                for i, t in enumerate(_matrix(batch.column("p"), batch.num_rows) if batch.num_rows else []):
                    r = cells.squares(t)
                    near = np.argsort(r, kind="stable")
                    near = near[:FIRST] if first else near[FIRST:][r[near[FIRST:]] <= limit * bound[i]]
                    rows += [i] * len(near)
                    to += near.tolist()
                    if len(to) > 20_000:
                        yield told(batch, rows, to)
                        rows, to = [], []
                yield told(batch, rows, to)

        def told(batch: pa.RecordBatch, rows: list[int], to: list[int]) -> pa.RecordBatch:
            some = batch.select(["q", "id", "v", "size", "bound"]).take(pa.array(rows, pa.int64()))
            return pa.RecordBatch.from_arrays([*some.columns, pa.array(to, pa.int32())], names=[*some.schema.names, "cell"])

        return of

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        found = []
        if a.num_rows and b.num_rows:
            q, ids = b.column("q").to_numpy(), b.column("id").to_numpy()
            found, _ = search(a.column("id").to_numpy(), _matrix(a.column("v"), a.num_rows), ids, _matrix(b.column("v"), b.num_rows), k, dimensions, sure, b.column("bound").to_numpy())
            found = [(q[i], ids[i], j, d) for i, j, d in found]
        return pa.table({n: pa.array([x[i] for x in found], t) for i, (n, t) in enumerate((("q", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())))})

    def searched(queries: DataFrame, first: bool) -> DataFrame:
        sent = queries.mapInArrow(visits(first), "q bigint, id bigint, v array<double>, size int, bound double, cell int").join(F.broadcast(blocks), "cell")
        sent = saved(sent.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("blocks"), "visits")
        groups = saved(sent.groupBy("size", "cell", "block").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks")), "groups")
        # queries of a block in chunks of bounded size; only the blocks that many ask for are copied
        mine = sent.join(groups, ["size", "cell", "block"]).withColumn("chunk", F.expr("cast(pmod(xxhash64(q), chunks) as int)")).select("size", "cell", "block", "chunk", "q", "id", "v", "bound").groupBy("size", "cell", "block", "chunk")
        theirs = left.join(groups, ["size", "cell", "block"]).withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)"))).select("size", "cell", "block", "chunk", "id", "v").groupBy("size", "cell", "block", "chunk")
        return saved(theirs.cogroup(mine).applyInArrow(meet, "q bigint, query_id bigint, vec_id bigint, score double"), "found")

    near = searched(asked.withColumn("bound", F.lit(float("inf"))), True)
    tops = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("score"))).where(F.col("r") == k).select("q", (F.col("score") * F.col("score") * (1 + 1e-12)).alias("bound"))
    rest = searched(asked.join(tops, "q", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))), False)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.union(rest).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
