"""Nearest neighbours with a vantage-point tree per shard.

Shards are the leaves of one small vantage-point tree, fitted on a sample of about ``SAMPLE`` vectors (a documented bound; every vector is indexed): a shard is
a region, of about ``SHARD`` rows while there are fewer than ``SHARDS`` of them. A region with many more rows, such as one vector that fills a third of the table, is cut by a hash
of the id into salts. A shard's own tree splits its rows at the median distance from a vantage point, down to leaves of ``LEAF`` rows.

By the triangle inequality, a query at distance d from the vantage point has nothing on the other side of the radius r nearer than |d - r|; that side is left out
if ``factor`` x |d - r| is above the query's k-th distance so far. Factor 1 is exact; larger ones leave out more. The same holds for whole shards: a query first goes to
the shard that it lies in, and then only to those that its k-th distance there doesn't rule out. Vectors are shuffled to their shard once for each of the two steps, whatever
the number of queries; a task holds one shard and streams batches of queries through its tree.

Distances are Euclidean, in double precision, on the original vectors; ties go to the smaller id. Vectors that are null, empty, zero or hold a null or
a non-finite component take no part, nor do rows with a null id. Vectors are only compared with those of their length. Of several vectors of an id the smallest one in
order counts, as a query and as a candidate. Without queries or candidates the result is empty. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import checkpoint, lean

SHARD, LEAF, FACTOR = 4096, 64, 3.0
SAMPLE, SHARDS = 8192, 4096


def _gaps(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - point) ** 2).sum(axis=1))


class Regions:
    """A vantage-point tree with a number of leaves, which are the shards."""

    def __init__(self, sample: np.ndarray, leaves: int) -> None:
        self.nodes: list[list] = [[0]]  # [leaf's number] or [vantage point, radius, inner, outer]
        self.leaves = 1
        todo = [(-sample.shape[0], 0, np.arange(sample.shape[0]))]  # the largest leaf is split first
        while todo and self.leaves < leaves:
            _, place, rows = heapq.heappop(todo)
            if rows.size < 2:
                continue
            point = sample[rows[(place * 7919) % rows.size]]
            d = _gaps(sample[rows], point)
            radius = float(np.median(d))
            inner = d <= radius
            if inner.all():
                radius = float(d[d < radius].max(initial=-1.0))  # many equal distances: they are the outer side
                inner = d <= radius
                if not inner.any():
                    continue
            number, self.leaves = self.leaves, self.leaves + 1
            for own, leaf in ((inner, self.nodes[place][0]), (~inner, number)):
                heapq.heappush(todo, (-int(own.sum()), len(self.nodes), rows[own]))
                self.nodes.append([leaf])
            self.nodes[place] = [point, radius, len(self.nodes) - 2, len(self.nodes) - 1]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(x.shape[0], np.int32)
        todo = [(0, np.arange(x.shape[0]))]
        while todo:
            place, rows = todo.pop()
            at = self.nodes[place]
            if len(at) == 1:
                out[rows] = at[0]
            elif rows.size:
                inner = _gaps(x[rows], at[0]) <= at[1]
                todo += [(at[2], rows[inner]), (at[3], rows[~inner])]
        return out

    def reached(self, x: np.ndarray, bound: np.ndarray, factor: float) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of x for which the leaf may hold something within the bound)."""
        todo = [(0, np.arange(x.shape[0]))]
        while todo:
            place, rows = todo.pop()
            at = self.nodes[place]
            if not rows.size:
                continue
            if len(at) == 1:
                yield at[0], rows
                continue
            d = _gaps(x[rows], at[0])
            room = bound[rows] * (1 + 1e-9) + 1e-12  # distances are rounded
            todo += [(at[2], rows[factor * (d - at[1]) <= room]), (at[3], rows[factor * (at[1] - d) <= room])]


class Tree:
    """A vantage-point tree over the rows of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> None:
        self.ids, self.vectors = ids, vectors
        self.nodes: list[tuple] = []  # (rows,) or (vantage point's row, radius, inner, outer)
        todo: list[tuple[np.ndarray, int | None, int]] = [(np.arange(ids.size), None, 0)]
        while todo:
            rows, parent, side = todo.pop()
            place = len(self.nodes)
            if parent is not None:
                self.nodes[parent][side] = place
            if rows.size <= leaf:
                self.nodes.append([rows])
                continue
            point = rows[(place * 7919) % rows.size]
            rest = rows[rows != point]
            d = _gaps(vectors[rest], vectors[point])
            radius = float(np.median(d))
            inner = d <= radius
            if inner.all():  # many equal distances
                self.nodes.append([rows])
                continue
            self.nodes.append([int(point), radius, -1, -1])
            todo += [(rest[inner], place, 2), (rest[~inner], place, 3)]

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's row, id, distance) of the k nearest found of each query, other than its own id. bound: what is farther isn't asked for."""
        n = ids.size
        bound = np.full(n, np.inf) if bound is None else bound
        best_d, best_id = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)

        def offer(q: np.ndarray, rows: np.ndarray, d: np.ndarray) -> None:
            own = self.ids[rows][None, :] == ids[q][:, None]
            d = np.concatenate((best_d[q], np.where(own, np.inf, d)), axis=1)
            i = np.concatenate((best_id[q], np.where(own, np.iinfo(np.int64).max, np.broadcast_to(self.ids[rows], (q.size, rows.size)))), axis=1)
            order = np.lexsort((i, d), axis=1)[:, :k]
            best_d[q], best_id[q] = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)

        def distances(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
            out = np.empty((q.size, rows.size))
            for at in range(0, q.size, 64):
                for lo in range(0, rows.size, 256):
                    gap = queries[q[at : at + 64], None, :] - self.vectors[None, rows[lo : lo + 256], :]
                    out[at : at + 64, lo : lo + 256] = np.sqrt((gap**2).sum(axis=2))
            return out

        # (node, queries, how near the other side can be); the nearer side of each query is taken first
        todo: list[tuple[int, np.ndarray, np.ndarray]] = [(0, np.arange(n), np.zeros(n))] if n and self.nodes else []
        while todo:
            node, q, gap = todo.pop()
            live = factor * gap <= np.minimum(best_d[q, -1], bound[q]) * (1 + 1e-9) + 1e-12  # distances are rounded
            q, gap = q[live], gap[live]
            if not q.size:
                continue
            at = self.nodes[node]
            if len(at) == 1:
                offer(q, at[0], distances(q, at[0]))
                continue
            point, radius, inner, outer = at
            d = distances(q, np.array([point]))
            offer(q, np.array([point]), d)
            d = d[:, 0]
            near = d <= radius
            border = np.maximum(gap, np.abs(d - radius))
            todo += [(outer, q[near], border[near]), (inner, q[~near], border[~near]), (inner, q[near], gap[near]), (outer, q[~near], gap[~near])]
        row, place = np.nonzero((best_d < np.inf) & (best_d <= bound[:, None]))
        return row, best_id[row, place], best_d[row, place]


def _usable(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    new = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    cuts = [0, *(np.flatnonzero(new) + 1).tolist(), columns[0].size]
    yield from zip(cuts[:-1], cuts[1:], strict=True)


def _found(vectors: DataFrame, asked: DataFrame, k: int, factor: float) -> DataFrame:
    """query_id, vec_id, score: what each query (id, vector, dim, shard, salt, bound) finds in the cell (dim, shard, salt) of vectors that it goes to."""
    both = vectors.select("dim", "shard", "salt", F.lit(0).alias("ask"), "id", "vector", F.lit(0.0).alias("bound"))
    both = both.unionByName(asked.select("dim", "shard", "salt", F.lit(1).alias("ask"), "id", "vector", "bound"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, own, tree = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c).to_numpy() for c in range(4)]
            for lo, hi in _runs(*keys):
                here = tuple(int(x[lo]) for x in keys[:3])
                if here != cell:
                    cell, own, tree = here, [], None
                ids, x = batch.column(4).slice(lo, hi - lo).to_numpy(), _matrix(batch.column(5).slice(lo, hi - lo))
                if not keys[3][lo]:  # vectors come before queries
                    own.append((ids, x))
                    continue
                if not own:
                    continue
                tree = tree or Tree(*map(np.concatenate, zip(*own, strict=True)))
                row, vec, d = tree.search(ids, x, k, factor, batch.column(6).slice(lo, hi - lo).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(vec), pa.array(d)], ["query_id", "vec_id", "score"])

    parts = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cells = both.repartition(parts, "dim", "shard", "salt").sortWithinPartitions("dim", "shard", "salt", "ask", "id")
    return cells.mapInArrow(lean(run), "query_id long, vec_id long, score double")


def _best(hits: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return hits.withColumn("rank", place).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = FACTOR, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector of queries the k nearest found of vectors. Both have vec_id and embedding."""

    def ready(df: DataFrame) -> DataFrame:
        rows = df.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
        rows = rows.where(F.col("id").isNotNull() & _usable(F.col("vector")))
        if not rows.groupBy("id").count().where("count > 1").isEmpty():
            rows = rows.groupBy("id").agg(F.min("vector").alias("vector"))
        return rows.withColumn("dim", F.size("vector"))

    rows, asked = ready(vectors), ready(queries)
    n = max(1, rows.count())
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / n) * (1 << 30))).limit(2 * SAMPLE).toArrow()
    by_dim: dict[int, list] = {}
    for i, dim in enumerate(sample.column("dim").to_pylist()):
        by_dim.setdefault(dim, []).append(i)
    regions, size = {}, max(shard, -(-n // SHARDS))
    for dim, places in by_dim.items():
        own = sample.take(places).sort_by("id")  # the tree doesn't depend on the order of rows
        regions[dim] = Regions(_matrix(own.column("vector").combine_chunks()), -(-n * len(places) // (size * sample.num_rows)))
    sent = rows.sparkSession.sparkContext.broadcast(regions)  # fewer than SHARDS vantage points for each dimension in the sample

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = batch.column(2).to_numpy()
            leaves = [sent.value[int(dims[lo])].leaf_of(_matrix(batch.column(1).slice(lo, hi - lo))) if int(dims[lo]) in sent.value else np.zeros(hi - lo, np.int32) for lo, hi in _runs(dims)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(leaves))], ["id", "vector", "dim", "shard"])

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "vector", "dim", "shard", "bound"]
        for batch in (b.slice(i, 1000) for b in batches for i in range(0, b.num_rows, 1000)):
            dims, home, bound = (batch.column(c).to_numpy() for c in (2, 3, 4))
            for lo, hi in _runs(dims):
                if int(dims[lo]) not in sent.value:
                    continue  # its one shard is its home
                for leaf, own in sent.value[int(dims[lo])].reached(_matrix(batch.column(1).slice(lo, hi - lo)), bound[lo:hi], factor):
                    own = own[home[lo:hi][own] != leaf] + lo
                    if own.size:
                        part = batch.take(pa.array(own))
                        yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(np.full(own.size, leaf, np.int32)), part.column(4)], names)

    shape = "id long, vector array<double>, dim int, shard int"
    placed = checkpoint(rows.mapInArrow(dealt, shape))
    cells = placed.groupBy("dim", "shard").agg(F.ceil(F.count("*") / (2 * size)).cast("int").alias("salts"))
    vectors = placed.join(cells, ["dim", "shard"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    to_all = lambda df: df.join(cells, ["dim", "shard"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    asked = checkpoint(asked.mapInArrow(dealt, shape))
    first = checkpoint(_best(_found(vectors, to_all(asked).withColumn("bound", F.lit(float("inf"))), k, factor), k))
    bounds = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("bound"))
    open_ = asked.join(bounds, "id", "left").select("id", "vector", "dim", "shard", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    more = _found(vectors, to_all(open_.mapInArrow(routed, f"{shape}, bound double")), k, factor)
    return _best(first.drop("rank").unionByName(more), k).select("query_id", "rank", "vec_id", "score")


def hundredth(vectors: DataFrame, k: int = 10, factor: float = FACTOR) -> DataFrame:
    """The nearest of every vector whose id is divisible by 100."""
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), k, factor)
