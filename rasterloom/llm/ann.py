"""Nearest neighbours by vantage-point trees per shard.

A small tree over a bounded sample cuts the space into regions; every vector is
indexed in its region's shard, by a vantage-point tree of its own, and a region
that holds more rows than a task should is cut further by hash (so copies of one
vector spread out). A query is answered in two rounds: its own region first, which
gives the distance of the k-th hit, then every region that the triangle inequality
cannot exclude at that distance.

Both trees drop a branch if ``factor * bound >= distance of the k-th hit``, where
``bound`` is the triangle inequality's lower bound for the branch. Factor 1 is
exact; a larger one drops branches whose bound comes close, trading recall for
work. Distances are Euclidean, in double precision, on the original vectors.

Vectors that are null, zero, or hold null or non-finite components take no part,
nor do rows without an id.
Vectors of different lengths never meet. The query's own row, one row with its id and
its very vector, is no candidate; other rows of that id are. A repeated query id is
answered for each of its rows. Ties go to the smaller id. An empty table gives no
rows; further columns, whatever their names, are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.plans.scratch import materialise

FACTOR = 2.0
LEAF = 128
SAMPLE_PER_REGION = 16
HOMES_PER_TASK = 200_000
QUERIES_PER_TASK = 20_000
BLOCK_CELLS = 1 << 21
FOUND = "uid long, query_id long, vec_id long, score double"


def usable(vector: str) -> Column:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.empty((len(q), len(x)))
    step = max(1, BLOCK_CELLS // max(1, x.size))
    for at in range(0, len(q), step):
        out[at : at + step] = np.sqrt(((q[at : at + step, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    return out


@dataclass
class Region:
    """A split of the region tree, or a leaf (``shard`` >= 0)."""

    vantage: np.ndarray | None = None
    middle: float = 0.0
    near: "Region | None" = None
    far: "Region | None" = None
    shard: int = -1


def region_tree(sample: np.ndarray, depth: int, leaves: list[int]) -> Region:
    if depth and len(sample) > 1:
        vantage = sample[len(sample) // 2]
        d = distances(vantage[None], sample)[0]
        middle = float(np.sort(d)[(len(d) - 1) // 2])
        near = d <= middle
        if not near.all():
            return Region(vantage, middle, region_tree(sample[near], depth - 1, leaves), region_tree(sample[~near], depth - 1, leaves))
    leaves.append(len(sample))
    return Region(shard=len(leaves) - 1)


def regions(node: Region, x: np.ndarray, rows: np.ndarray, home: np.ndarray, reach: np.ndarray | None, factor: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, rows, whether it is their home): home shards only, or with ``reach`` all that lie within reach."""
    if not len(rows):
        return
    if node.shard >= 0:
        yield node.shard, rows, home
        return
    d = distances(x[rows], node.vantage[None])[:, 0]
    near = d <= node.middle
    for side, own, gap in ((node.near, near, d - node.middle), (node.far, ~near, node.middle - d)):
        open_ = own if reach is None else own | (gap * factor < reach[rows])
        yield from regions(side, x, rows[open_], home[open_] & own[open_], reach, factor)


class Best:
    """The k nearest hits of each query so far, nearest first, ties by id."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, k: int, reach: np.ndarray) -> None:
        self.queries, self.own, self.k = queries, own, k
        self.score = np.full((len(queries), k), np.inf)
        self.id = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.limit = reach

    def reach(self, rows: np.ndarray) -> np.ndarray:
        return np.minimum(self.score[rows, -1], self.limit[rows])

    def offer(self, rows: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> None:
        d = distances(self.queries[rows], vectors)
        d[(self.own[rows][:, None] == ids[None, :]) & (d == 0)] = np.inf  # twins of the own row are added in the end
        score = np.concatenate([self.score[rows], d], axis=1)
        names = np.concatenate([self.id[rows], np.broadcast_to(ids, d.shape)], axis=1)
        order = np.lexsort((names, score), axis=1)[:, : self.k]
        self.score[rows] = np.take_along_axis(score, order, axis=1)
        self.id[rows] = np.take_along_axis(names, order, axis=1)


def search_shard(vectors: np.ndarray, ids: np.ndarray, best: Best, factor: float) -> None:
    """Build the shard's tree while walking it: a branch that no query enters is never built."""

    def visit(points: np.ndarray, rows: np.ndarray) -> None:
        if not len(points) or not len(rows):
            return
        if len(points) <= LEAF:
            best.offer(rows, vectors[points], ids[points])
            return
        vantage = vectors[points[len(points) // 2]]
        d = distances(vantage[None], vectors[points])[0]
        middle = float(np.sort(d)[(len(d) - 1) // 2])
        near = d <= middle
        if near.all():  # equally far from here: take them in leaf-sized blocks
            for at in range(0, len(points), LEAF):
                best.offer(rows, vectors[points[at : at + LEAF]], ids[points[at : at + LEAF]])
            return
        inner, outer = points[near], points[~near]
        low, high = float(d[~near].min()), float(d[near].max())
        dq = distances(best.queries[rows], vantage[None])[:, 0]
        own = dq <= middle
        visit(inner, rows[own])
        visit(outer, rows[~own])
        more = rows[own]
        visit(outer, more[(low - dq[own]) * factor < best.reach(more)])
        more = rows[~own]
        visit(inner, more[(dq[~own] - high) * factor < best.reach(more)])

    visit(np.arange(len(ids)), np.arange(len(best.queries)))


def nearest_neighbours(
    vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = FACTOR, id_column: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` found for each row of ``queries``: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    narrow = lambda df: df.where(usable(vector) & F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")
    )
    corpus = narrow(vectors).withColumn("dim", F.size("v"))
    asked = materialise(narrow(queries).withColumn("dim", F.size("v")).withColumn("uid", F.monotonically_increasing_id()), "ann-queries")
    sizes = {r.dim: r.n for r in corpus.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row per vector length
    chunks = max(1, math.ceil(asked.count() / QUERIES_PER_TASK))
    trees: dict[int, Region] = {}
    layout: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
    tasks = 0
    for dim, n in sorted(sizes.items()):
        depth = math.ceil(math.log2(max(1.0, math.sqrt(n) / 32)))
        rate = min(1.0, SAMPLE_PER_REGION * 2**depth / n)
        order = F.xxhash64("vec_id", F.lit(5)).bitwiseAND(F.lit((1 << 31) - 1)) / float(1 << 31)
        taken = corpus.where((F.col("dim") == dim) & (order <= rate)).select("vec_id", "v").collect()
        sample = np.array([r.v for r in sorted(taken, key=lambda r: r.vec_id)], dtype=float).reshape(-1, dim)
        leaves: list[int] = []
        trees[dim] = region_tree(sample, depth, leaves)
        splits = np.maximum(1, np.ceil(np.array(leaves) / max(rate, 1e-12) / HOMES_PER_TASK)).astype(np.int64)
        layout[dim] = (tasks, np.concatenate([[0], np.cumsum(splits)[:-1]]), splits)
        tasks += int(splits.sum())
    shared = spark.sparkContext.broadcast((trees, layout))  # a bounded sample's worth

    def send(batches: Iterator[pa.RecordBatch], round_: int) -> Iterator[pa.RecordBatch]:
        own_trees, own_layout = shared.value
        for b in batches:
            dims = np.asarray(b.column("dim"))
            for dim in np.unique(dims):
                if dim not in own_trees:
                    continue
                part = b.filter(pa.array(dims == dim))
                x = np.asarray(part.column("v").flatten()).reshape(-1, dim)
                reach = np.asarray(part.column("reach")) if round_ == 2 else None
                first, starts, splits = own_layout[dim]
                for shard, rows, home in regions(own_trees[dim], x, np.arange(len(x)), np.ones(len(x), bool), reach, factor):
                    if round_ == 2:
                        rows = rows[~home]
                    if not len(rows):
                        continue
                    own = part.take(pa.array(rows))
                    n = int(splits[shard])
                    if round_ == 0:
                        salt = np.asarray(own.column("uid")) % n
                        for chunk in range(chunks):
                            yield _tagged(own, (first + starts[shard] + salt) * chunks + chunk)
                    else:
                        chunk = np.asarray(own.column("uid")) % chunks
                        for split in range(n):
                            yield _tagged(own, (first + starts[shard] + split) * chunks + chunk)

    columns = "task long, uid long, vec_id long, v array<double>, reach double"

    def sent(df: DataFrame, round_: int) -> DataFrame:
        return df.mapInArrow(lambda batches: send(batches, round_), columns)

    def search(table: pa.Table) -> pa.Table:
        home = np.asarray(table.column("reach").is_null(), dtype=bool)
        homes, own = table.filter(pa.array(home)), table.filter(pa.array(~home))
        if not len(homes) or not len(own):
            return _found([], [], [], [])
        x = np.asarray(homes.column("v").combine_chunks().flatten()).reshape(len(homes), -1)
        q = np.asarray(own.column("v").combine_chunks().flatten()).reshape(len(own), -1)
        ids = np.asarray(homes.column("vec_id"), dtype=np.int64)
        named = np.asarray(own.column("vec_id"), dtype=np.int64)
        best = Best(q, named, k, np.asarray(own.column("reach"), dtype=float))
        search_shard(x, ids, best, factor)
        hit = np.isfinite(best.score)
        row = np.nonzero(hit)[0]
        return _found(np.asarray(own.column("uid"))[row], named[row], best.id[hit], best.score[hit])

    homes = sent(corpus.select("dim", F.monotonically_increasing_id().alias("uid"), "vec_id", "v", F.lit(None).cast("double").alias("reach")), 0)
    everywhere = F.lit(float("inf"))
    first_queries = sent(asked.select("dim", "uid", "vec_id", "v", everywhere.alias("reach")), 1)
    first = materialise(homes.unionByName(first_queries).groupBy("task").applyInArrow(search, FOUND), "ann-first")
    limit = first.groupBy("uid").agg(F.sort_array(F.collect_list("score")).alias("s")).select(
        "uid", F.when(F.size("s") >= k, F.element_at("s", k)).alias("kth")
    )
    wider = asked.join(limit, "uid", "left").select("dim", "uid", "vec_id", "v", F.coalesce("kth", everywhere).alias("reach"))
    second = homes.unionByName(sent(wider, 2)).groupBy("task").applyInArrow(search, FOUND)
    # rows of a query's id and vector beyond the own one; -0.0 is as near as 0.0
    print_ = F.xxhash64(F.transform("v", lambda x: x + F.lit(0.0)))
    twins = (
        corpus.join(asked.select("vec_id").distinct(), "vec_id", "left_semi").groupBy("vec_id", print_.alias("p"))
        .agg((F.count("*") - 1).cast("int").alias("n")).where("n > 0")
    )
    again = asked.select("uid", "vec_id", print_.alias("p")).join(twins, ["vec_id", "p"]).select(
        "uid", F.col("vec_id").alias("query_id"), "vec_id", F.explode(F.array_repeat(F.lit(0.0), F.least("n", F.lit(k)))).alias("score")
    )
    by_query = Window.partitionBy("uid").orderBy("score", "vec_id")
    return (
        first.unionByName(second).unionByName(again).withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _tagged(own: pa.RecordBatch, task: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.broadcast_to(task, own.num_rows), pa.int64()), own.column("uid"), own.column("vec_id"), own.column("v"), own.column("reach")],
        names=["task", "uid", "vec_id", "v", "reach"],
    )


def _found(uid, query, vec, score) -> pa.Table:
    return pa.table({"uid": pa.array(uid, pa.int64()), "query_id": pa.array(query, pa.int64()), "vec_id": pa.array(vec, pa.int64()), "score": pa.array(score, pa.float64())})
