"""Exact nearest-neighbour join of two large vector tables, by cells around pivots.

1. Pivots are a bounded sample of the corpus. Every corpus row belongs to the cell of its
   nearest pivot; a cell is known by its row count and radius.
2. Every query first meets its own cell. The k-th distance found there bounds the true one.
3. A query goes on to another cell only if the triangle inequality (radius of the cell) or
   the plane halfway between the two pivots leaves room within that bound.

A cell of many rows is cut into corpus blocks, and the queries that visit it into query
blocks; a task multiplies one of each. Blocks are numbered by hash, so neither a
crowded cell nor a popular one lands in one task, and both tables are read a constant
number of times, however many queries there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rasterloom.plans.scratch import materialise

CORPUS_BLOCK, QUERY_BLOCK = 20_000, 4_096
PIVOT_BYTES, PIVOTS = 16 << 20, 1_024
STRIDE = 512


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """List column of equal lengths to a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if n and (lengths != lengths[0]).any():
        raise ValueError(f"vectors of different lengths in one search: {sorted(set(lengths.tolist()))[:5]}")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1 if n else 0)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by a matrix product; right up to rounding."""
    sq = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(sq, 0.0))


def slack(*values: np.ndarray) -> float:
    """More than the rounding error of ``distances`` between vectors of these sizes."""
    size = max((float(np.sqrt((v * v).sum(axis=1).max())) for v in values if len(v)), default=0.0)
    return 1e-6 * (1.0 + size)


def best_rows(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, exact) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query the k nearest rows, ties by id: everything within rounding of the k-th is measured again by ``exact``."""
    for lo in range(0, len(queries), STRIDE):
        part = queries[lo : lo + STRIDE]
        far = distances(part, rows)
        kth = min(k, len(rows)) - 1
        edge = np.partition(far, kth, axis=1)[:, kth] + slack(part, rows)
        for i in range(len(part)):
            near = np.flatnonzero(far[i] <= edge[i])
            d, found = exact(part[i], rows[near]), ids[near]
            order = np.lexsort((found, d))[:k]
            yield lo + i, d[order], found[order]


def euclidean(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - query) ** 2).sum(axis=1))


def one_minus_dot(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return 1.0 - rows @ query


def _assigned(table: DataFrame, pivots, own: str) -> DataFrame:
    """The table with its nearest pivot as ``cell`` and the distance to it as ``away``."""
    schema = T.StructType([*table.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = matrix(batch.column("vec"))
                if m.shape[1] != pivots.value.shape[1]:
                    raise ValueError(f"{own} vectors of length {m.shape[1]}, others of length {pivots.value.shape[1]}")
                far = distances(m, pivots.value)
                cell = np.argmin(far, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell, pa.int32()), pa.array(far[np.arange(len(m)), cell])], names=[*batch.schema.names, "cell", "away"]
                )

    return table.mapInArrow(run, schema)


def _visits(queries: DataFrame, pivots, radii) -> DataFrame:
    """(query_id, vec, visit): the cells other than its own that may hold a nearer row than ``bound``."""
    schema = T.StructType([queries.schema["query_id"], queries.schema["vec"], T.StructField("visit", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = distances(pivots.value, pivots.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, STRIDE):
                part = batch.slice(lo, STRIDE)
                m = matrix(part.column("vec"))
                own = part.column("cell").to_numpy()
                bound = part.column("bound").to_numpy()
                far = distances(m, pivots.value)
                room = slack(m, pivots.value)
                home = far[np.arange(len(m)), own][:, None]
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (far**2 - home**2) / (2 * between[own])
                plane = np.where(between[own] > room, plane, 0.0)  # twins of a pivot share their cell's rows
                least = np.maximum(far - radii.value[None, :], plane)
                go = least <= bound[:, None] + room * (1 + np.where(np.isfinite(least), np.abs(least), 0))
                go[np.arange(len(m)), own] = False
                go[:, radii.value < 0] = False
                q, cell = np.nonzero(go)
                for at in range(0, len(q), 4 * STRIDE):  # a query may visit every cell
                    rows = part.take(pa.array(q[at : at + 4 * STRIDE]))
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("query_id"), rows.column("vec"), pa.array(cell[at : at + 4 * STRIDE], pa.int32())], names=["query_id", "vec", "visit"]
                    )

    return queries.mapInArrow(run, schema)


def _meet(queries: DataFrame, corpus: DataFrame, sizes: DataFrame, k: int, exact, schema: T.StructType) -> DataFrame:
    """k best rows per query among the cells it visits, block by block."""
    loads = queries.groupBy("visit").agg(F.count("*").alias("q"))
    grid = materialise(
        sizes.join(loads, sizes["cell"] == loads["visit"]).select(
            "cell", F.ceil(F.col("n") / CORPUS_BLOCK).cast("int").alias("c_blocks"), F.ceil(F.col("q") / QUERY_BLOCK).cast("int").alias("q_blocks")
        ),
        "cell-grid",
    )
    left = queries.withColumnRenamed("visit", "cell").join(grid, "cell")
    left = left.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.col("q_blocks")).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.col("c_blocks") - 1)))
    right = corpus.join(grid, "cell")
    right = right.withColumn("cb", F.pmod(F.xxhash64("neighbour_id", "vec"), F.col("c_blocks")).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
    types = [to_arrow_type(f.dataType) for f in schema.fields]

    def multiply(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table([pa.array([], t) for t in types], names=schema.names)
        ids = b.column("neighbour_id").to_numpy()
        found = list(best_rows(matrix(a.column("vec")), matrix(b.column("vec")), ids, k, exact))
        take = np.repeat([i for i, _, _ in found], [len(d) for _, d, _ in found])
        return pa.table(
            [a.column("query_id").take(pa.array(take)), pa.array(np.concatenate([n for _, _, n in found]), types[1]), pa.array(np.concatenate([d for _, d, _ in found]))],
            names=schema.names,
        )

    key = ["cell", "cb", "qb"]
    pair = left.select(*key, "query_id", "vec").groupBy(*key).cogroup(right.select(*key, "neighbour_id", "vec").groupBy(*key))
    return pair.applyInArrow(multiply, schema)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn_join(corpus: DataFrame, queries: DataFrame, k: int, schema: T.StructType, unit: bool = False, pivots: int | None = None) -> DataFrame:
    """(query_id, neighbour_id, distance, rank) for tables (neighbour_id, vec) and (query_id, vec).

    With ``unit`` the vectors have length one and the distance is the cosine distance;
    the cells work with the Euclidean one, which orders rows alike.
    """
    spark = corpus.sparkSession
    exact = one_minus_dot if unit else euclidean
    corpus = materialise(corpus, "join-corpus")
    size = corpus.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    if not size.n:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())]))
    wanted = pivots or min(PIVOTS, max(1, PIVOT_BYTES // (8 * size.d)), math.ceil(size.n / 2_000))
    picked = corpus.orderBy(F.xxhash64("neighbour_id", F.lit(3)), "neighbour_id").limit(wanted).select("vec").toArrow()
    shared = spark.sparkContext.broadcast(np.unique(matrix(picked.column("vec")), axis=0))
    cells = materialise(_assigned(corpus, shared, "corpus"), "join-cells")
    sizes = materialise(cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("r")), "join-sizes")
    radii = np.full(len(shared.value), -1.0)
    for r in sizes.collect():  # one row a pivot
        radii[r.cell] = r.r
    spread = spark.sparkContext.broadcast(radii)
    asked = materialise(_assigned(queries, shared, "query"), "join-queries")
    home = _meet(asked.withColumn("visit", F.col("cell")).select("query_id", "vec", "visit"), cells.select("cell", "neighbour_id", "vec"), sizes, k, exact, schema)
    home = materialise(_top(home, k), "join-home")
    last = home.where(F.col("rank") == k).select("query_id", F.col("distance").alias("d"))
    bound = F.sqrt(F.greatest(2 * F.col("d"), F.lit(0.0))) if unit else F.col("d")
    bounded = asked.join(last, "query_id", "left").withColumn("bound", F.coalesce(bound, F.lit(math.inf)))
    visits = materialise(_visits(bounded.select("query_id", "vec", "cell", "bound"), shared, spread), "join-visits")
    away = _meet(visits, cells.select("cell", "neighbour_id", "vec"), sizes, k, exact, schema)
    return _top(home.drop("rank").unionByName(away), k)
