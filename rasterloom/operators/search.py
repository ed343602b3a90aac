"""Nearest-neighbour search over embedding tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rasterloom.functions.vectors import mean_vector
from rasterloom.operators.vector_join import knn_join
from rasterloom.plans.scratch import materialise
from rasterloom.plans.skew import salted_join

BLOCK_BYTES = 32 << 20  # query vectors shipped to every task at once
BLOCK_ROWS = 4096
STRIDE = 512  # queries multiplied with one Arrow batch at a time


def _matrix(column: pa.ChunkedArray | pa.Array, width: int | None) -> np.ndarray:
    """List column to a float64 matrix without a Python loop; the lists must have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if n and (lengths != lengths[0]).any():
        raise ValueError(f"vectors of different lengths in one search: {sorted(set(lengths.tolist()))[:5]}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(n, -1) if n else flat.reshape(0, width or 0)
    return rows if width is None else rows[:, :width]


def _exact(query: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return np.sqrt(((rows - query) ** 2).sum(axis=1))
    return 1.0 - rows @ query


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.sqrt((m**2).sum(axis=1, keepdims=True)), 1e-12)


def _scaled(table: DataFrame) -> DataFrame:
    """Vectors of length one, as ``_unit`` makes them."""
    norm = F.greatest(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v)), F.lit(1e-12))
    return table.withColumn("_norm", norm).withColumn("vec", F.transform("vec", lambda v: v / F.col("_norm"))).drop("_norm")


def _block_search(queries, k: int, metric: str, width: int | None, types: tuple[pa.DataType, pa.DataType]):
    """Task body: per query, the k best corpus rows of this partition.

    A matrix product gives approximate distances; every row within rounding
    error of the k-th best is measured again exactly, so ties end up in id order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = queries.value
        q_sq = (q**2).sum(axis=1)
        best: list[tuple] = [None] * len(q)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            m = _matrix(batch.column(1), width)
            if m.shape[1] != q.shape[1]:
                raise ValueError(f"corpus vectors of length {m.shape[1]}, queries of length {q.shape[1]}")
            if metric == "cosine":
                m = _unit(m)
            m_sq = (m**2).sum(axis=1)
            for lo in range(0, len(q), STRIDE):
                part = q[lo : lo + STRIDE]
                cross = part @ m.T
                far = (
                    q_sq[lo : lo + STRIDE, None] + m_sq[None, :] - 2 * cross if metric == "l2" else 1.0 - cross
                )
                kth = min(k, far.shape[1]) - 1
                edge = np.partition(far, kth, axis=1)[:, kth]
                slack = 1e-9 * (1.0 + np.abs(edge) + m_sq.max() + q_sq[lo : lo + STRIDE])
                for i in range(len(part)):
                    near = np.flatnonzero(far[i] <= edge[i] + slack[i])
                    d, found = _exact(part[i], m[near], metric), ids[near]
                    held = best[lo + i]
                    if held is not None:
                        d, found = np.concatenate([held[0], d]), np.concatenate([held[1], found])
                    order = np.lexsort((found, d))[:k]
                    best[lo + i] = (d[order], found[order])
        for i, held in enumerate(best):
            if held is not None:
                yield pa.RecordBatch.from_pydict(
                    {
                        "query_id": pa.array([qids[i]] * len(held[0]), types[0]),
                        "neighbour_id": pa.array(held[1], types[1]),
                        "distance": pa.array(held[0], pa.float64()),
                    }
                )

    return run


def _search(corpus: DataFrame, table: pa.Table, k: int, metric: str, width: int | None, schema) -> DataFrame:
    ids = table.column(0).to_pylist()
    if len(set(ids)) != len(ids):
        raise ValueError("a query id occurs more than once")
    q = _matrix(table.column(1), width)
    if metric == "cosine":
        q = _unit(q)
    shipped = corpus.sparkSession.sparkContext.broadcast((ids, q))
    types = (to_arrow_type(schema[0].dataType), to_arrow_type(schema[1].dataType))
    local = corpus.mapInArrow(_block_search(shipped, k, metric, width, types), schema)
    order = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def knn(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    corpus_id: str = "vec_id",
    query_id: str = "query_id",
    vec: str = "vec",
    metric: str = "l2",
    prefix: int | None = None,
    block_bytes: int = BLOCK_BYTES,
    pivots: int | None = None,
) -> DataFrame:
    """Exact k nearest corpus rows per query: (query_id, neighbour_id, distance, rank).

    Rows whose vector is NULL or holds a NULL take no part, on either side.
    Vectors of different lengths and query ids that occur twice are errors.

    The corpus never moves: each partition keeps its k best per query and only
    those are shuffled. Query vectors that fit one block (checked in rows and
    bytes, in one pass) travel to the tasks. More queries than that are joined with
    the corpus by cells around pivots (``vector_join``): both tables are read a
    constant number of times and a task holds one block of each.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric {metric}")
    corpus = corpus.select(F.col(corpus_id).alias("neighbour_id"), F.col(vec).cast("array<double>").alias("vec"))
    queries = queries.select(F.col(query_id).alias("query_id"), F.col(vec).cast("array<double>").alias("vec"))
    schema = T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("neighbour_id", corpus.schema["neighbour_id"].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )
    whole = F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull())
    corpus, queries = corpus.where(whole), queries.where(whole)
    if prefix is not None:
        corpus = corpus.withColumn("vec", F.slice("vec", 1, prefix))
        queries = queries.withColumn("vec", F.slice("vec", 1, prefix))
    few = queries.limit(BLOCK_ROWS + 1).toArrow()
    if few.num_rows <= BLOCK_ROWS and few.nbytes <= block_bytes:
        return _search(corpus, few, k, metric, prefix, schema)
    queries = materialise(queries, "queries")
    if queries.groupBy("query_id").count().where("count > 1").limit(1).count():
        raise ValueError("a query id occurs more than once")
    if metric == "cosine":
        corpus, queries = _scaled(corpus), _scaled(queries)
    return knn_join(corpus, queries, k, schema, unit=metric == "cosine", pivots=pivots)


def reference_vectors(table: DataFrame, by: list[str], vec: str = "vec") -> DataFrame:
    """Mean vector of each reference set."""
    return table.groupBy(*by).agg(mean_vector(vec).alias("vec"))


def knn_filtered(
    corpus: DataFrame, references: DataFrame, k: int, by: str, predicate=None, corpus_id: str = "vec_id"
) -> DataFrame:
    """Neighbours of the mean of each reference set, among corpus rows that pass the predicate."""
    if predicate is not None:
        corpus = corpus.filter(predicate)
    return knn(corpus, reference_vectors(references, [by]), k, corpus_id=corpus_id, query_id=by)


def knn_from_points(hits: DataFrame, corpus: DataFrame, k: int, corpus_id: str = "vec_id") -> DataFrame:
    """For (point, patch) hits: neighbours of every patch hit, searched once per patch."""
    wanted = hits.select(corpus_id).distinct()
    queries = corpus.join(wanted, corpus_id, "left_semi").withColumn("query_id", F.col(corpus_id))
    found = knn(corpus, queries, k, corpus_id=corpus_id)
    return salted_join(hits, found.withColumnRenamed("query_id", corpus_id), [corpus_id])


def knn_prefix(corpus: DataFrame, queries: DataFrame, prefix: int, k: int, **kw) -> DataFrame:
    """Search on the leading ``prefix`` dimensions only."""
    return knn(corpus, queries, k, prefix=prefix, **kw)


def knn_lsh(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    radius: float,
    bucket_length: float,
    tables: int = 6,
    seed: int = 42,
    corpus_id: str = "vec_id",
    query_id: str = "query_id",
) -> DataFrame:
    """Approximate k nearest rows within ``radius``: candidates share a random-projection bucket.

    The candidate search is a hash equi-join between the corpus and the queries.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    left = corpus.select(F.col(corpus_id).alias("neighbour_id"), array_to_vector("vec").alias("features"))
    right = queries.select(F.col(query_id).alias("query_id"), array_to_vector("vec").alias("features"))
    lsh = BucketedRandomProjectionLSH(
        inputCol="features", outputCol="hashes", bucketLength=bucket_length, numHashTables=tables, seed=seed
    )
    pairs = lsh.fit(left).approxSimilarityJoin(left, right, radius, distCol="distance")
    found = pairs.select(
        F.col("datasetB.query_id").alias("query_id"), F.col("datasetA.neighbour_id").alias("neighbour_id"), "distance"
    )
    order = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
