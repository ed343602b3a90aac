"""A stored inverted-file index for approximate vector search.

Building: coarse centres and, per sub-space, codebooks of the residuals are fitted on a
bounded sample; then every row of the corpus is written once, below the folder of its
nearest centre, with one byte per sub-space and its vector.

The number of cells to visit and of rows to measure again follow the data: a bounded
sample of rows is searched exactly while the index is built. ``probes`` is how many nearest
cells hold the wanted share of their true neighbours, ``rerank`` how many rows of these
cells, by approximate distance, do.

Searching: a query visits the ``probes`` nearest cells. Only their folders are listed, and
of them only ids and codes are read; a table per (query, cell) turns codes into
approximate distances. The ``rerank`` best of each query are measured again on their
vectors, read from the folders of the cells they lie in. The corpus is never scanned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from rasterloom.operators.search import knn
from rasterloom.operators.vector_join import distances, matrix
from rasterloom.plans.scratch import materialise

SAMPLE, CODES, ROUNDS = 50_000, 256, 8
FITTED_BYTES = 64 << 20
SAMPLE_BYTES, LEAST_MEMBERS = 64 << 20, 8  # of the sample on the driver, and its rows per cell at least
BLOCK_BYTES = 16 << 20  # distances in memory at a time
QUERY_BLOCK = 4_096
ROWS_PER_FILE = 500_000
TRIALS = 256


@dataclass(frozen=True)
class Index:
    """Where the cells lie, the fitted centres (cells x d) and codebooks (m x codes x d/m), and how many cells and exact distances a query needs."""

    path: str
    centres: np.ndarray
    books: np.ndarray
    probes: int
    rerank: int = 200


def _blocks(rows: np.ndarray, centres: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Distances of all rows to all centres, some rows at a time: memory does not follow rows times centres."""
    stride = max(1, BLOCK_BYTES // (8 * len(centres)))
    for lo in range(0, len(rows), stride):
        at = slice(lo, min(lo + stride, len(rows)))
        yield at, distances(rows[at], centres)


def _nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest centre and its distance."""
    own, away = np.empty(len(rows), np.int64), np.empty(len(rows))
    for at, far in _blocks(rows, centres):
        own[at] = np.argmin(far, axis=1)
        away[at] = far[np.arange(len(far)), own[at]]
    return own, away


def _fit(rows: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centres of a sample by k-means; a centre that loses its rows starts again at a far row."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), min(k, len(rows)), replace=False)].copy()
    for _ in range(ROUNDS):
        own, away = _nearest(rows, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        lost = np.flatnonzero(counts == 0)
        if len(lost):
            centres[lost] = rows[np.argsort(-away)[: len(lost)]]
    return centres


def _codes(residual: np.ndarray, books: np.ndarray) -> np.ndarray:
    m, _, width = books.shape
    return np.stack([_nearest(residual[:, j * width : (j + 1) * width], books[j])[0] for j in range(m)], axis=1).astype(np.uint8)


def _about(rest: np.ndarray, books: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared approximate distances of queries, less the centre of a cell, to coded rows of this cell."""
    width = books.shape[2]
    about = np.zeros((len(rest), len(codes)))
    for j, book in enumerate(books):
        about += (distances(rest[:, j * width : (j + 1) * width], book) ** 2)[:, codes[:, j]]
    return about


def _unpacked(codes, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(-1, parts)


def _visitors(near: np.ndarray) -> dict[int, np.ndarray]:
    """The queries (rows of ``near``) that visit each cell."""
    by_cell = np.argsort(near, axis=None, kind="stable")
    met, first = np.unique(near.ravel()[by_cell], return_index=True)
    return {int(c): who for c, who in zip(met, np.split(by_cell // near.shape[1], first[1:]), strict=True)}


def _nearest_cells(queries: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    return np.concatenate([np.argsort(far, axis=1, kind="stable")[:, :probes] for _, far in _blocks(queries, centres)])


def _whole(table: DataFrame) -> DataFrame:
    return table.where(F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x)))


def build_index(
    corpus: DataFrame, path: str, cells: int | None = None, parts: int = 8, sample: int = SAMPLE, corpus_id: str = "vec_id", vec: str = "vec", seed: int = 7,
    share: float = 0.97,
) -> Index:
    """Fit on about ``sample`` rows, write every row; vectors that are NULL or hold NULLs are left out.

    ``cells`` defaults to four times the square root of the row count, within the
    memory that centres may take in every task. The sample has 40 rows a cell or more, but
    no more than ``SAMPLE_BYTES`` of vectors; on tables so large that this leaves fewer than
    ``LEAST_MEMBERS`` a cell there are fewer cells. ``parts`` must divide the length;
    ``share`` of the true neighbours of some ``TRIALS`` rows lie in the cells a search visits,
    and as large a share of these among the rows it measures again.
    """
    spark = corpus.sparkSession
    rows = _whole(corpus.select(F.col(corpus_id).alias("id"), F.col(vec).cast("array<double>").alias("vec")))
    size = rows.agg(F.count("*").alias("n"), F.min(F.size("vec")).alias("lo"), F.max(F.size("vec")).alias("d")).first()
    if not size.n:
        raise ValueError("nothing to index")
    if size.lo != size.d or size.d % parts:
        raise ValueError(f"vectors of length {size.lo} to {size.d} cannot be cut into {parts} parts")
    most = max(1, SAMPLE_BYTES // (8 * size.d))
    bound = max(1, min(FITTED_BYTES // (8 * size.d), most // LEAST_MEMBERS))
    wanted = min(cells or math.ceil(4 * math.sqrt(size.n)), bound)
    drawn_rows = min(max(sample, 40 * wanted), most)
    rate = min(1.0, drawn_rows / size.n)
    draw = F.xxhash64("id", F.lit(seed)).bitwiseAND(F.lit((1 << 31) - 1)) / float(1 << 31)
    taken = rows.where(draw < rate).orderBy("id").limit(2 * drawn_rows).select("vec").toArrow()
    drawn = matrix(taken.column("vec")) if taken.num_rows else matrix(rows.limit(1).toArrow().column("vec"))
    centres = _fit(drawn, wanted, seed)
    residual = drawn - centres[_nearest(drawn, centres)[0]]
    width = size.d // parts
    books = np.zeros((parts, CODES, width))
    for j in range(parts):
        book = _fit(residual[:, j * width : (j + 1) * width], CODES, seed + 1 + j)
        books[j, : len(book)] = book
        books[j, len(book) :] = book[0]
    shared = spark.sparkContext.broadcast((centres, books))
    schema = T.StructType([rows.schema["id"], rows.schema["vec"], T.StructField("codes", T.BinaryType()), T.StructField("cell", T.IntegerType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_centres, own_books = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            m = matrix(batch.column("vec"))
            cell, _ = _nearest(m, own_centres)
            codes = _codes(m - own_centres[cell], own_books)
            packed = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vec"), packed, pa.array(cell, pa.int32())], names=["id", "vec", "codes", "cell"])

    # crowded cells go to several tasks, small ones share one
    rows.mapInArrow(encode, schema).hint("rebalance", "cell").write.option("compression", "zstd").option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy("cell").parquet(f"{path}/cells")
    probes, rerank = _effort(rows, path, centres, books, share, seed)
    fitted = [("probes", probes, 0, []), ("rerank", rerank, 0, [])] + [("centre", i, 0, c.tolist()) for i, c in enumerate(centres)] + [("book", j, c, v.tolist()) for j, b in enumerate(books) for c, v in enumerate(b)]
    spark.createDataFrame(fitted, "kind string, a int, b int, vec array<double>").coalesce(1).write.parquet(f"{path}/fitted")
    return Index(path, centres, books, probes, rerank)


def _effort(rows: DataFrame, path: str, centres: np.ndarray, books: np.ndarray, share: float, seed: int) -> tuple[int, int]:
    """How many nearest cells hold ``share`` of the true neighbours of a few rows, and how many of their rows to measure again for as large a share of these."""
    spark = rows.sparkSession
    queries = rows.orderBy(F.xxhash64("id", F.lit(seed + 99))).limit(TRIALS).select(F.col("id").alias("query_id"), "vec")
    queries = materialise(queries, "index-trials").dropDuplicates(["query_id"])
    true = knn(rows.withColumnRenamed("id", "vec_id"), queries, 10).select("query_id", F.col("neighbour_id").alias("id"))
    cells = spark.read.parquet(f"{path}/cells").select("id", "codes", "cell")
    found = true.join(cells, "id").join(queries, "query_id").orderBy("query_id").select("query_id", "vec", "cell", "codes").toArrow()  # ten rows a trial
    if not found.num_rows:
        return 1, Index.rerank
    asked, held = matrix(found.column("vec")), np.asarray(found.column("cell"))
    rank = np.empty(len(asked), np.int64)
    for at, far in _blocks(asked, centres):
        rank[at] = (far < far[np.arange(len(far)), held[at]][:, None]).sum(axis=1) + 1
    probes = int(np.quantile(rank, share, method="higher"))
    kept = np.flatnonzero(rank <= probes)
    asked, held, codes = asked[kept], held[kept], _unpacked(found.column("codes"), len(books))[kept]
    limit = np.array([_about(asked[i : i + 1] - centres[held[i]], books, codes[i : i + 1])[0, 0] for i in range(len(kept))])
    ids = found.column("query_id").take(pa.array(kept)).to_pylist()
    first = [i for i in range(len(ids)) if not i or ids[i] != ids[i - 1]]  # a trial's neighbours stand together
    spans = np.array([*first, len(ids)])
    shared = spark.sparkContext.broadcast((centres, books, asked[first], limit, spans, _visitors(_nearest_cells(asked[first], centres, probes))))

    def nearer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_centres, own_books, trials, limits, at, who = shared.value
        counts = np.zeros(len(limits), np.int64)
        for batch in batches:
            in_cell = batch.column("cell").to_numpy(zero_copy_only=False)
            coded = _unpacked(batch.column("codes"), len(own_books))
            for cell in np.unique(in_cell):
                asking = who.get(int(cell), ())
                if len(asking):
                    about = np.sort(_about(trials[asking] - own_centres[cell], own_books, coded[in_cell == cell]), axis=1)
                    for t, line in zip(asking, about, strict=True):
                        counts[at[t] : at[t + 1]] += np.searchsorted(line, limits[at[t] : at[t + 1]] * (1 - 1e-9))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts)), pa.int32()), pa.array(counts)], names=["i", "n"])

    place = cells.select("codes", "cell").mapInArrow(nearer, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    return probes, max(Index.rerank, int(np.quantile(place.column("n").to_numpy(), share, method="higher")) + 1)


def open_index(spark: SparkSession, path: str) -> Index:
    """An index built earlier; only what was fitted is read."""
    rows = sorted(spark.read.parquet(f"{path}/fitted").collect(), key=lambda r: (r.kind, r.a, r.b))
    centres = np.array([r.vec for r in rows if r.kind == "centre"])
    books = np.array([r.vec for r in rows if r.kind == "book"])
    needs = {r.kind: r.a for r in rows if r.kind in ("probes", "rerank")}
    return Index(path, centres, books.reshape(-1, CODES, books.shape[1]), **needs)


def _cells(spark: SparkSession, index: Index, wanted: list[int], columns: str) -> DataFrame:
    """Some cells of the index; other folders are neither listed nor read."""
    paths = [f"{index.path}/cells/cell={c}" for c in wanted]
    return spark.read.schema(columns).option("basePath", f"{index.path}/cells").parquet(*paths)


def search_index(index: Index, queries: DataFrame, k: int, id_type: T.DataType, probes: int | None = None, rerank: int | None = None, query_id: str = "query_id", vec: str = "vec") -> DataFrame:
    """Approximate k nearest rows: (query_id, neighbour_id, distance, rank); distances are exact.

    Queries travel to the tasks in blocks; each block reads the cells it probes.
    """
    spark, probes, rerank = queries.sparkSession, probes or index.probes, rerank or index.rerank
    asked = _whole(queries.select(F.col(query_id).alias("query_id"), F.col(vec).cast("array<double>").alias("vec")))
    few = asked.limit(QUERY_BLOCK + 1).toArrow()
    schema = T.StructType([asked.schema["query_id"], T.StructField("neighbour_id", id_type), T.StructField("distance", T.DoubleType())])
    if few.num_rows <= QUERY_BLOCK:
        found = _search_block(spark, index, few, k, id_type, probes, rerank, schema)
    else:
        asked = materialise(asked, "index-queries")
        blocks = 2 * -(-asked.count() // QUERY_BLOCK)
        found = None
        for b in range(blocks):
            block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
            part = materialise(_search_block(spark, index, block, k, id_type, probes, rerank, schema), "index-answers")
            found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(spark, index: Index, block: pa.Table, k: int, id_type, probes: int, rerank: int, schema: T.StructType) -> DataFrame:
    if not block.num_rows:
        return spark.createDataFrame([], schema)
    q = matrix(block.column("vec"))
    present = _present(spark, index)
    visitors = {c: who for c, who in _visitors(_nearest_cells(q, index.centres, probes)).items() if c in present}
    shared = spark.sparkContext.broadcast((index.centres, index.books, q, visitors))
    names = T.StructType([T.StructField("q", T.IntegerType()), T.StructField("id", id_type), T.StructField("cell", T.IntegerType()), T.StructField("about", T.DoubleType())])
    arrow_id = to_arrow_type(id_type)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, books, own, who = shared.value
        for batch in batches:
            cells = batch.column("cell").to_numpy(zero_copy_only=False)
            codes = _unpacked(batch.column("codes"), len(books))
            for cell in np.unique(cells):
                rows = np.flatnonzero(cells == cell)
                asking = who.get(int(cell), ())
                if not len(asking):
                    continue
                about = _about(own[asking] - centres[cell], books, codes[rows])
                kept = min(rerank, len(rows))
                best = np.argpartition(about, kept - 1, axis=1)[:, :kept]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(asking, kept), pa.int32()), batch.column("id").take(pa.array(rows[best].ravel())), pa.array(np.full(best.size, cell), pa.int32()),
                     pa.array(np.take_along_axis(about, best, axis=1).ravel())],
                    names=["q", "id", "cell", "about"],
                )

    id_ddl = f"id {id_type.simpleString()}"
    rough = _cells(spark, index, sorted(visitors), f"{id_ddl}, codes binary, cell int").select("id", "codes", "cell").mapInArrow(scan, names)
    order = Window.partitionBy("q").orderBy("about", "id")
    short = materialise(rough.withColumn("r", F.row_number().over(order)).where(F.col("r") <= rerank).select("q", "id", "cell"), "index-shortlist")
    hit = sorted(r.cell for r in short.select("cell").distinct().collect())  # at most one row a cell
    vectors = _cells(spark, index, hit, f"{id_ddl}, vec array<double>, cell int").join(short.select("id", "cell").distinct(), ["id", "cell"], "left_semi")
    pairs = short.join(vectors, ["id", "cell"])
    qids = block.column("query_id").to_pylist()

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, own, _ = shared.value
        for batch in batches:
            if batch.num_rows:
                at = batch.column("q").to_numpy()
                d = np.sqrt(((matrix(batch.column("vec")) - own[at]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array([qids[i] for i in at], to_arrow_type(schema[0].dataType)), batch.column("id").cast(arrow_id), pa.array(d)], names=schema.names)

    return pairs.select("q", "id", "vec").mapInArrow(measure, schema)


def _present(spark: SparkSession, index: Index) -> set[int]:
    """Cells that hold rows, from the folder names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{index.path}/cells")
    store = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in store.listStatus(hadoop)]
    return {int(n.split("=")[1]) for n in names if n.startswith("cell=")}
