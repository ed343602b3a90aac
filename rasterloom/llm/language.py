"""Language identification by the nearest of several centroids per language.

A text becomes a vector of its n-grams of two to four UTF-8 bytes: lower case, every run of
ASCII characters that are no letters one blank, hashed into ``2**DIM_BITS`` places,
``log(1 + count)`` times the inverse document frequency, scaled to length one.

``fit`` counts languages and document frequencies over all labelled rows. The centroids
come from a bounded sample, ``sample`` labelled documents of each language (smallest
draws by their id): k-means by cosine, at most ``clusters`` centroids a language, one
task a language. Each centroid keeps the distance (1 - cosine) that all but
one in a hundred of its own documents stay within.

``identify`` gives the language of the nearest centroid (``near``), the cosine as
``score`` (0 to 1) and ``rejected``: the distance is more than ``slack`` times that of the
centroid. Whole texts count, in slices of bounded size. Centroids travel to the tasks in
blocks of ``BLOCK`` (64 MB); more than that, as in a table with a thousand labels, are
compared block after block, each pass keeping the best so far.

Defined cases: a text that is null or holds no letter (Unicode L) is ``und``, score 0, not
rejected; so is every text if nothing was learned. Rows without a language or
text teach nothing. Equal cosines go to the language that is less in byte order.
Repeated rows and ids get a row each; an empty table gives no rows; further columns
are left out unless named in ``keep``, and those of the result's names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.llm.common import slices
from rasterloom.plans.scratch import materialise

DIM_BITS = 13
DIMS = 1 << DIM_BITS
SIZES = (2, 3, 4)
SAMPLE, CLUSTERS, ROUNDS = 1000, 4, 12
SLACK, WITHIN = 1.25, 0.99
BLOCK = 1024  # centroids of 32 KB
ROWS, SLICE = 256, 2 << 20
UNKNOWN = "und"

LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def gram_counts(texts: list[str]) -> np.ndarray:
    """Hashed n-gram counts, one row a text (float32)."""
    parts = [b" " + t.lower().encode("utf-8", "replace").translate(LETTERS) + b" " for t in texts]
    flat = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    row = np.repeat(np.arange(len(parts), dtype=np.int64) << DIM_BITS, [len(p) for p in parts])
    # a second blank in a row ends a gram: neither runs of blanks nor two texts make one
    double = (flat[:-1] == 32) & (flat[1:] == 32)
    total = np.zeros(len(parts) * DIMS, dtype=np.int64)
    code, good = flat, np.ones(len(flat), dtype=bool)
    for n in range(2, SIZES[-1] + 1):
        code = (code[:-1] << np.uint32(8)) | flat[n - 1 :]
        good = good[:-1] & ~double[n - 2 :]
        if n in SIZES:
            place = ((code ^ np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - DIM_BITS)
            total += np.bincount((row[: len(place)] + place)[good], minlength=len(total))
    return total.reshape(len(parts), DIMS).astype(np.float32)


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Pieces of few rows and few bytes, so that the dense counts stay small."""
    for piece in slices(batch, "text", SLICE):
        for start in range(0, piece.num_rows, ROWS):
            yield piece.slice(start, ROWS)


def unit(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF vectors of length one; a zero vector stays zero."""
    v = np.log1p(counts) * idf
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.maximum(norm, 1e-12)


def cluster(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """At most ``k`` centroids of unit vectors by cosine, and the distance most of their own rows keep."""
    chosen = [0]
    best = rows @ rows[0]
    while len(chosen) < min(k, len(rows)):  # the row farthest from all chosen ones
        at = int(np.argmin(best))
        if best[at] > 1 - 1e-6:
            break
        chosen.append(at)
        best = np.maximum(best, rows @ rows[at])
    centres = rows[chosen].copy()
    for _ in range(rounds):
        own = np.argmax(rows @ centres.T, axis=1)
        sums = np.stack([rows[own == c].sum(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        new = sums / np.maximum(np.sqrt((sums * sums).sum(axis=1, keepdims=True)), 1e-12)
        if np.allclose(new, centres, atol=1e-6):
            break
        centres = new
    near = rows @ centres.T
    own = np.argmax(near, axis=1)
    full = [c for c in range(len(centres)) if (own == c).any()]
    reach = [float(np.quantile(1 - near[own == c, c], WITHIN)) for c in full]
    return centres[full], np.array(reach)


@dataclass
class Learned:
    """Inverse document frequencies, and the table of centroids: lang, cluster, reach, centre."""

    idf: np.ndarray
    centroids: DataFrame


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(DIMS, dtype=np.int64)
    for batch in batches:
        for piece in _blocks(batch):
            total += (gram_counts(piece.column("text").to_pylist()) > 0).sum(axis=0)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["dim", "n"])


def _vectors(idf):
    """Sparse unit vectors of the sampled documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _blocks(batch):
                v = unit(gram_counts(piece.column("text").to_pylist()), idf.value)
                at = [np.flatnonzero(x).astype(np.int32) for x in v]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("lang"), piece.column("draw"), pa.array(at, pa.list_(pa.int32())), pa.array([x[i] for x, i in zip(v, at, strict=True)], pa.list_(pa.float32()))],
                    names=["lang", "draw", "at", "value"],
                )

    return run


def fit(labelled: DataFrame, sample: int = SAMPLE, clusters: int = CLUSTERS, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Learned:
    """Learn from the rows of ``labelled`` that have a language and a letter."""
    spark = labelled.sparkSession
    draw = F.xxhash64(F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).cast("binary")), F.col(f"`{text}`"))
    rows = labelled.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"), draw.alias("draw"))
    rows = rows.where(F.col("lang").isNotNull() & has_letter(F.col("text")))
    sizes = materialise(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    documents = sizes.agg(F.sum("n")).first()[0] or 0
    counts = rows.select("text").mapInArrow(_document_frequencies, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(DIMS)
    seen[np.asarray(counts.column("dim"), dtype=np.int64)] = np.asarray(counts.column("n"))
    idf = (np.log((1 + documents) / (1 + seen)) + 1).astype(np.float32)
    shared = spark.sparkContext.broadcast(idf)
    # twice the wanted share by a hash, then the first ones of each language
    share = F.least(F.lit(1.0), F.lit(2.0 * sample) / F.col("n"))
    rate = F.col("draw").bitwiseAND(F.lit((1 << 31) - 1)) / float(1 << 31)
    some = rows.join(sizes, "lang").where((rate < share) | (F.col("n") <= 4 * sample)).select("lang", "text", "draw")
    vectors = some.mapInArrow(_vectors(shared), "lang string, draw long, at array<int>, value array<float>")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    taken = vectors.withColumn("rank", first).where(F.col("rank") <= sample)

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("draw")
        dense = np.zeros((table.num_rows, DIMS), dtype=np.float32)
        for i, (at, value) in enumerate(zip(table.column("at"), table.column("value"), strict=True)):
            dense[i, at.values.to_numpy()] = value.values.to_numpy()
        centres, reach = cluster(dense, clusters)
        n = len(centres)
        return pa.table(
            [pa.array([table.column("lang")[0].as_py()] * n), pa.array(np.arange(n), pa.int32()), pa.array(reach), pa.array(list(centres), pa.list_(pa.float32()))],
            names=["lang", "cluster", "reach", "centre"],
        )

    centroids = taken.groupBy("lang").applyInArrow(learn, "lang string, cluster int, reach double, centre array<float>")
    return Learned(idf, materialise(centroids, "centroids"))


def _nearest(shared, fields: list[str]):
    """Compare each text with one block of centroids; what an earlier block found stays if it is as near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, langs, reach, centres = shared.value
        for batch in batches:
            for piece in _blocks(batch):
                spoken = piece.column("_spoken").to_numpy(zero_copy_only=False)
                at = np.flatnonzero(spoken)
                near = piece.column("near").to_pylist()
                score = piece.column("score").to_numpy(zero_copy_only=False).copy()
                bound = piece.column("_reach").to_numpy(zero_copy_only=False).copy()
                if len(at):
                    # in double precision, so that a score does not depend on which rows and centroids meet in one product
                    cosine = unit(gram_counts(piece.column("text").take(pa.array(at)).to_pylist()), idf).astype(np.float64) @ centres.T
                    best = np.argmax(cosine, axis=1)
                    top = np.clip(np.round(cosine[np.arange(len(at)), best].astype(np.float64), 6), 0.0, 1.0)
                    for i, b, x in zip(at.tolist(), best.tolist(), top.tolist(), strict=True):
                        if near[i] is None or x > score[i]:
                            near[i], score[i], bound[i] = langs[b], x, reach[b]
                new = {"near": pa.array(near, pa.string()), "score": pa.array(score), "_reach": pa.array(bound)}
                yield pa.RecordBatch.from_arrays([new.get(n, piece.column(n)) for n in fields], names=fields)

    return run


def identify(docs: DataFrame, learned: Learned, text: str = "text", keep: tuple[str, ...] = ("doc_id",), slack: float = SLACK, block: int = BLOCK) -> DataFrame:
    """The ``keep`` columns with near (a learned language or ``und``), score and rejected."""
    spark = docs.sparkSession
    kept = {f"_keep{i}": name for i, name in enumerate(keep) if name not in ("near", "score", "rejected")}
    rows = docs.select(*[F.col(f"`{n}`").alias(a) for a, n in kept.items()], F.col(f"`{text}`").alias("text"))
    found = rows.select(
        *kept, "text", has_letter(F.col("text")).alias("_spoken"), F.lit(None).cast("string").alias("near"), F.lit(0.0).alias("score"), F.lit(0.0).alias("_reach")
    )
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in found.schema.fields])
    names = [(r.lang, r.cluster) for r in learned.centroids.select("lang", "cluster").collect()]  # two short values a centroid
    names.sort(key=lambda x: (x[0].encode(), x[1]))
    for start in range(0, len(names), block):
        low, high = names[start], names[min(start + block, len(names)) - 1]
        place = F.struct("lang", "cluster")
        edge = [F.struct(F.lit(x[0]).alias("lang"), F.lit(x[1]).cast("int").alias("cluster")) for x in (low, high)]
        own = sorted(learned.centroids.where((place >= edge[0]) & (place <= edge[1])).collect(), key=lambda r: (r.lang.encode(), r.cluster))
        shared = spark.sparkContext.broadcast((learned.idf, [r.lang for r in own], [r.reach for r in own], np.array([r.centre for r in own], dtype=np.float64)))
        found = found.mapInArrow(_nearest(shared, found.columns), schema)
        if start + block < len(names):
            found = materialise(found, "languages-so-far")
    far = (1 - F.col("score")) > slack * F.col("_reach")
    known = F.col("near").isNotNull()
    return found.select(*[F.col(a).alias(n) for a, n in kept.items()], F.coalesce("near", F.lit(UNKNOWN)).alias("near"), "score", (known & far).alias("rejected"))


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text leaves 1 by 3 (a null key counts as empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1
