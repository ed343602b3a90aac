"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space that separates words everywhere here: \x20 and \x09-\x0D.
# It is exactly what bytes.split() and bytes.strip() take for white space.
BLANKS = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 4 << 20
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2_000


def small_batches(df: DataFrame) -> DataFrame:
    """The table, its session set to Arrow batches of at most ``BATCH_ROWS`` rows.

    A batch is counted in rows, not bytes, and is held whole by the JVM and by the
    Python worker; rows with texts are long.
    """
    spark = df.sparkSession
    if not 0 < int(spark.conf.get(BATCH_SETTING)) <= BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    return df


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``limit`` bytes of ``column`` at most.

    A single value above the limit makes a piece of its own, so the memory of a
    worker follows the longest text and not the number of rows in a batch.
    """
    sizes = byte_lengths(batch.column(column))
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def byte_lengths(array: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(pc.binary_length(array), 0), dtype=np.int64)


def as_bytes(array: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in array.cast(pa.binary()).to_pylist()]


def as_texts(array: pa.Array) -> list[str]:
    return [x or "" for x in array.to_pylist()]


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, whatever else the table carries."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def whole_number(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("long")


def word_count(text: Column | str) -> Column:
    """Number of words of a text as a column (null: 0), inside the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a fixed scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
