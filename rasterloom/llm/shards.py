"""Contiguous shards of nearly equal bytes from global prefix sums.

The order is ascending ``doc_id`` (null first), then checksum and size. A range
shuffle of narrow rows (no text) puts the order into partitions; each partition's
total bytes and rows give its offset, and inside a partition a running sum
places every row. A row goes to the shard in which the middle of its bytes
falls when the whole is cut at equal targets, so a cut always takes the nearer
of the two possible places.

Null texts have no bytes. Equal rows are interchangeable: they share the sort
key and only their sum matters. A random last key keeps equal ids from meeting in
one partition. An empty table gives no rows. A text of any length is one row, and
may be longer than a shard, which then holds it alone or with its neighbours' rows;
further columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OVERHEAD = 16


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage and keep the partitions as they are, in the shared folder."""
    from rasterloom.plans.scratch import scratch_root

    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(scratch_root(df.sparkSession))
    return df.checkpoint(eager=True)


def byte_shards(docs: DataFrame, shards: int = 40, overhead: int = OVERHEAD) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, global row number ``at``, bytes before it, shard, slot."""
    raw = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.length(raw) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.monotonically_increasing_id().alias("salt"),
    )
    order = ["doc_id", "text_crc32", "size", "salt"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(
        narrow.repartitionByRange(parts, *[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .select("doc_id", "size", "text_crc32", F.spark_partition_id().alias("part"))
    )
    totals = ranged.groupBy("part").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()  # a row per partition
    offsets, bytes_before, rows_before = {}, 0, 0
    for t in sorted(totals):
        offsets[t.part] = (bytes_before, rows_before)
        bytes_before, rows_before = bytes_before + t.size, rows_before + t.n
    total = max(bytes_before, 1)
    shared = docs.sparkSession.sparkContext.broadcast(offsets)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, at, part = 0, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            if part is None:
                part = b.column("part")[0].as_py()
                before, at = shared.value[part]
            size = np.asarray(b.column("size"), dtype=np.int64)
            ends = before + np.cumsum(size)
            starts = ends - size
            shard = [min(shards - 1, (int(s) + int(e)) * shards // (2 * total)) for s, e in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("size"), b.column("text_crc32"), pa.array(at + np.arange(len(size)), pa.int64()), pa.array(starts, pa.int64()), pa.array(shard, pa.int32())],
                names=["doc_id", "size", "text_crc32", "at", "bytes_before", "shard"],
            )
            before, at = int(ends[-1]), at + len(size)

    placed = ranged.mapInArrow(
        place, "doc_id long, size long, text_crc32 long, at long, bytes_before long, shard int"
    )
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))  # a row per shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "at", "bytes_before", "shard", (F.col("at") - F.col("first")).alias("slot")
    )
