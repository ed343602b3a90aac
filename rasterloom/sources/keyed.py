"""Tables that are updated by key: one Parquet folder per write, and a small listing of what is current.

Rows live in hash buckets of their key. Each write puts the buckets it touches below a
folder of its own and then adds a listing (``_listing/version=N``): per bucket the
folders that hold its rows, and a Bloom filter of its keys. The listing appears in one
rename after all data, so a reader sees a write whole or not at all, and readers of
an earlier version keep theirs. There is one writer at a time.

A batch looks at the filters first. A bucket that holds none of the batch's keys gets a
further folder and is not read; a bucket that may hold one is merged and written
anew. All other buckets are neither read nor written.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from rasterloom.plans.scratch import materialise

BUCKETS = 64
FILTER_BITS = 1 << 17  # per bucket: 16 KB, one false hit in a hundred at 13,000 keys
PROBES = 4
ROWS_PER_FILE = 1_000_000
FOLDERS = 16  # a bucket in more folders than this is merged when it is next written
LISTING = "version long, batch long, buckets int, bucket int, folders array<string>, bits array<long>"


@dataclass(frozen=True)
class Listing:
    """The current version: its number, the last batch in it, the number and folders of its buckets, the filters' size."""

    version: int
    batch: int
    buckets: int
    bits: int
    folders: dict[int, list[str]]


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def _places(key: str, bits: int) -> Column:
    """The filter positions of a key."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(bits)).cast("int") for seed in range(1, PROBES + 1)])


def _listings(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(LISTING).option("basePath", f"{path}/_listing").parquet(f"{path}/_listing")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None


def _latest(spark: SparkSession, path: str, buckets: int = BUCKETS, bits: int = FILTER_BITS) -> tuple[Listing, DataFrame | None]:
    """What is current; a new table takes the given sizes, later writes keep those it has."""
    every = _listings(spark, path)
    top = every.agg(F.max("version")).first()[0] if every is not None else None
    if top is None:
        return Listing(0, -1, buckets, bits, {}), None
    own = every.where(F.col("version") == top)
    rows = own.select("batch", "buckets", "bucket", "folders", F.size("bits").alias("words")).collect()  # one short row per bucket
    return Listing(top, rows[0].batch, rows[0].buckets, rows[0].words * 64, {r.bucket: list(r.folders) for r in rows}), own


def _bucket_rows(spark: SparkSession, path: str, listing: Listing, buckets: list[int], schema) -> DataFrame:
    """The rows of some buckets; nothing else is listed or read."""
    paths = [f"{path}/data/{folder}/bucket={b}" for b in buckets for folder in listing.folders.get(b, [])]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def read_keyed(spark: SparkSession, path: str, schema) -> DataFrame:
    """The current rows; none if nothing was ever written."""
    listing, _ = _latest(spark, path)
    return _bucket_rows(spark, path, listing, sorted(listing.folders), schema)


def _maybe_held(batch: DataFrame, filters: DataFrame | None, key: str, bits: int) -> list[int]:
    """Buckets whose filter holds at least one key of the batch; ``batch`` has the column ``bucket``."""
    if filters is None:
        return []
    tested = batch.select("bucket", _places(key, bits).alias("at")).join(filters.select("bucket", "bits"), "bucket")
    hit = F.forall("at", lambda p: F.get("bits", (p / 64).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), p % 64)) != 0)
    return sorted(r.bucket for r in tested.where(hit).select("bucket").distinct().collect())


def lookup(spark: SparkSession, path: str, keys: DataFrame, key: str, schema) -> DataFrame:
    """The table's rows for the given keys; reads only buckets whose filter knows one of them."""
    listing, filters = _latest(spark, path)
    wanted = keys.select(key).withColumn("bucket", bucket_of(key, listing.buckets))
    held = _maybe_held(wanted, filters, key, listing.bits)
    return _bucket_rows(spark, path, listing, held, schema).join(keys.select(key).distinct(), key, "left_semi")


def _filters(rows: DataFrame, key: str, bits: int) -> DataFrame:
    """(bucket, bits): the Bloom filter of each bucket's keys."""
    at = rows.select("bucket", F.explode(_places(key, bits)).alias("p"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p") % 64)
    words = at.groupBy("bucket", (F.col("p") / 64).cast("int").alias("w")).agg(F.bit_or(one).alias("v"))
    held = words.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("w", "v"))).alias("m"))
    return held.select("bucket", F.transform(F.sequence(F.lit(0), F.lit(bits // 64 - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0).cast("long"))).alias("bits"))


def newest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: the last by ``order``; ties go to the row that is greatest as a whole."""
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    rank = F.struct(*[F.col(c) for c in order], F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns if c != key]))
    best = rows.groupBy(key).agg(F.max_by(whole, rank).alias("_row"))
    return best.select(*[F.col(f"_row.`{c}`").alias(c) for c in rows.columns])


def upsert(
    rows: DataFrame, path: str, key: str, order: list[str] | None = None, batch: int | None = None,
    buckets: int = BUCKETS, bits: int = FILTER_BITS,
) -> list[int]:
    """Insert rows with new keys and replace those with known ones; returns the buckets that were merged.

    Inside the batch, and between batch and table, the row that is last by ``order``
    stays, in whichever sequence the rows arrive; without ``order`` the batch replaces
    the table. A ``batch`` number that the table already holds changes nothing, and an
    attempt that died left no listing, so it is simply made again.
    Rows with a NULL key are refused.
    """
    spark, order = rows.sparkSession, order or []
    listing, filters = _latest(spark, path, buckets, bits)
    buckets, bits = listing.buckets, listing.bits
    if batch is not None and batch <= listing.batch:
        return []
    schema = rows.schema
    new = materialise(newest(rows, key, order).withColumn("bucket", bucket_of(key, buckets)), "upsert-batch")
    if new.where(F.col(key).isNull()).limit(1).count():
        raise ValueError(f"rows without {key}")
    touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())  # at most ``buckets``
    if not touched:
        return []
    merged = _maybe_held(new, filters, key, bits)
    merged = sorted({*merged, *[b for b in touched if len(listing.folders.get(b, [])) >= FOLDERS]})
    out = new
    if merged:
        old = _bucket_rows(spark, path, listing, merged, schema).withColumn("bucket", bucket_of(key, buckets))
        both = old.withColumn("_batch", F.lit(0)).unionByName(new.where(F.col("bucket").isin(merged)).withColumn("_batch", F.lit(1)))
        kept = newest(both, key, [*order, "_batch"]).drop("_batch")
        out = kept.unionByName(new.where(~F.col("bucket").isin(merged)))
    folder = f"{listing.version + 1:08d}-{uuid.uuid4().hex}"
    out.hint("rebalance", "bucket").write.option("compression", "zstd").option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy("bucket").parquet(f"{path}/data/{folder}")
    written = spark.read.parquet(f"{path}/data/{folder}").select("bucket", key)
    added = _filters(written, key, bits)
    if filters is not None:
        kept = filters.where(~F.col("bucket").isin(merged)).select("bucket", F.col("bits").alias("_old"))
        joined = added.join(kept, "bucket", "full")
        either = F.zip_with("bits", "_old", lambda a, b: a.bitwiseOR(b))
        added = joined.select("bucket", F.when(F.col("_old").isNull(), F.col("bits")).when(F.col("bits").isNull(), F.col("_old")).otherwise(either).alias("bits"))
    now = {b: [*([] if b in merged else f), *([folder] if b in touched or b in merged else [])] for b, f in (listing.folders | {b: listing.folders.get(b, []) for b in touched}).items()}
    places = spark.createDataFrame(sorted(now.items()), "bucket int, folders array<string>")
    last = listing.batch if batch is None else batch
    entry = places.join(added, "bucket").select(F.lit(last).cast("long").alias("batch"), F.lit(buckets).alias("buckets"), "bucket", "folders", "bits")
    entry.coalesce(1).write.mode("overwrite").parquet(f"{path}/_listing/version={listing.version + 1}")
    return merged
