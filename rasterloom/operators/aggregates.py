"""Counts, extents, band statistics, collation and histogram equalisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def band_stats(chips: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean and sample deviation per band over all chips and pixels."""
    by = by or ["platform"]
    bands = chips.select(*by, F.posexplode("pixels").alias("band_idx", "_band"))
    values = bands.select(*by, "band_idx", F.explode("_band").alias("_v"))
    return values.groupBy(*by, "band_idx").agg(
        F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("std"), F.count("_v").alias("n")
    )


def platform_counts(chips: DataFrame, total: bool = True) -> DataFrame:
    """Chips per platform; the grand total has platform NULL."""
    grouped = chips.rollup("platform") if total else chips.groupBy("platform")
    return grouped.agg(F.count(F.lit(1)).alias("n_chips"))


def extent(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    return points.groupBy(*(by or [])).agg(
        F.min("lon").alias("xmin"), F.min("lat").alias("ymin"), F.max("lon").alias("xmax"), F.max("lat").alias("ymax")
    )


def label_tally(merged: DataFrame, by: list[str] | None = None, label: str = "class") -> DataFrame:
    return merged.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("found"),
        F.count_if(F.col(label) == 1).alias("positive"),
        F.count_if(F.col(label) == 0).alias("negative"),
    )


def unique_ids(files: DataFrame, col: str = "id") -> DataFrame:
    return files.select(col).distinct()


def collate(rows: DataFrame, batch: list[str], order: str, columns: list[str]) -> DataFrame:
    """One row per batch: the members' arrays joined end to end in slot order.

    A group is one batch, so its size is the batch size and never grows with the data.
    """
    members = F.array_sort(F.collect_list(F.struct(order, *columns)))
    grouped = rows.groupBy(*batch).agg(members.alias("_m"))
    return grouped.select(*batch, *[F.flatten(F.col(f"_m.{c}")).alias(c) for c in columns])


def concat_tables(tables: list[DataFrame]) -> DataFrame:
    """All rows of all tables; columns one of them lacks are NULL there."""
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def equalise_histogram(chips: DataFrame, values: str, nbins: int = 256) -> DataFrame:
    """Map each value of the array through the cumulative distribution of its own array.

    The distribution is taken at the centres of equal bins and interpolated
    linearly, over all bands of a chip at once if its array holds several. NULLs
    (and NaN) stay and are not counted. Per-row work, hence Arrow batches and no
    shuffle.
    """
    schema = T.StructType(
        [T.StructField(f.name, T.ArrayType(T.DoubleType())) if f.name == values else f for f in chips.schema]
    )

    def one(v: np.ndarray) -> np.ndarray:
        there = ~np.isnan(v)
        own = v[there]
        if own.size:
            counts, edges = np.histogram(own, bins=nbins)
            v[there] = np.interp(own, (edges[:-1] + edges[1:]) / 2, counts.cumsum() / own.size)
        return v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(values)
            column = batch.column(at)
            flat = column.flatten()
            empty = np.asarray(flat.is_null())
            ends = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            parts = np.split(np.array(flat.cast(pa.float64()).fill_null(np.nan), dtype=np.float64), ends[:-1]) if len(ends) else []
            out = np.concatenate([one(p) for p in parts]) if parts else np.zeros(0)
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            mapped = pa.ListArray.from_arrays(offsets, pa.array(out, pa.float64(), mask=empty), mask=column.is_null())
            columns = [mapped if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return chips.mapInArrow(run, schema)
