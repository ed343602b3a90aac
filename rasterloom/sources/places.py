"""Located rows in the order of a space-filling curve, with the bounds of every file.

Rows are range-partitioned by the Hilbert key of their box's middle, so a file covers a
compact area. A small table beside the data holds the box around each file; a search by
area reads it and opens only files whose box meets the area.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions.geo import box, boxes_overlap, box_centroid

ORDER = 16  # bits per axis
ROWS_PER_FILE = 1_000_000
WORLD = (-180.0, -90.0, 180.0, 90.0)


def hilbert_key(x: Column, y: Column, order: int = ORDER) -> Column:
    """Place on the Hilbert curve of two grid coordinates from 0 to ``2**order - 1``."""
    state = "struct<x:bigint,y:bigint,key:bigint>"

    def halve(s: Column, i: Column) -> Column:
        side = F.call_function("shiftleft", F.lit(1).cast("bigint"), i)
        right, up = s["x"].bitwiseAND(side) != 0, s["y"].bitwiseAND(side) != 0
        quarter = F.when(right & up, 2).when(right, 3).when(up, 1).otherwise(0)
        # the lower quarters hold the curve turned over, the right one mirrored too
        last = F.lit((1 << order) - 1)
        a, b = F.when(right, last - s["x"]).otherwise(s["x"]), F.when(right, last - s["y"]).otherwise(s["y"])
        x2, y2 = F.when(up, s["x"]).otherwise(b), F.when(up, s["y"]).otherwise(a)
        return F.struct(x2.cast("bigint").alias("x"), y2.cast("bigint").alias("y"), (s["key"] + quarter * side * side).cast("bigint").alias("key")).cast(state)

    start = F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y"), F.lit(0).cast("bigint").alias("key")).cast(state)
    return F.aggregate(F.sequence(F.lit(order - 1), F.lit(0), F.lit(-1)), start, halve)["key"]


def place_key(bbox: Column, world: tuple[float, float, float, float] = WORLD, order: int = ORDER) -> Column:
    """Hilbert key of a box's middle; places outside ``world`` count as on its border."""
    lon, lat = box_centroid(bbox)
    last = (1 << order) - 1

    def grid(v: Column, low: float, high: float) -> Column:
        return F.least(F.lit(last), F.greatest(F.lit(0), F.floor((v - low) / (high - low) * (1 << order)))).cast("bigint")

    return hilbert_key(grid(lon, world[0], world[2]), grid(lat, world[1], world[3]), order)


def write_places(df: DataFrame, path: str, files: int, bbox: str = "bbox", world: tuple[float, float, float, float] = WORLD) -> None:
    """About ``files`` Parquet files in curve order below ``path/rows``, their boxes in ``path/bounds``.

    Rows of one place may fill several files; rows without a box come first and have a file box of NULLs if alone.
    """
    spark = df.sparkSession
    keyed = df.withColumn("_place", place_key(F.col(bbox), world))
    keyed = keyed.repartitionByRange(files, F.col("_place").asc_nulls_first(), F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])).sortWithinPartitions("_place").drop("_place")
    keyed.write.option("compression", "zstd").option("maxRecordsPerFile", ROWS_PER_FILE).parquet(f"{path}/rows")
    b = F.col(bbox)
    rows = spark.read.parquet(f"{path}/rows").select(b, F.col("_metadata.file_path").alias("file"))
    bounds = rows.groupBy("file").agg(
        F.count("*").alias("n"), F.min(b["xmin"]).alias("xmin"), F.min(b["ymin"]).alias("ymin"), F.max(b["xmax"]).alias("xmax"), F.max(b["ymax"]).alias("ymax")
    )
    bounds.coalesce(1).write.parquet(f"{path}/bounds")


def search_places(spark: SparkSession, path: str, area: tuple[float, float, float, float], bbox: str = "bbox") -> DataFrame:
    """Rows whose box meets the area; files whose box does not are never opened."""
    wanted = box(*[F.lit(float(v)) for v in area])
    schema = spark.read.parquet(f"{path}/rows").schema
    around = F.struct("xmin", "ymin", "xmax", "ymax")
    files = [r.file for r in spark.read.parquet(f"{path}/bounds").where(boxes_overlap(around, wanted)).select("file").collect()]
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*files).where(boxes_overlap(F.col(bbox), wanted))
