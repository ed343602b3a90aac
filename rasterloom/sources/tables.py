"""Embedding, chip and catalog tables at rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.functions import names
from rasterloom.functions.geo import box_wkb

ROWS_PER_FILE = 1_000_000
CHIPS_PER_FILE = 20_000


def embeddings_filename(df: DataFrame, version: int = 1, tile: str = "tile", dt: str = "dt") -> DataFrame:
    """``{tile}_{first date}_{last date}_v{version}.gpq`` per tile."""
    day = lambda c: F.date_format(c, "yyyyMMdd")
    spans = df.groupBy(tile).agg(F.min(dt).alias("_a"), F.max(dt).alias("_b"))
    tag = F.lit(f"v{version:03d}.gpq")
    return spans.select(tile, F.concat_ws("_", F.col(tile), day("_a"), day("_b"), tag).alias("name"))


def write_embeddings(df: DataFrame, path: str, tile: str = "tile", mode: str = "append") -> None:
    """Zstandard Parquet partitioned by tile, with the footprint also as WKB.

    Rows are gathered by tile in one shuffle; adaptive execution then splits the
    tiles that outgrow its advisory size over several tasks and lets small ones
    share a task, so files are few and no tile is one task's burden.
    """
    out = df.withColumn("geometry", box_wkb("bbox")) if "bbox" in df.columns and "geometry" not in df.columns else df
    (
        out.hint("rebalance", tile)
        .write.mode(mode)
        .option("compression", "zstd")
        .option("maxRecordsPerFile", ROWS_PER_FILE)
        .partitionBy(tile)
        .parquet(path)
    )


def scan_embeddings(spark: SparkSession, *paths: str, dt: str | None = "dt") -> DataFrame:
    """Many per-scene files as one table, with file name, year, tile and index from them."""
    base = spark.read.parquet(*paths).withColumn("file_name", F.col("_metadata.file_name"))
    stem = names.stem(F.col("file_name"))
    added: dict[str, Column] = {"idx": names.tail_fields(stem, 2)}
    if "tile" not in base.columns:
        source = names.stem(F.col("source_url")) if "source_url" in base.columns else stem
        added["tile"] = names.field(source, 0)
    if dt and dt in base.columns:
        added["year"] = F.year(dt)
    return base.withColumns(added)


def write_chips(df: DataFrame, path: str, mode: str = "append") -> None:
    """Chips, cubes or label chips as Parquet by platform; date and tile stay columns."""
    df.hint("rebalance", "platform").write.mode(mode).option("compression", "zstd").option(
        "maxRecordsPerFile", CHIPS_PER_FILE
    ).partitionBy("platform").parquet(path)


def scan_chips(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def replace_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """Create the table (at ``path``, if given) or replace all of it."""
    writer = df.write.mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def drop_table(spark: SparkSession, name: str) -> None:
    """A table that is not there is fine."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def scan_geojson_points(spark: SparkSession, path: str, properties: dict[str, str] | None = None) -> DataFrame:
    """Point features of GeoJSON files as (properties..., lon, lat)."""
    fields = ", ".join(f"`{k}`: {v}" for k, v in (properties or {"class": "int"}).items())
    schema = (
        f"features array<struct<properties: struct<{fields}>, "
        "geometry: struct<type: string, coordinates: array<double>>>>"
    )
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    return rows.filter(F.col("f.geometry.type") == "Point").select(
        "f.properties.*",
        F.col("f.geometry.coordinates")[0].alias("lon"),
        F.col("f.geometry.coordinates")[1].alias("lat"),
    )
