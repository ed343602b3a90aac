"""Band selection and per-platform metadata for chip tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import pixels as px
from rasterloom.functions.binding import let
from rasterloom.sources.registry import platform_meta

# Band groups of the optical + radar stack.
BAND_GROUPS: dict[str, list[str]] = {
    "rgb": ["red", "green", "blue"],
    "rededge": ["rededge1", "rededge2", "rededge3", "nir08"],
    "nir": ["nir"],
    "swir": ["swir16", "swir22"],
    "sar": ["vv", "vh"],
    "scl": ["scl"],
}

# Sensor categories of the summary.
SENSOR_CATEGORIES: dict[str, list[str]] = {
    "Multispectral Satellites": ["sentinel-2-l2a", "landsat-c2l1", "landsat-c2l2-sr"],
    "Commercial High-Resolution": ["planetscope-sr"],
    "Aerial Imagery": ["naip", "linz"],
    "Radar": ["sentinel-1-rtc"],
    "Global Monitoring": ["modis"],
}


def attach_band_meta(chips: DataFrame, registry: DataFrame) -> DataFrame:
    """Wavelengths (um), ground sample distance, band names and statistics per chip.

    A chip that carries its own ``gsd`` keeps it.
    """
    meta = platform_meta(registry)
    if "gsd" in chips.columns:
        chips = chips.withColumnRenamed("gsd", "_own_gsd")
        joined = chips.join(meta, "platform", "left")
        return joined.withColumn("gsd", F.coalesce("_own_gsd", "gsd")).drop("_own_gsd")
    return chips.join(meta, "platform", "left")


def _stat(stat: str, names: list[str]) -> Column:
    wanted = F.array(*[F.lit(n) for n in names])
    return F.transform(
        wanted, lambda n: F.get(F.col(stat), (F.array_position(F.col("reg_bands"), n) - 1).cast("int"))
    )


def select_bands(chips: DataFrame, registry: DataFrame, names: list[str]) -> DataFrame:
    """Keep bands in caller order, with the statistics that belong to them."""
    with_meta = chips.join(platform_meta(registry), "platform", "left")
    return with_meta.select(
        *[c for c in chips.columns if c not in ("pixels", "bands")],
        F.array(*[F.lit(n) for n in names]).alias("bands"),
        px.pick_bands(F.col("pixels"), F.col("reg_bands"), names).alias("pixels"),
        _stat("reg_mean", names).alias("mean"),
        _stat("reg_std", names).alias("std"),
    )


def select_rgb(chips: DataFrame, registry: DataFrame) -> DataFrame:
    """Three bands per chip, radar composed from its two polarisations."""
    with_meta = chips.join(platform_meta(registry), "platform", "left")
    return with_meta.select(
        *[c for c in chips.columns if c != "pixels"],
        px.rgb(F.col("pixels"), F.col("platform"), F.col("rgb_idx")).alias("pixels"),
    )


def select_band_groups(
    chips: DataFrame, registry: DataFrame, groups: dict[str, list[str]] | None = None
) -> DataFrame:
    """One row per chip and group the chip has bands of; order inside a group is kept.

    ``group_idx`` lists the 0-based source positions of the bands kept.
    """
    groups = groups or BAND_GROUPS
    with_meta = chips.join(platform_meta(registry), "platform", "left")
    table = F.array(
        *[
            F.struct(F.lit(g).alias("group"), F.array(*[F.lit(b) for b in bands]).alias("wanted"))
            for g, bands in groups.items()
        ]
    )
    at = lambda n: (F.array_position(F.col("reg_bands"), n) - 1).cast("int")
    found = lambda g: F.filter(F.transform(g["wanted"], at), lambda i: i >= 0)

    def piece(pixels: Column, g: Column) -> Column:
        take = lambda arr, idx: F.transform(idx, lambda i: F.get(arr, i))
        return let(
            found(g),
            lambda idx: F.struct(
                g["group"].alias("band_group"),
                idx.alias("group_idx"),
                take(pixels, idx).alias("pixels"),
                take(F.col("reg_mean"), idx).alias("mean"),
                take(F.col("reg_std"), idx).alias("std"),
            ),
        )

    # groups are picked inside the row, so the chip is not copied once per group
    pieces = let(F.col("pixels"), lambda p: F.transform(table, lambda g: piece(p, g)))
    kept = F.filter(pieces, lambda s: F.size(s["group_idx"]) > 0)
    return with_meta.select(*[c for c in chips.columns if c not in ("pixels", "bands")], F.inline(kept))


def sensor_summary(chips: DataFrame, registry: DataFrame) -> DataFrame:
    """Chips per sensor category and platform with band count and gsd; unknown sensors skipped."""
    spark = chips.sparkSession
    pairs = [(c, p) for c, platforms in SENSOR_CATEGORIES.items() for p in platforms]
    categories = F.broadcast(spark.createDataFrame(pairs, "category string, platform string"))
    counted = chips.groupBy("platform").agg(F.count(F.lit(1)).alias("n_chips"))
    return (
        counted.join(categories, "platform")
        .join(platform_meta(registry), "platform")
        .select("category", "platform", F.size("reg_bands").alias("n_bands"), "gsd", "n_chips")
    )


def known(found: Column, wanted: Column, value: Column, unknown: str) -> Column:
    """``value`` where the registry has the sensor; otherwise an error with its name, or NULL.

    No chip is dropped: ``unknown="error"`` stops the job, ``unknown="null"``
    returns the row with NULL in place of the value.
    """
    if unknown not in ("error", "null"):
        raise ValueError(f"unknown must be 'error' or 'null', not {unknown}")
    missing = F.raise_error(F.concat(F.lit("not in the sensor registry: "), F.coalesce(wanted, F.lit("NULL"))))
    return F.when(found.isNotNull(), value).otherwise(missing if unknown == "error" else F.lit(None))


def normalise_join(values: DataFrame, registry: DataFrame, unknown: str = "error") -> DataFrame:
    """Long (platform, band, value) rows scaled with the registry; see ``known`` for sensors or bands it lacks."""
    stats = F.broadcast(registry.select("platform", "band", "mean", "std", F.lit(True).alias("_known")))
    name = F.concat_ws("/", F.coalesce("platform", F.lit("NULL")), F.coalesce("band", F.lit("NULL")))
    scaled = F.try_divide(F.col("value") - F.col("mean"), F.col("std"))
    return (
        values.join(stats, ["platform", "band"], "left")
        .withColumn("scaled", known(F.col("_known"), name, scaled, unknown))
        .drop("mean", "std", "_known")
    )


def standardise_chips(chips: DataFrame, registry: DataFrame, unknown: str = "error") -> DataFrame:
    """Radar to decibel, then (x - mean) / std per band: a narrow, per-row job; see ``known`` for unknown sensors."""
    with_meta = chips.join(platform_meta(registry), "platform", "left")
    decibel = px.sar_to_db(F.col("pixels"), F.col("platform"))
    return with_meta.select(
        *[c for c in chips.columns if c != "pixels"],
        known(F.col("reg_mean"), F.col("platform"), px.standardise(decibel, F.col("reg_mean"), F.col("reg_std")), unknown).alias("pixels"),
    )


def destandardise_chips(
    chips: DataFrame, registry: DataFrame, byte_platforms: tuple[str, ...] = ("naip", "linz"), unknown: str = "error"
) -> DataFrame:
    """Back to sensor units; aerial sensors are cast to bytes; see ``known`` for unknown sensors."""
    with_meta = chips.join(platform_meta(registry), "platform", "left")
    back = px.destandardise(F.col("pixels"), F.col("reg_mean"), F.col("reg_std"))
    as_byte = F.transform(px.to_byte(back), lambda b: F.transform(b, lambda v: v.cast("double")))
    return with_meta.select(
        *[c for c in chips.columns if c != "pixels"],
        known(F.col("reg_mean"), F.col("platform"), F.when(F.col("platform").isin(*byte_platforms), as_byte).otherwise(back), unknown).alias("pixels"),
    )
