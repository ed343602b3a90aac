"""Nodata, clouds, labels and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.binding import let
from rasterloom.functions.pixels import window

# Nodata codes and band counts per feature platform.
FEATURE_NODATA = {"S1": ([0.0, -9999.0], 2), "S2": ([0.0], 10)}
SINUSOIDAL_NODATA = -28672
COMPLETE_BANDS = 12
MAX_MASKED_CELLS = 100000
# Scene-classification codes that count as cloud.
CLOUD_CODES = [7, 8, 9, 10]
# Land-cover codes to training classes.
LABEL_CLASSES = {1: 0, 2: 1, 3: 2, 4: 3, 5: 4, 6: 5, 15: 6}


def mask_nodata(features: DataFrame, rules: dict[str, tuple[list[float], int]] | None = None) -> DataFrame:
    """Keep each platform's leading bands; nodata codes become NULL."""
    rules = rules or FEATURE_NODATA
    keep, value = F.lit(False), F.col("value")
    for platform, (codes, n_bands) in rules.items():
        here = F.col("platform") == platform
        keep = keep | (here & (F.col("band_idx") < n_bands))
        value = F.when(here & F.col("value").isin(*codes), F.lit(None)).otherwise(value)
    return features.filter(keep).withColumn("value", value)


def remap_labels(df: DataFrame, col: str = "label", mapping: dict[int, int] | None = None) -> DataFrame:
    """Label codes to classes; a code without a class becomes NULL."""
    pairs = [F.lit(x) for pair in (mapping or LABEL_CLASSES).items() for x in pair]
    return df.withColumn(col, F.try_element_at(F.create_map(*pairs), F.col(col).cast("int")))


def filter_cloud(df: DataFrame, op: str, pct: float) -> DataFrame:
    """Compare ``cloud_cover`` with a threshold; reaches the scan."""
    cloud = F.col("cloud_cover")
    tests = {"<": cloud < pct, "<=": cloud <= pct, ">": cloud > pct, ">=": cloud >= pct, "==": cloud == pct}
    return df.filter(tests[op])


def filter_attr(
    points: DataFrame, where: dict[str, object] | None = None, bbox: tuple[float, float, float, float] | None = None
) -> DataFrame:
    """Attribute equality and a coordinate slice."""
    for name, value in (where or {}).items():
        points = points.filter(F.col(name) == value)
    if bbox:
        xmin, ymin, xmax, ymax = bbox
        points = points.filter(F.col("lon").between(xmin, xmax) & F.col("lat").between(ymin, ymax))
    return points


def detected(predictions: DataFrame, keep: list[str], col: str = "prediction") -> DataFrame:
    return predictions.filter(F.col(col) == 1).select(*keep)


def patch_cloud_pct(chips: DataFrame, scl: Column, key: list[str], size: int = 32, codes: list[int] | None = None) -> DataFrame:
    """Truncated cloud percentage of each full ``size`` x ``size`` patch; stays in the row's task."""
    codes = codes or CLOUD_CODES
    h, w = F.col("h"), F.col("w")
    rows, cols = F.floor(h / size).cast("int"), F.floor(w / size).cast("int")

    def patch(raster: Column, n: Column) -> Column:
        row, col = F.floor(n / cols).cast("int"), (n % cols).cast("int")
        block = window(raster, w, col * size, row * size, F.lit(size), F.lit(size))
        cloudy = F.size(F.filter(block, lambda v: v.isin(*codes)))
        return F.struct(
            row.alias("patch_row"),
            col.alias("patch_col"),
            F.floor(F.lit(100) * cloudy / (size * size)).cast("int").alias("cloud_pct"),
        )

    numbers = F.sequence(F.lit(0), rows * cols - 1)
    patches = let(scl, lambda raster: F.transform(numbers, lambda n: patch(raster, n)))
    return chips.filter((h >= size) & (w >= size)).select(*key, F.inline(patches))


def complete_months(features: DataFrame, expected: int = COMPLETE_BANDS, by: list[str] | None = None) -> DataFrame:
    """Rows of the months that have every expected (platform, band)."""
    by = by or ["tile", "month"]
    bands = [c for c in ("platform", "band_idx") if c in features.columns]
    whole = (
        features.groupBy(*by).agg(F.count_distinct(*bands).alias("_n")).filter(F.col("_n") == expected).select(*by)
    )
    return features.join(whole, by, "left_semi")


def temporal_composite(features: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean over months that skips masked values; masked in every month stays NULL."""
    by = by or ["tile", "band_idx", "px"]
    return features.groupBy(*by).agg(F.avg("value").alias("value"))


def drop_nodata_tiles(composite: DataFrame, most: int = MAX_MASKED_CELLS) -> DataFrame:
    """Drop tiles with more than ``most`` masked cells."""
    bad = (
        composite.filter(F.col("value").isNull())
        .groupBy("tile")
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > most)
        .select("tile")
    )
    return composite.join(bad, "tile", "left_anti")


def zero_nodata_tiles(pixels: DataFrame, is_nodata: Column, by: str = "tile") -> DataFrame:
    """Tiles without a single nodata cell."""
    return pixels.groupBy(by).agg(F.count_if(is_nodata).alias("_n")).filter(F.col("_n") == 0).select(by)


def skip_existing(todo: DataFrame, done: DataFrame, on: list[str], overwrite: bool = False) -> DataFrame:
    return todo if overwrite else todo.join(done, on, "left_anti")
