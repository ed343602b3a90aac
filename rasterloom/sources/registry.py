"""Sensor registry: platform -> ordered bands with mean, std and wavelength."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.schemas import SENSOR_BANDS

# Published per-band statistics of the supported sensors.
# platform | gsd in metres | rgb positions | band mean std wavelength(um); ...
FIXED_SENSORS = """
sentinel-2-l2a | 10 | 2,1,0
  blue      1105 1809 0.493
  green     1355 1757 0.56
  red       1552 1888 0.665
  rededge1  1887 1870 0.704
  rededge2  2422 1732 0.74
  rededge3  2630 1697 0.783
  nir       2743 1742 0.842
  nir08     2785 1648 0.865
  swir16    2388 1470 1.61
  swir22    1835 1379 2.19
planetscope-sr | 5 | 5,3,1
  coastal_blue 1720 747 0.443
  blue         1715 698 0.490
  green_i      1913 739 0.531
  green        2088 768 0.565
  yellow       2274 849 0.610
  red          2290 868 0.665
  rededge      2613 849 0.705
  nir          3970 914 0.865
landsat-c2l1 | 30 | 0,1,2
  red    10678 6025 0.65
  green  10563 5411 0.56
  blue   11083 5468 0.48
  nir08  14792 6746 0.86
  swir16 12276 5897 1.6
  swir22 10114 4850 2.2
landsat-c2l2-sr | 30 | 0,1,2
  red    13705 9578  0.65
  green  13310 9408  0.56
  blue   12474 10144 0.48
  nir08  17801 8277  0.86
  swir16 14615 5300  1.6
  swir22 12701 4522  2.2
naip | 1.0 | 0,1,2
  red   110.16 47.23 0.65
  green 115.41 39.82 0.56
  blue  98.15  35.43 0.48
  nir   139.04 49.86 0.842
linz | 0.5 | 0,1,2
  red   89.96 41.83 0.635
  green 99.46 36.96 0.555
  blue  89.51 31.45 0.465
sentinel-1-rtc | 10 |
  vv -12.113 8.314 3.5
  vh -18.673 8.017 4.0
modis | 500 | 0,3,2
  sur_refl_b01 1072 1643 0.645
  sur_refl_b02 1624 1878 0.858
  sur_refl_b03 931  1449 0.469
  sur_refl_b04 1023 1538 0.555
  sur_refl_b05 1599 1763 1.240
  sur_refl_b06 1404 1618 1.640
  sur_refl_b07 1051 1396 2.130
satellogic-MSI-L1D | 1.0 | 0,1,2
  red   1451.54 995.48  0.640
  green 1456.54 771.29  0.545
  blue  1543.22 708.86  0.480
  nir   2132.68 1236.71 0.825
"""

# The platforms trained on by default, and the printed categories.
DEFAULT_PLATFORMS = (
    "landsat-c2l1",
    "landsat-c2l2-sr",
    "linz",
    "modis",
    "naip",
    "sentinel-1-rtc",
    "sentinel-2-l2a",
)


def _rows(text: str) -> list[tuple]:
    rows: list[tuple] = []
    platform, gsd, rgb, idx = "", 0.0, [], 0
    for line in filter(str.strip, text.splitlines()):
        if "|" in line:
            platform, gsd_text, rgb_text = (p.strip() for p in line.split("|"))
            gsd, idx = float(gsd_text), 0
            rgb = [int(p) for p in rgb_text.split(",") if p]
        else:
            band, mean, std, wave = line.split()
            pos = rgb.index(idx) if idx in rgb else None
            rows.append((platform, idx, band, float(mean), float(std), float(wave), gsd, pos))
            idx += 1
    return rows


def sensor_rows(spec: dict[str, dict[str, Any]] | None = None) -> list[tuple]:
    """Registry rows of the fixed sensors, or of a parsed YAML-like mapping."""
    if spec is None:
        return _rows(FIXED_SENSORS)
    rows = []
    for platform, entry in spec.items():
        order, bands = list(entry["band_order"]), entry["bands"]
        for stat in ("mean", "std", "wavelength"):
            if set(bands[stat]) != set(order):
                raise ValueError(f"{platform}: keys of {stat} differ from band_order")
        rgb = [int(i) for i in entry.get("rgb_indices") or []]
        if any(i < 0 or i >= len(order) for i in rgb):
            raise ValueError(f"{platform}: rgb position outside band_order")
        for i, band in enumerate(order):
            rows.append(
                (
                    platform,
                    i,
                    band,
                    float(bands["mean"][band]),
                    float(bands["std"][band]),
                    float(bands["wavelength"][band]),
                    float(entry["gsd"]),
                    rgb.index(i) if i in rgb else None,
                )
            )
    return rows


def sensor_registry(spark: SparkSession, yaml_path: str | None = None) -> DataFrame:
    """One row per platform and band, positions preserved.

    Without a path the fixed sensors are used; the table is read on the driver
    because it is configuration (tens of rows), not data.
    """
    spec = None
    if yaml_path:
        import yaml

        with open(yaml_path, encoding="utf-8") as fh:
            spec = yaml.safe_load(fh)
    return spark.createDataFrame(sensor_rows(spec), SENSOR_BANDS)


def add_sensor(registry: DataFrame, platform: str, spec: dict[str, Any]) -> DataFrame:
    """Registry plus a user sensor; band keys must agree in order, mean, std and wavelength."""
    spark = registry.sparkSession
    rows = sensor_rows({platform: spec})
    added = spark.createDataFrame(rows, SENSOR_BANDS)
    clash = registry.filter(F.col("platform") == platform).limit(1).count()
    if clash:
        raise ValueError(f"{platform} is already registered")
    return registry.unionByName(added)


def platform_meta(registry: DataFrame) -> DataFrame:
    """One row per platform with ordered arrays; as small as the registry, hence broadcast."""
    ordered = F.array_sort(F.collect_list(F.struct("band_idx", "band", "mean", "std", "wavelength_um")))
    rgb = F.array_sort(
        F.collect_list(F.when(F.col("rgb_pos").isNotNull(), F.struct("rgb_pos", "band_idx")))
    )
    return F.broadcast(
        registry.groupBy("platform")
        .agg(ordered.alias("_b"), rgb.alias("_rgb"), F.min("gsd").alias("gsd"))
        .select(
            "platform",
            "gsd",
            F.col("_b.band").alias("reg_bands"),
            F.col("_b.mean").alias("reg_mean"),
            F.col("_b.std").alias("reg_std"),
            F.col("_b.wavelength_um").alias("waves"),
            F.when(F.size("_rgb") > 0, F.col("_rgb.band_idx")).alias("rgb_idx"),
        )
    )
