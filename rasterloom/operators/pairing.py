"""Joins in time and by name: radar to optical scenes, labels to chips, metadata to patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.plans.skew import salted_join

FAN = 32


def _coverage_prefix(scenes: DataFrame, by: list[str], order: list[Column | str], full: float) -> DataFrame:
    """Rows before which the running coverage is still short of ``full``."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("coverage").over(w), F.lit(0))
    return scenes.withColumn("_before", before).filter(F.col("_before") < full).drop("_before")


def match_sar(
    s2: DataFrame, s1: DataFrame, days: int = 3, full: float = 1.0, s2_id: str = "item_id", s1_id: str = "sar_id"
) -> DataFrame:
    """Radar scenes nearest in date to each optical scene, added until the tile is covered.

    Scenes of one tile and day are equally near to anything, so only the first
    few of them (by id, until they cover the tile themselves) can ever be used;
    the rest goes before any join, first within salted sub-groups. The order is
    then settled once per (tile, day) that has optical scenes, not once per
    scene. Optical scenes without a match drop out.
    """
    radar = s1.select(s1_id, "tile", F.to_date("dt").alias("_day"), "coverage")
    radar = radar.withColumn("_salt", F.pmod(F.xxhash64(s1_id), F.lit(FAN)))
    radar = _coverage_prefix(radar, ["tile", "_day", "_salt"], [s1_id], full).drop("_salt")
    radar = _coverage_prefix(radar, ["tile", "_day"], [s1_id], full)

    optical = s2.withColumn("_date", F.to_date("dt"))
    wanted = optical.select("tile", "_date").distinct()
    near = radar.withColumn("day_gap", F.explode(F.sequence(F.lit(-days), F.lit(days)))).withColumn(
        "_date", F.date_sub("_day", F.col("day_gap"))
    )
    order = [F.abs("day_gap"), F.col(s1_id)]
    chosen = _coverage_prefix(near.join(wanted, ["tile", "_date"]), ["tile", "_date"], order, full)
    rank = F.row_number().over(Window.partitionBy("tile", "_date").orderBy(*order))
    chosen = chosen.withColumn("match_rank", rank).select("tile", "_date", s1_id, "day_gap", "coverage", "match_rank")
    return salted_join(optical, chosen, ["tile", "_date"]).drop("_date")


def pair_labels(chips: DataFrame, labels: DataFrame, key: Column, label_name: str = "label_name") -> DataFrame:
    """Chips with the label file their own name leads to."""
    return chips.withColumn(label_name, key).join(labels, label_name)


def attach_patch_meta(vectors: DataFrame, boxes: DataFrame, clouds: DataFrame, key: list[str]) -> DataFrame:
    """Patch vectors with their bounds and cloud share, matched on explicit row and column."""
    on = [*key, "patch_row", "patch_col"]
    return vectors.join(boxes, on).join(clouds, on)
