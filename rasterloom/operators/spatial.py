"""Spatial joins as equi-joins on grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.polygons import box_planes, clip_convex, contains_point, polygon_area, polygons_touch, rings_box
from rasterloom.plans.grid import KEYS, box_level, cell, levels_of, with_cells
from rasterloom.plans.skew import ROWS_PER_TASK, salted_join


def spatial_join(
    boxes: DataFrame,
    points: DataFrame,
    bbox: str = "bbox",
    lon: str = "lon",
    lat: str = "lat",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Every (point, box) pair with the point inside or on the edge of the box.

    A point has one cell per level, so no pair appears twice. Cells crowded with
    points are split over tasks.
    """
    own = boxes.withColumn("_own", box_level(F.col(bbox)))
    left = with_cells(own.withColumn("_level", F.col("_own")), bbox).drop("_own")
    right = points.withColumn("_level", F.explode(levels_of(own)))
    right = right.withColumn("_ix", cell(F.col(lon), F.col("_level"))).withColumn(
        "_iy", cell(F.col(lat), F.col("_level"))
    )
    pairs = salted_join(right, left, KEYS, rows_per_task, both=True)
    b = F.col(bbox)
    inside = F.col(lon).between(b["xmin"], b["xmax"]) & F.col(lat).between(b["ymin"], b["ymax"])
    return pairs.filter(inside).drop(*KEYS)


def aoi_overlay(
    tiles: DataFrame,
    aoi: DataFrame,
    tile_box: str = "bbox",
    aoi_box: str = "aoi_bbox",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Pairs of boxes that share area, with the shared box as ``clip``.

    A pair meets on the coarser of its two levels; it is kept only in the cell
    that holds the lower-left corner of the shared box, so no distinct is needed.
    """
    a = tiles.withColumn("_own", box_level(F.col(tile_box)))
    b = aoi.withColumn("_own", box_level(F.col(aoi_box)))

    def spread(df: DataFrame, other: DataFrame, bbox: str, own: str) -> DataFrame:
        levelled = df.withColumn("_level", F.explode(F.array_union(F.array("_own"), levels_of(other))))
        coarser = levelled.filter(F.col("_level") >= F.col("_own"))
        return with_cells(coarser, bbox).withColumnRenamed("_own", own)

    pairs = salted_join(
        spread(a, b, tile_box, "_tile_own"), spread(b, a, aoi_box, "_aoi_own"), KEYS, rows_per_task, both=True
    )
    p, q = F.col(tile_box), F.col(aoi_box)
    clip = F.struct(
        F.greatest(p["xmin"], q["xmin"]).alias("xmin"),
        F.greatest(p["ymin"], q["ymin"]).alias("ymin"),
        F.least(p["xmax"], q["xmax"]).alias("xmax"),
        F.least(p["ymax"], q["ymax"]).alias("ymax"),
    )
    c, level = F.col("clip"), F.col("_level")
    return (
        pairs.filter(level == F.greatest("_tile_own", "_aoi_own"))
        .withColumn("clip", clip)
        .filter((c["xmin"] < c["xmax"]) & (c["ymin"] < c["ymax"]))
        .filter((cell(c["xmin"], level) == F.col("_ix")) & (cell(c["ymin"], level) == F.col("_iy")))
        .drop(*KEYS, "_tile_own", "_aoi_own")
    )


def attach_dem(tiles: DataFrame, dem: DataFrame, tile_id: str, tile_box: str = "bbox", dem_box: str = "dem_bbox") -> DataFrame:
    """Tiles with each elevation part they share area with; tiles without one stay."""
    parts = aoi_overlay(tiles.select(tile_id, tile_box), dem, tile_box, dem_box).drop(tile_box)
    return tiles.join(parts, tile_id, "left")


def reference_hits(points: DataFrame, patches: DataFrame, bbox: str = "bbox") -> DataFrame:
    """Patches under each reference point; points without one drop out."""
    return spatial_join(patches, points, bbox)


def points_with_hits(points: DataFrame, patches: DataFrame, point_id: str = "point_id", bbox: str = "bbox") -> DataFrame:
    hits = spatial_join(patches.select(bbox), points.select(point_id, "lon", "lat"), bbox)
    return points.join(hits.select(point_id), point_id, "left_semi")


def polygon_join(
    polygons: DataFrame, points: DataFrame, rings: str = "rings", lon: str = "lon", lat: str = "lat", rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Every (point, polygon) pair with the point inside or on the edge: boxes meet on the grid, ray crossing decides."""
    boxed = polygons.withColumn("_box", rings_box(F.col(rings))).where("_box.xmin is not null")
    pairs = spatial_join(boxed, points, "_box", lon, lat, rows_per_task)
    return pairs.where(contains_point(F.col(rings), F.col(lon), F.col(lat))).drop("_box")


def polygon_overlay(
    tiles: DataFrame, aoi: DataFrame, tile_rings: str = "rings", aoi_rings: str = "aoi_rings", rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Pairs of polygons that share a point and whose boxes share area; ``shared_box`` is the box both lie in."""
    a = tiles.withColumn("_tile_box", rings_box(F.col(tile_rings))).where("_tile_box.xmin is not null")
    b = aoi.withColumn("_aoi_box", rings_box(F.col(aoi_rings))).where("_aoi_box.xmin is not null")
    pairs = aoi_overlay(a, b, "_tile_box", "_aoi_box", rows_per_task)
    return pairs.where(polygons_touch(F.col(tile_rings), F.col(aoi_rings))).withColumnRenamed("clip", "shared_box").drop("_tile_box", "_aoi_box")


def clip_to_boxes(polygons: DataFrame, boxes: DataFrame, rings: str = "rings", bbox: str = "bbox", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Each polygon cut along the boxes it shares area with: ``part`` (rings) and its ``area``."""
    boxed = polygons.withColumn("_poly_box", rings_box(F.col(rings))).where("_poly_box.xmin is not null")
    pairs = aoi_overlay(boxes, boxed, bbox, "_poly_box", rows_per_task)
    cut = pairs.withColumn("part", clip_convex(F.col(rings), box_planes(F.col(bbox)))).where(F.size("part") > 0)
    return cut.withColumn("area", polygon_area(F.col("part"))).where("area > 0").drop("clip", "_poly_box")
