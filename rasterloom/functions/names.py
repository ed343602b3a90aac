"""Fields hidden in paths and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def parent_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def field(name: Column, index: int, sep: str = "_") -> Column:
    """``name.split(sep)[index]``; negative counts from the end; missing is NULL."""
    return F.try_element_at(F.split(name, sep), F.lit(index + 1 if index >= 0 else index))


def tail_fields(name: Column, start: int, sep: str = "_") -> Column:
    """``sep.join(name.split(sep)[start:])``."""
    parts = F.split(name, sep)
    return F.array_join(F.slice(parts, F.lit(start + 1), F.greatest(F.size(parts) - start, F.lit(0))), sep)


def grid_code(value: Column) -> Column:
    """``MGRS-29SNB`` to ``29SNB``."""
    return F.regexp_extract(value, r"^MGRS-(.+)$", 1)


def epsg_code(value: Column) -> Column:
    """``EPSG:32629`` to 32629."""
    return F.try_to_number(F.regexp_extract(value, r"^EPSG:(\d+)$", 1), F.lit("999999")).cast("int")


def feature_file(path: Column) -> Column:
    """``{id}_{platform}_{month}.ext`` as a struct."""
    name = stem(path)
    return F.struct(
        field(name, 0).alias("id"), field(name, 1).alias("platform"), field(name, 2).alias("month")
    )


def label_key_segment(image_name: Column) -> Column:
    """Segmentation image name to its label name."""
    return F.regexp_replace(image_name, "_naip-new_", "_lc_")


def label_key_biomass(cube_name: Column) -> Column:
    """Biomass cube name to its label raster name."""
    return F.concat(field(stem(cube_name), -1), F.lit("_agbm.tif"))
