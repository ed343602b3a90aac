"""Multi-level grid that turns box overlap into an equi-join.

A box lives on the level whose cell is just larger than its longer side, so it
touches at most four cells however large or small it is: there is no cell size
to tune and no oversize box to treat apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOWEST, HIGHEST = -20, 30  # cells of 2**-20 to 2**30 map units: at most 51 levels


def box_level(bbox: Column) -> Column:
    side = F.greatest(bbox["xmax"] - bbox["xmin"], bbox["ymax"] - bbox["ymin"], F.lit(2.0**LOWEST))
    return F.least(F.ceil(F.log2(side)).cast("int"), F.lit(HIGHEST))


def cell(v: Column, level: Column) -> Column:
    return F.floor(v / F.pow(F.lit(2.0), level))


def levels_of(df: DataFrame) -> Column:
    """Distinct ``_own`` levels as one small array, found by a subquery at run time."""
    found = df.agg(F.sort_array(F.collect_set("_own")).alias("levels"))
    return F.coalesce(found.scalar(), F.array().cast("array<int>"))


def with_cells(df: DataFrame, bbox: str) -> DataFrame:
    """One row per cell (``_ix``, ``_iy``) the box touches on its ``_level``."""
    b, level = F.col(bbox), F.col("_level")
    xs = F.sequence(cell(b["xmin"], level), cell(b["xmax"], level))
    ys = F.sequence(cell(b["ymin"], level), cell(b["ymax"], level))
    return df.withColumn("_ix", F.explode(xs)).withColumn("_iy", F.explode(ys))


KEYS = ["_level", "_ix", "_iy"]
