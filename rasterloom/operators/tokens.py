"""Patch-token tables, reductions and vector series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions import vectors as v
from rasterloom.plans.ranking import time_slices


def vector_mean(table: DataFrame, by: list[str], vec: str = "vec") -> DataFrame:
    """Element-wise mean per group."""
    return table.groupBy(*by).agg(v.mean_vector(vec).alias("vec"))


def reduce_level(
    tokens: DataFrame,
    level: str,
    by: list[str],
    length: int,
    groups: int = 1,
    specials: int = 0,
    class_token: bool = False,
) -> DataFrame:
    """Token rows (by, token_idx, vec) to one of the embedding levels.

    ``class`` picks the leading class token. ``mean`` averages patch tokens,
    ``patch`` averages over band groups and keeps (by, patch_idx), ``group``
    keeps every (by, group_idx, patch_idx). ``length`` is the encoder's fixed
    sequence length; its trailing ``specials`` (location, time) never count as
    patches.
    """
    first = 1 if class_token else 0
    if level == "class":
        if not class_token:
            raise ValueError("these tokens have no class token")
        return tokens.filter(F.col("token_idx") == 0).select(*by, "vec")
    patches = length - specials - first
    body = tokens.filter(F.col("token_idx").between(first, first + patches - 1))
    if level == "mean":
        return vector_mean(body, by)
    if patches % groups:
        raise ValueError(f"{patches} patches do not split into {groups} groups")
    per = patches // groups
    pos = F.col("token_idx") - first
    at = body.withColumn("patch_idx", (pos % per).cast("int")).withColumn(
        "group_idx", F.floor(pos / per).cast("int")
    )
    if level == "patch":
        return vector_mean(at, [*by, "patch_idx"])
    if level == "group":
        return at.select(*by, "group_idx", "patch_idx", "vec")
    raise ValueError(f"unknown level {level}")


def lerp_vectors(pairs: DataFrame, a: str, b: str, steps: int = 20) -> DataFrame:
    """``steps`` blends of each pair, alpha evenly from 0 to 1."""
    return pairs.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn(
        "vec", v.lerp(F.col(a), F.col(b), F.col("step") / F.lit(float(steps - 1)))
    )


def change_series(
    table: DataFrame, by: str, dt: str, key: str, event: Column, threshold: float, rows_per_slice: int = 1_000_000
) -> DataFrame:
    """Distance of each vector to the previous date and to the location's pre-event mean.

    The window runs per (location, slice), where only locations beyond
    ``rows_per_slice`` rows are cut into time slices; the first row of a slice
    finds its predecessor in a small table of slice ends.
    """
    rows = time_slices(table, by, dt, rows_per_slice)
    if rows is None:
        before = table.withColumn("_prev", F.lag("vec").over(Window.partitionBy(by).orderBy(dt, key)))
    else:
        inside = Window.partitionBy(by, "_slice").orderBy(dt, key)
        ends = rows.groupBy(by, "_slice").agg(F.max_by("vec", F.struct(dt, key)).alias("_end"))
        carried = ends.withColumn("_carry", F.lag("_end").over(Window.partitionBy(by).orderBy("_slice")))
        carried = carried.filter(F.col("_carry").isNotNull()).drop("_end")
        before = (
            rows.withColumn("_prev", F.lag("vec").over(inside))
            .join(carried, [by, "_slice"], "left")
            .withColumn("_prev", F.coalesce("_prev", "_carry"))
            .drop("_slice", "_carry")
        )
    base = table.filter(event).groupBy(by).agg(v.mean_vector("vec").alias("_base"))
    out = (
        before.join(base, by, "left")
        .withColumn("dist_prev", v.l2_distance("vec", "_prev"))
        .withColumn("dist_base", v.l2_distance("vec", "_base"))
    )
    flag = F.coalesce(F.col("dist_prev") > threshold, F.lit(False))
    return out.withColumn("shifted", flag).drop("_prev", "_base")
