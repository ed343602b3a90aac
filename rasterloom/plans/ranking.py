"""Exact ranks and cuts that never put one group into one task.

``row_number() over (partition by g order by draw)`` sends a whole group to one
task. Draws are uniform, so their leading hex digits cut every group, however
large, into equal slices in rank order. Slice sizes are counted first (partially
aggregated on the map side) and summed up into offsets; the number of digits
follows from the sizes found. The window then runs per (group, slice).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterloom.functions.draws import draw
from rasterloom.plans.scratch import materialise

SLICE_DIGITS = 3  # 16**3 = 4096 slices per group to begin with
ROWS_PER_SLICE = 1_000_000
DRAW_DIGITS = 32


def _sliced(df: DataFrame, by: list[str], drawn: Column, digits: int) -> DataFrame:
    group = F.struct(*[F.col(c) for c in by]) if by else F.lit(0)
    return (
        df.withColumn("_draw", drawn)
        .withColumn("_group", group)  # struct equality keeps NULL keys together
        .withColumn("_slice", F.substring("_draw", 1, digits))
    )


def _offsets(sliced: DataFrame) -> DataFrame:
    """Rows per slice, rows before it and rows in its group: at most 16**digits rows a group."""
    per_slice = sliced.groupBy("_group", "_slice").agg(F.count(F.lit(1)).alias("_here"))
    ordered = Window.partitionBy("_group").orderBy("_slice")
    return per_slice.withColumn(
        "_before", F.sum("_here").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_here")
    ).withColumn("_size", F.sum("_here").over(Window.partitionBy("_group")))


def _measured(df: DataFrame, by: list[str], drawn: Column, rows_per_slice: int) -> tuple[DataFrame, DataFrame]:
    """Sliced rows and their counted offsets, with slices of ``rows_per_slice`` rows at most.

    The counts (a partial aggregate) are written out. Where a slice turns out too
    large, more digits follow from its size and the rows are counted once more.
    """
    digits = SLICE_DIGITS
    while True:
        sliced = _sliced(df, by, drawn, digits)
        counted = materialise(_offsets(sliced), "slices")
        most = counted.agg(F.max("_here")).first()[0] or 0
        if most <= rows_per_slice or digits >= DRAW_DIGITS:
            return sliced, counted
        digits = min(DRAW_DIGITS, digits + max(1, math.ceil(math.log(most / rows_per_slice, 16))))


def draw_rank(
    df: DataFrame,
    by: list[str],
    key: list[str],
    seed: int | str | Column,
    rank: str = "rank",
    size: str | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Add the 1-based rank of each row's draw within its group (and the group size).

    ``key`` must be unique in the group; it breaks the (md5) ties.
    """
    sliced, counted = _measured(df, by, draw(seed, *key), rows_per_slice)
    local = Window.partitionBy("_group", "_slice").orderBy("_draw", *key)
    # rank first: the offsets then join on the partitioning the window already has
    placed = sliced.withColumn("_local", F.row_number().over(local)).drop("_draw")
    out = placed.join(counted, ["_group", "_slice"]).withColumn(rank, F.col("_before") + F.col("_local"))
    if size:
        out = out.withColumn(size, F.col("_size"))
    return out.drop("_local", "_group", "_slice", "_here", "_before", "_size")


def draw_within(
    df: DataFrame,
    by: list[str],
    key: list[str],
    seed: int | str | Column,
    quota: Column,
    flag: str = "within",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Flag exactly the first ``quota`` rows of each group in draw order; ``quota`` may use ``group_size``.

    Only the slice that holds a group's last row within the quota is ranked. That row is the group's mark, and every other row is
    compared with it. Marks (one row per group) are written out first, so Spark
    knows their true size when it decides whether to broadcast them, and the
    rows themselves then need no shuffle.
    """
    sliced, counted = _measured(df, by, draw(seed, *key), rows_per_slice)  # counted once, used twice
    offsets = counted.withColumn("group_size", F.col("_size")).withColumn("_quota", quota.cast("bigint"))
    before, here, cut = F.col("_before"), F.col("_here"), F.col("_quota")
    edge = offsets.filter((before < cut) & (cut <= before + here)).select(
        "_group", "_slice", (cut - before).alias("_need")
    )
    local = Window.partitionBy("_group", "_slice").orderBy("_draw", *key)
    last = (
        sliced.join(edge, ["_group", "_slice"])
        .withColumn("_local", F.row_number().over(local))
        .filter(F.col("_local") == F.col("_need"))
        .select("_group", F.struct("_draw", *key).alias("_last"))
    )
    groups = offsets.groupBy("_group").agg(F.max("_quota").alias("_quota"), F.max("_size").alias("_size"))

    def inside(quota: Column, size: Column, last: Column) -> Column:
        return (
            F.when(quota >= size, True).when(quota <= 0, False).otherwise(F.struct("_draw", *key) <= last)
        )

    if not by:  # one group, one mark: two single rows, no join
        whole, mark = groups.first(), last.first()
        if whole is None:
            return df.withColumn(flag, F.lit(False))
        if mark is None:
            return df.withColumn(flag, F.lit(whole["_quota"] >= whole["_size"]))
        kind = last.schema["_last"].dataType
        at = F.struct(*[F.lit(mark["_last"][f.name]).cast(f.dataType).alias(f.name) for f in kind.fields])
        flagged = sliced.withColumn(flag, inside(F.lit(whole["_quota"]), F.lit(whole["_size"]), at))
        return flagged.drop("_draw", "_group", "_slice")

    marks = materialise(groups.join(last, "_group", "left"), "marks")
    return (
        sliced.join(marks, "_group")
        .withColumn(flag, inside(F.col("_quota"), F.col("_size"), F.col("_last")))
        .drop("_draw", "_group", "_slice", "_quota", "_size", "_last")
    )


def draw_cut(
    df: DataFrame, by: list[str], key: list[str], seed: int | str | Column, quota: Column, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Keep exactly the first ``quota`` rows of each group in draw order."""
    marked = draw_within(df, by, key, seed, quota, "_within", rows_per_slice)
    return marked.filter("_within").drop("_within")


def top_per_group(
    df: DataFrame,
    by: list[str],
    order: list[Column],
    k: int,
    spread_on: list[str],
    rank: str = "rank",
    fan: int = 64,
) -> DataFrame:
    """The first ``k`` rows per group in a caller-given order, ranked.

    A pass over ``fan`` salted sub-groups leaves at most ``fan * k`` rows per
    group for the final window, so a hot group is never sorted in one task. For
    k up to ``spark.sql.optimizer.windowGroupLimitThreshold`` Spark also cuts
    each map task's groups to k rows before either shuffle.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*spread_on), F.lit(fan)))
    first = Window.partitionBy(*by, "_salt").orderBy(*order)
    last = Window.partitionBy(*by).orderBy(*order)
    return (
        salted.withColumn("_r", F.row_number().over(first))
        .filter(F.col("_r") <= k)
        .withColumn(rank, F.row_number().over(last))
        .filter(F.col(rank) <= k)
        .drop("_salt", "_r")
    )


def best_row(df: DataFrame, by: list[Column | str], order: list[str], keep: list[str]) -> DataFrame:
    """One row per group, least in ``order``: a plain aggregate with map-side combine."""
    best = F.min(F.struct(*order, *[c for c in keep if c not in order])).alias("_best")
    agg = df.groupBy(*by).agg(best)
    names = [c for c in agg.columns if c != "_best"]
    return agg.select(*names, *[F.col(f"_best.{c}").alias(c) for c in keep])


def time_slices(
    df: DataFrame, by: str, dt: str, rows_per_slice: int = 1_000_000, most: int = 1024
) -> DataFrame | None:
    """Add ``_slice``: consecutive time ranges of a group, for groups too large for one task.

    None when no group has more than ``rows_per_slice`` rows. Otherwise the large
    groups are cut at approximate time quantiles and all others are slice 0. The
    cuts (at most ``most`` per large group, and there are at most ``rows /
    rows_per_slice`` large groups) are written out once, so that every use of the
    slices sees the same ones and Spark knows their size when it picks a join.
    """
    large = materialise(
        df.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_slice).select(by), "large"
    )
    if large.isEmpty():
        return None
    micros = F.unix_micros(F.col(dt).cast("timestamp"))
    shares = [i / most for i in range(1, most)]
    cuts = (
        df.join(large, by)
        .groupBy(by)
        .agg(F.array_distinct(F.percentile_approx(micros, shares, 100 * most)).alias("_cuts"))
    )
    cuts = materialise(cuts, "cuts")
    place = F.size(F.filter("_cuts", lambda c: c < micros))
    return (
        df.join(cuts, by, "left")
        .withColumn("_slice", F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(place))
        .drop("_cuts")
    )
