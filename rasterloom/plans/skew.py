"""Equi-joins that survive a hot key, on one side or on both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.plans.scratch import materialise

ROWS_PER_TASK = 1_000_000


def hot_keys(big: DataFrame, small: DataFrame | None, keys: list[str], rows_per_task: int) -> DataFrame:
    """Keys with more than ``rows_per_task`` rows on a side that is given, and into how many parts each side is cut."""

    def crowded(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > rows_per_task)

    none = F.lit(None).cast("long").alias("_b")
    both = crowded(big, "_a").join(crowded(small, "_b"), keys, "full") if small is not None else crowded(big, "_a").select("*", none)
    parts = [F.ceil(F.coalesce(F.col(n), F.lit(1)) / rows_per_task).cast("int").alias(p) for n, p in (("_a", "_rows"), ("_b", "_cols"))]
    return materialise(both.select(*keys, *parts), "hot-keys")


def hot_grid(big: DataFrame, small: DataFrame, hot: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of hot keys dealt over a grid (``_r``, ``_c``): a row of ``big`` lies in one grid row, one of ``small`` in one column.

    Rows are dealt by a number that is written out with them, so equal rows are spread
    as well, and a task that runs again deals as before.
    """

    def dealt(df: DataFrame, own: str, parts: str, other: str, others: str) -> DataFrame:
        numbered = materialise(df.join(hot, keys).withColumn("_id", F.monotonically_increasing_id()), "hot-rows")
        placed = numbered.withColumn(own, F.pmod(F.xxhash64("_id"), F.col(parts)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1))).drop("_id", "_rows", "_cols")

    return dealt(big, "_r", "_rows", "_c", "_cols"), dealt(small, "_c", "_cols", "_r", "_rows")


def salted_join(
    big: DataFrame, small: DataFrame, keys: list[str], rows_per_task: int = ROWS_PER_TASK, both: bool = False
) -> DataFrame:
    """Inner equi-join; a key with more than ``rows_per_task`` rows in ``big`` becomes a row of tasks, or a grid.

    With ``both`` the rows of ``small`` are counted as well, and each task of a grid
    holds about ``rows_per_task`` rows of either side, even if both sides are crowded
    in the same key; without it ``small`` is taken to have few rows a key and is
    not computed twice. All other keys meet in a plain join, and so does everything
    if no key is hot.
    """
    hot = hot_keys(big, small if both else None, keys, rows_per_task)
    if not hot.limit(1).count():
        return big.join(small, keys)
    names = hot.select(*keys)
    cold = big.join(names, keys, "left_anti").join(small.join(names, keys, "left_anti"), keys)
    left, right = hot_grid(big, small, hot, keys)
    return cold.unionByName(left.join(right, [*keys, "_r", "_c"]).drop("_r", "_c"))
