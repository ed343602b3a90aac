"""Seeded, partition-independent draws.

A draw is the md5 of ``seed:part:part...``. It depends on the row's own key and
nothing else, so a retried task or a different partitioning gives the same
numbers, and any other engine with md5 can reproduce them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(part: Column | str | int) -> Column:
    if isinstance(part, Column):
        return part
    return F.col(part) if isinstance(part, str) else F.lit(part)


def draw(seed: int | str | Column, *parts: Column | str | int) -> Column:
    """32 hex digits, uniform over keys."""
    head = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(
        F.concat_ws(":", head.cast("string"), *[_col(p).cast("string") for p in parts]).cast("binary")
    )


def uniform(seed: int | str | Column, *parts: Column | str | int) -> Column:
    """A double in [0, 1) from the first eight hex digits of the draw."""
    head = F.substring(draw(seed, *parts), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(4294967296.0)
