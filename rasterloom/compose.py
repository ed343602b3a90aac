"""Chaining of DataFrame transforms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Step = Callable[[DataFrame], DataFrame]


def compose(*steps: Step) -> Step:
    """One transform out of many, applied in order; the result stays lazy."""

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df

    return run
