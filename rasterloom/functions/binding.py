"""Evaluate an expression once per row inside higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A column mentioned inside a lambda is evaluated per element, and the
    optimizer may put the whole expression behind the column there. A lambda
    variable is a plain lookup.
    """
    return F.transform(F.array(value), body)[0]
