"""Vector arithmetic on array columns, for row-wise pairs of vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.functions.binding import let


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column | str, b: Column | str) -> Column:
    return _total(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column | str) -> Column:
    return F.sqrt(_total(F.transform(_col(a), lambda x: x.cast("double") * x.cast("double"))))


def l2_distance(a: Column | str, b: Column | str) -> Column:
    square = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.sqrt(_total(F.zip_with(_col(a), _col(b), square)))


def cosine(a: Column | str, b: Column | str, eps: float = 1e-8) -> Column:
    """Cosine similarity; each norm is held above ``eps``."""
    floor = lambda v: F.greatest(norm(v), F.lit(eps))
    return dot(a, b) / (floor(a) * floor(b))


def lerp(a: Column, b: Column, alpha: Column) -> Column:
    """alpha * a + (1 - alpha) * b."""
    return F.zip_with(a, b, lambda x, y: alpha * x + (F.lit(1.0) - alpha) * y)


def splice(a: Column, b: Column, head: int) -> Column:
    """The first ``head`` entries of a, the rest from b."""
    return F.concat(F.slice(a, 1, head), F.slice(b, F.lit(head + 1), F.greatest(F.size(b) - head, F.lit(0))))


def argmax(scores: Column | str) -> Column:
    """0-based position of the first largest score."""
    scores = _col(scores)
    return F.array_position(scores, F.array_max(scores)) - 1


def mean_vector(vec: Column | str) -> Column:
    """Element-wise mean as an aggregate, combined on the map side."""
    return vector_to_array(Summarizer.mean(array_to_vector(_col(vec))))


def unravel(vec: Column | str, rows: int, cols: int, depth: int) -> Column:
    """Flat array to an array of (row, col, vals) structs; anything beyond rows*cols*depth is dropped."""
    numbers = F.sequence(F.lit(0), F.lit(rows * cols - 1))

    def cell(v: Column, i: Column) -> Column:
        row, col = F.floor(i / cols).cast("int"), (i % cols).cast("int")
        return F.struct(row.alias("row"), col.alias("col"), F.slice(v, i * depth + 1, depth).alias("vals"))

    return let(_col(vec), lambda v: F.transform(numbers, lambda i: cell(v, i)))
