"""Bulk embedding with a pluggable encoder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rasterloom.operators.bands import attach_band_meta, known


class Encoder(Protocol):
    """One platform's chips to vectors."""

    def __call__(
        self, pixels: np.ndarray, time: np.ndarray, latlon: np.ndarray, waves: np.ndarray, gsd: float
    ) -> np.ndarray: ...


class PatchMeanEncoder:
    """Deterministic stand-in for a trained network.

    Patch means are projected on cosines of wavelength and patch position; time
    and location shift the result. Works for any sensor, size and band count.
    """

    def __init__(self, dim: int = 16, grid: int = 2) -> None:
        self.dim, self.grid = dim, grid

    def __call__(self, pixels, time, latlon, waves, gsd):
        n, c, h, w = pixels.shape
        g = self.grid
        ph, pw = h // g, w // g
        tiles = pixels[:, :, : ph * g, : pw * g].reshape(n, c, g, ph, g, pw)
        means = tiles.mean(axis=(3, 5)).reshape(n, c, g * g)
        place = waves[:, None] + np.arange(1, g * g + 1)[None, :] * (gsd / 10.0)
        basis = np.cos(place[None] * np.arange(1, self.dim + 1)[:, None, None])
        extra = np.hstack([time, latlon])
        shift = extra[:, np.arange(self.dim) % extra.shape[1]]
        return np.tensordot(means, basis, axes=([1, 2], [1, 2])) / (c * g * g) + 0.01 * shift


class OnnxEncoder:
    """A network file run by onnxruntime; ``feeds`` names the inputs it takes, in any subset.

    The session opens once per task, on first use. ``path`` must be readable
    from every executor (a shared folder or a shipped file).
    """

    def __init__(self, path: str, feeds: dict[str, str], output: int = 0) -> None:
        self.path, self.feeds, self.output = path, feeds, output
        self._session = None

    def __getstate__(self):
        return {**self.__dict__, "_session": None}

    def __call__(self, pixels, time, latlon, waves, gsd):
        if self._session is None:
            import onnxruntime

            self._session = onnxruntime.InferenceSession(self.path, providers=["CPUExecutionProvider"])
        inputs = {"pixels": pixels, "time": time, "latlon": latlon, "waves": waves, "gsd": np.asarray(gsd)}
        inputs["flat"] = pixels.reshape(len(pixels), -1)
        given = {name: np.asarray(inputs[source], np.float32) for name, source in self.feeds.items()}
        return np.asarray(self._session.run(None, given)[self.output], np.float64).reshape(len(pixels), -1)


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def embed_chips(
    chips: DataFrame,
    registry: DataFrame,
    encoder: Encoder | Callable[..., np.ndarray],
    keep: list[str],
    batch: int = 32,
    unknown: str = "error",
) -> DataFrame:
    """Vectors of all chips: (keep..., vec).

    Chips stay in their partitions: an Arrow batch is cut into single-platform,
    equal-shape runs of at most ``batch`` chips for the encoder. Missing time or
    location is all zeros. Chips of a sensor that the registry lacks stop the job
    with its name, or come out with a NULL vector if ``unknown`` is ``"null"``.
    """
    zeros = F.array(*[F.lit(0.0)] * 4)
    for name in ("time", "latlon"):
        if name not in chips.columns:
            chips = chips.withColumn(name, zeros)
    ready = attach_band_meta(chips, registry)
    ready = ready.withColumn("waves", known(F.col("waves"), F.col("platform"), F.col("waves"), unknown))
    ready = ready.select(
        *keep,
        F.col("platform").alias("_platform"),
        F.col("h").alias("_h"),
        F.col("w").alias("_w"),
        F.col("gsd").alias("_gsd"),
        F.col("waves").alias("_waves"),
        F.col("time").cast("array<double>").alias("_time"),
        F.col("latlon").cast("array<double>").alias("_latlon"),
        F.col("pixels").cast("array<array<double>>").alias("_pixels"),
    )
    schema = T.StructType([*[ready.schema[k] for k in keep], T.StructField("vec", T.ArrayType(T.DoubleType()))])
    arrow = to_arrow_schema(schema)
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            col = {name: rows.column(i) for i, name in enumerate(rows.schema.names)}
            shape = list(zip(*(col[c].to_pylist() for c in ("_platform", "_h", "_w", "_gsd"))))
            for one in dict.fromkeys(shape):
                members = np.flatnonzero([s == one for s in shape])
                _, h, w, gsd = one
                if col["_waves"][int(members[0])].as_py() is None:
                    part = rows.take(pa.array(members))
                    none = pa.nulls(len(members), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(n_keep)], none], schema=arrow)
                    continue
                for lo in range(0, len(members), batch):
                    take = pa.array(members[lo : lo + batch])
                    part = rows.take(take)
                    at = {name: part.column(i) for i, name in enumerate(part.schema.names)}
                    waves = np.asarray(at["_waves"][0].as_py(), np.float64)
                    values = at["_pixels"].flatten().flatten().to_numpy(zero_copy_only=False)
                    pixels = values.astype(np.float64).reshape(len(part), len(waves), h, w)
                    vec = np.asarray(encoder(pixels, _rows(at["_time"]), _rows(at["_latlon"]), waves, gsd), np.float64)
                    offsets = pa.array(np.arange(len(part) + 1) * vec.shape[1], pa.int32())
                    lists = pa.ListArray.from_arrays(offsets, pa.array(vec.reshape(-1), pa.float64()))
                    yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(n_keep)], lists], schema=arrow)

    return ready.mapInArrow(run, schema)
