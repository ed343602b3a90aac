"""Spark ML on embedding tables."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    LinearSVC,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@contextmanager
def _kept(df: DataFrame):
    """Training rows held (spilling to disk) while an estimator passes over them again and again.

    They are spread evenly first, over at least one partition a core: adaptive
    execution would otherwise cache them in as few partitions as their bytes
    suggest, and training is bound by cores. The number follows the data through
    ``spark.sql.shuffle.partitions`` and has no upper bound of its own.
    """
    spark = df.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    df = df.repartition(width).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def _features(df: DataFrame, vec: str = "vec") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(vec).cast("array<double>")))


def _labelled(df: DataFrame, label: str, vec: str) -> DataFrame:
    return _features(df, vec).select("features", F.col(label).cast("double").alias("label"))


def pca(table: DataFrame, k: int, vec: str = "vec") -> DataFrame:
    """Centred principal components as ``pc``; each loading's largest entry is positive.

    The driver sees one d x d covariance, never a row.
    """
    steps = Pipeline(
        stages=[
            StandardScaler(inputCol="features", outputCol="centred", withMean=True, withStd=False),
            PCA(k=k, inputCol="centred", outputCol="_pc"),
        ]
    )
    ready = _features(table, vec)
    with _kept(ready.select("features")) as rows:
        fitted = steps.fit(rows)
    loadings = fitted.stages[1].pc.toArray()
    signs = [1.0 if col[abs(col).argmax()] >= 0 else -1.0 for col in loadings.T]
    flipped = F.zip_with(vector_to_array("_pc"), F.array(*[F.lit(s) for s in signs]), lambda v, s: v * s)
    return fitted.transform(ready).withColumn("pc", flipped).drop("features", "centred", "_pc")


def kmeans(table: DataFrame, k: int = 5, vec: str = "vec", seed: int = 42) -> DataFrame:
    ready = _features(table, vec)
    with _kept(ready.select("features")) as rows:
        fitted = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(rows)
    return fitted.transform(ready).drop("features")


def kmeans_places(table: DataFrame, k: int = 5, lon: str = "lon", lat: str = "lat", seed: int = 42) -> DataFrame:
    """Clusters of places by great-circle distance: ``cluster`` and its middle as ``centre_lon``, ``centre_lat``.

    Places are points of the unit sphere, so neither the date line nor a pole cuts a
    cluster; a centre is the mean direction. Rows without a place have NULLs.
    """
    x, y = F.radians(F.col(lon).cast("double")), F.radians(F.col(lat).cast("double"))
    ready = table.withColumn("_at", F.array(F.cos(y) * F.cos(x), F.cos(y) * F.sin(x), F.sin(y)))
    there = ready.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).withColumn("features", array_to_vector("_at"))
    with _kept(there.select("features")) as rows:
        fitted = KMeans(k=k, seed=seed, distanceMeasure="cosine", featuresCol="features", predictionCol="cluster").fit(rows)
    found = fitted.transform(there).drop("features")
    centres = np.array(fitted.clusterCenters())
    middle = np.degrees(np.stack([np.arctan2(centres[:, 1], centres[:, 0]), np.arctan2(centres[:, 2], np.hypot(centres[:, 0], centres[:, 1]))], axis=1))
    places = F.array(*[F.array(F.lit(float(a)), F.lit(float(b))) for a, b in middle])
    place = F.get(places, F.col("cluster"))
    none = ready.where(F.col(lon).isNull() | F.col(lat).isNull()).withColumn("cluster", F.lit(None).cast("int"))
    both = found.unionByName(none).drop("_at")
    return both.withColumns({"centre_lon": place[0], "centre_lat": place[1]})


def train_presence(
    merged: DataFrame, label: str = "class", vec: str = "vec", trees: int = 100, depth: int = 5, seed: int = 42
):
    """Random forest on labelled vectors; returns the fitted forest.

    More histogram memory per task lets all nodes of a level share one pass.
    """
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed, maxMemoryInMB=1024
    )
    with _kept(_labelled(merged, label, vec)) as rows:
        return forest.fit(rows)


class FourierSvm:
    """A linear machine on random cosine features: by Bochner's theorem the kernel of the features tends to the RBF kernel."""

    def __init__(self, scaler, weights: np.ndarray, shifts: np.ndarray, machine=None) -> None:
        self.scaler, self.weights, self.shifts, self.machine = scaler, weights, shifts, machine

    def features(self, df: DataFrame) -> DataFrame:
        """``features`` scaled, turned and bent, a batch of rows as one matrix product."""
        shared = df.sparkSession.sparkContext.broadcast((self.weights, self.shifts))  # set by two parameters

        @F.pandas_udf("array<double>")
        def bend(rows: pd.Series) -> pd.Series:
            weights, shifts = shared.value
            m = np.cos(np.stack(rows.to_numpy()) @ weights + shifts) * np.sqrt(2.0 / len(shifts)) if len(rows) else np.zeros((0, len(shifts)))
            return pd.Series(list(m))

        scaled = self.scaler.transform(df).drop("features").withColumn("bent", bend(vector_to_array("scaled")))
        return scaled.withColumn("features", array_to_vector("bent")).drop("scaled", "bent")

    def transform(self, df: DataFrame) -> DataFrame:
        return self.machine.transform(self.features(df))


def train_rbf_svm(
    table: DataFrame, label: str, vec: str = "vec", components: int = 512, gamma: float | None = None, reg: float = 1e-4, max_iter: int = 50, seed: int = 42
) -> FourierSvm:
    """One machine per class with (nearly) a radial basis kernel ``exp(-gamma d^2)`` on standardised inputs.

    ``gamma`` defaults to one over the number of dimensions. The error of the kernel
    falls with the square root of ``components``; the rows never move.
    """
    rows = _labelled(table, label, vec)
    with _kept(rows) as kept:
        scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(kept)
        dim, rng = len(scaler.mean), np.random.default_rng(seed)
        weights = rng.normal(size=(dim, components)) * np.sqrt(2.0 * (gamma if gamma is not None else 1.0 / dim))
        machine = FourierSvm(scaler, weights, rng.uniform(0, 2 * np.pi, components))
        with _kept(machine.features(kept)) as bent:
            machine.machine = OneVsRest(classifier=LinearSVC(maxIter=max_iter, regParam=reg), labelCol="label", parallelism=4).fit(bent)
    return machine


def train_svm(table: DataFrame, label: str, vec: str = "vec", max_iter: int = 50):
    """One linear support-vector machine per class, on standardised inputs."""
    steps = Pipeline(
        stages=[
            StandardScaler(inputCol="features", outputCol="scaled", withMean=True),
            OneVsRest(
                classifier=LinearSVC(maxIter=max_iter, featuresCol="scaled"),
                featuresCol="scaled",
                labelCol="label",
                parallelism=4,
            ),
        ]
    )
    with _kept(_labelled(table, label, vec)) as rows:
        return steps.fit(rows)


def train_mlp_head(table: DataFrame, label: str, classes: int, dim: int, vec: str = "vec", hidden: int = 512, seed: int = 42, max_iter: int = 50):
    """One hidden layer on class-token vectors."""
    head = MultilayerPerceptronClassifier(
        layers=[dim, hidden, classes], featuresCol="features", labelCol="label", seed=seed, maxIter=max_iter
    )
    with _kept(_labelled(table, label, vec)) as rows:
        return head.fit(rows)


def predict(fitted, table: DataFrame, keep: list[str], vec: str = "vec") -> DataFrame:
    """(keep..., prediction) for every row."""
    scored = fitted.transform(_features(table, vec))
    return scored.select(*keep, F.col("prediction").cast("int").alias("prediction"))
