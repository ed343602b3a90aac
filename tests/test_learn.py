"""Estimators on data whose answer is known."""

import numpy as np
import pytest

from rasterloom.operators import learn


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    rows = [(i, (rng.normal(scale=0.3, size=4) + 6 * np.eye(4)[i % 3]).tolist(), i % 3) for i in range(120)]
    return spark.createDataFrame(rows, "vec_id int, vec array<double>, kind int").cache()


def test_pca_equals_numpy(blobs):
    got = learn.pca(blobs, 2).orderBy("vec_id").toPandas()
    m = np.array(got["vec"].tolist())
    _, _, vt = np.linalg.svd(m - m.mean(0), full_matrices=False)
    load = vt[:2] * np.sign(vt[:2][np.arange(2), np.abs(vt[:2]).argmax(1)])[:, None]
    assert np.allclose(np.array(got["pc"].tolist()), (m - m.mean(0)) @ load.T, atol=1e-8)


def test_kmeans_finds_the_blobs(blobs):
    pairs = learn.kmeans(blobs, 3).select("kind", "cluster").distinct()
    assert pairs.count() == 3


@pytest.mark.parametrize("fit", ["forest", "svm", "mlp"])
def test_classifiers_separate_the_blobs(blobs, fit):
    fitted = {
        "forest": lambda: learn.train_presence(blobs, "kind", trees=5),
        "svm": lambda: learn.train_svm(blobs, "kind", max_iter=5),
        "mlp": lambda: learn.train_mlp_head(blobs, "kind", 3, 4, hidden=8, max_iter=30),
    }[fit]()
    scored = learn.predict(fitted, blobs, ["kind"])
    assert scored.filter("kind = prediction").count() >= 115
