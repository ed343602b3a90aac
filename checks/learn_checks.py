"""Estimators on embeddings: SQL checks what it can (invariants), tests the properties."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import standins as s
from checks.registry import check
from rasterloom.operators import learn, search, spatial
from rasterloom.operators.metrics import classification_metrics
from rasterloom.operators.sampling import random_split
from rasterloom.plans.scratch import materialise


@check("v6_knn_lsh")
def _(t):
    emb = s.embeddings(t)
    queries = emb.groupBy("label").agg(F.min("vec_id").alias("query_id"), F.min_by("vec", "vec_id").alias("vec"))
    return search.knn_lsh(emb, queries.select("query_id", "vec"), 10, radius=2.0, bucket_length=0.5)


@check("v7_pca")
def _(t):
    return learn.pca(s.embeddings(t), 2).select("vec_id", "pc")


@check(
    "v6_lsh_finds_itself",
    "SELECT min(vec_id) AS query_id, min(vec_id) AS neighbour_id, 0.0::DOUBLE AS distance FROM embeddings GROUP BY label",
)
def _(t):
    emb = s.embeddings(t)
    queries = emb.groupBy("label").agg(F.min("vec_id").alias("query_id"), F.min_by("vec", "vec_id").alias("vec"))
    found = search.knn_lsh(emb, queries.select("query_id", "vec"), 10, radius=2.0, bucket_length=0.5)
    return found.where("rank = 1").select("query_id", "neighbour_id", "distance")


@check(
    "v7_pca_norms",
    f"""
    WITH c AS (SELECT vec_id, v - avg(v) OVER (PARTITION BY pos) AS d FROM {s.ENTRIES})
    SELECT vec_id, round(sqrt(sum(d * d)), 5) AS norm FROM c GROUP BY vec_id
    """,
)
def _(t):
    """All components together turn the centred vectors and keep their lengths."""
    turned = learn.pca(s.embeddings(t), 64)
    norm = F.sqrt(F.aggregate("pc", F.lit(0.0), lambda a, x: a + x * x))
    return turned.select("vec_id", F.round(norm, 5).alias("norm"))


@check("v7_pca_timeline")
def _(t):
    """One component, as a timeline of a place uses it."""
    return learn.pca(s.embeddings(t), 1).select("vec_id", "pc")


@check("v8_kmeans_on_components")
def _(t):
    turned = learn.pca(s.embeddings(t), 8).select("vec_id", F.col("pc").alias("vec"))
    return learn.kmeans(turned, 5).select("vec_id", "cluster")


@check("v8_kmeans")
def _(t):
    return learn.kmeans(s.embeddings(t), 5).select("vec_id", "cluster")


def _labelled(t):
    """Footprints that labelled points fall into, split by (point, footprint), with their vectors."""
    # written once: the split counts, marks and flags the same hits
    hits = materialise(spatial.spatial_join(s.footprints(t), s.points(t)).select("vec_id", "point_id", "class"), "hits")
    return random_split(hits, ["point_id", "vec_id"]).join(s.embeddings(t), "vec_id")


@check("v9_train_presence")
def _(t):
    fitted = learn.train_presence(_labelled(t).filter("split = 'train'"))
    # p13 keeps the detected rows; here every prediction is shown
    return learn.predict(fitted, s.embeddings(t), ["vec_id"])


@check("v9_presence_metrics")
def _(t):
    rows = _labelled(t)
    fitted = learn.train_presence(rows.filter("split = 'train'"))
    tested = learn.predict(fitted, rows.filter("split = 'test'"), ["class"])
    return classification_metrics(tested, "class", "prediction", positive=1)


def _three(t):
    return random_split(s.embeddings(t).withColumn("kind", F.col("label") % 3), ["vec_id"])


@check("v10_train_svm")
def _(t):
    rows = _three(t)
    fitted = learn.train_svm(rows.filter("split = 'train'"), "kind")
    return learn.predict(fitted, rows.filter("split = 'test'"), ["vec_id", "kind"])


@check("v10_rbf_svm_separates_rings", "SELECT count(*) AS tested, true AS nine_in_ten FROM embeddings WHERE vec_id % 4 = 0")
def _(t):
    """Inside or outside a circle of two components, which no line separates; three quarters teach, SQL states the share to be met."""
    emb = s.embeddings(t).withColumn("vec", F.slice("vec", 1, 2))
    size = emb.withColumn("size", F.col("vec")[0] * F.col("vec")[0] + F.col("vec")[1] * F.col("vec")[1])
    middle = size.agg(F.percentile("size", 0.5).alias("m"))
    rows = size.withColumn("kind", (F.col("size") > middle.scalar()).cast("int"))
    fitted = learn.train_rbf_svm(rows.where("vec_id % 4 > 0"), "kind", components=128, max_iter=20)
    tested = learn.predict(fitted, rows.where("vec_id % 4 = 0"), ["kind"])
    return tested.agg(F.count("*").alias("tested"), (F.avg((F.col("kind") == F.col("prediction")).cast("int")) >= 0.9).alias("nine_in_ten"))


@check("v8_kmeans_places_date_line", "SELECT count(*) AS places, count(DISTINCT c_custkey % 4) AS pairs FROM customer")
def _(t):
    """Four groups of places a quarter of the globe apart, one of them on both sides of the date line: a cluster each."""
    group = F.col("point_id") % 4
    apart = s.points(t).select(group.alias("kind"), ((F.col("lon") + 170 + 90 * group + 180) % 360 - 180).alias("lon"), "lat")
    found = learn.kmeans_places(apart, 4)
    return found.agg(F.count("*").alias("places"), F.count_distinct("kind", "cluster").alias("pairs"))


@check("v11_train_mlp_head")
def _(t):
    rows = _three(t)
    fitted = learn.train_mlp_head(rows.filter("split = 'train'"), "kind", 3, 64)
    return learn.predict(fitted, rows.filter("split = 'test'"), ["vec_id", "kind"])
