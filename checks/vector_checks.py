"""Vector arithmetic, token reductions and neighbour search."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import standins as s
from checks.registry import check
from rasterloom.functions import vectors as v
from rasterloom.operators import search, tokens, vector_index
from rasterloom.plans.scratch import scratch_path

EMB, ENT = s.EMBEDDINGS, s.ENTRIES
K = 10


@check(
    "a5_vector_mean",
    f"SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(v), 6) AS v FROM {ENT} GROUP BY label, pos",
)
def _(t):
    return s.vector_rows(tokens.vector_mean(s.embeddings(t), ["label"]), ["label"])


def _pairs(t):
    """Each vector next to the mean of its label: as many pairs as vectors."""
    means = tokens.vector_mean(s.embeddings(t), ["label"]).withColumnRenamed("vec", "mate")
    return s.embeddings(t).join(means, "label")


_MATE = f"(SELECT e.vec_id, e.label, e.pos, e.v AS a, avg(e.v) OVER (PARTITION BY e.label, e.pos) AS b FROM {ENT} e)"


@check(
    "f13_lerp_vectors",
    f"""
    SELECT vec_id, CAST(step AS INTEGER) AS step, round(sum(abs((step / 19.0::DOUBLE) * a + (1 - step / 19.0::DOUBLE) * b)), 6) AS l1
    FROM {_MATE}, range(20) r(step) GROUP BY vec_id, step
    """,
)
def _(t):
    blended = tokens.lerp_vectors(_pairs(t), "vec", "mate", 20)
    total = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + F.abs(x))
    return blended.select("vec_id", "step", F.round(total, 6).alias("l1"))


@check(
    "f14_splice_vectors",
    f"SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(CASE WHEN pos < 24 THEN a ELSE b END, 6) AS v FROM {_MATE}",
)
def _(t):
    spliced = _pairs(t).withColumn("vec", v.splice(F.col("vec"), F.col("mate"), 24))
    return s.vector_rows(spliced, ["vec_id"])


@check(
    "f15_cosine",
    f"""
    SELECT vec_id, round(sum(a * b) / (greatest(sqrt(sum(a * a)), 1e-8) * greatest(sqrt(sum(b * b)), 1e-8)), 6) AS cosine
    FROM {_MATE} GROUP BY vec_id
    """,
)
def _(t):
    return _pairs(t).select("vec_id", F.round(v.cosine("vec", "mate"), 6).alias("cosine"))


@check(
    "f16_argmax",
    f"SELECT vec_id, list_position(vec, list_max(vec)) - 1 AS best FROM {EMB}",
)
def _(t):
    return s.embeddings(t).select("vec_id", v.argmax("vec").cast("int").alias("best"))


@check(
    "f19_unravel",
    f"""
    SELECT vec_id, CAST(pos // 15 // 2 AS INTEGER) AS row, CAST(pos // 15 % 2 AS INTEGER) AS col,
           CAST(pos % 15 AS INTEGER) AS pos, round(v, 6) AS v FROM {ENT} WHERE pos < 60
    """,
)
def _(t):
    cells = s.embeddings(t).select("vec_id", F.explode(v.unravel("vec", 2, 2, 15)).alias("c"))
    return s.vector_rows(cells.select("vec_id", "c.row", "c.col", F.col("c.vals").alias("vec")), ["vec_id", "row", "col"])


def _tokens(t):
    """Each vector as 16 tokens of width 4: class, 2 groups x 6 patches, ..., 3 specials."""
    return s.embeddings(t).select(
        "vec_id",
        F.posexplode(
            F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("vec", i * 4 + 1, 4))
        ).alias("token_idx", "vec"),
    )


_TOK = f"(SELECT vec_id, pos // 4 AS token_idx, pos % 4 AS d, v FROM {ENT})"


@check(
    "v2_reduce_level",
    f"""
    SELECT 'class' AS level, vec_id, -1 AS group_idx, -1 AS patch_idx, CAST(d AS INTEGER) AS pos, round(v, 6) AS v
    FROM {_TOK} WHERE token_idx = 0
    UNION ALL SELECT 'mean', vec_id, -1, -1, CAST(d AS INTEGER), round(avg(v), 6)
    FROM {_TOK} WHERE token_idx BETWEEN 1 AND 12 GROUP BY vec_id, d
    UNION ALL SELECT 'patch', vec_id, -1, CAST((token_idx - 1) % 6 AS INTEGER) AS p, CAST(d AS INTEGER), round(avg(v), 6)
    FROM {_TOK} WHERE token_idx BETWEEN 1 AND 12 GROUP BY vec_id, p, d
    UNION ALL SELECT 'group', vec_id, CAST((token_idx - 1) // 6 AS INTEGER), CAST((token_idx - 1) % 6 AS INTEGER), CAST(d AS INTEGER), round(v, 6)
    FROM {_TOK} WHERE token_idx BETWEEN 1 AND 12
    """,
)
def _(t):
    out = None
    for level in ("class", "mean", "patch", "group"):
        df = tokens.reduce_level(_tokens(t), level, ["vec_id"], 16, groups=2, specials=3, class_token=True)
        for c in ("group_idx", "patch_idx"):
            if c not in df.columns:
                df = df.withColumn(c, F.lit(-1))
        df = s.vector_rows(df.withColumn("level", F.lit(level)), ["level", "vec_id", "group_idx", "patch_idx"])
        out = df if out is None else out.unionByName(df)
    return out


def _first_per_label(t):
    """The lowest id of each label is the query, as a user would name one chip per class."""
    best = s.embeddings(t).groupBy("label").agg(F.min_by("vec", "vec_id").alias("vec"), F.min("vec_id").alias("query_id"))
    return best.select("query_id", "vec")


def _top(pairs: str, k: int = K) -> str:
    return f"""
    SELECT query_id, neighbour_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM ({pairs}))
    WHERE rank <= {k}
    """


_FIRST = f"(SELECT min(vec_id) AS query_id, arg_min(vec, vec_id) AS vec FROM {EMB} GROUP BY label)"


def _rounded(found):
    return found.withColumn("distance", F.round("distance", 6))


@check(
    "v3_knn",
    _top(f"SELECT q.query_id, c.vec_id AS neighbour_id, list_distance(q.vec, c.vec) AS distance FROM {_FIRST} q, {EMB} c"),
)
def _(t):
    return _rounded(search.knn(s.embeddings(t), _first_per_label(t), K))


@check(
    "v3_knn_cosine",
    _top(
        f"SELECT q.query_id, c.vec_id AS neighbour_id, 1 - list_cosine_similarity(q.vec, c.vec) AS distance FROM {_FIRST} q, {EMB} c"
    ),
)
def _(t):
    found = search.knn(s.embeddings(t), _first_per_label(t), K, metric="cosine")
    # a query's distance to itself is zero up to rounding: keep -0.0 out
    return found.withColumn("distance", F.round(F.abs("distance"), 6))


_EVERY = f"SELECT q.vec_id AS query_id, c.vec_id AS neighbour_id, %s AS distance FROM {EMB} q, {EMB} c"


@check("v3_knn_join", _top(_EVERY % "list_distance(q.vec, c.vec)"))
def _(t):
    """Every row asks: more queries than one block, met cell by cell."""
    every = s.embeddings(t)
    return _rounded(search.knn(every, every.select(F.col("vec_id").alias("query_id"), "vec"), K, block_bytes=1, pivots=24))


@check("v3_knn_join_cosine", _top(_EVERY % "1 - list_cosine_similarity(q.vec, c.vec)"))
def _(t):
    every = s.embeddings(t)
    found = search.knn(every, every.select(F.col("vec_id").alias("query_id"), "vec"), K, metric="cosine", block_bytes=1, pivots=24)
    return found.withColumn("distance", F.round(F.abs("distance"), 6))


@check(
    "v6_index_recall",
    "SELECT count(*) AS queries, true AS found_nine_in_ten, true AS distances_exact FROM embeddings WHERE vec_id % 20 = 0",
)
def _(t):
    """Every twentieth row asks the stored index; SQL states what recall and distances must come to."""
    every = s.embeddings(t)
    queries = every.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vec")
    path = scratch_path(t.spark, "vector-index")
    vector_index.build_index(every, path)
    found = vector_index.search_index(vector_index.open_index(t.spark, path), queries, K, every.schema["vec_id"].dataType)
    exact = search.knn(every, queries, K).select("query_id", "neighbour_id", F.col("distance").alias("exact"))
    both = exact.join(found.select("query_id", "neighbour_id", "distance"), ["query_id", "neighbour_id"], "left")
    return both.agg(
        F.count_distinct("query_id").alias("queries"),
        (F.count("distance") >= 0.9 * F.count("exact")).alias("found_nine_in_ten"),
        (F.coalesce(F.max(F.abs(F.col("distance") - F.col("exact"))), F.lit(0.0)) < 1e-9).alias("distances_exact"),
    )


@check(
    "v4_knn_filtered",
    f"""
    WITH m AS (SELECT label AS query_id, pos, avg(v) AS b FROM {ENT} GROUP BY label, pos),
    d AS (SELECT m.query_id, e.vec_id AS neighbour_id, sqrt(sum((e.v - m.b) * (e.v - m.b))) AS distance
          FROM {ENT} e JOIN m USING (pos) WHERE e.label <> 0 GROUP BY m.query_id, e.vec_id)
    """
    + _top("SELECT * FROM d"),
)
def _(t):
    emb = s.embeddings(t).withColumn("query_id", F.col("label"))
    return _rounded(search.knn_filtered(emb, emb, K, "query_id", F.col("label") != 0))


@check(
    "v12_knn_prefix",
    " UNION ALL ".join(
        f"SELECT {p} AS prefix, * FROM ("
        + _top(
            f"SELECT q.query_id, c.vec_id AS neighbour_id, list_distance(q.vec[1:{p}], c.vec[1:{p}]) AS distance FROM {_FIRST} q, {EMB} c"
        )
        + ")"
        for p in (16, 32, 64)
    ),
)
def _(t):
    out = None
    for p in (16, 32, 64):
        found = _rounded(search.knn_prefix(s.embeddings(t), _first_per_label(t), p, K)).withColumn("prefix", F.lit(p))
        out = found if out is None else out.unionByName(found)
    return out


@check(
    "v13_change_series",
    f"""
    WITH e AS (SELECT vec_id, vec_id % 50 AS location, vec_id // 50 AS day, vec FROM {EMB}),
    x AS (SELECT vec_id, vec_id % 50 AS location, vec_id // 50 AS day, pos, v,
          lag(v) OVER (PARTITION BY vec_id % 50, pos ORDER BY vec_id // 50) AS p FROM {ENT}),
    b AS (SELECT location, pos, avg(v) AS b FROM x WHERE day < 5 GROUP BY location, pos),
    d AS (SELECT x.vec_id, x.location, sqrt(sum((v - p) * (v - p))) AS dp, sqrt(sum((v - b) * (v - b))) AS db
          FROM x JOIN b USING (location, pos) GROUP BY x.vec_id, x.location)
    SELECT vec_id, location, round(dp, 6) AS dist_prev, round(db, 6) AS dist_base, coalesce(dp > 1.4, false) AS shifted FROM d
    """,
)
def _(t):
    day = F.floor(F.col("vec_id") / 50).cast("int")
    series = s.embeddings(t).select(
        "vec_id", "vec", (F.col("vec_id") % 50).alias("location"), F.date_add(F.lit("2024-01-01").cast("date"), day).alias("dt")
    )
    out = tokens.change_series(series, "location", "dt", "vec_id", F.col("dt") < F.lit("2024-01-06").cast("date"), 1.4)
    return out.select(
        "vec_id", "location", F.round("dist_prev", 6).alias("dist_prev"), F.round("dist_base", 6).alias("dist_base"), "shifted"
    )
