"""Quality filters, aggregates and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import standins as s
from checks.registry import check
from rasterloom.functions import vectors as v
from rasterloom.operators import aggregates as a
from rasterloom.operators import metrics as m
from rasterloom.operators import quality as q

ENT, FEAT = s.ENTRIES, s.FEATURES


def _raw(t):
    return t("lineitem").select(
        F.col("l_orderkey").alias("tile"),
        F.when(F.col("l_linenumber") % 2 == 0, "S1").otherwise("S2").alias("platform"),
        (F.col("l_partkey") % 12).cast("int").alias("band_idx"),
        F.when(F.col("l_discount") == 0, 0.0)
        .when(F.col("l_discount") == 0.05, -9999.0)
        .otherwise(F.col("l_quantity"))
        .alias("value"),
    )


@check(
    "p6_mask_nodata",
    """
    WITH r AS (SELECT l_orderkey AS tile, CASE WHEN l_linenumber % 2 = 0 THEN 'S1' ELSE 'S2' END AS platform, CAST(l_partkey % 12 AS INTEGER) AS band_idx,
      CASE WHEN l_discount = 0 THEN 0.0 WHEN l_discount = 0.05 THEN -9999.0 ELSE l_quantity END AS value FROM lineitem),
    k AS (SELECT tile, platform, band_idx, CASE WHEN value = 0 OR (platform = 'S1' AND value = -9999) THEN NULL ELSE value END AS value FROM r
      WHERE (platform = 'S1' AND band_idx < 2) OR (platform = 'S2' AND band_idx < 10))
    SELECT tile, platform, band_idx, value IS NULL AS nodata, coalesce(value, 0)::DOUBLE AS value FROM k
    """,
)
def _(t):
    out = q.mask_nodata(_raw(t))
    return out.select(
        "tile", "platform", "band_idx", F.col("value").isNull().alias("nodata"), F.coalesce("value", F.lit(0.0)).alias("value")
    )


@check(
    "p8_remap_labels",
    """
    SELECT l_orderkey, l_linenumber, coalesce(CASE CAST(l_quantity AS INTEGER) WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3
      WHEN 5 THEN 4 WHEN 6 THEN 5 WHEN 15 THEN 6 END, -1) AS label FROM lineitem
    """,
)
def _(t):
    out = q.remap_labels(t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("label")))
    return out.withColumn("label", F.coalesce("label", F.lit(-1)))


@check(
    "p11_filter_cloud",
    f"""
    SELECT 'clear' AS kind, item_id, cloud_cover FROM {s.SCENES} WHERE cloud_cover < 10
    UNION ALL SELECT 'half', item_id, cloud_cover FROM {s.SCENES} WHERE cloud_cover > 50
    UNION ALL SELECT 'cloudy', item_id, cloud_cover FROM {s.SCENES} WHERE cloud_cover > 80
    """,
)
def _(t):
    parts = [("clear", "<", 10), ("half", ">", 50), ("cloudy", ">", 80)]
    tables = [
        q.filter_cloud(s.scenes(t), op, pct).select(F.lit(kind).alias("kind"), "item_id", "cloud_cover")
        for kind, op, pct in parts
    ]
    return a.concat_tables(tables)


@check(
    "p12_filter_attr",
    f"SELECT * FROM {s.POINTS} WHERE class = 1 AND lon BETWEEN 5 AND 20 AND lat BETWEEN 4 AND 15",
)
def _(t):
    return q.filter_attr(s.points(t), {"class": 1}, (5, 4, 20, 15))


_PRED = "(SELECT l.doc_id, l.quality AS label, CAST(d.n_chars > 2000 AS INTEGER) AS pred, d.lang FROM labels l JOIN documents d USING (doc_id))"


def _pred(t):
    return t("labels").join(t("documents").select("doc_id", "lang", "n_chars"), "doc_id").select(
        "doc_id", F.col("quality").alias("label"), (F.col("n_chars") > 2000).cast("int").alias("pred"), "lang"
    )


@check("p13_detected", f"SELECT doc_id, lang FROM {_PRED} WHERE pred = 1")
def _(t):
    return q.detected(_pred(t), ["doc_id", "lang"], "pred")


_WHOLE = f"(SELECT tile, month FROM {FEAT} GROUP BY tile, month HAVING count(DISTINCT band_idx) = 7)"


@check(
    "a1_temporal_composite",
    f"""
    SELECT tile, band_idx, px, round(coalesce(avg(value), -1), 6) AS value FROM {FEAT} JOIN {_WHOLE} USING (tile, month) GROUP BY ALL
    """,
)
def _(t):
    out = q.temporal_composite(q.complete_months(s.features(t), 7))
    return out.withColumn("value", F.round(F.coalesce("value", F.lit(-1.0)), 6))


@check(
    "a2_complete_months",
    f"SELECT tile, CAST(month AS INTEGER) AS month, band_idx, px FROM {FEAT} JOIN {_WHOLE} USING (tile, month)",
)
def _(t):
    return q.complete_months(s.features(t), 7).select("tile", "month", "band_idx", "px")


_TILE_FEATURES = "(SELECT l_orderkey AS tile, l_linenumber AS band_idx, l_partkey AS px, CASE WHEN l_discount <> 0 THEN l_quantity END AS value FROM lineitem)"


def _tile_features(t):
    return t("lineitem").select(
        F.col("l_orderkey").alias("tile"),
        F.col("l_linenumber").alias("band_idx"),
        F.col("l_partkey").alias("px"),
        F.when(F.col("l_discount") != 0, F.col("l_quantity")).alias("value"),
    )


@check(
    "a3_drop_nodata_tiles",
    f"""
    WITH c AS (SELECT tile, band_idx, px, avg(value) AS value FROM {_TILE_FEATURES} GROUP BY ALL)
    SELECT tile, band_idx, px, round(coalesce(value, -1), 6) AS value FROM c
    WHERE tile NOT IN (SELECT tile FROM c WHERE value IS NULL GROUP BY tile HAVING count(*) > 2)
    """,
)
def _(t):
    out = q.drop_nodata_tiles(q.temporal_composite(_tile_features(t)), 2)
    return out.withColumn("value", F.round(F.coalesce("value", F.lit(-1.0)), 6))


@check(
    "a4_zero_nodata_tiles",
    "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (WHERE l_discount = 0) = 0",
)
def _(t):
    return q.zero_nodata_tiles(t("lineitem"), F.col("l_discount") == 0, "l_orderkey")


@check(
    "a6_band_stats",
    f"SELECT platform, CAST(band_idx AS INTEGER) AS band_idx, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, count(*) AS n FROM {s.CHIP_PIXELS} GROUP BY ALL",
)
def _(t):
    out = a.band_stats(s.chips(t))
    return out.withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@check(
    "a8_patch_cloud_pct",
    f"""
    SELECT vec_id, CAST(pos // 8 // 4 AS INTEGER) AS patch_row, CAST(pos % 8 // 4 AS INTEGER) AS patch_col,
      CAST(floor(100 * count(*) FILTER (WHERE CAST(floor(abs(v) * 100) AS BIGINT) % 12 IN (7, 8, 9, 10)) / 16) AS INTEGER) AS cloud_pct
    FROM {ENT} GROUP BY ALL
    """,
)
def _(t):
    scl = F.transform("vec", lambda x: F.floor(F.abs(x) * 100) % 12)
    chips = s.embeddings(t).withColumn("h", F.lit(8)).withColumn("w", F.lit(8))
    return q.patch_cloud_pct(chips, scl, ["vec_id"], 4)


@check(
    "a9_platform_counts",
    f"SELECT coalesce(platform, 'ALL') AS platform, count(*) AS n_chips FROM {s.STREAM_CHIPS} GROUP BY ROLLUP (platform)",
)
def _(t):
    return a.platform_counts(s.stream_chips(t)).withColumn("platform", F.coalesce("platform", F.lit("ALL")))


@check(
    "a10_extent",
    f"SELECT class, min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax, max(lat) AS ymax FROM {s.POINTS} GROUP BY class",
)
def _(t):
    return a.extent(s.points(t), ["class"])


@check(
    "a12_unique_ids",
    "SELECT DISTINCT split_part(split_part(url, '/', 3), '.', 1) AS id FROM pages",
)
def _(t):
    host = F.element_at(F.split("url", "/"), 3)
    return a.unique_ids(t("pages").select(F.element_at(F.split(host, r"\."), 1).alias("id")))


_CLASSES = f"""
    c AS (SELECT lang, unnest([0, 1]) AS cls FROM (SELECT DISTINCT lang FROM {_PRED})),
    k AS (SELECT c.lang, c.cls, count(*) FILTER (WHERE label = cls) AS support, count(*) FILTER (WHERE pred = cls) AS predicted,
      count(*) FILTER (WHERE label = cls AND pred = cls) AS tp FROM c JOIN {_PRED} p ON p.lang = c.lang GROUP BY c.lang, c.cls),
    r AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS re,
      2 * tp / (support + predicted) AS f1, tp / (support + predicted - tp) AS ja FROM k WHERE support + predicted > 0)
"""


@check(
    "a13_class_metrics",
    f"""
    WITH {_CLASSES} SELECT lang, cls, CAST(support AS BIGINT) AS support, CAST(predicted AS BIGINT) AS predicted, CAST(tp AS BIGINT) AS tp,
      round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, round(ja, 6) AS jaccard, round(f1, 6) AS dice FROM r
    """,
)
def _(t):
    out = m.class_metrics(_pred(t), by=["lang"])
    for c in ("precision", "recall", "f1", "jaccard", "dice"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@check(
    "a13_classification_metrics",
    f"""
    WITH {_CLASSES} SELECT lang, CAST(sum(support) AS BIGINT) AS n, round(sum(tp) / sum(support), 6) AS accuracy, round(avg(pr), 6) AS precision,
      round(avg(re), 6) AS recall, round(sum(support * f1) / sum(support), 6) AS f1_weighted,
      round(sum(support * ja) / sum(support), 6) AS jaccard_weighted, round(avg(f1), 6) AS dice FROM r GROUP BY lang
    """,
)
def _(t):
    out = m.classification_metrics(_pred(t), by=["lang"])
    for c in ("accuracy", "precision", "recall", "f1_weighted", "jaccard_weighted", "dice"):
        out = out.withColumn(c, F.round(c, 6))
    return out


@check(
    "a14_regression_metrics",
    """
    WITH p AS (SELECT o_custkey, o_totalprice % 500 AS t, (o_totalprice * 1.1::DOUBLE) % 500 AS p FROM orders),
    s AS (SELECT o_custkey, avg((p - t) ** 2) FILTER (WHERE t < 400) AS mse FROM p GROUP BY o_custkey)
    SELECT round((SELECT sqrt(avg((p - t) ** 2)) FROM p), 6) AS rmse, round(avg(sqrt(mse)), 6) AS valid_rmse, count(mse) AS valid_samples FROM s
    """,
)
def _(t):
    pairs = t("orders").select(
        "o_custkey", (F.col("o_totalprice") % 500).alias("target"), ((F.col("o_totalprice") * 1.1) % 500).alias("pred")
    )
    out = m.regression_metrics(pairs, "o_custkey")
    return out.withColumn("rmse", F.round("rmse", 6)).withColumn("valid_rmse", F.round("valid_rmse", 6))


def _patch_pairs(t):
    """16 patches of 4 values per vector; the reconstruction is the label mean."""
    means = t_mean(t)
    parts = lambda c: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice(c, i * 4 + 1, 4))
    both = s.embeddings(t).join(means, "label").select(
        "vec_id", "label", F.posexplode(F.arrays_zip(parts("vec").alias("vals"), parts("mate").alias("recon"))).alias("patch_idx", "_p")
    )
    return both.select("vec_id", "label", "patch_idx", "_p.vals", "_p.recon", (F.col("patch_idx") % 3 > 0).cast("int").alias("masked"))


def t_mean(t):
    return s.embeddings(t).groupBy("label").agg(v.mean_vector("vec").alias("mate"))


_PATCHES = f"""
    p AS (SELECT vec_id, label, pos // 4 AS patch, v, avg(v) OVER (PARTITION BY label, pos) AS r,
      avg(v) OVER w AS pm, var_samp(v) OVER w AS pv FROM {ENT} WINDOW w AS (PARTITION BY vec_id, pos // 4)),
    l AS (SELECT label, vec_id, patch, avg(abs(v - r)) AS l1, avg(abs((v - pm) / sqrt(pv + 1e-6) - r)) AS l2, CAST(patch % 3 > 0 AS INTEGER) AS masked FROM p GROUP BY ALL)
"""


@check(
    "a15_masked_l1",
    f"""
    WITH {_PATCHES} SELECT 'raw' AS kind, label, round(sum(l1 * masked) / sum(masked), 6) AS loss FROM l GROUP BY label
    UNION ALL SELECT 'standardised', label, round(sum(l2 * masked) / sum(masked), 6) FROM l GROUP BY label
    """,
)
def _(t):
    raw = m.masked_l1(_patch_pairs(t), ["label"]).withColumn("kind", F.lit("raw"))
    scaled = m.masked_l1(_patch_pairs(t), ["label"], True).withColumn("kind", F.lit("standardised"))
    return raw.unionByName(scaled).withColumn("loss", F.round("loss", 6))


@check(
    "a16_combined_loss",
    """
    WITH e AS (SELECT CASE event_type WHEN 'click' THEN 'modis' ELSE event_type END AS platform, value AS rec, (user_id % 100) / 100.0::DOUBLE AS sim FROM events),
    g AS (SELECT platform, avg(CASE WHEN platform = 'modis' THEN rec / 10 ELSE rec END) AS rec, 1 - avg(sim) AS rep FROM e GROUP BY platform)
    SELECT platform, round(rec, 6) AS rec_loss, round(rep, 6) AS rep_loss, round(0.9::DOUBLE * rec + 0.1::DOUBLE * rep, 6) AS loss FROM g
    """,
)
def _(t):
    rows = t("events").select(
        F.when(F.col("event_type") == "click", "modis").otherwise(F.col("event_type")).alias("platform"),
        F.col("value").alias("rec_loss"),
        ((F.col("user_id") % 100) / 100.0).alias("similarity"),
    )
    out = m.combined_loss(rows, ["platform"])
    return out.select("platform", *[F.round(c, 6).alias(c) for c in ("rec_loss", "rep_loss", "loss")])


@check(
    "a17_matryoshka_loss",
    f"""
    WITH p AS (SELECT vec_id, pos, v, avg(v) OVER (PARTITION BY label, pos) AS b FROM {ENT}),
    r AS (SELECT k.prefix, k.w, vec_id, v, CASE WHEN pos < k.prefix THEN v ELSE b END AS rep FROM p, (VALUES (16, 1.0::DOUBLE), (32, 0.5::DOUBLE), (48, 0.25::DOUBLE)) k(prefix, w)),
    c AS (SELECT prefix, w, vec_id, 1 - sum(v * rep) / (greatest(sqrt(sum(v * v)), 1e-6) * greatest(sqrt(sum(rep * rep)), 1e-6)) AS d FROM r GROUP BY ALL),
    f AS (SELECT prefix, w, avg(d) AS d FROM c GROUP BY ALL)
    SELECT round(sum(w * d) / count(*), 6) AS loss FROM f
    """,
)
def _(t):
    both = s.embeddings(t).join(t_mean(t), "label")
    reps = [
        both.select(F.lit(p).alias("prefix"), v.splice(F.col("vec"), F.col("mate"), p).alias("rep"), F.col("vec").alias("target"))
        for p in (16, 32, 48)
    ]
    out = m.matryoshka_loss(a.concat_tables(reps), {16: 1.0, 32: 0.5, 48: 0.25})
    return out.withColumn("loss", F.round("loss", 6))


@check(
    "a18_metric_rollup",
    f"""
    SELECT CASE WHEN grouping(platform) = 1 THEN phase || '/' || name ELSE phase || '_' || platform || '/' || name END AS series,
      CASE WHEN grouping(step) = 1 THEN 'epoch' ELSE 'step' END AS grain, coalesce(step, CAST(epoch AS BIGINT)) AS at, round(avg(value), 6) AS value, count(value) AS n
    FROM {s.METRIC_LOG}
    GROUP BY GROUPING SETS ((phase, name, epoch), (phase, platform, name, epoch), (phase, name, step), (phase, platform, name, step))
    """,
)
def _(t):
    return m.metric_rollup(s.metric_log(t)).withColumn("value", F.round("value", 6))


@check(
    "a19_collate",
    f"""
    SELECT label, vec_id // 20 AS batch, CAST(row_number() OVER (PARTITION BY label, vec_id // 20 ORDER BY vec_id, pos) - 1 AS INTEGER) AS pos, round(v, 6) AS v FROM {ENT}
    """,
)
def _(t):
    rows = s.embeddings(t).withColumn("batch", F.floor(F.col("vec_id") / 20))
    return s.vector_rows(a.collate(rows, ["label", "batch"], "vec_id", ["vec"]), ["label", "batch"])


@check(
    "a20_equalise_histogram",
    """
    WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
    r AS (SELECT vec_id, vec, list_min(vec) AS lo, (list_max(vec) - list_min(vec)) / 256 AS step FROM e),
    b AS (SELECT *, list_transform(vec, lambda v: least(CAST(floor((v - lo) / step) AS BIGINT), 255)) AS bins FROM r),
    x AS (SELECT vec_id, bins, len(vec) AS n, unnest(list_transform(vec, lambda v: (v - lo) / step - 0.5)) AS xp, generate_subscripts(vec, 1) - 1 AS pos FROM b),
    y AS (SELECT *, greatest(0, least(255, CAST(floor(xp) AS BIGINT))) AS k, greatest(0, least(255, CAST(floor(xp) AS BIGINT) + 1)) AS k1 FROM x),
    c AS (SELECT *, len(list_filter(bins, lambda q: q <= k)) / n AS low, len(list_filter(bins, lambda q: q <= k1)) / n AS high FROM y)
    SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(low + (high - low) * (xp - floor(xp)), 6) AS v FROM c
    """,
)
def _(t):
    return s.vector_rows(a.equalise_histogram(s.embeddings(t), "vec"), ["vec_id"])


@check(
    "u1_concat_tables",
    """
    SELECT o_orderkey AS id, 'order' AS kind, coalesce(o_totalprice, 0) AS price FROM orders
    UNION ALL SELECT p_partkey, 'part', coalesce(p_retailprice, 0) FROM part
    UNION ALL SELECT page_id, 'page', 0 FROM pages
    """,
)
def _(t):
    tables = [
        t("orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"), F.col("o_totalprice").alias("price")),
        t("part").select(F.col("p_partkey").alias("id"), F.lit("part").alias("kind"), F.col("p_retailprice").alias("price")),
        t("pages").select(F.col("page_id").alias("id"), F.lit("page").alias("kind")),
    ]
    return a.concat_tables(tables).withColumn("price", F.coalesce("price", F.lit(0.0)))


@check(
    "j8_skip_existing",
    "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def _(t):
    done = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return q.skip_existing(t("orders").select("o_orderkey"), done, ["o_orderkey"])
