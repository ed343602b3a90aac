"""Spatial and temporal joins, names, projections and encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import standins as s
from checks.registry import check
from rasterloom.functions import encodings as enc
from rasterloom.functions import geo, names
from rasterloom.functions import polygons as pg
from rasterloom.operators import aggregates as a
from rasterloom.operators import pairing, search, spatial
from rasterloom.operators.sampling import first_k_years

FOOT, PTS = s.FOOTPRINTS, s.POINTS
_HITS = f"(SELECT f.vec_id, p.* FROM {FOOT} f JOIN {PTS} p ON p.lon BETWEEN f.xmin AND f.xmax AND p.lat BETWEEN f.ymin AND f.ymax)"


@check("j1_spatial_join", f"SELECT vec_id, point_id, class FROM {_HITS}")
def _(t):
    return spatial.spatial_join(s.footprints(t), s.points(t)).select("vec_id", "point_id", "class")


@check(
    "a11_label_tally",
    f"SELECT vec_id, count(*) AS found, count(*) FILTER (WHERE class = 1) AS positive, count(*) FILTER (WHERE class = 0) AS negative FROM {_HITS} GROUP BY vec_id",
)
def _(t):
    return a.label_tally(spatial.spatial_join(s.footprints(t), s.points(t)), ["vec_id"])


_REGIONS = "(SELECT n_nationkey, (n_nationkey % 5) * 5.0::DOUBLE AS x0, (n_nationkey // 5) * 4.0::DOUBLE AS y0 FROM nation)"


def _regions(t, bbox: str):
    x = (F.col("n_nationkey") % 5) * 5.0
    y = F.floor(F.col("n_nationkey") / 5) * 4.0
    return t("nation").select("n_nationkey", geo.box(x, y, x + 6, y + 5).alias(bbox))


@check(
    "j2_aoi_overlay",
    f"""
    SELECT vec_id, n_nationkey, greatest(xmin, x0) AS xmin, greatest(ymin, y0) AS ymin, least(xmax, x0 + 6) AS xmax, least(ymax, y0 + 5) AS ymax
    FROM {FOOT} JOIN {_REGIONS} ON xmin < x0 + 6 AND x0 < xmax AND ymin < y0 + 5 AND y0 < ymax
    """,
)
def _(t):
    out = spatial.aoi_overlay(s.footprints(t), _regions(t, "aoi_bbox"))
    return out.select("vec_id", "n_nationkey", "clip.xmin", "clip.ymin", "clip.xmax", "clip.ymax")


# L-shaped outlines with a square hole, as corners relative to a lower-left corner and a scale
_L = ([(0.0, 0.0), (1.0, 0.0), (1.0, 0.5), (0.5, 0.5), (0.5, 1.0), (0.0, 1.0)], [(0.125, 0.125), (0.375, 0.125), (0.375, 0.375), (0.125, 0.375)])


def _l_rings(x, y, side: float):
    rings = [[pg.point(x + a * side, y + b * side) for a, b in [*r, r[0]]] for r in _L]
    return F.array(*[F.array(*r) for r in rings])


def _l_edges(table: str, key: str, x: str, y: str, side: float) -> str:
    edges = ", ".join(f"({a}, {b}, {c}, {d})" for r in _L for (a, b), (c, d) in zip(r, [*r[1:], r[0]], strict=True))
    at = lambda o, v: f"{o} + {v} * {side}::DOUBLE"
    return f"""(SELECT {key}, {at(x, "px")} AS px, {at(y, "py")} AS py, {at(x, "qx")} AS qx, {at(y, "qy")} AS qy
      FROM {table}, (SELECT a::DOUBLE AS px, b::DOUBLE AS py, c::DOUBLE AS qx, d::DOUBLE AS qy FROM (VALUES {edges}) v(a, b, c, d)))"""


_L_FOOT = _l_edges(FOOT, "vec_id", "xmin", "ymin", 1.2)
_L_REGION = _l_edges(_REGIONS, "n_nationkey", "x0", "y0", 6.0)


def _l_feet(t):
    box = F.col("bbox")
    return s.footprints(t).select("vec_id", _l_rings(box["xmin"], box["ymin"], 1.2).alias("rings"))


def _l_regions(t, name: str):
    box = F.col("b")
    return _regions(t, "b").select("n_nationkey", _l_rings(box["xmin"], box["ymin"], 6.0).alias(name))


def _in_l(edges: str, key: str, points: str, point: str, x: str, y: str) -> str:
    """Ray crossing with edges included."""
    side = f"(qx - px) * ({y} - py) - (qy - py) * ({x} - px)"
    on = f"{side} = 0 AND {x} BETWEEN least(px, qx) AND greatest(px, qx) AND {y} BETWEEN least(py, qy) AND greatest(py, qy)"
    return f"""(SELECT {key}, {point} FROM {edges} e JOIN {points} p ON true GROUP BY {key}, {point}
      HAVING count(*) FILTER (WHERE (py > {y}) <> (qy > {y}) AND {x} < (qx - px) * ({y} - py) / (qy - py) + px) % 2 = 1 OR bool_or({on}))"""


@check("j1_polygon_join", f"SELECT vec_id, point_id FROM {_in_l(_L_FOOT, 'vec_id', s.POINTS, 'point_id', 'lon', 'lat')}")
def _(t):
    return spatial.polygon_join(_l_feet(t), s.points(t)).select("vec_id", "point_id")


_HIT = f"""
    SELECT DISTINCT vec_id, n_nationkey FROM (
      SELECT f.vec_id, r.n_nationkey FROM {_L_FOOT} f JOIN {_L_REGION} r ON
        greatest(least(f.px, f.qx), least(r.px, r.qx)) <= least(greatest(f.px, f.qx), greatest(r.px, r.qx))
        AND greatest(least(f.py, f.qy), least(r.py, r.qy)) <= least(greatest(f.py, f.qy), greatest(r.py, r.qy))
      UNION ALL
      SELECT vec_id, n_nationkey FROM {_in_l(_L_REGION, 'n_nationkey', FOOT, 'vec_id', 'xmin', 'ymin')}
      UNION ALL
      SELECT vec_id, n_nationkey FROM {_in_l(_L_FOOT, 'vec_id', _REGIONS, 'n_nationkey', 'x0', 'y0')})
"""


@check(
    "j2_polygon_overlay",
    f"""
    SELECT h.vec_id, h.n_nationkey FROM ({_HIT}) h JOIN {FOOT} f USING (vec_id) JOIN {_REGIONS} r USING (n_nationkey)
    WHERE xmin < x0 + 6 AND x0 < xmax AND ymin < y0 + 6 AND y0 < ymax
    """,
)
def _(t):
    return spatial.polygon_overlay(_l_feet(t), _l_regions(t, "aoi_rings")).select("vec_id", "n_nationkey")


def _shared(a: float, b: float, c: float, d: float) -> str:
    """Area that a footprint shares with the part of an L between two relative corners."""
    return (
        f"greatest(0, least(xmax, x0 + {c * 6}::DOUBLE) - greatest(xmin, x0 + {a * 6}::DOUBLE)) * greatest(0, least(ymax, y0 + {d * 6}::DOUBLE) - greatest(ymin, y0 + {b * 6}::DOUBLE))"
    )


@check(
    "j2_clip_polygons",
    f"""
    SELECT * FROM (SELECT vec_id, n_nationkey, round({_shared(0, 0, 1, 1)} - {_shared(0.5, 0.5, 1, 1)} - {_shared(0.125, 0.125, 0.375, 0.375)}, 6) AS area
      FROM {FOOT}, {_REGIONS}) WHERE area > 0
    """,
)
def _(t):
    parts = spatial.clip_to_boxes(_l_regions(t, "rings"), s.footprints(t))
    return parts.select("vec_id", "n_nationkey", F.round("area", 6).alias("area")).where("area > 0")


@check(
    "p12_filter_by_polygon",
    f"SELECT DISTINCT point_id FROM {_in_l('(SELECT * FROM ' + _L_REGION + ' WHERE n_nationkey = 7)', 'n_nationkey', s.POINTS, 'point_id', 'lon', 'lat')}",
)
def _(t):
    """Points inside one area that comes as WKB, as a plain row filter."""
    area = _l_regions(t, "rings").where("n_nationkey = 7").select(pg.rings_wkb(F.col("rings")).alias("wkb")).first()["wkb"]
    once = t.spark.range(1).select(pg.wkb_rings(F.lit(area)))  # a subquery: not read again for each point
    points = s.points(t).withColumn("rings", once.scalar())
    return points.where(pg.contains_point(F.col("rings"), F.col("lon"), F.col("lat"))).select("point_id")


@check(
    "j3_reference_hits",
    f"SELECT point_id, class, vec_id FROM {_HITS}",
)
def _(t):
    return spatial.reference_hits(s.points(t), s.footprints(t)).select("point_id", "class", "vec_id")


@check("j3_points_with_hits", f"SELECT DISTINCT point_id, lon, lat, class FROM {_HITS}")
def _(t):
    return spatial.points_with_hits(s.points(t), s.footprints(t))


@check(
    "j5_attach_dem",
    f"""
    SELECT n_nationkey, coalesce(vec_id, -1) AS vec_id FROM {_REGIONS} LEFT JOIN {FOOT}
      ON xmin < x0 + 6 AND x0 < xmax AND ymin < y0 + 5 AND y0 < ymax
    """,
)
def _(t):
    dem = s.footprints(t).withColumnRenamed("bbox", "dem_bbox")
    out = spatial.attach_dem(_regions(t, "bbox"), dem, "n_nationkey")
    return out.select("n_nationkey", F.coalesce("vec_id", F.lit(-1).cast("bigint")).alias("vec_id"))


_MATCHES = f"""
    SELECT o.item_id, o.tile, o.dt, s.sar_id, date_diff('day', o.dt, s.dt) AS day_gap, s.coverage,
      coalesce(sum(s.coverage) OVER (PARTITION BY o.item_id ORDER BY abs(date_diff('day', o.dt, s.dt)), s.sar_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
      row_number() OVER (PARTITION BY o.item_id ORDER BY abs(date_diff('day', o.dt, s.dt)), s.sar_id) AS match_rank
    FROM {s.SCENES} o JOIN {s.RADAR_SCENES} s ON s.tile = o.tile AND abs(date_diff('day', o.dt, s.dt)) <= 3
"""


@check(
    "j4_match_sar",
    f"SELECT item_id, sar_id, CAST(day_gap AS INTEGER) AS day_gap, coverage, CAST(match_rank AS INTEGER) AS match_rank FROM ({_MATCHES}) WHERE before < 100",
)
def _(t):
    out = pairing.match_sar(s.scenes(t), s.radar_scenes(t), full=100)
    return out.select("item_id", "sar_id", "day_gap", "coverage", "match_rank")


@check(
    "w3_first_k_years",
    f"""
    WITH y AS (SELECT tile, CAST(year(dt) AS INTEGER) AS year, count(*) AS n_matches FROM ({_MATCHES}) WHERE before < 100 GROUP BY ALL)
    SELECT tile, year, n_matches, CAST(r AS INTEGER) AS year_rank FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY md5('31:' || tile || ':' || year), year) AS r FROM y) WHERE r <= 3
    """,
)
def _(t):
    matches = pairing.match_sar(s.scenes(t), s.radar_scenes(t), full=100)
    return first_k_years(matches.withColumn("year", F.year("dt")), "tile", "year", 3, 31)


@check(
    "j6_pair_labels",
    """
    SELECT p_partkey, 'm_' || p_size || '_lc_chip_' || p_partkey || '.npy' AS label_name, p_partkey * 2 AS label FROM part
    WHERE p_brand <> 'Brand#1'
    UNION ALL SELECT p_partkey, p_partkey || '_agbm.tif', p_partkey * 3 FROM part WHERE p_brand <> 'Brand#2'
    """,
)
def _(t):
    key = F.col("p_partkey").cast("string")
    size = F.col("p_size").cast("string")
    chips = t("part").select("p_partkey", F.concat(F.lit("m_"), size, F.lit("_naip-new_chip_"), key, F.lit(".npy")).alias("chip"))
    labels = t("part").filter("p_brand <> 'Brand#1'").select(
        F.concat(F.lit("m_"), size, F.lit("_lc_chip_"), key, F.lit(".npy")).alias("label_name"), (F.col("p_partkey") * 2).alias("label")
    )
    segment = pairing.pair_labels(chips, labels, names.label_key_segment(F.col("chip")))
    cubes = t("part").select("p_partkey", F.concat(F.lit("biomass_cube_"), key, F.lit(".npz")).alias("chip"))
    rasters = t("part").filter("p_brand <> 'Brand#2'").select(
        F.concat(key, F.lit("_agbm.tif")).alias("label_name"), (F.col("p_partkey") * 3).alias("label")
    )
    biomass = pairing.pair_labels(cubes, rasters, names.label_key_biomass(F.col("chip")))
    return segment.unionByName(biomass).select("p_partkey", "label_name", "label")


_RC = "CAST(l_linenumber AS INTEGER) AS patch_row, CAST(l_partkey % 8 AS INTEGER) AS patch_col"


@check(
    "j7_attach_patch_meta",
    f"""
    WITH k AS (SELECT l_orderkey AS chip_id, {_RC}, sum(l_quantity) AS q, min(l_tax) AS x, max(l_discount) AS c FROM lineitem GROUP BY ALL)
    SELECT chip_id, patch_row, patch_col, q, x, c FROM k WHERE c < 0.09
    """,
)
def _(t):
    rows = t("lineitem").select(
        F.col("l_orderkey").alias("chip_id"),
        F.col("l_linenumber").alias("patch_row"),
        (F.col("l_partkey") % 8).cast("int").alias("patch_col"),
        "l_quantity",
        "l_tax",
        "l_discount",
    )
    key = ["chip_id", "patch_row", "patch_col"]
    vectors = rows.groupBy(*key).agg(F.sum("l_quantity").alias("q"))
    boxes = rows.groupBy(*key).agg(F.min("l_tax").alias("x"))
    clouds = rows.groupBy(*key).agg(F.max("l_discount").alias("c")).filter("c < 0.09")
    return pairing.attach_patch_meta(vectors, boxes, clouds, ["chip_id"])


@check(
    "v5_knn_from_points",
    f"""
    WITH d AS (SELECT q.vec_id, c.vec_id AS neighbour_id, list_distance(q.vec, c.vec) AS distance FROM {s.EMBEDDINGS} q, {s.EMBEDDINGS} c WHERE q.vec_id IN (SELECT vec_id FROM {_HITS})),
    k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour_id) AS rank FROM d)
    SELECT point_id, vec_id, neighbour_id, round(distance, 6) AS distance, CAST(rank AS INTEGER) AS rank FROM {_HITS} JOIN k USING (vec_id) WHERE rank <= 5
    """,
)
def _(t):
    hits = spatial.reference_hits(s.points(t), s.footprints(t)).select("point_id", "vec_id")
    out = search.knn_from_points(hits, s.embeddings(t), 5)
    return out.withColumn("distance", F.round("distance", 6))


# -- encodings ---------------------------------------------------------------


@check(
    "f1_encode_time",
    """
    SELECT event_id, round(sin(w), 6) AS week_sin, round(cos(w), 6) AS week_cos, round(sin(h), 6) AS hour_sin, round(cos(h), 6) AS hour_cos
    FROM (SELECT event_id, weekofyear(ts) * 2 * pi() / 52 AS w, hour(ts) * 2 * pi() / 24 AS h FROM events)
    """,
)
def _(t):
    e = t("events").select("event_id", enc.encode_time("ts").alias("e"))
    parts = ["week_sin", "week_cos", "hour_sin", "hour_cos"]
    return e.select("event_id", *[F.round(F.col("e")[i], 6).alias(n) for i, n in enumerate(parts)])


@check(
    "f2_encode_latlon",
    f"SELECT point_id, round(sin(radians(lat)), 6) AS a, round(cos(radians(lat)), 6) AS b, round(sin(radians(lon)), 6) AS c, round(cos(radians(lon)), 6) AS d FROM {PTS}",
)
def _(t):
    e = s.points(t).select("point_id", enc.encode_latlon("lat", "lon").alias("e"))
    return e.select("point_id", *[F.round(F.col("e")[i], 6).alias(n) for i, n in enumerate("abcd")])


@check(
    "f3_posenc_1d",
    """
    WITH k AS (SELECT p_partkey, p_size, k, pow(10000::DOUBLE, -(k / 7.0::DOUBLE)) AS o FROM part, range(8) r(k))
    SELECT p_partkey, CAST(k AS INTEGER) AS pos, round(sin(p_size * o), 6) AS v FROM k
    UNION ALL SELECT p_partkey, CAST(k + 8 AS INTEGER), round(cos(p_size * o), 6) FROM k
    """,
)
def _(t):
    e = t("part").select("p_partkey", enc.posenc_1d(F.col("p_size").cast("double"), 16).alias("vec"))
    return s.vector_rows(e, ["p_partkey"])


_XY = "(SELECT vec_id, vec_id % 25 AS x, vec_id // 25 AS y, 1 + label % 3 AS gsd FROM embeddings)"


def _xy(t):
    return t("embeddings").select(
        "vec_id",
        (F.col("vec_id") % 25).alias("x"),
        F.floor(F.col("vec_id") / 25).alias("y"),
        (1 + F.col("label") % 3).cast("double").alias("gsd"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


def _enc2d(omega: str, n: int, dim_cols: str = "vec_id") -> str:
    return f"""
    k AS (SELECT e.*, k, {omega} AS o FROM {_XY} e, range({n}) r(k)),
    enc AS (SELECT vec_id, k AS pos, sin(x * o) AS v FROM k UNION ALL SELECT vec_id, k + {n}, cos(x * o) FROM k
    UNION ALL SELECT vec_id, k + {2 * n}, sin(y * o) FROM k UNION ALL SELECT vec_id, k + {3 * n}, cos(y * o) FROM k)
    """


_OMEGA = "pow(10000::DOUBLE, -(k / 5.0::DOUBLE))"


@check(
    "f4_posenc_2d",
    f"WITH {_enc2d(_OMEGA, 6)} SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(v, 6) AS v FROM enc",
)
def _(t):
    return s.vector_rows(_xy(t).withColumn("vec", enc.posenc_2d("x", "y", 24)), ["vec_id"])


def _gsd_omega(n: int, dim: int) -> str:
    return f"pow(10000::DOUBLE, -(2 * (k / {n - 1}.0::DOUBLE) / {dim})) * gsd"


@check(
    "f5_posenc_2d_gsd",
    f"WITH {_enc2d(_gsd_omega(6, 24), 6)} SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(v, 6) AS v FROM enc",
)
def _(t):
    return s.vector_rows(_xy(t).withColumn("vec", enc.posenc_2d("x", "y", 24, gsd=F.col("gsd"))), ["vec_id"])


@check(
    "f8_add_encodings",
    f"""
    WITH {_enc2d(_gsd_omega(14, 56), 14)},
    x AS (SELECT vec_id, pos, v FROM enc UNION ALL SELECT vec_id, 56 + i, CASE WHEN i < 4 THEN 0.25::DOUBLE ELSE 0.5 END FROM embeddings, range(8) r(i))
    SELECT e.vec_id, CAST(e.pos AS INTEGER) AS pos, round(e.v + x.v, 6) AS v FROM {s.ENTRIES} e JOIN x USING (vec_id, pos)
    """,
)
def _(t):
    quad = lambda v: F.array(*[F.lit(v)] * 4)
    out = _xy(t).withColumn(
        "vec", enc.add_encodings(F.col("vec"), F.col("x"), F.col("y"), quad(0.25), quad(0.5), 64, F.col("gsd"))
    )
    return s.vector_rows(out, ["vec_id"])


@check(
    "f9_affine_xy",
    f"SELECT vec_id, round(10 * x + 0.5 * y + 500000, 6)::DOUBLE AS mx, round(0.25 * x - 10 * y + 4000000, 6)::DOUBLE AS my FROM {_XY}",
)
def _(t):
    mx, my = geo.affine_xy((10, 0.5, 500000, 0.25, -10, 4000000), F.col("x"), F.col("y"))
    return _xy(t).select("vec_id", F.round(mx, 6).alias("mx"), F.round(my, 6).alias("my"))


@check(
    "f10_bounds_around",
    f"SELECT point_id, lon - 76 AS xmin, lat - 76 AS ymin, lon + 76 AS xmax, lat + 76 AS ymax, lon - 2560 AS fixed_xmin FROM {PTS}",
)
def _(t):
    p = s.points(t).withColumn("b", geo.bounds_around(F.col("lon"), F.col("lat"), 255, 0.6))
    fixed = geo.bounds_around(F.col("lon"), F.col("lat"), 512, 10)["xmin"]
    return p.select("point_id", "b.xmin", "b.ymin", "b.xmax", "b.ymax", fixed.alias("fixed_xmin"))


@check(
    "f11_box_centroid",
    f"SELECT item_id, round((xmin + xmax) / 2, 6) AS lon, round((ymin + ymax) / 2, 6) AS lat FROM {s.SCENES}",
)
def _(t):
    lon, lat = geo.box_centroid("bbox")
    swapped = geo.box_from_corners(F.col("bbox.xmax"), F.col("bbox.ymin"), F.col("bbox.xmin"), F.col("bbox.ymax"))
    return s.scenes(t).withColumn("bbox", swapped).select("item_id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


_NN = 1 / 298.257223563 / (2 - 1 / 298.257223563)
_UTM = f"""
    c AS (SELECT {_NN!r}::DOUBLE AS n),
    k AS (SELECT n, 2 * sqrt(n) / (1 + n) AS e, 0.9996::DOUBLE * 6378137 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS r,
      n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 AS a1, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 AS a2, 61 * n ** 3 / 240 AS a3 FROM c),
    p AS (SELECT point_id, lon, lat, sin(radians(lat)) AS s, radians(lon) - radians(15) AS dl, k.* FROM {PTS}, k),
    t AS (SELECT *, sinh(atanh(s) - e * atanh(e * s)) AS t FROM p),
    u AS (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM t)
"""


@check(
    "f12_reproject",
    f"""
    WITH {_UTM}
    SELECT point_id,
      round(500000 + r * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)), 3) AS utm_x,
      round(r * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)), 3) AS utm_y,
      round(lon, 6) AS back_lon, round(lat, 6) AS back_lat,
      round(6378137 * radians(lon), 3) AS web_x, round(6378137 * ln(tan(pi() / 4 + radians(lat) / 2)) + 0.0, 3) AS web_y
    FROM u
    """,
)
def _(t):
    p = s.points(t)
    x, y = geo.reproject(F.col("lon"), F.col("lat"), 4326, 32633)
    wx, wy = geo.reproject(F.col("lon"), F.col("lat"), 4326, 3857)
    p = p.select("point_id", x.alias("x"), y.alias("y"), wx.alias("wx"), wy.alias("wy"))
    # there and back again: UTM to web mercator to degrees
    mx, my = geo.reproject(F.col("x"), F.col("y"), 32633, 3857)
    lon, lat = geo.reproject(mx, my, 3857, 4326)
    clean = lambda c, d: (F.round(c, d) + F.lit(0.0))
    return p.select(
        "point_id",
        clean(F.col("x"), 3).alias("utm_x"),
        clean(F.col("y"), 3).alias("utm_y"),
        clean(lon, 6).alias("back_lon"),
        clean(lat, 6).alias("back_lat"),
        clean(F.col("wx"), 3).alias("web_x"),
        clean(F.col("wy"), 3).alias("web_y"),
    )


@check(
    "f18_parse_names",
    """
    SELECT page_id, regexp_replace(split_part(url, '/', -1), '\\.[^.]*$', '') AS stem, split_part(split_part(url, '/', 3), '.', 1) AS head,
      'cube_' || page_id || '_tail_' || (page_id % 7) AS tail, lpad(CAST(page_id AS VARCHAR), 5, '0') AS grid, CAST(32600 + page_id % 60 AS INTEGER) AS epsg FROM pages
    """,
)
def _(t):
    id_text = F.col("page_id").cast("string")
    name = F.concat(F.lit("a_b_cube_"), id_text, F.lit("_tail_"), (F.col("page_id") % 7).cast("string"))
    host = F.element_at(F.split("url", "/"), 3)
    return t("pages").select(
        "page_id",
        names.stem(F.col("url")).alias("stem"),
        names.field(host, 0, r"\.").alias("head"),
        names.tail_fields(name, 2).alias("tail"),
        names.grid_code(F.concat(F.lit("MGRS-"), F.lpad(id_text, 5, "0"))).alias("grid"),
        names.epsg_code(F.concat(F.lit("EPSG:"), (32600 + F.col("page_id") % 60).cast("string"))).alias("epsg"),
    )


@check(
    "s5_parse_feature_files",
    """
    SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS id, CASE WHEN p_size % 2 = 0 THEN 'S1' ELSE 'S2' END AS platform,
      lpad(CAST(p_size % 12 AS VARCHAR), 2, '0') AS month FROM part
    """,
)
def _(t):
    path = F.concat(
        F.lit("/data/features/"),
        F.lpad(F.col("p_partkey").cast("string"), 8, "0"),
        F.when(F.col("p_size") % 2 == 0, "_S1_").otherwise("_S2_"),
        F.lpad((F.col("p_size") % 12).cast("string"), 2, "0"),
        F.lit(".tif"),
    )
    return t("part").select("p_partkey", names.feature_file(path).alias("f")).select("p_partkey", "f.id", "f.platform", "f.month")


@check(
    "s9_embeddings_filename",
    f"""
    SELECT tile, tile || '_' || strftime(min(dt), '%Y%m%d') || '_' || strftime(max(dt), '%Y%m%d') || '_v001.gpq' AS name
    FROM (SELECT lpad(CAST(tile AS VARCHAR), 5, '0') AS tile, dt FROM {s.SCENES}) GROUP BY tile
    """,
)
def _(t):
    from rasterloom.sources.tables import embeddings_filename

    return embeddings_filename(s.scenes(t).withColumn("tile", F.lpad(F.col("tile").cast("string"), 5, "0")), 1)
