"""Files and tables: written from the driver tables, scanned back, compared with SQL on the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import standins as s
from checks.registry import check
from rasterloom.functions.polygons import polygon_area
from rasterloom.operators.embed import PatchMeanEncoder, embed_chips
from rasterloom.plans.scratch import scratch_path
from rasterloom.sources import chips as c
from rasterloom.sources import features, places, tables

PER_STACK = 40


def _stacks(t):
    """Chips of one platform in stacks, as stack files would hold them."""
    members = F.array_sort(F.collect_list(F.struct("chip_id", "pixels")))
    grouped = s.chips(t).groupBy("platform", F.floor(F.col("chip_id") / PER_STACK).alias("n")).agg(members.alias("m"))
    path = F.concat(F.col("platform"), F.lit("/cube_"), F.col("n").cast("string"), F.lit(".npz"))
    return grouped.select(path.alias("path"), F.lit(s.SIDE).alias("h"), F.lit(s.SIDE).alias("w"), F.col("m.pixels").alias("pixels"))


def _written(df, root: str) -> str:
    """Force the files out; only their number comes back."""
    c.write_files(df, root).agg(F.sum("length")).collect()
    return root


@check(
    "s3_scan_chip_stacks",
    f"""
    WITH k AS (SELECT *, dense_rank() OVER (PARTITION BY platform, chip_id // {PER_STACK} ORDER BY chip_id) - 1 AS i FROM {s.CHIP_PIXELS})
    SELECT platform, 'cube_' || (chip_id // {PER_STACK}) || '.npz' AS file, CAST(i AS INTEGER) AS chip_idx, band_idx, px,
      round(CAST(CAST(v AS FLOAT) AS DOUBLE), 6) AS v FROM k
    """,
)
def _(t):
    root = _written(c.encode_stacks(_stacks(t)), scratch_path(t.spark, "stacks"))
    chips = c.scan_chip_stacks(t.spark, root).withColumn("file", F.element_at(F.split("path", "/"), -1))
    return s.pixel_rows(chips, ["platform", "file", "chip_idx"])


@check(
    "e5_stack_table_function",
    f"""
    WITH k AS (SELECT *, dense_rank() OVER (PARTITION BY platform, chip_id // {PER_STACK} ORDER BY chip_id) - 1 AS i FROM {s.CHIP_PIXELS})
    SELECT 'cube_' || (chip_id // {PER_STACK}) || '.npz' AS file, platform, CAST(i AS INTEGER) AS chip_idx, band_idx, px,
      round(CAST(CAST(v AS FLOAT) AS DOUBLE), 6) AS v FROM k
    """,
)
def _(t):
    t.spark.udtf.register("decode_stack", c.stack_table_function())
    c.encode_stacks(_stacks(t)).createOrReplaceTempView("encoded_stacks")
    chips = t.spark.sql("SELECT path, d.* FROM encoded_stacks, LATERAL decode_stack(content) AS d")
    parts = F.split("path", "/")
    named = chips.withColumn("file", F.element_at(parts, -1)).withColumn("platform", F.element_at(parts, -2))
    return s.pixel_rows(named, ["file", "platform", "chip_idx"])


@check(
    "s4_scan_chip_arrays",
    f"SELECT CAST(chip_id AS VARCHAR) || '.npy' AS file, band_idx, px, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 6) AS v FROM {s.CHIP_PIXELS}",
)
def _(t):
    named = s.chips(t).withColumn("path", F.concat(F.lit("chips/"), F.col("chip_id").cast("string"), F.lit(".npy")))
    root = _written(c.encode_arrays(named), scratch_path(t.spark, "arrays"))
    chips = c.scan_chip_arrays(t.spark, root).withColumn("file", F.element_at(F.split("path", "/"), -1))
    return s.pixel_rows(chips, ["file"])


def _tiled(t):
    return s.embeddings(t).join(s.footprints(t), "vec_id").select(
        F.concat(F.lit("T"), F.lpad(F.col("label").cast("string"), 4, "0")).alias("tile"),
        "vec_id",
        "vec",
        F.date_add(F.lit("2023-12-20").cast("date"), (F.col("vec_id") % 30).cast("int")).alias("dt"),
        "bbox",
    )


@check(
    "s7_scan_embeddings",
    f"""
    SELECT 'T' || lpad(CAST(label AS VARCHAR), 4, '0') AS tile, e.vec_id, CAST(year(DATE '2023-12-20' + CAST(e.vec_id % 30 AS INTEGER)) AS INTEGER) AS year,
      round(list_sum(vec), 6) AS total, f.xmin, f.ymax FROM {s.EMBEDDINGS} e JOIN {s.FOOTPRINTS} f USING (vec_id)
    """,
)
def _(t):
    path = scratch_path(t.spark, "embeddings")
    tables.write_embeddings(_tiled(t), path)
    total = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v)
    back = tables.scan_embeddings(t.spark, path)
    return back.select("tile", "vec_id", "year", F.round(total, 6).alias("total"), "bbox.xmin", "bbox.ymax")


@check(
    "s8_write_embeddings",
    "SELECT 'T' || lpad(CAST(label AS VARCHAR), 4, '0') AS tile, count(*) AS n, CAST(93 AS INTEGER) AS wkb_bytes FROM embeddings GROUP BY label",
)
def _(t):
    path = scratch_path(t.spark, "embeddings")
    tables.write_embeddings(_tiled(t), path)
    back = t.spark.read.parquet(path)
    return back.groupBy("tile").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.octet_length("geometry")).alias("wkb_bytes")
    )


@check("s10_replace_table", f"SELECT vec_id, label FROM {s.EMBEDDINGS}")
def _(t):
    name = f"rasterloom_{uuid.uuid4().hex}"
    tables.drop_table(t.spark, name)  # not there yet: tolerated
    tables.replace_table(s.footprints(t).select("vec_id"), name, scratch_path(t.spark, "table"))
    tables.replace_table(s.embeddings(t).select("vec_id", "label"), name, scratch_path(t.spark, "table"))
    return t.spark.table(name)


@check(
    "s12_write_chips",
    f"SELECT chip_id, platform, 'T' || (chip_id % 7) AS tile, band_idx, px, round(v, 6) AS v FROM {s.CHIP_PIXELS}",
)
def _(t):
    path = scratch_path(t.spark, "chips")
    tile = F.concat(F.lit("T"), (F.col("chip_id") % 7).cast("string"))
    tables.write_chips(s.chips(t).withColumn("tile", tile), path)
    return s.pixel_rows(tables.scan_chips(t.spark, path), ["chip_id", "platform", "tile"])


@check("s6_scan_geojson_points", f"SELECT CAST(point_id AS INTEGER) AS point_id, class, lon, lat FROM {s.POINTS}")
def _(t):
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct("point_id", "class").alias("properties"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"),
    )
    docs = (
        s.points(t)
        .groupBy(F.floor(F.col("point_id") / 500).alias("n"))
        .agg(F.collect_list(feature).alias("features"))
        .select(
            F.concat(F.lit("points_"), F.col("n").cast("string"), F.lit(".geojson")).alias("path"),
            F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).cast("binary").alias("content"),
        )
    )
    root = _written(docs, scratch_path(t.spark, "geojson"))
    return tables.scan_geojson_points(t.spark, root, {"point_id": "int", "class": "int"})


@check(
    "s6_scan_features",
    f"""
    SELECT 'Point' AS kind, CAST(point_id AS INTEGER) AS id, lon, lat, CAST(NULL AS DOUBLE) AS area FROM {s.POINTS}
    UNION ALL SELECT 'Polygon', CAST(vec_id AS INTEGER), NULL, NULL, round((xmax - xmin) * (ymax - ymin), 6) FROM {s.FOOTPRINTS}
    """,
)
def _(t):
    """All points and footprints as one collection in a single file, read in ranges of 16 KB."""
    def corner(x: str, y: str):
        return F.array(F.col(f"bbox.{x}"), F.col(f"bbox.{y}"))

    ring = F.array(corner("xmin", "ymin"), corner("xmax", "ymin"), corner("xmax", "ymax"), corner("xmin", "ymax"), corner("xmin", "ymin"))

    def member(kind: str, key: str, coordinates):
        geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
        piece = F.concat_ws("_", F.lit(kind), F.floor(F.col(key) / 5000).cast("string"))
        text = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.col(key).alias("id")).alias("properties"), geometry.alias("geometry")))
        return piece.alias("path"), text.alias("m")

    members = s.points(t).select(*member("Point", "point_id", F.array("lon", "lat"))).union(s.footprints(t).select(*member("Polygon", "vec_id", F.array(ring))))
    pieces = members.groupBy("path").agg(F.array_join(F.collect_list("m"), ", ").cast("binary").alias("content"))
    parts, root = _written(pieces, scratch_path(t.spark, "feature-pieces")), scratch_path(t.spark, "features")
    c.join_files(t.spark, parts, f"{root}/all.geojson", b'{"type":"FeatureCollection","features":[', b", ", b"]}")
    found = features.scan_features(t.spark, root, {"id": "int"}, range_bytes=16 << 10)
    return found.select("kind", "id", "lon", "lat", F.round(polygon_area(F.col("rings")), 6).alias("area"))


@check("s11_search_places", f"SELECT vec_id, xmin, ymin FROM {s.FOOTPRINTS} WHERE xmin <= 12.5 AND xmax >= 7 AND ymin <= 9 AND ymax >= 4.5")
def _(t):
    """Footprints in curve order; the search opens only files whose box meets the area."""
    path = scratch_path(t.spark, "places")
    places.write_places(s.footprints(t), path, 16, world=(0.0, 0.0, 40.0, 40.0))
    return places.search_places(t.spark, path, (7.0, 4.5, 12.5, 9.0)).select("vec_id", "bbox.xmin", "bbox.ymin")


def landing_files(t):
    """Full and short stacks (events), stacks without pixels (pages), no stacks at all (documents).

    Files of the three kinds share their names and differ by folder.
    """

    def stacks(name: str, rows, key: str, per: int):
        members = F.array_sort(F.collect_list(F.struct(key, F.array(F.array(F.col("v").cast("float"))).alias("p"))))
        grouped = rows.groupBy(F.floor(F.col(key) / per).alias("n")).agg(members.alias("m"))
        return grouped.select(
            F.concat(F.lit(f"landing/{name}/cube_"), F.col("n").cast("string"), F.lit(".npz")).alias("path"),
            F.lit(1).alias("h"),
            F.lit(1).alias("w"),
            F.col("m.p").alias("pixels"),
        )

    good = c.encode_stacks(stacks("events", t("events").withColumn("v", F.col("value")), "event_id", 128))
    other = c.encode_stacks(stacks("pages", t("pages").withColumn("v", F.length("html")), "page_id", 100), "labels")
    junk = t("documents").select(
        F.concat(F.lit("landing/documents/cube_"), F.col("doc_id").cast("string"), F.lit(".npz")).alias("path"),
        F.col("text").cast("binary").alias("content"),
    )
    return good.unionByName(other).unionByName(junk)


def short_path(path: str):
    """Folder and name of a file."""
    return F.array_join(F.slice(F.split(path, "/"), -2, 2), "/")


QA = """
    SELECT 'events/cube_' || (event_id // 128) || '.npz' AS file, CASE WHEN count(*) = 128 THEN 'valid' ELSE 'wrong_first_dim' END AS status FROM events GROUP BY event_id // 128
    UNION ALL SELECT DISTINCT 'pages/cube_' || (page_id // 100) || '.npz', 'missing_pixels' FROM pages
    UNION ALL SELECT 'documents/cube_' || doc_id || '.npz', 'unreadable' FROM documents WHERE length(text) > 0
"""


@check("p10_chip_qa", QA)
def _(t):
    root = _written(landing_files(t), scratch_path(t.spark, "landing"))
    checked = c.chip_qa(c.stack_files(t.spark, root))
    valid, quarantine = c.split_by_qa(checked)
    both = valid.unionByName(quarantine)
    return both.select(short_path("path").alias("file"), "status")


def located_chips(t):
    """Chips with time and location; every ninth has none."""
    lat = F.when(F.col("chip_id") % 9 == 0, F.lit(0.0)).otherwise(F.lit(0.5))
    return s.chips(t).withColumn("latlon", F.array(lat, lat, lat, lat)).withColumn("time", F.array(*[F.lit(0.25)] * 4))


EMBEDDED = f"""
    WITH m AS (SELECT p.chip_id, p.platform, p.band_idx, p.px // 4 // 2 * 2 + p.px % 4 // 2 AS patch, avg(v) AS m FROM {s.CHIP_PIXELS} p GROUP BY ALL),
    e AS (SELECT m.chip_id, m.platform, j, avg(m.m * cos(j * (r.wavelength_um + (patch + 1) * (r.gsd / 10.0::DOUBLE)))) AS v
      FROM m JOIN {s.REGISTRY} r ON r.platform = m.platform AND r.band_idx = m.band_idx, range(1, 17) g(j) GROUP BY ALL)
    SELECT chip_id, platform, CAST(j - 1 AS INTEGER) AS pos, round(v + 0.01::DOUBLE * CASE WHEN (j - 1) % 8 < 4 THEN 0.25::DOUBLE WHEN chip_id % 9 = 0 THEN 0 ELSE 0.5::DOUBLE END, 6) AS v FROM e
"""


@check("v1_embed_chips", EMBEDDED)
def _(t):
    vectors = embed_chips(located_chips(t), s.registry(t), PatchMeanEncoder(16), ["chip_id", "platform"])
    return s.vector_rows(vectors, ["chip_id", "platform"])
