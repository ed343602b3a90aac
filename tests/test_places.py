"""Polygons, feature files, curve order, and both-sided skew against plain computations."""

import io
import itertools
import json
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.functions import polygons as pg
from rasterloom.functions.geo import box
from rasterloom.operators import learn, search, spatial, vector_index
from rasterloom.plans.skew import hot_grid, hot_keys, salted_join
from rasterloom.sources import features, places

L = [[(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (2.0, 2.0), (2.0, 4.0), (0.0, 4.0), (0.0, 0.0)], [(0.5, 0.5), (1.0, 0.5), (1.0, 1.0), (0.5, 1.0), (0.5, 0.5)]]


def star(rng, cx, cy, n=9):
    """A ring that is not convex, around a middle."""
    pts = [(cx + r * math.cos(a), cy + r * math.sin(a)) for a, r in zip(sorted(rng.uniform(0, 2 * math.pi) for _ in range(n)), [rng.uniform(0.3, 2) for _ in range(n)])]
    return [[*pts, pts[0]]]


def polygons(spark, shapes, name="rings", key="id"):
    return spark.createDataFrame([(i, s) for i, s in enumerate(shapes)], f"{key} int, {name} {pg.RINGS}")


def inside(rings, x, y):
    odd = False
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:]):
            side = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
            if side == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                return True
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
    return odd


def test_polygon_join_equals_brute_force(spark):
    rng = random.Random(4)
    shapes = [L, *[star(rng, rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(12)]]
    points = [(i, rng.uniform(0, 10), rng.uniform(0, 10)) for i in range(200)] + [(900, 0.0, 2.0), (901, 0.5, 0.7), (902, 3.0, 2.0), (903, 0.75, 0.75), (904, 4.0, 4.0)]
    found = spatial.polygon_join(polygons(spark, shapes), spark.createDataFrame(points, "p int, lon double, lat double"), rows_per_task=20)
    want = sorted((i, p) for (i, s), (p, x, y) in itertools.product(enumerate(shapes), points) if inside(s, x, y))
    assert sorted((r.id, r.p) for r in found.collect()) == want and {p for i, p in want if i == 0} >= {900, 901, 902}


def test_polygon_overlay_equals_brute_force(spark):
    rng = random.Random(9)
    left = [L, *[star(rng, rng.uniform(0, 8), rng.uniform(0, 8), 6) for _ in range(8)]]
    right = [[[(0.6, 0.6), (0.9, 0.6), (0.9, 0.9), (0.6, 0.6)]], [[(2.5, 2.5), (3.5, 2.5), (3.5, 3.5), (2.5, 2.5)]], *[star(rng, rng.uniform(0, 8), rng.uniform(0, 8), 6) for _ in range(8)]]

    def meet(a, b):
        # sampled densely along all edges, and by corners: enough for random shapes
        for s, t in ((a, b), (b, a)):
            for r in s:
                for (ax, ay), (bx, by) in zip(r, r[1:]):
                    for k in range(400):
                        if inside(t, ax + (bx - ax) * k / 400, ay + (by - ay) * k / 400):
                            return True
        return False

    found = spatial.polygon_overlay(polygons(spark, left), polygons(spark, right, "aoi_rings", "aoi"))
    want = sorted((i, j) for (i, a), (j, b) in itertools.product(enumerate(left), enumerate(right)) if meet(a, b))
    got = sorted((r.id, r.aoi) for r in found.collect())
    assert got == want and (0, 0) not in got and (0, 1) not in got  # in the hole, and in the notch


def test_clipped_areas_add_up(spark):
    rng = random.Random(1)
    shapes = [L, *[star(rng, rng.uniform(1, 9), rng.uniform(1, 9)) for _ in range(6)]]
    grid = spark.range(36).select("id", box(F.col("id") % 6 * 2.0 - 1, F.floor(F.col("id") / 6) * 2.0 - 1, F.col("id") % 6 * 2.0 + 1, F.floor(F.col("id") / 6) * 2.0 + 1).alias("bbox")).withColumnRenamed("id", "cell")
    whole = {r.id: r.a for r in polygons(spark, shapes).select("id", pg.polygon_area(F.col("rings")).alias("a")).collect()}
    parts = spatial.clip_to_boxes(polygons(spark, shapes), grid)
    for r in parts.groupBy("id").agg(F.sum("area").alias("a")).collect():
        assert abs(r.a - whole[r.id]) < 1e-9
    ring = np.array([p for p in L[0]])
    assert abs(whole[0] - 11.75) < 1e-12 and len(ring) == 7


def test_clip_by_a_triangle(spark):
    triangle = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0))])
    square = [[[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]], [[(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 4.0), (2.0, 2.0)]], [[(1.0, 1.0), (4.0, 1.0), (4.0, 4.0), (1.0, 4.0), (1.0, 1.0)]]]
    cut = polygons(spark, square).select("id", pg.clip_convex(F.col("rings"), pg.convex_planes(triangle)).alias("c"))
    areas = {r.id: r.a for r in cut.select("id", F.when(F.size("c") > 0, pg.polygon_area(F.col("c"))).otherwise(0.0).alias("a")).collect()}
    assert abs(areas[0] - 4) < 1e-12 and abs(areas[1]) < 1e-12 and abs(areas[2] - 2) < 1e-12


def packed(rings, order="<"):
    body = b"".join(struct.pack(order + "I", len(r)) + b"".join(struct.pack(order + "dd", *p) for p in r) for r in rings)
    return struct.pack(order + "BII", order == "<", 3, len(rings)) + body


def test_wkb_of_both_byte_orders(spark):
    rng = random.Random(3)
    odd = [[(rng.uniform(-1e6, 1e6), rng.gauss(0, 1e-9)) for _ in range(4)], [(0.0, -0.0), (5e-324, 1e300), (-1.5, 2.0**-30)]]
    many = struct.pack(">BII", 0, 6, 2) + packed(odd, ">") + packed(L, "<")
    rows = [(0, packed(odd)), (1, packed(odd, ">")), (2, many), (3, None), (4, struct.pack("<BIdd", 1, 1, 1.0, 2.0)), (5, packed([])), (6, packed([[]]))]
    got = {r.id: r.r for r in spark.createDataFrame([(i, bytearray(w) if w is not None else None) for i, w in rows], "id int, w binary").select("id", pg.wkb_rings(F.col("w")).alias("r")).collect()}
    plain = lambda r: [[tuple(p) for p in ring] for ring in r]
    assert plain(got[0]) == odd and plain(got[1]) == odd and plain(got[2]) == odd + L and got[3] is None and got[4] is None and got[5] == [] and got[6] == [[]]
    back = polygons(spark, [L, odd[:1]]).select("id", pg.rings_wkb(F.col("rings")).alias("w")).collect()
    assert {r.id: bytes(r.w) for r in back} == {0: packed(L), 1: packed(odd[:1])}


def collection(rng, n):
    out = []
    for i in range(n):
        kind = rng.choice(["Point", "Polygon", "MultiPolygon", "LineString", "none"])
        coordinates = {"Point": [i * 1.5, -i], "Polygon": [[list(p) for p in r] for r in L], "MultiPolygon": [[[list(p) for p in r] for r in L]], "LineString": [[0, 0], [1, 1]]}
        geometry = {"type": kind, "coordinates": coordinates[kind]} if kind != "none" else None
        tricky = rng.choice(['brace { "x" and ]', 'a "quoted" \\ back', '{"type":"Feature","geometry":null}', "ünï 梦", ""])
        feature = {"type": "Feature", "properties": {"class": i, "name": tricky, "inner": {"type": "Feature", "geometry": None, "deep": [{"a": 1}, {"b": [2]}]}}, "geometry": geometry}
        out.append(dict(rng.sample(list(feature.items()), 3)))  # members in any order
    return out


@pytest.mark.parametrize("layout", ["one line", "one a line", "pretty"])
def test_feature_files_are_cut_at_any_byte(spark, tmp_path, layout):
    rng = random.Random(layout)
    rows = collection(rng, 60)
    whole = {"type": "FeatureCollection", "name": "some { \"type\": \"Feature\"", "features": rows}
    text = json.dumps(whole, indent=2 if layout == "pretty" else None, ensure_ascii=False)
    if layout == "one a line":
        text = '{"type": "FeatureCollection", "features": [\n' + ",\n".join(json.dumps(r) for r in rows) + "\n]}\n"
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.geojson").write_text(text)
    (tmp_path / "f" / "empty.geojson").write_text('{"type":"FeatureCollection","features":[]}')
    (tmp_path / "f" / "one.json").write_text(json.dumps(rows[0]))
    want = sorted((r["properties"]["class"], r["properties"]["name"], (r["geometry"] or {}).get("type")) for r in [*rows, rows[0]])
    raw = text.encode()
    for size in (7, 64, 1000):  # every feature belongs to exactly one range, wherever the cuts fall
        cut = [f for at in range(0, len(raw), size) for f in features.features_between(io.BytesIO(raw), at, min(at + size, len(raw)), len(raw), 1 << 20)]
        assert [f for _, f in cut] == rows and all(raw[o : o + 1] == b"{" for o, _ in cut)
    for size in (20_000, 10**7):
        found = features.scan_features(spark, str(tmp_path / "f"), {"class": "int", "name": "string"}, range_bytes=size)
        got = found.collect()
        assert sorted((r["class"], r.name, r.kind) for r in got) == want
        for r in got:
            if r.kind == "Point":
                assert (r.lon, r.lat, r.rings) == (r["class"] * 1.5, -r["class"], None)
            elif r.kind in ("Polygon", "MultiPolygon"):
                assert [[tuple(p) for p in ring] for ring in r.rings] == L
            else:
                assert (r.lon, r.lat, r.rings) == (None, None, None)
    assert features.scan_features(spark, str(tmp_path / "f"), range_bytes=4000).rdd.getNumPartitions() > len(text) // 4000


def test_small_ranges_of_a_large_file_read_little_and_share_tasks(spark, tmp_path):
    rows = [{"type": "Feature", "properties": {"class": i}, "geometry": {"type": "Point", "coordinates": [i, -i]}} for i in range(5000)]
    raw = json.dumps({"type": "FeatureCollection", "features": rows}).encode()

    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            data = super().read(n)
            self.taken += len(data)
            return data

    handle = Counted(raw)
    cut = [f for at in range(0, len(raw), 4000) for _, f in features.features_between(handle, at, min(at + 4000, len(raw)), len(raw), 1 << 20)]
    assert cut == rows and handle.taken < 5 * len(raw)
    for k in range(3):
        (tmp_path / f"{k}.geojson").write_bytes(raw)
    found = features.scan_features(spark, str(tmp_path), range_bytes=4000)
    assert found.rdd.getNumPartitions() <= 2 * features.TASKS < 3 * len(raw) // 4000
    assert sorted(r["class"] for r in found.collect()) == sorted(3 * list(range(5000)))


def test_hilbert_curve_visits_neighbours(spark):
    n = 32
    cells = spark.range(n * n).select((F.col("id") % n).alias("x"), F.floor(F.col("id") / n).alias("y"))
    rows = cells.select("x", "y", places.hilbert_key(F.col("x"), F.col("y"), 5).alias("k")).orderBy("k").collect()
    assert [r.k for r in rows] == list(range(n * n))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) == 1 for a, b in zip(rows, rows[1:]))


def test_box_search_opens_few_files(spark, tmp_path):
    path = str(tmp_path / "places")
    x, y = (F.col("id") * 7919 % 36000) / 100.0 - 180, (F.col("id") * 104729 % 18000) / 100.0 - 90
    table = spark.range(20_000).select("id", box(x, y, x + 0.1, y + 0.1).alias("bbox"))
    places.write_places(table, path, 64)
    area = (10.0, 20.0, 30.0, 35.0)
    found = places.search_places(spark, path, area)
    b = F.col("bbox")
    want = table.where((b["xmin"] <= area[2]) & (b["xmax"] >= area[0]) & (b["ymin"] <= area[3]) & (b["ymax"] >= area[1]))
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in want.collect())
    assert len(found.inputFiles()) <= 8 < 60 <= len(spark.read.parquet(f"{path}/rows").inputFiles())
    assert places.search_places(spark, path, (500, 500, 501, 501)).collect() == []


def test_places_across_the_date_line_and_a_pole_are_one_cluster(spark):
    rng = np.random.default_rng(5)
    rows = [(0, float((180 + d + 180) % 360 - 180), float(rng.normal(0, 1))) for d in rng.normal(0, 3, 60)]
    rows += [(1, float(rng.uniform(-180, 180)), 88.0) for _ in range(60)]
    rows += [(2, float(rng.normal(10, 2)), float(rng.normal(45, 2))) for _ in range(60)] + [(3, None, 1.0)]
    got = learn.kmeans_places(spark.createDataFrame(rows, "kind int, lon double, lat double"), 3).collect()
    pairs = {(r.kind, r.cluster) for r in got}
    assert len(pairs) == 4 and (3, None) in pairs
    line = next(r for r in got if r.kind == 0)
    assert abs(abs(line.centre_lon) - 180) < 3 and abs(line.centre_lat) < 2
    assert next(r for r in got if r.kind == 1).centre_lat > 85


def test_radial_kernel_separates_rings(spark):
    rng = np.random.default_rng(6)
    angle, ring = rng.uniform(0, 2 * np.pi, 400), rng.integers(0, 2, 400)
    radius = 1 + 2 * ring + rng.normal(0, 0.15, 400)
    rows = [(i, [float(r * np.cos(a)), float(r * np.sin(a))], int(k)) for i, (a, r, k) in enumerate(zip(angle, radius, ring))]
    table = spark.createDataFrame(rows, "vec_id int, vec array<double>, kind int")
    train, test = table.where("vec_id % 4 > 0"), table.where("vec_id % 4 = 0")

    def share(fitted):
        return learn.predict(fitted, test, ["kind"]).where("kind = prediction").count() / test.count()

    assert share(learn.train_rbf_svm(train, "kind", components=200, max_iter=20)) > 0.97 > 0.8 > share(learn.train_svm(train, "kind", max_iter=20))


def test_both_sides_crowded(spark):
    left = spark.range(600).select((F.col("id") % 3 * F.when(F.col("id") % 7 == 0, 1).otherwise(0)).alias("k"), F.lit("same").alias("a"))
    right = spark.range(500).select((F.col("id") % 5 * F.when(F.col("id") % 3 == 0, 1).otherwise(0)).alias("k"), F.col("id").alias("b"))
    want = left.join(right, "k").groupBy("k").agg(F.count("*"), F.sum("b")).collect()
    for both in (True, False):
        got = salted_join(left, right, ["k"], 40, both).groupBy("k").agg(F.count("*"), F.sum("b")).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    hot = hot_keys(left, right, ["k"], 40)
    assert {r.k for r in hot.collect()} == {r["k"] for r in left.groupBy("k").count().where("count > 40").union(right.groupBy("k").count().where("count > 40")).collect()}
    for side in hot_grid(left, right, hot, ["k"]):  # equal rows are spread as well
        assert side.groupBy("k", "_r", "_c").count().agg(F.max("count")).first()[0] <= 80


def test_index_recall_and_its_reads(spark, tmp_path):
    rng = np.random.default_rng(0)
    middles = rng.normal(size=(30, 16)) * 3
    m = (middles[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16))).round(4)
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(5000, None), (5001, [None] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, vec array<double>").repartition(6)
    vector_index.build_index(table, str(tmp_path / "ix"), cells=60, parts=4)
    index = vector_index.open_index(spark, str(tmp_path / "ix"))
    queries = table.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    exact = {(r.query_id, r.neighbour_id): r.distance for r in search.knn(table, queries, 10).collect()}
    found = {(r.query_id, r.neighbour_id): r.distance for r in vector_index.search_index(index, queries, 10, table.schema["vec_id"].dataType).collect()}
    assert len(found.keys() & exact.keys()) >= 0.9 * len(exact) and index.probes < 30
    assert all(abs(found[p] - exact[p]) < 1e-9 for p in found.keys() & exact.keys())
    near = np.argsort(((m[0] - index.centres) ** 2).sum(axis=1))[:3].tolist()
    files = vector_index._cells(spark, index, near, "id long, codes binary, cell int").inputFiles()
    assert files and all(any(f"cell={c}/" in f for c in near) for f in files)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_join_of_two_tables_equals_brute_force(spark, metric):
    rng = np.random.default_rng(8)
    m = np.concatenate([rng.normal(size=(150, 6)), np.tile(rng.normal(size=6), (60, 1)), rng.normal(size=(40, 6)) + 5]).round(3)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, vec array<double>").repartition(5)
    queries = table.withColumnRenamed("vec_id", "query_id")
    got = {(r.query_id, r["rank"]): r.neighbour_id for r in search.knn(table, queries, 9, metric=metric, block_bytes=1, pivots=12).collect()}
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(len(m)):
        d = np.sqrt(((m - m[q]) ** 2).sum(1)) if metric == "l2" else 1 - unit @ unit[q]
        want = np.lexsort((np.arange(len(m)), d.round(12)))[:9].tolist()
        assert [got[q, k + 1] for k in range(9)] == want


def test_index_measures_again_as_many_rows_as_the_recall_takes(spark, tmp_path):
    rng = np.random.default_rng(5)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(4000, 16)))], "vec_id long, vec array<double>").repartition(4)
    index = vector_index.build_index(table, str(tmp_path / "ix"), cells=20, parts=1)  # one code a vector: distances are very rough
    queries = table.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vec")
    opened = vector_index.open_index(spark, str(tmp_path / "ix"))
    assert (opened.probes, opened.rerank) == (index.probes, index.rerank) and index.rerank > 200
    exact = {(r.query_id, r.neighbour_id) for r in search.knn(table, queries, 10).collect()}
    found = {(r.query_id, r.neighbour_id) for r in vector_index.search_index(opened, queries, 10, table.schema["vec_id"].dataType).collect()}
    assert len(found & exact) >= 0.9 * len(exact)


def test_fitting_an_index_holds_a_block_of_distances():
    import tracemalloc

    rows = np.random.default_rng(6).normal(size=(20_000, 8))
    tracemalloc.start()
    centres = vector_index._fit(rows, 1500, 1)  # all distances at once: 240 MB
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(centres) == 1500 and peak < 8 * vector_index.BLOCK_BYTES
