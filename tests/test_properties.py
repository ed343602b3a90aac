"""Results that must hold whatever the data, the partitioning or the skew."""

import itertools

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterloom.functions import geo
from rasterloom.functions import pixels as px
from rasterloom.operators import pairing, sampling, search, spatial, tokens
from rasterloom.plans.ranking import draw_rank, draw_within, top_per_group
from rasterloom.plans.skew import salted_join

FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def skewed(spark, n=3000):
    """A third of all rows in one group."""
    return spark.range(n).select(
        F.col("id").alias("chip_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 7)).alias("platform")
    )


def test_draw_rank_is_a_dense_rank_per_group(spark):
    got = draw_rank(skewed(spark), ["platform"], ["chip_id"], 1, "r", "n").toPandas()
    for _, g in got.groupby("platform"):
        assert sorted(g["r"]) == list(range(1, len(g) + 1)) and set(g["n"]) == {len(g)}


def test_draw_rank_keeps_null_groups(spark):
    df = spark.range(100).select(F.col("id"), F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise("x").cast("string").alias("g"))
    assert draw_rank(df, ["g"], ["id"], 1).count() == 100


@pytest.mark.parametrize("quota", [0, 1, 7, 10_000])
@pytest.mark.parametrize("rows_per_slice", [1, 10**6])
def test_draw_within_equals_rank(spark, quota, rows_per_slice):
    df = skewed(spark).withColumn("platform", F.when(F.col("platform") != "g1", F.col("platform")))
    want = draw_rank(df, ["platform"], ["chip_id"], 6, "r").filter(F.col("r") <= quota)
    got = draw_within(df, ["platform"], ["chip_id"], 6, F.lit(quota), "w", rows_per_slice)
    assert got.count() == 3000
    assert sorted(r[0] for r in got.filter("w").select("chip_id").collect()) == sorted(r[0] for r in want.select("chip_id").collect())


@pytest.mark.parametrize("quota", [0, 1, 70, 10_000])
def test_draw_within_one_group(spark, quota):
    df = skewed(spark, 100)
    want = draw_rank(df, [], ["chip_id", "platform"], 6, "r").filter(F.col("r") <= quota)
    got = draw_within(df, [], ["chip_id", "platform"], 6, F.lit(quota), "w")
    assert got.count() == 100
    assert sorted(r[0] for r in got.filter("w").collect()) == sorted(r[0] for r in want.collect())
    assert draw_within(df.filter("chip_id < 0"), [], ["chip_id"], 6, F.lit(quota), "w").count() == 0


@pytest.mark.parametrize("rows_per_slice", [1, 3, 50])
def test_slices_do_not_change_ranks(spark, rows_per_slice):
    a = draw_rank(skewed(spark), ["platform"], ["chip_id"], 5, rows_per_slice=rows_per_slice)
    b = draw_rank(skewed(spark), ["platform"], ["chip_id"], 5)
    assert a.exceptAll(b).count() == 0


@pytest.mark.parametrize("parts", ["1", "3", "17"])
def test_partitioning_does_not_change_results(spark, parts):
    def run():
        chips = skewed(spark)
        names = [r[0] for r in chips.select("platform").distinct().orderBy("platform").collect()]
        split = sampling.stratified_split(chips, ["platform"], ["chip_id"], 2)
        batches = sampling.balanced_batches(chips, names, 16, ["chip_id"], 2)
        return split.toPandas().sort_values("chip_id").values.tolist(), sorted(map(tuple, batches.collect()))

    want = run()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert run() == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_split_sizes_are_exact_and_disjoint(spark):
    got = sampling.stratified_split(skewed(spark), ["platform"], ["chip_id"], 3).toPandas()
    assert got["chip_id"].is_unique and len(got) == 3000
    for _, g in got.groupby("platform"):
        assert (g["split"] == "train").sum() == round(len(g) * 0.8)
    assert sampling.sample_ids(skewed(spark), 0.05, 1, ["chip_id"]).count() == 150
    assert sampling.sample_ids(skewed(spark), 1, 1, ["chip_id"]).count() == 3000


def test_bounded_fraction_bounds(spark):
    got = sampling.bounded_fraction(skewed(spark), ["platform"], ["chip_id"], 1, 0.5, 10, 300).groupBy("platform").count().collect()
    n = {r["platform"]: r["count"] for r in got}
    total = {r["platform"]: r["count"] for r in skewed(spark).groupBy("platform").count().collect()}
    assert n == {k: min(300, max(10, v // 2)) for k, v in total.items()}


def test_replicas_are_disjoint_and_epochs_differ(spark):
    chips = skewed(spark, 600)
    names = [r[0] for r in chips.select("platform").distinct().orderBy("platform").collect()]
    first = sampling.distributed_batches(chips, names, 8, ["chip_id"], 4, 9, epoch=0)
    rows = first.toPandas()
    assert not rows.duplicated(["chip_id", "rep"]).any()
    assert (rows.groupby(["replica", "batch_order"]).size() == 8).all()
    assert rows.groupby(["replica", "batch_order"])["platform"].nunique().max() == 1
    assert sampling.distributed_batches(chips, names, 8, ["chip_id"], 4, 9, epoch=1).exceptAll(first).count() > 0
    only = sampling.distributed_batches(chips, names, 8, ["chip_id"], 4, 9, epoch=0, rank=2)
    assert only.count() == (rows["replica"] == 2).sum()


@FEW
@given(ratio=st.floats(0, 1), n=st.integers(1, 64))
def test_masked_count(spark, ratio, n):
    got = sampling.mask_patches(spark.range(5), F.lit(n), ratio, 4, ["id"]).groupBy("id").agg(F.sum("masked").alias("m"), F.count("*").alias("n"))
    assert {(r["m"], r["n"]) for r in got.collect()} == {(int(ratio * n), n)}


def test_natural_mask_order(spark):
    rows = sampling.mask_patches(spark.range(1), F.lit(10), 0.35, None, ["id"]).orderBy("patch_idx").collect()
    assert [r["masked"] for r in rows] == [1] * 3 + [0] * 7


@pytest.mark.parametrize("limit", [50, 10_000])
def test_salted_join_equals_plain_join(spark, limit):
    big = skewed(spark)
    small = big.select("platform").distinct().withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    got = salted_join(big, small, ["platform"], limit)
    want = big.join(small, "platform").select(*got.columns)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() == 6000


def _boxes(spark, rows, name):
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], f"{name} int, x double, y double, w double, h double")
    return df.select(name, geo.box(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")).alias(f"{name}_box"))


coord = st.integers(-40, 40).map(lambda v: v / 4)
side = st.sampled_from([0.25, 1.0, 3.0, 17.0, 64.0])
box_rows = st.lists(st.tuples(coord, coord, side, side), min_size=1, max_size=12)


@FEW
@given(boxes=box_rows, points=st.lists(st.tuples(coord, coord), min_size=1, max_size=20))
def test_spatial_join_equals_brute_force(spark, boxes, points):
    p = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(points)], "point_id int, lon double, lat double")
    got = spatial.spatial_join(_boxes(spark, boxes, "b"), p, "b_box", rows_per_task=3).select("b", "point_id")
    want = sorted(
        (i, j)
        for (i, (x, y, w, h)), (j, (px_, py_)) in itertools.product(enumerate(boxes), enumerate(points))
        if x <= px_ <= x + w and y <= py_ <= y + h
    )
    assert sorted(map(tuple, got.collect())) == want


@FEW
@given(left=box_rows, right=box_rows)
def test_overlay_equals_brute_force(spark, left, right):
    got = spatial.aoi_overlay(_boxes(spark, left, "l"), _boxes(spark, right, "r"), "l_box", "r_box", rows_per_task=5).select("l", "r")
    want = sorted(
        (i, j)
        for (i, (x, y, w, h)), (j, (a, b, c, d)) in itertools.product(enumerate(left), enumerate(right))
        if max(x, a) < min(x + w, a + c) and max(y, b) < min(y + h, b + d)
    )
    assert sorted(map(tuple, got.collect())) == want


def test_radar_match_equals_brute_force_under_skew(spark):
    rng = np.random.default_rng(1)
    tile = np.where(rng.random(400) < 0.4, 0, rng.integers(1, 6, 400))
    s1 = [(i, int(tile[i]), f"2020-01-{1 + int(rng.integers(0, 20)):02d}", int(rng.integers(1, 6)) * 10) for i in range(400)]
    s2 = [(i, int(rng.integers(0, 7)), f"2020-01-{1 + int(rng.integers(0, 25)):02d}") for i in range(80)]
    a = spark.createDataFrame(s2, "item_id int, tile int, dt string").withColumn("dt", F.to_timestamp("dt"))
    b = spark.createDataFrame(s1, "sar_id int, tile int, dt string, coverage int").withColumn("dt", F.to_timestamp("dt"))
    want = set()
    for item, t, day in s2:
        near = sorted((abs(int(d[-2:]) - int(day[-2:])), i, c) for i, u, d, c in s1 if u == t and abs(int(d[-2:]) - int(day[-2:])) <= 3)
        covered = 0
        for _, i, c in near:
            if covered >= 100:
                break
            want.add((item, i))
            covered += c
    assert {(r["item_id"], r["sar_id"]) for r in pairing.match_sar(a, b, full=100).collect()} == want


def _vectors(spark, n=300, d=8, copies=100):
    """Random vectors, a third of them copies of one."""
    m = np.random.default_rng(3).normal(size=(n, d)).round(3)
    m[: copies] = m[0]
    return m, spark.createDataFrame([(i, m[i].tolist()) for i in range(n)], "vec_id long, vec array<double>").repartition(7)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("block", [32 << 20, 1200])
def test_knn_equals_brute_force(spark, metric, block):
    m, table = _vectors(spark)
    queries = table.filter(F.col("vec_id") % 37 == 0).withColumnRenamed("vec_id", "query_id")
    got = search.knn(table, queries, 12, metric=metric, block_bytes=block).collect()
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(0, 300, 37):
        d = np.sqrt(((m - m[q]) ** 2).sum(1)) if metric == "l2" else 1 - unit @ unit[q]
        want = np.lexsort((np.arange(300), d.round(12)))[:12].tolist()
        assert [r["neighbour_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_lsh_recall(spark):
    _, table = _vectors(spark, copies=1)
    queries = table.filter("vec_id < 20").withColumnRenamed("vec_id", "query_id")
    exact = {(r["query_id"], r["neighbour_id"]) for r in search.knn(table, queries, 5).collect()}
    near = {(r["query_id"], r["neighbour_id"]) for r in search.knn_lsh(table, queries, 5, radius=10.0, bucket_length=4.0).collect()}
    assert len(exact & near) / len(exact) > 0.8


@pytest.mark.parametrize("rows_per_slice", [20, 1_000_000])
def test_change_series_equals_pandas_shift(spark, rows_per_slice):
    m, table = _vectors(spark, copies=1)
    where = F.when(F.col("vec_id") % 3 == 0, F.lit(0)).otherwise(F.col("vec_id") % 5 + 1)
    series = table.withColumn("loc", where).withColumn("dt", F.timestamp_seconds(F.col("vec_id") * 5000))
    got = tokens.change_series(series, "loc", "dt", "vec_id", F.col("vec_id") < 30, 1.0, rows_per_slice).collect()
    assert len(got) == 300
    last = {}
    dist = {r["vec_id"]: r["dist_prev"] for r in got}
    for i in range(300):
        loc = 0 if i % 3 == 0 else i % 5 + 1
        if loc in last:
            assert dist[i] == pytest.approx(np.linalg.norm(m[i] - m[last[loc]]))
        else:
            assert dist[i] is None
        last[loc] = i


def test_top_per_group_equals_plain_window(spark):
    df = skewed(spark)
    got = top_per_group(df, ["platform"], [F.desc("chip_id")], 7, ["chip_id"]).groupBy("platform").agg(F.min("chip_id").alias("m"), F.count("*").alias("n"))
    want = df.toPandas().sort_values("chip_id", ascending=False).groupby("platform").head(7).groupby("platform")["chip_id"].min().to_dict()
    assert {r["platform"]: r["m"] for r in got.collect()} == want


def test_standardise_round_trip(spark):
    df = spark.createDataFrame([([[1.0, 2.5], [3.0, -4.0]],)], "pixels array<array<double>>")
    mean, std = F.array(F.lit(5.0), F.lit(-2.0)), F.array(F.lit(3.0), F.lit(0.5))
    back = df.select(px.destandardise(px.standardise(F.col("pixels"), mean, std), mean, std).alias("p")).collect()[0]["p"]
    assert np.allclose(back, [[1.0, 2.5], [3.0, -4.0]])


@FEW
@given(lon=st.floats(12, 18), lat=st.floats(-79, 83))
def test_projection_round_trip(spark, lon, lat):
    epsg = 32633 if lat >= 0 else 32733
    x, y = geo.reproject(F.lit(lon), F.lit(lat), 4326, epsg)
    back = spark.range(1).select(*geo.reproject(x, y, epsg, 4326)).collect()[0]
    assert back[0] == pytest.approx(lon, abs=1e-7) and back[1] == pytest.approx(lat, abs=1e-7)


def test_unknown_sensors_never_vanish(spark):
    import pytest

    from rasterloom.operators import bands, embed
    from rasterloom.sources.registry import sensor_registry

    registry = sensor_registry(spark)
    rows = [(1, "linz", 2, 2, [[1.0] * 4] * 3), (2, "balloon", 2, 2, [[1.0] * 4] * 3), (3, None, 2, 2, [[1.0] * 4] * 3)]
    chips = spark.createDataFrame(rows, "chip_id int, platform string, h int, w int, pixels array<array<double>>")
    for job in (bands.standardise_chips, bands.destandardise_chips):
        with pytest.raises(Exception, match="balloon|NULL"):
            job(chips, registry).collect()
        out = {r.chip_id: r.pixels for r in job(chips, registry, unknown="null").collect()}
        assert set(out) == {1, 2, 3} and out[1] is not None and out[2] is None and out[3] is None
    encoder = embed.PatchMeanEncoder(4)
    with pytest.raises(Exception, match="balloon|NULL"):
        embed.embed_chips(chips, registry, encoder, ["chip_id"]).collect()
    out = {r.chip_id: r.vec for r in embed.embed_chips(chips, registry, encoder, ["chip_id"], unknown="null").collect()}
    assert set(out) == {1, 2, 3} and out[1] is not None and out[2] is None
    values = spark.createDataFrame([("linz", "red", 1.0), ("linz", "sonar", 1.0), ("balloon", "red", 1.0)], "platform string, band string, value double")
    with pytest.raises(Exception, match="sonar|balloon"):
        bands.normalise_join(values, registry).collect()
    scaled = bands.normalise_join(values, registry, unknown="null").collect()
    assert len(scaled) == 3 and sum(r.scaled is None for r in scaled) == 2


def test_search_leaves_null_vectors_out_and_refuses_ragged_ones(spark):
    import pytest

    from rasterloom.operators import search

    corpus = spark.createDataFrame([(1, [0.0, 1.0]), (2, None), (3, [None, 1.0]), (4, [0.0, 3.0])], "vec_id int, vec array<double>")
    queries = spark.createDataFrame([(7, [0.0, 1.5]), (8, None)], "query_id int, vec array<double>")
    found = search.knn(corpus, queries, 3).collect()
    assert sorted((r.query_id, r.rank, r.neighbour_id) for r in found) == [(7, 1, 1), (7, 2, 4)]
    with pytest.raises(ValueError, match="more than once"):
        search.knn(corpus, queries.unionByName(queries), 3)
    ragged = corpus.unionByName(spark.createDataFrame([(5, [1.0, 2.0, 3.0])], corpus.schema))
    with pytest.raises(Exception, match="length"):
        search.knn(ragged, queries, 3).collect()


def test_equalised_histograms_of_odd_arrays(spark):
    import numpy as np

    from rasterloom.operators.aggregates import equalise_histogram

    rows = [(0, [2.0, 2.0]), (1, [1.0, None, 4.0, 9.0]), (2, []), (3, None), (4, [None])]
    out = {r.i: r.v for r in equalise_histogram(spark.createDataFrame(rows, "i int, v array<double>"), "v").collect()}
    counts, edges = np.histogram([1.0, 4.0, 9.0], bins=256)
    want = np.interp([1.0, 4.0, 9.0], (edges[:-1] + edges[1:]) / 2, counts.cumsum() / 3)
    assert out[0] == [0.5, 0.5] and out[1][1] is None and np.allclose([out[1][i] for i in (0, 2, 3)], want)
    assert out[2] == [] and out[3] is None and out[4] == [None]


def test_masked_loss_without_masked_patches(spark):
    from rasterloom.operators.metrics import masked_l1

    patches = spark.createDataFrame([([1.0], [2.0], 0)], "vals array<double>, recon array<double>, masked int")
    assert masked_l1(patches).first().loss is None
