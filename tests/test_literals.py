"""Hand-computed results on tiny frames."""

import math

import pytest
from pyspark.sql import functions as F

from rasterloom.functions import encodings as enc
from rasterloom.functions import geo, names
from rasterloom.functions import pixels as px
from rasterloom.functions import vectors as v
from rasterloom.operators import aggregates as agg
from rasterloom.operators import metrics, pairing, quality, sampling, spatial, tiling, tokens


def one(df):
    return df.collect()[0]


def raster(spark, w, h, bands=1):
    """One raster whose pixel value is 100*y + x (+1000 per band)."""
    pixels = [[float(1000 * b + 100 * y + x) for y in range(h) for x in range(w)] for b in range(bands)]
    return spark.createDataFrame([("r", h, w, pixels)], "id string, h int, w int, pixels array<array<float>>")


def test_iso_week_53_and_midnight(spark):
    df = spark.sql("select explode(array(timestamp '2021-01-03 00:00:00', timestamp '2018-07-01 00:00:00')) ts")
    rows = [r["e"] for r in df.select(enc.encode_time("ts").alias("e")).collect()]
    week = 53 * 2 * math.pi / 52
    assert rows[0] == pytest.approx([math.sin(week), math.cos(week), 0.0, 1.0])
    assert rows[1] == pytest.approx([math.sin(26 * 2 * math.pi / 52), math.cos(26 * 2 * math.pi / 52), 0.0, 1.0])


def test_latlon(spark):
    got = one(spark.range(1).select(enc.encode_latlon(F.lit(30.0), F.lit(90.0)).alias("e")))["e"]
    assert got == pytest.approx([0.5, math.sqrt(3) / 2, 1.0, 0.0], abs=1e-12)


def test_position_encoding_needs_even_width():
    with pytest.raises(ValueError):
        enc.posenc_1d(F.lit(1.0), 7)
    with pytest.raises(ValueError):
        enc.posenc_2d(F.lit(1.0), F.lit(1.0), 6)


def test_position_encoding_values(spark):
    got = one(spark.range(1).select(enc.posenc_1d(F.lit(2.0), 4).alias("e")))["e"]
    assert got == pytest.approx([math.sin(2), math.sin(2e-4), math.cos(2), math.cos(2e-4)])


def test_chips_are_numbered_down_the_columns(spark):
    chips = tiling.chip_raster(raster(spark, 4, 6, 2), 2, ["id"]).collect()
    assert len(chips) == 6
    corner = {c["chip_no"]: (c["chip_x"], c["chip_y"], c["pixels"][0][0]) for c in chips}
    assert corner[0] == (0, 0, 0.0) and corner[1] == (0, 1, 200.0) and corner[3] == (1, 0, 2.0)
    assert {c["chip_no"]: c["pixels"][1] for c in chips}[5] == [1402.0, 1403.0, 1502.0, 1503.0]


def test_remainder_is_dropped(spark):
    assert tiling.chip_raster(raster(spark, 6, 5), 2, ["id"]).count() == 6
    assert tiling.chip_raster(raster(spark, 1, 5), 2, ["id"]).count() == 0


def test_patchify_round_trip(spark):
    source = raster(spark, 8, 8, 3)
    patches = tiling.patchify(source, 4, ["id"])
    assert patches.count() == 4
    assert one(patches.filter("patch_idx = 1"))["vals"][:5] == [4.0, 5.0, 6.0, 7.0, 104.0]
    back = tiling.unpatchify(patches, 4, 8, 8, ["id"])
    assert one(back)["pixels"] == one(source)["pixels"]


def test_bilinear_identity_and_halving(spark):
    assert one(tiling.resample(raster(spark, 4, 4), 4, 4))["pixels"] == one(raster(spark, 4, 4))["pixels"]
    half = one(tiling.resample(raster(spark, 4, 4), 2, 2))["pixels"][0]
    assert half == [50.5, 52.5, 250.5, 252.5]


def features(spark, rows):
    return spark.createDataFrame(rows, "tile string, platform string, month int, band_idx int, px int, value double")


def test_only_complete_months_enter_the_composite(spark):
    rows = [("t", p, 0, b, 0, 2.0) for p, n in (("S1", 2), ("S2", 10)) for b in range(n)]
    rows += [("t", "S1", 1, b, 0, 50.0) for b in range(2)] + [("t", "S2", 1, b, 0, 50.0) for b in range(9)]
    whole = quality.complete_months(features(spark, rows))
    assert {r["month"] for r in whole.select("month").collect()} == {0}
    mean = quality.temporal_composite(whole, ["tile", "platform", "band_idx", "px"])
    assert {r["value"] for r in mean.collect()} == {2.0}


def test_masked_everywhere_stays_null(spark):
    rows = [("t", "S1", m, 0, 0, 0.0) for m in range(3)] + [("t", "S1", m, 1, 0, float(m)) for m in range(3)]
    masked = quality.mask_nodata(features(spark, rows))
    got = {r["band_idx"]: r["value"] for r in quality.temporal_composite(masked).collect()}
    assert got == {0: None, 1: 1.5}


def test_nodata_threshold_is_exclusive(spark):
    rows = [("a", 0, i, None) for i in range(2)] + [("b", 0, i, None) for i in range(3)]
    df = spark.createDataFrame(rows, "tile string, band_idx int, px int, value double")
    assert {r["tile"] for r in quality.drop_nodata_tiles(df, 2).collect()} == {"a"}


def test_label_codes(spark):
    df = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, 15, 7)], "label int")
    assert [r["label"] for r in quality.remap_labels(df).collect()] == [0, 1, 2, 3, 4, 5, 6, None]


def test_cloud_percentage_truncates(spark):
    scl = [9.0] * 1023 + [4.0]
    df = spark.createDataFrame([("c", 32, 32, scl)], "id string, h int, w int, scl array<double>")
    assert one(quality.patch_cloud_pct(df, F.col("scl"), ["id"]))["cloud_pct"] == 99


def test_point_on_a_shared_edge_hits_both_boxes(spark):
    boxes = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 1.0), ("b", 1.0, 0.0, 2.0, 1.0)], "id string, x0 double, y0 double, x1 double, y1 double")
    boxes = boxes.select("id", geo.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("bbox"))
    points = spark.createDataFrame([(1, 1.0, 0.5), (2, 5.0, 5.0)], "point_id int, lon double, lat double")
    assert {(r["id"], r["point_id"]) for r in spatial.spatial_join(boxes, points).collect()} == {("a", 1), ("b", 1)}


def test_touching_boxes_do_not_overlay(spark):
    def boxes(rows, name):
        df = spark.createDataFrame(rows, f"{name} string, x0 double, y0 double, x1 double, y1 double")
        return df.select(name, geo.box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias(f"{name}_box"))

    left = boxes([("a", 0.0, 0.0, 1.0, 1.0)], "l")
    right = boxes([("edge", 1.0, 0.0, 2.0, 1.0), ("in", 0.5, 0.5, 100.0, 100.0)], "r")
    got = spatial.aoi_overlay(left, right, "l_box", "r_box").collect()
    assert [(r["r"], r["clip"]["xmin"], r["clip"]["xmax"]) for r in got] == [("in", 0.5, 1.0)]


def radar(spark, gaps, coverage):
    rows = [(i, "t", f"2020-05-{10 + g:02d}", coverage) for i, g in enumerate(gaps)]
    return spark.createDataFrame(rows, "sar_id int, tile string, dt string, coverage double").withColumn("dt", F.to_timestamp("dt"))


def test_radar_window_is_three_days(spark):
    s2 = spark.createDataFrame([("x", "t", "2020-05-10"), ("alone", "u", "2020-05-10")], "item_id string, tile string, dt string")
    s2 = s2.withColumn("dt", F.to_timestamp("dt"))
    got = pairing.match_sar(s2, radar(spark, [-4, -3, 0, 3], 0.1)).collect()
    assert [(r["sar_id"], r["match_rank"]) for r in sorted(got, key=lambda r: r["match_rank"])] == [(2, 1), (1, 2), (3, 3)]
    assert {r["item_id"] for r in got} == {"x"}


def test_radar_stops_when_the_tile_is_covered(spark):
    s2 = spark.createDataFrame([("x", "t", "2020-05-10")], "item_id string, tile string, dt string").withColumn("dt", F.to_timestamp("dt"))
    got = pairing.match_sar(s2, radar(spark, [-1, 0, 0, 2], 0.5)).collect()
    assert {r["sar_id"] for r in got} == {1, 2}


def test_balanced_batches_of_5_2_1(spark):
    rows = [(f"{p}{i}", p) for p, n in (("a", 5), ("b", 2), ("c", 1)) for i in range(n)]
    chips = spark.createDataFrame(rows, "chip_id string, platform string")
    got = sampling.balanced_batches(chips, ["a", "b", "c"], 2, ["chip_id"], 3).collect()
    assert len(got) == 12  # two batches of two per platform
    by_batch = {}
    for r in got:
        by_batch.setdefault(r["batch_order"], []).append(r)
    assert sorted(by_batch) == list(range(6))
    assert all(len(b) == 2 and len({r["platform"] for r in b}) == 1 for b in by_batch.values())
    assert [by_batch[i][0]["platform"] for i in range(6)] == ["a", "b", "c"] * 2


def test_weighted_scores(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (None, 1)], "label int, pred int")
    got = one(metrics.classification_metrics(df))
    assert got["n"] == 4 and got["accuracy"] == 0.75
    assert got["f1_weighted"] == pytest.approx((2 / 3 + 0.8) / 2)
    assert got["jaccard_weighted"] == pytest.approx((0.5 + 2 / 3) / 2)


def test_sample_without_valid_target_is_skipped(spark):
    df = spark.createDataFrame([("a", 1.0, 3.0), ("a", 500.0, 0.0), ("b", 900.0, 1.0)], "s string, target double, pred double")
    got = one(metrics.regression_metrics(df, "s"))
    assert got["valid_rmse"] == 2.0 and got["valid_samples"] == 1


def test_loss_only_counts_masked_patches(spark):
    df = spark.createDataFrame([(1, [1.0, 1.0], [0.0, 0.0]), (0, [9.0, 9.0], [0.0, 0.0])], "masked int, vals array<double>, recon array<double>")
    assert one(metrics.masked_l1(df))["loss"] == 1.0


def test_epoch_and_step_series(spark):
    log = spark.createDataFrame([("train", "naip", 0, 1, "loss", 2.0), ("train", "linz", 0, 2, "loss", 4.0)], "phase string, platform string, epoch int, step bigint, name string, value double")
    got = {(r["series"], r["grain"], r["at"]): r["value"] for r in metrics.metric_rollup(log).collect()}
    assert got[("train/loss", "epoch", 0)] == 3.0
    assert got[("train_naip/loss", "epoch", 0)] == 2.0 and got[("train/loss", "step", 2)] == 4.0
    assert len(got) == 7


def test_radar_decibel_floor(spark):
    df = spark.createDataFrame([([[0.0, -1.0, 100.0]],)], "pixels array<array<double>>")
    got = one(df.select(px.sar_to_db(F.col("pixels"), F.lit("sentinel-1-rtc")).alias("p")))["p"][0]
    assert got == pytest.approx([-100.0, -100.0, 20.0])


def test_byte_cast_truncates_and_wraps(spark):
    df = spark.createDataFrame([([[1.9, 256.5, -1.2]],)], "pixels array<array<double>>")
    assert one(df.select(px.to_byte(F.col("pixels")).alias("p")))["p"][0] == [1, 0, 255]


def test_vector_helpers(spark):
    df = spark.createDataFrame([([1.0, 0.0, 2.0], [0.0, 1.0, 2.0])], "a array<double>, b array<double>")
    got = one(df.select(v.l2_distance("a", "b").alias("d"), v.cosine("a", "b").alias("c"), v.splice(F.col("a"), F.col("b"), 1).alias("s"), v.argmax("a").alias("m")))
    assert got["d"] == pytest.approx(math.sqrt(2)) and got["c"] == pytest.approx(0.8)
    assert got["s"] == [1.0, 1.0, 2.0] and got["m"] == 2


def test_level_needs_matching_groups(spark):
    df = spark.createDataFrame([("a", 0, [1.0])], "id string, token_idx int, vec array<double>")
    with pytest.raises(ValueError):
        tokens.reduce_level(df, "patch", ["id"], 7, groups=2, specials=2)


def test_names(spark):
    df = spark.createDataFrame([("s3://b/x/29SNB_20200101_0_1.tif", "MGRS-29SNB", "EPSG:32629")], "p string, g string, e string")
    got = one(df.select(names.stem(F.col("p")).alias("stem"), names.grid_code(F.col("g")).alias("g"), names.epsg_code(F.col("e")).alias("e"), names.tail_fields(names.stem(F.col("p")), 2).alias("t"), names.parent_name(F.col("p")).alias("d")))
    assert tuple(got) == ("29SNB_20200101_0_1", "29SNB", 32629, "0_1", "x")


def test_rollup_total(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "platform string")
    got = {r["platform"]: r["n_chips"] for r in agg.platform_counts(df).collect()}
    assert got == {"a": 2, "b": 1, None: 3}


@pytest.mark.parametrize("lon,lat,epsg,x,y", [(15.0, 0.0, 32633, 500000.0, 0.0), (9.0, 48.0, 32632, 500000.0, 5316300.0), (-70.0, -33.0, 32719, 406582.0, 6348185.0)])
def test_known_utm_points(spark, lon, lat, epsg, x, y):
    got = one(spark.range(1).select(*geo.reproject(F.lit(lon), F.lit(lat), 4326, epsg)))
    assert got[0] == pytest.approx(x, abs=200) and got[1] == pytest.approx(y, abs=400)


def test_wkb_of_a_box(spark):
    import struct

    df = spark.range(1).select(geo.box_wkb(geo.box(F.lit(-1.5), F.lit(0.0), F.lit(2.25), F.lit(1e-3))).alias("w"))
    raw = bytes(one(df)["w"])
    assert struct.unpack("<bIII", raw[:13]) == (1, 3, 1, 5)
    assert struct.unpack("<10d", raw[13:]) == (-1.5, 0.0, 2.25, 0.0, 2.25, 1e-3, -1.5, 1e-3, -1.5, 0.0)
