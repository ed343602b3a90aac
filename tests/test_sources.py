"""Files on disk: stacks, arrays, points, tables, registry, encoders."""

import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators.bands import attach_band_meta
from rasterloom.operators.embed import OnnxEncoder, PatchMeanEncoder, embed_chips
from rasterloom.compose import compose
from rasterloom.sources import chips, tables
from rasterloom.sources.registry import add_sensor, sensor_registry

RNG = np.random.default_rng(0)


def save_stack(path, n=128, c=2, side=8, **arrays):
    pixels = RNG.normal(size=(n, c, side, side)).astype(np.float32)
    pairs = {k: RNG.normal(size=(n, 2)).astype(np.float32) for k in ("week_norm", "hour_norm", "lat_norm", "lon_norm")}
    path.parent.mkdir(parents=True, exist_ok=True)
    np.savez(path, **{"pixels": pixels, **pairs, **arrays})
    return pixels, pairs


def test_stack_scan_decodes_every_chip(spark, tmp_path):
    pixels, pairs = save_stack(tmp_path / "sub" / "sentinel-1-rtc" / "cube_0.npz")
    save_stack(tmp_path / "naip" / "cube_1.npz", c=4)
    got = chips.scan_chip_stacks(spark, str(tmp_path))
    assert got.groupBy("platform").count().orderBy("platform").collect() == [("naip", 128), ("sentinel-1-rtc", 128)]
    row = got.filter("platform = 'sentinel-1-rtc' AND chip_idx = 77").collect()[0]
    assert np.allclose(np.array(row["pixels"]).reshape(2, 8, 8), pixels[77])
    assert np.allclose(row["time"], np.hstack([pairs["week_norm"][77], pairs["hour_norm"][77]]))
    assert np.allclose(row["latlon"], np.hstack([pairs["lat_norm"][77], pairs["lon_norm"][77]]))


def test_listing_is_sorted_and_reads_no_content(spark, tmp_path):
    for i in (3, 1, 2):
        save_stack(tmp_path / "naip" / f"cube_{i}.npz", n=1)
    listing = chips.stack_listing(spark, str(tmp_path))
    assert [r["path"][-10:] for r in listing.collect()] == ["cube_1.npz", "cube_2.npz", "cube_3.npz"]
    assert "content" not in listing.columns


def test_many_small_files_share_few_tasks(spark, tmp_path):
    for i in range(1000):
        (tmp_path / f"{i}.npz").write_bytes(b"not a zip")
    checked = chips.chip_qa(chips.stack_files(spark, str(tmp_path)))
    assert checked.rdd.getNumPartitions() <= chips.TASKS_PER_CORE * spark.sparkContext.defaultParallelism < 1000 // 32
    assert [tuple(r) for r in checked.groupBy("status").count().collect()] == [("unreadable", 1000)]


@pytest.mark.parametrize("most", [0, 1, 256])
def test_tasks_list_what_spark_lists(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(chips, "FOLDERS", most)
    root = tmp_path / "a folder%20"
    for name in ("x/y/1.npz", "x/a b#%41.npz", "x/2.npy", "k=1/_k=2/3.npz", "_no/4.npz", ".no/5.npz", "x/_6.npz", "x/.7.npz", "x/8.npz._COPYING_", "\u00e9/9.npz", "0.npz"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(name.encode() * 3)
    (root / "x" / "empty.npz").write_bytes(b"")
    (root / "none").mkdir()
    (root / "x" / "link.npz").symlink_to(root / "0.npz")
    (root / "x" / "gone.npz").symlink_to(root / "nowhere")
    want = sorted(tuple(r) for r in chips._spark_files(spark, str(root), "*.npz").collect())
    assert len(want) == 6
    for given in (str(root), f"file://{root}/", f"file:{root}"):
        got = chips.stack_files(spark, given)
        assert sorted(tuple(r) for r in got.collect()) == want
        assert "binaryFile" not in got._jdf.queryExecution().toString()  # whose listing the driver holds
    assert [r["path"] for r in chips.stack_listing(spark, str(root)).collect()] == sorted(r[0] for r in want)
    one = chips.stack_files(spark, f"{root}/x/*/1.npz".replace("%", "?"))  # patterns are left to Spark
    assert [r["length"] for r in one.collect()] == [27]
    assert chips.stack_files(spark, str(root / "none")).collect() == []


def test_checked_files_are_read_once(spark, tmp_path):
    (tmp_path / "1.npz").write_bytes(b"not a zip")
    valid, quarantine = chips.split_by_qa(chips.chip_qa(chips.stack_files(spark, str(tmp_path))))
    (tmp_path / "1.npz").unlink()
    assert (valid.count(), quarantine.count()) == (0, 1)


def test_files_are_joined_in_order_of_their_names(spark, tmp_path):
    (tmp_path / "parts").mkdir()
    for name, content in (("b", b"two" * 5), ("a", b"one"), ("c", b"")):
        (tmp_path / "parts" / name).write_bytes(content)
    chips.join_files(spark, str(tmp_path / "parts"), str(tmp_path / "out" / "all.txt"), b"[", b", ", b"]")
    assert (tmp_path / "out" / "all.txt").read_bytes() == b"[one, twotwotwotwotwo, ]"
    chips.join_files(spark, str(tmp_path / "none"), f"file://{tmp_path}/out/nothing.txt", b"[", b", ", b"]")
    assert {f.name for f in (tmp_path / "out").iterdir()} == {"all.txt", "nothing.txt"} and (tmp_path / "out" / "nothing.txt").read_bytes() == b"[]"


def test_quality_statuses_and_nothing_deleted(spark, tmp_path):
    save_stack(tmp_path / "p" / "good.npz")
    save_stack(tmp_path / "p" / "short.npz", n=5)
    np.savez(tmp_path / "p" / "other.npz", labels=np.zeros(3))
    (tmp_path / "p" / "junk.npz").write_bytes(b"not a zip")
    whole = (tmp_path / "p" / "good.npz").read_bytes()
    (tmp_path / "p" / "cut.npz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "p" / "empty.npz").write_bytes(b"")
    checked = chips.chip_qa(chips.stack_files(spark, str(tmp_path)))
    got = {r["path"].rsplit("/", 1)[1]: r["status"] for r in checked.collect()}
    assert got == {
        "good.npz": "valid", "short.npz": "wrong_first_dim", "other.npz": "missing_pixels",
        "junk.npz": "unreadable", "cut.npz": "unreadable",
    }  # Spark's file listing skips zero-byte files
    valid, quarantine = chips.split_by_qa(checked)
    assert valid.count() == 1 and quarantine.count() == 4
    assert len(list((tmp_path / "p").iterdir())) == 6


def test_array_files(spark, tmp_path):
    chip, label = RNG.normal(size=(3, 4, 5)).astype(np.float32), np.arange(20).reshape(4, 5)
    np.save(tmp_path / "x_naip-new_chip_0.npy", chip)
    np.save(tmp_path / "x_lc_chip_0.npy", label)
    rows = {r["path"].rsplit("/", 1)[1]: r for r in chips.scan_chip_arrays(spark, str(tmp_path)).collect()}
    assert np.allclose(np.array(rows["x_naip-new_chip_0.npy"]["pixels"]).reshape(3, 4, 5), chip)
    assert rows["x_lc_chip_0.npy"]["pixels"] == [list(map(float, range(20)))]
    assert (rows["x_lc_chip_0.npy"]["h"], rows["x_lc_chip_0.npy"]["w"]) == (4, 5)


def test_table_function(spark):
    buffer = io.BytesIO()
    np.savez(buffer, pixels=np.arange(12, dtype=np.float32).reshape(3, 1, 2, 2))
    spark.udtf.register("decode_stack", chips.stack_table_function())
    spark.createDataFrame([(bytearray(buffer.getvalue()),)], "content binary").createOrReplaceTempView("stack_bytes")
    got = spark.sql("SELECT d.* FROM stack_bytes, LATERAL decode_stack(content) d ORDER BY chip_idx").collect()
    assert [r["pixels"][0] for r in got] == [[0.0, 1.0, 2.0, 3.0], [4.0, 5.0, 6.0, 7.0], [8.0, 9.0, 10.0, 11.0]]


def test_geojson_points(spark, tmp_path):
    def feature(kind, xy, cls):
        return {"type": "Feature", "properties": {"class": cls}, "geometry": {"type": kind, "coordinates": xy}}

    doc = {"type": "FeatureCollection", "features": [feature("Point", [1.5, 2.5], 1), feature("Point", [3, 4], 0)]}
    (tmp_path / "points.geojson").write_text(json.dumps(doc, indent=2))
    got = tables.scan_geojson_points(spark, str(tmp_path / "points.geojson")).collect()
    assert [tuple(r) for r in got] == [(1, 1.5, 2.5), (0, 3.0, 4.0)]


def test_embedding_files_carry_their_names(spark, tmp_path):
    df = spark.createDataFrame([("s3://b/29SNB_20200101_v001.tif", "2020-05-06", [1.0])], "source_url string, d string, vec array<float>")
    df = df.select("source_url", F.to_date("d").alias("dt"), "vec")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    part = next((tmp_path / "e").glob("*.parquet"))
    part.rename(tmp_path / "29SNB_scene_3_7.parquet")
    row = tables.scan_embeddings(spark, str(tmp_path / "29SNB_scene_3_7.parquet")).collect()[0]
    assert (row["tile"], row["idx"], row["year"]) == ("29SNB", "3_7", 2020)


def test_hot_tile_is_split_and_small_tiles_are_not(spark, tmp_path):
    tile = F.when(F.col("id") % 3 == 0, F.concat(F.lit("T"), F.col("id") % 30)).otherwise("hot")
    df = spark.range(0, 60000, 1, 16).select(tile.alias("tile"), F.col("id").alias("vec_id"), F.rand(1).alias("v"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    try:
        tables.write_embeddings(df, str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = lambda t: len(list((tmp_path / "out" / f"tile={t}").glob("*.parquet")))
    assert files("hot") > 1 and files("T3") <= 2
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60000


def test_replace_and_drop_table(spark):
    tables.drop_table(spark, "not_there")
    tables.replace_table(spark.range(3), "numbers")
    tables.replace_table(spark.range(5), "numbers")
    assert spark.table("numbers").count() == 5
    tables.drop_table(spark, "numbers")
    assert not spark.catalog.tableExists("numbers")


def test_registry_shape(spark):
    reg = sensor_registry(spark)
    assert reg.count() == 50
    counts = {r["platform"]: r["count"] for r in reg.groupBy("platform").count().collect()}
    assert counts["sentinel-2-l2a"] == 10 and counts["sentinel-1-rtc"] == 2 and len(counts) == 9
    rgb = reg.filter("platform = 'modis' AND rgb_pos IS NOT NULL").orderBy("rgb_pos").collect()
    assert [r["band_idx"] for r in rgb] == [0, 3, 2]


SPEC = {"band_order": ["a", "b"], "gsd": 3, "bands": {"mean": {"a": 1, "b": 2}, "std": {"a": 1, "b": 1}, "wavelength": {"a": 0.4, "b": 0.5}}}


def test_registry_from_yaml(spark, tmp_path):
    import yaml

    (tmp_path / "m.yaml").write_text(yaml.safe_dump({"mine": {**SPEC, "rgb_indices": [1, 0, 0]}}))
    rows = sensor_registry(spark, str(tmp_path / "m.yaml")).collect()
    assert [(r["band"], r["gsd"]) for r in rows] == [("a", 3.0), ("b", 3.0)]


def test_new_sensor_is_validated(spark):
    reg = sensor_registry(spark)
    assert add_sensor(reg, "mine", SPEC).count() == 52
    broken = {**SPEC, "bands": {**SPEC["bands"], "std": {"a": 1}}}
    with pytest.raises(ValueError):
        add_sensor(reg, "mine", broken)
    with pytest.raises(ValueError):
        add_sensor(reg, "naip", SPEC)


def chip_rows(spark):
    rows = [(i, p, 4, 4, [[float(i + b)] * 16 for b in range(n)]) for i in range(40) for p, n in [("naip", 4), ("linz", 3)]]
    return spark.createDataFrame(rows, "chip_id int, platform string, h int, w int, pixels array<array<double>>")


def test_encoder_sees_one_platform_at_a_time(spark):
    def count_bands(pixels, time, latlon, waves, gsd):
        assert pixels.shape[1] == len(waves) and len(pixels) <= 8
        return np.full((len(pixels), 2), [len(waves), gsd])

    got = embed_chips(chip_rows(spark), sensor_registry(spark), count_bands, ["chip_id", "platform"], batch=8)
    assert {(r["platform"], *r["vec"]) for r in got.collect()} == {("naip", 4.0, 1.0), ("linz", 3.0, 0.5)}
    assert got.count() == 80


def test_chip_gsd_overrides_the_registry(spark):
    df = chip_rows(spark).withColumn("gsd", F.when(F.col("chip_id") == 0, F.lit(0.6)))
    got = attach_band_meta(df.filter("platform = 'naip'"), sensor_registry(spark)).filter("chip_id < 2").orderBy("chip_id")
    assert [r["gsd"] for r in got.collect()] == [0.6, 1.0]


def test_onnx_encoder_plugs_in(spark):
    onnxruntime = pytest.importorskip("onnxruntime")
    from onnxruntime.datasets import get_example

    path = get_example("logreg_iris.onnx")
    name = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"]).get_inputs()[0]
    n, width = name.shape
    rows = [(i, "sentinel-1-rtc", 1, 1, [[float(i)], [1.0]]) for i in range(3)]
    df = spark.createDataFrame(rows, "chip_id int, platform string, h int, w int, pixels array<array<double>>").coalesce(1)
    assert width == 2 and n in (3, None)
    got = embed_chips(df, sensor_registry(spark), OnnxEncoder(path, {name.name: "flat"}), ["chip_id"], batch=3)
    assert got.count() == 3


def test_default_encoder_depends_on_time_and_place(spark):
    df = chip_rows(spark).filter("chip_id = 3 AND platform = 'naip'")
    here = df.withColumn("latlon", F.array(*[F.lit(1.0)] * 4))
    a, b = (embed_chips(d, sensor_registry(spark), PatchMeanEncoder(8), ["chip_id"]).collect()[0]["vec"] for d in (df, here))
    assert len(a) == 8 and np.allclose(np.array(b) - np.array(a), [0, 0, 0, 0, 0.01, 0.01, 0.01, 0.01])


def test_compose_chains_transforms(spark):
    run = compose(lambda d: d.filter("id > 1"), lambda d: d.withColumn("twice", F.col("id") * 2))
    assert [r["twice"] for r in run(spark.range(4)).collect()] == [4, 6]


def test_lenient_scan_lists_broken_files(spark, tmp_path):
    (tmp_path / "naip").mkdir()
    np.savez(tmp_path / "naip" / "cube_0.npz", pixels=np.ones((2, 1, 2, 2), np.float32))
    np.savez(tmp_path / "naip" / "cube_1.npz", labels=np.ones(3))
    (tmp_path / "naip" / "cube_2.npz").write_bytes(b"junk")
    good, broken = chips.split_decoded(chips.scan_chip_stacks(spark, str(tmp_path), lenient=True))
    assert good.count() == 2
    assert sorted((r.path.rsplit("/", 1)[1], r.platform) for r in broken.collect()) == [("cube_1.npz", "naip"), ("cube_2.npz", "naip")]
