"""Tables updated by key, and the streams that write them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.operators.embed import PatchMeanEncoder
from rasterloom.sources import keyed
from rasterloom.sources.registry import sensor_registry
from rasterloom.streaming import jobs

SCHEMA = "k long, version int, v string"


def put(spark, path, rows, **kw):
    return keyed.upsert(spark.createDataFrame(rows, SCHEMA), path, "k", **kw)


def held(spark, path):
    return sorted(map(tuple, keyed.read_keyed(spark, path, SCHEMA).collect()))


def test_batches_equal_a_dictionary(spark, tmp_path):
    rng, path, want = np.random.default_rng(2), str(tmp_path / "t"), {}
    for batch in range(6):
        rows = [(int(k), batch, f"{batch}-{i}") for i, k in enumerate(rng.choice(60, 15, replace=False))]
        put(spark, path, rows, buckets=4, bits=256, batch=batch)
        want |= {k: (k, b, v) for k, b, v in rows}
        assert held(spark, path) == sorted(want.values())


def test_the_order_column_decides_not_the_arrival(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, path, [(1, 5, "new"), (2, 1, "old"), (3, None, "unknown")], order=["version"])
    put(spark, path, [(1, 4, "late"), (2, 2, "newer"), (2, 1, "again"), (3, 0, "known")], order=["version"])
    assert held(spark, path) == [(1, 5, "new"), (2, 2, "newer"), (3, 0, "known")]


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, path, [(1, 1, "a")], batch=7)
    put(spark, path, [(1, 2, "b")], batch=8)
    assert put(spark, path, [(1, 1, "a"), (9, 9, "z")], batch=7) == [] and put(spark, path, [(1, 3, "c")], batch=8) == []
    assert held(spark, path) == [(1, 2, "b")]


def test_a_died_attempt_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, path, [(1, 1, "a")])
    # data of an attempt that never came to its listing
    spark.createDataFrame([(2, 1, "lost", 0)], SCHEMA + ", bucket int").write.partitionBy("bucket").parquet(f"{path}/data/00000002-dead")
    put(spark, path, [(3, 1, "c")])
    assert held(spark, path) == [(1, 1, "a"), (3, 1, "c")]


def test_only_buckets_with_a_known_key_are_read(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, path, [(k, 1, "a") for k in range(200)], buckets=16)
    listing, _ = keyed._latest(spark, path)
    own = spark.createDataFrame([(5,)], "k long").select(keyed.bucket_of("k", 16).alias("b")).first().b
    assert put(spark, path, [(5, 2, "b")]) == [own]  # merged: the one bucket that holds the key
    assert put(spark, path, [(10**6, 1, "n")]) == []  # a new key: its bucket gets a folder and is not read
    after, _ = keyed._latest(spark, path)
    assert {b for b in listing.folders if after.folders[b] != listing.folders[b]} <= {own, *[b for b, f in after.folders.items() if len(f) > 1]}
    files = keyed.lookup(spark, path, spark.createDataFrame([(5,)], "k long"), "k", SCHEMA).inputFiles()
    assert files and all(f"bucket={own}/" in f for f in files)
    assert keyed.lookup(spark, path, spark.createDataFrame([(777_777,)], "k long"), "k", SCHEMA).inputFiles() == []


def test_readers_of_an_earlier_version_keep_it(spark, tmp_path):
    path = str(tmp_path / "t")
    put(spark, path, [(1, 1, "a")])
    before = keyed.read_keyed(spark, path, SCHEMA)
    put(spark, path, [(1, 2, "b")])
    assert [r.v for r in before.collect()] == ["a"] and held(spark, path) == [(1, 2, "b")]


def test_many_folders_are_merged(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(keyed.FOLDERS + 2):
        put(spark, path, [(i, 1, "x")], buckets=1)
    listing, _ = keyed._latest(spark, path)
    assert len(listing.folders[0]) <= keyed.FOLDERS and len(held(spark, path)) == keyed.FOLDERS + 2


def test_null_keys_are_refused_and_empty_batches_pass(spark, tmp_path):
    path = str(tmp_path / "t")
    assert put(spark, path, []) == [] and held(spark, path) == []
    with pytest.raises(ValueError, match="without k"):
        put(spark, path, [(None, 1, "x")])


CHIPS = "chip_id int, platform string, h int, w int, pixels array<array<double>>"


def counting(folder):
    """Embeds with the mean patch and leaves a mark per chip it was asked for (a closure, so that workers need not import the tests)."""
    inner, folder = PatchMeanEncoder(4), str(folder)

    def encode(pixels, time, latlon, waves, gsd):
        import pathlib
        import uuid

        for p in pixels:
            (pathlib.Path(folder) / f"{int(p.flat[0])}-{uuid.uuid4().hex}").touch()
        return inner(pixels, time, latlon, waves, gsd)

    return encode


def test_new_versions_are_embedded_and_known_ones_are_not(spark, tmp_path):
    source, out, ckpt = (str(tmp_path / n) for n in ("chips", "vectors", "ckpt"))
    marks = tmp_path / "marks"
    marks.mkdir()

    def deliver(values):
        rows = [(i, "linz", 2, 2, [[float(v)] * 4] * 3) for i, v in values]
        frame = spark.createDataFrame(rows, CHIPS)
        frame.coalesce(1).write.mode("append").parquet(source)
        for f in marks.iterdir():
            f.unlink()
        live = spark.readStream.schema(CHIPS).parquet(source)
        jobs.stream_embed(live, sensor_registry(spark), counting(marks), out, ckpt).awaitTermination()
        table = keyed.read_keyed(spark, out, jobs.embedded_schema(frame))
        return {r.chip_id: [round(x, 6) for x in r.vec] for r in table.collect()}, sorted(f.name.split("-")[0] for f in marks.iterdir())

    first, asked = deliver([(1, 10), (2, 20), (2, 20)])
    assert set(first) == {1, 2} and asked == ["10", "20"]
    second, asked = deliver([(2, 20), (3, 30), (1, 11)])
    assert set(second) == {1, 2, 3} and asked == ["11", "30"]
    assert second[2] == first[2] and second[1] != first[1]


def test_a_restarted_stream_changes_nothing(spark, tmp_path):
    source, out, ckpt = (str(tmp_path / n) for n in ("chips", "vectors", "ckpt"))
    frame = spark.createDataFrame([(i, "linz", 2, 2, [[float(i)] * 4] * 3) for i in range(6)], CHIPS)
    frame.write.parquet(source)
    versions = []
    for _ in range(2):
        live = spark.readStream.schema(CHIPS).parquet(source)
        jobs.stream_embed(live, sensor_registry(spark), PatchMeanEncoder(4), out, ckpt).awaitTermination()
        versions.append(keyed._latest(spark, out)[0])
    assert versions[0] == versions[1] and keyed.read_keyed(spark, out, jobs.embedded_schema(frame)).count() == 6
