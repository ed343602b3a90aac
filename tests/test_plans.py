"""What the physical plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks.registry import ORACLES
from rasterloom.operators import quality, sampling

QUERIES = entry.queries()
# Queries that only declare a plan (the others run jobs while being built).
LAZY = [
    n for n in sorted(ORACLES)
    if not n.startswith(("x", "s3_", "s4_", "s6_", "s7_", "s8_", "s10_", "s12_", "p10_", "v3", "v4", "v5", "v6_index", "v10", "v12", "s11_search_places"))
]
PYTHON = {"a20_equalise_histogram", "v1_embed_chips", "e5_stack_table_function"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins_and_python_only_where_declared(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    if name not in PYTHON:
        assert "Python" not in text and "InArrow" not in text and "InPandas" not in text


def test_neighbour_search_does_not_cross_join(spark, sf):
    text = plan(QUERIES["v3_knn"](spark, sf))
    assert "NestedLoop" not in text and "Cartesian" not in text and "MapInArrow" in text
    assert "WindowGroupLimit" in text


def scenes(spark, path):
    df = spark.range(1000).select(
        F.col("id").cast("string").alias("item_id"),
        F.lit("c").alias("collection"),
        F.timestamp_seconds(F.col("id") * 86400).alias("dt"),
        (F.col("id") % 100).cast("double").alias("cloud_cover"),
        F.struct(*[F.lit(float(i)).alias(n) for i, n in enumerate(("xmin", "ymin", "xmax", "ymax"))]).alias("bbox"),
    )
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_catalog_filters_reach_the_scan(spark, tmp_path):
    found = sampling.catalog_search(scenes(spark, str(tmp_path / "s")), ["c"], (0, 0, 5, 5), "1970-02-01", "1971-01-01", 50)
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    text = plan(found)
    pushed = text[text.index("PushedFilters") :]
    for part in ("cloud_cover", "collection", "dt", "bbox.xmin", "bbox.ymax"):
        assert part in pushed


def test_cloud_filter_reaches_the_scan_and_prunes_columns(spark, tmp_path):
    df = quality.filter_cloud(scenes(spark, str(tmp_path / "s")), "<", 10).select("item_id")
    text = plan(df)
    assert "LessThan(cloud_cover,10.0)" in text
    assert "bbox" not in text[text.index("ReadSchema") :]


def test_heads_are_cut_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("dir"), F.col("id").cast("string").alias("name"))
    assert "WindowGroupLimit" in plan(sampling.head_per_group(df, "dir", "name", 5))


def test_best_rows_need_one_partial_aggregate(spark, sf):
    text = plan(QUERIES["w1_least_cloudy"](spark, sf))
    assert "partial_min" in text and "Window" not in text


@pytest.mark.parametrize("name", ["w2_random_years", "w16_mask_patches", "w17_augment", "c1_chip_raster", "c4_patchify", "f6_standardise", "v1_embed_chips"])
def test_row_wise_operators_do_not_shuffle_chips(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    # only the registry (tens of rows) may be exchanged
    shuffles = [line for line in text.splitlines() if "Exchange hashpartitioning" in line]
    assert all("platform" in line for line in shuffles)


def test_no_broadcast_is_forced_on_tables_that_grow():
    """Only the sensor registry (configuration) carries a hint; hot keys and cuts leave the choice to Spark."""
    import pathlib

    for name in ("skew.py", "ranking.py"):
        assert "broadcast(" not in (pathlib.Path(sampling.__file__).parents[1] / "plans" / name).read_text()


def test_polygon_filter_reads_its_area_once(spark, sf):
    found = QUERIES["p12_filter_by_polygon"](spark, sf)
    rows = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Filter" in line]
    assert rows and all("hex(" not in line and "subquery" in line for line in rows)
