"""Driver tables seen as chips, scenes, footprints and logs, in Spark and in SQL.

Each stand-in is plain arithmetic on keys over a whole table, so the Spark frame
and the SQL fragment of the same name hold the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import Tables
from rasterloom.functions import geo
from rasterloom.sources.registry import sensor_registry, sensor_rows

CHIP_PLATFORMS = [("naip", 4), ("linz", 3), ("sentinel-1-rtc", 2), ("satellogic-MSI-L1D", 4)]
SIDE = 4
CELLS = SIDE * SIDE


def registry(t: Tables) -> DataFrame:
    return sensor_registry(t.spark)


def _sql_value(v) -> str:
    if v is None:
        return "CAST(NULL AS INTEGER)"
    if isinstance(v, str):
        return f"'{v}'"
    return f"CAST({v!r} AS DOUBLE)" if isinstance(v, float) else str(v)


REGISTRY = (
    "(SELECT * FROM (VALUES "
    + ", ".join("(" + ", ".join(_sql_value(v) for v in row) + ")" for row in sensor_rows())
    + ") r(platform, band_idx, band, mean, std, wavelength_um, gsd, rgb_pos))"
)


def embeddings(t: Tables) -> DataFrame:
    return t("embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label"
    )


EMBEDDINGS = "(SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings)"
# One row per vector entry, 0-based position.
ENTRIES = (
    "(SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS v, "
    "generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"
)


def chips(t: Tables) -> DataFrame:
    """Every vector as a chip of 4x4 bands; platform (hence band count) by label."""
    value = F.transform("embedding", lambda v: v.cast("double") * 100)
    platform = F.when(F.lit(False), F.lit(""))
    bands = F.when(F.lit(False), F.lit(0))
    for i, (name, n) in enumerate(CHIP_PLATFORMS):
        platform = platform.when(F.col("label") % 4 == i, F.lit(name))
        bands = bands.when(F.col("label") % 4 == i, F.lit(n))
    return (
        t("embeddings")
        .withColumn("_v", value)
        .withColumn("_n", bands)
        .select(
            F.col("vec_id").alias("chip_id"),
            platform.alias("platform"),
            F.lit(SIDE).alias("h"),
            F.lit(SIDE).alias("w"),
            F.transform(
                F.sequence(F.lit(0), F.col("_n") - 1), lambda b: F.slice(F.col("_v"), b * CELLS + 1, CELLS)
            ).alias("pixels"),
        )
    )


_PLATFORM_CASE = "CASE label % 4 " + " ".join(
    f"WHEN {i} THEN '{n}'" for i, (n, _) in enumerate(CHIP_PLATFORMS)
) + " END"
_BANDS_CASE = "CASE label % 4 " + " ".join(
    f"WHEN {i} THEN {n}" for i, (_, n) in enumerate(CHIP_PLATFORMS)
) + " END"
# One row per chip pixel.
CHIP_PIXELS = (
    f"(SELECT vec_id AS chip_id, {_PLATFORM_CASE} AS platform, pos // {CELLS} AS band_idx, "
    f"pos % {CELLS} AS px, v * 100 AS v FROM {ENTRIES} WHERE pos // {CELLS} < {_BANDS_CASE})"
)
CHIPS = f"(SELECT vec_id AS chip_id, {_PLATFORM_CASE} AS platform, {_BANDS_CASE} AS n_bands FROM embeddings)"


def pixel_rows(df: DataFrame, keep: list[str], pixels: str = "pixels") -> DataFrame:
    """Long (band_idx, px, v) form of a chip table, for comparing."""
    bands = df.select(*keep, F.posexplode(pixels).alias("band_idx", "_band"))
    cells = bands.select(*keep, "band_idx", F.posexplode("_band").alias("px", "v"))
    return cells.select(
        *keep,
        F.col("band_idx").cast("bigint").alias("band_idx"),
        F.col("px").cast("bigint").alias("px"),
        F.round(F.col("v").cast("double"), 6).alias("v"),
    )


def vector_rows(df: DataFrame, keep: list[str], vec: str = "vec", digits: int = 6) -> DataFrame:
    return df.select(*keep, F.posexplode(vec).alias("pos", "v")).withColumn(
        "v", F.round(F.col("v").cast("double"), digits)
    )


def footprints(t: Tables) -> DataFrame:
    """25-wide grid of boxes of side 1.2, so neighbours overlap."""
    x = (F.col("vec_id") % 25) * 1.0
    y = F.floor(F.col("vec_id") / 25) * 1.0
    return t("embeddings").select("vec_id", geo.box(x, y, x + 1.2, y + 1.2).alias("bbox"))


FOOTPRINTS = (
    "(SELECT vec_id, (vec_id % 25) * 1.0::DOUBLE AS xmin, (vec_id // 25) * 1.0::DOUBLE AS ymin, "
    "(vec_id % 25) * 1.0::DOUBLE + 1.2::DOUBLE AS xmax, (vec_id // 25) * 1.0::DOUBLE + 1.2::DOUBLE AS ymax "
    "FROM embeddings)"
)


def points(t: Tables) -> DataFrame:
    return t("customer").select(
        F.col("c_custkey").alias("point_id"),
        ((F.col("c_custkey") * 37 % 2500) / 100.0).alias("lon"),
        ((F.col("c_custkey") * 91 % 2000) / 100.0).alias("lat"),
        (F.col("c_mktsegment") == "BUILDING").cast("int").alias("class"),
    )


POINTS = (
    "(SELECT c_custkey AS point_id, (c_custkey * 37 % 2500) / 100.0::DOUBLE AS lon, "
    "(c_custkey * 91 % 2000) / 100.0::DOUBLE AS lat, CAST(c_mktsegment = 'BUILDING' AS INTEGER) AS class "
    "FROM customer)"
)


def scenes(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    x = (key * 37 % 3600) / 10.0 - 180
    y = (key * 53 % 1600) / 10.0 - 80
    return t("orders").select(
        key.alias("item_id"),
        (F.col("o_custkey") % 50).alias("tile"),
        F.col("o_orderdate").alias("dt"),
        (F.floor("o_totalprice") % 100).cast("double").alias("cloud_cover"),
        F.col("o_orderpriority").alias("collection"),
        geo.box(x, y, x + 1, y + 1).alias("bbox"),
    )


SCENES = (
    "(SELECT o_orderkey AS item_id, o_custkey % 50 AS tile, o_orderdate AS dt, "
    "CAST(CAST(floor(o_totalprice) AS BIGINT) % 100 AS DOUBLE) AS cloud_cover, o_orderpriority AS collection, "
    "(o_orderkey * 37 % 3600) / 10.0::DOUBLE - 180 AS xmin, (o_orderkey * 53 % 1600) / 10.0::DOUBLE - 80 AS ymin, "
    "(o_orderkey * 37 % 3600) / 10.0::DOUBLE - 180 + 1 AS xmax, (o_orderkey * 53 % 1600) / 10.0::DOUBLE - 80 + 1 AS ymax "
    "FROM orders)"
)


def radar_scenes(t: Tables) -> DataFrame:
    """One radar scene per (order, line); coverage in percent of the tile."""
    return (
        t("lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(
            (F.min("l_suppkey") % 50).alias("tile"),
            F.min("l_shipdate").alias("dt"),
            (20 + 10 * (F.min("l_partkey") % 6)).alias("coverage"),
        )
        .select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sar_id"), "tile", "dt", "coverage")
    )


RADAR_SCENES = (
    "(SELECT l_orderkey * 10 + l_linenumber AS sar_id, min(l_suppkey) % 50 AS tile, min(l_shipdate) AS dt, "
    "20 + 10 * (min(l_partkey) % 6) AS coverage FROM lineitem GROUP BY l_orderkey, l_linenumber)"
)


def landcover(t: Tables) -> DataFrame:
    return t("lineitem").select(
        (F.col("l_orderkey") % 2000).alias("tile"),
        (F.col("l_partkey") % 11).alias("class"),
        F.col("l_quantity").cast("bigint").alias("px"),
    )


LANDCOVER = (
    "(SELECT l_orderkey % 2000 AS tile, l_partkey % 11 AS class, CAST(l_quantity AS BIGINT) AS px FROM lineitem)"
)


def features(t: Tables) -> DataFrame:
    """Monthly band values; a discount of 0 stands for nodata."""
    return t("lineitem").select(
        F.col("l_suppkey").alias("tile"),
        F.col("l_linenumber").alias("band_idx"),
        F.month("l_shipdate").alias("month"),
        F.col("l_partkey").alias("px"),
        F.when(F.col("l_discount") != 0, F.col("l_quantity")).alias("value"),
    )


FEATURES = (
    "(SELECT l_suppkey AS tile, l_linenumber AS band_idx, month(l_shipdate) AS month, l_partkey AS px, "
    "CASE WHEN l_discount <> 0 THEN l_quantity END AS value FROM lineitem)"
)


def stream_chips(t: Tables) -> DataFrame:
    """Chip keys by platform."""
    return t("events").select(F.col("event_id").alias("chip_id"), F.col("event_type").alias("platform"))


STREAM_CHIPS = "(SELECT event_id AS chip_id, event_type AS platform FROM events)"


def metric_log(t: Tables) -> DataFrame:
    return t("events").select(
        "ts",
        F.when(F.col("event_id") % 5 == 0, "val").otherwise("train").alias("phase"),
        F.col("event_type").alias("platform"),
        (F.col("event_id") % 4).cast("int").alias("epoch"),
        F.col("event_id").alias("step"),
        F.when(F.col("user_id") % 3 == 0, "loss")
        .when(F.col("user_id") % 3 == 1, "rec_loss")
        .otherwise("rep_loss")
        .alias("name"),
        "value",
    )


METRIC_LOG = (
    "(SELECT ts, CASE WHEN event_id % 5 = 0 THEN 'val' ELSE 'train' END AS phase, event_type AS platform, "
    "CAST(event_id % 4 AS INTEGER) AS epoch, event_id AS step, CASE user_id % 3 WHEN 0 THEN 'loss' WHEN 1 THEN "
    "'rec_loss' ELSE 'rep_loss' END AS name, value FROM events)"
)
