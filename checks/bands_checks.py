"""Sensor registry, band selection and pixel arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import standins as s
from checks.registry import check
from rasterloom.compose import compose
from rasterloom.functions import pixels as px
from rasterloom.operators import bands
from rasterloom.sources.registry import add_sensor

REG, PIX, CHIPS = s.REGISTRY, s.CHIP_PIXELS, s.CHIPS

USER_SENSOR = {
    "band_order": ["red", "pan"],
    "rgb_indices": [0],
    "gsd": 2.5,
    "bands": {
        "mean": {"red": 100.0, "pan": 200.0},
        "std": {"red": 10.0, "pan": 20.0},
        "wavelength": {"red": 0.65, "pan": 0.7},
    },
}


@check(
    "s1_sensor_registry",
    f"""
    SELECT c.chip_id, c.platform, r.band_idx, r.band, r.mean, r.std, r.wavelength_um, r.gsd, coalesce(r.rgb_pos, -1) AS rgb_pos
    FROM {CHIPS} c JOIN {REG} r ON c.platform = r.platform
    """,
)
def _(t):
    chips = s.chips(t).select("chip_id", "platform")
    return chips.join(F.broadcast(s.registry(t)), "platform").withColumn(
        "rgb_pos", F.coalesce("rgb_pos", F.lit(-1))
    )


@check(
    "s2_add_sensor",
    f"""
    WITH reg AS (SELECT platform, band_idx, wavelength_um, gsd FROM {REG}
      UNION ALL VALUES ('user-sensor', 0, 0.65::DOUBLE, 2.5::DOUBLE), ('user-sensor', 1, 0.7::DOUBLE, 2.5::DOUBLE)),
    chips AS (SELECT vec_id, CASE WHEN label % 4 = 1 THEN 'user-sensor' ELSE 'naip' END AS platform FROM embeddings)
    SELECT vec_id, reg.platform, band_idx, wavelength_um, gsd FROM chips JOIN reg USING (platform)
    """,
)
def _(t):
    reg = add_sensor(s.registry(t), "user-sensor", USER_SENSOR)
    chips = t("embeddings").select(
        "vec_id", F.when(F.col("label") % 4 == 1, "user-sensor").otherwise("naip").alias("platform")
    )
    return chips.join(F.broadcast(reg), "platform").select(
        "vec_id", "platform", "band_idx", "wavelength_um", "gsd"
    )


_NAMES = ["blue", "red"]


@check(
    "p1_select_bands",
    f"""
    WITH wanted AS (SELECT * FROM (VALUES (0, 'blue'), (1, 'red')) w(out_idx, band))
    SELECT p.chip_id, p.platform, CAST(w.out_idx AS BIGINT) AS band_idx, p.px, round(p.v, 6) AS v, r.mean, r.std
    FROM {PIX} p JOIN {REG} r ON r.platform = p.platform AND r.band_idx = p.band_idx
    JOIN wanted w ON w.band = r.band
    """,
)
def _(t):
    chips = bands.select_bands(s.chips(t), s.registry(t), _NAMES)
    long = s.pixel_rows(chips, ["chip_id", "platform", "mean", "std"])
    return long.withColumn("mean", F.get("mean", F.col("band_idx").cast("int"))).withColumn("std", F.get("std", F.col("band_idx").cast("int")))


@check(
    "p2_select_rgb",
    f"""
    SELECT p.chip_id, p.platform, r.rgb_pos AS band_idx, p.px, round(p.v, 6) AS v
    FROM {PIX} p JOIN {REG} r ON r.platform = p.platform AND r.band_idx = p.band_idx
    WHERE p.platform <> 'sentinel-1-rtc' AND r.rgb_pos IS NOT NULL
    UNION ALL
    SELECT chip_id, platform, band_idx, px, round(v, 6) FROM {PIX} WHERE platform = 'sentinel-1-rtc'
    UNION ALL
    SELECT chip_id, platform, 2, px, round((max(v) FILTER (WHERE band_idx = 0) + max(v) FILTER (WHERE band_idx = 1)) / 2, 6)
    FROM {PIX} WHERE platform = 'sentinel-1-rtc' GROUP BY chip_id, platform, px
    """,
)
def _(t):
    return s.pixel_rows(bands.select_rgb(s.chips(t), s.registry(t)), ["chip_id", "platform"])


@check(
    "p3_attach_band_meta",
    f"""
    SELECT c.chip_id, c.platform, r.gsd, r.band_idx AS pos, round(r.wavelength_um, 6) AS v
    FROM {CHIPS} c JOIN {REG} r ON c.platform = r.platform
    """,
)
def _(t):
    with_meta = bands.attach_band_meta(s.chips(t).select("chip_id", "platform"), s.registry(t))
    return s.vector_rows(with_meta, ["chip_id", "platform", "gsd"], "waves")


@check(
    "p4_sensor_summary",
    f"""
    WITH cat AS (SELECT * FROM (VALUES
      ('Multispectral Satellites', 'sentinel-2-l2a'), ('Multispectral Satellites', 'landsat-c2l1'),
      ('Multispectral Satellites', 'landsat-c2l2-sr'), ('Commercial High-Resolution', 'planetscope-sr'),
      ('Aerial Imagery', 'naip'), ('Aerial Imagery', 'linz'), ('Radar', 'sentinel-1-rtc'),
      ('Global Monitoring', 'modis')) v(category, platform)),
    reg AS (SELECT platform, CAST(count(*) AS INTEGER) AS n_bands, min(gsd) AS gsd FROM {REG} GROUP BY platform)
    SELECT category, platform, reg.n_bands, gsd, count(*) AS n_chips
    FROM {CHIPS} JOIN cat USING (platform) JOIN reg USING (platform) GROUP BY ALL
    """,
)
def _(t):
    return bands.sensor_summary(s.chips(t), s.registry(t))


_GROUPS = "VALUES ('rgb','red',0),('rgb','green',1),('rgb','blue',2),('rededge','rededge1',0),('rededge','rededge2',1),('rededge','rededge3',2),('rededge','nir08',3),('nir','nir',0),('swir','swir16',0),('swir','swir22',1),('sar','vv',0),('sar','vh',1),('scl','scl',0)"


@check(
    "p5_select_band_groups",
    f"""
    WITH g AS (SELECT * FROM ({_GROUPS}) v(band_group, band, ord)),
    used AS (SELECT r.platform, g.band_group, r.band_idx AS src, r.mean, r.std,
             row_number() OVER (PARTITION BY r.platform, g.band_group ORDER BY ord) - 1 AS band_idx
             FROM {REG} r JOIN g USING (band))
    SELECT p.chip_id, p.platform, u.band_group, u.band_idx, u.src, u.mean, u.std, p.px, round(p.v, 6) AS v
    FROM {PIX} p JOIN used u ON u.platform = p.platform AND u.src = p.band_idx
    """,
)
def _(t):
    groups = bands.select_band_groups(s.chips(t), s.registry(t))
    long = s.pixel_rows(groups, ["chip_id", "platform", "band_group", "group_idx", "mean", "std"])
    return long.select(
        "chip_id",
        "platform",
        "band_group",
        "band_idx",
        F.get("group_idx", F.col("band_idx").cast("int")).alias("src"),
        F.get("mean", F.col("band_idx").cast("int")).alias("mean"),
        F.get("std", F.col("band_idx").cast("int")).alias("std"),
        "px",
        "v",
    )


_DB = "CASE WHEN platform = 'sentinel-1-rtc' THEN 10 * log10(CASE WHEN v <= 0 THEN 1e-10 ELSE v END) ELSE v END"


@check(
    "p7_sar_to_db",
    f"SELECT chip_id, platform, band_idx, px, round({_DB}, 6) AS v FROM {PIX}",
)
def _(t):
    decibel = s.chips(t).withColumn("pixels", px.sar_to_db(F.col("pixels"), F.col("platform")))
    return s.pixel_rows(decibel, ["chip_id", "platform"])


@check(
    "f6_standardise",
    f"""
    SELECT p.chip_id, p.platform, p.band_idx, p.px, round(({_DB.replace("platform", "p.platform")} - r.mean) / r.std, 6) AS v
    FROM {PIX} p JOIN {REG} r ON r.platform = p.platform AND r.band_idx = p.band_idx
    """,
)
def _(t):
    return s.pixel_rows(bands.standardise_chips(s.chips(t), s.registry(t)), ["chip_id", "platform"])


@check(
    "e1_transform_pipeline",
    f"""
    SELECT p.chip_id, p.platform, p.band_idx, p.px, round(least(2.0::DOUBLE, greatest(-2.0::DOUBLE, (p.v - r.mean) / r.std)), 6) AS v
    FROM {PIX} p JOIN {REG} r ON r.platform = p.platform AND r.band_idx = p.band_idx WHERE p.platform <> 'sentinel-1-rtc'
    """,
)
def _(t):
    """Filter, standardise and clip as one transform."""
    steps = compose(
        lambda d: d.where(F.col("platform") != "sentinel-1-rtc"),
        lambda d: bands.standardise_chips(d, s.registry(t)),
        lambda d: d.withColumn("pixels", F.transform("pixels", lambda b: F.transform(b, lambda v: F.least(F.lit(2.0), F.greatest(F.lit(-2.0), v))))),
    )
    return s.pixel_rows(steps(s.chips(t)), ["chip_id", "platform"])


@check(
    "f7_destandardise",
    f"""
    WITH b AS (SELECT p.chip_id, p.platform, p.band_idx, p.px, p.v * r.std + r.mean AS x
      FROM {PIX} p JOIN {REG} r ON r.platform = p.platform AND r.band_idx = p.band_idx)
    SELECT chip_id, platform, band_idx, px, round(CASE WHEN platform IN ('naip', 'linz')
      THEN ((CAST(trunc(x) AS BIGINT) % 256) + 256) % 256 ELSE x END, 6)::DOUBLE AS v FROM b
    """,
)
def _(t):
    return s.pixel_rows(bands.destandardise_chips(s.chips(t), s.registry(t)), ["chip_id", "platform"])


@check(
    "f17_minmax_stretch",
    f"""
    WITH m AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM {PIX} WINDOW w AS (PARTITION BY chip_id, band_idx))
    SELECT chip_id, band_idx, px, round((v - lo) / (hi - lo), 6) AS v FROM m
    """,
)
def _(t):
    stretched = s.chips(t).withColumn("pixels", F.transform("pixels", px.minmax_stretch))
    return s.pixel_rows(stretched, ["chip_id"])


@check(
    "p9_clip",
    """
    SELECT o_orderkey, round(least(greatest(o_totalprice / 1000 - 50, 0), 400), 6) AS biomass,
           round(least(greatest(o_totalprice / 10000 - 20, 0), 1), 6) AS reflectance FROM orders
    """,
)
def _(t):
    price = F.col("o_totalprice")
    return t("orders").select(
        "o_orderkey",
        F.round(px.clip(price / 1000 - 50, 0, 400), 6).alias("biomass"),
        F.round(px.clip(price / 10000 - 20, 0, 1), 6).alias("reflectance"),
    )


@check(
    "j9_normalise_join",
    f"""
    SELECT l_orderkey, l_linenumber, l_partkey, r.platform, r.band, round((l_quantity - r.mean) / r.std, 6) AS scaled
    FROM lineitem JOIN {REG} r ON r.platform = 'modis' AND r.band = 'sur_refl_b0' || l_linenumber
    """,
)
def _(t):
    values = t("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.lit("modis").alias("platform"),
        F.concat(F.lit("sur_refl_b0"), F.col("l_linenumber").cast("string")).alias("band"),
        F.col("l_quantity").alias("value"),
    )
    return bands.normalise_join(values, s.registry(t)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "platform", "band", F.round("scaled", 6).alias("scaled")
    )
