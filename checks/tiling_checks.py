"""Chipping, patching, stacking and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import standins as s
from checks.registry import check
from rasterloom.operators import tiling

ENT, PIX = s.ENTRIES, s.CHIP_PIXELS


def _raster(t, extra: bool = False):
    """Each vector as an 8x8 raster of one band (two bands with ``extra``: the second is negated)."""
    one = F.col("vec")
    bands = F.array(one, F.transform(one, lambda v: -v)) if extra else F.array(one)
    return s.embeddings(t).select("vec_id", "label", F.lit(8).alias("h"), F.lit(8).alias("w"), bands.alias("pixels"))


_TWO = f"(SELECT vec_id, label, 0::BIGINT AS band_idx, pos // 8 AS y, pos % 8 AS x, v FROM {ENT} UNION ALL SELECT vec_id, label, 1, pos // 8, pos % 8, -v FROM {ENT})"


@check(
    "c1_chip_raster",
    f"""
    SELECT vec_id, CAST((x // 3) * 2 + y // 3 AS INTEGER) AS chip_no, band_idx, (y % 3) * 3 + x % 3 AS px, round(v, 6) AS v
    FROM {_TWO} WHERE x < 6 AND y < 6
    """,
)
def _(t):
    return s.pixel_rows(tiling.chip_raster(_raster(t, True), 3, ["vec_id"]), ["vec_id", "chip_no"])


@check(
    "c2_chip_splits",
    f"""
    SELECT CASE WHEN label < 5 THEN 'train' ELSE 'val' END AS split, CASE WHEN label % 2 = 0 THEN 'image' ELSE 'label' END AS kind,
      'tile' || vec_id || '_chip_' || ((x // 4) * 2 + y // 4) AS chip_name, 0::BIGINT AS band_idx, (y % 4) * 4 + x % 4 AS px, round(v, 6) AS v
    FROM {_TWO} WHERE band_idx = 0
    """,
)
def _(t):
    rasters = _raster(t).select(
        F.when(F.col("label") < 5, "train").otherwise("val").alias("split"),
        F.when(F.col("label") % 2 == 0, "image").otherwise("label").alias("kind"),
        F.concat(F.lit("tile"), F.col("vec_id").cast("string")).alias("stem"),
        "h",
        "w",
        "pixels",
    )
    return s.pixel_rows(tiling.chip_splits(rasters, 4), ["split", "kind", "chip_name"])


@check(
    "c3_patch_grid",
    """
    SELECT vec_id, CAST(r * 2 + c AS INTEGER) AS patch_idx, CAST(r AS INTEGER) AS patch_row, CAST(c AS INTEGER) AS patch_col,
      10 * (c * 4) + 1000.0::DOUBLE * (vec_id % 25) AS lon_start, -10 * (r * 4) + 1000.0::DOUBLE * (vec_id // 25) AS lat_start,
      10 * (c * 4 + 4) + 1000.0::DOUBLE * (vec_id % 25) AS lon_end, -10 * (r * 4 + 4) + 1000.0::DOUBLE * (vec_id // 25) AS lat_end
    FROM embeddings, range(2) a(r), range(2) b(c)
    """,
)
def _(t):
    x, y = 1000.0 * (F.col("vec_id") % 25), 1000.0 * F.floor(F.col("vec_id") / 25)
    affine = F.struct(
        F.lit(10.0).alias("a"), F.lit(0.0).alias("b"), x.alias("c"), F.lit(0.0).alias("d"), F.lit(-10.0).alias("e"), y.alias("f")
    )
    chips = _raster(t).withColumn("affine", affine)
    out = tiling.patch_grid(chips, 4, ["vec_id"], F.col("affine"))
    for c in ("lon_start", "lat_start", "lon_end", "lat_end"):
        out = out.withColumn(c, F.col(c) + 0.0)
    return out


_PATCHIFIED = f"SELECT vec_id, CAST((y // 2) * 4 + x // 2 AS INTEGER) AS patch_idx, CAST(band_idx * 4 + (y % 2) * 2 + x % 2 AS INTEGER) AS pos, round(v, 6) AS v FROM {_TWO}"


@check("c4_patchify", _PATCHIFIED)
def _(t):
    return s.vector_rows(tiling.patchify(_raster(t, True), 2, ["vec_id"]), ["vec_id", "patch_idx"], "vals")


@check("c5_unpatchify", f"SELECT vec_id, band_idx, y * 8 + x AS px, round(v, 6) AS v FROM {_TWO}")
def _(t):
    patches = tiling.patchify(_raster(t, True), 2, ["vec_id"])
    return s.pixel_rows(tiling.unpatchify(patches, 2, 8, 8, ["vec_id"]), ["vec_id"])


@check(
    "c6_split_stacks",
    """
    WITH e AS (SELECT event_id // 128 AS stack, event_id % 128 AS pos, value, user_id, count(*) OVER (PARTITION BY event_id // 128) AS n FROM events)
    SELECT CASE WHEN n = 128 THEN 'cube_' || stack || '_' || (pos // 32) ELSE 'cube_' || stack END AS name,
      CAST(CASE WHEN n = 128 THEN pos % 32 ELSE pos END AS INTEGER) AS pos, value, user_id FROM e
    """,
)
def _(t):
    members = F.array_sort(F.collect_list(F.struct("event_id", "value", "user_id")))
    stacks = (
        t("events")
        .groupBy(F.floor(F.col("event_id") / 128).alias("stack"))
        .agg(members.alias("m"))
        .select(
            F.concat(F.lit("cube_"), F.col("stack").cast("string")).alias("name"),
            F.col("m.value").alias("pixels"),
            F.col("m.user_id").alias("users"),
        )
    )
    parts = tiling.split_stacks(stacks, ["pixels", "users"])
    long = parts.select("name", F.posexplode(F.arrays_zip("pixels", "users")).alias("pos", "z"))
    return long.select("name", "pos", F.col("z.pixels").alias("value"), F.col("z.users").alias("user_id"))


@check(
    "c7_composite_mask",
    f"""
    SELECT vec_id, band_idx, y * 8 + x AS px, round(CASE WHEN ((y // 2) * 4 + x // 2 + label) % 3 = 0 THEN v * 2 + 1 ELSE v END, 6) AS v FROM {_TWO}
    """,
)
def _(t):
    chips = _raster(t, True)
    recon = F.transform("pixels", lambda b: F.transform(b, lambda v: v * 2 + 1))
    mask = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: ((i + F.col("label")) % 3 == 0).cast("int"))
    out = tiling.composite_mask(chips.withColumn("recon", recon).withColumn("mask", mask), 2)
    return s.pixel_rows(out, ["vec_id"])


@check(
    "c8_resample_nearest",
    f"""
    SELECT vec_id, 0::BIGINT AS band_idx, i AS px, round(e.v, 6) AS v FROM {ENT} e JOIN (SELECT i, ((i // 5) * 8 // 6) * 8 + (i % 5) * 8 // 5 AS pos FROM range(30) r(i)) USING (pos)
    """,
)
def _(t):
    return s.pixel_rows(tiling.resample(_raster(t), 6, 5, "nearest"), ["vec_id"])


@check(
    "c8_resample_bilinear",
    f"""
    WITH a AS (SELECT i, greatest((i // 5 + 0.5) * 8 / 12.0::DOUBLE - 0.5, 0) AS py, greatest((i % 5 + 0.5) * 8 / 5.0::DOUBLE - 0.5, 0) AS px FROM range(60) r(i)),
    b AS (SELECT *, least(CAST(floor(py) AS BIGINT), 7) AS y0, least(CAST(floor(px) AS BIGINT), 7) AS x0 FROM a),
    c AS (SELECT i, y0, x0, least(y0 + 1, 7) AS y1, least(x0 + 1, 7) AS x1, py - y0 AS fy, px - x0 AS fx FROM b),
    n AS (SELECT i, y0 * 8 + x0 AS pos, (1 - fy) * (1 - fx) AS wt FROM c UNION ALL SELECT i, y0 * 8 + x1, (1 - fy) * fx FROM c
      UNION ALL SELECT i, y1 * 8 + x0, fy * (1 - fx) FROM c UNION ALL SELECT i, y1 * 8 + x1, fy * fx FROM c)
    SELECT vec_id, 0::BIGINT AS band_idx, i AS px, round(sum(e.v * wt), 6) AS v FROM {ENT} e JOIN n USING (pos) GROUP BY vec_id, i
    """,
)
def _(t):
    return s.pixel_rows(tiling.resample(_raster(t), 12, 5, "bilinear"), ["vec_id"])


@check(
    "c9_strip_plan",
    f"SELECT CAST(floor((lon - 2) * 12000 / 512) AS BIGINT) AS strip, count(*) AS n FROM {s.POINTS} WHERE floor((lon - 2) * 12000 / 512) BETWEEN 0 AND 420 GROUP BY 1",
)
def _(t):
    planned = tiling.strip_plan(s.points(t), 2, 20, 12000, 512)
    return planned.groupBy("strip").agg(F.count(F.lit(1)).alias("n"))


@check(
    "c10_stack_bands",
    f"SELECT vec_id, pos // 16 AS band_idx, pos % 16 AS px, round(v, 6) AS v FROM {ENT}",
)
def _(t):
    def source(first: int, n: int):
        bands = F.transform(F.sequence(F.lit(first), F.lit(first + n - 1)), lambda b: F.slice("vec", b * 16 + 1, 16))
        return s.embeddings(t).select("vec_id", F.lit(4).alias("h"), F.lit(4).alias("w"), bands.alias("pixels"))

    return s.pixel_rows(tiling.stack_bands([source(0, 2), source(2, 1), source(3, 1)], ["vec_id"]), ["vec_id"])


@check(
    "c11_pixel_window",
    f"SELECT vec_id, band_idx, (y - 1) * 4 + (x - 2) AS px, round(v, 6) AS v FROM {_TWO} WHERE x BETWEEN 2 AND 5 AND y BETWEEN 1 AND 3",
)
def _(t):
    return s.pixel_rows(tiling.pixel_window(_raster(t, True), 2, 1, 6, 4), ["vec_id"])
