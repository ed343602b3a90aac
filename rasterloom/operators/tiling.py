"""Cutting, joining and resampling of rasters held as ``array<array<float>>`` rows.

Pieces are cut inside the row that holds the raster and exploded afterwards, so
no pixel is shuffled and the parent raster is not copied per piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions import pixels as px
from rasterloom.functions.binding import let
from rasterloom.functions.geo import affine_xy


def _int(c: Column) -> Column:
    return c.cast("int")


def chip_raster(rasters: DataFrame, size: int, key: list[str]) -> DataFrame:
    """Full ``size`` x ``size`` chips, numbered down the columns; the remainder is dropped."""
    nx, ny = _int(F.floor(F.col("w") / size)), _int(F.floor(F.col("h") / size))
    full = rasters.filter((F.col("w") >= size) & (F.col("h") >= size))

    def piece(pixels: Column, n: Column) -> Column:
        i, j = _int(F.floor(n / ny)), _int(n % ny)
        return F.struct(
            _int(n).alias("chip_no"),
            i.alias("chip_x"),
            j.alias("chip_y"),
            F.transform(
                pixels, lambda b: px.window(b, F.col("w"), i * size, j * size, F.lit(size), F.lit(size))
            ).alias("pixels"),
        )

    numbers = F.sequence(F.lit(0), nx * ny - 1)
    pieces = let(F.col("pixels"), lambda p: F.transform(numbers, lambda n: piece(p, n)))
    return full.select(*key, F.explode(pieces).alias("_c")).select(
        *key, "_c.chip_no", "_c.chip_x", "_c.chip_y", F.lit(size).alias("h"), F.lit(size).alias("w"), "_c.pixels"
    )


def chip_splits(rasters: DataFrame, size: int, stem: str = "stem") -> DataFrame:
    """The same cut for every (split, kind) set; chips are named ``{stem}_chip_{n}``."""
    chips = chip_raster(rasters, size, ["split", "kind", stem])
    return chips.withColumn("chip_name", F.concat(F.col(stem), F.lit("_chip_"), F.col("chip_no").cast("string")))


def patch_grid(chips: DataFrame, size: int, key: list[str], transform: Column | tuple) -> DataFrame:
    """Full patches of a chip with their map bounds under an affine transform."""
    cols, rows = _int(F.floor(F.col("w") / size)), _int(F.floor(F.col("h") / size))
    idx = F.explode(F.sequence(F.lit(0), rows * cols - 1))
    cells = chips.filter((F.col("w") >= size) & (F.col("h") >= size)).withColumn("patch_idx", idx)
    row, col = _int(F.floor(F.col("patch_idx") / cols)), _int(F.col("patch_idx") % cols)
    x0, y0 = affine_xy(transform, col * size, row * size)
    x1, y1 = affine_xy(transform, (col + 1) * size, (row + 1) * size)
    return cells.select(
        *key,
        "patch_idx",
        row.alias("patch_row"),
        col.alias("patch_col"),
        x0.alias("lon_start"),
        y0.alias("lat_start"),
        x1.alias("lon_end"),
        y1.alias("lat_end"),
    )


def patchify(chips: DataFrame, size: int, key: list[str]) -> DataFrame:
    """Patches in row-major order, each a vector ordered (band, row, column)."""
    cols, rows = _int(F.floor(F.col("w") / size)), _int(F.floor(F.col("h") / size))

    def piece(pixels: Column, n: Column) -> Column:
        r, c = _int(F.floor(n / cols)), _int(n % cols)
        vals = F.flatten(
            F.transform(pixels, lambda b: px.window(b, F.col("w"), c * size, r * size, F.lit(size), F.lit(size)))
        )
        return F.struct(r.alias("patch_row"), c.alias("patch_col"), _int(n).alias("patch_idx"), vals.alias("vals"))

    numbers = F.sequence(F.lit(0), rows * cols - 1)
    pieces = let(F.col("pixels"), lambda p: F.transform(numbers, lambda n: piece(p, n)))
    full = chips.filter((F.col("w") >= size) & (F.col("h") >= size))
    return full.select(*key, F.inline(pieces))


def unpatchify(patches: DataFrame, size: int, h: int, w: int, key: list[str]) -> DataFrame:
    """Inverse of ``patchify``; a group is one chip, h*w/size^2 patches."""
    cols = w // size
    grouped = patches.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("patch_idx", "vals")))["vals"].alias("_p"))
    n_bands = _int(F.size(F.col("_p")[0]) / (size * size))

    def band(b: Column) -> Column:
        def line(y: Column) -> Column:
            first = _int(F.floor(y / size)) * cols
            inner = b * (size * size) + (y % size) * size
            strips = F.transform(
                F.sequence(F.lit(0), F.lit(cols - 1)),
                lambda c: F.slice(F.get(F.col("_p"), first + c), inner + 1, size),
            )
            return F.flatten(strips)

        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(h - 1)), line))

    return grouped.select(
        *key,
        F.lit(h).alias("h"),
        F.lit(w).alias("w"),
        F.transform(F.sequence(F.lit(0), n_bands - 1), band).alias("pixels"),
    )


def split_stacks(stacks: DataFrame, arrays: list[str], name: str = "name", whole: int = 128, part: int = 32) -> DataFrame:
    """Stacks of exactly ``whole`` entries become parts named ``{name}_{i}``; others stay as they are."""
    full = F.size(arrays[0]) == whole
    ids = F.when(full, F.sequence(F.lit(0), F.lit(whole // part - 1))).otherwise(F.array(F.lit(-1)))
    cut = lambda a, i: F.when(i >= 0, F.slice(a, i * part + 1, F.lit(part))).otherwise(a)
    pieces = let(
        F.struct(*arrays),
        lambda s: F.transform(ids, lambda i: F.struct(i.alias("part"), *[cut(s[c], i).alias(c) for c in arrays])),
    )
    rest = [c for c in stacks.columns if c not in (name, *arrays)]
    named = F.when(F.col("_s.part") >= 0, F.concat_ws("_", F.col(name), F.col("_s.part").cast("string"))).otherwise(
        F.col(name)
    )
    return stacks.select(name, *rest, F.explode(pieces).alias("_s")).select(
        named.alias(name), *rest, *[F.col(f"_s.{c}").alias(c) for c in arrays]
    )


def composite_mask(chips: DataFrame, size: int, recon: str = "recon", mask: str = "mask") -> DataFrame:
    """Reconstruction where the patch is masked, the chip elsewhere (mask: one 0/1 per patch)."""
    w = F.col("w")
    cols = _int(w / size)
    patch = lambda i: _int(F.floor(F.floor(i / w) / size) * cols + F.floor((i % w) / size))

    def blend(m: Column) -> Column:
        one = lambda band, other: F.transform(
            band, lambda v, i: F.when(F.get(m, patch(i)) == 1, F.get(other, i)).otherwise(v)
        )
        return F.zip_with("pixels", recon, one)

    return chips.withColumn("pixels", let(F.col(mask), blend)).drop(recon, mask)


def resample(chips: DataFrame, h2: int, w2: int, method: str = "bilinear") -> DataFrame:
    fn = {"nearest": px.resample_nearest, "bilinear": px.resample_bilinear}[method]
    h, w = F.col("h"), F.col("w")
    return chips.withColumn("pixels", F.transform("pixels", lambda b: fn(b, h, w, h2, w2))).withColumns(
        {"h": F.lit(h2), "w": F.lit(w2)}
    )


def strip_count(lon0: float, lon1: float, pixels_per_degree: float, chip: int) -> int:
    """Chip-wide columns between two longitudes."""
    return int((lon1 - lon0) * pixels_per_degree / chip)


def strip_plan(
    work: DataFrame, lon0: float, lon1: float, pixels_per_degree: float, chip: int, lon: str = "lon"
) -> DataFrame:
    """Work rows with their strip number; rows outside the planned strips are left out."""
    strip = F.floor((F.col(lon) - lon0) * pixels_per_degree / chip)
    n = strip_count(lon0, lon1, pixels_per_degree, chip)
    return work.withColumn("strip", strip).filter(F.col("strip").between(0, n - 1))


def stack_bands(tables: list[DataFrame], on: list[str]) -> DataFrame:
    """Aligned chips of several sources as one chip, bands in table order."""
    out = tables[0].select(*on, "h", "w", F.col("pixels").alias("_p0"))
    for i, t in enumerate(tables[1:], start=1):
        out = out.join(t.select(*on, F.col("pixels").alias(f"_p{i}")), on)
    parts = [F.col(f"_p{i}") for i in range(len(tables))]
    return out.select(*on, "h", "w", F.concat(*parts).alias("pixels"))


def pixel_window(chips: DataFrame, xmin: int, ymin: int, xmax: int, ymax: int) -> DataFrame:
    """Pixels with xmin <= x < xmax and ymin <= y < ymax."""
    ww, hh = xmax - xmin, ymax - ymin
    cut = F.transform("pixels", lambda b: px.window(b, F.col("w"), F.lit(xmin), F.lit(ymin), F.lit(ww), F.lit(hh)))
    return chips.withColumn("pixels", cut).withColumns({"w": F.lit(ww), "h": F.lit(hh)})
