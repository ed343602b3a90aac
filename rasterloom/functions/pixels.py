"""Pixel arithmetic on ``array<array<float>>`` chips (band -> row-major H*W).

All of it works inside one row: no shuffle, no explode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.functions.binding import let

# Fixed values of the radar conversion.
SAR_PLATFORM = "sentinel-1-rtc"
SAR_FLOOR = 1e-10


def pick_bands(pixels: Column, bands: Column, names: list[str]) -> Column:
    """Bands in caller order; a band the chip does not have comes out NULL."""
    wanted = F.array(*[F.lit(n) for n in names])
    return let(
        pixels, lambda p: F.transform(wanted, lambda n: F.get(p, (F.array_position(bands, n) - 1).cast("int")))
    )


def pick_positions(pixels: Column, positions: Column) -> Column:
    return let(pixels, lambda p: F.transform(positions, lambda i: F.get(p, i)))


def rgb(pixels: Column, platform: Column, rgb_idx: Column) -> Column:
    """Registry rgb positions; radar gets (vv, vh, mean of both)."""
    vv, vh = F.get(pixels, F.lit(0)), F.get(pixels, F.lit(1))
    radar = F.array(vv, vh, F.zip_with(vv, vh, lambda r, g: (r + g) / 2))
    return F.when(platform == SAR_PLATFORM, radar).otherwise(pick_positions(pixels, rgb_idx))


def to_decibel(value: Column) -> Column:
    """10*log10 with non-positive (corrupt) values lifted to a small one."""
    return F.lit(10.0) * F.log10(F.when(value <= 0, F.lit(SAR_FLOOR)).otherwise(value))


def sar_to_db(pixels: Column, platform: Column) -> Column:
    """Radar chips in decibel, all others untouched."""
    decibel = F.transform(pixels, lambda band: F.transform(band, to_decibel))
    return F.when(platform == SAR_PLATFORM, decibel).otherwise(pixels)


def standardise(pixels: Column, mean: Column, std: Column) -> Column:
    return F.transform(
        pixels, lambda band, b: F.transform(band, lambda x: (x - F.get(mean, b)) / F.get(std, b))
    )


def destandardise(pixels: Column, mean: Column, std: Column) -> Column:
    return F.transform(pixels, lambda band, b: F.transform(band, lambda x: x * F.get(std, b) + F.get(mean, b)))


def to_byte(pixels: Column) -> Column:
    """Truncating cast to an unsigned byte, wrapping like an 8-bit cast."""
    return F.transform(
        pixels, lambda band: F.transform(band, lambda x: F.pmod(x.cast("int"), F.lit(256)))
    )


def clip(value: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(value, F.lit(float(lo))), F.lit(float(hi)))


def minmax_stretch(values: Column) -> Column:
    """(x - min) / (max - min); a constant array maps to zeros."""
    lo, hi = F.array_min(values), F.array_max(values)
    span = F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))
    ends = F.struct(lo.alias("lo"), span.alias("span"))
    return let(ends, lambda e: F.transform(values, lambda x: (x - e["lo"]) / e["span"]))


def flip_horizontal(band: Column, h: Column, w: Column) -> Column:
    rows = F.sequence(F.lit(0), h - 1)
    return F.flatten(F.transform(rows, lambda y: F.reverse(F.slice(band, y * w + 1, w))))


def flip_vertical(band: Column, h: Column, w: Column) -> Column:
    rows = F.sequence(F.lit(0), h - 1)
    return F.flatten(F.transform(rows, lambda y: F.slice(band, (h - 1 - y) * w + 1, w)))


def window(band: Column, w: Column, x0: Column, y0: Column, cw: Column, ch: Column) -> Column:
    """The cw x ch block of a band whose top-left pixel is (x0, y0)."""
    rows = F.sequence(F.lit(0), ch - 1)
    return F.flatten(F.transform(rows, lambda dy: F.slice(band, (y0 + dy) * w + x0 + 1, cw)))


def resample_nearest(band: Column, h: Column, w: Column, h2: int, w2: int) -> Column:
    """Source cell floor(i * n / n2) for each target cell."""
    axis = lambda n, n2: F.transform(
        F.sequence(F.lit(0), F.lit(n2 - 1)), lambda i: F.floor(i * n / F.lit(n2)).cast("int")
    )
    rows = axis(h, h2)
    return let(
        axis(w, w2),
        lambda cols: F.flatten(F.transform(rows, lambda y: F.transform(cols, lambda x: F.get(band, y * w + x)))),
    )


def resample_bilinear(band: Column, h: Column, w: Column, h2: int, w2: int) -> Column:
    """Half-pixel centres, edges clamped (corners not aligned).

    Neighbours and weights are worked out once per target row and column.
    """

    def axis(n: Column, n2: int) -> Column:
        def place(i: Column) -> Column:
            pos = F.greatest((i + F.lit(0.5)) * n / F.lit(float(n2)) - F.lit(0.5), F.lit(0.0))
            low = F.least(F.floor(pos).cast("int"), n - 1)
            return F.struct(low.alias("a"), F.least(low + 1, n - 1).alias("b"), (pos - low).alias("f"))

        return F.transform(F.sequence(F.lit(0), F.lit(n2 - 1)), place)

    def line(y: Column, cols: Column) -> Column:
        top, low, fy = y["a"] * w, y["b"] * w, y["f"]

        def blend(x: Column) -> Column:
            at = lambda row, c: F.get(band, row + x[c])
            upper = at(top, "a") * (1 - x["f"]) + at(top, "b") * x["f"]
            lower = at(low, "a") * (1 - x["f"]) + at(low, "b") * x["f"]
            return upper * (1 - fy) + lower * fy

        return F.transform(cols, blend)

    return let(axis(w, w2), lambda cols: F.flatten(F.transform(axis(h, h2), lambda y: line(y, cols))))
