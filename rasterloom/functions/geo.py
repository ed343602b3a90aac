"""Boxes, affine transforms and closed-form map projections (WGS 84)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
UTM_SCALE = 0.9996
UTM_EASTING = 500000.0
UTM_SOUTH_NORTHING = 10000000.0

_N = FLATTENING / (2 - FLATTENING)
_RADIUS = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_K = 2 * _N**0.5 / (1 + _N)
# Krueger series to third order in n (published coefficients).
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def _col(c: Column | str | float) -> Column:
    if isinstance(c, Column):
        return c
    return F.col(c) if isinstance(c, str) else F.lit(float(c))


def affine_xy(t: tuple[float, ...] | Column, col: Column, row: Column) -> tuple[Column, Column]:
    """Map x, y of a pixel corner under (a, b, c, d, e, f): x = a*col + b*row + c."""
    if isinstance(t, Column):
        a, b, c, d, e, f = (t[n] for n in "abcdef")
    else:
        a, b, c, d, e, f = (F.lit(float(v)) for v in t)
    return a * col + b * row + c, d * col + e * row + f


def bounds_around(x: Column, y: Column, size: int, gsd: float | Column) -> Column:
    """Square box of size*gsd map units around a point; the half width is floored."""
    half = F.floor(F.lit(float(size)) * _col(gsd) / 2).cast("double")
    return box(x - half, y - half, x + half, y + half)


def box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return F.struct(
        xmin.cast("double").alias("xmin"),
        ymin.cast("double").alias("ymin"),
        xmax.cast("double").alias("xmax"),
        ymax.cast("double").alias("ymax"),
    )


def box_from_corners(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Any two opposite corners, in any order."""
    return box(F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2))


def box_centroid(bbox: Column | str) -> tuple[Column, Column]:
    """(lon, lat) of the middle: lon is x, lat is y."""
    bbox = _col(bbox)
    return (bbox["xmin"] + bbox["xmax"]) / 2, (bbox["ymin"] + bbox["ymax"]) / 2


def boxes_overlap(a: Column, b: Column) -> Column:
    """Closed boxes: a shared edge counts."""
    return (
        (a["xmin"] <= b["xmax"])
        & (b["xmin"] <= a["xmax"])
        & (a["ymin"] <= b["ymax"])
        & (b["ymin"] <= a["ymax"])
    )


def box_wkb(bbox: Column | str) -> Column:
    """Little-endian WKB polygon of a box, ring counter-clockwise from (xmin, ymin)."""
    bbox = _col(bbox)

    def hex_double(v: Column) -> Column:
        return F.lpad(F.hex(_double_bits(v)), 16, "0")

    x0, y0, x1, y1 = (bbox[n] for n in ("xmin", "ymin", "xmax", "ymax"))
    ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
    # byte order, type 3 (polygon), one ring, five points
    head = F.lit("01" + "03000000" + "01000000" + "05000000")
    body = [_swap_bytes(hex_double(v)) for point in ring for v in point]
    return F.unhex(F.concat(head, *body))


def _double_bits(v: Column) -> Column:
    """IEEE-754 bits of a double as a bigint, by exponent and mantissa."""
    mag = F.abs(v)
    raw = F.floor(F.log2(mag))
    # log2 may be off by one ulp around powers of two
    exp = (
        F.when(F.pow(F.lit(2.0), raw) > mag, raw - 1)
        .when(F.pow(F.lit(2.0), raw + 1) <= mag, raw + 1)
        .otherwise(raw)
    )
    mantissa = ((mag / F.pow(F.lit(2.0), exp) - 1) * F.lit(float(1 << 52))).cast("bigint")
    bits = F.shiftleft((exp + 1023).cast("bigint"), 52).bitwiseOR(mantissa)
    sign = F.when(v < 0, F.lit(-(1 << 63))).otherwise(F.lit(0).cast("bigint"))
    return F.when(mag == 0, F.lit(0).cast("bigint")).otherwise(bits.bitwiseOR(sign))


def _swap_bytes(hex16: Column) -> Column:
    return F.concat(*[F.substring(hex16, i, 2) for i in range(15, 0, -2)])


def _zone(epsg: Column) -> tuple[Column, Column]:
    """Central meridian in radians and false northing of EPSG 326zz / 327zz."""
    zone = epsg % 100
    north = F.when(F.floor(epsg / 100) == 327, F.lit(UTM_SOUTH_NORTHING)).otherwise(F.lit(0.0))
    return F.radians(zone * 6 - 183), north


def lonlat_to_utm(lon: Column, lat: Column, epsg: Column | int) -> tuple[Column, Column]:
    epsg = epsg if isinstance(epsg, Column) else F.lit(epsg)
    meridian, north = _zone(epsg)
    s = F.sin(F.radians(lat))
    dl = F.radians(lon) - meridian
    t = F.sinh(F.atanh(s) - F.lit(_K) * F.atanh(F.lit(_K) * s))
    xi = F.atan2(t, F.cos(dl))
    eta = F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    east, up = eta, xi
    for j, a in enumerate(_ALPHA, start=1):
        east = east + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        up = up + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    reach = F.lit(UTM_SCALE * _RADIUS)
    return F.lit(UTM_EASTING) + reach * east, north + reach * up


def utm_to_lonlat(x: Column, y: Column, epsg: Column | int) -> tuple[Column, Column]:
    epsg = epsg if isinstance(epsg, Column) else F.lit(epsg)
    meridian, north = _zone(epsg)
    reach = F.lit(UTM_SCALE * _RADIUS)
    xi, eta = (y - north) / reach, (x - F.lit(UTM_EASTING)) / reach
    xi_p, eta_p = xi, eta
    for j, b in enumerate(_BETA, start=1):
        xi_p = xi_p - F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta_p = eta_p - F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi_p) / F.cosh(eta_p))
    lat = chi
    for j, d in enumerate(_DELTA, start=1):
        lat = lat + F.lit(d) * F.sin(2 * j * chi)
    return F.degrees(meridian + F.atan2(F.sinh(eta_p), F.cos(xi_p))), F.degrees(lat)


def lonlat_to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:3857."""
    return F.lit(SEMI_MAJOR) * F.radians(lon), F.lit(SEMI_MAJOR) * F.asinh(F.tan(F.radians(lat)))


def mercator_to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / F.lit(SEMI_MAJOR)), F.degrees(F.atan(F.sinh(y / F.lit(SEMI_MAJOR))))


def reproject(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """Between EPSG:4326, EPSG:3857 and the UTM zones, by way of lon/lat."""
    if source == target:
        return x, y
    if source == 4326:
        lon, lat = x, y
    elif source == 3857:
        lon, lat = mercator_to_lonlat(x, y)
    elif source // 100 in (326, 327):
        lon, lat = utm_to_lonlat(x, y, source)
    else:
        raise ValueError(f"unknown EPSG:{source}")
    if target == 4326:
        return lon, lat
    if target == 3857:
        return lonlat_to_mercator(lon, lat)
    if target // 100 in (326, 327):
        return lonlat_to_utm(lon, lat, target)
    raise ValueError(f"unknown EPSG:{target}")
