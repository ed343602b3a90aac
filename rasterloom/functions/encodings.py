"""Time, location and position encodings as array columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The periods the encodings wrap around.
WEEKS_PER_TURN = 52
HOURS_PER_TURN = 24
TEMPERATURE = 10000.0


def _pair(angle: Column) -> list[Column]:
    return [F.sin(angle), F.cos(angle)]


def encode_time(ts: Column | str) -> Column:
    """ISO week and hour as (sin, cos, sin, cos). Week 53 simply wraps past a full turn."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    week = F.weekofyear(ts) * F.lit(2 * math.pi / WEEKS_PER_TURN)
    hour = F.hour(ts) * F.lit(2 * math.pi / HOURS_PER_TURN)
    return F.array(*_pair(week), *_pair(hour))


def encode_latlon(lat: Column | str, lon: Column | str) -> Column:
    """Degrees to (sin lat, cos lat, sin lon, cos lon)."""
    return F.array(*_pair(F.radians(lat)), *_pair(F.radians(lon)))


def _waves(value: Column, n: int, exponent) -> tuple[Column, Column]:
    """sin and cos blocks of ``value * omega_k`` for k in 0..n-1, omega_k = exponent(k)."""
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    return (
        F.transform(steps, lambda k: F.sin(value * exponent(k))),
        F.transform(steps, lambda k: F.cos(value * exponent(k))),
    )


def posenc_1d(value: Column | str, dim: int, temperature: float = TEMPERATURE) -> Column:
    """Sine block then cosine block over dim/2 geometric frequencies."""
    if dim % 2:
        raise ValueError("dim must be a multiple of 2")
    value = F.col(value) if isinstance(value, str) else value
    n = dim // 2
    base = F.lit(float(temperature))
    s, c = _waves(value, n, lambda k: F.pow(base, -k / F.lit(float(n - 1))))
    return F.concat(s, c)


def posenc_2d(
    x: Column | str,
    y: Column | str,
    dim: int,
    temperature: float = TEMPERATURE,
    gsd: Column | float | None = None,
) -> Column:
    """x sines, x cosines, y sines, y cosines over dim/4 frequencies.

    With ``gsd`` the frequencies use the resolution-scaled formula.
    """
    if dim % 4:
        raise ValueError("dim must be a multiple of 4")
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    n = dim // 4
    base = F.lit(float(temperature))
    if gsd is None:
        omega = lambda k: F.pow(base, -k / F.lit(float(n - 1)))
    else:
        scale = gsd if isinstance(gsd, Column) else F.lit(float(gsd))
        omega = lambda k: F.pow(base, -(k / F.lit(float(n - 1))) * F.lit(2.0 / dim)) * scale
    return F.concat(*_waves(x, n, omega), *_waves(y, n, omega))


def add_encodings(
    vals: Column, x: Column, y: Column, time4: Column, latlon4: Column, dim: int, gsd: Column | float
) -> Column:
    """Patch vector plus (position of width dim-8, time, latlon)."""
    extra = F.concat(posenc_2d(x, y, dim - 8, gsd=gsd), time4, latlon4)
    return F.zip_with(vals, extra, lambda v, e: v + e)
