"""Polygons as columns: ``array<array<struct<x: double, y: double>>>``, closed rings, holes and parts by the even-odd rule.

All functions are column expressions, so a polygon is read, tested, clipped and written
inside the task that holds its row, without Python. NULL polygons give NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.functions.binding import let
from rasterloom.functions.geo import _double_bits, _swap_bytes, box

RINGS = "array<array<struct<x:double,y:double>>>"
POINTS = "array<struct<x:double,y:double>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def box_rings(bbox: Column) -> Column:
    """A box as a polygon, counter-clockwise from (xmin, ymin)."""
    x0, y0, x1, y1 = (bbox[n] for n in ("xmin", "ymin", "xmax", "ymax"))
    return F.array(F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0)))


def rings_box(rings: Column) -> Column:
    """The box around a polygon."""
    flat = F.flatten(rings)
    xs, ys = F.transform(flat, lambda p: p["x"]), F.transform(flat, lambda p: p["y"])
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def _edges(ring: Column) -> Column:
    """The edges (a, b) of a closed ring."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1))), lambda i: F.struct(F.element_at(ring, i).alias("a"), F.coalesce(F.get(ring, i), F.element_at(ring, 1)).alias("b")))


def all_edges(rings: Column) -> Column:
    return F.flatten(F.transform(rings, _edges))


def _on_edge(a: Column, b: Column, x: Column, y: Column) -> Column:
    side = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
    return (side == 0) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))


def contains_point(rings: Column, x: Column, y: Column) -> Column:
    """Ray crossing over all rings: inside outer rings, not in holes; a point on an edge counts as inside."""

    def crossed(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        # multiplied out, so that an edge and its reverse are judged alike
        left = (b["x"] - a["x"]) * (y - a["y"]) - (x - a["x"]) * (b["y"] - a["y"])
        return spans & ((left > 0) == (b["y"] > a["y"]))

    def judged(edges: Column) -> Column:
        odd = F.size(F.filter(edges, crossed)) % 2 == 1
        return odd | F.exists(edges, lambda e: _on_edge(e["a"], e["b"], x, y))

    return let(all_edges(rings), judged)


def _turn(a: Column, b: Column, p: Column) -> Column:
    return F.signum((b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"]))


def _cross(e: Column, f: Column) -> Column:
    """Whether two edges share a point."""
    t1, t2 = _turn(e["a"], e["b"], f["a"]), _turn(e["a"], e["b"], f["b"])
    t3, t4 = _turn(f["a"], f["b"], e["a"]), _turn(f["a"], f["b"], e["b"])
    touch = (
        _on_edge(e["a"], e["b"], f["a"]["x"], f["a"]["y"]) | _on_edge(e["a"], e["b"], f["b"]["x"], f["b"]["y"])
        | _on_edge(f["a"], f["b"], e["a"]["x"], e["a"]["y"]) | _on_edge(f["a"], f["b"], e["b"]["x"], e["b"]["y"])
    )
    return ((t1 * t2 < 0) & (t3 * t4 < 0)) | touch


def polygons_touch(a: Column, b: Column) -> Column:
    """Whether two polygons share a point: edges cross, or a ring's first corner lies in the other."""
    ours, theirs = all_edges(a), all_edges(b)
    crossing = F.exists(ours, lambda e: F.exists(theirs, lambda f: _cross(e, f)))
    inside = F.exists(a, lambda r: contains_point(b, F.element_at(r, 1)["x"], F.element_at(r, 1)["y"]))
    around = F.exists(b, lambda r: contains_point(a, F.element_at(r, 1)["x"], F.element_at(r, 1)["y"]))
    return crossing | inside | around


def ring_area(ring: Column) -> Column:
    """Signed area: counter-clockwise is positive."""
    terms = F.transform(_edges(ring), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t) / 2


def polygon_area(rings: Column) -> Column:
    """Area of the first ring less that of all others (one part with holes); 0 without rings."""
    sizes = F.transform(rings, lambda r: F.abs(ring_area(r)))
    return 2 * F.coalesce(F.get(sizes, F.lit(0)), F.lit(0.0)) - F.aggregate(sizes, F.lit(0.0), lambda s, t: s + t)


def _clip_half(ring: Column, plane: Column) -> Column:
    """The part of a closed ring where ``nx * x + ny * y <= c``, closed again; empty if nothing is left."""

    def depth(p: Column) -> Column:
        return plane["nx"] * p["x"] + plane["ny"] * p["y"] - plane["c"]

    def cut(e: Column) -> Column:
        a, b = e["a"], e["b"]
        da, db = depth(a), depth(b)
        share = da / F.when(da == db, F.lit(1.0)).otherwise(da - db)
        # on planes parallel to an axis the cut lies exactly on them
        x = F.when(plane["ny"] == 0, plane["c"] / F.when(plane["nx"] == 0, F.lit(1.0)).otherwise(plane["nx"])).otherwise(a["x"] + share * (b["x"] - a["x"]))
        y = F.when(plane["nx"] == 0, plane["c"] / F.when(plane["ny"] == 0, F.lit(1.0)).otherwise(plane["ny"])).otherwise(a["y"] + share * (b["y"] - a["y"]))
        middle, none = F.array(point(x, y)), F.array().cast(POINTS)
        return F.when((da <= 0) & (db <= 0), F.array(b)).when(da <= 0, middle).when(db <= 0, F.concat(middle, F.array(b))).otherwise(none)

    open_ring = F.flatten(F.transform(_edges(ring), cut))
    return F.when(F.size(ring) == 0, ring).otherwise(F.concat(open_ring, F.slice(open_ring, 1, 1)))


def clip_convex(rings: Column, planes: Column) -> Column:
    """A polygon cut down to a convex area, given as ``array<struct<nx, ny, c>>`` of half planes; lost rings drop out.

    Clipping a ring that is not convex may leave parts joined by edges that run along
    the border of the area; they enclose nothing, so areas are right.
    """
    kept = F.transform(rings, lambda r: F.aggregate(planes, r, _clip_half))
    return F.filter(kept, lambda r: F.size(r) > 3)


def box_planes(bbox: Column) -> Column:
    def plane(nx: float, ny: float, c: Column) -> Column:
        return F.struct(F.lit(nx).alias("nx"), F.lit(ny).alias("ny"), c.cast("double").alias("c"))

    return F.array(plane(-1.0, 0.0, -bbox["xmin"]), plane(1.0, 0.0, bbox["xmax"]), plane(0.0, -1.0, -bbox["ymin"]), plane(0.0, 1.0, bbox["ymax"]))


def convex_planes(ring: Column) -> Column:
    """Half planes of a convex counter-clockwise ring."""

    def plane(e: Column) -> Column:
        nx, ny = e["b"]["y"] - e["a"]["y"], e["a"]["x"] - e["b"]["x"]
        return F.struct(nx.alias("nx"), ny.alias("ny"), (nx * e["a"]["x"] + ny * e["a"]["y"]).alias("c"))

    return F.transform(_edges(ring), plane)


# --- well-known binary ---


def _le_int(n: Column) -> Column:
    h = F.lpad(F.hex(n.cast("bigint")), 8, "0")
    return F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])


def rings_wkb(rings: Column) -> Column:
    """Little-endian WKB polygon."""

    def number(v: Column) -> Column:
        return _swap_bytes(F.lpad(F.hex(_double_bits(v)), 16, "0"))

    def ring(r: Column) -> Column:
        points = F.transform(r, lambda p: F.concat(number(p["x"]), number(p["y"])))
        return F.concat(_le_int(F.size(r)), F.array_join(points, ""))

    return F.unhex(F.concat(F.lit("01" + "03000000"), _le_int(F.size(rings)), F.array_join(F.transform(rings, ring), "")))


def _read(text: Column, at: Column, digits: int, big: Column) -> Column:
    """Hex digits of a number that starts at digit ``at`` (from 0), most significant byte first."""
    plain = F.substr(text, at + 1, F.lit(digits))
    swapped = F.concat(*[F.substr(text, at + i, F.lit(2)) for i in range(digits - 1, 0, -2)])
    return F.when(big, plain).otherwise(swapped)


def _whole(h: Column) -> Column:
    return F.conv(h, 16, 10).cast("bigint")


def _double(h: Column) -> Column:
    """The double of 16 hex digits; exact, since each step scales by a power of two."""

    def number(parts: Column) -> Column:
        head, mantissa = parts["head"], parts["mantissa"]
        exponent = (head % 2048).cast("double")
        size = F.when(exponent == 0, mantissa * F.pow(F.lit(2.0), F.lit(-1022.0))).otherwise((1 + mantissa) * F.pow(F.lit(2.0), exponent - 1023))
        return F.when(head >= 2048, -size).otherwise(size)

    def split(digits: Column) -> Column:
        mantissa = _whole(F.substring(digits, 4, 13)).cast("double") * F.lit(2.0**-52)
        return F.struct(_whole(F.substring(digits, 1, 3)).alias("head"), mantissa.alias("mantissa"))

    return let(h, lambda digits: let(split(digits), number))


def wkb_rings(wkb: Column) -> Column:
    """All rings of a WKB polygon or multipolygon of either byte order; other geometries give NULL.

    A multipolygon's parts follow each other; with the even-odd rule its rings are one list.
    """
    return let(F.hex(wkb), _text_rings)


def _text_rings(text: Column) -> Column:
    """The rings of WKB in hex digits."""
    state = "struct<at:int,rings:" + RINGS + ">"

    def read_polygon(s: Column) -> Column:
        """One polygon that starts at digit ``s.at``: byte order, kind, ring count, rings."""
        big = F.substr(text, s["at"] + 1, F.lit(2)) == "00"
        count = _whole(_read(text, s["at"] + 10, 8, big)).cast("int")

        def read_ring(t: Column, _: Column) -> Column:
            n = _whole(_read(text, t["at"], 8, big)).cast("int")
            first = t["at"] + 8
            points = F.transform(
                F.sequence(F.lit(0), n - 1),
                lambda i: point(_double(_read(text, first + i * 32, 16, big)), _double(_read(text, first + i * 32 + 16, 16, big))),
            )
            points = F.when(n > 0, points).otherwise(F.array().cast(POINTS))
            return F.struct((first + n * 32).cast("int").alias("at"), F.concat(t["rings"], F.array(points)).alias("rings")).cast(state)

        start = F.struct((s["at"] + 18).cast("int").alias("at"), s["rings"].alias("rings")).cast(state)
        return F.when(count > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), start, read_ring)).otherwise(start)

    big = F.substring(text, 1, 2) == "00"
    kind = _whole(_read(text, F.lit(2), 8, big))
    nothing = F.array().cast(RINGS)
    one = read_polygon(F.struct(F.lit(0).alias("at"), nothing.alias("rings")).cast(state))["rings"]
    parts = _whole(_read(text, F.lit(10), 8, big)).cast("int")
    start = F.struct(F.lit(18).alias("at"), nothing.alias("rings")).cast(state)
    many = F.aggregate(F.sequence(F.lit(1), F.greatest(parts, F.lit(1))), start, lambda s, _: read_polygon(s))["rings"]
    return F.when(kind == 3, one).when((kind == 6) & (parts > 0), many).when(kind == 6, nothing)
