"""Planar geometry on rings (array<struct<x, y>>) as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ring_from_pairs(flat: Column) -> Column:
    """A closed ring from x1, y1, x2, y2, ..."""
    n = F.floor(F.size(flat) / 2).cast("int")
    points = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.element_at(flat, 2 * i + 1).cast("double").alias("x"), F.element_at(flat, 2 * i + 2).cast("double").alias("y")))
    return F.concat(points, F.slice(points, 1, 1))


def _edges(ring: Column, of) -> Column:
    """Sum of of(a, b) over the edges of a closed ring."""
    n = F.size(ring)
    terms = F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), of)
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)


def signed_area(ring: Column) -> Column:
    return _edges(ring, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]) / 2


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def length(ring: Column) -> Column:
    return _edges(ring, lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))


def bbox(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def overlaps(a: Column, b: Column) -> Column:
    return (a["minx"] <= b["maxx"]) & (a["maxx"] >= b["minx"]) & (a["miny"] <= b["maxy"]) & (a["maxy"] >= b["miny"])


def expand(box: Column, m: float) -> Column:
    return F.struct((box["minx"] - m).alias("minx"), (box["miny"] - m).alias("miny"), (box["maxx"] + m).alias("maxx"), (box["maxy"] + m).alias("maxy"))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd ray cast."""
    crosses = lambda a, b: (((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"])).cast("double")
    return _edges(ring, lambda a, b: F.coalesce(crosses(a, b), F.lit(0.0))) % 2 == 1


def convex(ring: Column) -> Column:
    """Whether a closed ring turns the same way at every vertex; straight ones don't count."""
    n = F.size(ring)
    after = F.concat(F.slice(ring, F.lit(2), n - 1), F.slice(ring, 2, 1))
    steps = F.zip_with(ring, after, lambda a, b: F.struct((b["x"] - a["x"]).alias("x"), (b["y"] - a["y"]).alias("y")))
    turns = F.zip_with(F.slice(steps, F.lit(1), n - 1), F.slice(steps, F.lit(2), n - 1), lambda a, b: a["x"] * b["y"] - a["y"] * b["x"])
    return (F.array_min(turns) > 0) | (F.array_max(turns) < 0)


def centroid(ring: Column) -> Column:
    cross = lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]
    six = signed_area(ring) * 6
    return F.struct((_edges(ring, lambda a, b: (a["x"] + b["x"]) * cross(a, b)) / six).alias("x"), (_edges(ring, lambda a, b: (a["y"] + b["y"]) * cross(a, b)) / six).alias("y"))


def centre(ring: Column, least_fill: float = 0.3) -> Column:
    """The middle of the bounding box, or the centroid where the ring fills too little of it."""
    box = bbox(ring)
    fill = F.try_divide(area(ring), (box["maxx"] - box["minx"]) * (box["maxy"] - box["miny"]))
    return F.when(fill < least_fill, centroid(ring)).otherwise(F.struct(((box["minx"] + box["maxx"]) / 2).alias("x"), ((box["miny"] + box["maxy"]) / 2).alias("y")))


def inner_point(ring: Column) -> Column:
    """A point inside: on the line at the box's mid-height, the middle of the widest stretch within; the first vertex if there is none."""
    n, box = F.size(ring), bbox(ring)
    y = (box["miny"] + box["maxy"]) / 2
    at = lambda a, b: F.when((a["y"] > y) != (b["y"] > y), a["x"] + (b["x"] - a["x"]) * F.try_divide(y - a["y"], b["y"] - a["y"]))
    xs = F.array_sort(F.array_compact(F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), at)))
    inside = F.filter(F.transform(xs, lambda x, i: F.struct((F.get(xs, i + 1) - x).alias("width"), x.alias("x"), i.alias("i"))), lambda s: s["i"] % 2 == 0)
    widest = F.array_max(inside)
    return F.when(F.size(xs) >= 2, F.struct((widest["x"] + widest["width"] / 2).alias("x"), y.alias("y"))).otherwise(F.struct(F.get(ring, F.lit(0))["x"].alias("x"), F.get(ring, F.lit(0))["y"].alias("y")))


def clip(a: Column, b: Column, box: Column) -> Column:
    """The part of a segment within a box as a struct of two points; null if there is none."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    sides = [(-dx, a["x"] - box["minx"]), (dx, box["maxx"] - a["x"]), (-dy, a["y"] - box["miny"]), (dy, box["maxy"] - a["y"])]
    enter = F.greatest(F.lit(0.0), *[F.when(p < 0, F.try_divide(q, p)) for p, q in sides])
    leave = F.least(F.lit(1.0), *[F.when(p > 0, F.try_divide(q, p)) for p, q in sides])
    outside = F.lit(False)
    for p, q in sides:
        outside = outside | ((p == 0) & (q < 0))
    point = lambda t: F.struct((a["x"] + t * dx).alias("x"), (a["y"] + t * dy).alias("y"))
    return F.when(~outside & (enter <= leave), F.struct(point(enter).alias("a"), point(leave).alias("b")))


def envelope(minx, miny, maxx, maxy) -> Column:
    """A box from four numbers or columns."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(*[lit(v).cast("double").alias(n) for n, v in zip(("minx", "miny", "maxx", "maxy"), (minx, miny, maxx, maxy))])


def srid_ok(srid: Column) -> Column:
    """The two systems that submissions may come in."""
    return F.coalesce(srid.isin(4326, 5179), F.lit(False))


# A polygon is an array of closed rings, the outer one first, then its holes; several parts are an array of polygons.

POLYGON = "array<array<struct<x:double,y:double>>>"


def polygon_area(polygon: Column) -> Column:
    """The outer ring's area less the holes'; 0 without rings."""
    sizes = F.transform(polygon, area)
    return F.aggregate(sizes, F.lit(0.0), lambda s, x: s - x, lambda s: F.coalesce(s + 2 * F.get(sizes, F.lit(0)), F.lit(0.0)))


def multi(polygon: Column) -> Column:
    """A polygon as one of several parts; null stays null, no rings are no parts."""
    return F.when(F.size(polygon) > 0, F.array(polygon)).when(polygon.isNotNull(), F.array().cast(f"array<{POLYGON}>"))


def multi_area(parts: Column) -> Column:
    return F.aggregate(F.transform(parts, polygon_area), F.lit(0.0), lambda s, x: s + x)


def vertices(parts: Column) -> Column:
    """All vertices of all rings, holes included."""
    return F.flatten(F.flatten(parts))


def on_edge(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies on a closed ring's edges."""
    def on(a: Column, b: Column) -> Column:
        cross = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
        between = x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))
        return ((cross == 0) & between).cast("double")

    return _edges(ring, on) > 0


def covers(polygon: Column, x: Column, y: Column) -> Column:
    """Whether a polygon meets a point: inside the outer ring and no hole, or on any edge."""
    inside = F.aggregate(F.transform(polygon, lambda r: contains(r, x, y).cast("int")), F.lit(0), lambda s, v: s + v)
    return (inside % 2 == 1) | F.exists(polygon, lambda r: on_edge(r, x, y))


def meets_box(polygon: Column, box: Column) -> Column:
    """Whether a polygon and a box share a point: an edge runs into the box, or the box's corner lies in the polygon."""
    def edge_inside(ring: Column) -> Column:
        n = F.size(ring)
        ends = F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.exists(ends, lambda e: clip(e["a"], e["b"], box).isNotNull())

    return F.exists(polygon, edge_inside) | covers(polygon, box["minx"], box["miny"])


def crosses_itself(ring: Column) -> Column:
    """Whether two edges of a closed ring cross at a point inside both: such rings need repair and are set apart. Edges are held
    against each other in the row, so this is for rings of some thousand vertices."""
    n = F.size(ring)
    edges = F.zip_with(F.slice(ring, F.lit(1), n - 1), F.slice(ring, F.lit(2), n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    side = lambda e, p: (e["b"]["x"] - e["a"]["x"]) * (p["y"] - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (p["x"] - e["a"]["x"])
    cross = lambda e, f: (side(e, f["a"]) * side(e, f["b"]) < 0) & (side(f, e["a"]) * side(f, e["b"]) < 0)
    return F.transform(F.array(edges), lambda es: F.exists(es, lambda e: F.exists(es, lambda f: cross(e, f))))[0]


def union_of_parts(parts: str) -> Column:
    """Aggregate: polygons of a group as one shape of several parts. Exact for parts that do not overlap, as rows of one code are."""
    return F.flatten(F.collect_list(F.col(parts)))


def rounded(parts: Column, digits: int) -> Column:
    return F.transform(parts, lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y")))))


def from_geojson(text: Column) -> Column:
    """The polygons of a GeoJSON geometry: those of a Polygon, a MultiPolygon or a GeometryCollection of them; lines and points are
    left out (empty array). Null for null or another text."""
    ring = "array<array<double>>"
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    shape = lambda parts: F.transform(parts, lambda polygon: F.transform(polygon, lambda r: F.transform(r, point)))
    empty = F.array().cast(f"array<{POLYGON}>")

    def of(kind: Column, coordinates: Column) -> Column:
        one = F.array(F.from_json(coordinates, f"array<{ring}>"))
        many = F.from_json(coordinates, f"array<array<{ring}>>")
        return F.when(kind == "Polygon", shape(one)).when(kind == "MultiPolygon", shape(many)).when(kind.isNotNull(), empty)

    members = F.from_json(F.get_json_object(text, "$.geometries"), "array<string>")
    collected = F.flatten(F.transform(members, lambda m: of(F.get_json_object(m, "$.type"), F.get_json_object(m, "$.coordinates"))))
    kind = F.get_json_object(text, "$.type")
    return F.when(kind == "GeometryCollection", F.coalesce(collected, empty)).otherwise(of(kind, F.get_json_object(text, "$.coordinates")))


def to_geojson(parts: Column) -> Column:
    """A MultiPolygon as GeoJSON text; null for no parts."""
    coordinates = F.transform(parts, lambda polygon: F.transform(polygon, lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))))
    return F.when(F.size(parts) > 0, F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), coordinates.alias("coordinates"))))


def projected(parts: Column) -> Column:
    """All vertices from longitude and latitude to metres."""
    return F.transform(parts, lambda polygon: F.transform(polygon, lambda r: F.transform(r, lambda p: project(p["x"], p["y"]))))


#: GRS80, and the parameters of the projected system.
A, FLAT, LON0, LAT0, K0, FE, FN = 6378137.0, 1 / 298.257222101, 127.5, 38.0, 0.9996, 1_000_000.0, 2_000_000.0
_N = FLAT / (2 - FLAT)
_RECT = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_C = 2 * math.sqrt(_N) / (1 + _N)


def _origin() -> float:
    s = math.sin(math.radians(LAT0))
    t = math.sinh(math.atanh(s) - _C * math.atanh(_C * s))
    xi = math.atan(t)
    return K0 * _RECT * (xi + sum(a * math.sin(2 * (j + 1) * xi) for j, a in enumerate(_ALPHA)))


def project(lon: Column, lat: Column) -> Column:
    """Longitude and latitude in degrees to metres, by the transverse Mercator (Krueger) series."""
    s, dl = F.sin(F.radians(lat)), F.radians(lon - LON0)
    t = F.sinh(F.atanh(s) - _C * F.atanh(_C * s))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    north, east = xi, eta
    for j, a in enumerate(_ALPHA, 1):
        north, east = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta), east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return F.struct((FE + K0 * _RECT * east).alias("x"), (FN - _origin() + K0 * _RECT * north).alias("y"))


def unproject(x: Column, y: Column) -> Column:
    xi, eta = (y - FN + _origin()) / (K0 * _RECT), (x - FE) / (K0 * _RECT)
    a, b = xi, eta
    for j, k in enumerate(_BETA, 1):
        a, b = a - k * F.sin(2 * j * xi) * F.cosh(2 * j * eta), b - k * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    lat = chi
    for j, k in enumerate(_DELTA, 1):
        lat = lat + k * F.sin(2 * j * chi)
    return F.struct((LON0 + F.degrees(F.atan2(F.sinh(b), F.cos(a)))).alias("lon"), F.degrees(lat).alias("lat"))


def world_to_pixel(x: Column, y: Column, left: Column, top: Column, step: Column) -> Column:
    """Half-even rounding, as the producer of the rasters does."""
    return F.struct(F.rint((x - left) / step).cast("long").alias("col"), F.rint((top - y) / step).cast("long").alias("row"))
