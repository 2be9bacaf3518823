"""Shapefiles, and operators on points and lines, on small fixtures."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from parcelflow.functions import geometry as G
from parcelflow.operators import spatial as P
from parcelflow.sources import shapefile

SQUARE, HOLE = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]


def shp(shapes):
    out = b""
    for k, rings in enumerate(shapes, 1):
        flat = [p for r in rings for p in r]
        starts = [sum(map(len, rings[:i])) for i in range(len(rings))]
        body = struct.pack("<i4d2i", 5, 0, 0, 0, 0, len(rings), len(flat)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in flat) if rings else struct.pack("<i", 0)
        out += struct.pack(">2i", k, len(body) // 2) + body
    return b"\0" * 100 + out


def dbf(rows, encoding):
    fields = b"".join(n.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([12, 0]) + b"\0" * 14 for n in ("ADM_CD", "ADM_NM"))
    head = struct.pack("<4B", 3, 0, 0, 0) + struct.pack("<IHH", len(rows), 32 + len(fields) + 1, 25) + b"\0" * 20 + fields + b"\r"
    return head + b"".join(flag + b"".join(v.encode(encoding).ljust(12) for v in row) for flag, *row in rows)


def test_shapefile(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.shp").write_bytes(shp([[SQUARE, HOLE], [], [SQUARE]]))
    (tmp_path / "d/a.dbf").write_bytes(dbf([(b" ", "37570360", "우곡면"), (b" ", "2", "x"), (b"*", "3", "y")], "cp949"))
    (tmp_path / "b.shp").write_bytes(shp([[SQUARE]]))
    (tmp_path / "c.shp").write_bytes(shp([]))
    rows = sorted(shapefile.shapes(spark, str(tmp_path)).collect(), key=lambda r: (r["path"], r["row_no"]))
    assert [(r["path"][-1], r["row_no"], r["attrs"], len(r["rings"])) for r in rows] == [("b", 0, {}, 1), ("a", 0, {"adm_cd": "37570360", "adm_nm": "우곡면"}, 2), ("a", 1, {"adm_cd": "2", "adm_nm": "x"}, 0)]
    assert [tuple(p) for p in rows[1]["rings"][1]] == HOLE
    (tmp_path / "b.dbf").write_bytes(dbf([(b" ", "1", "é")], "utf-8"))
    assert [r["attrs"]["adm_nm"] for r in shapefile.shapes(spark, str(tmp_path), ("ascii", "utf-8")).where("path like '%b'").collect()] == ["é"]


def ring(points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def test_points_of_rings(spark):
    u = [(0, 0), (9, 0), (9, 9), (8, 9), (8, 0.5), (1, 0.5), (1, 9), (0, 9), (0, 0)]  # a U that fills 27 % of its box
    got = spark.range(1).select(G.inner_point(ring(SQUARE)), G.inner_point(ring(u)), G.centre(ring(SQUARE)), G.centre(ring(u))["y"], G.inner_point(ring([(1, 1), (2, 1), (1, 1)])), G.convex(ring(SQUARE)), G.convex(ring(u))).first()
    assert tuple(got[0]) == (2, 2) and got[1]["y"] == 4.5 and got[1]["x"] in (0.5, 8.5)
    assert tuple(got[2]) == (2, 2) and got[3] < 4.5 and tuple(got[4]) == (1, 1) and (got[5], got[6]) == (True, False)


def test_clip(spark):
    box = F.struct(*[F.lit(v).alias(n) for n, v in (("minx", 0.0), ("miny", 0.0), ("maxx", 4.0), ("maxy", 4.0))])
    cut = lambda a, b: G.clip(ring([a])[0], ring([b])[0], box)
    got = spark.range(1).select(cut((-2, 2), (6, 2)), cut((-2, 5), (6, 5)), cut((1, 1), (2, 2)), cut((1, 1), (1, 1)), cut((5, 1), (5, 2))).first()
    assert [None if g is None else tuple(map(tuple, g)) for g in got] == [((0, 2), (4, 2)), None, ((1, 1), (2, 2)), ((1, 1), (1, 1)), None]


def test_points_along(spark):
    rows = spark.range(1).select(F.lit(1).alias("id"), ring([(0, 0), (3, 0), (3, 0), (3, 4)]).alias("l")).union(spark.range(1).select(F.lit(2), ring([(1, 1), (1, 1)])))
    got = sorted(map(tuple, P.points_along(rows, "id", "l", 1.5).collect()))
    assert got == [(1, 0, 0, 0), (1, 1, 1.5, 0), (1, 2, 3, 0), (1, 3, 3, 1.5), (1, 4, 3, 3), (2, 0, 1, 1)]
    assert P.points_along(rows.where("id = 3"), "id", "l", 1.5).count() == 0


def test_spaced_top(spark):
    points = spark.createDataFrame([("i", float(x), 0.0, d) for d, x in enumerate((0, 1, 5, 6, 11, 20))] + [("j", 0.0, 0.0, 1)], "img string, x double, y double, d int")
    got = sorted((r["img"], r["x"]) for r in P.spaced_top(points, "img", ["d"], 3, 5.0).collect())
    assert got == [("i", 0), ("i", 5), ("i", 11), ("j", 0)]


def test_similarity_fit(spark):
    a, b = 2 * math.cos(0.3), 2 * math.sin(0.3)
    pairs = spark.createDataFrame([(1, x, y, a * x - b * y + 7, b * x + a * y - 3) for x, y in ((0.0, 0.0), (1.0, 0.0), (2.0, 5.0), (-3.0, 1.0))] + [(2, 1.0, 1.0, 4.0, 4.0)], "g int, x double, y double, u double, v double")
    got = {r["g"]: r for r in P.similarity_fit(pairs, ["g"]).collect()}
    assert all(abs(p - q) < 1e-9 for p, q in zip(got[1][2:7], (a, b, 7, -3, 2))) and got[1]["rms"] < 1e-6 and got[2]["a"] is None


def test_polygons(spark):
    one = lambda *c: spark.range(1).select(*c).first()
    ring = lambda *p: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in (*p, p[0])])
    square, hole = ring((0, 0), (10, 0), (10, 10), (0, 10)), ring((4, 4), (6, 4), (6, 6), (4, 6))
    p = F.array(square, hole)
    at = lambda x, y: G.covers(p, F.lit(float(x)), F.lit(float(y)))
    assert tuple(one(at(1, 1), at(5, 5), at(10, 5), at(4, 5), at(11, 5), at(0, 0))) == (True, False, True, True, False, True)
    assert tuple(one(G.polygon_area(p), G.multi_area(G.multi(p)), F.size(G.vertices(G.multi(p))))) == (96.0, 96.0, 10)
    box = lambda *v: G.meets_box(p, G.envelope(*v))
    assert tuple(one(box(4.5, 4.5, 5, 5), box(4.5, 4.5, 7, 5), box(-1, -1, 20, 20), box(11, 0, 12, 1), box(1, 1, 2, 2))) == (False, True, True, False, True)
    bow = ring((0, 0), (2, 2), (2, 0), (0, 2))
    assert tuple(one(G.crosses_itself(square), G.crosses_itself(bow))) == (False, True)
    text = F.lit('{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,2]},{"type":"Polygon","coordinates":[[[0,0],[1,0],[0,1],[0,0]]]}]}')
    assert one(G.multi_area(G.from_geojson(text)))[0] == 0.5
    back = one(G.from_geojson(G.to_geojson(G.multi(p))).alias("a"), G.multi(p).alias("b"))
    assert back["a"] == back["b"]
    metres = one(G.projected(G.multi(F.array(ring((127.5, 38), (127.6, 38), (127.5, 38.1))))).alias("m"))["m"][0][0][0]
    assert abs(metres["x"] - 1_000_000) < 1e-6 and abs(metres["y"] - 2_000_000) < 1e-6


def test_touched_polygons(spark):
    rings = spark.createDataFrame([(1, 0.0), (2, 5.0), (3, 5.5)], "key int, o double")
    p = lambda dx, dy: F.struct((F.col("o") + dx).alias("x"), (F.col("o") + dy).alias("y"))
    rings = rings.withColumn("shape", F.array(F.array(p(0, 0), p(2, 0), p(2, 2), p(0, 2), p(0, 0))))
    lines = spark.createDataFrame([(1, [(1.0, 1.0), (9.0, 9.0)]), (2, [(6.0, 6.0)]), (3, [(3.0, 3.0)]), (4, [])], "id int, line array<struct<x:double,y:double>>")
    got = P.touched(lines, rings, "line", "shape").select("id", "key").collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 2), (2, 3)]


def test_simplified_keeps_the_tolerance(spark):
    r = random.Random(2)
    lines = [(k, [(float(i), r.uniform(-1, 1)) for i in range(60)]) for k in range(5)] + [(9, []), (10, [(1.0, 1.0)]), (11, [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)])]
    df = spark.createDataFrame(lines, "k int, line array<struct<x:double,y:double>>")
    got = {x["k"]: [tuple(q) for q in x["line"]] for x in P.simplified(df, "line", 0.8).collect()}
    assert got[11] == [(0.0, 0.0), (2.0, 0.0)] and got[9] == [] and got[10] == [(1.0, 1.0)]
    for k, line in lines[:5]:
        kept = got[k]
        assert 2 <= len(kept) < 60 and kept[0] == line[0] and kept[-1] == line[-1] and set(kept) <= set(line)
        for x, y in line:
            (a, b), (c, d) = next((p, q) for p, q in zip(kept, kept[1:]) if p[0] <= x <= q[0])
            assert abs(b + (d - b) * (x - a) / (c - a) - y) <= 0.8 * math.hypot(1, (d - b) / (c - a)) + 1e-9


def test_rasters(spark):
    rows = spark.createDataFrame([(1,)], "k int")
    ring = lambda *p: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in (*p, p[0])])
    shape = F.array(ring((1.2, 1.3), (8.7, 2.1), (7.1, 8.9), (0.4, 7.7)), ring((3.1, 3.2), (5.2, 3.1), (5.3, 5.9), (2.9, 5.2)))
    runs = P.raster_runs(rows.withColumn("s", shape), "s", 0.0, 10.0, 0.5, 20, 20).select("row", "first", "last").collect()
    got = {(x["row"], c) for x in runs for c in range(x["first"], x["last"] + 1)}
    want = set()
    for row in range(20):
        middles = spark.range(20).select("id", G.covers(shape, (F.col("id") + 0.5) * 0.5, F.lit(10.0 - (row + 0.5) * 0.5)).alias("in"))
        want |= {(row, x["id"]) for x in middles.where("in").collect()}
    assert got == want and len(got) > 100


def test_matches(spark):
    pairs = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 0.5), ("b", 2, 3.0), ("c", 2, 1.5), ("c", 1, 1.6)], "l string, r int, d double")
    assert sorted(tuple(x)[:2] for x in P.mutual_best(pairs, "l", "r", "d").collect()) == [("b", 1), ("c", 2)]
    assert sorted(tuple(x) for x in P.ratio_matches(pairs, "l", "r", "d").collect()) == [("a", 1, 1.0), ("b", 1, 0.5)]


def test_icp_finds_a_similarity(spark):
    import numpy as np

    r = np.random.default_rng(3)
    p = r.uniform(0, 100, 80) + 1j * r.uniform(0, 100, 80)
    m, t = 1.01 * np.exp(0.01j), 0.8 - 0.5j
    q = m * p + t
    rows = [("g", "source", float(z.real), float(z.imag)) for z in [*p, 500 + 500j]] + [("g", "target", float(z.real), float(z.imag)) for z in q] + [("h", "source", 1.0, 1.0)]
    got = {x["key"]: x for x in P.icp_fits(spark.createDataFrame(rows, "key string, kind string, x double, y double"), "key", gate=0.1).collect()}
    assert abs(got["g"]["a"] - m.real) < 1e-6 and abs(got["g"]["b"] - m.imag) < 1e-6 and abs(got["g"]["tx"] - t.real) < 1e-4 and got["g"]["accepted"]
    assert not got["h"]["accepted"]


def test_shift_by_correlation(spark):
    import numpy as np

    a = np.random.default_rng(4).random((32, 40))
    rows = [(k, a.tolist(), np.roll(a, (dy, dx), (0, 1)).tolist()) for k, (dx, dy) in enumerate([(0, 0), (5, -3), (-7, 9)])]
    got = P.shifts(spark.createDataFrame(rows, "k int, first array<array<double>>, second array<array<double>>"), "k").orderBy("k").collect()
    assert [(round(x["dx"]), round(x["dy"])) for x in got] == [(0, 0), (5, -3), (-7, 9)] and all(x["peak"] > 0.99 for x in got)


def test_placements(spark):
    rows = spark.createDataFrame([("u", 1, 0.0, 0.0, 10.0, 10.0), ("u", 2, 8.0, 0.0, 18.0, 10.0), ("u", 3, 30.0, -10.0, 40.0, 0.0)], "unit string, k int, a double, b double, c double, d double")
    got = P.placements(rows.select("unit", "k", G.envelope(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("box")), "unit", "k", "box", 0.5).orderBy("k").collect()
    assert [(x["left"], x["top"], x["right"], x["bottom"], x["covered"]) for x in got] == [(0, 0, 20, 20, [2]), (16, 0, 36, 20, []), (60, 20, 80, 40, [])]


def test_profiles(spark):
    values = [200.0] * 10 + [20.0, 30.0] + [200.0] * 2 + [10.0] + [200.0] * 30 + [100.0] + [200.0] * 5
    got = P.dark_frames(spark.createDataFrame([(values,)], "profile array<double>")).first()["runs"]
    assert [(x["first"], x["last"]) for x in got] == [(10, 14), (45, 45)] and got[0]["depth"] == 120.0
    assert spark.range(1).select(P.merged_lines(F.array(*map(F.lit, (1.0, 2.0, 10.0, 2.5))), 2.0)).first()[0] == [pytest.approx(5.5 / 3), 10.0]


def test_units_from_shapefile(spark, tmp_path):
    (tmp_path / "u.shp").write_bytes(shp([[SQUARE, HOLE]]))
    got = shapefile.units(spark, str(tmp_path)).select(F.size("polygons").alias("n"), F.size(F.col("polygons")[0]).alias("rings"), G.multi_area(F.col("polygons")).alias("area")).first()
    assert tuple(got) == (1, 2, 15.0)
