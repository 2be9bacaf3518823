"""Polygons and attributes of shapefiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.functions import geometry as G

RINGS = "array<array<struct<x:double,y:double>>>"
#: Rows handed on at a time.
BATCH = 1000
#: Fixed values of the format: shape types of polygons, plain, with Z and with M.
POLYGONS = (5, 15, 25)


def polygons(raw: bytes):
    """The rings of each record of a .shp file, in order; none for an empty shape or one of another type."""
    import struct

    import numpy as np

    at = 100
    while at + 8 <= len(raw):
        size = 2 * struct.unpack_from(">i", raw, at + 4)[0]
        body, at = at + 8, at + 8 + size
        if struct.unpack_from("<i", raw, body)[0] not in POLYGONS:
            yield []
            continue
        n_parts, n_points = struct.unpack_from("<2i", raw, body + 36)
        cuts = np.frombuffer(raw, "<i4", n_parts, body + 44).tolist() + [n_points]
        xy = np.frombuffer(raw, "<f8", 2 * n_points, body + 44 + 4 * n_parts).reshape(-1, 2).tolist()
        yield [[{"x": x, "y": y} for x, y in xy[a:b]] for a, b in zip(cuts, cuts[1:])]


def attributes(raw: bytes, encodings: tuple[str, ...]):
    """The stripped fields of each record of a .dbf file by lower-case name, or None for one that is marked as deleted.

    The first encoding that fits the whole file is taken; the last one replaces what it can't read.
    """
    import struct

    n, head, width = struct.unpack_from("<IHH", raw, 4)
    fields, at = [], 1
    for i in range(32, head - 1, 32):
        if raw[i] == 0x0D:
            break
        size = raw[i + 16]
        fields.append((raw[i : i + 11].split(b"\0")[0].decode("ascii", "replace").lower(), at, at + size))
        at += size
    data = raw[head : head + n * width]
    for encoding in encodings[:-1]:
        try:
            data.decode(encoding)
        except UnicodeDecodeError:
            continue
        break
    else:
        encoding = encodings[-1]
    for k in range(0, n * width, width):
        row = data[k : k + width]
        yield None if row[:1] == b"*" else {name: row[a:b].decode(encoding, "replace").strip("\0 ") for name, a, b in fields}


def shapes(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("cp949", "utf-8")) -> DataFrame:
    """(path, row_no from 0, attrs map, rings): a row for each polygon record below path that is not deleted.

    A .shp file without a .dbf has empty attrs; records without a polygon have no rings. Files are read by Spark, so they may
    lie in any store; each is one row, which the format itself holds under 2 GB.
    """

    def files(kind: str) -> DataFrame:
        read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{kind}").load(path)
        return read.select(F.regexp_replace("path", r"\.[^.]*$", "").alias("path"), F.col("content").alias(kind))

    def parse(frames):
        import itertools

        import pandas as pd

        for frame in frames:
            for stem, shp, dbf in zip(frame["path"], frame["shp"], frame["dbf"]):
                told = attributes(dbf, encodings) if dbf is not None else itertools.repeat({})
                rows = ((stem, k, a, r) for k, (r, a) in enumerate(zip(polygons(shp), told)) if a is not None)
                while part := list(itertools.islice(rows, BATCH)):
                    yield pd.DataFrame(part, columns=["path", "row_no", "attrs", "rings"])

    both = files("shp").join(files("dbf"), "path", "left").select("path", "shp", "dbf")
    return both.mapInPandas(parse, f"path string, row_no long, attrs map<string,string>, rings {RINGS}")


def parts(rings: Column) -> Column:
    """The rings of a record as polygons: outer rings run clockwise, and a hole belongs to the outer ring that its first vertex lies in."""
    outer = F.filter(rings, lambda r: G.signed_area(r) < 0)
    holes = F.filter(rings, lambda r: G.signed_area(r) >= 0)
    return F.transform(outer, lambda o: F.concat(F.array(o), F.filter(holes, lambda h: G.contains(o, h[0]["x"], h[0]["y"]))))


def units(spark: SparkSession, path: str, code: str | None = None, to_metres: bool = False, **how) -> DataFrame:
    """(attrs as columns of attrs, polygons): unit polygons as shapes of several parts, perhaps only one unit's, perhaps projected."""
    rows = shapes(spark, path, **how)
    rows = rows if code is None else rows.where(F.col("attrs")["adm_cd"] == code)
    polygons = parts(F.col("rings"))
    return rows.select("attrs", (G.projected(polygons) if to_metres else polygons).alias("polygons"))
