"""Sheets of a unit: grids, boxes, scales, gates on quadrilaterals, paths and times, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelflow.functions import geometry as G

#: Dots per inch of rendered pages; share of the shape by which an aspect may be off; gates on a found quadrilateral.
DPI, ASPECT_TOLERANCE = 300, 0.03
OPPOSITE, CORNER_COSINE, BODY_RATIO, COVERAGE = 0.10, 0.20, (0.78, 0.92), 0.30


def pixel_size(scale: Column, dpi: int = DPI) -> Column:
    """Metres a pixel of a page printed at 1:scale."""
    return F.lit(0.0254) * scale / F.lit(float(dpi))


def path_prefixes(code: Column) -> Column:
    """The folders of a unit: province and district."""
    return F.concat_ws("/", F.substring(code, 1, 2), F.substring(code, 1, 5))


def steps(labels: Column) -> Column:
    """Distinct label coordinates to the nearest 10, in order; halves go to the even ten."""
    return F.array_sort(F.array_distinct(F.transform(labels, lambda v: F.rint(v / 10) * 10)))


def nearest_step(lines: Column, at: Column) -> Column:
    """Index of the line nearest to a coordinate, the first of equals."""
    away = F.transform(lines, lambda v, i: F.struct(F.abs(v - F.rint(at / 10) * 10).alias("d"), i.alias("i")))
    return F.array_min(away)["i"]


def sheet_box(body: Column, cols: Column, rows: Column, col: Column, row: Column, width: Column, height: Column, scale: Column, dpi: int = DPI) -> Column:
    """World box of a sheet: its size in pixels at its own scale around the middle of its cell; the cell itself without a scale or size."""
    w, h = (body["maxx"] - body["minx"]) / cols, (body["maxy"] - body["miny"]) / rows
    cx, cy = body["minx"] + (col + 0.5) * w, body["maxy"] - (row + 0.5) * h
    half_w, half_h = width * pixel_size(scale, dpi) / 2, height * pixel_size(scale, dpi) / 2
    own = G.envelope(cx - half_w, cy - half_h, cx + half_w, cy + half_h)
    cell = G.envelope(body["minx"] + col * w, body["maxy"] - (row + 1) * h, body["minx"] + (col + 1) * w, body["maxy"] - row * h)
    return F.when(half_w.isNotNull() & half_h.isNotNull(), own).otherwise(cell)


def aspect(box: Column) -> Column:
    height = box["maxy"] - box["miny"]
    return F.when(height > 0, (box["maxx"] - box["minx"]) / height)


def grown_to_aspect(box: Column, page_w: Column, page_h: Column, expected: Column, tolerance: float = ASPECT_TOLERANCE) -> Column:
    """struct(x, y, w, h, deviation, axis) of a found box (x, y, w, h) that is grown where its aspect is off by more than the tolerance:
    too narrow ones in width, too flat ones in height, on the side with the larger margin (right or bottom if equal), as far as the
    page goes. axis is '' where nothing is grown."""
    x, y, w, h = (box[c] for c in "xywh")
    off = F.coalesce(F.when(expected.isNotNull() & (h > 0) & (w > 0), (w / h - expected) / expected), F.lit(0.0))
    need = F.when(off < 0, F.rint(h * expected) - w).otherwise(F.rint(w / expected) - h).cast("long")
    start, size, page = F.when(off < 0, x).otherwise(y), F.when(off < 0, w).otherwise(h), F.when(off < 0, page_w).otherwise(page_h)
    after = page - (start + size)
    grow_end = (after >= start) & (after > 0)
    side = F.when(F.abs(off) <= tolerance, "").when(grow_end, F.when(off < 0, "w(right)").otherwise("h(bot)")).when(start > 0, F.when(off < 0, "w(left)").otherwise("h(top)")).otherwise("")
    room = F.when(side.isin("w(right)", "h(bot)"), after).when(side != "", start).otherwise(F.lit(0))
    by = F.when(side == "", F.lit(0)).otherwise(F.least(need, room)).cast("long")
    back = F.when(side.isin("w(left)", "h(top)"), by).otherwise(F.lit(0))
    wide = off < 0
    return F.struct(
        (x - F.when(wide, back).otherwise(0)).cast("long").alias("x"), (y - F.when(wide, 0).otherwise(back)).cast("long").alias("y"),
        (w + F.when(wide, by).otherwise(0)).cast("long").alias("w"), (h + F.when(wide, 0).otherwise(by)).cast("long").alias("h"),
        off.alias("deviation"), side.alias("axis"),
    )


def quad_gate(corners: Column, page_w: Column, page_h: Column, coverage: Column) -> Column:
    """Why a found quadrilateral (four corners in order) is refused, or 'ok': its size against the page, opposite sides, angles, and
    how much of it the matches cover."""
    after = F.concat(F.slice(corners, 2, 3), F.slice(corners, 1, 1))
    sides = F.zip_with(corners, after, lambda a, b: F.struct((b["x"] - a["x"]).alias("x"), (b["y"] - a["y"]).alias("y")))

    def told(s: Column) -> Column:
        n = [F.hypot(s[i]["x"], s[i]["y"]) for i in range(4)]
        width, height = F.rint((n[0] + n[2]) / 2), F.rint((n[1] + n[3]) / 2)
        inside = (width / page_w).between(*BODY_RATIO) & (height / page_h).between(*BODY_RATIO)
        uneven = F.greatest(*[F.try_divide(F.abs(n[i] - n[i + 2]), F.greatest(n[i], n[i + 2])) for i in (0, 1)])
        cosine = F.greatest(*[F.abs(F.try_divide(s[i]["x"] * s[(i + 1) % 4]["x"] + s[i]["y"] * s[(i + 1) % 4]["y"], n[i] * n[(i + 1) % 4])) for i in range(4)])
        finite = F.forall(corners, lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")))
        return F.when(~finite, "not finite").when(coverage < COVERAGE, "coverage").when(~inside, "size").when(F.least(*n) <= 0, "side").when(uneven > OPPOSITE, "opposite sides").when(cosine > CORNER_COSINE, "angle").otherwise("ok")

    return F.transform(F.array(sides), told)[0]


def parsed_box(text: Column) -> Column:
    """The four numbers of 'BOX(minx miny,maxx maxy)'; null for anything else."""
    numbers = F.transform(F.split(F.regexp_extract(text, r"^BOX\(([^)]*)\)$", 1), "[ ,]+"), lambda v: v.try_cast("double"))
    return F.when(F.size(F.array_compact(numbers)) == 4, numbers)


def quoted(text: Column) -> Column:
    """Percent-encoded, blanks as %20; letters, digits and _.-~ stay."""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def object_url(bucket: str, key: Column) -> Column:
    return F.concat(F.lit(f"s3://{bucket}/"), key)


def tile_url(prefix: str, url: Column) -> Column:
    return F.concat(F.lit(f"{prefix}/cog/tiles/WebMercatorQuad/{{z}}/{{x}}/{{y}}.png?url="), quoted(url))


def object_key(code: Column) -> Column:
    return F.concat(F.lit("cog/"), path_prefixes(code), F.lit("/"), code, F.lit(".tif"))


def iso_time(at: Column) -> Column:
    """ISO 8601 with microseconds where there are any, in UTC."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, F.when(F.date_format(at, "SSSSSS") != "000000", F.concat(F.lit("."), F.date_format(at, "SSSSSS"))).otherwise(""), F.lit("+00:00"))


def local_time(text: Column, empty: str = "") -> Column:
    """An ISO time in UTC as local time to the minute; of a text that is none, its first 16 characters with a blank for the T."""
    at = F.try_to_timestamp(F.regexp_replace(text, r"(Z|\+00:00)$", ""))
    local = F.date_format(at + F.expr("INTERVAL 9 HOURS"), "yyyy-MM-dd HH:mm")
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(empty)).otherwise(F.coalesce(local, F.substring(F.regexp_replace(text, "^([^T]*)T", "$1 "), 1, 16)))


def form_problem(buffer: Column, srid: Column, code: Column) -> Column:
    """The first thing wrong with a request, null if nothing is. Limits of the buffer, systems, length of a code."""
    return F.when(F.length(code) != 8, "code").when(~buffer.between(0, 50_000), "buffer").when(~G.srid_ok(srid), "srid")
