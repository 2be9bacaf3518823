"""Queries with real shapes, computed keys, file names, gates and exports, on the analogue tables of `review`.

Parcels are diamonds with a diamond hole around points that the keys fix, so that SQL can say by a closed formula what the
operators find out from rings.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelflow.functions import geometry as G
from parcelflow.functions import sheets as H
from parcelflow.operators import codes as C
from parcelflow.operators import relational as R
from parcelflow.operators import spatial as P
from parcelflow.plans.review import query
from parcelflow.sources import files as N
from parcelflow.sources import readers as S
from parcelflow.sources import writers as K

#: The same expressions in both engines.
CX, CY, RADIUS, HOLE = "CAST(50 + gid % 11 AS DOUBLE)", "CAST(50 + gid % 7 AS DOUBLE)", "CAST(3.5 + gid % 13 AS DOUBLE)", "0.3"
PX, PY = "CAST(50.25 + adm_cd % 11 AS DOUBLE)", "CAST(50.125 + adm_cd % 7 AS DOUBLE)"
PATH = """concat('d', CAST(event_id % 7 AS STRING), CASE WHEN event_id % 11 = 0 THEN '/.ipynb_checkpoints/' ELSE '/' END, lpad(CAST(user_id * 7919 % 100000000 AS STRING), 8, '0'),
CASE WHEN event_id % 13 = 0 THEN '.pdf' ELSE concat('_', CAST(4 + 5 * (event_id % 2) AS STRING), '-', CAST(event_id % 9 + 1 AS STRING), CASE WHEN event_id % 5 = 0 THEN '_2' ELSE '' END, CASE event_id % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' ELSE '.pdf' END) END)"""
PARCEL = f"parcel AS (SELECT *, {CX} AS cx, {CY} AS cy, {RADIUS} AS r FROM boundary),"
POINT = f"point AS (SELECT adm_cd, {PX} AS x, {PY} AS y FROM node),"
PATHS = f"paths AS (SELECT {PATH} AS path FROM events),"
CONFIRMED = """confirmed AS (SELECT DISTINCT o_custkey AS adm_cd, coalesce(nullif(trim(CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END), ''), 'gid:' || o_orderkey) AS ri_cd FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'
UNION SELECT o_custkey, 'gid:' || (o_orderkey + 100000000) FROM orders WHERE o_orderkey % 5 = 0),"""


def _then(*ctes: str):
    """A decorator for a query whose SQL stands behind further common table expressions."""
    return lambda sql: query(", " + " ".join(ctes).rstrip(",") + " " + sql)


def diamond(cx, cy, r):
    point = lambda dx, dy: F.struct((cx + dx).alias("x"), (cy + dy).alias("y"))
    return F.array(point(r, F.lit(0.0)), point(F.lit(0.0), r), point(-r, F.lit(0.0)), point(F.lit(0.0), -r), point(r, F.lit(0.0)))


def parcels(t):
    rows = t.boundary.withColumns({"cx": F.expr(CX), "cy": F.expr(CY), "r": F.expr(RADIUS).cast("double")})
    cx, cy, r = F.col("cx"), F.col("cy"), F.col("r")
    return rows.withColumn("polygon", F.array(diamond(cx, cy, r), diamond(cx, cy, r * float(HOLE))))


def points(t):
    return t.node.select("adm_cd", F.expr(PX).cast("double").alias("x"), F.expr(PY).cast("double").alias("y"))


def confirmed(t):
    """Confirmations by unit and code, or gid:<gid> where the row has none; some of rows that no longer exist."""
    gone = t.boundary.where("gid % 5 = 0").select("adm_cd", F.concat(F.lit("gid:"), (F.col("gid") + 100000000).cast("string")).alias("ri_cd"))
    rows = t.boundary.join(t.confirm, "gid", "left_semi").select("adm_cd", R.confirm_key(F.col("ri_cd"), F.col("gid")).alias("ri_cd"))
    return rows.union(gone).distinct()


def paths(t):
    return t.events.select(F.expr(PATH).alias("path"))


@_then(PARCEL, POINT)("SELECT p.adm_cd, p.x, p.y, arg_min(gid, (2 * r * r - 2 * (0.3 * r) * (0.3 * r), gid)) AS gid FROM point p JOIN parcel b ON b.adm_cd = p.adm_cd AND abs(p.x - cx) + abs(p.y - cy) BETWEEN 0.3 * r AND r GROUP BY ALL")
def smallest_polygon(t):
    """The smallest parcel of the unit that holds each unit's point, holes left out."""
    return P.smallest_covering(points(t), parcels(t), "adm_cd", "gid")


@_then(PARCEL)("SELECT gid, round(2 * r * r - 2 * (0.3 * r) * (0.3 * r), 6) AS area, cx - r AS minx, cy + r AS maxy, 8 AS n_vertices FROM parcel")
def parcel_measures(t):
    p = parcels(t)
    box = G.bbox(F.col("polygon")[0])
    return p.select("gid", F.round(G.multi_area(G.multi(F.col("polygon"))), 6).alias("area"), box["minx"].alias("minx"), box["maxy"].alias("maxy"), F.size(F.array_distinct(G.vertices(G.multi(F.col("polygon"))))).alias("n_vertices"))


BOXES = "boxes AS (SELECT c_custkey AS adm_cd, c_custkey % 100 * 3 + 0.25 AS minx, c_custkey // 100 * 3 + 0.25 AS miny, c_custkey % 100 * 3 + 1.25 + c_custkey % 4 AS maxx, c_custkey // 100 * 3 + 1.25 + c_custkey % 3 AS maxy FROM customer),"


def unit_boxes(t):
    k = F.col("c_custkey")
    x, y = k % 100 * 3, F.floor(k / 100) * 3
    return t.customer.select(k.alias("adm_cd"), G.envelope(x + 0.25, y + 0.25, x + 1.25 + k % 4, y + 1.25 + k % 3).alias("box"))


@_then(BOXES)("SELECT a.adm_cd AS target, b.adm_cd FROM boxes a JOIN boxes b ON a.minx - 2 <= b.maxx AND a.maxx + 2 >= b.minx AND a.miny - 2 <= b.maxy AND a.maxy + 2 >= b.miny")
def units_around(t):
    """For each unit, all whose box meets its own, expanded by a buffer."""
    boxes = unit_boxes(t)
    return P.around(boxes, "adm_cd", "box", boxes, 2.0)


@_then(BOXES)("SELECT adm_cd FROM boxes WHERE minx <= 60 AND maxx >= 10.5 AND miny <= 20 AND maxy >= 5")
def units_in_window(t):
    return unit_boxes(t).where(G.overlaps(F.col("box"), G.envelope(10.5, 5, 60, 20))).select("adm_cd")


@_then(PARCEL)("SELECT gid FROM parcel WHERE greatest(52.1 - cx, 0, cx - 53.3) + greatest(51.2 - cy, 0, cy - 52.6) <= r AND greatest(abs(52.1 - cx), abs(53.3 - cx)) + greatest(abs(51.2 - cy), abs(52.6 - cy)) >= 0.3 * r")
def parcels_meeting_box(t):
    """Parcels that share a point with a search box; one that lies in a hole shares none."""
    return P.meeting_box(parcels(t), "polygon", G.envelope(52.1, 51.2, 53.3, 52.6)).select("gid")


@_then(PARCEL)("SELECT DISTINCT m.id, p.gid FROM (SELECT id, adm_cd, unnest([0, 1, 2, 3]) AS k FROM markup WHERE id % 20 = 3) m JOIN parcel p ON p.gid % 10 = 1 AND abs(40.03 + m.id % 31 + 0.7 * k - cx) + abs(47.02 + m.id % 17 + 0.3 * k - cy) BETWEEN 0.3 * r AND r AND m.adm_cd = p.adm_cd")
def parcels_hit(t):
    """Parcels of a request's unit that one of its sampled points lies in."""
    at = lambda k: F.struct((F.lit(40.03) + F.col("id") % 31 + 0.7 * k).alias("x"), (F.lit(47.02) + F.col("id") % 17 + 0.3 * k).alias("y"))
    lines = t.markup.where("id % 20 = 3").select("id", F.col("adm_cd").alias("unit"), F.array(*[at(k) for k in range(4)]).alias("line"))
    # the unit is an equi-join key here, so boxes need no grid
    met = lines.join(parcels(t).where("gid % 10 = 1").select("gid", "polygon", F.col("adm_cd").alias("unit")), "unit")
    return met.where(F.exists("line", lambda p: G.covers(F.col("polygon"), p["x"], p["y"]))).select("id", "gid")


@_then(CONFIRMED)("SELECT gid, b.adm_cd, coalesce(nullif(trim(b.ri_cd), ''), 'gid:' || gid) AS confirm_key, c.ri_cd IS NOT NULL AS confirmed FROM boundary b LEFT JOIN confirmed c ON c.adm_cd = b.adm_cd AND c.ri_cd = coalesce(nullif(trim(b.ri_cd), ''), 'gid:' || gid)")
def confirmed_by_key(t):
    """Rows of one unit that share a code share its confirmation; rows without a code have their own."""
    keyed = t.boundary.select("gid", "adm_cd", R.confirm_key(F.col("ri_cd"), F.col("gid")).alias("confirm_key"))
    c = confirmed(t).select("adm_cd", F.col("ri_cd").alias("confirm_key"), F.lit(True).alias("c"))
    return keyed.join(c, ["adm_cd", "confirm_key"], "left").select("gid", "adm_cd", "confirm_key", F.col("c").isNotNull().alias("confirmed"))


@_then(CONFIRMED)("SELECT b.adm_cd, b.gid FROM boundary b JOIN confirmed c ON c.adm_cd = b.adm_cd AND c.ri_cd = 'gid:' || b.gid WHERE b.ri_cd IS NULL OR trim(b.ri_cd) = ''")
def confirmed_without_code(t):
    """Confirmations that must be carried over when a unit is replaced."""
    blank = t.boundary.where(~R.non_blank(F.col("ri_cd"))).select("adm_cd", "gid", F.concat(F.lit("gid:"), F.col("gid").cast("string")).alias("ri_cd"))
    return blank.join(confirmed(t), ["adm_cd", "ri_cd"], "left_semi").select("adm_cd", "gid")


@_then(CONFIRMED)("SELECT adm_cd, ri_cd FROM confirmed c WHERE starts_with(ri_cd, 'gid:') AND NOT EXISTS (SELECT 1 FROM boundary b WHERE b.adm_cd = c.adm_cd AND 'gid:' || b.gid = c.ri_cd)")
def orphan_keys(t):
    """Confirmations of rows that no longer exist."""
    c = confirmed(t).where(F.col("ri_cd").startswith("gid:"))
    return c.join(t.boundary.select("adm_cd", F.concat(F.lit("gid:"), F.col("gid").cast("string")).alias("ri_cd")), ["adm_cd", "ri_cd"], "left_anti")


NAME = "regexp_extract(path, '([^/]*)$', 1)"
SHEET = r"^(\d{8})_(\d+)-(\d+)(?:_\d+)?\.(?:jpg|jpeg|png)$"


@_then(PATHS)(rf"SELECT CASE WHEN sheet THEN 'split' ELSE 'main' END AS kind, left(name, 8) AS adm_cd, CASE WHEN sheet THEN regexp_extract(name, '_(\d+-\d+)', 1) END AS sheet_id, max(path) AS path FROM (SELECT path, {NAME} AS name, contains(path, '_') AND NOT regexp_matches(path, '/\d{{8}}\.pdf$') AS sheet FROM paths) WHERE regexp_matches(name, '^\d{{8}}(_\d+-\d+)?\.pdf$') GROUP BY ALL")
def document_files(t):
    """Whole-unit documents and their sheets, by name."""
    return N.documents(paths(t))


@_then(PATHS)(rf"SELECT regexp_extract(name, '{SHEET}', 1) AS adm_cd, regexp_extract(name, '{SHEET}', 2)::INTEGER AS n, regexp_extract(name, '{SHEET}', 3)::INTEGER AS i, max(path) AS path FROM (SELECT path, {NAME} AS name FROM paths WHERE NOT contains(path, '.ipynb_checkpoints')) WHERE regexp_matches(name, '{SHEET}') GROUP BY ALL")
def body_files(t):
    return N.bodies(paths(t)).orderBy("adm_cd", *N.sheet_order())


@_then(PATHS)(rf"SELECT regexp_extract(name, '{SHEET}', 1) AS adm_cd, regexp_extract(name, '{SHEET}', 2)::INTEGER AS n, regexp_extract(name, '{SHEET}', 3)::INTEGER AS i, list(path ORDER BY path) AS paths, count(*) AS copies FROM (SELECT path, {NAME} AS name FROM paths WHERE NOT contains(path, '.ipynb_checkpoints')) WHERE regexp_matches(name, '{SHEET}') GROUP BY 1, 2, 3 HAVING count(*) > 1")
def duplicate_bodies(t):
    return N.duplicate_sheets(paths(t))


@_then(PATHS)("SELECT path FROM paths WHERE ends_with(path, '.pdf') OR regexp_replace(path, '\\.[^./]*$', '') NOT IN (SELECT regexp_replace(path, '\\.[^./]*$', '') FROM paths WHERE ends_with(path, '.pdf'))")
def images_without_document(t):
    return N.documents_over_images(paths(t))


@_then(PATHS)(f"SELECT DISTINCT left({NAME}, 8) AS adm_cd FROM paths")
def codes_of_files(t):
    return N.unit_codes(paths(t))


@query("""SELECT number, slot, kind, CASE kind WHEN 'shp' THEN min(CASE WHEN ends_with(path, '.shp') THEN path END) WHEN 'xlsx' THEN coalesce(min(CASE WHEN ends_with(path, '.xlsx') THEN path END), min(CASE WHEN ends_with(path, '.xlsm') THEN path END)) ELSE min(CASE WHEN ends_with(path, '.jpg') THEN regexp_replace(path, '/[^/]*$', '') END) END AS found
FROM (VALUES ('01', 'units', 'shp'), ('02', 'roster', 'xlsx'), ('03', 'images', 'raster_dir'), ('77', 'none', 'shp')) AS w(number, slot, kind) LEFT JOIN (SELECT 'work/' || lpad((s_suppkey % 4)::VARCHAR, 2, '0') || '_x/f' || s_suppkey || ['.shp', '.xlsm', '.xlsx', '.jpg'][s_suppkey % 5 % 4 + 1] AS path FROM supplier) ON substr(path, 6, 2) = number GROUP BY number, slot, kind""")
def work_slots(t):
    """What lies in the numbered folders of a work folder."""
    ending = F.element_at(F.array(*map(F.lit, (".shp", ".xlsm", ".xlsx", ".jpg"))), (F.col("s_suppkey") % 5 % 4 + 1).cast("int"))
    files = t.supplier.select(F.concat(F.lit("work/"), F.lpad((F.col("s_suppkey") % 4).cast("string"), 2, "0"), F.lit("_x/f"), F.col("s_suppkey").cast("string"), ending).alias("path"))
    wanted = t.spark.createDataFrame([("01", "units", "shp"), ("02", "roster", "xlsx"), ("03", "images", "raster_dir"), ("77", "none", "shp")], "number string, slot string, kind string")
    return N.slots(files, wanted)


@query("SELECT gid, adm_cd, ri_cd, status FROM boundary WHERE status IN ('F', 'P') AND ri_cd IS NOT NULL")
def succeeded_rows(t):
    """Rows of a status table that succeeded and are named."""
    return S.succeeded(t.boundary.select("gid", "adm_cd", "ri_cd", "status"), ("F", "P"), ("adm_cd", "ri_cd"))


@query("SELECT c_mktsegment AS role, count(*) AS n FROM customer GROUP BY 1")
def accounts_by_role(t):
    return t.customer.groupBy(F.col("c_mktsegment").alias("role")).agg(F.count("*").alias("n")).orderBy("role")


@query("SELECT status, count(*) AS n, count(*) FILTER (upper(kind) = 'CLICK') AS done FROM markup GROUP BY status")
def status_tallies(t):
    return t.markup.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.upper("kind") == "CLICK").alias("done"))


@query("SELECT adm_cd, kind, votes, height FROM (SELECT adm_cd, kind, count(*) AS votes, max(value) AS height FROM markup GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY adm_cd ORDER BY votes DESC, height DESC, kind) = 1")
def votes_by_height(t):
    """The candidate with most votes, then the greatest height."""
    votes = t.markup.groupBy("adm_cd", "kind").agg(F.count("*").alias("votes"), F.max("value").alias("height"))
    return R.top1(votes, ["adm_cd"], [-F.col("votes"), -F.col("height"), F.col("kind")])


@query("SELECT adm_cd, arg_min(prefix, (-n, prefix)) AS prefix FROM (SELECT adm_cd, split_part(ri_cd, '-', 1) AS prefix, count(*) AS n FROM boundary WHERE ri_cd IS NOT NULL GROUP BY ALL) GROUP BY adm_cd")
def common_prefix(t):
    """The prefix that most codes of a unit have."""
    n = t.boundary.where("ri_cd IS NOT NULL").groupBy("adm_cd", F.split_part("ri_cd", F.lit("-"), F.lit(1)).alias("prefix")).agg(F.count("*").alias("n"))
    return n.groupBy("adm_cd").agg(F.min_by("prefix", F.struct(-F.col("n"), "prefix")).alias("prefix"))


@query("SELECT gid, adm_cd, row_number() OVER (PARTITION BY adm_cd ORDER BY ri_cd NULLS LAST, gid) AS place FROM boundary")
def listed_by_code(t):
    """Rows of a unit by code, those without one last."""
    from pyspark.sql import Window as W

    return t.boundary.select("gid", "adm_cd", F.row_number().over(W.partitionBy("adm_cd").orderBy(F.asc_nulls_last("ri_cd"), "gid")).cast("long").alias("place"))


@query("SELECT adm_cd, list(gid ORDER BY price DESC, gid) AS gids, arg_max(gid, (price, -gid)) AS largest FROM boundary GROUP BY adm_cd")
def by_size(t):
    rows = F.array_sort(F.collect_list(F.struct((-F.col("price")).alias("p"), "gid")))
    return t.boundary.groupBy("adm_cd").agg(rows.alias("r")).select("adm_cd", F.col("r.gid").alias("gids"), F.col("r")[0]["gid"].alias("largest"))


@query("SELECT adm_cd, list(gid ORDER BY hash_at, gid)[:3] AS gids FROM (SELECT adm_cd, gid, gid * 2654435761 % 4294967296 AS hash_at FROM boundary) GROUP BY adm_cd")
def seeded_sample(t):
    """At most three rows of each unit in a fixed pseudorandom order: a sampling operator."""
    rows = F.array_sort(F.collect_list(F.struct((F.col("gid").cast("long") * 2654435761 % 4294967296).alias("h"), "gid")))
    return t.boundary.groupBy("adm_cd").agg(rows.alias("r")).select("adm_cd", F.slice(F.col("r.gid"), 1, 3).alias("gids"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 <> 0 THEN '.' || lpad((microsecond(ts) % 1000000)::VARCHAR, 6, '0') ELSE '' END || '+00:00' AS iso, CASE event_id % 3 WHEN 0 THEN strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') WHEN 1 THEN 'not a time ' || event_id % 10 ELSE '' END AS local FROM events")
def times_as_text(t):
    """ISO times, and local times with what is left of texts that are none."""
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("not a time "), (F.col("event_id") % 10).cast("string")))
    return t.events.select("event_id", H.iso_time(F.col("ts")).alias("iso"), H.local_time(text).alias("local"))


CODE = "lpad(CAST(c_custkey * 7919 % 100000000 AS STRING), 8, '0')"


@query(f"SELECT c_custkey, left(code, 2) || '/' || left(code, 5) AS folder, 's3://maps/cog/' || left(code, 2) || '/' || left(code, 5) || '/' || code || '.tif' AS url, '/t/cog/tiles/WebMercatorQuad/{{z}}/{{x}}/{{y}}.png?url=' || replace(replace(replace(c_name || ' ~*', ' ', '%20'), '*', '%2A'), '#', '%23') AS tiles, [CAST(c_custkey % 10 AS DOUBLE), -1.5, 30.0, CAST(c_custkey AS DOUBLE)]::DOUBLE[] AS box FROM (SELECT *, {CODE} AS code FROM customer)")
def object_paths(t):
    rows = t.customer.select("c_custkey", "c_name", F.expr(CODE).alias("code"))
    box = F.concat(F.lit("BOX("), (F.col("c_custkey") % 10).cast("string"), F.lit(" -1.5,30 "), F.col("c_custkey").cast("string"), F.lit(")"))
    return rows.select("c_custkey", H.path_prefixes(F.col("code")).alias("folder"), H.object_url("maps", H.object_key(F.col("code"))).alias("url"), H.tile_url("/t", F.concat("c_name", F.lit(" ~*"))).alias("tiles"), H.parsed_box(box).alias("box"))


@query("SELECT p_partkey, CASE WHEN length(code) <> 8 THEN 'code' WHEN buffer NOT BETWEEN 0 AND 50000 THEN 'buffer' WHEN srid NOT IN (4326, 5179) THEN 'srid' END AS problem FROM (SELECT p_partkey, left('123456789', 8 + (p_partkey % 7 = 0)::INT) AS code, p_retailprice * 40 - 1000 AS buffer, CASE p_partkey % 3 WHEN 0 THEN 4326 WHEN 1 THEN 5179 ELSE 3857 END AS srid FROM part)")
def request_problems(t):
    srid = F.when(F.col("p_partkey") % 3 == 0, 4326).when(F.col("p_partkey") % 3 == 1, 5179).otherwise(3857)
    code = F.when(F.col("p_partkey") % 7 == 0, "123456789").otherwise("12345678")
    return t.part.select("p_partkey", H.form_problem(F.col("p_retailprice") * 40 - 1000, srid, code).alias("problem"))


@query("""SELECT p_partkey, CASE WHEN abs(off) <= 0.03 THEN '' WHEN off < 0 AND 1000 - (x + w) >= x AND 1000 - (x + w) > 0 THEN 'w(right)' WHEN off < 0 AND x > 0 THEN 'w(left)' WHEN off > 0 AND 800 - (y + h) >= y AND 800 - (y + h) > 0 THEN 'h(bot)' WHEN off > 0 AND y > 0 THEN 'h(top)' ELSE '' END AS axis,
(w + CASE axis WHEN 'w(right)' THEN least(round_even(h * 1.3, 0) - w, 1000 - (x + w)) WHEN 'w(left)' THEN least(round_even(h * 1.3, 0) - w, x) ELSE 0 END)::BIGINT AS w, (h + CASE axis WHEN 'h(bot)' THEN least(round_even(w0 / 1.3, 0) - h, 800 - (y + h)) WHEN 'h(top)' THEN least(round_even(w0 / 1.3, 0) - h, y) ELSE 0 END)::BIGINT AS h
FROM (SELECT p_partkey, p_partkey % 300 AS x, p_partkey % 170 AS y, 300 + p_partkey % 390 AS w, w AS w0, 250 + p_size * 5 AS h, (w::DOUBLE / h - 1.3) / 1.3 AS off FROM part)""")
def grown_boxes(t):
    """Found boxes whose aspect is off are grown on the side with more room."""
    k = F.col("p_partkey")
    box = F.struct((k % 300).alias("x"), (k % 170).alias("y"), (300 + k % 390).alias("w"), (250 + F.col("p_size") * 5).alias("h"))
    g = t.part.select("p_partkey", H.grown_to_aspect(box, F.lit(1000), F.lit(800), F.lit(1.3)).alias("g"))
    return g.select("p_partkey", "g.axis", "g.w", "g.h")


@query("""SELECT p_partkey, [10.0, 40.0, 90.0]::DOUBLE[] AS lines, CASE WHEN x <= 25 THEN 0 WHEN x <= 65 THEN 1 ELSE 2 END AS col, round(0.0254::DOUBLE * p_size * 1000 / 300, 9) AS step, round(100 + (col + 0.5::DOUBLE) * 100 - CASE WHEN p_partkey % 2 = 0 THEN 500 * 0.0254::DOUBLE * p_size * 1000 / 300 / 2 ELSE 50 END, 6) AS minx FROM (SELECT p_partkey, p_size, round_even(p_partkey % 100 / 10.0, 0) * 10 AS x FROM part)""")
def sheet_grids(t):
    """Labels on the lines of a grid, and the box of a sheet by its scale, its cell without one."""
    labels = F.array(*[F.lit(v) for v in (88.0, 11.0, 9.0, 42.0, 38.0, 91.0)])
    rows = t.part.withColumn("lines", H.steps(labels)).withColumn("col", H.nearest_step(F.col("lines"), F.col("p_partkey") % 100))
    scale = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") * 1000)
    box = H.sheet_box(G.envelope(100, 0, 400, 200), F.lit(3), F.lit(2), F.col("col"), F.lit(1), F.lit(500), F.lit(400), scale)
    return rows.select("p_partkey", "lines", "col", F.round(H.pixel_size(F.col("p_size") * 1000), 9).alias("step"), F.round(box["minx"], 6).alias("minx"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 100 < 30 THEN 'coverage' WHEN w / 1000 NOT BETWEEN 0.78 AND 0.92 OR h / 800 NOT BETWEEN 0.78 AND 0.92 THEN 'size' WHEN skew > 0.2 THEN 'angle' ELSE 'ok' END AS gate FROM (SELECT p_partkey, 760.0 + p_partkey % 200 AS w, round_even(sqrt((600.0 + p_size * 3) ** 2 + (p_partkey % 151) ** 2), 0) AS h, (p_partkey % 151) / sqrt((600.0 + p_size * 3) ** 2 + (p_partkey % 151) ** 2) AS skew FROM part)")
def quad_gates(t):
    """Slanted quadrilaterals: covered too little, of a wrong size, or too far from right angles."""
    w, h, s = F.lit(760.0) + F.col("p_partkey") % 200, F.lit(600.0) + F.col("p_size") * 3, (F.col("p_partkey") % 151).cast("double")
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    corners = F.array(p(F.lit(0), F.lit(0)), p(w, F.lit(0)), p(w + s, h), p(s, h))
    return t.part.select("p_partkey", H.quad_gate(corners, F.lit(1000.0), F.lit(800.0), F.col("p_partkey") % 100 / 100).alias("gate"))


@query("SELECT gid, CASE gid % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 0 END AS parts, CASE gid % 4 WHEN 0 THEN 2.0 * (gid % 9 + 1) WHEN 1 THEN gid % 9 + 1 + 0.5 WHEN 2 THEN 0.0 END::DOUBLE AS area FROM boundary")
def geojson_shapes(t):
    """Polygons of GeoJSON geometries; lines have no parts, null stays null."""
    s = (F.col("gid") % 9 + 1).cast("string")
    one = F.concat(F.lit('{"type":"Polygon","coordinates":[[[0,0],['), s, F.lit(",0],["), s, F.lit(",2],[0,2],[0,0]]]}"))
    two = F.concat(F.lit('{"type":"MultiPolygon","coordinates":[[[[0,0],['), s, F.lit(",0],[0,2],[0,0]]],[[[9,9],[10,9],[10,10],[9,9]]]]}"))
    text = F.when(F.col("gid") % 4 == 0, one).when(F.col("gid") % 4 == 1, two).when(F.col("gid") % 4 == 2, F.lit('{"type":"LineString","coordinates":[[0,0],[1,1]]}'))
    shape = t.boundary.select("gid", G.from_geojson(text).alias("s"))
    return shape.select("gid", F.when(F.col("s").isNotNull(), F.size("s")).alias("parts"), G.multi_area(F.col("s")).alias("area"))


@_then(PARCEL)("SELECT adm_cd, ri_cd, CASE WHEN ri_cd IS NULL THEN gid END AS row_no, count(*) AS parts, round(sum(2 * r * r * 0.91::DOUBLE), 4) AS area, coalesce(max(nullif(status, 'O')), 'draft') AS status FROM parcel GROUP BY ALL")
def united_parcels(t):
    """Rows of one code as one shape of several parts."""
    own = F.when(F.col("ri_cd").isNull(), F.col("gid")).alias("row_no")
    rows = parcels(t).withColumn("parts", G.multi(F.col("polygon")))
    rows = rows.groupBy("adm_cd", "ri_cd", own).agg(G.union_of_parts("parts").alias("g"), F.coalesce(F.max(F.nullif("status", F.lit("O"))), F.lit("draft")).alias("status"))
    return rows.select("adm_cd", "ri_cd", "row_no", F.size("g").cast("long").alias("parts"), F.round(G.multi_area(F.col("g")), 4).alias("area"), "status")


@_then(PARCEL)("SELECT gid, adm_cd, 2 * r * r - 2 * (0.3 * r) * (0.3 * r) AS a, '' AS \"REMARK\", round_even(2 * r * r - 2 * (0.3 * r) * (0.3 * r), 0)::BIGINT AS area FROM parcel WHERE adm_cd = 7")
def job_seed(t):
    """The seed of one unit's work layer."""
    rows = parcels(t).select("gid", "adm_cd", G.multi(F.col("polygon")).alias("polygons"))
    rows = K.job_rows(rows, "7")
    return rows.select("gid", "adm_cd", G.multi_area(F.col("polygons")).alias("a"), "REMARK", "area")


@query("SELECT o_custkey AS adm_cd, NULL::VARCHAR AS ri_nm, o_totalprice AS price FROM orders WHERE o_custkey IN (SELECT s_suppkey FROM supplier)")
def seeded_layer(t):
    """Unit rows into a work layer: common columns only, whatever the case."""
    work = t.spark.createDataFrame([], "adm_cd long, ri_nm string, price double")
    units = t.orders.select(F.col("o_custkey").alias("ADM_CD"), F.col("o_totalprice").alias("Price"), F.lit(1).alias("other"))
    return K.seeded(work, units, t.supplier.select(F.col("s_suppkey").alias("adm_cd")))


@query("SELECT adm_cd, kind, coalesce(json_extract_string(props, '$.k'), '') AS note, id FROM markup WHERE status IN ('pending', 'applied') AND kind IN ('click', 'view', 'signup')")
def flat_export(t):
    """A unit's requests for export, attributes flattened."""
    rows = t.markup.where(F.col("status").isin("pending", "applied") & F.col("kind").isin("click", "view", "signup"))
    return rows.select("adm_cd", "kind", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("note"), "id")


@query("SELECT adm_cd, count(*) AS n, min(id) AS first_id FROM markup GROUP BY adm_cd")
def collections_read_back(t):
    """Feature collections by unit, parsed again."""
    made = S.feature_collection(t.markup, ["adm_cd"], ["kind", "status"], "id", F.to_json(F.struct(F.lit("Point").alias("type"), F.array(F.col("id") % 180, F.lit(1)).alias("coordinates"))))
    back = made.select("adm_cd", F.from_json("geojson", "type string, features array<struct<id:bigint,type:string,geometry:string>>").alias("c"))
    return back.select("adm_cd", F.size("c.features").cast("long").alias("n"), F.array_min("c.features.id").alias("first_id"))


@query("SELECT 'user' || lpad(c_custkey::VARCHAR, 9, '0')[:4] AS admin_cd, CASE WHEN c_custkey % 3 = 0 THEN '10.0.0.' || c_custkey % 250 ELSE '192.0.2.1' END AS ip FROM customer")
def login_audit(t):
    """Audit rows of attempts: the first eight characters of the login, the first forwarded address, else the peer's."""
    k = F.col("c_custkey")
    forwarded = F.when(k % 3 == 0, F.concat(F.lit("10.0.0."), (k % 250).cast("string"), F.lit(", 172.16.0.1"))).when(k % 3 == 1, "")
    rows = t.customer.select(F.concat(F.lit("user"), F.lpad(k.cast("string"), 9, "0")).alias("login"), forwarded.alias("forwarded"), F.lit("192.0.2.1").alias("peer"), F.lit("agent").alias("user_agent"), F.lit(None).cast("timestamp").alias("ts"), F.lit(True).alias("ok"))
    return K.login_rows(rows).select("admin_cd", "ip")


@query("SELECT adm_cd, adm_nm, contains(lower(adm_nm), '0007') OR contains(adm_cd::VARCHAR, '0007') AS by_name, contains(adm_nm, 'Customer') AS as_written, contains(lower(concat_ws(' ', adm_cd, adm_nm, sgg_nm)), 'nation_3') AS anywhere FROM node")
def search_variants(t):
    """The three searches: code or name in any case, name as written, all columns in any case."""
    rows = t.node.select("adm_cd", "adm_nm", "sgg_nm")
    return rows.select("adm_cd", "adm_nm", R.found_in("0007", ["adm_nm", "adm_cd"], any_case=True).alias("by_name"), R.found_in("Customer", ["adm_nm"]).alias("as_written"), R.found_in("NATION_3", ["adm_cd", "adm_nm", "sgg_nm"], any_case=True, joined=True).alias("anywhere"))


@query("SELECT id, adm_cd, kind, status FROM markup WHERE adm_cd = 7 AND status = 'pending'")
def filtered_by_request(t):
    """A conjunction of the conditions that a request names, of those that may be named."""
    return R.where_named(t.markup.select("id", "adm_cd", "kind", "status"), {"adm_cd": 7, "status": "pending", "kind": None, "value": 3}, {"adm_cd", "status", "kind"})


TIERED = """CASE p_partkey % 8 WHEN 0 THEN concat('가나 동', CAST(p_partkey AS STRING), '( ', substr(code, 1, 4), ' ', substr(code, 5), ' )') WHEN 1 THEN concat('code (', code, ')') WHEN 2 THEN concat('동', CAST(p_partkey AS STRING), '.', substr(code, 1, 7))
WHEN 3 THEN concat('동 ', CAST(p_partkey AS STRING), '. 99', substr(code, 3)) WHEN 4 THEN concat('동', CAST(p_partkey AS STRING), '.') WHEN 5 THEN concat('no ', substr(code, 1, 3), substr(code, 5)) WHEN 6 THEN concat(substr(code, 1, 3), '-', substr(code, 4)) ELSE 'nothing' END"""


def recognised(t):
    """(texts, units, valid): recognised texts of several kinds, units with names, and the codes that there are documents of."""
    units = t.part.select("p_partkey", F.expr("lpad(CAST(p_partkey * 7919 % 100000000 AS STRING), 8, '0')").alias("code"), F.concat(F.lit("동"), F.col("p_partkey").cast("string"), F.lit(".")).alias("name"))
    return units.select("p_partkey", F.expr(TIERED).alias("t")), units.select("code", "name"), units.where("p_partkey % 10 <> 3").select("code")


@query()
def text_code_tiers(t):
    """The codes of recognised texts by the best evidence; a test holds them against a slow reading."""
    texts, units, valid = recognised(t)
    return C.tiered_codes(texts, "p_partkey", "t", units, valid)


@query("SELECT adm_cd, ri_cd, gid, coalesce(a.name, 'passthrough') AS template FROM boundary LEFT JOIN (SELECT p_partkey AS adm_cd, '1-URGENT' AS ri_cd, p_name AS name FROM part) a USING (adm_cd, ri_cd)")
def sheet_templates(t):
    """The template of a unit's sheet; rows without one pass through."""
    known = t.part.select(F.col("p_partkey").alias("adm_cd"), F.lit("1-URGENT").alias("ri_cd"), F.col("p_name").alias("template"))
    rows = t.boundary.select("adm_cd", "ri_cd", "gid").join(known, ["adm_cd", "ri_cd"], "left")
    return rows.select("adm_cd", "ri_cd", "gid", F.coalesce("template", F.lit("passthrough")).alias("template"))


@query("SELECT s_suppkey AS admin_cd, 'master' AS role, s_nationkey AS perm_level FROM supplier UNION ALL SELECT adm_cd, 'normal', 1 FROM node WHERE adm_cd NOT IN (SELECT s_suppkey FROM supplier)")
def accounts_from_units(t):
    """An account for each unit that has none."""
    old = t.supplier.select(F.col("s_suppkey").alias("admin_cd"), F.lit("master").alias("role"), F.col("s_nationkey").alias("perm_level"))
    new = t.node.select(F.col("adm_cd").alias("admin_cd"), F.lit("normal").alias("role"), F.lit(1).cast(old.schema["perm_level"].dataType).alias("perm_level"))
    return R.insert_ignore(old, new, ["admin_cd"])


def _projection(lon: str, lat: str) -> tuple[str, str]:
    """The projected system written out in SQL, as a check on the column expressions."""
    chi = f"atan(sinh(atanh(sin(radians({lat}))) - {G._C!r} * atanh({G._C!r} * sin(radians({lat})))) / cos(radians({lon} - {G.LON0})))"
    t = f"sinh(atanh(sin(radians({lat}))) - {G._C!r} * atanh({G._C!r} * sin(radians({lat}))))"
    eta = f"atanh(sin(radians({lon} - {G.LON0})) / sqrt(1 + {t} ** 2))"
    east = " + ".join([eta] + [f"{a!r} * cos({2 * j} * {chi}) * sinh({2 * j} * {eta})" for j, a in enumerate(G._ALPHA, 1)])
    north = " + ".join([chi] + [f"{a!r} * sin({2 * j} * {chi}) * cosh({2 * j} * {eta})" for j, a in enumerate(G._ALPHA, 1)])
    scale = G.K0 * G._RECT
    return f"{G.FE!r} + {scale!r} * ({east})", f"{G.FN - G._origin()!r} + {scale!r} * ({north})"


X_SQL, Y_SQL = _projection("lon", "lat")


@query(f"SELECT c_custkey, round({X_SQL}, 3) AS x, round({Y_SQL}, 3) AS y FROM (SELECT c_custkey, 126.0::DOUBLE + c_custkey % 300 / 100 AS lon, 34.0::DOUBLE + c_custkey % 400 / 100 AS lat FROM customer)")
def projected_points(t):
    """Longitude and latitude in metres of the projected system, to the millimetre."""
    p = G.project(F.lit(126.0) + F.col("c_custkey") % 300 / 100, F.lit(34.0) + F.col("c_custkey") % 400 / 100)
    return t.customer.select("c_custkey", p.alias("p")).select("c_custkey", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))
