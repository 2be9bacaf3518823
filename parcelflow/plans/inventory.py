"""Further queries of the operator inventory: ingest shapes, sinks as plans, gates, repairs, nearest neighbours, runs.

They use the analogue tables of `review` and register beside its queries.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelflow.functions import geometry as G
from parcelflow.functions import signed as J
from parcelflow.functions import text as X
from parcelflow.operators import relational as R
from parcelflow.operators import spatial as P
from parcelflow.plans.review import query
from parcelflow.streaming import markup as M

CODE = "lpad(({0}::BIGINT * 7919 % 100000000) || '', 8, '0')"


def _code(c: str):
    return F.lpad((F.col(c).cast("long") * 7919 % 100000000).cast("string"), 8, "0")


@query("SELECT vec_id, generate_subscripts(embedding, 1) AS ord, unnest(embedding)::DOUBLE AS value FROM embeddings")
def array_positions(t):
    """Elements of an array with their position from 1."""
    rows = t.embeddings.select("vec_id", F.posexplode("embedding").alias("pos", "value"))
    return rows.select("vec_id", (F.col("pos") + 1).cast("long").alias("ord"), F.col("value").cast("double").alias("value"))


@query("SELECT event_id, k AS name, json_extract_string(props, '$.' || k)::BIGINT AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def map_entries(t):
    return t.events.select("event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("name", "value"))


@query("SELECT user_id, arg_min(event_type, (ts, event_id)) AS event_type, min(ts) AS first_at FROM events GROUP BY user_id")
def first_per_key(t):
    return t.events.groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.min("ts").alias("first_at"))


@query("SELECT gid, adm_cd, rank FROM (SELECT gid, adm_cd, CASE status WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS rank FROM boundary) QUALIFY rank = min(rank) OVER (PARTITION BY adm_cd)")
def preferred_variant(t):
    """All rows of the best kind that a unit has."""
    rows = t.boundary.select("gid", "adm_cd", F.when(F.col("status") == "F", 1).when(F.col("status") == "O", 2).otherwise(3).alias("rank"))
    return rows.join(rows.groupBy("adm_cd").agg(F.min("rank").alias("rank")), ["adm_cd", "rank"]).select("gid", "adm_cd", "rank")


@query("SELECT gid, adm_cd FROM boundary WHERE EXISTS (SELECT 1 FROM confirm WHERE confirm.gid = boundary.gid)")
def with_sibling(t):
    return t.boundary.join(t.confirm, "gid", "left_semi").select("gid", "adm_cd")


@query("SELECT c_custkey AS adm_cd, coalesce(s_acctbal, b.largest, c_acctbal) AS value, CASE WHEN s_acctbal IS NOT NULL THEN 'memory' WHEN b.largest IS NOT NULL THEN 'sidecar' ELSE 'computed' END AS found FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey LEFT JOIN (SELECT adm_cd, max(price) AS largest FROM boundary GROUP BY adm_cd) b ON b.adm_cd = c_custkey")
def fallback_lookup(t):
    """Three levels of lookup."""
    b = t.boundary.groupBy("adm_cd").agg(F.max("price").alias("largest"))
    s = t.supplier.select(F.col("s_suppkey").alias("adm_cd"), "s_acctbal")
    rows = t.customer.select(F.col("c_custkey").alias("adm_cd"), "c_acctbal").join(s, "adm_cd", "left").join(b, "adm_cd", "left")
    found = F.when(F.col("s_acctbal").isNotNull(), "memory").when(F.col("largest").isNotNull(), "sidecar").otherwise("computed")
    return rows.select("adm_cd", F.coalesce("s_acctbal", "largest", "c_acctbal").alias("value"), found.alias("found"))


@query("SELECT scope, kind, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (SELECT unnest(['all', sido_nm]) AS scope, kind, id FROM markup JOIN node USING (adm_cd) WHERE status IN ('pending', 'applied')) GROUP BY ALL")
def export_index(t):
    """The files of an export: each region and all, by kind, only those with rows."""
    rows = t.markup.where(F.col("status").isin("pending", "applied")).join(t.node.select("adm_cd", "sido_nm"), "adm_cd")
    rows = rows.groupBy("sido_nm", "kind").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    rows = rows.withColumn("scope", F.explode(F.array(F.lit("all"), F.col("sido_nm"))))  # after the first aggregate, so few rows are doubled
    return rows.groupBy("scope", "kind").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"))


@query("SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN 'Y' ELSE 'N' END, 'N') AS work_yn, coalesce(toxic, -1) AS remark, labels.doc_id IS NOT NULL AS changed FROM documents LEFT JOIN labels USING (doc_id)")
def roster_update(t):
    """Cells take the update where there is one."""
    new = t.labels.select("doc_id", "quality", "toxic", F.lit(True).alias("hit"))
    rows = t.documents.select("doc_id").join(new, "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("quality") == 1, "Y").otherwise("N").alias("work_yn"), F.coalesce("toxic", F.lit(-1)).alias("remark"), F.col("hit").isNotNull().alias("changed"))


@query("SELECT c_custkey AS account, coalesce(nullif(c_nationkey, 0), 1) AS level, coalesce(nullif(c_nationkey, 0), 1) < 2 AS may_edit, coalesce(nullif(c_nationkey, 0), 1) < 3 AS may_log_in, 900000000 >= coalesce(floor(epoch(o.at)), 0) AS token_valid FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS at FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def account_gates(t):
    """Edit and login gates by level, and whether a token issued at a given second is still valid."""
    changed = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("at"))
    level = F.coalesce(F.nullif("c_nationkey", F.lit(0)), F.lit(1))
    rows = t.customer.select("c_custkey", level.alias("level")).join(changed, "c_custkey", "left")
    valid = F.lit(900000000) >= F.coalesce(F.unix_timestamp(F.col("at").cast("timestamp")), F.lit(0))
    return rows.select(F.col("c_custkey").alias("account"), "level", (F.col("level") < 2).alias("may_edit"), (F.col("level") < 3).alias("may_log_in"), valid.alias("token_valid"))


KEYS = ("review-key", "another-key")


def _signed_sql() -> str:
    url = "translate(base64({0}), '+/=', '-_')".format
    blob = lambda b: f"unhex('{b.hex()}')"
    hmac = lambda key: "unhex(sha256({1} || unhex(sha256({0} || encode(body)))))".format(*map(blob, J.pads(key)))
    head = url("""encode('{"alg":"HS256","typ":"JWT"}')""")
    payload = """'{"sub":"' || c_custkey || '","role":"normal","iat":900000000,"exp":' || (900000000 + c_nationkey * 60) || '}'"""
    body = f"SELECT c_custkey, c_nationkey, {head} || '.' || {url(f'encode({payload})')} AS body FROM customer"
    mark = f"CASE WHEN c_custkey % 2 = 0 THEN {url(hmac(KEYS[0]))} ELSE {url(hmac(KEYS[1]))} END"
    return f"SELECT c_custkey AS account, body || '.' || {mark} AS token, CASE WHEN c_custkey % 2 = 0 AND c_nationkey > 10 THEN c_custkey || '' END AS sub FROM ({body})"


@query(_signed_sql())
def signed_tokens(t):
    """Tokens of accounts, and whom those name that one key signed and that have not expired ten minutes later."""
    payload = F.format_string('{"sub":"%d","role":"normal","iat":900000000,"exp":%d}', F.col("c_custkey").cast("long"), 900000000 + F.col("c_nationkey").cast("long") * 60)
    token = F.when(F.col("c_custkey") % 2 == 0, J.sign(payload, KEYS[0])).otherwise(J.sign(payload, KEYS[1]))
    rows = t.customer.select(F.col("c_custkey").alias("account"), token.alias("token"))
    return rows.withColumn("sub", F.get_json_object(J.claims(F.col("token"), KEYS[0], F.lit(900000600)), "$.sub"))


@query("SELECT adm_cd, adm_nm, sgg_cd FROM node WHERE sgg_cd = 7")
def visible_units(t):
    """A normal account sees the rows of its own unit."""
    return R.visible(t.node.select("adm_cd", "adm_nm", "sgg_cd"), "sgg_cd", "normal", 7)


@query("SELECT id, kind, shape FROM (SELECT id, kind, ['Point', 'LineString', 'Polygon'][id % 3 + 1] AS shape FROM markup) WHERE kind IN ('click', 'view') AND shape = 'Point' OR kind = 'purchase' AND shape IN ('LineString', 'Polygon') OR kind = 'signup' AND shape = 'Polygon'")
def compatible_shapes(t):
    """Kinds with a shape they may have: a semi join with a rule table."""
    rules = t.spark.createDataFrame([("click", "Point"), ("view", "Point"), ("purchase", "LineString"), ("purchase", "Polygon"), ("signup", "Polygon")], "kind string, shape string")
    shape = F.element_at(F.array(F.lit("Point"), F.lit("LineString"), F.lit("Polygon")), (F.col("id") % 3 + 1).cast("int"))
    return t.markup.select("id", "kind", shape.alias("shape")).join(rules, ["kind", "shape"], "left_semi").select("id", "kind", "shape")


@query("SELECT p_partkey, p_size BETWEEN 10 AND 40 AS ok, CASE WHEN NOT p_size BETWEEN 10 AND 40 THEN 'size ' || p_size || ' is outside 10 to 40' END AS reason FROM part")
def size_range(t):
    ok = F.col("p_size").between(10, 40)
    return t.part.select("p_partkey", ok.alias("ok"), F.when(~ok, F.format_string("size %d is outside 10 to 40", "p_size")).alias("reason"))


@query("SELECT page_id, split_part(split_part(url, '//', 2), '/', 1) AS host FROM pages")
def hosts(t):
    return t.pages.select("page_id", F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1)).alias("host"))


@query("SELECT gid, adm_cd, ri_cd, n FROM (SELECT *, count(*) OVER (PARTITION BY adm_cd, ri_cd) AS n FROM boundary WHERE status IN ('F', 'O')) WHERE status = 'F' AND n > 1")
def duplicates_across_folders(t):
    """Identified members of keys that occur twice or more over identified and unmatched rows."""
    rows = t.boundary.where(F.col("status").isin("F", "O")).withColumn("ri", F.coalesce("ri_cd", F.lit("")))
    n = rows.groupBy("adm_cd", "ri").agg(F.count("*").alias("n")).where("n > 1")
    return rows.where("status = 'F'").join(n, ["adm_cd", "ri"]).select("gid", "adm_cd", "ri_cd", "n")


@query("SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'applied') AS applied, count(*) FILTER (status = 'rejected') AS rejected, count(DISTINCT sido_cd) AS regions, count(*) FILTER (sido_nm IN ('ASIA', 'EUROPE')) AS chosen FROM markup JOIN node USING (adm_cd)")
def dashboard_totals(t):
    by = t.markup.join(t.node.select("adm_cd", "sido_cd", "sido_nm"), "adm_cd").groupBy("sido_cd", "sido_nm", "status").agg(F.count("*").alias("n"))
    total = lambda c, name: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(name)
    return by.agg(total(F.lit(True), "total"), *[total(F.col("status") == s, s) for s in ("pending", "applied", "rejected")], F.count_distinct("sido_cd").alias("regions"), total(F.col("sido_nm").isin("ASIA", "EUROPE"), "chosen"))


@query("SELECT p_name, p_brand, p_size, list(p_partkey ORDER BY p_partkey) AS codes FROM part GROUP BY ALL")
def homonyms(t):
    return t.part.groupBy("p_name", "p_brand", "p_size").agg(F.array_sort(F.collect_list("p_partkey")).alias("codes"))


@query("SELECT l_orderkey, arg_min(l_partkey, (l_extendedprice, l_linenumber, l_partkey)) AS best, min(l_extendedprice) AS cost FROM lineitem WHERE l_quantity >= 5 AND l_discount BETWEEN 0.02 AND 0.2 AND l_extendedprice < 50000 GROUP BY l_orderkey")
def best_candidate(t):
    """The cheapest of the candidates that pass the gates."""
    rows = t.lineitem.where((F.col("l_quantity") >= 5) & F.col("l_discount").between(0.02, 0.2) & (F.col("l_extendedprice") < 50000))
    return rows.groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct("l_extendedprice", "l_linenumber", "l_partkey")).alias("best"), F.min("l_extendedprice").alias("cost"))


@query("SELECT p_partkey, count(l_partkey) AS problems, coalesce(sum(l_quantity), 0) AS total FROM part LEFT JOIN (SELECT l_partkey, l_quantity FROM lineitem WHERE l_returnflag = 'R') ON l_partkey = p_partkey GROUP BY p_partkey")
def problem_summary(t):
    """Problems and their total for each image, 0 where there are none."""
    r = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return t.part.select("p_partkey").join(r, "p_partkey", "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("problems"), F.coalesce("q", F.lit(0.0)).alias("total"))


@query(r"SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(regexp_replace(d.text, '\s+', '', 'g'), regexp_replace(b.text, '\s+', '', 'g'))")
def name_in_text(t):
    """Names that occur in a text once blanks are removed."""
    names = t.benchmark.select("item_id", X.compact(F.col("text")).alias("name"))
    texts = t.documents.select("doc_id", X.compact(F.col("text")).alias("compact"))
    return R.contains_join(texts, names, "compact", "name").select("doc_id", "item_id")


@query(f"SELECT run, code FROM (SELECT left({CODE.format('s_suppkey')}, 7) AS run FROM supplier), (SELECT {CODE.format('c_custkey')} AS code FROM customer) WHERE list_contains(list_transform(generate_series(0, 7), lambda i: substr(code, 1, i) || substr(code, i + 2, 9)), run)")
def repaired_codes(t):
    """Runs of seven digits, one digit being lost, against the valid codes: variants meet codes in an equi-join."""
    runs = t.supplier.select(F.substring(_code("s_suppkey"), 1, 7).alias("run"))
    return runs.select("run", F.explode(X.repair_variants(F.col("run"))).alias("code")).join(t.customer.select(_code("c_custkey").alias("code")), "code").select("run", "code")


@query("SELECT doc_id, list_sort(list_distinct(list_filter(flatten(list_transform(range(1, len(r) + 1), lambda i: list_transform(range(0, 5), lambda k: array_to_string(r[i:i + k], '')))), lambda s: length(s) = 8))) AS codes FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[0-9]+') AS r FROM documents)")
def joined_codes(t):
    """Codes that up to five neighbouring runs of digits make together."""
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[0-9]+"), F.lit(0))
    return t.documents.select("doc_id", runs.alias("r")).select("doc_id", F.array_sort(X.joined_runs(F.col("r"))).alias("codes"))


NEAR = "(SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)"


@query(f"SELECT a.vec_id AS a, arg_min(b.vec_id, (round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 9), b.vec_id)) AS b FROM {NEAR} a JOIN {NEAR} b ON a.vec_id <> b.vec_id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.05 GROUP BY 1")
def nearest_points(t):
    """Each point's nearest other point within a limit."""
    p = t.embeddings.select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return R.nearest(p.toDF("a", "x", "y"), p.toDF("b", "x", "y"), 0.05, F.col("a") != F.col("b"), ["a"], "b", 2)


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE n <= 5 OR list_contains(list_transform(generate_series(0, 4), lambda k: k * (n - 1) // 4), i)")
def even_sample(t):
    """At most five evenly spaced rows of each group: a sampling operator."""
    i = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    n = t.events.groupBy("user_id").agg(F.count("*").alias("n"))
    rows = t.events.select("user_id", "event_id", "ts").withColumn("i", i).join(n, "user_id")
    return rows.where((F.col("n") <= 5) | F.expr("((i * 4 + n - 2) div (n - 1)) * (n - 1) div 4 = i")).select("user_id", "event_id")


@query("SELECT l_orderkey, l_linenumber, n, CASE n WHEN 4 THEN 2 WHEN 9 THEN 3 END AS cols, (l_linenumber - 1) // CASE n WHEN 4 THEN 2 WHEN 9 THEN 3 END AS row_no, (l_linenumber - 1) % CASE n WHEN 4 THEN 2 WHEN 9 THEN 3 END AS col_no FROM (SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)")
def grid_positions(t):
    """Row and column of a sheet in the grid that its unit's number of sheets implies; null where there is no such grid."""
    n = t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber").join(n, "l_orderkey").withColumn("cols", F.when(F.col("n") == 4, 2).when(F.col("n") == 9, 3))
    return rows.select("*", F.expr("cast((l_linenumber - 1) div cols AS int)").alias("row_no"), F.expr("(l_linenumber - 1) % cols").alias("col_no"))


TURN = "(q[{1}].x - q[{0}].x) * (q[{2}].y - q[{1}].y) - (q[{1}].y - q[{0}].y) * (q[{2}].x - q[{1}].x)"
TURNS = ", ".join(TURN.format(i, i % 4 + 1, (i + 1) % 4 + 1) for i in (1, 2, 3, 4))


@query(f"SELECT vec_id, least({TURNS}) > 0 OR greatest({TURNS}) < 0 AS convex FROM (SELECT vec_id, [{{x: embedding[2 * i - 1]::DOUBLE, y: embedding[2 * i]::DOUBLE}} FOR i IN [1, 2, 3, 4]] AS q FROM embeddings)")
def convex_quads(t):
    ring = G.ring_from_pairs(F.slice("embedding", 1, 8))
    return t.embeddings.select("vec_id", ring.alias("r")).select("vec_id", G.convex(F.col("r")).alias("convex"))


@query("SELECT user_id, min(event_id) AS first_id, count(*) AS points, round(sum(value), 4) AS total FROM (SELECT *, count(*) FILTER (value <= 20) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events) WHERE value > 20 GROUP BY user_id, island HAVING count(*) >= 2 AND sum(value) >= 50")
def deviation_runs(t):
    """Runs of consecutive points above a threshold, of two points and a given total at least."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t.events.withColumn("island", F.count_if(F.col("value") <= 20).over(w)).where("value > 20")
    runs = rows.groupBy("user_id", "island").agg(F.min("event_id").alias("first_id"), F.count("*").alias("points"), F.sum("value").alias("sum"))
    return runs.where("points >= 2 AND sum >= 50").select("user_id", "first_id", "points", F.round("sum", 4).alias("total"))


@query("""SELECT seq, CASE WHEN target = 'rejected' AND trim(reason) = '' THEN 'invalid' WHEN target = now_is THEN 'same' WHEN now_is <> 'pending' OR target NOT IN ('applied', 'rejected') THEN 'conflict' ELSE 'done' END AS outcome FROM (SELECT c.*, CASE WHEN m.status = 'pending' AND w.seq < c.seq THEN w.target ELSE m.status END AS now_is FROM commands c JOIN markup m USING (id)
LEFT JOIN (SELECT id, min(seq) AS seq, arg_min(target, seq) AS target FROM commands WHERE target = 'applied' OR target = 'rejected' AND trim(reason) <> '' GROUP BY id) w USING (id))""".replace("commands", "(SELECT event_id - event_id % 9 AS id, event_id AS seq, ['applied', 'rejected', 'pending', 'other'][event_id % 4 + 1] AS target, CASE WHEN event_id % 5 = 0 THEN ' ' ELSE 'why' END AS reason FROM events)"))
def command_outcomes(t):
    """What each command meets: invalid, the same state, a conflict, a stale version, or done."""
    target = F.element_at(F.array(*map(F.lit, ("applied", "rejected", "pending", "other"))), (F.col("event_id") % 4 + 1).cast("int"))
    commands = t.events.select((F.col("event_id") - F.col("event_id") % 9).alias("id"), F.col("event_id").alias("seq"), target.alias("target"), F.lit(None).cast("int").alias("expected"), F.when(F.col("event_id") % 5 == 0, " ").otherwise("why").alias("reason"))
    return M.outcomes(t.markup.select("id", "status", F.lit(1).alias("version")), commands).select("seq", "outcome")


@query("SELECT event_id, id FROM (SELECT event_id, event_id - event_id % 9 AS id FROM events) WHERE id NOT IN (SELECT id FROM markup WHERE kind = 'error' AND status <> 'applied')")
def cascade_delete(t):
    """Log rows that stay when requests of a kind are deleted; applied ones can't be."""
    gone = t.markup.where("kind = 'error' AND status <> 'applied'").select("id")
    return t.events.select("event_id", (F.col("event_id") - F.col("event_id") % 9).alias("id")).join(gone, "id", "left_anti").select("event_id", "id")


XYUV = "(SELECT label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS u, embedding[4]::DOUBLE AS v FROM embeddings)"


@query(f"SELECT label, n, round(a, 6) AS a, round(b, 6) AS b, round(mu - a * mx + b * my, 6) AS tx, round(mv - b * mx - a * my, 6) AS ty FROM (SELECT label, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, (covar_pop(x, u) + covar_pop(y, v)) / (var_pop(x) + var_pop(y)) AS a, (covar_pop(x, v) - covar_pop(y, u)) / (var_pop(x) + var_pop(y)) AS b FROM {XYUV} GROUP BY label HAVING count(*) > 1)")
def similarity_fits(t):
    """The least-squares similarity of each group's point pairs."""
    at = lambda i, c: F.col("embedding")[i].cast("double").alias(c)
    fits = P.similarity_fit(t.embeddings.select("label", *[at(i, c) for i, c in enumerate("xyuv")]), ["label"]).where("n > 1")
    return fits.select("label", "n", *[F.round(c, 6).alias(c) for c in ("a", "b", "tx", "ty")])


@query(f"SELECT a.vec_id FROM (SELECT vec_id, x, y, embedding[3]::DOUBLE - x AS dx, embedding[4]::DOUBLE - y AS dy FROM (SELECT vec_id, embedding, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings)) a WHERE greatest(0, CASE WHEN dx > 0 THEN (-0.05 - x) / dx WHEN dx < 0 THEN (0.05 - x) / dx END, CASE WHEN dy > 0 THEN (-0.05 - y) / dy WHEN dy < 0 THEN (0.05 - y) / dy END) <= least(1, CASE WHEN dx > 0 THEN (0.05 - x) / dx WHEN dx < 0 THEN (-0.05 - x) / dx END, CASE WHEN dy > 0 THEN (0.05 - y) / dy WHEN dy < 0 THEN (-0.05 - y) / dy END)")
def segments_in_box(t):
    """Segments that a box cuts or holds."""
    p = lambda i: F.struct(F.col("embedding")[i].cast("double").alias("x"), F.col("embedding")[i + 1].cast("double").alias("y"))
    box = F.struct(*[F.lit(v).alias(n) for n, v in (("minx", -0.05), ("miny", -0.05), ("maxx", 0.05), ("maxy", 0.05))])
    return t.embeddings.select("vec_id", p(0).alias("a"), p(2).alias("b")).where(G.clip(F.col("a"), F.col("b"), box).isNotNull()).select("vec_id")
