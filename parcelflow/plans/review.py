"""Review queries over the analogue tables.

customer stands for units (key, with nation and region as hierarchy), orders for boundary rows (priority '4-NOT SPECIFIED'
is the blank code), lineitem returns for confirmations, events for change requests, supplier for the image catalogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelflow.functions import geometry as G
from parcelflow.functions import text as X
from parcelflow.operators import relational as R
from parcelflow.sources import readers as S
from parcelflow.streaming import markup as M

KINDS = ("click", "error", "purchase", "signup", "view")
#: Units, nations and regions are reference tables; joins leave the strategy to the optimizer's size statistics.


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def node(self) -> DataFrame:
        rows = self.customer.join(self.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
        return rows.select(F.col("c_custkey").alias("adm_cd"), F.col("c_name").alias("adm_nm"), F.col("n_nationkey").alias("sgg_cd"), F.col("n_name").alias("sgg_nm"), F.col("r_regionkey").alias("sido_cd"), F.col("r_name").alias("sido_nm"))

    @property
    def boundary(self) -> DataFrame:
        code = F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority"))
        return self.orders.select(F.col("o_orderkey").alias("gid"), F.col("o_custkey").alias("adm_cd"), code.alias("ri_cd"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("updated_at"))

    @property
    def confirm(self) -> DataFrame:
        return self.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("gid")).distinct()

    @property
    def markup(self) -> DataFrame:
        status = F.element_at(F.array(F.lit("pending"), F.lit("applied"), F.lit("rejected")), (F.col("event_id") % 3 + 1).cast("int"))
        return self.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("adm_cd"), F.col("event_type").alias("kind"), status.alias("status"), F.col("ts").alias("created_at"), "value", "props")


CTE = """WITH node AS (SELECT c_custkey AS adm_cd, c_name AS adm_nm, n_nationkey AS sgg_cd, n_name AS sgg_nm, r_regionkey AS sido_cd, r_name AS sido_nm FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
boundary AS (SELECT o_orderkey AS gid, o_custkey AS adm_cd, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS ri_cd, o_orderstatus AS status, o_totalprice AS price, o_orderdate AS updated_at FROM orders),
confirm AS (SELECT DISTINCT l_orderkey AS gid FROM lineitem WHERE l_returnflag = 'R'),
markup AS (SELECT event_id AS id, user_id AS adm_cd, event_type AS kind, ['pending', 'applied', 'rejected'][event_id % 3 + 1] AS status, ts AS created_at, value, props FROM events)
"""
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = CTE + sql
        return f

    return keep


@query("""SELECT n.*, coalesce(b.n_remark, 0) AS n_remark, coalesce(b.n_confirmed, 0) AS n_confirmed, m.last_markup, s.s_suppkey IS NOT NULL AS has_image, b.adm_cd IS NOT NULL AS has_boundary
FROM node n LEFT JOIN (SELECT adm_cd, count(*) FILTER (ri_cd IS NOT NULL) AS n_remark, count(*) FILTER (ri_cd IS NOT NULL AND c.gid IS NOT NULL) AS n_confirmed FROM boundary b LEFT JOIN confirm c USING (gid) GROUP BY adm_cd) b USING (adm_cd)
LEFT JOIN (SELECT adm_cd, max(created_at) AS last_markup FROM markup GROUP BY adm_cd) m USING (adm_cd) LEFT JOIN supplier s ON s_suppkey = adm_cd WHERE s_suppkey IS NOT NULL OR b.adm_cd IS NOT NULL""")
def worklist(t):
    """The worklist: hierarchy, filtered counts, last request, presence flags; a unit with an image or a boundary is listed."""
    flagged = t.boundary.join(t.confirm.withColumn("c", F.lit(True)), "gid", "left")
    coded = F.col("ri_cd").isNotNull()
    b = flagged.groupBy("adm_cd").agg(F.count_if(coded).alias("n_remark"), F.count_if(coded & F.col("c").isNotNull()).alias("n_confirmed"), F.lit(True).alias("hb"))
    m = t.markup.groupBy("adm_cd").agg(F.max("created_at").alias("last_markup"))
    s = t.supplier.select(F.col("s_suppkey").alias("adm_cd"), F.lit(True).alias("hi"))
    rows = t.node.join(b, "adm_cd", "left").join(m, "adm_cd", "left").join(s, "adm_cd", "left").where("hi or hb")
    return rows.select(*t.node.columns, F.coalesce("n_remark", F.lit(0)).alias("n_remark"), F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"), "last_markup", F.col("hi").isNotNull().alias("has_image"), F.col("hb").isNotNull().alias("has_boundary"))


@query("SELECT adm_cd, adm_nm, count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'applied') AS applied, count(*) FILTER (status = 'rejected') AS rejected, max(created_at) AS last_request FROM markup JOIN node USING (adm_cd) GROUP BY ALL")
def markup_stats(t):
    is_ = lambda s: F.count_if(F.col("status") == s).alias(s)
    rows = t.markup.groupBy("adm_cd").agg(F.count("*").alias("total"), is_("pending"), is_("applied"), is_("rejected"), F.max("created_at").alias("last_request"))
    return rows.join(t.node.select("adm_cd", "adm_nm"), "adm_cd").orderBy(F.desc("pending"), F.desc("total"), "adm_cd")


@query("SELECT adm_cd, b.n, b.last_at, b.last_status, s_name, greatest(coalesce(b.last_at, TIMESTAMP '1970-01-01'), TIMESTAMP '1970-01-01') AS sort_at FROM node LEFT JOIN (SELECT adm_cd, count(*) AS n, max(updated_at) AS last_at, arg_max(status, (updated_at, gid)) AS last_status FROM boundary GROUP BY adm_cd) b USING (adm_cd) LEFT JOIN supplier ON s_suppkey = adm_cd WHERE b.n IS NOT NULL OR s_suppkey IS NOT NULL")
def upload_history(t):
    b = t.boundary.groupBy("adm_cd").agg(F.count("*").alias("n"), F.max("updated_at").alias("last_at"), F.max_by("status", F.struct("updated_at", "gid")).alias("last_status"))
    rows = t.node.select("adm_cd").join(b, "adm_cd", "left").join(t.supplier.select(F.col("s_suppkey").alias("adm_cd"), "s_name"), "adm_cd", "left").where("n is not null or s_name is not null")
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    return rows.withColumn("sort_at", F.greatest(F.coalesce("last_at", epoch), epoch)).orderBy(F.desc("sort_at"), "adm_cd")


@query("SELECT coalesce(sido_nm, 'total') AS sido_nm, " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in KINDS) + " FROM markup JOIN node USING (adm_cd) WHERE status IN ('pending', 'applied') GROUP BY GROUPING SETS ((sido_nm), ())")
def sido_summary(t):
    """Region by kind with a national total, in one pass."""
    rows = t.markup.where(F.col("status").isin("pending", "applied")).join(t.node.select("adm_cd", "sido_nm"), "adm_cd")
    return rows.rollup("sido_nm").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS]).withColumn("sido_nm", F.coalesce("sido_nm", F.lit("total")))


@query("SELECT id, adm_cd, adm_nm, kind, status FROM markup LEFT JOIN node USING (adm_cd) WHERE status = 'pending' AND kind = 'click'")
def markup_list(t):
    """A conjunction of optional filters with a left join, by unit, latest first."""
    conditions = [F.col("status") == "pending", F.col("kind") == "click"]
    rows = t.markup
    for c in conditions:
        rows = rows.where(c)
    return rows.join(t.node.select("adm_cd", "adm_nm"), "adm_cd", "left").select("id", "adm_cd", "adm_nm", "kind", "status").orderBy("adm_cd", F.desc("id"))


@query("SELECT adm_cd, adm_nm, sgg_cd, sido_cd FROM node ORDER BY sido_cd, sgg_cd, adm_cd LIMIT 300")
def first_units(t):
    return t.node.select("adm_cd", "adm_nm", "sgg_cd", "sido_cd").orderBy("sido_cd", "sgg_cd", "adm_cd").limit(300)


@query("SELECT adm_cd, adm_nm, sgg_nm FROM node WHERE contains(lower(adm_nm), '00012') OR contains(adm_cd::VARCHAR, '77') OR contains(lower(concat_ws(' ', adm_cd, adm_nm, sgg_nm)), 'nation_3')")
def unit_search(t):
    rows = t.node.select("adm_cd", "adm_nm", "sgg_nm")
    return rows.where(F.lower("adm_nm").contains("00012") | F.col("adm_cd").cast("string").contains("77") | F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in rows.columns])).contains("nation_3"))


@query("SELECT adm_cd FROM node WHERE EXISTS (SELECT 1 FROM boundary b WHERE b.adm_cd = node.adm_cd) AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = node.adm_cd)")
def boundary_without_image(t):
    rows = t.node.select("adm_cd").join(t.boundary.select("adm_cd"), "adm_cd", "left_semi")
    return rows.join(t.supplier.select(F.col("s_suppkey").alias("adm_cd")), "adm_cd", "left_anti")


@query("SELECT coalesce(a.adm_cd, s_suppkey) AS adm_cd, a.adm_cd IS NOT NULL AS in_boundary, s_suppkey IS NOT NULL AS in_images FROM (SELECT DISTINCT adm_cd FROM boundary) a FULL JOIN supplier ON s_suppkey = a.adm_cd")
def boundary_or_image(t):
    a, b = t.boundary.select(F.col("adm_cd").alias("a")).distinct(), t.supplier.select(F.col("s_suppkey").alias("b"))
    return a.join(b, F.col("a") == F.col("b"), "full_outer").select(F.coalesce("a", "b").alias("adm_cd"), F.col("a").isNotNull().alias("in_boundary"), F.col("b").isNotNull().alias("in_images"))


@query("SELECT gid, adm_cd, coalesce(nullif(trim(ri_cd), ''), 'gid:' || gid) AS confirm_key, c.gid IS NOT NULL AS confirmed FROM boundary LEFT JOIN confirm c USING (gid)")
def confirmed_boundaries(t):
    keyed = t.boundary.select("gid", "adm_cd", R.confirm_key(F.col("ri_cd"), F.col("gid")).alias("confirm_key"))
    return keyed.join(t.confirm.withColumn("c", F.lit(True)), "gid", "left").select("gid", "adm_cd", "confirm_key", F.col("c").isNotNull().alias("confirmed"))


@query("SELECT adm_cd, ri_cd, CASE WHEN ri_cd IS NULL THEN gid END AS row_no, count(*) AS parts, max(status) AS status, string_agg(DISTINCT status, ' / ' ORDER BY status) AS statuses, round(sum(price), 2) AS price FROM boundary GROUP BY ALL")
def merged_boundaries(t):
    """Rows of one code unite; each row without a code stays its own group."""
    own = F.when(F.col("ri_cd").isNull(), F.col("gid")).alias("row_no")
    return t.boundary.groupBy("adm_cd", "ri_cd", own).agg(F.count("*").alias("parts"), F.max("status").alias("status"), F.array_join(F.array_sort(F.collect_set("status")), " / ").alias("statuses"), F.round(F.sum("price"), 2).alias("price"))


@query("SELECT adm_cd, ri_cd, count(*) AS n FROM boundary WHERE ri_cd IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def duplicate_codes(t):
    return t.boundary.where(R.non_blank(F.col("ri_cd"))).groupBy("adm_cd", "ri_cd").agg(F.count("*").alias("n")).where("n > 1").orderBy("adm_cd", "ri_cd")


@query("SELECT gid, adm_cd, CASE WHEN status = 'F' THEN 'N' ELSE status END AS status FROM boundary UNION ALL SELECT -1 - gid, adm_cd, 'N' FROM boundary WHERE ri_cd IS NULL")
def upserted(t):
    """Finished rows come again with status N; rows without a code come once more under a new number."""
    new = t.boundary.where("status = 'F'").select("gid", "adm_cd", F.lit("N").alias("status"))
    more = t.boundary.where("ri_cd IS NULL").select((-1 - F.col("gid")).alias("gid"), "adm_cd", F.lit("N").alias("status"))
    return R.upsert(t.boundary.select("gid", "adm_cd", "status"), new.union(more), ["gid"])


@query("SELECT gid, status FROM boundary UNION ALL SELECT -1 - gid, 'N' FROM boundary WHERE ri_cd IS NULL")
def inserted_where_new(t):
    new = t.boundary.where("ri_cd IS NULL")
    new = new.select("gid", F.lit("N").alias("status")).union(new.select(-1 - F.col("gid"), F.lit("N")))
    return R.insert_ignore(t.boundary.select("gid", "status"), new, ["gid"])


@query("SELECT gid, adm_cd, status FROM boundary WHERE adm_cd NOT IN (SELECT adm_cd FROM boundary WHERE price > 495000) UNION ALL SELECT gid, adm_cd, 'draft' FROM boundary WHERE price > 495000")
def replaced_units(t):
    new = t.boundary.where("price > 495000").select("gid", "adm_cd", F.lit("draft").alias("status"))
    return R.replace_units(t.boundary.select("gid", "adm_cd", "status"), new, "adm_cd")


@query("SELECT c.gid FROM confirm c WHERE NOT EXISTS (SELECT 1 FROM boundary b WHERE b.gid = c.gid AND b.status <> 'F')")
def orphan_confirmations(t):
    return t.confirm.join(t.boundary.where("status <> 'F'").select("gid"), "gid", "left_anti")


@query("SELECT p.p_partkey, arg_min(o.gid, (o.price, o.gid)) AS gid FROM part p JOIN boundary o ON o.adm_cd = p.p_partkey AND o.price >= p.p_retailprice * 100 GROUP BY p.p_partkey")
def smallest_containing(t):
    """The smallest match of a non-equi condition for each key, without a lateral join."""
    hits = t.part.join(t.boundary, (F.col("adm_cd") == F.col("p_partkey")) & (F.col("price") >= F.col("p_retailprice") * 100))
    return hits.groupBy("p_partkey").agg(F.min_by("gid", F.struct("price", "gid")).alias("gid"))


@query("SELECT a.c_custkey AS unit, b.s_suppkey AS neighbour FROM customer a JOIN supplier b ON b.s_acctbal BETWEEN a.c_acctbal - 50 AND a.c_acctbal + 50")
def neighbours(t):
    """Intervals and points as flat boxes."""
    flat = lambda low, high: G.envelope(low, 0, high, 0)
    left = t.customer.select(F.col("c_custkey").alias("unit"), flat(F.col("c_acctbal") - 50, F.col("c_acctbal") + 50).alias("a"))
    right = t.supplier.select(F.col("s_suppkey").alias("neighbour"), flat(F.col("s_acctbal"), F.col("s_acctbal")).alias("b"))
    return R.box_join(left, right, "a", "b", 100).select("unit", "neighbour")


@query("SELECT user_id, event_type, count(*) AS votes, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 6) AS confidence FROM events GROUP BY user_id, event_type QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) = 1")
def candidate_votes(t):
    votes = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("votes"))
    total = votes.groupBy("user_id").agg(F.sum("votes").alias("all"))
    return R.top1(votes, ["user_id"], [-F.col("votes"), F.col("event_type")]).join(total, "user_id").select("user_id", "event_type", "votes", F.round(F.col("votes") / F.col("all"), 6).alias("confidence"))


@query("SELECT gid, adm_cd, ri_cd, status = 'O' AND count(*) FILTER (status = 'O') OVER (PARTITION BY adm_cd, ri_cd) > 1 AS conflict FROM boundary")
def conflicts(t):
    return R.conflicts_fail(t.boundary, ["adm_cd", "ri_cd"], F.col("status") == "O").select("gid", "adm_cd", "ri_cd", "conflict")


@query("""SELECT gid, adm_cd, round(CASE WHEN n >= 3 AND peers > 0 AND NOT is_peer THEN peer ELSE price END, 4) AS repaired, is_peer FROM (SELECT *, median(CASE WHEN is_peer THEN price END) OVER (PARTITION BY adm_cd) AS peer, count(*) FILTER (is_peer) OVER (PARTITION BY adm_cd) AS peers FROM
(SELECT *, abs(price - md) <= md * 0.3 AS is_peer FROM (SELECT *, median(price) OVER (PARTITION BY adm_cd) AS md, count(*) OVER (PARTITION BY adm_cd) AS n FROM boundary)))""")
def peer_repair(t):
    return R.peer_repair(t.boundary, "adm_cd", "price", 0.3).select("gid", "adm_cd", F.round("repaired", 4).alias("repaired"), "is_peer")


@query("SELECT adm_cd, round(avg(price), 1) AS mean, min(price) AS low, max(price) AS high, (max(price) - min(price)) / avg(price) * 100 > 150 AS deviates, arg_max(gid, (price, gid)) AS widest FROM boundary GROUP BY adm_cd")
def size_deviation(t):
    spread = (F.max("price") - F.min("price")) / F.avg("price") * 100
    return t.boundary.groupBy("adm_cd").agg(F.round(F.avg("price"), 1).alias("mean"), F.min("price").alias("low"), F.max("price").alias("high"), (spread > 150).alias("deviates"), F.max_by("gid", F.struct("price", "gid")).alias("widest"))


@query("SELECT gid, round(coalesce(CASE WHEN status = 'F' THEN price END, median(CASE WHEN status = 'F' THEN price END) OVER (PARTITION BY adm_cd)), 4) AS value FROM boundary")
def consensus_fallback(t):
    ok = F.when(F.col("status") == "F", F.col("price"))
    med = t.boundary.groupBy("adm_cd").agg(F.median(ok).alias("m"))
    return t.boundary.join(med, "adm_cd").select("gid", F.round(F.coalesce(ok, "m"), 4).alias("value"))


@query("SELECT user_id, island, count(*) AS n, min(ts) AS first_at, round(sum(value), 4) AS total FROM (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS gap FROM events)) GROUP BY ALL")
def islands(t):
    """Runs of consecutive points: a gap starts a new one."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.coalesce((F.col("ts") - F.lag("ts").over(w) > F.expr("INTERVAL 6 HOUR")).cast("int"), F.lit(0))
    rows = t.events.withColumn("gap", gap).withColumn("island", F.sum("gap").over(w))
    return rows.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT doc_id, regexp_extract_all(text, '[0-9]{7,11}') AS runs, regexp_extract(text, '\\((\\d{8})\\)', 1) AS code, length(regexp_replace(text, '\\s+', '', 'g')) AS n_compact FROM documents")
def text_codes(t):
    return t.documents.select("doc_id", F.regexp_extract_all("text", F.lit(r"[0-9]{7,11}"), F.lit(0)).alias("runs"), X.paren_code(F.col("text")).alias("code"), F.length(X.compact(F.col("text"))).cast("long").alias("n_compact"))


HAMMING = "list_sum(list_transform(generate_series(1, 8), lambda i: CASE WHEN substr(a, i, 1) <> substr(b, i, 1) THEN 1 ELSE 0 END))"


@query(f"SELECT a, b, {HAMMING}::INTEGER AS distance FROM (SELECT lpad(s_suppkey * 7919 % 100000000 || '', 8, '0') AS a FROM supplier), (SELECT lpad(n_nationkey * 7919 * 3 % 100000000 || '', 8, '0') AS b FROM nation) WHERE {HAMMING} <= 2")
def fuzzy_codes(t):
    code = lambda c, k: F.lpad((F.col(c).cast("long") * k % 100000000).cast("string"), 8, "0")
    return R.hamming_join(t.supplier.select(code("s_suppkey", 7919).alias("a")), t.nation.select(code("n_nationkey", 7919 * 3).alias("b")), "a", "b")


@query("SELECT gid, coalesce(to_json({a: adm_cd}), '') AS j, (props_k)::BIGINT AS k FROM (SELECT id AS gid, adm_cd, json_extract_string(props, '$.k') AS props_k FROM markup)")
def json_values(t):
    return t.markup.select(F.col("id").alias("gid"), F.to_json(F.struct(F.col("adm_cd").alias("a"))).alias("j"), F.get_json_object("props", "$.k").cast("long").alias("k"))


RING = "(SELECT vec_id, [{x: embedding[2*i-1]::DOUBLE, y: embedding[2*i]::DOUBLE} FOR i IN generate_series(1, len(embedding)//2)] AS p FROM embeddings)"
EDGES = f"(SELECT vec_id, unnest([{{a: p[i], b: p[i % len(p) + 1]}} FOR i IN generate_series(1, len(p))]) AS e FROM {RING})"


@query(f"SELECT vec_id, round(abs(sum(e.a.x * e.b.y - e.b.x * e.a.y)) / 2, 6) AS area, round(sum(sqrt((e.b.x - e.a.x) ** 2 + (e.b.y - e.a.y) ** 2)), 6) AS length, round(min(e.a.x), 6) AS minx, round(max(e.a.y), 6) AS maxy FROM {EDGES} GROUP BY vec_id")
def ring_measures(t):
    r = t.embeddings.select("vec_id", G.ring_from_pairs(F.col("embedding")).alias("r"))
    return r.select("vec_id", F.round(G.area(F.col("r")), 6).alias("area"), F.round(G.length(F.col("r")), 6).alias("length"), F.round(G.bbox(F.col("r"))["minx"], 6).alias("minx"), F.round(G.bbox(F.col("r"))["maxy"], 6).alias("maxy"))


@query(f"SELECT vec_id, count(*) FILTER ((e.a.y > 0.01) <> (e.b.y > 0.01) AND 0.02 < (e.b.x - e.a.x) * (0.01 - e.a.y) / nullif(e.b.y - e.a.y, 0) + e.a.x) % 2 = 1 AS inside FROM {EDGES} GROUP BY vec_id")
def point_in_ring(t):
    return t.embeddings.select("vec_id", G.contains(G.ring_from_pairs(F.col("embedding")), F.lit(0.02), F.lit(0.01)).alias("inside"))


@query("SELECT a.vec_id AS a, b.vec_id AS b FROM (SELECT vec_id, embedding[1] AS x, embedding[2] AS y FROM embeddings) a JOIN (SELECT vec_id, embedding[1] AS x, embedding[2] AS y FROM embeddings) b ON abs(a.x::DOUBLE - b.x::DOUBLE) <= 0.05 AND abs(a.y::DOUBLE - b.y::DOUBLE) <= 0.05")
def boxes_nearby(t):
    at = lambda n: t.embeddings.select(F.col("vec_id").alias(n), *[F.col("embedding")[i].cast("double").alias(n + c) for i, c in enumerate("xy")])
    left = at("a").withColumn("box", G.envelope(F.col("ax") - 0.06, F.col("ay") - 0.06, F.col("ax") + 0.06, F.col("ay") + 0.06))
    right = at("b").withColumn("own", G.envelope(F.col("bx"), F.col("by"), F.col("bx"), F.col("by")))
    met = R.box_join(left, right, "box", "own")
    return met.where((F.abs(F.col("ax") - F.col("bx")) <= 0.05) & (F.abs(F.col("ay") - F.col("by")) <= 0.05)).select("a", "b")


@query("SELECT id, CASE WHEN won IS NULL THEN status ELSE target END AS status, 1 + (won IS NOT NULL)::INTEGER AS version FROM (SELECT id, status FROM markup) m LEFT JOIN (SELECT id AS mid, min(seq) AS won, arg_min(target, seq) AS target FROM (SELECT event_id - event_id % 9 AS id, event_id AS seq, CASE event_id % 4 WHEN 0 THEN 'applied' WHEN 1 THEN 'rejected' WHEN 2 THEN 'pending' ELSE 'other' END AS target, CASE WHEN event_id % 5 = 0 THEN ' ' ELSE 'why' END AS reason FROM events) WHERE target = 'applied' OR target = 'rejected' AND trim(reason) <> '' GROUP BY 1) c ON mid = id AND status = 'pending'")
def state_machine(t):
    e = t.events
    target = F.element_at(F.array(*map(F.lit, ("applied", "rejected", "pending", "other"))), (F.col("event_id") % 4 + 1).cast("int"))
    commands = e.select((F.col("event_id") - F.col("event_id") % 9).alias("id"), F.col("event_id").alias("seq"), target.alias("target"), F.lit(None).cast("int").alias("expected"), F.when(F.col("event_id") % 5 == 0, " ").otherwise("why").alias("reason"))
    return M.apply_commands(t.markup.select("id", "status", F.lit(1).alias("version")), commands)[0]


@query("SELECT doc_id, quality IS NOT NULL AS marked, coalesce(quality, 0) AS done FROM documents LEFT JOIN labels USING (doc_id)")
def roster_marks(t):
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.col("quality").isNotNull().alias("marked"), F.coalesce("quality", F.lit(0)).alias("done"))


@query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'customer', count(*) FROM customer")
def table_counts(t):
    counts = [getattr(t, n).agg(F.lit(n).alias("name"), F.count("*").alias("n")).select("name", "n") for n in ("orders", "events", "customer")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("SELECT adm_cd FROM boundary INTERSECT SELECT adm_cd FROM markup")
def units_with_both(t):
    return t.boundary.select("adm_cd").intersect(t.markup.select("adm_cd"))


@query("SELECT adm_cd FROM boundary EXCEPT SELECT adm_cd FROM markup")
def units_without_markup(t):
    return t.boundary.select("adm_cd").distinct().join(t.markup.select("adm_cd"), "adm_cd", "left_anti")


@query("SELECT conv_id, list(text ORDER BY turn) AS texts FROM conversations GROUP BY conv_id")
def ordered_groups(t):
    rows = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("r"))
    return rows.select("conv_id", F.col("r.text").alias("texts"))


@query("SELECT url, regexp_extract(url, '/([a-z]{2})/(\\d+)$', 1) AS lang, regexp_extract(url, '/([a-z]{2})/(\\d+)$', 2) AS no FROM pages")
def names_as_keys(t):
    return t.pages.select("url", *[F.regexp_extract("url", r"/([a-z]{2})/(\d+)$", i).alias(n) for i, n in ((1, "lang"), (2, "no"))])


@query("SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS local_at, floor(epoch(ts))::BIGINT AS at FROM events")
def local_times(t):
    return t.events.select("event_id", F.date_format(F.col("ts") + F.expr("INTERVAL 9 HOURS"), "yyyy-MM-dd HH:mm").alias("local_at"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("at"))


@query("SELECT gid, CASE WHEN rn = 1 THEN adm_cd || '' ELSE adm_cd || '_' || rn END AS name FROM (SELECT gid, adm_cd, row_number() OVER (PARTITION BY adm_cd, ri_cd ORDER BY gid) AS rn FROM boundary)")
def routed_names(t):
    """Repeats get the suffixes _2, _3 and so on."""
    rn = F.row_number().over(W.partitionBy("adm_cd", "ri_cd").orderBy("gid"))
    return t.boundary.withColumn("rn", rn).select("gid", F.concat(F.col("adm_cd").cast("string"), F.when(F.col("rn") > 1, F.concat(F.lit("_"), F.col("rn").cast("string"))).otherwise("")).alias("name"))


@query("SELECT count(*) AS n, round(min(c_acctbal), 2) AS low, round(max(c_acctbal), 2) AS high, round(median(c_acctbal), 4) AS mid, round(quantile_cont(c_acctbal, 0.95), 4) AS p95 FROM customer")
def extent(t):
    mid, p95 = R.quantiles(t.customer, "c_acctbal", [0.5, 0.95])
    return t.customer.agg(F.count("*").alias("n"), F.round(F.min("c_acctbal"), 2).alias("low"), F.round(F.max("c_acctbal"), 2).alias("high")).select("*", F.round(F.lit(mid), 4).alias("mid"), F.round(F.lit(p95), 4).alias("p95"))


@query()
def feature_collections(t):
    """GeoJSON by unit; rows only, as JSON text differs between engines."""
    return S.feature_collection(t.boundary, ["adm_cd"], ["ri_cd", "status"], "gid")


@query()
def projected(t):
    """Longitude and latitude to metres and back."""
    p = t.customer.select("c_custkey", (F.lit(126.0) + F.col("c_custkey") % 300 / 100).alias("lon"), (F.lit(34.0) + F.col("c_custkey") % 400 / 100).alias("lat"))
    p = p.withColumn("p", G.project(F.col("lon"), F.col("lat")))
    return p.withColumn("back", G.unproject(F.col("p.x"), F.col("p.y"))).select("c_custkey", "lon", "lat", "p.x", "p.y", F.col("back.lon").alias("lon2"), F.col("back.lat").alias("lat2"))
