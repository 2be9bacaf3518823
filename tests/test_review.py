"""Review queries against DuckDB, and building blocks on small fixtures."""

import glob
import math
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from parcelflow.functions import geometry as G
from parcelflow.functions import signed as J
from parcelflow.functions import text as X
from parcelflow.operators import codes as C
from parcelflow.operators import relational as R
from parcelflow.plans import inventory, places, review  # noqa: F401
from parcelflow.sources import readers as S
from parcelflow.sources import writers as K
from parcelflow.streaming import markup as M


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, (list, tuple)):
        return str([value(y) for y in x])
    return f"{x:.6f}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(review.ORACLES))
def test_query(spark, duck, sf, name):
    got = review.QUERIES[name](spark, sf)
    want = duck.execute(review.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(tuple(map(value, r)) for r in got.select(*columns).collect()) == sorted(tuple(map(value, r)) for r in want.fetchall())


def test_projection_round_trip(spark, sf):
    rows = review.QUERIES["projected"](spark, sf).collect()
    assert all(abs(r["lon"] - r["lon2"]) < 1e-8 and abs(r["lat"] - r["lat2"]) < 1e-8 for r in rows)
    p = spark.range(1).select(G.project(F.lit(127.5), F.lit(38.0)).alias("p")).first()["p"]
    assert abs(p["x"] - 1_000_000) < 1e-6 and abs(p["y"] - 2_000_000) < 1e-6


def test_geometry(spark):
    square = F.array(*[F.lit(float(v)) for v in (0, 0, 4, 0, 4, 2, 0, 2)])
    r = G.ring_from_pairs(square)
    got = spark.range(1).select(G.area(r), G.length(r), G.centroid(r)["x"], G.centroid(r)["y"], G.contains(r, F.lit(1.0), F.lit(1.0)), G.contains(r, F.lit(5.0), F.lit(1.0)), G.overlaps(G.bbox(r), G.expand(G.bbox(r), 1.0))).first()
    assert tuple(got) == (8.0, 12.0, 2.0, 1.0, True, False, True)
    assert tuple(spark.range(1).select(G.world_to_pixel(F.lit(2.5), F.lit(0.0), F.lit(0.0), F.lit(1.5), F.lit(1.0))["col"]).first()) == (2,)


def test_text(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first()[0]
    assert one(X.paren_code(F.lit("우곡면(37570360)"))) == "37570360"
    assert "39010330" in one(X.code_windows(F.lit("2539010330")))
    assert {"12345678"} == set(one(X.repair_variants(F.lit("12345678")))) and "12345678" in one(X.repair_variants(F.lit("1234567"))) and "12345678" in one(X.repair_variants(F.lit("123945678")))
    assert one(X.compact(F.lit("한 림 읍"))) == "한림읍" and one(X.scale(F.lit("1:7,727"))) == 7727 and one(X.scale(F.lit("1 : 14957"))) == 14957
    assert one(X.status_list(F.lit(" applied, x"))) == ["applied"] and one(X.status_list(F.lit(None).cast("string"))) == ["pending"]
    assert one(X.sheet_id(F.lit("/-1"))) == "7-1"
    nine = F.array(*[F.lit(f"9-{i}") for i in range(1, 10)])
    assert one(X.sheet_id(F.lit("/-1"), nine)) == "9-1" and one(X.sheet_id(F.lit("90"), nine)) is None
    assert one(R.hamming(F.lit("80020310"), F.lit("39020310"))) == 2


def test_hamming_join_finds_all(spark):
    import random

    r = random.Random(1)
    codes = ["".join(r.choice("012") for _ in range(8)) for _ in range(80)]
    df = spark.createDataFrame([(c,) for c in codes], "a string")
    got = {(x["a"], x["b"]) for x in R.hamming_join(df, df.withColumnRenamed("a", "b"), "a", "b").collect()}
    assert got == {(a, b) for a in codes for b in codes if sum(x != y for x, y in zip(a, b)) <= 2}


def test_sources(spark, tmp_path):
    header = ["CTPV_CD", "EMD CD", "EMD_NM", "RI_NM", "LI_NM", "LI-CD", "WORK_YN"]
    (tmp_path / "r.csv").write_text(",".join(header) + "\n1, 10 ,n,x,ri,5,Y\n1,11,n,x,,5,Y\n,,,,,,\n")
    rows = S.roster(spark, str(tmp_path / "r.csv")).collect()
    assert [(r["adm_cd"], r["ri_nm"], r["li_nm"], r["ri_cd"]) for r in rows] == [("10", "ri", "x", "5")]
    assert S.detect_columns(["x"])[1] == list(S.REQUIRED)
    assert S.detect_columns(["읍면동코드", "행정동 명", "법정리명", "행정리명", "행정리코드", "RMK"]) == ({"읍면동코드": "adm_cd", "행정동 명": "adm_nm", "법정리명": "li_nm", "행정리명": "ri_nm", "행정리코드": "ri_cd", "RMK": "remark"}, [])
    assert S.pick_sheet({"a": ["x"], "b": header}) == "b" and S.pick_sheet({"a": ["x"], "b": []}) == "a" and S.pick_sheet({}) is None
    (tmp_path / "o.csv").write_text("a,b\n1,2\n")
    assert S.roster_of(spark, {"notes": str(tmp_path / "o.csv"), "list": str(tmp_path / "r.csv")}, units=["10"]).count() == 1
    (tmp_path / "s.csv").write_text("scan_path,status,admin_code,sheet_id\na,OK,1,4-1\nb,FAIL,1,4-2\nc,OK_NO_PDF,1,\n")
    assert [x["scan_path"] for x in S.status_rows(spark, str(tmp_path / "s.csv")).collect()] == ["a"]
    (tmp_path / "u.csv").write_text("admin_cd , role\n 1 ,master\n")
    assert [tuple(x) for x in S.accounts(spark, str(tmp_path / "u.csv")).collect()] == [("1", "master")]
    (tmp_path / "a.jgw").write_text("0.5\n0\n0\n-0.5\n10\n20\n")
    assert tuple(S.world_files(spark, str(tmp_path / "a.jgw")).drop("path").first()) == (0.5, 0.0, 0.0, -0.5, 10.0, 20.0)
    names = spark.createDataFrame([("a/12345678_4-1_2.jpg",), ("b.jpg",)], "path string")
    assert [tuple(r)[1:] for r in S.image_names(names).collect()] == [("12345678", "4-1")]


def test_state_machine(spark):
    m = spark.createDataFrame([(1, "pending", 1), (2, "applied", 2), (3, "pending", 1), (4, "pending", 1)], "id long, status string, version int")
    c = spark.createDataFrame([(1, 1, "rejected", None, " "), (1, 2, "applied", 1, None), (1, 3, "rejected", None, "why"), (2, 4, "rejected", None, "why"), (3, 5, "applied", 9, None)], "id long, seq long, target string, expected int, reason string")
    after, events = M.apply_commands(m, c)
    assert sorted(map(tuple, after.collect())) == [(1, "applied", 2), (2, "applied", 2), (3, "pending", 1), (4, "pending", 1)]
    assert [tuple(e) for e in events.collect()] == [(1, "pending", "applied", 2)]


def test_state_stream(spark, tmp_path):
    """Two batches, days apart: a request decided in the first is no longer pending in the second; each event against the rules."""
    import random

    r = random.Random(4)
    rows = [(r.randrange(6), k, r.choice(["applied", "rejected", "pending", "other"]), r.choice([None, 1, 2]), r.choice([None, " ", "why"]), f"a{k}") for k in range(120)]
    cut = lambda part, day: spark.createDataFrame(part, "id long, seq long, target string, expected int, reason string, actor string").selectExpr("*", f"timestamp'2024-01-{day}' + make_interval(0,0,0,0,0,seq) AS at")
    cut(rows[:40], "01").coalesce(1).write.parquet(str(tmp_path / "in" / "1"))
    stream = spark.readStream.schema("id long, seq long, target string, expected int, reason string, actor string, at timestamp").option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = M.transitions(stream).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).format("memory").queryName("events_out").start()
    q.processAllAvailable()
    cut(rows[40:], "09").coalesce(1).write.parquet(str(tmp_path / "in" / "2"))
    q.processAllAvailable()
    q.stop()
    state, want = {}, []
    for id_, seq, target, expected, reason, actor in rows:
        status, version = state.get(id_, ("pending", 1))
        if target == "rejected" and not (reason or "").strip():
            got = "invalid"
        elif target == status:
            got = "same"
        elif status != "pending" or target not in ("applied", "rejected"):
            got = "conflict"
        elif expected not in (None, version):
            got = "stale"
        else:
            got = "done"
            state[id_] = target, version + 1
        want.append((id_, seq, got, status, *state.get(id_, (status, version)), actor))
    assert len(state) > 3
    assert sorted(tuple(x)[:7] for x in spark.sql("SELECT * FROM events_out").collect()) == sorted(want)


def test_deletable(spark):
    m = spark.createDataFrame([(1, "pending"), (2, "applied"), (3, "rejected")], "id long, status string")
    e = spark.createDataFrame([(10, 1), (11, 2), (12, 3)], "event long, id long")
    ids = spark.createDataFrame([(1,), (2,), (9,)], "id long")
    left = [sorted(r["id"] for r in x.collect()) for x in M.deletable(m, e, ids)]
    assert left == [[2, 3], [2, 3]]
    assert [sorted(r["id"] for r in x.collect()) for x in M.deletable(m, e, ids, superadmin=True)] == [[3], [3]]


def test_replace_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "gid long, unit string")
    new = spark.createDataFrame([(9, "b")], "gid long, unit string")
    once = R.replace_units(old, new, "unit")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, R.replace_units(once, new, "unit").collect())) == [(1, "a"), (9, "b")]


@pytest.mark.parametrize("many", [200_000, 0])
def test_contains_join_finds_all(spark, monkeypatch, many):
    monkeypatch.setattr(R, "MANY", many)
    texts = spark.createDataFrame([(1, "abcdefghijkl"), (2, "xab"), (3, None), (4, ""), (5, "abcdefghijkl")], "t int, text string")
    names = spark.createDataFrame([(1, "ab"), (2, "cdefghijkl"), (3, "cdefghijkx"), (4, ""), (5, None), (6, "b")], "n int, name string")
    got = sorted((r["t"], r["n"]) for r in R.contains_join(texts, names, "text", "name").collect())
    assert got == [(1, 1), (1, 2), (1, 6), (2, 1), (2, 6), (5, 1), (5, 2), (5, 6)]
    assert R.contains_join(texts.union(texts), names.union(names), "text", "name").count() == 4 * len(got)
    assert R.contains_join(texts, names.where("n = 4"), "text", "name").count() == 0


def test_outcomes(spark):
    m = spark.createDataFrame([(1, "pending", 1), (2, "applied", 2)], "id long, status string, version int")
    c = [(1, 1, "applied", 9, None), (1, 2, "applied", 1, None), (1, 3, "applied", 7, None), (1, 4, "rejected", None, "why"), (2, 5, "rejected", None, " "), (2, 6, "applied", 9, None), (3, 7, "applied", None, None)]
    got = {r["seq"]: r["outcome"] for r in M.outcomes(m, spark.createDataFrame(c, "id long, seq long, target string, expected int, reason string")).collect()}
    assert got == {1: "stale", 2: "done", 3: "same", 4: "conflict", 5: "invalid", 6: "same"}


def test_access(spark):
    units = spark.createDataFrame([("a",), ("b",)], "unit string")
    assert R.visible(units, "unit", "master", "a").count() == 2 and R.visible(units, "unit", "normal", "a").count() == 1


def test_inventory_empty(spark):
    e = spark.createDataFrame([], "a int, x double, y double")
    assert R.nearest(e, e.withColumnRenamed("a", "b"), 1.0, F.lit(True), ["a"], "b").count() == 0
    assert spark.range(1).select(X.joined_runs(F.array(F.lit("1234"), F.lit("5678"), F.lit("9")))).first()[0] == ["12345678"]


def slow_codes(text, units, valid):
    """The tiers in a row, one text at a time."""
    compact = re.sub(r"\s+", "", text or "")
    text, known = text or "", {c for c, _ in units}
    names = {c for c, n in units if n and re.sub(r"\s+", "", n) in compact}
    keep = lambda found: {c for c in found if valid is None or c in valid}
    parens = [re.sub(r"\s", "", p) for p in re.findall(r"\(\s*([\d\s]+?)\s*\)", text)]
    behind = [re.sub(r"\s", "", p) for p in re.findall(r"[가-힣][가-힣\s]*\(\s*([\d\s]+?)\s*\)", text)]
    if found := keep(p for p in behind if len(p) == 8):
        return 0, found
    found = keep(p for p in parens if len(p) == 8)
    if found := (found & names if names else found):
        return 10, found
    tokens = {p for p in parens if 7 <= len(p) <= 11} | set(re.findall(r"\d{7,11}", text))
    windows = {t[i : i + 8] for t in tokens for i in range(len(t) - 7)}
    off = lambda a, b: sum(x != y for x, y in zip(a, b))
    fuzzy = {c for c in known for t in tokens if (len(t) == 8 and off(t, c) <= 1) or (len(t) == 7 and any(c[:i] + c[i + 1 :] == t for i in range(8))) or (len(t) == 9 and any(t[:i] + t[i + 1 :] == c for i in range(9))) or (len(t) > 9 and c in t)}
    if both := fuzzy & names:
        return (20, keep(both)) if keep(both) else (21, both)
    if found := keep(c for c in names if any(off(w, c) <= 2 for w in windows)):
        return 25, found
    if found := keep(names):
        return 30, found
    if found := keep(fuzzy):
        return 40, found
    if valid is not None and len(valid) <= C.SMALL and (found := {c for c in valid if any(off(w, c) <= 2 for w in windows)}):
        return 45, found
    runs = re.findall(r"\d+", text)
    eights = set(re.findall(r"\d{8}", text)) | {"".join(runs[i : i + k]) for i in range(len(runs)) for k in range(1, 6)}
    return 50, keep(c for c in eights if len(c) == 8)


@pytest.mark.parametrize("n", [None, 30, 160])
def test_code_tiers(spark, sf, n):
    from parcelflow.plans.review import Tables

    texts, units, _ = places.recognised(Tables(spark, sf))
    units = units.limit(200)
    listed = [tuple(u) for u in units.collect()]
    valid = None if n is None else {c for c, _ in listed[:n]}
    more = [(-1, "한 림 읍 (37570360)"), (-2, "우곡면(3757 0360) 37570360"), (-3, None), (-4, ""), (-5, "2539010330"), (-6, "1234567 12 34 56 78 9"), (-7, "80" + listed[3][0][2:]), (-8, listed[5][0][:4] + "9" + listed[5][0][4:])]
    texts = texts.union(spark.createDataFrame(more, texts.schema))
    table = None if valid is None else spark.createDataFrame([(c,) for c in valid], "code string")
    got = {}
    for r in C.tiered_codes(texts, "p_partkey", "t", units, table).collect():
        got.setdefault(r["p_partkey"], (r["tier"], set()))[1].add(r["code"])
    want = {r["p_partkey"]: slow_codes(r["t"], listed, valid) for r in texts.collect()}
    assert got == {k: v for k, v in want.items() if v[1]}
    assert len({t for t, _ in got.values()}) >= 4


def test_quantiles(spark):
    import numpy as np

    r = np.random.default_rng(1)
    for values in (r.normal(size=5000), r.integers(0, 3, 2000).astype(float), np.array([5.0]), np.concatenate((np.zeros(1000), 1e9 + r.random(1000)))):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
        shares = [0.0, 0.1, 0.5, 0.95, 1.0]
        assert R.quantiles(df, "v", shares, keep=50) == pytest.approx(np.quantile(values, shares).tolist())
    assert R.quantiles(df.where("false"), "v", [0.5]) == [None]


def test_box_join_finds_each_pair_once(spark):
    import random

    r = random.Random(3)
    boxes = [(i, *sorted((r.uniform(-9, 9), r.uniform(-9, 9))), *sorted((r.uniform(-9, 9), r.uniform(-9, 9)))) for i in range(60)] + [(100 + i, 1.0, 1.0, 2.0, 2.0) for i in range(30)]
    df = spark.createDataFrame(boxes, "id int, a double, b double, c double, d double").select("id", G.envelope(F.col("a"), F.col("c"), F.col("b"), F.col("d")).alias("box"))
    want = sorted((p[0], q[0]) for p in boxes for q in boxes if p[1] <= q[2] and p[2] >= q[1] and p[3] <= q[4] and p[4] >= q[3])
    for cell, most in ((None, 2000), (1.0, 5), (40.0, 7)):
        got = R.box_join(df, df.withColumnsRenamed({"id": "id2", "box": "box2"}), "box", "box2", cell, most)
        assert sorted((x["id"], x["id2"]) for x in got.collect()) == want
    assert R.box_join(df, df.where("false").withColumnsRenamed({"id": "id2", "box": "box2"}), "box", "box2").count() == 0


def test_replace_and_read_back(spark, tmp_path):
    path = str(tmp_path / "boundary")
    rows = lambda *r: spark.createDataFrame(list(r), "adm_cd string, gid long")
    assert K.current(spark, path) is None
    assert K.replace_units(spark, path, rows(("a", 1), ("a", 2), ("b", 3)), "adm_cd") == (0, 3)
    assert K.replace_units(spark, path, rows(("a", 9)), "adm_cd") == (2, 1)
    assert sorted(tuple(r) for r in K.current(spark, path).select("adm_cd", "gid").collect()) == [("a", 9), ("b", 3)]


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "N", "add"), (2, "N", "attr"), (3, "S", "add")], "id long, region string, kind string")
    made = S.feature_collection(K.export_rows(rows, "region", "kind", ["all", "S", "unknown"]), ["file"], ["kind"], "id")
    K.write_collections(made, str(tmp_path / "x"))
    names = sorted(os.path.basename(f) for f in glob.glob(str(tmp_path / "x" / "file=*")))
    assert names == ["file=S_add", "file=all_add", "file=all_attr"]
    assert all(len(glob.glob(f"{tmp_path}/x/{n}/*.txt")) == 1 for n in names)
    empty = S.feature_collection(rows.where("false"), [], ["kind"], "id").collect()
    assert [r["geojson"] for r in empty] == ['{"type":"FeatureCollection","features":[]}']
    stay, n = K.deleted(rows, F.col("region") == "N")
    assert n == 2 and stay.count() == 1
    assert K.append_log(rows, str(tmp_path / "log")) and K.append_log(rows, str(tmp_path / "log")) and spark.read.parquet(str(tmp_path / "log")).count() == 6
    assert not K.append_log(rows.withColumn("x", F.expr("raise_error('no')")), str(tmp_path / "log"))
    K.status_csv(rows.withColumn("none", F.lit(None).cast("int")), str(tmp_path / "s"), ["id", "none"])
    assert sorted(r["id"] for r in spark.read.option("header", True).csv(str(tmp_path / "s")).collect()) == ["1", "2", "3"]


def test_layer_features(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.123456789, 0.0), (1.0, 0.0), (1.0, 1.0), (0.123456789, 0.0))])
    rows = spark.range(2).select(F.col("id").alias("ADM_CD"), F.lit("r").alias("Ri_Cd"), F.lit(1).alias("other"), F.when(F.col("id") == 0, F.array(F.array(ring))).alias("polygons"))
    got = K.layer_features(rows).collect()
    assert len(got) == 1 and got[0]["adm_cd"] == 0 and got[0]["geometry"][0][0][0]["x"] == 0.1234568


def test_files_on_disk(spark, tmp_path):
    from parcelflow.sources import files as N

    for name in ("12345678.pdf", "a/12345678_4-1.jpg", "b/12345678_4-1_2.jpg", "a/.ipynb_checkpoints/12345678_4-2.jpg", "b/x.JPG", "b/x.pdf"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    found = N.listed(spark, str(tmp_path))
    assert found.count() == 5 and N.bodies(found).count() == 1 and N.duplicate_sheets(found).first()["copies"] == 2
    assert {tuple(r)[:3] for r in N.documents(found).collect()} == {("main", "12345678", None)}
    assert N.documents_over_images(found).count() == 4  # hidden folders are not listed


def test_signed_tokens(spark):
    import base64
    import hashlib
    import hmac

    url = lambda b: base64.urlsafe_b64encode(b).rstrip(b"=").decode()
    for key in ("k", "x" * 64, "ß" * 100):
        for payload in ('{"sub":"é?>~"}', '{"exp":99}', '{"exp":101}', '{"exp":"soon"}', "", None):
            token = payload if payload is None else f"{url(b'{"alg":"HS256","typ":"JWT"}')}.{url(payload.encode())}"
            token = token and f"{token}.{url(hmac.new(key.encode(), token.encode(), hashlib.sha256).digest())}"
            plain = f"{url(b'{"alg":"none"}')}.{url((payload or '').encode())}"
            plain += "." + url(hmac.new(key.encode(), plain.encode(), hashlib.sha256).digest())
            rows = spark.createDataFrame([(payload, token, plain)], "payload string, token string, plain string")
            read = lambda c, k=key: J.claims(c, k, F.lit(100))
            got = rows.select(J.sign(F.col("payload"), key), read(F.col("token")), read(F.col("token"), "other"), read(F.concat("token", F.lit("."))), read(F.col("plain")), read(F.lit("a.?.b"))).first()
            assert tuple(got) == (token, None if payload in ('{"exp":99}', '{"exp":"soon"}') else payload, None, None, None, None)


def test_nearest_in_dense_and_coincident_places(spark):
    """Halved cells find what all pairs find: copies in one place, a dense spot, lone rows, places that are not numbers."""
    import random

    r = random.Random(5)
    rows = [(i, 0.31, 0.31) for i in range(90, 0, -1)] + [(100 + i, 0.5 + r.gauss(0, 0.001), 0.5 + r.gauss(0, 0.001)) for i in range(200)]
    rows += [(400 + i, r.uniform(-1, 1), r.uniform(-1, 1)) for i in range(100)] + [(600, 5.0, 5.0), (601, 5.05, 5.0), (602, -0.0, 0.0), (603, 0.0, 0.0), (604, float("nan"), 0.0), (605, float("nan"), 0.0), (606, None, 1.0)]
    df = spark.createDataFrame(rows, "a long, x double, y double")
    far = lambda p, q: ((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2) ** 0.5
    near = {p[0]: [(round(far(p, q), 9), q[0]) for q in rows[:-1] if p[0] != q[0] and far(p, q) <= 0.05] for p in rows[:-1]}
    want = {k: min(v)[1] for k, v in near.items() if v}
    for few in (None, 2, 3):
        got = R.nearest(df, df.withColumnRenamed("a", "b"), 0.05, F.col("a") != F.col("b"), ["a"], "b", few).collect()
        assert {x["a"]: x["b"] for x in got} == want and len(got) == len(want)


def test_box_join_deals_tasks_by_pairs_and_files_few_copies(spark, monkeypatch):
    """Few bytes may be many pairs; wide boxes on the left meet many small ones on the right in few cells."""
    points = spark.range(3000).select("id", G.envelope(F.col("id") % 50, F.col("id") % 60, F.col("id") % 50, F.col("id") % 60).alias("own"))
    wide = points.select(F.col("id").alias("a"), G.expand(F.col("own"), 10.0).alias("box"))
    monkeypatch.setattr(R, "TASK_PAIRS", 100_000, raising=False)
    got = R.box_join(wide, points, "box", "own")
    assert got.rdd.getNumPartitions() > 20
    at = [(i % 50, i % 60) for i in range(3000)]
    assert got.count() == sum(abs(x - u) <= 10 and abs(y - v) <= 10 for x, y in at[:300] for u, v in at) * 10


def test_box_join_tests_few_pairs_in_vain(spark, monkeypatch):
    """Cells are narrower than the boxes, so most pairs that meet in a cell are results; the tasks tell how many pairs there are."""
    points = spark.range(6000).select("id", (F.col("id") * 7919 % 997 / 20).alias("x"), (F.col("id") * 104729 % 991 / 20).alias("y"))
    points = points.select("id", G.envelope(F.col("x"), F.col("y"), F.col("x"), F.col("y")).alias("own"))
    wide = points.select(F.col("id").alias("a"), G.expand(F.col("own"), 10.0).alias("box"))
    monkeypatch.setattr(R, "TASK_PAIRS", 200_000)
    got = R.box_join(wide, points, "box", "own")
    at = [(i * 7919 % 997 / 20, i * 104729 % 991 / 20) for i in range(6000)]
    near = sum(abs(x - u) <= 10 and abs(y - v) <= 10 for x, y in at[::20] for u, v in at) * 20
    assert got.count() == pytest.approx(near, rel=0.05)
    assert got.rdd.getNumPartitions() * 200_000 < 3 * near


def test_code_tiers_broadcast_no_exploded_rows(spark, sf, monkeypatch):
    """Units of any number: their grams and keys go by shuffle, whatever their files' size, and find what the slow reading finds."""
    from parcelflow.plans.review import Tables

    monkeypatch.setattr(R, "MANY", 0)
    texts, units, valid = places.recognised(Tables(spark, sf))
    found = C.tiered_codes(texts, "p_partkey", "t", units, valid)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    listed, codes, got = [tuple(u) for u in units.collect()], {r[0] for r in valid.collect()}, {}
    for r in found.collect():
        got.setdefault(r["p_partkey"], (r["tier"], set()))[1].add(r["code"])
    want = {r["p_partkey"]: slow_codes(r["t"], listed, codes) for r in texts.collect()}
    assert got == {k: v for k, v in want.items() if v[1]}


def test_run_keys_stand_for_all_variants(spark):
    """A code is among a run's variants just when they share a key."""
    runs = spark.createDataFrame([(r,) for r in ("1234567", "12345678", "123456789", "1234567890", "12345678901", "0000000", "00000000", "010010010", "123456", "123456789012")], "run string")
    codes = runs.select(F.explode(X.fuzzy_variants(F.col("run"))).alias("code")).union(spark.createDataFrame([("99999999",), ("12345687",), ("00000012",), ("01234568",)], "code string")).distinct()
    pairs = runs.crossJoin(codes).select("run", "code", F.array_contains(X.fuzzy_variants(F.col("run")), F.col("code")).alias("want"), F.arrays_overlap(X.run_keys(F.col("run")), X.code_keys(F.col("code"))).alias("got"))
    rows = pairs.collect()
    assert all(r["want"] == r["got"] for r in rows) and {r["want"] for r in rows} == {True, False}
