"""Operators 2, 6, 7, 8, 9 and the pipeline against brute force, round trips and stated properties."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parcelflow.llm import common, components, mixing, packing, sharding, tokens, vectors
from tests.llm.data import awkward, plain, table
from tests.llm.test_documents import slow_components, slow_features, slow_fingerprint, slow_lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5000, 5000 + i) for i in range(1, 300)] + [(None, 3), (7, 7)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in links:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()))
    assert got == {x: find(x) for x in parent}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_of_stars_are_read_off(spark, monkeypatch):
    """Each v of stars is its component's smallest node already, so nothing is written but the links; a path of 4 takes more."""
    written, keep = [], components.durable
    monkeypatch.setattr(components, "durable", lambda df, *rest: written.append(rest) or keep(df, *rest))
    stars = [(100 * k + i, 100 * k) for k in range(3) for i in range(1, 40)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(stars, "u long, v long")).collect()))
    assert got == dict(stars) | {v: v for _, v in stars} and len(written) == 1
    path = components.connected_components(spark.createDataFrame([(4, 3), (3, 2), (2, 1)], "u long, v long"))
    assert dict(map(tuple, path.collect())) == {1: 1, 2: 1, 3: 1, 4: 1} and len(written) > 2


def test_packing(spark):
    r = random.Random(3)
    sizes = [r.choice([1, 5, 700, 3000, 8192, r.randint(1, 8192)]) for _ in range(3000)]
    where, offset, bins = packing.pack(sizes)
    used, held = Counter(), defaultdict(list)
    for n, b, o in zip(sizes, where, offset):
        used[b] += n
        held[b].append((o, n))
    for b, items in held.items():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert bins[b] == min(s for s in packing.SIZES if s >= used[b])
    assert sum(bins) <= 1.05 * sum(sizes)
    assert packing.pack([]) == ([], [], [])
    # one permitted size: plain best fit, falling
    rooms = []
    for n in sorted(sizes, reverse=True):
        fit = [x for x in rooms if x >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(8192 - n)
    assert len(packing.pack(sizes, (8192,))[2]) == len(rooms)


def price(bins):
    return sum(packing.cost(x) for x in bins)


def test_packing_sizes_jointly():
    r = random.Random(13)
    cases = [[600] * 1000, [1100] * 1000, [520] * 100, [1] * 5000, [8192] * 5, [5000, 3000] * 50, [r.choice([600, 1100, 3000, 90]) for _ in range(700)], [min(8192, int(r.lognormvariate(6, 1.3)) + 1) for _ in range(4000)]]
    for sizes in cases:
        one = [price(packing.pack(sizes, (s,))[2]) for s in packing.SIZES if s >= max(sizes)]
        assert price(packing.pack(sizes)[2]) <= min(one) + 1e-6
    assert price(packing.pack([600] * 1000)[2]) <= 709_680 and price(packing.pack([1100] * 1000)[2]) <= 1_320_176


def test_packing_against_all_partitions():
    sizes = (8, 16, 32)
    fee = lambda n: packing.cost(next(s for s in sizes if s >= n), sizes)
    r, ratios = random.Random(14), []
    for _ in range(150):
        items = [r.randint(1, 32) for _ in range(r.randint(1, 8))]
        full = (1 << len(items)) - 1
        total = [sum(x for k, x in enumerate(items) if m >> k & 1) for m in range(full + 1)]
        best = [0.0] + [float("inf")] * full
        for m in range(1, full + 1):
            sub, low = m, m & -m
            while sub:
                if sub & low and total[sub] <= 32:
                    best[m] = min(best[m], best[m ^ sub] + fee(total[sub]))
                sub = (sub - 1) & m
        ratios.append(sum(packing.cost(b, sizes) for b in packing.pack(items, sizes)[2]) / best[full])
    assert min(ratios) >= 1 - 1e-9 and max(ratios) <= 1.25 and sum(x < 1 + 1e-9 for x in ratios) >= 90


def token_ids(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary())
    found = [t.encode(r[1] or "", add_special_tokens=False).ids for r in rows]
    return [[*x, 2] if x else [] for x in found]


def test_packing_documents(spark):
    rows = awkward() + [(600, "w " * 20_000, None, None, None, None, None)]
    docs = table(spark, rows).withColumn("row", F.lit("own")).withColumn("size", F.lit(-1)).withColumn("bin", F.lit(0))
    got = packing.pack_documents(docs, sizes=(8, 64, 512)).collect()
    size = Counter()
    for g in got:
        size[g["doc_id"]] += g["n_tokens"]
        assert (g["bin"] is None) == (g["n_tokens"] == 0) and g["n_tokens"] <= 512
    want = Counter()
    for r, ids in zip(rows, token_ids(rows)):
        want[r[0]] += len(ids)
    assert size == want and len({g["doc_id"] for g in got}) == len({r[0] for r in rows})
    bins = defaultdict(list)
    for g in got:
        if g["bin"] is not None:
            bins[g["bin"]].append(g)
    for b in bins.values():
        assert sum(g["n_tokens"] for g in b) == b[0]["bin_tokens"] <= b[0]["bin_size"]
        spans = sorted((g["offset"], g["n_tokens"]) for g in b)
        assert all(a + n == c for (a, n), (c, _) in zip(spans, spans[1:])) and spans[0][0] == 0
    assert packing.pack_documents(table(spark, [])).count() == 0


def test_packed_sequences_hold_every_id(spark):
    rows = [(k, *r[1:]) for k, r in enumerate(awkward())]
    got = packing.sequences(table(spark, rows), sizes=(64, 512)).collect()
    pieces = defaultdict(list)
    for g in got:
        assert len(g["ids"]) <= g["bin_size"]
        for d, a, b in zip(g["doc_ids"], g["starts"], [*g["starts"][1:], len(g["ids"])]):
            pieces[d].append(tuple(g["ids"][a:b]))
    for k, ids in enumerate(token_ids(rows)):
        assert Counter(pieces[k]) == Counter(tuple(ids[a : a + 512]) for a in range(0, len(ids), 512))
    assert packing.sequences(table(spark, [])).count() == 0


def test_packing_deals_equal_rows_over_groups(spark):
    rows = spark.range(20_000).selectExpr("id AS row", "7L AS id", "600L AS size")
    got = packing.layout(rows).selectExpr("bin >> 32 AS g").groupBy("g").count().collect()
    assert len(got) >= 5 and max(r["count"] for r in got) < 2 * packing.GROUP and sum(r["count"] for r in got) == 20_000


def slow_targets(sizes):
    out, left, free = {}, 1.5 * sum(sizes), [i for i, s in enumerate(sizes) if s]
    while free:
        total = sum((3, 1, 2)[i % 3] for i in free)
        over = [i for i in free if left * (3, 1, 2)[i % 3] / total > 2 * sizes[i]]
        if not over:
            return [out.get(i, left * (3, 1, 2)[i % 3] / total if i in free else 0) for i in range(len(sizes))]
        for i in over:
            out[i] = 2 * sizes[i]
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in over]
    return [out.get(i, 0) for i in range(len(sizes))]


def test_targets_and_plan():
    r = random.Random(4)
    for _ in range(200):
        sizes = [r.choice([0, 1, 10, 1000, r.randint(1, 10**6)]) for _ in range(r.randint(1, 9))]
        assert mixing.targets(sizes) == pytest.approx(slow_targets(sizes))
        plan = mixing.plan(sizes, block=64)
        for s in plan:
            n = -(-s.size // 64)
            if not n:
                assert s.slots == 0
                continue
            blocks = [min(64, s.size - 64 * int(b)) for b in mixing.permuted(np.arange(s.slots) % n, n, 7_000_021 + s.number)]
            taken = sum(blocks[:-1]) + min(blocks[-1], s.rest) if blocks else 0
            assert taken == min(round(s.target), 2 * s.size)
        got = mixing.draws(plan)
        for s in plan:
            mine = sorted((a, n) for _, k, a, n in got if k == s.number)
            assert sum(n for _, n in mine) == s.slots and all(a + n == b for (a, n), (b, _) in zip(mine, mine[1:]))


def test_permutation():
    for n in (1, 2, 3, 10, 64, 1000):
        p = mixing.permuted(np.arange(n), n, 99)
        assert sorted(p.tolist()) == list(range(n))
        assert (mixing.permuted(p, n, 99, inverse=True) == np.arange(n)).all()
    assert (mixing.permuted(np.arange(1000), 1000, 1) != mixing.permuted(np.arange(1000), 1000, 2)).any()


def test_mixing(spark):
    rows = awkward()
    docs = table(spark, rows)
    got = mixing.mix(docs)
    a = plain(got.collect())
    assert a == plain(mixing.mix(docs.repartition(5)).collect())
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(len(WORD.findall(r[1] or "")) for r in rows if r[3] == s) for s in names}
    target = dict(zip(names, slow_targets([size[s] for s in names])))
    assert sorted((x[0] is not None, x[0] or 0, x[1]) for x in a) == sorted((r[0] is not None, r[0] or 0, len(WORD.findall(r[1] or ""))) for r in rows)
    by = defaultdict(int)
    for x in a:
        assert 0 <= x[4] <= 2 * x[1]
        by[x[2], x[3]] += x[4]
    for s in names:
        assert any(k[0] == size[s] and k[1] == pytest.approx(target[s]) and abs(v - target[s]) <= 1 for k, v in by.items())
    texts = mixing.mixed(docs, n_chars_col="n_chars")
    assert texts.columns == docs.columns
    words, taken = Counter(), Counter()
    for r in texts.collect():
        assert r["n_chars"] == len(r["text"])
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    for x in a:
        taken[x[0]] += x[4]
    assert words == +taken
    assert mixing.mix(table(spark, [])).count() == 0 and mixing.mixed(table(spark, [])).count() == 0


def test_mixing_takes_one_python_worker_a_task(spark):
    docs = common.durable(table(spark, awkward(3)), "docs")
    for mix in (mixing.mix, mixing.mixed):
        plan = mix(docs)._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall("ArrowEvalPython|BatchEvalPython|MapInArrow|MapInPandas", plan)) == 1
        assert "LogicalRDD" not in plan  # tuples that went through Python workers of another environment


def test_short_tables(spark):
    rows = [("a", 1), (None, 2), ("é", None)]
    assert common.short_table(spark, rows, "name string, number int").collect() == spark.createDataFrame(rows, "name string, number int").collect()
    empty = common.short_table(spark, [], "name string, number int")
    assert not empty.collect() and empty.dtypes == [("name", "string"), ("number", "int")]


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = awkward() + [(700, "Ünï códe ß ́ ıİ ΑΣ don't it's\x1c\x85 x y 12 34\r\n\x0b\x0cab é", None, None, None, None, None)]
    t = Tokenizer.from_file(tokens.vocabulary())
    ids = {r[1]: [*t.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows}
    for size in (tokens.SHARD_BYTES, 3000):
        tokens.write(table(spark, rows), str(tmp_path / "t"), shard_bytes=size)
        got = tokens.read(spark, str(tmp_path / "t")).collect()
        crc = Counter((r[0], len(ids[r[1]]), zlib.crc32(np.array(ids[r[1]], "<u4").tobytes())) for r in rows)
        assert Counter((g["key"], g["n_tokens"], g["ids_crc32"]) for g in got) == crc
        at = 0
        for g in sorted(got, key=lambda g: g["start"]):
            assert g["start"] == at
            at += g["n_tokens"]
        order = [g["key"] for g in sorted(got, key=lambda g: g["start"])]
        assert order == sorted(order, key=lambda k: (k is not None, k or 0))
        keys = [5, 700, 3, 304, 999_999, -1]
        found = tokens.lookup(spark, str(tmp_path / "t"), keys).collect()
        assert Counter((f["key"], tuple(f["ids"])) for f in found) == Counter((r[0], tuple(ids[r[1]])) for r in rows if r[0] in keys)
    tokens.write(table(spark, []), str(tmp_path / "e"))
    assert tokens.read(spark, str(tmp_path / "e")).count() == 0


def test_lookup_reads_two_shards_for_two_far_keys(spark, tmp_path):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('some words of text ', id, ' and more of them') AS text")
    tokens.write(docs, str(tmp_path / "t"), shard_bytes=200)
    assert tokens.directory(spark, str(tmp_path / "t")).count() > 40
    found = tokens.lookup(spark, str(tmp_path / "t"), [0, 399])
    plan = found._jdf.queryExecution().executedPlan()
    assert plan.executeCollectPublic is not None
    found._jdf.queryExecution().toRdd().count()
    leaves = plan.collectLeaves()
    assert sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size())) == 2
    assert sorted(r["key"] for r in found.collect()) == [0, 399]


def test_other_tokenizers_encode_plainly():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, e = Tokenizer.from_file(path), tokens.Encoder(path, 2)
    texts = ["a  b\n c don't", "", "é  ", " x"]
    assert not e.by_parts and tokens.Encoder(tokens.vocabulary(), 2).by_parts
    assert [np.frombuffer(x, e.kind).tolist() for x in e(texts)] == [[*t.encode(x, add_special_tokens=False).ids, 2] for x in texts]


def test_long_parts_are_not_remembered():
    e = tokens.Encoder(tokens.vocabulary(), 2)
    long = [("x" * n) + end for n in (100, 5000) for end in ("", "!!", "1")]
    first = e([*long, "short words"])
    assert e([*long, "short words"]) == first and not any(len(x) > tokens.LONG for x in e.cache)


def test_parts_encode_as_the_tokenizer_does(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 400)
    e, r = tokens.Encoder(tokens.vocabulary(), 2), random.Random(4)
    letters = "aBcdzÉßñªºµÿ×'‘’.,!?<|>#&*-_/\\@()$%^~`+=:;\"0129½²Ⅷ \t\n\r\xa0\u2003e\u0301\u0338éİςΣя你😀"
    whole = ["<|endoftext|>", "<|startoftext|>", "'s", "'re", "</w>", "don't"]
    texts = ["".join(r.choice(whole if r.random() < 0.06 else letters) for _ in range(r.randrange(40))) for _ in range(6000)] + ["*İ#", "Ab.", "ab'.", "aB's'"]
    found = [x for k in range(0, len(texts), 100) for x in e(texts[k : k + 100])]
    assert e.cache.older and len(e.cache) + len(e.cache.older) < 3000
    assert [np.frombuffer(x, e.kind).tolist() for x in found] == [[*x.ids, 2] for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_perfect_hash_is_minimal():
    for n in (0, 1, 2, 3, 50, 2000):
        keys = random.Random(n).sample(range(-(10**12), 10**12), n)
        index = tokens.build_index(keys, range(n), [1] * n)
        first, run = tokens.find_in_index(index, keys)
        assert first.tolist() == list(range(n)) and run.tolist() == [1] * n
        buckets = max(1, -(-n // 3))
        assert len(index) == 8 + 4 * buckets + 12 * n
    other = tokens.find_in_index(index, range(2 * 10**12, 2 * 10**12 + 1000))[1]
    assert other.sum() == 0


@pytest.mark.parametrize("limit", [100, 1500, 1 << 20])
def test_sharding(spark, limit):
    rows = awkward() + [(800, "same text of some length", None, None, None, None, None)] * 30
    got = sharding.shards(table(spark, rows), limit=limit).collect()
    assert Counter((g["doc_id"], g["n_bytes"]) for g in got) == Counter((r[0], len((r[1] or "").encode())) for r in rows)
    held = defaultdict(list)
    for g in got:
        held[g["shard"], g["page"]].append(g["n_bytes"])
        assert g["depth"] == len(g["shard"])
    assert all(sum(x) <= limit or len(x) == 1 for x in held.values())
    names = sorted({s for s, _ in held})
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    for s in names:  # only oversized buckets split
        if s:
            whole = sum(g["n_bytes"] for g in got if g["shard"].startswith(s[:-1]))
            assert whole > limit
    assert sharding.shards(table(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [100, 1500])
def test_sharding_equals_its_sql(spark, tmp_path, limit):
    import duckdb

    from parcelflow.llm.oracles import sharding_sql

    rows = awkward() + [(800, "same text of some length", None, None, None, None, None)] * 30
    docs = table(spark, rows)
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/d")
    want = duckdb.sql(sharding_sql(f"'{tmp_path}/d/*.parquet'", limit)).fetchall()
    assert plain(sharding.shards(docs, limit=limit).collect()) == plain(want)


def test_shards_are_written_whole(spark, tmp_path):
    rows = awkward() + [(800, "same text of some length", None, None, None, None, None)] * 30
    docs = table(spark, rows).withColumn("path", F.lit("p")).withColumn("depth", F.lit(3))
    sharding.write(docs, str(tmp_path / "s"), limit=1500)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert plain(back.select(*docs.columns).collect()) == plain(docs.collect())
    size = defaultdict(list)
    for r in back.selectExpr("_metadata.file_path AS f", "shard", "page", "octet_length(coalesce(text, '')) AS n").collect():
        size[r["shard"], r["page"]].append((r["f"], r["n"]))
    assert all(len({f for f, _ in x}) == 1 and (sum(n for _, n in x) <= 1500 or len(x) == 1) for x in size.values())


def test_extra_columns_with_clashing_names(spark):
    """Operators that return the columns of docs, with every name they use inside."""
    from parcelflow.llm import langid, line_dedup, quality, simhash

    rows = [(r[0], r[1], r[2], r[3], r[4]) for r in awkward(4) if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = "id th h own own_id doc fp key rep node component cut near pos line rows copy copies spans size number start block low high skip part whole f at stratum of_stratum cutoff kept base_failed p n_words path row leaf h1 h2 halves k v t all first chunk order".split()
    wide = docs.select("*", *[F.lit(f"own {n}").alias(n) for n in names], F.lit(1).alias("__h"), F.lit(2).alias("__id"), F.lit(3).alias("__text"))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for f in (simhash.keep_one, line_dedup.keep_lines, lambda d: mixing.mixed(d, n_chars_col="n_chars"), lambda d: quality.keep_good(d, labels), lambda d: langid.identify(d, {}).drop("lang_pred", "score"), lambda d: line_dedup.dedup_lines(d).drop("n_lines", "n_dropped", "n_near")):
        got = f(wide)
        assert got.columns == wide.columns
        assert plain(got.select(*docs.columns).collect()) == plain(f(docs).select(*docs.columns).collect())
        assert {tuple(r) for r in got.select(*names, "__h", "__id", "__text").collect()} == {(*[f"own {n}" for n in names], 1, 2, 3)}


def test_vectors(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(1500, 16))
    x[200:500] = x[0] + 0.3 * r.normal(size=(300, 16))
    x[600:640] = x[1]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, x[1].tolist()), (2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [None] + [1.0] * 15), (2005, [float("inf")] * 16), (2006, x[3][:9].tolist()), (2007, [1e300] * 16), (2008, [1e-300] * 16), (2007, [1e300] * 16), (2009, None)]
    got = {}
    out = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit(1)))
    found = out.collect()
    assert len(found) == len(rows)
    m, ok = np.zeros((len(rows), 16)), []
    for i, (_, v) in enumerate(rows):
        if v and all(e is not None and np.isfinite(e) for e in v) and any(v):
            w = np.array(v) / np.abs(v).max()
            m[i, : len(v)] = w / np.linalg.norm(w)
    s = m @ m.T >= 0.9
    np.fill_diagonal(s, False)
    label = list(range(len(rows)))
    for i, j in zip(*np.nonzero(s)):
        a, b = i, j
        while label[a] != a:
            a = label[a]
        while label[b] != b:
            b = label[b]
        label[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        a = i
        while label[a] != a:
            a = label[a]
        label[i] = a
        groups[a].append(rows[i][0])
    least = {a: min((k for k in g if k is not None), default=None) for a, g in groups.items()}
    want = plain([(rows[i][0], int(s[i].sum()), least[label[i]], rows[i][0] == least[label[i]]) for i in range(len(rows))])
    got = plain([tuple(f) for f in found])
    links, all_links = sum(g[1] for g in got), sum(w[1] for w in want)
    assert 0.97 * all_links <= links <= all_links
    assert sum(a[2] == b[2] for a, b in zip(got, want)) >= 0.99 * len(want)
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def check_links(spark, x, audit):
    """Against all pairs: no link counted that is none, both ends counted, nothing linked without a count."""
    s = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = s @ s.T >= 0.9
    np.fill_diagonal(s, False)
    out = vectors.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), audit=audit).collect()
    got, group = np.zeros(len(x), int), np.zeros(len(x), int)
    for r in out:
        got[r["vec_id"]], group[r["vec_id"]] = r["n_links"], r["component_id"]
        assert r["kept"] == (r["vec_id"] == r["component_id"])
    want, size = s.sum(1), np.bincount(group, minlength=len(x))
    assert (got <= want).all() and not ((got == 0) & (size[group] > 1)).any() and not ((got > 0) & (size[group] == 1)).any()
    has = want > 0
    assert (got[has] / want[has]).mean() >= 0.95 and got.sum() >= 0.97 * want.sum() and got.sum() % 2 == 0
    assert audit[-1]["per_query"] >= vectors.RECALL and audit[-1]["pooled"] >= vectors.RECALL


@pytest.mark.parametrize("most", [512, 6])
def test_vector_links_count_at_both_ends(spark, monkeypatch, most):
    """Over 64 leaves, as one list of centroids and as a tree of them."""
    for name, value in {"CLUSTER": 30, "SHARD": 90, "MAX_CLUSTERS": most}.items():
        monkeypatch.setattr(vectors, name, value)
    r = np.random.default_rng(21)
    x = r.normal(size=(3000, 16))
    x[:500] = x[0] + 0.3 * r.normal(size=(500, 16))
    x[1000:1900] = np.repeat(x[2000:2300], 3, axis=0) + 0.25 * r.normal(size=(900, 16))
    audit = []
    check_links(spark, x, audit)


def test_deciding_takes_each_meeting_once():
    """Of all meetings of two nodes, exactly one decides."""
    r = np.random.default_rng(5)
    for _ in range(300):
        near = [r.permutation(7)[:4] for _ in range(2)]
        routes = int(r.integers(1, 5))
        for all_leaves in (False, True):
            n = 0
            for q, x in ((0, 1), (1, 0)):
                for c in near[x][:2]:
                    if all_leaves or c in near[q][:routes]:
                        asks = (None, None) if all_leaves else (near[q][None, :routes], near[x][None, :routes])
                        n += vectors.deciding(c, np.array([q]), np.array([x]), near[q][None, :2], near[x][None, :2], *asks)[0]
            meet = all_leaves or bool({*near[1][:2]} & {*near[0][:routes]} or {*near[0][:2]} & {*near[1][:routes]})
            assert n == meet


def test_pipeline(spark, tmp_path):
    """Each stage against brute force on what the stage before has kept."""
    rows = [r for r in awkward(9) if r[0] is not None]
    docs = table(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    folder = str(tmp_path)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality_rules"](spark, docs, folder)
    assert kept.columns == docs.columns
    good = [r[:5] for r in rows if (f := slow_features(r[1]))[0] >= 10 and 100 * f[4] <= 20 * f[0]]
    assert plain(kept.collect()) == plain(good)
    lines = stage["line_dedup"](spark, kept, folder)
    drop = slow_lines(good, 20)
    want = []
    for r in good:
        gone = drop.get((r[0], r[1]), {})
        text = "\n".join(x for k, x in enumerate(r[1].split("\n")) if k not in gone)
        if not gone or WORD.search(text):
            want.append((*r[:1], text, *r[2:4], len(text)))
    assert plain(lines.collect()) == plain(want)
    lone = stage["simhash_near_dedup"](spark, lines, folder)
    group = slow_components([r[0] for r in want], [slow_fingerprint(r[1]) for r in want], 3)
    assert plain(lone.collect()) == plain({r for r, g in zip(want, group) if r[0] == g})
    mix = stage["mix_sources"](spark, lone, folder)
    assert mix.columns == docs.columns and {r[0] for r in mix.collect()} <= {r[0] for r in lone.collect()}
    packed = stage["best_fit_packing"](spark, mix, folder).collect()
    assert sum(p["n_tokens"] for p in packed) == sum(map(len, token_ids([(0, r["text"]) for r in mix.collect()])))
    assert len(corpus_pipeline.run(spark, folder).collect()) == len(packed)


def test_near_dedup_stage_reaches_similarity(spark):
    """Copies from 0.6 to 1, in a group and apart, against all pairs."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    texts = []
    for k in range(60):
        base = [word() for _ in range(r.choice([30, 120, 300]) if k else 300)]
        texts.append(base)
        for _ in range(40 if k == 0 else 2):
            copy = list(base)
            for i in r.sample(range(len(base)), max(1, int(len(base) * r.choice([0.005, 0.01, 0.02, 0.03, 0.06])))):
                copy[i] = word()
            texts.append(copy)
    texts += [["Few", "words"], ["few", "words"], ["other", "words"]]
    r.shuffle(texts)
    sets = [{" ".join(t[i : i + 5]).lower() for i in range(max(1, len(t) - 4))} for t in texts]
    prints = [slow_fingerprint(" ".join(t)) for t in texts]
    label, pairs = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            near = common >= 0.8 * (len(sets[i]) + len(sets[j]) - common)
            pairs += near and (prints[i] ^ prints[j]).bit_count() > 3
            if near or (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    assert pairs > 50
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, "")
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted(set(label))
    assert dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs.limit(0), "").count() == 0


def test_vectors_below_the_target_are_searched_whole(spark, monkeypatch):
    """A group spread over more clusters than are ranked at first; the target asks for every link."""
    for name, value in {"CLUSTER": 8, "ROUTES": 60, "OVERLAP": 1, "BEAM": 2, "RECALL": 1.0}.items():
        monkeypatch.setattr(vectors, name, value)
    r = np.random.default_rng(9)
    x = r.normal(size=16) + 0.32 * r.normal(size=(640, 16))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(1) - 1
    out = vectors.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    assert {g["vec_id"]: g["n_links"] for g in out.collect()} == dict(enumerate(want.tolist()))
