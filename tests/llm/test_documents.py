"""Operators 1, 3, 4, 5 and 10 against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from parcelflow.llm import components, langid, line_dedup, quality, queries, secrets, simhash
from tests.llm.data import awkward, plain, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_agrees_over_pieces(monkeypatch):
    texts = [r[1] for r in awkward()] + ["a b", "a b c", "a b c d"]
    want = [slow_fingerprint(t) for t in texts]
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(simhash, "CHUNK", size)
        assert [simhash.fingerprint(t) for t in texts] == want


def slow_components(ids, prints, bits):
    label = list(range(len(ids)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                label[root(i)] = root(j)
    groups = {}
    for i, d in enumerate(ids):
        groups.setdefault(root(i), []).append(d)
    return [min((d for d in groups[root(i)] if d is not None), default=None) for i in range(len(ids))]


def test_simhash(spark):
    rows = awkward()
    got = plain(simhash.near_duplicates(table(spark, rows)).select("doc_id", "fp", "component_id").collect())
    prints = [slow_fingerprint(r[1]) for r in rows]
    want = slow_components([r[0] for r in rows], prints, 3)
    assert got == plain([(r[0], (p ^ 1 << 63) - (1 << 63), c) for r, p, c in zip(rows, prints, want)])
    assert simhash.near_duplicates(table(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [1000, 2])
def test_simhash_links_are_complete(spark, hot):
    import random

    r = random.Random(1)
    prints = {r.getrandbits(64) for _ in range(60)} | {0}
    prints |= {p ^ sum(1 << b for b in r.sample(range(64), k)) for p in list(prints) for k in (1, 2, 3, 4) for _ in range(3)}
    signed = [(p ^ 1 << 63) - (1 << 63) for p in prints]
    got = {frozenset(x) for x in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), hot=hot).collect()}
    m = (1 << 64) - 1
    assert got == {frozenset((a, b)) for a in signed for b in signed if 0 < ((a & m) ^ (b & m)).bit_count() <= 3}


def few_files(spark, monkeypatch, module, run, *names):
    """The tables `names` that run() writes by module.durable come in few files, whatever the number of shuffle partitions; run()'s rows."""
    found, keep = {}, module.durable

    def durable(df, name, *rest):
        made = keep(df, name, *rest)
        found.setdefault(name, []).append(len(made.inputFiles()))
        return made

    monkeypatch.setattr(module, "durable", durable)
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = run().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    most = 2 * spark.sparkContext.defaultParallelism
    assert {name for name in names if max(found[name]) > most} == set(), found
    return rows


def test_simhash_writes_small_tables_in_few_files(spark, monkeypatch):
    rows = [(i, f"word{i} and some others, {i * i} of them", None, None, None, None, None) for i in range(400)]
    got = few_files(spark, monkeypatch, simhash, lambda: simhash.near_duplicates(table(spark, rows)), "classes", "labelled")
    assert len(got) == len(rows)


def test_simhash_keeps_one(spark):
    rows = awkward()
    docs = table(spark, rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    groups = {}
    for r, c in zip(rows, slow_components(list(range(len(rows))), [slow_fingerprint(r[1]) for r in rows], 3)):
        groups.setdefault(c, []).append(r)
    want = [min(g, key=lambda r: (r[0] is None, r[0])) for g in groups.values()]
    assert sorted(str(r[0]) for r in kept.collect()) == sorted(str(r[0]) for r in want)
    assert simhash.keep_one(table(spark, [])).count() == 0


def test_line_dedup_writes_small_tables_in_few_files(spark, monkeypatch):
    rows = [(i, f"this line of {i:05d} is longer than the others are\nand {i * i} follows", None, None, None, None, None) for i in range(400)]
    got = few_files(spark, monkeypatch, line_dedup, lambda: line_dedup.dedup_lines(table(spark, rows)), "first", "live", "candidates", "near")
    assert len(got) == len(rows)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def slow_lines(rows, near_chars):
    # rows equal in id and text come out alike
    docs = sorted({(r[0], r[1]) for r in rows}, key=lambda d: (d[0] is not None, d[0] or 0))
    seen, drop = [], {}
    for d in docs:
        for k, line in enumerate((d[1] or "").split("\n")):
            if WORD.search(line):
                equal = line in seen
                near = equal or len(line) >= near_chars and any(len(s) >= near_chars and abs(len(line) - len(s)) < 2 and edits(line, s) <= 1 for s in seen if s[: len(line) // 2] == line[: len(line) // 2] or s[-(len(line) // 3) :] == line[-(len(line) // 3) :])
                if near:
                    drop.setdefault(d, {})[k] = equal
                seen.append(line)
    return drop


def test_line_dedup(spark):
    rows = [r for r in awkward(3) if r[0] is not None]  # without ids the order is that of hashes
    base = "a line that is long enough to take part in it all"
    rows += [(400, base + "\n" + base[:-1] + "\nshort\nshort", None, None, None, None, None), (401, base[:9] + "X" + base[10:] + "\n" + base[:9] + "Y" + base[9:], None, None, None, None, None), (402, "z" * 200 + "\n" + "z" * 201 + "\n" + "z" * 64 + "q" + "z" * 136, None, None, None, None, None)]
    docs = table(spark, rows)
    drop = slow_lines(rows, line_dedup.NEAR_CHARS)
    want = []
    for r in rows:
        gone = drop.get((r[0], r[1]), {})
        lines = None if r[1] is None else r[1].split("\n")
        text = None if lines is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
        want.append((r[0], text, 0 if lines is None else len(lines), len(gone), sum(not e for e in gone.values())))
    assert any(w[4] for w in want) and any("short" in (x or "") and n for _, x, _, n, _ in want)
    got = line_dedup.dedup_lines(docs).select("doc_id", "text", "n_lines", "n_dropped", "n_near")
    assert plain(got.collect()) == plain(want)
    assert line_dedup.dedup_lines(docs).columns[: len(docs.columns)] == docs.columns
    assert line_dedup.keep_lines(table(spark, [])).count() == 0
    everything = line_dedup.dedup_lines(table(spark, awkward(3)))
    assert everything.count() == len(awkward(3))


def test_line_dedup_equals_its_sql(spark, tmp_path):
    """Many near lines, against the registered SQL."""
    import random

    import duckdb

    from parcelflow.llm import oracles

    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(2, 8)))
    base = [" ".join(word() for _ in range(r.randint(2, 12))) for _ in range(80)] + ["no", "yes", "a b"]

    def line():
        t = r.choice(base)
        at = r.randrange(len(t))
        return r.choice([t, t[:at] + "z" + t[at + 1 :], t[:at] + t[at + 1 :], t[:at] + "q" + t[at:], ""])

    rows = [(i, "\n".join(line() for _ in range(r.randint(1, 6)))) for i in range(150)] + [(900, None), (901, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op3_line_dedup(spark, str(tmp_path)).collect()
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duckdb.sql(oracles.line_dedup_sql()).fetchall()
    assert plain(got) == plain(want) and sum(x["n_near"] for x in got) >= 50


def test_secrets(spark):
    key = "AKIA" + "Q" * 16
    texts = ['password = "hunter22"', "é token:abc api-key", f"é {key} and API_KEY=deadbeefdeadbeefdeadbeef00", "token: token: abcdefgh", f"{key[:19]}", "a" * 23 + " " + "a" * 24, None, "", f"{key} {key}", "x" * 200_000 + " secret=abcdefg"]
    rows = [(i, t, None, None, None, "k", None) for i, t in enumerate(texts)] + [(None, texts[0], None, None, None, None, None), (1, texts[1], None, None, None, None, None)]
    docs = table(spark, rows)
    assign = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    want = []
    for r in rows:
        t = r[1] or ""
        a = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        k = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        h = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        spans = ",".join(f"{('assign', 'access', 'hex')[x]}:{s}:{e}" for s, x, e in sorted(a + k + h))
        want.append((r[0], len(a), len(k), len(h), hashlib.sha256(spans.encode()).hexdigest()))
    findings, ledger = secrets.scan(docs)
    got = secrets.digest(findings)
    assert plain(got.drop("spans").collect()) == plain(want)
    assert ledger.count() == len({t or "" for t in texts})
    more = docs.union(table(spark, [(50, "new secret=abcdef1", None, None, None, None, None)]))
    again, ledger2 = secrets.scan(more, ledger)
    assert ledger2.count() == ledger.count() + 1
    assert ledger2.exceptAll(ledger).count() == 1 and ledger.exceptAll(ledger2).count() == 0
    other = secrets.BASE[:1]
    assert secrets.scan(docs, ledger2, rules=other)[1].count() == 2 * ledger.count() + 1
    assert secrets.scan(table(spark, []))[0].count() == 0
    found, ledger3, scanned = secrets.scan_in_instalments(docs, 3)
    assert plain(secrets.digest(found).drop("spans").collect()) == plain(want)
    assert sum(scanned) == ledger3.count() == len({t or "" for t in texts})
    found, _, scanned = secrets.scan_in_instalments(docs, 2, ledger3)
    assert scanned == [0, 0] and found.count() == len(rows)
    pem = secrets.find("-----BEGIN RSA PRIVATE KEY-----")
    assert pem == [(0, 3, 31)]


def test_secrets_of_a_text_in_many_rows(spark, monkeypatch):
    monkeypatch.setattr(secrets, "OFTEN", 20)
    docs = spark.range(500).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'secret=abcdefgh' ELSE concat('token: xyz', id, 'abcd') END AS text")
    got = secrets.digest(secrets.scan(docs)[0]).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(500)) and all(r["n_assign"] == 1 for r in got)


def test_language_grams_agree_over_pieces(monkeypatch):
    text = "Abc dé, fgh! " * 50
    x, n = langid.grams(text)
    line = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    line = re.sub(" +", " ", line)
    want = Counter(c for c in line if c != " ") + Counter(zip(line, line[1:])) + Counter(zip(line, line[1:], line[2:]))
    code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    assert dict(zip(x.tolist(), n.tolist())) == {code(g): v for g, v in want.items()}
    for size in (1, 2, 3, 7, 100):
        monkeypatch.setattr(langid, "CHUNK", size)
        y, m = langid.grams(text)
        assert (x == y).all() and (n == m).all()


def slow_language(profiles, text):
    """The out-of-place distance, written out."""
    line = " " + " ".join("".join(c if c.isalpha() else " " for c in (text or "").lower()).split()) + " "
    if not line.strip():
        return "und"
    n = Counter(c for c in line if c != " ") + Counter(line[i : i + 2] for i in range(len(line) - 1)) + Counter(line[i : i + 3] for i in range(len(line) - 2))
    code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    mine = sorted((-v, code(g)) for g, v in n.items())[: langid.TOP]
    away = {lang: sum(abs(ranks.index(c) - i) if c in ranks else langid.TOP for i, (_, c) in enumerate(mine)) for lang, ranks in profiles.items()}
    return min(away, key=lambda x: (away[x], x))


def test_language_agrees_with_the_slow_predictor(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    profiles = langid.fit(docs)
    predict = langid.predictor(profiles)
    texts = [r["text"] for r in docs.select("text").collect()] + [r[1] for r in awkward()] + ["½ ² ③", "Ⅷ 12 _", "½ and ³ Maße", "x"]
    assert [predict(t)[0] for t in texts] == [slow_language(profiles, t) for t in texts]
    assert predict("½ ² ③") == ("und", 0.0) == predict("Ⅷ 12 _")
    # the codes and counts of a profile, from the sampled texts themselves
    few = docs.where("lang = 'fr'")
    n = Counter()
    for r in few.collect():
        x, m = langid.grams(r["text"])
        n.update(dict(zip(x.tolist(), m.tolist())))
    assert langid.fit(few)["fr"] == [c for _, c in sorted((-v, c) for c, v in n.items())[: langid.TOP]]


def test_language(spark):
    got = queries.op5_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["lang"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    docs = table(spark, awkward())
    profiles = langid.fit(docs)
    rows = langid.identify(docs, profiles).collect()
    assert len(rows) == docs.count() and {r["lang_pred"] for r in rows if not any(map(str.isalpha, r["text"] or ""))} == {"und"}
    assert langid.identify(docs, {}).select("lang_pred").distinct().collect()[0][0] == "und"
    assert langid.fit(table(spark, [])) == {}


def slow_features(text):
    t = text or ""
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_features(spark):
    rows = awkward()
    rows += [(500, "a b c d e a b c d e a b c x y", None, None, None, None, None), (501, "a b c d e", None, None, None, None, None), (502, "a a a a a a", None, None, None, None, None), (503, "# |x|\n# |x|\n\n\nq", None, None, None, None, None)]
    got = quality.with_features(table(spark, rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert plain(got) == plain([(r[0], *slow_features(r[1])) for r in rows])


def test_critical_counts(spark):
    for n, rate, level in ((1, 0.5, 0.6), (10, 0.3, 0.05), (500, 0.02, 0.01), (3000, 0.004, 0.002), (20, 0.01, 0.05)):
        cdf, k, best = 0.0, 0, -1
        while k <= n * rate:
            cdf += math.comb(n, k) * rate**k * (1 - rate) ** (n - k)
            best, k = (k if cdf <= level else best), k + 1
        assert spark.range(1).select(quality.critical_count(F.lit(n).cast("long"), rate, F.lit(level))).first()[0] == best


def test_quality_cutoffs(spark):
    import random

    r = random.Random(5)
    good = [(i, "some plain words of text here which " + " ".join(str(r.random()) for _ in range(10)), r.choice(["en", "de"])) for i in range(600)]
    bad = [(1000 + i, " ||| ".join(str(r.random()) for _ in range(30)), r.choice(["en", "de"])) for i in range(80)]
    rare = [(2000, "| " * 40, "fr"), (2001, None, None)]
    docs = spark.createDataFrame(good + bad + rare, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i, *_ in good] + [(i, 0, 0) for i, *_ in bad] + [(1000, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in quality.score(docs, labels, risk=0.1, delta=0.1).collect()}
    assert all(got[i]["kept"] for i, *_ in good)
    assert not any(got[i]["kept"] for i, *_ in bad)
    assert not got[2001]["kept"] and got[2000]["base_failed"]
    assert all(x["kept"] == (not x["base_failed"]) for x in quality.score(docs, labels.where("false")).collect())
    kept = quality.keep_good(docs, labels, risk=0.1, delta=0.1)
    assert kept.columns == docs.columns and sorted(x["doc_id"] for x in kept.collect()) == sorted(i for i, x in got.items() if x["kept"])
    assert quality.score(docs.where("false"), labels).count() == 0


def test_quality_equals_its_sql_where_the_method_acts(spark, tmp_path):
    import random

    import duckdb

    from parcelflow.llm import oracles

    r = random.Random(6)
    plainly = lambda i: f"Some words {i} of text number {r.random()} that say little more and end here in the row {r.random()}"
    rows = [(i, plainly(i) + (" # | #" * r.choice([0, 0, 1]) if i % 300 == 0 else ""), r.choice(["en", "de", None])) for i in range(1200)]
    rows += [(2000 + i, plainly(i) + "".join(f" |#|{r.random()}!" for _ in range(r.randint(1, 12))), r.choice(["en", "de", None])) for i in range(150)] + [(3000, None, None), (3001, "", "xx")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < 2000), 0) for i, *_ in rows if i % 4]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op10_quality(spark, str(tmp_path))
    for name in ("documents", "labels"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = duckdb.sql(oracles.oracle_sql()["op10_quality"])
    assert plain(got.select(*want.columns).collect()) == plain(want.fetchall())
    assert sum(not x["kept"] and not x["base_failed"] for x in got.collect()) > 50


def test_quality_false_rejections_stay_within_the_risk(spark):
    """Strata drawn 150 times from a known law: the admitted cutoff may reject over `risk` of good documents in a share of delta of them."""
    import numpy as np

    r, risk, delta, rows = np.random.default_rng(11), 0.05, 0.1, []
    for k in range(150):
        # in good documents the score falls off so that each cutoff of the grid has its own true rate of false rejections
        for good, n, mean in ((True, 300, 30), (False, 60, 900)):
            rows += [(str(k), good, 100, 1000, int(v), 0, 0, 1, 0, 0) for v in r.exponential(mean * 0.2, n)]
    labelled = spark.createDataFrame(rows, "stratum string, good boolean, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long, n_marks long")
    got = quality.thresholds(labelled, risk, delta * 150).collect()  # each stratum at level delta
    true = lambda cutoff: math.exp(-((cutoff // 5 + 1)) / 6)  # noqa: E731  symbols are 20 permille for 100
    assert len(got) >= 100 and sum(true(x["cutoff"]) > risk for x in got) <= delta * 150 + 3 * math.sqrt(delta * 150)


def test_growing_tables_are_not_broadcast(spark, monkeypatch):
    """The statistics see neither compression nor an explode, so no growing side of a join may be left to them."""
    plans = []

    def noted(df, *args, made=simhash.durable):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return made(df, *args)

    for module in (components, line_dedup, simhash):
        monkeypatch.setattr(module, "durable", noted)
    docs = table(spark, awkward())
    out = [simhash.near_duplicates(docs.select("doc_id", "text"), least=0.8), simhash.links(docs.select(F.xxhash64("text").alias("fp")).distinct()), line_dedup.dropped_lines(docs)]
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in out]
    assert sum("Join" in p for p in plans) > 10
    # line dedup sends the hashes of lines of which it has counted few
    found = [p for p in plans if "BroadcastExchange" in p]
    assert len(found) <= 1, found[0]
