"""Near-duplicate documents by SimHash and multi-index hashing.

A fingerprint has 64 bits, split in two segments of 32. Two fingerprints that differ in at most 3 bits differ in at most one
bit within one of the segments. Every distinct fingerprint is filed once under each segment and probes, for each segment,
the Hamming ball of radius 1 round its own value; equal keys meet in a hash join and the complete distance is verified. A
ball is enumerated upwards only (bits that are 0 become 1): of two values that differ in one bit, one reaches the other.

A segment value with more than HOT distinct fingerprints is not joined as it is: of its members' other halves, which may
differ in 3 bits at most, one of four bytes must agree, so the key is refined by each byte in turn; a refined key that is still
crowded is refined by a quarter of the bits that are left, and so once more. No link is lost, and a key of the last kind tells
at least 46 bits.

64 bits tell little of a similarity of 0.8 (about 10 bits differ), so texts alike by their shingles are found another way, on
request: by MinHash, BANDS keys of ROWS values. Two shingle sets of Jaccard similarity 0.8 share no key with a chance of 5e-8.
Of the sets under one key, each is held against one leader; then pairs of different components are. Every link is verified on the
whole sets. Before that, pairs are told apart by length, by one bit of each MinHash value (a pair of similarity 0.8 fails that with a
chance of about 9e-07), and by two bounds on what they can have in common: shingles that a set has to itself are shared
with no other, and of the leader's shingles both have only those that neither lacks (which ones a set lacks is told when
it is held against its leader, in 256 bits). The leader is the set with the least share of shingles to itself, so copies changed in
few places are linked to it, and the bounds part those changed in many. Pairs that pass all this are verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parcelflow.llm.common import durable, shuffled, unpacked, whole
from parcelflow.llm.components import connected_components

HOT = 1000
#: Shingles hashed at a time, so that a text of any length takes bounded memory.
CHUNK = 1 << 16
#: Texts of a batch worked on at a time.
SLICE = 128
BANDS, ROWS = 32, 4
#: Of BANDS * ROWS bits, so many agree at least for a pair to be verified: 115 are expected at similarity 0.8, give or take 3.4.
AGREE = 97


def _hashes(text: str | None, width: int):
    """Arrays of at most CHUNK hashes, one for each shingle of `width` words (A-Z lower-cased; of all words where there are fewer)."""
    from itertools import islice

    import numpy as np
    from xxhash import xxh64_intdigest

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not found:
        return
    line, ends = b" ".join(found), np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - width + 1)
    pairs = zip(starts[:n].tolist(), ends[min(width, len(found)) - 1 :].tolist())
    for _ in range(0, n, CHUNK):
        yield np.array([xxh64_intdigest(line[a:b], 42) for a, b in islice(pairs, CHUNK)], np.uint64)


def fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned fingerprint of a text: a bit is set if set in over half of the hashes of its shingles."""
    import numpy as np

    n, counts = 0, np.zeros(64, np.int64)
    for h in _hashes(text, width):
        n += len(h)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def shingles(text: str | None, width: int):
    """The distinct hashes of a text's shingles, in order; none for a text without words."""
    import numpy as np

    found = list(_hashes(text, width))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def sketch(h) -> tuple[int, int, list[int], list[int]]:
    """Of distinct hashes in order: a hash of them all, their number, BANDS keys, and one bit of each MinHash value in longs."""
    import numpy as np
    from xxhash import xxh64_intdigest

    factors = np.random.default_rng(5).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for a in range(0, len(h), 1024):
        least = np.minimum(least, (factors[:, None] * h[None, a : a + 1024]).min(1))
    signed = lambda x: (x ^ (1 << 63)) - (1 << 63)
    keys = [signed(xxh64_intdigest(x.tobytes(), b)) for b, x in enumerate(least.reshape(BANDS, ROWS))]
    bit = [xxh64_intdigest(x.tobytes(), 7) & 1 for x in least]
    return signed(xxh64_intdigest(h.tobytes(), 1)), len(h), keys, np.packbits(bit).view("<i8").tolist()


def _each(rows: DataFrame, added: str, of) -> DataFrame:
    """rows(..., text) with the columns `added` in the place of text: of(texts) gives their Arrow arrays.

    SLICE texts are worked on at a time, so a worker never holds the values of a whole batch.
    """
    schema = StructType([*rows.drop("text").schema.fields, *StructType.fromDDL(added).fields])

    def replaced(batches):
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                some = batch.slice(a, SLICE)
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], *of(some.columns[-1].to_pylist())], schema.names)

    return rows.mapInArrow(replaced, schema)


def _sketches(rows: DataFrame, width: int) -> DataFrame:
    """rows(..., text) -> (..., sh, n, keys, bits)."""

    def of(texts):
        import pyarrow as pa

        found = [sketch(shingles(t, width)) for t in texts]
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return [pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)]

    return _each(rows, "sh long, n long, keys array<long>, bits array<long>", of)


def _shingles(rows: DataFrame, width: int) -> DataFrame:
    """rows(..., text) -> (..., set)."""

    def of(texts):
        import numpy as np
        import pyarrow as pa

        found = [shingles(t, width).view(np.int64) for t in texts]
        ends = np.cumsum([0, *map(len, found)])
        return [pa.LargeListArray.from_arrays(ends, np.concatenate(found)).cast(pa.list_(pa.int64()))]

    return _each(rows, "set array<long>", of)


def similar(docs: DataFrame, text_col: str, width: int, least: float) -> DataFrame:
    """(th, other): hashes of texts, linked so that the components are those of texts whose shingle sets are equal or have a Jaccard similarity of `least` or more."""
    if least < 0.8:
        raise ValueError("the keys and bits are laid out for similarities of 0.8 and more")
    texts = docs.select(F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    marks = durable(_sketches(texts.select("th", whole("text").alias("text")), width), "sketches").where("n > 0")
    most = BANDS * marks.count()
    sets = marks.groupBy("sh").agg(F.min("th").alias("node"))
    equal = marks.select("th", "sh").join(shuffled(sets), "sh").where("th <> node").select("th", F.col("node").alias("other"))
    filed = marks.select("sh", "n", F.col("bits")[0].alias("b0"), F.col("bits")[1].alias("b1"), F.explode("keys").alias("key")).distinct()
    shared = filed.groupBy("key").agg(F.min("sh").alias("a"), F.max("sh").alias("b")).where("a <> b").select("key")
    filed = durable(filed.join(shuffled(shared), "key"), "filed", most)
    wanted = filed.select("sh").distinct().join(shuffled(sets), "sh").select("sh", F.col("node").alias("th"))
    held = durable(_shingles(texts.join(shuffled(wanted), "th").dropDuplicates(["sh"]).select("sh", "text"), width), "sets")
    single = held.select("sh", F.explode("set").alias("x")).groupBy("x").agg(F.min("sh").alias("sh"), F.count("*").alias("n")).where("n = 1")
    single = single.groupBy("sh").agg(F.count("*").alias("u"))
    # u: shingles that no other set has
    filed = durable(filed.join(shuffled(single), "sh", "left").select("key", "sh", "n", "b0", "b1", F.coalesce("u", F.lit(0)).alias("u")), "counted", most)

    def alike(pairs: DataFrame) -> DataFrame:
        """Of the pairs (x, y) of filed rows, those that may be similar."""
        agree = BANDS * ROWS - F.bit_count(F.col("x.b0").bitwiseXOR(F.col("y.b0"))) - F.bit_count(F.col("x.b1").bitwiseXOR(F.col("y.b1")))
        may = (agree >= AGREE) & (F.least("x.n", "y.n") >= F.lit(least) * F.greatest("x.n", "y.n"))
        common = F.least(F.col("x.n") - F.col("x.u"), F.col("y.n") - F.col("y.u"))  # no more than this
        return pairs.where(may & enough(common, F.col("x.n"), F.col("y.n")))

    def enough(common: Column, m: Column, n: Column) -> Column:
        return common * (1 + least) >= F.lit(least) * (m + n) - 1e-6

    row = F.struct("sh", "n", "b0", "b1", "u")
    led = durable(filed.groupBy("key").agg(F.min_by(row, F.struct(F.col("u") / F.col("n"), F.xxhash64("sh", "key"))).alias("x")), "leaders", most)
    pairs = alike(filed.select("key", row.alias("y")).join(shuffled(led), "key")).select(F.col("x.sh").alias("lead"), F.col("y.sh").alias("sh")).where("lead <> sh").distinct()
    pairs = pairs.join(shuffled(held.toDF("lead", "ls")), "lead").join(shuffled(held), "sh")
    lacks = F.array_except("ls", "set")
    word = lambda k: F.aggregate(F.filter("lacks", lambda x: F.shiftrightunsigned(x, 6).bitwiseAND(F.lit(3)) == k), F.lit(0).cast("long"), lambda w, x: w.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))))
    # against its leader: shingles in common, how many of the leader's are lacking, and which, in 256 bits by hash
    told = pairs.select("lead", "sh", F.size("ls").alias("nl"), F.size("set").alias("n"), lacks.alias("lacks")).withColumn("m", F.size("lacks"))
    told = durable(told.select("lead", "sh", "nl", "n", "m", *[word(k).alias(f"w{k}") for k in range(4)]), "led")
    first = told.where(enough(F.col("nl") - F.col("m"), F.col("nl"), F.col("n"))).select(F.least("lead", "sh").alias("u"), F.greatest("lead", "sh").alias("v"))
    groups = connected_components(first)
    placed = filed.join(shuffled(groups.withColumnRenamed("node", "sh")), "sh", "left").withColumn("c", F.coalesce("component", "sh"))
    apart = placed.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("key")
    placed = placed.join(shuffled(apart), "key").join(shuffled(led.select("key", F.col("x.sh").alias("lead"), F.col("x.n").alias("nl"))), "key")
    placed = placed.join(shuffled(told.drop("nl", "n")), ["lead", "sh"], "left")
    own = F.col("sh") == F.col("lead")
    more = [F.when(own, 0).otherwise(F.col(c)).alias(c) for c in ("m", "w0", "w1", "w2", "w3")]
    placed = durable(placed.select("key", "c", F.struct("sh", "n", "b0", "b1", "u", "nl", *more).alias("x")), "placed", most)
    other = placed.select("key", F.col("x").alias("y"), F.col("c").alias("d"))
    both = sum((F.bit_count(F.col(f"x.w{k}").bitwiseAND(F.col(f"y.w{k}"))) for k in range(4)), F.lit(0))
    doubled = lambda r: F.col(f"{r}.m") - sum((F.bit_count(f"{r}.w{k}") for k in range(4)), F.lit(0))
    # what both lack of their leader is at most the bits they share, and what one of them has on a bit twice
    lacked = F.least(both + F.least(doubled("x"), doubled("y")), F.col("x.m"), F.col("y.m"))
    extra = lambda r: F.col(f"{r}.n") - (F.col(f"{r}.nl") - F.col(f"{r}.m")) - F.col(f"{r}.u")
    common = F.col("x.nl") - F.col("x.m") - F.col("y.m") + lacked + F.least(extra("x"), extra("y"))
    near = alike(placed.join(shuffled(other), "key").where("c < d")).where(F.coalesce(enough(common, F.col("x.n"), F.col("y.n")), F.lit(True)))
    near = durable(near.select(F.least("x.sh", "y.sh").alias("u"), F.greatest("x.sh", "y.sh").alias("v")).distinct(), "candidates")
    near = near.join(shuffled(held.toDF("u", "us")), "u").join(shuffled(held.toDF("v", "vs")), "v")
    common = F.size(F.array_intersect("us", "vs"))
    second = near.where(enough(common, F.size("us"), F.size("vs"))).select("u", "v")
    name = lambda c: shuffled(sets.select(F.col("sh").alias(c), F.col("node").alias(f"{c}_node")))
    near = first.union(second).join(name("u"), "u").join(name("v"), "v").select(F.col("u_node").alias("th"), F.col("v_node").alias("other"))
    return durable(equal.union(near), "similar")


def _fingerprints(rows: DataFrame) -> DataFrame:
    """rows(..., text) -> (..., fp)."""

    def of(texts):
        import pyarrow as pa

        return [pa.array([((x := fingerprint(t)) ^ (1 << 63)) - (1 << 63) for t in texts], pa.int64())]

    return _each(rows, "fp long", of)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): one row for each row of docs, fp as a signed long. Null and empty texts have fingerprint 0."""
    return _fingerprints(docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))).toDF(id_col, "fp")


def quarters(mask: int) -> list[int]:
    """The bits of a mask in four parts."""
    bits = [b for b in range(32) if mask >> b & 1]
    return [sum(1 << b for b in bits[len(bits) * k // 4 : len(bits) * (k + 1) // 4]) for k in range(4)]


def links(distinct: DataFrame, max_bits: int = 3, hot: int = HOT) -> DataFrame:
    """distinct(fp) without repeats -> (u, v), pairs of fingerprints that differ in 1 to max_bits (at most 3) bits."""
    if not 0 < max_bits <= 3:
        raise ValueError("two segments searched with radius 1 find distances up to 3")
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    second = F.lit(1 << 32)  # keys of the upper segment are apart from the lower one's
    halves = F.array(F.struct(low.alias("key"), high.alias("rest")), F.struct((high + second).alias("key"), low.alias("rest")))
    filed = distinct.select("fp", F.explode(halves).alias("h")).select("fp", "h.key", "h.rest")
    ones = F.array(*[F.lit(1 << j) for j in range(32)])
    ball = F.transform(F.filter(ones, lambda b: F.col("key").bitwiseAND(b) == 0), lambda b: F.col("key") + b)
    probes = filed.select("fp", "rest", F.explode(F.concat(F.array("key"), ball)).alias("key"))
    filed, probes = (x.withColumn("path", F.lit(0)).withColumn("tag", F.lit(0).cast("long")) for x in (filed, probes))
    on = ["key", "path", "tag"]
    masks = [0xFFFFFFFF]  # of the bits of rest that a path has not looked at; the parts of path p are 4 * p + 1 and the next three
    for level in range(3):
        crowded = filed.groupBy(*on).count().where(F.col("count") > hot).select(*on)
        crowded = durable(crowded, "crowded") if level or not crowded.isEmpty() else crowded
        if crowded.isEmpty():
            break
        parts = [part for mask in masks for part in quarters(mask)]  # of all paths so far, in order
        masks = [0xFFFFFFFF] + [masks[k // 4] & ~part for k, part in enumerate(parts)]
        part = lambda i: F.element_at(F.array(*map(F.lit, parts)), (F.col("path") * 4 + i + 1).cast("int"))  # noqa: B023, E731
        finer = F.transform(F.array(*map(F.lit, range(4))), lambda i: F.struct((F.col("path") * 4 + 1 + i).alias("path"), F.xxhash64("tag", i, F.col("rest").bitwiseAND(part(i))).alias("tag")))
        same = F.array(F.struct(F.col("path"), F.col("tag")))
        crowded = crowded.withColumn("crowd", F.lit(True))
        filed, probes = (x.join(shuffled(crowded), on, "left").withColumn("p", F.explode(F.when(F.col("crowd"), finer).otherwise(same))).select("fp", "key", "rest", "p.path", "p.tag") for x in (filed, probes))
    pairs = filed.select(F.col("fp").alias("u"), *on).join(shuffled(probes.select(F.col("fp").alias("v"), *on)), on)
    return pairs.where((F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits)).select("u", "v")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 3, least: float | None = None, width: int = 5) -> DataFrame:
    """(id, fp, class_fp, component_id): one row for each row of docs.

    With `least`, texts whose sets of shingles of `width` words have at least that Jaccard similarity are linked as well.

    component_id is the smallest id reachable over links of at most max_bits bits, equal fingerprints included; ids that are
    null are never chosen unless a component has no other. Repeated rows come out as often as they went in. An empty table
    gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints = durable(fingerprints(rows, "id", "text"), "fingerprints")
    n = prints.count()
    reps = durable(prints.groupBy("fp").agg(F.min("id").alias("rep")), "classes", n)
    found = links(reps.select("fp"), max_bits)
    if least is not None:
        alike = similar(rows, "text", width, least)
        ends = alike.select(F.explode(F.array("th", "other")).alias("th")).distinct()
        of_text = rows.select(F.xxhash64("text").alias("th"), "text").join(shuffled(ends), "th").dropDuplicates(["th"])
        of_text = durable(_fingerprints(of_text.select("th", whole("text").alias("text"))), "ends")
        found = found.union(alike.join(shuffled(of_text.toDF("th", "u")), "th").join(shuffled(of_text.toDF("other", "v")), "other").select("u", "v"))
    groups = connected_components(found)
    joined = reps.join(shuffled(groups.withColumnRenamed("node", "fp")), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("class_fp"))
    joined = durable(joined, "labelled", n)
    smallest = joined.groupBy("class_fp").agg(F.min("rep").alias("component_id"))
    return prints.join(shuffled(joined.join(shuffled(smallest), "class_fp").select("fp", "class_fp", "component_id")), "fp").select(F.col("id").alias(id_col), "fp", "class_fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float | None = None) -> DataFrame:
    """docs with one row of each near-duplicate group: the smallest id, null last, then the smallest hash of the text.

    Rows equal in id and text count as one row.
    """
    h = F.xxhash64(text_col)
    key = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), h.alias("h"))
    groups = near_duplicates(docs.select(key.alias("key"), F.col(text_col).alias("text")), "key", "text", least=least)
    keep = groups.select(F.col("component_id").alias("k")).distinct().select(F.col("k.id").alias("id"), F.col("k.h").alias("h"))
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("own_id"), h.alias("own"))
    kept = rows.join(shuffled(keep), F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("h")), "left_semi")
    return kept.dropDuplicates(["own_id", "own"]).select(*unpacked(docs, {}))
