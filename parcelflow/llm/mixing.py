"""Mixing sources to target weights.

The words of each source, its documents in a pseudorandom order, form blocks of BLOCK words (the last may be shorter). A mix
is a sequence of slots in output shards of equal size. How many slots of each source a shard gets is a multinomial draw over
what is left of each source's quota, so that every draw has the target weights and the quotas come out exactly. The slots of
a source are numbered through all shards; a number is mapped to a block by the source's own pseudorandom permutation of block
indexes (a Feistel network, walked until it falls in range), going round again after all blocks. Blocks meet the documents'
pieces by (source, block), a key with at most two slots and the few pieces of a block, so there is no hot key.

The last slot of a source takes as many words of its block as its target still lacks.

Rows equal in id and text are one entry with a count until their places are known, so copies of one row are no hot group. There
may be MAX_SOURCES sources, the mix's configuration; more raise an error.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.llm.common import durable, n_words, row_of, short_table, unpacked, whole, with_running_total, words

BLOCK, SEED, WEIGHTS, SHARE, MOST = 1024, 7, (3, 1, 2), 1.5, 2
#: Slots of an output shard at least; there are never more than MAX_SHARDS, so the draws stay a small table.
SHARD_SLOTS, MAX_SHARDS = 4096, 4096
#: Documents of a chunk in which offsets are added up.
CHUNK = 2048
#: So many sources at most: a short row for each goes to the driver, and to the tasks.
MAX_SOURCES = 10_000


@dataclass
class Source:
    """A source's plan: slots of BLOCK words each, of which the last takes only `rest`."""

    number: int
    size: int
    target: float
    slots: int
    rest: int


def targets(sizes: list[int], weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> list[float]:
    """Split share * sum(sizes) by the weights, repeating; a target stops at most * size and the excess is shared again."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out, free, left = [0.0] * len(sizes), {i for i, n in enumerate(sizes) if n > 0}, share * sum(sizes)
    while free:
        total = sum(w[i] for i in free)
        over = {i for i in free if left * w[i] / total > most * sizes[i]}
        if not over:
            for i in free:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        free -= over
        left -= sum(out[i] for i in over)
    return out


def _mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index, n, key, inverse: bool = False):
    """Arrays: the place of index in a pseudorandom permutation of range(n), which key chooses; or the way back."""
    import numpy as np

    index, n, key = (np.array(x, np.uint64) for x in np.broadcast_arrays(index, n, key))
    half = np.zeros(index.shape, np.uint64)  # bits of a half: 4 ** half >= n
    while ((np.uint64(1) << (half * np.uint64(2))) < n).any():
        half += ((np.uint64(1) << (half * np.uint64(2))) < n).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    todo, out = np.arange(index.size), index.copy()
    while len(todo):
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        a, b = x >> h, x & m
        for r in range(6):
            r = np.uint64(5 - r if inverse else r)
            if inverse:
                a, b = b ^ (_mix(a + k * np.uint64(0x9E3779B97F4A7C15) + r) & m), a
            else:
                a, b = b, a ^ (_mix(b + k * np.uint64(0x9E3779B97F4A7C15) + r) & m)
        out[todo] = (a << h) | b
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def plan(sizes: list[int], block: int = BLOCK, seed: int = SEED, **how) -> list[Source]:
    out = []
    for k, (size, target) in enumerate(zip(sizes, targets(sizes, **how))):
        blocks, want = -(-size // block), min(round(target), MOST * size)
        turns, rest = divmod(want, size) if size else (0, 0)
        slots = turns * blocks
        if rest:
            short = blocks * block - size  # words the last block lacks
            last = int(permuted([blocks - 1], blocks, seed * 1_000_003 + k, inverse=True)[0])
            more = -(-rest // block)
            more = -(-(rest + short) // block) if last < more else more
            rest -= (more - 1) * block - short * (last < more - 1)
            slots += more
        out.append(Source(k, size, target, slots, rest or block))
    return out


def draws(sources: list[Source], seed: int = SEED) -> list[tuple[int, int, int, int]]:
    """(shard, source, first slot, slots): each shard's multinomial draw over the slots that are left."""
    import numpy as np

    left = np.array([s.slots for s in sources], np.int64)
    at, total = np.zeros_like(left), int(left.sum())
    size = max(SHARD_SLOTS, -(-total // MAX_SHARDS))
    rng, out = np.random.default_rng(seed), []
    for shard in range(-(-total // size)):
        need = min(size, int(left.sum()))
        got = np.zeros_like(left)
        while (short := need - int(got.sum())) > 0:
            rest = left - got
            got += np.minimum(rest, rng.multinomial(short, rest / rest.sum()))
        out += [(shard, k, int(at[k]), int(got[k])) for k in np.nonzero(got)[0].tolist()]
        at, left = at + got, left - got
    return out


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, list[Source]]:
    """Written rows (id, th, source, size, number), and the sources' plans in order: by code point, null last."""
    rows = durable(docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(source_col).alias("source"), n_words(text_col).alias("size")), "sized")
    found = rows.groupBy("source").agg(F.sum("size")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sources = plan([int(r[1]) for r in found])
    names = short_table(rows.sparkSession, [(r[0], k) for k, r in enumerate(found)], "name string, number int")
    return rows.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("name"))).drop("name"), sources


def slots(spark, sources: list[Source], block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(shard, number, slot, block, part): every slot of the mix. part: how many words of the block are taken, `block` for all."""

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            number, slot, blocks = (batch.column(c).to_numpy() for c in ("number", "slot", "blocks"))
            at = permuted(slot % blocks, blocks, seed * 1_000_003 + number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int64())], [*batch.schema.names, "block"])

    rows = short_table(spark, draws(sources, seed), "shard int, number int, first long, n long")
    blocks = F.element_at(F.array(*[F.lit(max(1, -(-s.size // block))).cast("long") for s in sources] or [F.lit(1).cast("long")]), F.col("number") + 1)
    last = F.element_at(F.array(*[F.lit(s.slots - 1).cast("long") for s in sources] or [F.lit(0)]), F.col("number") + 1)
    rest = F.element_at(F.array(*[F.lit(s.rest) for s in sources] or [F.lit(0)]), F.col("number") + 1)
    each = rows.repartition("shard", "number").select("shard", "number", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot"))
    # not a UDF: a join on block would put its "is not null" below, which calls a UDF twice, in two Python workers for each task
    each = each.withColumn("blocks", blocks).mapInArrow(place, "shard int, number int, slot long, blocks long, block long")
    return each.select("shard", "number", "slot", "block", F.when(F.col("slot") == last, rest).otherwise(block).cast("int").alias("part"))


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows with (block, low, high, skip): a row for each block a document has words in, at [low, high) there, after `skip` of its
    own words. A document without words has one row with nulls."""
    rows = rows.groupBy("id", "th", "source", "size", "number").agg(F.count("*").alias("copies")).withColumn("all", F.col("size") * F.col("copies"))
    rows = durable(rows, "entries")
    n = max(1, rows.count())
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "th"), F.lit(-(-n // CHUNK)))).withColumn("order", F.xxhash64(F.lit(3), "id", "th"))
    rows = with_running_total(rows, ["number"], "chunk", ["order", "id", "th"], "all", "first")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    rows = rows.withColumn("start", F.col("first") + F.col("copy") * F.col("size")).drop("chunk", "order", "first", "copies", "copy", "all")
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    rows = rows.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    low, high = F.greatest(F.col("start"), F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return rows.withColumn("low", low - F.col("block") * block).withColumn("high", high - F.col("block") * block).withColumn("skip", low - F.col("start"))


def _taken(rows: DataFrame, sources: list[Source]) -> DataFrame:
    """The pieces with (whole, part): how often all of the block is taken, and the words of it that the last slot takes."""
    each = slots(rows.sparkSession, sources).groupBy("number", "block").agg(F.count_if(F.col("part") == BLOCK).alias("whole"), F.max(F.when(F.col("part") < BLOCK, F.col("part"))).alias("part"))
    # the plan's statistics see the short table of draws, not the slots it grows to: no broadcast
    return pieces(rows).join(each.hint("merge"), ["number", "block"], "left").withColumn("whole", F.coalesce("whole", F.lit(0)))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, taken): a row for each row of docs.

    A null text has size 0, and nothing of it is taken. Null is a source of its own, the last. Repeated rows are rows of their
    own. The same table gives the same rows, however it is partitioned. An empty one gives an empty one.
    """
    rows, sources = sized(docs, id_col, text_col, source_col)
    if not sources:
        return rows.select(F.col("id").alias(id_col), "size", F.col("size").alias("source_size"), F.lit(0.0).alias("target"), F.col("size").alias("taken"))
    part = F.greatest(F.lit(0), F.least("high", "part") - F.col("low"))
    taken = F.col("whole") * (F.col("high") - F.col("low")) + F.coalesce(F.when(F.col("part").isNotNull(), part), F.lit(0))
    some = _taken(rows, sources)
    found = some.where("size > 0").groupBy("id", "size", "number", "start").agg(F.sum(taken).cast("long").alias("taken"))
    found = found.select("id", "size", "number", "taken").unionByName(some.where("size = 0").select("id", "size", "number", F.lit(0).cast("long").alias("taken")))
    of = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("number") + 1)
    return found.select(F.col("id").alias(id_col), "size", of([s.size for s in sources], "long").alias("source_size"), of([s.target for s in sources], "double").alias("target"), "taken")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", n_chars_col: str | None = None) -> DataFrame:
    """The mix as documents: a row for each time a document is taken, whole or in part, with the columns of docs.

    A document taken whole keeps its text; of one that block borders cut, the words taken are joined by spaces.
    """
    rows, sources = sized(docs, id_col, text_col, source_col)
    if not sources:
        return docs
    span = lambda high: F.struct(F.col("skip").alias("a"), (F.col("skip") + high - F.col("low")).alias("b"))
    full = F.transform(F.when(F.col("whole") > 0, F.sequence(F.lit(1), F.col("whole").cast("int"))).otherwise(F.array().cast("array<int>")), lambda c: F.struct(c.alias("copy"), span(F.col("high")).alias("span")))
    part = F.when(F.col("part") > F.col("low"), F.array(F.struct((F.col("whole") + 1).cast("int").alias("copy"), span(F.least("high", "part")).alias("span"))))
    some = _taken(rows, sources).where("size > 0")
    some = some.select("id", "th", "number", "start", "size", F.explode(F.concat(full, F.coalesce(part, F.array().cast(full_type())))).alias("t"))
    copies = some.groupBy("id", "th", "number", "start", "size", "t.copy").agg(F.array_sort(F.collect_list("t.span")).alias("spans"))
    texts = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("own_id"), F.xxhash64(text_col).alias("own")).dropDuplicates(["own_id", "own"])
    out = texts.join(copies, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("th")))
    got = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["b"] - s["a"])
    # the words are bound to a name of the lambda, so they are split once
    slices = lambda w: F.flatten(F.transform("spans", lambda s: F.slice(w, (s["a"] + 1).cast("int"), (s["b"] - s["a"]).cast("int"))))
    cut = F.transform(F.array(words(row_of(text_col))), lambda w: F.array_join(slices(w), " "))[0]
    out = out.withColumn("text", F.when(got < F.col("size"), cut).otherwise(row_of(text_col)))
    new = {text_col: F.col("text")} | ({n_chars_col: F.length(whole("text")).cast(docs.schema[n_chars_col].dataType)} if n_chars_col else {})
    return out.select(*unpacked(docs, new))


def full_type() -> str:
    return "array<struct<copy:int,span:struct<a:bigint,b:bigint>>>"
