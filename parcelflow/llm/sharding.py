"""Sharding by extendible hashing, in DataFrame operations.

A document's path is 128 bits: 64 of the MD5 of its id, then 64 of the MD5 of its text. A shard is a prefix of paths. Where a
prefix holds more than the byte limit it is split on the next bit, and only there; so every shard is the shortest prefix that
fits. Sizes of all prefixes come from one sum at a depth somewhat below what is needed on average, rolled up to the shorter
ones; the few that are still too large are taken deeper in another round. A single document larger than the limit is a shard
of its own. Rows equal in id and text have one path; if they exceed the limit together, they are dealt into pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.llm.common import durable, unpacked, whole, with_running_total

LIMIT = 1 << 20
BITS, STEP = 128, 24


def _path(id_col: str, text_col: str):
    bits = lambda c: F.lpad(F.conv(F.substring(F.md5(c.cast("binary")), 1, 16), 16, 2), 64, "0")
    return F.concat(bits(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), bits(whole(text_col)))


def _placed(rows: DataFrame, limit: int) -> DataFrame:
    """rows(path, row, n_bytes, and any others) with shard, depth and page."""
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    low, deep = 0, min(BITS, (total // limit).bit_length() + 6)
    done, todo = None, rows
    while True:
        leaves = todo.groupBy(F.substring("path", 1, deep).alias("leaf")).agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        leaves = durable(leaves, "leaves")
        levels = leaves.select("leaf", "b", "n", F.explode(F.sequence(F.lit(low), F.lit(deep))).alias("depth"))
        prefixes = levels.groupBy("depth", F.expr("substring(leaf, 1, depth)").alias("prefix")).agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
        fits = durable(prefixes.where((F.col("b") <= limit) | (F.col("n") == 1)).select("depth", "prefix"), "fits")
        # at shorter prefixes than any that fits, many leaves share a key and none finds a match
        least = fits.agg(F.min("depth")).first()[0]
        least = deep + 1 if least is None else least
        could = F.explode(F.when(F.lit(least <= deep), F.sequence(F.lit(least), F.lit(deep)))).alias("depth")
        best = leaves.select("leaf", could).withColumn("prefix", F.expr("substring(leaf, 1, depth)")).join(fits, ["depth", "prefix"])
        best = best.groupBy("leaf").agg(F.min("depth").alias("depth"))
        best = leaves.select("leaf").join(best, "leaf", "left")
        if deep < BITS:
            best = durable(best, "directory")
        marked = todo.withColumn("leaf", F.substring("path", 1, deep)).join(best.hint("merge"), "leaf").drop("leaf")
        fine = marked.where("depth is not null")
        done = fine if done is None else done.unionByName(fine)
        if deep == BITS:
            rest = marked.where("depth is null")
            break
        if best.where("depth is null").isEmpty():
            rest = None
            break
        low, deep, todo = deep + 1, min(BITS, deep + STEP), durable(marked.where("depth is null").drop("depth"), "crowded")
    out = done.withColumn("shard", F.expr("substring(path, 1, depth)")).withColumn("page", F.lit(0).cast("long"))
    if rest is not None:
        same = with_running_total(rest.withColumn("one", F.lit(1)).withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(4096))), ["path"], "chunk", ["row"], "one", "at")
        each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("n_bytes")))
        same = same.withColumn("shard", F.col("path")).withColumn("depth", F.lit(BITS)).withColumn("page", F.floor(F.col("at") / each))
        out = out.unionByName(same.select(*out.columns))
    return out


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, shard, depth, page): a row for each row of docs. Shards are (shard, page); shard is the prefix as 0s and 1s.

    n_bytes is the UTF-8 length of the text, 0 for null. An empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(whole(text_col)).cast("long").alias("n_bytes"), _path(id_col, text_col).alias("path"))
    rows = durable(rows.withColumn("row", F.monotonically_increasing_id()), "paths")
    return _placed(rows, limit).select(F.col("id").alias(id_col), "n_bytes", "shard", F.col("depth").cast("long").alias("depth"), "page")


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> None:
    """Write the rows of docs in their shards: a folder path/shard=p<prefix>/page=<page> with one Parquet file for each shard.

    The prefix is written after a letter, so that readers don't take it for a number. Columns of docs have any names but these two.
    """
    n_bytes = F.octet_length(whole(text_col)).cast("long").alias("n_bytes")
    rows = docs.select(F.struct("*").alias("doc"), n_bytes, _path(id_col, text_col).alias("path"))
    rows = durable(rows.withColumn("row", F.monotonically_increasing_id()), "paths")
    placed = _placed(rows, limit).withColumn("shard", F.concat(F.lit("p"), "shard"))
    placed = placed.select(*unpacked(docs, {}, "shard", "page"), "shard", "page")
    # as many tasks as a shard each would need, within reason: a task writes whole shards
    tasks = max(1, min(200_000, 2 * (rows.agg(F.sum("n_bytes")).first()[0] or 0) // (128 * limit)))
    placed.repartition(tasks, "shard", "page").sortWithinPartitions("shard", "page").write.mode("overwrite").partitionBy("shard", "page").parquet(path)
