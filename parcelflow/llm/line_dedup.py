"""Line deduplication by a deletion-neighbourhood join, in DataFrame operations only.

Lines are the \\n-split parts of a text. A line takes part if it has a word; others stay. Order: document id (null first), hash of
the text, line number. A line is dropped if an earlier line is equal to it, or if both have NEAR_CHARS code points or more and lie
within one edit (one code point inserted, deleted or replaced), whether or not that earlier line is itself kept. In shorter lines
one edit makes another word, so they go only where they are equal.

Equal lines are first reduced to one (two 64-bit hashes, map-side combined, so a line in a third of all documents costs a row
for each task). Of distinct lines, two within one edit, of lengths m and m or m + 1, share the first floor(m/2) or the last
ceil(m/2) code points. Lines whose half is shared are held against each other again with one of BLOCKS parts left out, a part
being counted from the start on its left and from the end on its right, so that an edit within it does not show. Lines that
still meet another emit all their one-deletion variants as hashed keys:

* (length, position, line without that position): holders of one key differ at that position only, so all are linked;
* (the line without a position) together with the lines that are that string: one such line, linked with all holders.

Either way the earliest holder decides, so no pairs within a group are made: groups are reduced by a minimum and joined back.
Links found are verified by edit distance on the lines themselves. Keys are hashed piece by piece, so that a line of n code
points costs n * (PIECE + n / PIECE), not n squared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.llm.common import discard, durable, row_of, shuffled, unpacked, whole

NEAR_CHARS = 20
PIECE = 64
BLOCKS = 16
#: So many hashes of lines with a shared half at most (16 bytes each) are broadcast; more are joined by shuffle.
SMALL = 100_000


def _lines(docs: DataFrame, id_col: str, text_col: str, least: int = 1) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.posexplode(F.split(whole(text_col), "\n")).alias("pos", "line"))
    rows = rows.where((F.length("line") >= least) & F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return rows.withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit(1), "line"))


def _halves(line: Column) -> Column:
    n, keys = F.length(line), []
    for less in (0, 1):
        m = n - less
        first = F.floor(m / 2).cast("int")
        keys += [F.xxhash64(F.lit(0), m, F.substring(line, F.lit(1), first)), F.xxhash64(F.lit(1), m, F.substring(line, first - m, m - first))]
    return F.array(*keys)


def _without_block(line: Column) -> Column:
    n, keys = F.length(line), []
    for less in (0, 1):
        m = n - less
        for j in range(BLOCKS):
            left, right = F.floor(m * j / BLOCKS).cast("int"), m - F.floor(m * (j + 1) / BLOCKS).cast("int")
            tail = F.when(right > 0, F.substring(line, -right, right)).otherwise("")
            keys.append(F.xxhash64(F.lit(j), m, F.substring(line, F.lit(1), left), tail))
    return F.array(*keys)


def _meeting(rows: DataFrame, keys: Column) -> DataFrame:
    """The rows' h1, with repeats, that share a key with a row of another h1."""
    held = rows.select("h1", F.explode(keys).alias("key"))
    shared = held.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("key")
    return held.join(shuffled(shared), "key").select("h1")


def _variants(line: Column) -> Column:
    """array<struct<key, kind>>: 0 a replaced position, 1 the line without a position, 2 the line itself. Keys of 1 and 2 meet."""
    n = F.length(line)
    pieces = lambda n: F.sequence(F.lit(0), F.floor((n - 1) / PIECE).cast("int"))

    def of_piece(p: Column) -> Column:
        at = p * PIECE
        before, piece, after = F.xxhash64(F.substring(line, F.lit(1), at)), F.substring(line, at + 1, F.lit(PIECE)), F.xxhash64(F.substring(line, at + PIECE + 1, n))
        parts = F.array(F.struct(before.alias("b"), piece.alias("p"), after.alias("a")))  # held once for all positions of the piece

        def of_part(x: Column) -> Column:
            def at_position(i: Column) -> Column:
                rest = F.concat(F.substring(x["p"], F.lit(1), i), F.substring(x["p"], i + 2, F.lit(PIECE)))
                return F.array(
                    F.struct(F.xxhash64(F.lit("r"), n, at + i, x["b"], rest, x["a"]).alias("key"), F.lit(0).alias("kind")),
                    F.struct(F.xxhash64(F.lit("d"), n - 1, p, x["b"], rest, x["a"]).alias("key"), F.lit(1).alias("kind")),
                )

            return F.flatten(F.transform(F.sequence(F.lit(0), F.length(x["p"]) - 1), at_position))

        return F.flatten(F.transform(parts, of_part))

    def itself(p: Column) -> Column:
        at = p * PIECE
        b, mid, a = F.xxhash64(F.substring(line, F.lit(1), at)), F.substring(line, at + 1, F.lit(PIECE - 1)), F.xxhash64(F.substring(line, at + PIECE, n))
        return F.struct(F.xxhash64(F.lit("d"), n, p, b, mid, a).alias("key"), F.lit(2).alias("kind"))

    return F.concat(F.flatten(F.transform(pieces(n), of_piece)), F.transform(pieces(n + 1), itself))


def near_lines(docs: DataFrame, held: DataFrame, first: DataFrame, id_col: str, text_col: str, near_chars: int, most: int) -> DataFrame:
    """(h1, h2) of the distinct lines that have an earlier line within one edit. held: (h1, halves) of all lines, at most `most`; first: (h1, h2, at), each distinct line's earliest place."""
    live = durable(_meeting(held, F.col("halves")).distinct(), "live", most)
    some = F.broadcast(live) if live.count() <= SMALL else shuffled(live)
    lines = _lines(docs, id_col, text_col, near_chars).join(some, "h1", "left_semi").groupBy("h1", "h2").agg(F.min("line").alias("line"))
    every = durable(lines, "lines")
    most = every.count()
    lines = every.join(shuffled(_meeting(every, _without_block(F.col("line"))).distinct()), "h1", "left_semi")
    lines = durable(lines.join(shuffled(first), ["h1", "h2"]).select(F.struct("at", "h1", "h2").alias("me"), "line"), "candidates", most)
    variants = lines.select(F.col("me.h1").alias("h1"), F.col("me.h2").alias("h2"), F.explode(_variants(F.col("line"))).alias("v")).select("h1", "h2", "v.*")
    variants = durable(variants, "variants")  # making them costs more than keeping them
    met = variants.groupBy("key").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select("key")
    found = durable(variants.join(shuffled(met), "key"), "found")
    discard(variants)
    held_by = found.join(shuffled(lines.select(F.col("me"), F.col("me.h1").alias("h1"), F.col("me.h2").alias("h2"))), ["h1", "h2"]).select("key", "kind", "me")
    least = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("me")))
    groups = held_by.groupBy("key").agg(least(0).alias("r"), least(1).alias("d"), least(2).alias("s"))
    other = F.when(F.col("kind") == 0, F.col("r")).when(F.col("kind") == 1, F.col("s")).otherwise(F.col("d"))
    pairs = held_by.join(shuffled(groups), "key").select("me", other.alias("other")).where(F.col("other") < F.col("me")).distinct()
    mine, theirs = lines.toDF("me", "line"), lines.toDF("other", "earlier")
    checked = pairs.join(shuffled(mine), "me").join(shuffled(theirs), "other").where(F.levenshtein("line", "earlier", 1).between(0, 1))
    near = durable(checked.select("me.h1", "me.h2").distinct(), "near", most)
    discard(live, every, lines, found)
    return near


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_chars: int = NEAR_CHARS) -> DataFrame:
    """(id, th, pos, near): the lines to drop, th being the hash of the document's text, near whether no equal line is earlier."""
    place = F.struct("id", "th", "pos")
    halves = F.when(F.length("line") >= near_chars, _halves(F.col("line")))
    lines = _lines(docs, id_col, text_col).withColumn("halves", halves).drop("line")
    held = durable(lines, "held")  # hashes only
    most = held.count()
    first = durable(held.groupBy("h1", "h2").agg(F.min(place).alias("at")), "first", most)
    near = near_lines(docs, held, first, id_col, text_col, near_chars, most)
    status = first.join(shuffled(near.withColumn("near", F.lit(True))), ["h1", "h2"], "left").select("h1", "h2", "at", F.coalesce("near", F.lit(False)).alias("near"))
    rows = held.select("h1", "h2", place.alias("place")).join(shuffled(status), ["h1", "h2"]).where((F.col("place") > F.col("at")) | F.col("near"))
    return rows.select("place.id", "place.th", "place.pos", (F.col("place") <= F.col("at")).alias("near"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_chars: int = NEAR_CHARS) -> DataFrame:
    """docs with the text cut to the lines that stay, and n_lines, n_dropped, n_near (longs) added; every row stays.

    A null text stays null, with no lines. Rows equal in id and text are one document here and come out alike. An empty table
    gives an empty one. Columns of any other name pass through; those with the names of the added ones give way to them.
    """
    cut = dropped_lines(docs.select(F.col(id_col), F.col(text_col)), id_col, text_col, near_chars).groupBy("id", "th").agg(F.collect_set("pos").alias("cut"), F.count_if("near").alias("near"))
    cut = cut.hint("shuffle_hash")
    rows = docs.select(F.struct("*").alias("doc"), F.xxhash64(text_col).alias("own"))
    rows = rows.join(cut, row_of(id_col).eqNullSafe(F.col("id")) & (F.col("own") == F.col("th")), "left")  # the hint saves sorting the texts
    text, pieces = row_of(text_col), F.split(row_of(text_col), "\n")
    # array_except works by hash: positions that stay, in order
    stay = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col("cut"))
    # the lines are bound to a name of the lambda, so they are split once
    rest = F.transform(F.array(pieces), lambda p: F.array_join(F.transform(stay, lambda i: F.element_at(p, i + 1)), "\n"))[0]
    counts = {"n_lines": F.when(text.isNull(), 0).otherwise(F.size(pieces)), "n_dropped": F.coalesce(F.size("cut"), F.lit(0)), "n_near": F.coalesce("near", F.lit(0))}
    cleaned = unpacked(docs, {text_col: F.when(F.col("cut").isNull(), text).otherwise(rest)}, *counts)
    return rows.select(*cleaned, *[v.cast("long").alias(k) for k, v in counts.items()])


def keep_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_chars: int = NEAR_CHARS) -> DataFrame:
    """docs with the text cut to the lines that stay; a document that had words and has none left is no longer a row."""
    packed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*[c for c in docs.columns if c != text_col]).alias("doc"))
    done = dedup_lines(packed, "id", "text", near_chars)
    done = done.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return done.select(*unpacked(docs, {text_col: F.col("text")}))
