"""Relational building blocks: deterministic top-1, upserts, snapshot replacement, group repair, fuzzy joins."""

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def non_blank(c: Column) -> Column:
    return F.coalesce(F.trim(c) != "", F.lit(False))


def confirm_key(code: Column, gid: Column) -> Column:
    """The code, or gid:<gid> where it is blank; derived before joining, so that the join stays an equi-join."""
    return F.coalesce(F.nullif(F.trim(code), F.lit("")), F.concat(F.lit("gid:"), gid.cast("string")))


def top1(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in a total order, by a struct minimum: combined map-side, no sort of whole groups."""
    first = F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct(*df.columns).alias("row"))).alias("m")
    return df.groupBy(*keys).agg(first).select("m.row.*")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of new replace rows of old with the same key."""
    return old.join(new.select(*keys), list(keys), "left_anti").select(*old.columns).unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti").select(*old.columns))


def replace_units(old: DataFrame, new: DataFrame, unit: str) -> DataFrame:
    """All rows of the units that new mentions are replaced by those of new."""
    return old.join(new.select(unit).distinct(), unit, "left_anti").select(*old.columns).unionByName(new)


def conflicts_fail(df: DataFrame, keys: Sequence[str], ok: Column) -> DataFrame:
    """Adds `conflict`: whether an OK row shares its key with another OK row."""
    n = F.count(F.when(ok, 1)).over(W.partitionBy(*keys))
    return df.withColumn("conflict", ok & (n > 1))


def peer_repair(df: DataFrame, group: str, size: str, tolerance: float, least: int = 3) -> DataFrame:
    """Adds median, is_peer and repaired: outliers of a group take the median of its peers; left alone where none or all are peers.

    All windows share one partitioning, so the table is read and shuffled once.
    """
    w = W.partitionBy(group)
    rows = df.withColumn("median", F.median(size).over(w)).withColumn("__n", F.count("*").over(w))
    rows = rows.withColumn("is_peer", F.abs(F.col(size) - F.col("median")) <= F.col("median") * tolerance)
    rows = rows.withColumn("__peer", F.median(F.when(F.col("is_peer"), F.col(size))).over(w)).withColumn("__k", F.count_if("is_peer").over(w))
    fix = (F.col("__n") >= least) & (F.col("__k") > 0) & ~F.col("is_peer")
    return rows.withColumn("repaired", F.when(fix, F.col("__peer")).otherwise(F.col(size))).drop("__n", "__peer", "__k")


def tasks_of(df: DataFrame, few: int = 5_000, most: int = 50_000) -> int:
    """A number of tasks for rows of few bytes and much work: `few` rows each, or up to `most` where the cores all have work."""
    n = df.count()
    return min(n // few + 1, max(2 * df.sparkSession.sparkContext.defaultParallelism, n // most))


def hamming(a: Column, b: Column) -> Column:
    """Positions of two strings of the same length that differ."""
    parts = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.aggregate(parts, F.lit(0), lambda s, x: s + x)


def hamming_join(left: DataFrame, right: DataFrame, a: str, b: str, size: int = 8) -> DataFrame:
    """Pairs of codes of `size` digits within Hamming distance 2, with their distance.

    Two such codes are equal once the two places where they may differ are masked, so each code is filed under all pairs of masked
    places (28 for 8 digits): an equi-join whose every match is a result, and the work follows the pairs that there are.
    """
    def keyed(df: DataFrame, c: str) -> DataFrame:
        cut = lambda i, j: F.concat(F.lit(f"{i}{j}:"), F.substring(c, 1, i), F.lit("?"), F.substring(c, i + 2, j - i - 1), F.lit("?"), F.substring(c, j + 2, size))
        keys = [cut(i, j) for i in range(size) for j in range(i + 1, size)]
        return df.select(c).where(F.length(c) == size).distinct().withColumn("__k", F.explode(F.array(*keys)))

    return keyed(left, a).join(keyed(right, b), "__k").select(a, b).distinct().withColumn("distance", hamming(F.col(a), F.col(b)))


#: Pairs that a task of box_join tests, about; so many pairs a row counts as, to be shuffled and sorted; a dense cell is dealt into blocks
#: of so many times `most` rows of each side at most.
TASK_PAIRS, ROW_PAIRS, BLOCK_SIDE = 50_000_000, 20, 5
#: A cell of box_join is so many times narrower than the larger boxes: boxes are filed more often, and fewer pairs are tested in vain.
CELL_SPLIT, BOUNDS = 3, ("minx", "miny", "maxx", "maxy")


def box_join(left: DataFrame, right: DataFrame, a: str, b: str, cell: float | None = None, most: int = 2000) -> DataFrame:
    """Pairs of rows whose boxes a and b (struct minx, miny, maxx, maxy) share a point, each pair once.

    Boxes are filed under the cells of a grid that they touch; a pair counts in the cell of the lower corner of what both share. The
    cell's side is an average box's of the side with the larger boxes, split in CELL_SPLIT but not below the other side's, or what holds
    four right rows on average if that is more: so a box is filed under as many cells on average however many rows there are. A cell with
    over BLOCK_SIDE * most rows of a side is dealt into blocks, and the number of tasks follows the pairs to test (and the rows): rows are
    few bytes where pairs are many, and tasks joined by bytes would be few. A pair's test reads flat columns, no structs, and divides nothing.
    """
    if cell is None:
        sides = lambda c: [F.avg(F.col(c)["maxx"] - F.col(c)["minx"]), F.avg(F.col(c)["maxy"] - F.col(c)["miny"])]
        m = right.agg(*sides(b), F.max(F.col(b)["maxx"]) - F.min(F.col(b)["minx"]), F.max(F.col(b)["maxy"]) - F.min(F.col(b)["miny"]), F.count("*")).first()
        own = left.agg(*sides(a)).first()
        small, large = sorted(max(r[0] or 0.0, r[1] or 0.0) for r in (m, own))
        cell = max(large / CELL_SPLIT, small, (4 * (m[2] or 0.0) * (m[3] or 0.0) / m[4]) ** 0.5 if m[4] else 0.0) or 1.0
    to = lambda v: F.floor(v / cell)

    def filed(df: DataFrame, box: str, own: str) -> DataFrame:
        """Rows by cell, with the box's bounds and whether the cell is its first in each direction."""
        lows = {"minx": "__i", "miny": "__j"}
        rows = df.withColumns({own + c: F.col(box)[c] for c in BOUNDS})
        for c, k in lows.items():
            rows = rows.withColumn(k, F.explode(F.sequence(to(F.col(own + c)), to(F.col(own + c.replace("min", "max"))))))
        return rows.withColumns({own + k: to(F.col(own + c)) == F.col(k) for c, k in lows.items()})

    x, y = filed(left, a, "__a"), filed(right, b, "__b")
    side, on = BLOCK_SIDE * most, ["__i", "__j"]
    sizes = x.groupBy(*on).agg(F.count("*").alias("__l")).join(y.groupBy(*on).agg(F.count("*").alias("__r")).hint("merge"), on)
    work = F.col("__l").cast("double") * F.col("__r") + ROW_PAIRS * (F.col("__l") + F.col("__r"))
    pairs, widest = sizes.agg(F.sum(work), F.max(F.greatest("__l", "__r"))).first()
    if (widest or 0) > side:
        dense = sizes.where((F.col("__l") > side) | (F.col("__r") > side)).select(*on, *[F.ceil(F.col(c) / side).cast("int").alias(c) for c in ("__l", "__r")])
        parts = {c: F.coalesce(c, F.lit(1)) for c in ("__l", "__r")}

        def dealt(df: DataFrame, columns: list[str], own: str, other: str, mine: str, theirs: str) -> DataFrame:
            rows = df.join(dense, on, "left").withColumn(mine, F.pmod(F.xxhash64(*columns), parts[own]).cast("int"))
            return rows.withColumn(theirs, F.explode(F.sequence(F.lit(0), parts[other] - 1))).drop("__l", "__r")

        x, y = dealt(x, left.columns, "__l", "__r", "__p", "__q"), dealt(y, right.columns, "__r", "__l", "__q", "__p")
        on = [*on, "__p", "__q"]
    tasks = min(20_000, int((pairs or 0) / TASK_PAIRS))
    if tasks > 1:  # a number that is given is not made smaller by bytes
        tasks = max(tasks, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        x, y = x.repartition(tasks, *on), y.repartition(tasks, *on)
    met = x.join(y.hint("merge"), on)
    p, q = ({c: F.col(own + c) for c in (*BOUNDS, "__i", "__j")} for own in ("__a", "__b"))
    share = (p["minx"] <= q["maxx"]) & (p["maxx"] >= q["minx"]) & (p["miny"] <= q["maxy"]) & (p["maxy"] >= q["miny"])
    here = (p["__i"] | q["__i"]) & (p["__j"] | q["__j"])  # the lower corner of what both share lies in the first cell of one of them
    return met.where(share & here).drop("__i", "__j", "__p", "__q", *[own + c for own in ("__a", "__b") for c in (*BOUNDS, "__i", "__j")])


def quantiles(df: DataFrame, column: str, shares: list[float], keep: int = 10_000) -> list[float | None]:
    """Exact quantiles (linear interpolation) of a numeric column, without a sort or one task that holds all values.

    Histograms narrow the range about each wanted rank until at most `keep` distinct values are left in it, which are then looked at.
    Each pass reads one column and sends 1024 counts. Nulls and NaN do not count; null for no values.
    """
    v = F.col(column).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v)).select(v.alias("v"))
    low, high, n = rows.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not n:
        return [None] * len(shares)

    def at(rank: int) -> float:
        """The value with `rank` values before it."""
        a, b, before = low, high, 0
        while a < b:
            inside = rows.where(F.col("v").between(a, b))
            few = inside.groupBy("v").count().orderBy("v").limit(keep + 1).collect()
            if len(few) <= keep:
                for r in few:
                    before += r["count"]
                    if rank < before:
                        return r["v"]
            step = (b - a) / 1024
            bin_ = F.least(F.lit(1023), F.floor((F.col("v") - a) / step)) if step else F.lit(0)
            counts = inside.groupBy(bin_.alias("k")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy("k").collect()
            for r in counts:
                if rank < before + r["n"]:
                    a, b = r["a"], r["b"]
                    break
                before += r["n"]
        return a

    out = []
    for share in shares:
        place = share * (n - 1)
        first = int(place)
        lower = at(first)
        out.append(lower + (place - first) * (at(min(first + 1, n - 1)) - lower) if place > first else lower)
    return out


def found_in(term: str, columns: Sequence[str], any_case: bool = False, joined: bool = False) -> Column:
    """Whether a search term is in one of the columns, or in all of them joined by blanks; an empty term is in everything."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    texts = [F.concat_ws(" ", *texts)] if joined else texts
    found = F.lit(False)
    for c in texts:
        found = found | (F.lower(c).contains(term.lower()) if any_case else c.contains(term))
    return found


def where_named(df: DataFrame, asked: dict[str, object], known: set[str]) -> DataFrame:
    """Rows that equal what is asked for in each known column; names that are not known and values of None are no condition."""
    for name in sorted(asked.keys() & known):
        df = df if asked[name] is None else df.where(F.col(name) == asked[name])
    return df


def visible(df: DataFrame, unit: str, role: str, own: object) -> DataFrame:
    """The rows an account may see: all for a master, those of its own unit otherwise. The filter reaches the scan."""
    return df if role == "master" else df.where(F.col(unit) == own)


#: Distinct names that are sent to every task at most, and their characters in all.
MANY, CHARS = 200_000, 16_000_000
#: Distinct first characters of names by which gram_join chooses where to cut grams, at most.
FIRSTS = 10_000


def contains_join(texts: DataFrame, names: DataFrame, text: str, name: str) -> DataFrame:
    """Pairs of rows where the text contains the name; null and empty names match nothing.

    Where the distinct names are few enough to be sent to every task (MANY, CHARS: checked), one automaton of them all reads each text
    once. More names meet the texts by their grams (see gram_join). Both find the same pairs.
    """
    distinct = names.where(F.length(name) > 0).select(F.col(name).alias("__n")).distinct()
    size = distinct.agg(F.count("*"), F.sum(F.length("__n"))).first()
    if not size[0]:
        return texts.join(names, F.lit(False))
    if size[0] > MANY or size[1] > CHARS:
        return gram_join(texts, names, text, name)
    known = sorted(r[0] for r in distinct.collect())  # at most MANY, CHARS characters

    @F.pandas_udf("array<int>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, word in enumerate(known):
            automaton.add_word(word, i)
        automaton.make_automaton()
        for batch in batches:
            yield pd.Series([[] if t is None else list({i for _, i in automaton.iter(t)}) for t in batch])

    numbers = texts.sparkSession.createDataFrame(list(enumerate(known)), "__i int, __n string")
    hits = texts.withColumn("__i", F.explode(found(F.col(text)))).join(F.broadcast(numbers), "__i")
    return hits.join(names, F.col("__n") == F.col(name)).drop("__i", "__n")


def gram_join(texts: DataFrame, names: DataFrame, text: str, name: str, gram: int = 8) -> DataFrame:
    """contains_join for any number of names.

    A name of `gram` characters or more meets the texts by its first gram, shorter ones by their own length: a theta join
    becomes an equi-join with the exact test behind it. Texts file hashes of their grams under a hash of their own, each
    once, so that no text is copied for each of its grams; grams are cut from an array of characters, in linear time, and only
    where a name's first character is, if those are FIRSTS at most. Exploded rows are no side to broadcast, whatever their files' size.
    """
    keyed = names.where(F.length(name) > 0).withColumn("__w", F.least(F.length(name), F.lit(gram)))
    keyed = keyed.withColumn("__k", F.xxhash64(F.slice(F.split(F.col(name), ""), F.lit(1), F.col("__w"))))
    widths, firsts = keyed.agg(F.sort_array(F.collect_set("__w")), F.collect_set(F.split(F.col(name), "")[0])).first()  # at most `gram` numbers, and characters
    keyed = keyed.drop("__w")
    if not widths:
        return texts.join(keyed.drop("__k"), F.lit(False))

    def of_width(c: Column, w: int) -> Column:
        at = F.sequence(F.lit(1), F.size(c) - w + 1)
        if len(firsts) <= FIRSTS:
            at = F.filter(at, lambda i: F.element_at(c, i).isin(firsts))
        cut = F.transform(at, lambda i: F.xxhash64(F.slice(c, i, F.lit(w))))
        return F.when(F.size(c) >= w, cut).otherwise(F.array().cast("array<bigint>"))

    # the characters are bound to a name of the lambda, so a text is split once
    grams = F.transform(F.array(F.split(F.col(text), "")), lambda c: F.array_distinct(F.concat(*[of_width(c, w) for w in widths])))[0]
    own = [F.xxhash64(text).alias("__t1"), F.xxhash64(F.lit(1), text).alias("__t2")]
    filed = texts.where(F.col(text).isNotNull()).select(*own, F.explode(grams).alias("__k"))
    hits = filed.join(keyed.select("__k").hint("merge"), "__k", "left_semi").distinct()  # rows equal in text are one here
    rows = texts.select("*", *own).join(hits.hint("merge"), ["__t1", "__t2"]).join(keyed.hint("merge"), "__k").where(F.contains(F.col(text), F.col(name)))
    return rows.drop("__t1", "__t2", "__k")


def nearest(left: DataFrame, right: DataFrame, limit: float, allowed: Column, keys: Sequence[str], out: str, few: int | None = None) -> DataFrame:
    """(keys, out): for each left row (with x, y) the right row's `out` at the least distance up to limit, ties to the least `out`.

    Right rows lie in one cell of side `limit`; left rows ask their cell and its eight neighbours, so it is an equi-join.

    few: `allowed` turns down fewer than `few` distinct `out` of any left row, where that is known. Of the right rows in one place the
    `few` least then do, and cells are halved where rows are dense: a left row's cell that holds `few` of them has an allowed one within
    its diagonal, so the row asks cells of twice that side. It takes the smallest such cell, and the pairs grow with the rows.
    """
    side = limit * (1 + 1e-9)  # what rounding takes for limit lies in a neighbouring cell for certain
    at = lambda c, level: F.floor(F.col(c) / side * F.pow(F.lit(2.0), level))
    left, depth = left.withColumnsRenamed({"x": "__x", "y": "__y"}), 0
    if few is not None:
        right = right.where(~(F.isnan("x") | F.isnan("y")))  # near nothing, and not to be counted in a cell
        right = right.withColumn("__n", F.dense_rank().over(W.partitionBy("x", "y").orderBy(out))).where(F.col("__n") <= few).drop("__n")
        n, w, h = right.agg(F.count("*"), F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
        while n and depth < 20 and side / 2**depth > 1e-7 and (side / 2**depth) ** 2 * n > (w or 0.0) * (h or 0.0) / 16:
            depth += 1
    levels = F.explode(F.array(*[F.lit(k) for k in range(depth + 1)])).alias("__level")
    filed = right.select("*", levels)
    filed = filed.withColumn("__i", at("x", F.col("__level"))).withColumn("__j", at("y", F.col("__level")))
    asked = left.withColumn("__level", F.lit(0))
    cell = ["__level", "__i", "__j"]
    if depth:
        held = filed.groupBy(*cell).agg(F.count_distinct(out).alias("__n")).where(F.col("__n") >= few).select(*cell)
        each = left.select(*keys, "__x", "__y", levels).withColumn("__i", at("__x", F.col("__level"))).withColumn("__j", at("__y", F.col("__level")))
        # rows equal in keys and place are one here, and ask the same
        found = each.join(held.hint("merge"), cell).groupBy(*keys, "__x", "__y").agg((F.max("__level") - 1).alias("__level"))
        same = [F.col(f"l.{c}").eqNullSafe(F.col(f"f.{c}")) for c in (*keys, "__x", "__y")]
        asked = left.alias("l").join(found.hint("merge").alias("f"), same, "left").select("l.*", F.greatest(F.lit(0), F.coalesce("__level", F.lit(0))).alias("__level"))
    around = lambda c: F.explode(F.array(*[at(c, F.col("__level")) + d for d in (-1, 0, 1)]))
    asked = asked.withColumn("__i", around("__x")).withColumn("__j", around("__y"))
    d = F.sqrt((F.col("x") - F.col("__x")) ** 2 + (F.col("y") - F.col("__y")) ** 2)
    near = asked.join(filed.hint("merge"), cell).where(allowed).withColumn("__d", d).where(F.col("__d") <= limit)
    return near.groupBy(*keys).agg(F.min_by(out, F.struct(F.round("__d", 9), out)).alias(out))
