"""Document quality rules with risk-controlled thresholds, in DataFrame operations only.

Base rules are fixed. The method adds one cutoff per stratum (language; null counts as '') on a joint score, chosen from labelled
holdouts: a cutoff is admitted only if the exact binomial (Clopper-Pearson) bound says, at the corrected level, that it rejects at
most `risk` of the stratum's good documents.

* Ratios are whole permille; the joint score is the largest ratio as a percentage of its unit, so both sides of every comparison
  are integers. Units are fixed beforehand, not fitted, so the score owes nothing to the labels.
* One score means one rejection, which has all of `risk`: 228 good labels are enough at four strata. Level: delta / strata
  (Bonferroni). Within a stratum the grid is tested from its loosest cutoff down and testing stops at the first failure (fixed
  sequence), which needs no further correction.
* Admitted cutoffs that reject no bad-labelled document, or too many good ones for it, are not used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.llm.common import GAP, durable, let, unpacked, whole, words

#: Ratios, larger being worse, as permille of (numerator, denominator), and the permille that counts as 100 in the joint score.
RATIOS = {"symbols": ("n_symbols", "word_chars", 20), "repeats": ("n_repeat_words", "n_words", 100), "dup_lines": ("n_dup_lines", "n_lines", 200), "capitals": ("n_capitals", "word_chars", 200), "marks": ("n_marks", "word_chars", 20)}
GRID = (1600, 1200, 800, 600, 400, 300, 200, 150, 100, 75, 50)
RISK, DELTA = 0.02, 0.05
#: A cutoff is used if it rejects this many times as many bad-labelled documents as good ones.
GAIN = 3
#: More strata with cutoffs than this are joined by shuffle, fewer are broadcast.
SMALL = 10_000
#: So many labelled ids (some 20 bytes each) are broadcast to the documents; beyond, labels meet the features by shuffle.
SMALL_LABELS = 1_000_000
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks")


def _repeat_words(w: Column) -> Column:
    """Of an array of words: how many lie in windows of five that are found twice or more.

    Windows are compared by hashes made from the hashes of their words; only where two are equal are they sorted, in n log n, and
    neighbours of one hash held against each other word by word.
    """

    def of_hashes(h: Column) -> Column:
        each = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, 5)]))
        return let(F.slice(each, F.lit(1), F.size(h) - 4), lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), of_windows(g)).otherwise(F.lit(0).cast("long")))

    def of_windows(g: Column) -> Column:
        placed = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(placed, lambda s: let(equal_to_next(s), lambda e: let(starts(s, e), covered)))

    def equal_to_next(s: Column) -> Column:
        window = lambda x: F.slice(w, x["i"] + 1, F.lit(5))
        return F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.coalesce((a["h"] == b["h"]) & (window(a) == window(b)), F.lit(False)))

    def starts(s: Column, e: Column) -> Column:
        return F.sort_array(F.array_compact(F.transform(s, lambda x, k: F.when(F.get(e, k) | F.coalesce(F.get(e, k - 1), F.lit(False)), x["i"]))))

    def covered(p: Column) -> Column:
        start = F.struct(F.lit(-5).alias("at"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(p, start, lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(5), i - a["at"])).alias("n")), lambda a: a["n"])

    return F.when(F.size(w) > 5, let(F.transform(w, lambda x: F.xxhash64(x)), of_hashes)).otherwise(F.lit(0).cast("long"))


def features(text: Column) -> Column:
    """struct of FEATURES (longs) of a text; a null one has no words, and all are 0. All within the row: nothing is shuffled."""
    size = lambda c: F.size(c).cast("long")
    text = whole(text)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(words(text), lambda w: F.struct(size(w).alias("n"), _repeat_words(w).alias("repeat")))
    of_lines = let(lines, lambda x: F.struct(size(x).alias("n"), (size(x) - size(F.array_distinct(x))).alias("dup")))
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("long")
    chars = F.length(F.regexp_replace(text, GAP, "")).cast("long")
    values = lambda w, x: (w["n"], chars, count(r"[#*$%&|<>]"), x["dup"], w["repeat"], x["n"], count(r"\p{Lu}"), count("[!?]"))
    return let(F.struct(of_words.alias("w"), of_lines.alias("x")), lambda v: F.struct(*[c.alias(n) for n, c in zip(FEATURES, values(v["w"], v["x"]))]))


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with FEATURES (longs) added, in place of columns with these names."""
    rows = docs.select(F.struct("*").alias("doc"), features(F.col(text_col)).alias("f"))
    return rows.select(*unpacked(docs, {}, *FEATURES), "f.*")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def stratum(lang_col: str = "lang") -> Column:
    return F.coalesce(F.col(lang_col), F.lit(""))


def joint_score() -> Column:
    """The largest ratio, as a percentage of its unit, rounded down."""
    part = lambda top, bottom, unit: F.when(F.col(bottom) > 0, F.floor(F.floor(F.col(top) * 1000 / F.col(bottom)) * 100 / unit)).otherwise(F.lit(0))
    return F.greatest(*[part(*r) for r in RATIOS.values()]).cast("long")


def critical_count(n: Column, rate: float, level: Column) -> Column:
    """The largest k with P(Binomial(n, rate) <= k) <= level, or -1: k false rejections among n still prove a rate below `rate`.

    A sum of the exact terms, by logarithms. Only k below rate * n can pass, so the fold is that long.
    """
    odds = math.log(rate) - math.log1p(-rate)
    start = F.struct((n * math.log1p(-rate)).alias("log_term"), F.lit(0.0).alias("cdf"), F.lit(-1).cast("long").alias("best"))

    def step(a: Column, i: Column) -> Column:
        cdf = a["cdf"] + F.exp(a["log_term"])
        after = a["log_term"] + F.log(n - i) - F.log(i + 1) + odds
        return F.struct(F.when(i < n, after).otherwise(a["log_term"]).alias("log_term"), cdf.alias("cdf"), F.when(cdf <= level, i).otherwise(a["best"]).alias("best"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.floor(n * rate).cast("long")), start, step, lambda a: a["best"])


def thresholds(labelled: DataFrame, risk: float = RISK, delta: float = DELTA, grid: tuple[int, ...] = GRID) -> DataFrame:
    """labelled(stratum, good boolean, FEATURES) -> (stratum, cutoff, n_good, n_false, n_bad, allowed), a row for each stratum with a cutoff.

    A document is rejected if its joint score exceeds the cutoff. Strata with few good documents get no row: nothing can be proven
    for them. The label table may be of any size; it is reduced to a histogram before anything else.
    """
    score = F.least(joint_score(), F.lit(max(grid) + 1)).alias("score")
    histogram = durable(labelled.select("stratum", "good", score).groupBy("stratum", "good", "score").count(), "histogram")
    good = histogram.where("good").groupBy("stratum").agg(F.sum("count").alias("n_good"))
    # one short row for each language that has labels; their number is the correction's factor
    strata = good.agg(F.collect_list(F.struct("stratum", "n_good")).alias("s")).select(F.explode("s").alias("g"), F.size("s").alias("n_strata"))
    allowed = strata.select("g.*", critical_count(F.col("g.n_good"), risk, F.lit(delta) / F.col("n_strata")).alias("allowed"))
    allowed = allowed.where("allowed >= 0")
    each = F.explode(F.filter(F.array(*map(F.lit, grid)), lambda c: c < F.col("score")))
    over = histogram.select("stratum", "good", "count", each.alias("cutoff")).groupBy("stratum", "cutoff")
    over = over.agg(F.sum(F.when(F.col("good"), F.col("count")).otherwise(0)).alias("n_false"), F.sum(F.when(F.col("good"), 0).otherwise(F.col("count"))).alias("n_bad"))
    # counts over a cutoff grow as it falls, so those that pass are the sequence up to the first failure
    passed = over.join(allowed, "stratum").where((F.col("n_false") <= F.col("allowed")) & (F.col("n_bad") > GAIN * F.col("n_false")))
    best = passed.groupBy("stratum").agg(F.max(F.struct((F.col("n_bad") - GAIN * F.col("n_false")).alias("gain"), "cutoff", "n_good", "n_false", "n_bad", "allowed")).alias("b"))
    return best.select("stratum", "b.cutoff", "b.n_good", "b.n_false", "b.n_bad", "b.allowed")


def with_verdict(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """rows(stratum, FEATURES, any others) with base_failed and kept added. cutoffs has at most a row for each stratum."""
    wide = durable(cutoffs.select(F.col("stratum").alias("of_stratum"), "cutoff"), "cutoffs")
    wide = F.broadcast(wide) if wide.count() <= SMALL else wide
    rows = rows.join(wide, F.col("stratum") == F.col("of_stratum"), "left")
    over = F.coalesce(joint_score() > F.col("cutoff"), F.lit(False))
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~over).drop("of_stratum", "cutoff")


def told(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, good): a document with several labels is good if all of them say so. Null ids and labels do not count."""
    known = labels.select(F.col(id_col).alias("id"), F.col("quality").alias("quality")).where("id IS NOT NULL AND quality IS NOT NULL")
    return known.groupBy("id").agg((F.min("quality") == 1).alias("good"))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(id, FEATURES, base_failed, kept): a row for each row of docs. Features are computed once and written, without the texts."""
    rows = docs.select(F.col(id_col).alias("id"), stratum(lang_col).alias("stratum"), features(F.col(text_col)).alias("f"))
    rows = durable(rows.select("id", "stratum", "f.*"), "features")
    cutoffs = thresholds(rows.join(told(labels, id_col), "id"), risk, delta)
    return with_verdict(rows, cutoffs).drop("stratum").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """The rows of docs that are kept, unchanged. Texts are read twice rather than shuffled: the labelled rows' for their features, all to filter."""
    known = durable(told(labels, id_col), "told")
    rows = docs.select(F.col(id_col).alias("id"), stratum(lang_col).alias("stratum"), F.col(text_col).alias("text"))
    few = known.count() <= SMALL_LABELS
    rows = rows.join(F.broadcast(known), "id") if few else rows
    rows = rows.select("id", "stratum", features(F.col("text")).alias("f"), *(["good"] if few else [])).select("*", "f.*")
    cutoffs = thresholds(rows if few else rows.join(known, "id"), risk, delta)
    rows = docs.select(F.struct("*").alias("doc"), stratum(lang_col).alias("stratum"), features(F.col(text_col)).alias("f"), F.monotonically_increasing_id().alias("at"))
    # a column that is not deterministic keeps the optimizer from copying the features' whole expression into the filter
    rows = with_verdict(rows.select("doc", "stratum", "at", "f.*"), cutoffs)
    return rows.where(F.col("kept") & (F.col("at") >= 0)).select(*unpacked(docs, {}))
