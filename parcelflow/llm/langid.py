"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's TOP most frequent character n-grams (1 to 3 letters of the lower-cased text, anything
that is not a letter counting as a blank), by rank. A text's own profile is compared with each language's by the out-of-place
distance: the sum over the text's n-grams of the difference in rank, TOP where the language lacks the n-gram. The nearest
language is predicted; ties go to the first name. All of a text is counted; a text without letters is `und`.

A letter is what str.isalpha calls one: signs that only stand for numbers, such as one half or a Roman numeral, are none.

Profiles are fitted on a bounded sample of the labelled rows: about MAX_TRAIN rows of each language, chosen by hash of the id. There
may be MAX_LANGS languages; more raise an error, since their profiles would go to the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from parcelflow.llm.common import unpacked

TOP = 400
MAX_TRAIN = 4000
MAX_LANGS = 2000
#: Letters counted at a time, so that a text of any length takes bounded memory.
CHUNK = 1 << 20
#: Runs of letters, and of numeric signs that are no digits: `letters` tells them apart.
LETTERS = re.compile(r"[^\W\d_]+")


def letters(text: str | None) -> str:
    """The lower-cased runs of letters, joined by blanks; '' if there is none."""
    runs = LETTERS.findall((text or "").lower())
    if not all(map(str.isalpha, runs)):
        runs = "".join(c if c.isalpha() else " " for c in " ".join(runs)).split()
    return " ".join(runs)


def grams(text: str | None):
    """(codes, counts) of the n-grams of a text; a code holds up to three code points of 21 bits. Empty if it has no letter."""
    import numpy as np

    line = letters(text)
    if not line:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = np.frombuffer(f" {line} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes, counts = [], []
    for at in range(0, len(c), CHUNK):
        a = c[max(0, at - 2) : at + CHUNK]
        new = min(2, at)  # letters of the piece before
        two, three = (a[:-1] << 21) | a[1:], (a[:-2] << 42) | (a[1:-1] << 21) | a[2:]
        one = a[new:]
        x, n = np.unique(np.concatenate((one[one != 32], two[max(0, new - 1) :], three)), return_counts=True)
        codes.append(x)
        counts.append(n)
    if len(codes) == 1:
        return codes[0], counts[0]
    x, where = np.unique(np.concatenate(codes), return_inverse=True)
    return x, np.bincount(where, np.concatenate(counts)).astype(np.int64)


def ranked(codes, counts, top: int = TOP):
    """The top codes, most frequent first, ties by code."""
    import numpy as np

    if len(codes) > 4 * top:  # keep all that can be among the first, ties included
        keep = counts >= np.partition(counts, -top)[-top]
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:top]


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", max_train: int = MAX_TRAIN, top: int = TOP) -> dict[str, list[int]]:
    """{language: codes by rank} from the rows with a language. What reaches the driver: a count and `top` codes for each language."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().limit(MAX_LANGS + 1).collect()}
    if not sizes:
        return {}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, max_train / n))])
    draw = F.pmod(F.xxhash64(F.lit("langid"), key_col, F.length(text_col)), F.lit(1_000_000)) / 1_000_000
    sample = known.where(draw < share[F.col(lang_col)]).select(lang_col, text_col)

    def count(batches):
        import numpy as np
        import pyarrow as pa

        held: dict[str, list] = {}

        def merged(parts):
            x, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return x, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts = held.setdefault(lang, [])
                parts.append(grams(text))
                if len(parts) > 64:
                    held[lang] = [merged(parts)]
        for lang, parts in held.items():
            x, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(x), pa.string()), pa.array(x, pa.int64()), pa.array(n, pa.int64())], ["lang", "code", "n"])

    totals = sample.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    best = totals.groupBy("lang").agg(F.expr(f"slice(sort_array(collect_list(struct(-n, code))), 1, {top}).code").alias("codes"))  # n-grams of a language, not rows
    return {r["lang"]: list(r["codes"]) for r in best.collect()}


def predictor(profiles: dict[str, list[int]], top: int = TOP):
    """text -> (language, score): score is 1 minus the distance as a share of the largest possible."""
    import numpy as np

    names = sorted(profiles)
    union = np.unique(np.concatenate([np.asarray(profiles[x], np.int64) for x in names])) if names else np.empty(0, np.int64)
    ranks = np.full((len(union) + 1, len(names)), -1, np.int64)  # the last row: in no profile
    for k, x in enumerate(names):
        ranks[np.searchsorted(union, profiles[x]), k] = np.arange(len(profiles[x]))

    def predict(text: str | None) -> tuple[str, float]:
        mine = ranked(*grams(text), top)
        if not len(mine) or not names:
            return "und", 0.0
        at = np.searchsorted(union, mine)
        at[(at == len(union)) | (union[np.minimum(at, len(union) - 1)] != mine)] = len(union)
        theirs = ranks[at]
        away = np.where(theirs < 0, top, np.abs(theirs - np.arange(len(mine))[:, None])).sum(0)
        best = int(away.argmin())
        return names[best], float(1 - away[best] / (top * len(mine)))

    return predict


def identify(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", top: int = TOP) -> DataFrame:
    """docs with lang_pred and score added, in place of columns with these names. Null, empty and letterless texts: `und`, 0. So is
    every text if nothing was learned."""

    @pandas_udf("lang_pred string, score double")
    def predicted(text):
        import pandas as pd

        predict = predictor(profiles, top)
        return pd.DataFrame([predict(t) for t in text], columns=["lang_pred", "score"])

    rows = docs.select(F.struct("*").alias("doc"), predicted(F.col(text_col)).alias("p"))
    return rows.select(*unpacked(docs, {}, "lang_pred", "score"), "p.lang_pred", "p.score")


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0
