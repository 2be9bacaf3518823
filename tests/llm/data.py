"""Small document tables with awkward rows."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("key", T.StringType()), T.StructField("fp", T.StringType())])


def awkward(seed=0, n=60):
    """Nulls in any column, empty and long texts, ties, repeated rows; columns key and fp clash with names used inside."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    line = lambda: " ".join(word() for _ in range(r.randint(1, 14)))
    texts = ["\n".join(line() for _ in range(r.randint(1, 6))) for _ in range(n)]
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["a", "b", "é", None]), len(t), "k", None) for i, t in enumerate(texts)]
    rows += [(100 + i, r.choice(texts), "en", "a", 1, None, "f") for i in range(10)]
    for i in range(12):  # one edit each
        t = r.choice(texts)
        at = r.randrange(len(t))
        rows.append((200 + i, t[:at] + r.choice(["", "z", t[at] + "q"]) + t[at + 1 :], None, None, None, "k", "f"))
    rows += [(300, None, "en", "a", None, None, None), (301, "", None, "b", 0, "k", None), (302, " \n\t ", "de", None, 4, "k", None), (303, "one two", "en", "a", 7, "k", "f")]
    rows += [(None, "a row without an id but with enough words in it", "en", "a", 5, "k", "f"), (None, None, None, None, None, None, None)]
    rows += [(304, ("lorem ipsum dolor sit amet " * 400 + "\n") * 3, "en", "b", 1, "k", "f"), (305, "x" * 3000 + " " + "y" * 3000, "en", "b", 1, "k", "f")]
    rows += [rows[3], rows[3], rows[-1]]
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def plain(rows):
    """Comparable: nulls first, as a sorted list."""
    return sorted(((tuple(r)) for r in rows), key=lambda t: [(x is not None, str(type(x)), x) if not isinstance(x, (list, dict)) else (True, "", str(x)) for x in t])
