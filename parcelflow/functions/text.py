"""Codes in text: extraction, repair, sheet numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that scans confuse with digits.
CONFUSED = ("/lIO", "7110")


def digits(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, *CONFUSED), r"[^0-9]", "")


def compact(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", "")


def code_windows(run: Column) -> Column:
    """All 8-digit windows of a run of digits."""
    return F.when(F.length(run) >= 8, F.transform(F.sequence(F.lit(1), F.length(run) - 7), lambda i: F.substring(run, i, F.lit(8)))).otherwise(F.array().cast("array<string>"))


def repair_variants(run: Column) -> Column:
    """Codes one edit away: 7 digits get one inserted, 8 are kept, 9 lose one."""
    n, ten = F.length(run), F.array(*[F.lit(str(d)) for d in range(10)])
    inserted = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(ten, lambda d: F.concat(F.substring(run, F.lit(1), i), d, F.substring(run, i + 1, F.lit(9))))))
    deleted = F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: F.concat(F.substring(run, F.lit(1), i), F.substring(run, i + 2, F.lit(9))))
    return F.array_distinct(F.when(n == 7, inserted).when(n == 8, F.array(run)).when(n == 9, deleted).otherwise(F.array().cast("array<string>")))


def fuzzy_variants(run: Column) -> Column:
    """Codes that a run of digits may stand for: 7 digits get one inserted, 8 are kept or have one replaced, 9 lose one, 10 and 11 are
    cut into windows."""
    ten = F.array(*[F.lit(str(d)) for d in range(10)])
    replaced = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(ten, lambda d: F.concat(F.substring(run, F.lit(1), i), d, F.substring(run, i + 2, F.lit(8))))))
    n = F.length(run)
    return F.array_distinct(F.when(n == 8, replaced).when(n.between(10, 11), code_windows(run)).otherwise(repair_variants(run)))


def _without(run: Column, last: int) -> Column:
    """The numbers that a run of digits makes without one of its digits, the first `last` + 1 in turn."""
    return F.transform(F.sequence(F.lit(0), F.lit(last)), lambda i: F.concat(F.substring(run, F.lit(1), i), F.substring(run, i + 2, F.lit(9))).cast("long"))


#: Keys of a place and the seven digits beside it lie below, keys of whole codes above.
_WHOLE = 1_000_000_000


def code_keys(code: Column) -> Column:
    """Keys of a code of eight digits: itself, and each place with the seven digits beside it."""
    return F.array_append(F.transform(_without(code, 7), lambda v, i: i * 10_000_000 + v), code.cast("long") + _WHOLE)


def run_keys(run: Column) -> Column:
    """Keys of a run of digits, one or more of which are among code_keys of just those codes that are in fuzzy_variants: nine keys at most
    for some eighty variants."""
    n, whole = F.length(run), lambda codes: F.transform(codes, lambda c: c.cast("long") + _WHOLE)
    seven = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: i * 10_000_000 + run.cast("long"))
    eight = F.transform(_without(run, 7), lambda v, i: i * 10_000_000 + v)
    keys = F.when(n == 7, seven).when(n == 8, eight).when(n == 9, whole(_without(run, 8))).when(n.between(10, 11), whole(code_windows(run)))
    return F.array_distinct(F.coalesce(keys, F.array().cast("array<bigint>")))


def paren_runs(c: Column) -> Column:
    """Digits in parentheses, blanks removed."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\(\s*([\d\s]+?)\s*\)"), F.lit(1)), lambda s: F.regexp_replace(s, r"\s", ""))


def named_paren_runs(c: Column) -> Column:
    """The same right behind a Hangul name."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"[가-힣][가-힣\s]*\(\s*([\d\s]+?)\s*\)"), F.lit(1)), lambda s: F.regexp_replace(s, r"\s", ""))


def digit_runs(c: Column) -> Column:
    """Runs of 7 to 11 digits."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\d{7,11}"), F.lit(0))


def paren_code(c: Column) -> Column:
    return F.regexp_extract(c, r"\((\d{8})\)", 1)


def first_tier(*tiers: Column) -> Column:
    """The first array of candidates that is not empty."""
    return F.coalesce(*[F.when(F.size(t) > 0, t) for t in tiers])


def sheet_id(c: Column, valid: Column | None = None) -> Column:
    """`first digit-last digit` of a token, confusions mended. If all valid sheets (an array) share a prefix, it is taken for the first
    digit; a sheet that is not valid is null."""
    d = digits(c)
    first = F.substring(d, 1, 1)
    if valid is not None:
        prefixes = F.array_distinct(F.transform(F.filter(valid, lambda s: s.contains("-")), lambda s: F.substring_index(s, "-", 1)))
        first = F.when(F.size(prefixes) == 1, F.get(prefixes, F.lit(0))).otherwise(first)
    found = F.when(F.length(d) >= 2, F.concat(first, F.lit("-"), F.substring(d, -1, 1)))
    return found if valid is None else F.when((F.size(valid) == 0) | F.array_contains(valid, found), found)


def scale(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(c, r"1\s*:\s*(\d[\d,]*)", 1), ",", "").try_cast("long")


def status_list(c: Column, known: tuple[str, ...] = ("pending", "applied", "rejected")) -> Column:
    """A comma list reduced to known values; `pending` where none is left."""
    got = F.array_intersect(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda s: F.trim(s)), F.array(*map(F.lit, known)))
    return F.when(F.size(got) > 0, got).otherwise(F.array(F.lit("pending")))


def joined_runs(runs: Column, size: int = 8, most: int = 5) -> Column:
    """Distinct strings of `size` digits that one to `most` neighbouring runs make together."""
    made = F.transform(runs, lambda _, i: F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: F.array_join(F.slice(runs, i + 1, k), "")))
    return F.array_distinct(F.filter(F.flatten(made), lambda s: F.length(s) == size))
