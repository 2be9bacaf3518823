"""Secret scanning over an incremental ledger of content-addressed blobs.

A blob is a distinct text, addressed by its SHA-256. The ledger has a row for each (blob, rule version) ever scanned, with the
spans found. A run addresses every row of the table (each is a version of some path), takes the blobs the ledger lacks at the
present rule version, scans each of them once, adds them to the ledger, and joins the findings back to all rows that hold the
blob. A changed rule changes the version, so everything counts as unseen again; an unchanged corpus scans nothing. A corpus may come
in instalments, each scanned against the ledger that those before it have left.

Texts travel to their blob's partition compressed, and a task sends each blob once, so a text that a third of all rows hold
arrives as one row for each task. Findings go back to the rows of a blob by (blob, salt) where more than OFTEN rows hold it.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.llm.common import durable, whole

#: Kind, pattern, group whose length counts, least length.
BASE = (
    ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: Kinds that the method adds, in public formats.
ADDED = (
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    ("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/=-]+", 0, 27),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
)
RULES = BASE + ADDED
SPANS = "array<struct<start:int,kind:int,stop:int>>"
#: Rows that meet a blob's findings under one key, about.
OFTEN = 20_000
LEDGER = f"blob binary, version string, spans {SPANS}"


def version(rules=RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def find(text: str, rules=RULES) -> list[tuple[int, int, int]]:
    """(start, rule number, stop) in code points, by start, then rule: leftmost non-overlapping for each rule, short ones left out."""
    found = []
    for k, (kind, pattern, group, least) in enumerate(rules):
        # a run that is too short can't hold a longer one, so runs of hexadecimal digits are looked for at full length
        pattern = f"[0-9a-f]{{{least},}}" if kind == "hex" else pattern
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if m.end(group) - m.start(group) >= least]
    return sorted(found)


def scan(docs: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> tuple[DataFrame, DataFrame]:
    """-> (findings, ledger). findings: (id, blob, spans), a row for each row of docs, spans empty where there are none.

    A null text counts as empty. ledger: LEDGER rows, the old ones and those scanned now; give it to the next run. Repeated
    rows give repeated findings; an empty table gives empty ones and the ledger as it was.
    """
    spark, now = docs.sparkSession, version(rules)
    text = whole(text_col)

    def address(batches):
        import pyarrow as pa
        import zstandard

        seen, pack = set(), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            rows = {}
            for t in batch.column(0).to_pylist():
                raw = t.encode("utf-8", "surrogatepass")
                if (blob := hashlib.sha256(raw).digest()) not in seen:
                    seen.add(blob)
                    rows[blob] = pack.compress(raw)
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.binary()), pa.array(list(rows.values()), pa.binary())], ["blob", "packed"])

    def scanner(batches):
        import pyarrow as pa
        import zstandard

        seen, unpack = set(), zstandard.ZstdDecompressor()
        kinds = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]))
        for batch in batches:
            rows = {}
            for blob, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if blob not in seen:  # all copies of a blob are in this partition
                    seen.add(blob)
                    found = find(unpack.decompress(packed).decode("utf-8", "surrogatepass"), rules)
                    rows[blob] = [{"start": a, "kind": k, "stop": b} for a, k, b in found]
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.binary()), pa.array(list(rows.values()), kinds)], ["blob", "spans"])

    blobs = docs.select(text.alias("text")).mapInArrow(address, "blob binary, packed binary").repartition("blob")
    if ledger is not None:
        known = ledger.where(F.col("version") == now).select("blob")
        blobs = blobs.join(known, "blob", "left_anti").repartition("blob")
    new = blobs.mapInArrow(scanner, f"blob binary, spans {SPANS}").select("blob", F.lit(now).alias("version"), "spans")
    new = durable(new, "ledger")
    full = new if ledger is None else ledger.unionByName(new)
    hits = full.where((F.col("version") == now) & (F.size("spans") > 0)).select("blob", "spans")
    paths = durable(docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("blob")), "paths")
    often = durable(paths.groupBy("blob").count().where(F.col("count") > OFTEN).select("blob", F.ceil(F.col("count") / OFTEN).cast("int").alias("salts")), "often")
    if not often.isEmpty():
        few = F.broadcast(often) if often.count() <= OFTEN else often
        salts = F.coalesce("salts", F.lit(1))
        paths = paths.join(few, "blob", "left").withColumn("salt", F.floor(F.rand(7) * salts).cast("int")).drop("salts")
        hits = hits.join(few, "blob", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    else:
        paths, hits = paths.withColumn("salt", F.lit(0)), hits.withColumn("salt", F.lit(0))
    found = paths.join(hits, ["blob", "salt"], "left")
    return found.select(F.col("id").alias(id_col), "blob", F.coalesce("spans", F.array().cast(SPANS)).alias("spans")), full


def scan_in_instalments(docs: DataFrame, n: int = 2, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> tuple[DataFrame, DataFrame, list[int]]:
    """scan() over docs as it arrives in n instalments, dealt by hash of id and text: every row is in one of them.

    -> (findings of all rows, ledger, how many blobs each instalment had to scan).
    """
    turn, found, scanned = F.pmod(F.xxhash64(F.lit("turn"), id_col, text_col), F.lit(n)), None, []
    for k in range(n):
        before = 0 if ledger is None else ledger.count()
        some, ledger = scan(docs.where(turn == k), ledger, id_col, text_col, rules)
        scanned.append(ledger.count() - before)
        found = some if found is None else found.unionByName(some)
    return found, ledger, scanned


def digest(findings: DataFrame, id_col: str = "doc_id", rules=RULES) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans): counts, and spans as kind:start:end joined by commas."""
    names = F.array(*[F.lit(k) for k, *_ in rules])
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    said = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")
    of_kind = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{name}") for k, (name, *_) in enumerate(BASE)]
    return findings.select(id_col, *counts, F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said("spans").alias("spans"))
