"""Token ids in shards with a minimal perfect hash index.

The file format is a Parquet table (any store that Spark can write), a row for each shard, uncompressed within its columns:

* part, seq: order of the shards; documents are in ascending order of id (null first), then of the text's hash;
* n_docs, n_tokens; first_key, last_key: least and greatest id (null: none);
* ids: the raw payload, all ids of all documents one after another, little-endian, `width` bytes each (2 if the vocabulary allows);
* offsets: little-endian unsigned 64-bit, n_docs + 1: where each document starts, in ids;
* keys: the documents' ids, for reading in order;
* index: a minimal perfect hash of the shard's distinct keys ("hash and displace"): header (n keys, n buckets) as unsigned 32-bit,
  a signed 32-bit displacement for each bucket, and for each of the n slots a 32-bit fingerprint of its key, the number of the
  key's first document and how many follow each other with this key, unsigned 32-bit each.

A shard is a row group of its own, whose statistics hold its key range. A lookup finds the shards whose range holds a key by the heads
alone, reads these shards only, hashes the key to one slot and compares the fingerprint: constant time.
"""

from __future__ import annotations

import functools
import json
import string
import zlib
from array import array

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelflow.llm.common import whole

#: Ids of a shard end after so many bytes, at the end of a document.
SHARD_BYTES = 4 << 20
#: Pieces of text whose ids a Python worker remembers, over all tasks it runs, of at most so many characters.
CACHE, LONG = 1_000_000, 64
#: So many shards are asked for by a filter that the scan can use, more by a join.
FEW = 500
#: The settings of a tokenizer whose texts may be encoded part by part.
BY_PARTS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
SHARDS = "part int, seq int, n_docs int, n_tokens long, width int, first_key long, last_key long, ids binary, offsets binary, keys array<long>, index binary"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Parts(dict):
    """Part of a text -> its ids as bytes, for the tokenizers that Encoder takes part by part. What is missing is encoded and, up to
    LONG characters, remembered in two generations of at most CACHE / 2 each (and what one call of the encoder adds): the older
    one's parts move back as they are met, so those in use stay known."""

    def __init__(self, tokenizer, kind: str, older: dict | None = None):
        super().__init__({"": b""})
        self.tokenizer, self.kind, self.older = tokenizer, kind, older or {}
        self.split = tokenizer.model.tokenize
        # no mark that occurs in an added token may be cut off
        added = "".join(t.content for t in tokenizer.get_added_tokens_decoder().values())
        self.marks = "".join(c for c in string.punctuation if c not in added)
        # Latin letters as the model sees them; none changes beside another
        self.letters = {}
        for c in filter(str.isalpha, map(chr, range(256))):
            ((piece, _),) = tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(c))
            self.letters[ord(c)] = piece

    def next(self) -> Parts:
        """A new generation, to which this one is the older."""
        young = Parts.__new__(Parts, {})
        young.__dict__.update(self.__dict__)
        young[""], young.older = b"", self
        self.older = {}
        return young

    def __missing__(self, x: str) -> bytes:
        found = self.older.get(x)
        if found is None:
            if x[-1] in self.marks and (y := x.rstrip(self.marks)) and y[-1].lower()[-1].isalnum():  # some letter's lower case ends in a mark
                found = self[y] + self[x[len(y) :]]
            elif not x.isalpha():
                found = self.plain(x)
            elif not x.isascii():
                found = self.word(x.translate(self.letters)) if max(x) < "\u0100" else self.plain(x)
            else:
                low = x.lower()
                found = self.word(x) if low == x else self[low]
        if len(x) <= LONG:
            self[x] = found
        return found

    def word(self, letters: str) -> bytes:
        return array(self.kind, [t.id for t in self.split(letters)]).tobytes()

    def plain(self, x: str) -> bytes:
        return array(self.kind, self.tokenizer.encode_batch_fast([x], add_special_tokens=False)[0].ids).tobytes()


class Encoder:
    """Ids of whole texts. A tokenizer with the settings BY_PARTS and words ending in </w> drops white space and never looks past it, so
    a text's ids are those of its parts between spaces, tabs and line ends, in order; parts seen before are not encoded again. A new
    part is cut before the ASCII marks it ends in, where the tokenizer itself starts another word. What remains and is Latin letters
    only is one word of the model. Any other tokenizer encodes whole texts plainly."""

    def __init__(self, path: str, end_id: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.tokenizer = Tokenizer.from_file(path)
        model, added = self.tokenizer.model, self.tokenizer.get_added_tokens_decoder().values()
        parts = {"normalizer": self.tokenizer.normalizer, "pre_tokenizer": self.tokenizer.pre_tokenizer}
        self.by_parts = isinstance(model, BPE) and model.end_of_word_suffix == "</w>" and all(v is not None and json.loads(v.__getstate__()) == BY_PARTS[k] for k, v in parts.items())
        self.by_parts = self.by_parts and not any(getattr(model, k, None) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges"))
        self.by_parts = self.by_parts and not any(t.lstrip or t.rstrip or t.single_word or t.normalized or t.content.split() != [t.content] or t.content.isalpha() for t in added)
        vocab = self.tokenizer.get_vocab()
        self.width = 2 if max(len(vocab), *vocab.values(), end_id) < 1 << 16 else 4
        self.kind, self.end = np.dtype(f"<u{self.width}"), end_id.to_bytes(self.width, "little")
        self.cache = Parts(self.tokenizer, {2: "H", 4: "I"}[self.width]) if self.by_parts else {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_parts:
            import numpy as np

            found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            return [np.array(x.ids, self.kind).tobytes() + self.end for x in found]
        if len(self.cache) > CACHE // 2:
            self.cache = self.cache.next()
        get = self.cache.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))) + self.end for t in texts]


@functools.lru_cache(1)
def encoder(path: str, end_id: int) -> Encoder:
    """This process's encoder: a Python worker runs many tasks, which read the vocabulary and meet a word for the first time once."""
    return Encoder(path, end_id)


def _hash(key, seed):
    import numpy as np

    x = key + np.atleast_1d(seed) * np.uint64(0x9E3779B97F4A7C15)  # arrays wrap round silently
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _marks(keys):
    import numpy as np

    return (_hash(keys, np.uint64(0xF00D)) >> np.uint64(32)).astype("<u4")


def build_index(keys, first, run) -> bytes:
    """The index of distinct integer keys with two numbers each."""
    import numpy as np

    k = np.asarray(keys, np.int64).view(np.uint64)
    n, buckets = len(k), max(1, -(-len(k) // 3))
    bucket = (_hash(k, np.uint64(0)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    ends = np.cumsum(sizes)
    free, place, shift = np.ones(n, bool), np.full(n, -1), np.zeros(buckets, "<i4")
    for b in np.argsort(-sizes, kind="stable"):
        mine = order[ends[b] - sizes[b] : ends[b]]
        if len(mine) < 2:
            break
        tried, found = 1, False
        while not found:
            seeds = np.arange(tried, tried + 128, dtype=np.uint64)
            at = (_hash(k[mine][:, None], seeds) % np.uint64(n)).astype(np.int64)
            line = np.sort(at, axis=0)
            good = np.nonzero(free[at].all(0) & (line[1:] != line[:-1]).all(0))[0]
            if found := bool(len(good)):
                place[mine], shift[b] = at[:, good[0]], tried + good[0]
                free[place[mine]] = False
            tried += 128
    alone = np.nonzero(sizes == 1)[0]
    spare = np.nonzero(free)[0]
    place[order[ends[alone] - 1]], shift[alone] = spare[: len(alone)], -1 - spare[: len(alone)]
    slots = np.zeros((n, 3), "<u4")
    slots[place] = np.stack((_marks(k), np.asarray(first, "<u4"), np.asarray(run, "<u4")), 1)
    return np.array([n, buckets], "<u4").tobytes() + shift.tobytes() + slots.tobytes()


def find_in_index(index: bytes, keys):
    """(first, run) of each key, run 0 where the index has no such key (by fingerprint)."""
    import numpy as np

    n, buckets = (int(x) for x in np.frombuffer(index, "<u4", 2))
    keys = np.asarray(keys, np.int64).view(np.uint64)
    if not n:
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    shift = np.frombuffer(index, "<i4", buckets, 8)
    slots = np.frombuffer(index, "<u4", 3 * n, 8 + 4 * buckets).reshape(n, 3)
    d = shift[(_hash(keys, np.uint64(0)) % np.uint64(buckets)).astype(np.int64)].astype(np.int64)
    at = np.where(d < 0, -1 - d, (_hash(keys, np.maximum(d, 0).astype(np.uint64)) % np.uint64(n)).astype(np.int64))
    got = slots[at]
    ok = got[:, 0] == _marks(keys)
    return got[:, 1].astype(np.int64), np.where(ok, got[:, 2], 0).astype(np.int64)


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> None:
    """Encode the whole texts (null: empty), end_id after each, and write the shards. Ids of documents are longs; they may repeat."""
    tokenizer = tokenizer or vocabulary()

    def shards(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encode, part, seq = encoder(tokenizer, end_id), TaskContext.get().partitionId(), 0
        keys, held, size = [], [], 0

        def shard():
            known = [(k, i) for i, k in enumerate(keys) if k is not None]
            distinct, first, run = np.unique(np.array([k for k, _ in known], np.int64), return_index=True, return_counts=True)
            offsets = np.concatenate(([0], np.cumsum([len(h) // encode.width for h in held]))).astype("<u8")
            values = [part, seq, len(keys), int(offsets[-1]), encode.width, known[0][0] if known else None, known[-1][0] if known else None]
            values += [b"".join(held), offsets.tobytes(), keys, build_index(distinct, first + (len(keys) - len(known)), run)]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], [x.split()[0] for x in SHARDS.split(", ")])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a in range(0, len(ids), 256):
                for key, raw in zip(ids[a : a + 256], encode(texts[a : a + 256])):
                    keys.append(key)
                    held.append(raw)
                    size += len(raw)
                    if size >= shard_bytes:
                        yield shard()
                        keys, held, size, seq = [], [], 0, seq + 1
        if keys:
            yield shard()

    rows = docs.select(F.col(id_col).cast("long").alias("key"), whole(text_col).alias("text"))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.mapInArrow(shards, SHARDS)
    rows.write.mode("overwrite").option("compression", "zstd").option("parquet.block.row.count.limit", 1).parquet(path)


def directory(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, n_docs, n_tokens, first_key, last_key, base): a row for each shard, base being the ids of all shards before it."""
    heads = spark.read.parquet(path).select("part", "seq", "n_docs", "n_tokens", "first_key", "last_key")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = heads.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))  # a short row for each writing task
    parts = parts.select("part", before(W.orderBy("part")).alias("start"))
    return heads.withColumn("own", before(W.partitionBy("part").orderBy("seq"))).join(parts, "part").withColumn("base", F.col("start") + F.col("own")).drop("own", "start")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32): every document, from the files. start counts the ids of all documents before it; the CRC is of
    the document's ids as little-endian unsigned 32-bit integers. Documents with a key are found through the index, those without
    one, which come first, by order."""

    def documents(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                offsets, width, ids = np.frombuffer(row["offsets"], "<u8").astype(np.int64), row["width"], row["ids"]
                keys = np.unique(np.array([k for k in row["keys"] if k is not None], np.int64))
                first, run = find_in_index(row["index"], keys)
                bare = row["keys"].count(None)
                at = np.concatenate((np.arange(bare), np.repeat(first - np.cumsum(run) + run, run) + np.arange(run.sum())))
                key = [None] * bare + np.repeat(keys, run).tolist()
                if len(at) != len(row["keys"]) or (np.sort(at) != np.arange(len(at))).any():
                    raise ValueError(f"shard {row['part']}-{row['seq']}: the index and the keys differ")
                for a in range(0, len(at), 512):
                    here = at[a : a + 512]
                    sizes = offsets[here + 1] - offsets[here]
                    some = [np.frombuffer(ids, f"<u{width}", n, offset * width).astype("<u4") for n, offset in zip(sizes.tolist(), offsets[here].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["part"]] * len(here), pa.int32()), pa.array([row["seq"]] * len(here), pa.int32()), pa.array(key[a : a + 512], pa.int64()), pa.array(offsets[here], pa.int64()), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in some], pa.int64())],
                        ["part", "seq", "key", "at", "n_tokens", "crc32"],
                    )

    rows = spark.read.parquet(path).select("part", "seq", "width", "ids", "offsets", "keys", "index")
    rows = rows.mapInArrow(documents, "part int, seq int, key long, at long, n_tokens long, crc32 long")
    return rows.join(directory(spark, path).select("part", "seq", "base"), ["part", "seq"]).select("key", (F.col("base") + F.col("at")).alias("start"), "n_tokens", F.col("crc32").alias("ids_crc32"))


def lookup(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """(key, ids array<long>) for each document with one of the keys, through the index. Unknown keys give no row."""
    keys = sorted(set(keys))

    def found(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                offsets = np.frombuffer(row["offsets"], "<u8").astype(np.int64)
                mine = [k for k in keys if row["first_key"] <= k <= row["last_key"]]
                for k, f, n in zip(mine, *find_in_index(row["index"], mine)):
                    out += [(k, np.frombuffer(row["ids"], f"<u{row['width']}", offsets[i + 1] - offsets[i], offsets[i] * row["width"])) for i in range(f, f + n)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int64()), pa.array([x.astype(np.int64) for _, x in out], pa.list_(pa.int64()))], ["key", "ids"])

    table = spark.read.parquet(path)
    near = F.exists(F.array(*[F.lit(k).cast("long") for k in keys] or [F.lit(None).cast("long")]), lambda k: k.between(F.col("first_key"), F.col("last_key")))
    heads = table.select("part", "seq", "first_key", "last_key").where(near).select("part", "seq")
    wanted = heads.limit(FEW + 1).collect()
    if len(wanted) <= FEW:
        one_of = F.lit(False)
        for r in wanted:
            one_of = one_of | ((F.col("part") == r["part"]) & (F.col("seq") == r["seq"]))
        shards = table.where(one_of)
    else:
        shards = table.join(heads, ["part", "seq"], "left_semi")
    return shards.select("first_key", "last_key", "width", "ids", "offsets", "index").mapInArrow(found, "key long, ids array<long>")
