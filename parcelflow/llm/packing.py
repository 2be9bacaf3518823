"""Best-fit packing of documents into sequences of several permitted lengths.

Documents are encoded, an end id after each, and cut into pieces of at most the longest length. Pieces are dealt by hash into groups
of some thousands, which are packed apart: in order of falling size, a piece goes into the open bin it leaves least room in. If none
fits, a bin is opened at the size that costs least for each token it would hold, its contents being made up from the pieces still to
come, the largest that fit first, and the size being cut down to them. A group is also packed with each permitted size alone (a
larger one only for pieces that need it), and the cheapest of these packings is taken, so several sizes never cost more than the
best single one. In the end each bin is cut down to the least permitted size that holds its contents.

No group is hot: a group has about GROUP pieces, and rows equal in id and size beyond REPEATS are dealt with a salt.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.llm import tokens
from parcelflow.llm.common import durable, whole

SIZES = (512, 1024, 2048, 4096, 8192)
GROUP, REPEATS = 4096, 64
#: Texts whose token counts a task remembers.
KNOWN = 50_000


def cost(size: int, sizes=SIZES) -> float:
    """Of a sequence, in token equivalents: its length, attention that grows with the square, and a fixed part."""
    return size + size * size / (8 * max(sizes)) + 16


def _packed(falling: list[int], opened) -> tuple[list[int], list[int], list[int]]:
    """Sizes from large to small -> (bin of each, its offset in it, contents of each bin); opened(i): size of a bin for the i-th."""
    rooms, open_ = [], {}  # rooms: distinct free amounts, sorted; open_: bins by free amount
    used, where, offset = [], [], []
    for i, n in enumerate(falling):
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
        else:
            b, room = len(used), opened(i)
            used.append(0)
        where.append(b)
        offset.append(used[b])
        used[b] += n
        if room > n:
            if room - n not in open_:
                insort(rooms, room - n)
            open_.setdefault(room - n, []).append(b)
    return where, offset, used


def pack(pieces: list[int], sizes=SIZES) -> tuple[list[int], list[int], list[int]]:
    """Piece sizes, each from 1 to max(sizes) -> (bin of each piece, its offset in it, size of each bin)."""
    sizes = sorted(sizes)
    order = sorted(range(len(pieces)), key=lambda i: -pieces[i])
    falling = [pieces[i] for i in order]
    rising = falling[::-1]
    holds = lambda n: sizes[bisect_left(sizes, n)]
    price = {s: cost(s, sizes) for s in sizes}

    def jointly(i: int) -> int:
        n, best = falling[i], None
        for s in sizes[bisect_left(sizes, n) :]:
            room, left = s - n, len(rising) - 1 - i  # the pieces to come are the first `left` of rising
            while left := bisect_right(rising, room, 0, left):
                left -= 1
                room -= rising[left]
            each = price[holds(s - room)] / (s - room)
            if best is None or each < best[0]:
                best = (each, s)
        return best[1]

    ways = [jointly] + [lambda i, s=s: max(s, holds(falling[i])) for s in sizes]
    where, offset, used = min((_packed(falling, way) for way in ways), key=lambda p: sum(price[holds(n)] for n in p[2]))
    back = sorted(range(len(order)), key=order.__getitem__)
    return [where[k] for k in back], [offset[k] for k in back], [holds(n) for n in used]


def encoded(docs: DataFrame, id_col: str, text_col: str, tokenizer: str | None, end_id: int, keep: bool) -> DataFrame:
    """Written rows (row, id, size, ids): `ids` are the raw ids, with an end id, if `keep`, else null. Texts without a token have none."""
    tokenizer = tokenizer or tokens.vocabulary()

    def encode(batches):
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        encoder, known = tokens.encoder(tokenizer, end_id), {}  # known: token counts of texts met before, for copies
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a in range(0, len(texts), 256):
                some = texts[a : a + 256]
                marks = [xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in some]
                new = list(range(len(some))) if keep else list({m: k for k, m in enumerate(marks) if m not in known}.values())
                raw = dict(zip(new, encoder([some[k] for k in new])))
                if len(known) > KNOWN:
                    known = {m: known[m] for m in marks if m in known}
                known.update((marks[k], len(x) // encoder.width if len(x) > encoder.width else 0) for k, x in raw.items())
                sizes = [known[m] for m in marks]
                raw = [raw[k] if n else b"" for k, n in enumerate(sizes)] if keep else [None] * len(some)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 256), pa.array(sizes, pa.int64()), pa.array(raw, pa.binary()), pa.array([encoder.width] * len(raw), pa.int32())], ["id", "size", "ids", "width"])

    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    rows = rows.mapInArrow(encode, f"id {docs.schema[id_col].dataType.simpleString()}, size long, ids binary, width int")
    return durable(rows.withColumn("row", F.monotonically_increasing_id()), "encoded")


def layout(rows: DataFrame, sizes=SIZES) -> DataFrame:
    """rows(row, id, size) -> (row, id, piece, n_tokens, bin, offset, bin_size, bin_tokens)."""
    most = max(sizes)
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("size") / most).cast("int") - 1))).alias("piece")
    rows = rows.select("row", "id", "size", at).select("row", "id", "piece", F.least(F.lit(most), F.col("size") - F.col("piece") * most).alias("n_tokens"))
    full = durable(rows.where("n_tokens > 0"), "pieces")
    groups = max(1, -(-full.count() // GROUP))
    same = full.groupBy("id", "piece", "n_tokens").count().where(F.col("count") > REPEATS)
    same = durable(same.withColumn("salts", F.ceil(F.col("count") / REPEATS)).drop("count"), "repeats")
    dealt = full.withColumn("salt", F.lit(0).cast("long"))
    if not same.isEmpty():
        s = same.toDF("id_", "piece_", "n_tokens_", "salts")
        met = F.col("id").eqNullSafe(F.col("id_")) & (F.col("piece") == F.col("piece_")) & (F.col("n_tokens") == F.col("n_tokens_"))
        salt = F.pmod(F.xxhash64("row"), F.coalesce("salts", F.lit(1)))
        dealt = full.join(s, met, "left").select(*full.columns, salt.alias("salt"))
    dealt = dealt.withColumn("group", F.pmod(F.xxhash64("id", "piece", "n_tokens", "salt"), F.lit(groups))).drop("salt")

    def of_group(key, group):
        import pyarrow as pa
        import pyarrow.compute as pc

        group = group.sort_by([("n_tokens", "descending"), ("id", "ascending"), ("piece", "ascending")])
        n = group["n_tokens"].to_pylist()
        where, offset, size = pack(n, sizes)
        used = [0] * len(size)
        for b, x in zip(where, n):
            used[b] += x
        first = pc.multiply(pa.scalar(key[0].as_py(), pa.int64()), pa.scalar(1 << 32, pa.int64())).as_py()
        more = {"bin": [first + b for b in where], "offset": offset, "bin_size": [size[b] for b in where], "bin_tokens": [used[b] for b in where]}
        return pa.table({c: group[c] for c in ("row", "id", "piece", "n_tokens")} | {k: pa.array(v, pa.int64()) for k, v in more.items()})

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"row long, id {kind}, piece int, n_tokens long, bin long, offset long, bin_size long, bin_tokens long"
    packed = dealt.groupBy("group").applyInArrow(of_group, schema)
    none = [F.lit(None).cast("long").alias(c) for c in ("bin", "offset", "bin_size", "bin_tokens")]
    return packed.unionByName(rows.where("n_tokens = 0").select("row", "id", "piece", "n_tokens", *none))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes=SIZES, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """(id, piece, n_tokens, bin, offset, bin_size, bin_tokens): where each piece of each document lies; its end id counts.

    A document without tokens (null text included) has one row, without a bin. Repeated rows are packed each. The result depends on
    ids and token counts alone, but for rows repeated more than REPEATS times. An empty table gives an empty one. Other columns, whatever
    their names, are not looked at.
    """
    return layout(encoded(docs, id_col, text_col, tokenizer, end_id, False).drop("ids"), sizes).drop("row").withColumnRenamed("id", id_col)


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes=SIZES, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """(bin, bin_size, ids array<int>, doc_ids, starts array<int>): the packed sequences, not padded; starts are those of the pieces."""
    rows = encoded(docs, id_col, text_col, tokenizer, end_id, True)
    where = layout(rows.drop("ids"), sizes).where("bin IS NOT NULL").select("row", "piece", "n_tokens", "bin", "offset", "bin_size")
    cut = F.substring("ids", (F.col("piece") * max(sizes) * F.col("width") + 1).cast("int"), (F.col("n_tokens") * F.col("width")).cast("int"))
    pieces = rows.join(where, "row").select("bin", "bin_size", "offset", "id", cut.alias("ids"), "width")

    def assemble(group):
        import numpy as np
        import pyarrow as pa

        group = group.sort_by("offset")
        ids = np.frombuffer(b"".join(group["ids"].to_pylist()), f"<u{group['width'][0].as_py()}")
        return pa.table({"bin": group["bin"][:1], "bin_size": group["bin_size"][:1], "ids": pa.array([ids.astype(np.int32)], pa.list_(pa.int32())), "doc_ids": pa.array([group["id"].to_pylist()], pa.list_(group["id"].type)), "starts": pa.array([group["offset"].to_pylist()], pa.list_(pa.int32()))})

    kind = docs.schema[id_col].dataType.simpleString()
    return pieces.groupBy("bin").applyInArrow(assemble, f"bin long, bin_size long, ids array<int>, doc_ids array<{kind}>, starts array<int>")
