"""Signed tokens of three parts (JSON web tokens, HS256) as columns: JVM-side hashes only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64  # bytes of a block of SHA-256


def pads(key: str) -> tuple[bytes, bytes]:
    """The inner and the outer pad of HMAC-SHA256 for a key."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > BLOCK else raw).ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in raw), bytes(b ^ 0x5C for b in raw)


def hmac_sha256(message: Column, key: str) -> Column:
    """Binary HMAC of a string's UTF-8 bytes; null for null."""
    inner, outer = pads(key)
    once = F.unhex(F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256))
    return F.unhex(F.sha2(F.concat(F.lit(outer), once), 256))


def to_url64(raw: Column) -> Column:
    return F.translate(F.base64(raw), "+/=\r\n", "-_")


def from_url64(c: Column) -> Column:
    """Text of base64 in the alphabet for addresses, without padding; null where it is not that."""
    padded = F.concat(F.translate(c, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(c), F.lit(4))))
    return F.try_to_binary(padded, F.lit("base64")).cast("string")


def sign(payload: Column, key: str) -> Column:
    """The token of a JSON payload."""
    head = F.lit('{"alg":"HS256","typ":"JWT"}').cast("binary")
    body = F.concat_ws(".", to_url64(head), to_url64(payload.cast("binary")))
    return F.when(payload.isNotNull(), F.concat_ws(".", body, to_url64(hmac_sha256(body, key))))


def claims(token: Column, key: str, now: Column) -> Column:
    """The JSON payload of a token that is signed by HS256 with the key and has not expired at `now` (seconds; a token without `exp`
    does not expire); null for any other. Signatures are compared by their digests, so the time taken tells nothing of them."""
    parts = F.split(token, r"\.", -1)
    head, body, mark = (F.get(parts, F.lit(k)) for k in range(3))
    due = to_url64(hmac_sha256(F.concat_ws(".", head, body), key))
    payload = from_url64(body)
    good = (F.size(parts) == 3) & (F.sha2(mark.cast("binary"), 256) == F.sha2(due.cast("binary"), 256)) & (F.get_json_object(from_url64(head), "$.alg") == "HS256")
    ends = F.get_json_object(payload, "$.exp").try_cast("double")
    asks = F.get_json_object(payload, "$.exp").isNotNull()
    return F.when(good & (~asks | (ends > now)), payload)
