"""Text columns of the stored entities: lists, JSON, identity keys, search, keyword routing, upload bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

#: The first bytes of accepted uploads, in hexadecimal, and the size limit.
MAGIC = ["FFD8FF", "89504E470D0A1A0A", "52494646", "424D", "49492A00", "4D4D002A"]
MAX_UPLOAD = 12 * 1024 * 1024


def decode_list(value: Column) -> Column:
    """A comma-joined list; empty for an empty text, null for null."""
    return F.when(value == "", F.array().cast("array<string>")).otherwise(F.split(value, ","))


def decode_json(value: Column, schema: DataType | str) -> Column:
    return F.from_json(value, schema)


def identity_key(email: Column, phone: Column, provider: Column, credential: Column) -> Column:
    """E-mail trimmed and lower-cased; else the digits of the phone; else 20 hex digits of a hash."""
    hashed = F.substring(F.sha2(F.concat_ws(":", provider, credential), 256), 1, 20)
    return F.when(F.length(F.trim(email)) > 0, F.lower(F.trim(email))).when(F.length(phone) > 0, F.regexp_replace(phone, r"\D", "")).otherwise(hashed)


def matches_search(query: str, *columns: Column) -> Column:
    """Whether any column contains the query, trimmed and without regard to case; an empty query matches all."""
    wanted = query.strip().lower()
    if not wanted:
        return F.lit(True)
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(wanted)), F.lit(False))
    return hit


def route_keyword(text: Column, keys: list[str], fallback: str = "fallback") -> Column:
    """The first key that the lower-cased text contains, in the order given."""
    out = None
    for k in keys:
        hit = F.contains(F.lower(text), F.lit(k))
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return F.lit(fallback) if out is None else out.otherwise(fallback)


def upload_verdict(content: Column, max_bytes: int = MAX_UPLOAD) -> Column:
    """`ok`, `empty`, `too_large` or `unsupported` for uploaded bytes."""
    head = F.hex(F.substring(content, 1, 8))
    known = F.lit(False)
    for m in MAGIC:
        known = known | head.startswith(m)
    size = F.octet_length(content)
    return F.when(content.isNull() | (size == 0), "empty").when(size > max_bytes, "too_large").when(~known, "unsupported").otherwise("ok")
