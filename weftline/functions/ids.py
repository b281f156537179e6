"""Digests and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: UUID name space of URLs (RFC 9562).
URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"


def _joined(*cols: Column) -> Column:
    """Values with a NUL between them."""
    parts: list[Column] = []
    for c in cols:
        parts += [F.coalesce(c, F.lit("")), F.lit("\x00")]
    return F.concat(*parts[:-1])


def content_hash(title: Column, summary: Column, body: Column) -> Column:
    return F.sha2(_joined(title, summary, body), 256)


def hints_hash(fields: dict[str, Column]) -> Column:
    """32 hex digits over the sorted listing fields a configuration reads."""
    parts = [F.concat(F.lit(k), F.lit("\x00"), F.coalesce(v, F.lit("")), F.lit("\x00")) for k, v in sorted(fields.items())]
    return F.left(F.sha2(F.concat(*parts) if parts else F.lit(""), 256), F.lit(32))


def uuid5_url(url: Column) -> Column:
    """Version-5 UUID of a URL."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_SPACE)), url.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def guid(mode: str, canonical: Column, url: Column) -> Column:
    """The canonical URL for permalink sites, else the UUID of the discovered one."""
    return canonical if mode == "permalink" else uuid5_url(url)


def atom_id(guid_: Column, permalink: Column) -> Column:
    return F.when(permalink, guid_).otherwise(F.concat(F.lit("urn:uuid:"), guid_))


def etag(body: Column) -> Column:
    return F.concat(F.lit('"'), F.left(F.sha2(body, 256), F.lit(32)), F.lit('"'))


def headers_key(headers: dict[str, str]) -> str:
    """16 hex digits over sorted headers, '' for none: one robots cache for each set."""
    import hashlib

    if not headers:
        return ""
    return hashlib.sha256("".join(f"{k.lower()}\x00{headers[k]}\x00" for k in sorted(headers, key=str.lower)).encode()).hexdigest()[:16]
