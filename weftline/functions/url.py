"""URL expressions."""

from __future__ import annotations

import mimetypes
import re
from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "avif": "image/avif", "svg": "image/svg+xml"}
ABSOLUTE = r"^https?://[^/?#\s]+"


def is_absolute(c: Column) -> Column:
    """http(s) with a host."""
    return F.coalesce(c.rlike("(?i)" + ABSOLUTE) & F.try_parse_url(c, F.lit("HOST")).isNotNull(), F.lit(False))


def clean_url(c: Column) -> Column:
    """Trimmed, without fragment; null unless absolute http(s)."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), "#.*$", "")
    return F.when(is_absolute(bare), bare)


def host(c: Column) -> Column:
    """Lower-case host name without port."""
    return F.lower(F.try_parse_url(c, F.lit("HOST")))


def authority(c: Column) -> Column:
    """Lower-case host with its port, without user."""
    return F.lower(F.regexp_replace(F.try_parse_url(c, F.lit("AUTHORITY")), "^[^@]*@", ""))


def same_site(c: Column, hosts: list[str]) -> Column:
    return F.coalesce(authority(c).isin([h.lower() for h in hosts]), F.lit(False))


def accept(c: Column, include: list[str], exclude: list[str]) -> Column:
    """No exclude pattern matches, and an include pattern does if there are any. Unanchored."""
    keep = F.lit(True)
    for p in exclude:
        keep &= ~c.rlike(p)
    if include:
        some = F.lit(False)
        for p in include:
            some |= c.rlike(p)
        keep &= some
    return keep


def url_match(c: Column, pattern: str) -> Column:
    """The whole match, or its non-empty groups joined by '-'; null without a match."""
    groups = re.compile(pattern).groups
    if not groups:
        out = F.regexp_extract(c, pattern, 0)
    else:
        out = F.concat_ws("-", *[F.nullif(F.regexp_extract(c, pattern, i + 1), F.lit("")) for i in range(groups)])
    return F.when(c.rlike(pattern), F.nullif(out, F.lit("")))


def image_type(c: Column) -> Column:
    """MIME type by the extension of a URL, image/jpeg if unknown."""
    ext = F.lower(F.regexp_extract(F.regexp_replace(c, "[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1))
    out = F.lit("image/jpeg")
    for e, kind in IMAGE_TYPES.items():
        out = F.when(ext == e, F.lit(kind)).otherwise(out)
    return out


def feed_path(site: Column, extension: str) -> Column:
    return F.concat(F.lit("feeds/"), site, F.lit(extension))


def py_resolve(base: str, ref: str) -> str:
    """``ref`` against ``base``; '' if it can't be read."""
    try:
        out = urljoin(base, ref.strip())
        urlsplit(out)
        return out
    except ValueError:
        return ""


def py_absolute(base: str, ref: str) -> str:
    out = py_resolve(base, ref)
    try:
        parts = urlsplit(out)
    except ValueError:
        return ""
    return out if parts.scheme in ("http", "https") and parts.netloc else ""


def py_image_type(url: str) -> str:
    return mimetypes.guess_type(re.sub("[?#].*", "", url))[0] or "image/jpeg"
