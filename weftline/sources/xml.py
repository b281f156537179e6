"""Sitemaps and feeds (RSS 2.0, RSS 1.0, Atom 1.0) from their bytes."""

from __future__ import annotations

import gzip
import io
import re
import zlib
from collections.abc import Callable, Iterator
from html import unescape
from urllib.parse import urldefrag, urlsplit
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..batches import OUT_ROWS, map_batches
from ..functions.text import py_clean_text
from ..functions.url import py_resolve
from ..html.body import plain_text

# Limits of sitemaps, name spaces.
GUNZIP_CAP, DEPTH, CHILDREN = 64 << 20, 3, 200
ATOM, DC, RDF, XML = "http://www.w3.org/2005/Atom", "http://purl.org/dc/elements/1.1/", "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/XML/1998/namespace"


class SourceFailure(ValueError):
    """A source that can't be read; discovery fails as a whole then."""


def gunzip(body: bytes) -> bytes:
    """The plain bytes of gzip data, told by its first bytes; others as they are."""
    if body[:2] != b"\x1f\x8b":
        return body
    try:
        with gzip.GzipFile(fileobj=io.BytesIO(body)) as f:
            out = f.read(GUNZIP_CAP + 1)
    except (OSError, EOFError, zlib.error) as e:
        raise SourceFailure(f"bad gzip data: {e}") from e
    if len(out) > GUNZIP_CAP:
        raise SourceFailure("gzip data is too large")
    return out


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _space(tag: str) -> str:
    return tag[1:].partition("}")[0] if tag.startswith("{") else ""


def _root(body: bytes | str) -> ElementTree.Element:
    """Lenient: bare ampersands and named HTML entities are repaired, text after the root is left out."""
    raw = body.encode() if isinstance(body, str) else body
    try:
        return ElementTree.fromstring(raw)
    except ElementTree.ParseError:
        text = raw.decode("utf-8", "replace").lstrip("﻿ \t\r\n")
        text = re.sub(r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);)([a-zA-Z][a-zA-Z0-9]*;)?", lambda m: (u if m[1] and (u := unescape(m[0])) != m[0] else "&amp;" + (m[1] or "")), text)
        text = re.sub(r"[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]", "", text)
        text = re.sub(r'(<\?xml[^>]*?)\s+encoding="[^"]*"', r"\1", text)
        try:
            return ElementTree.fromstring(text)
        except ElementTree.ParseError as e:
            raise SourceFailure(f"not XML: {e}") from e


def parse_sitemap(body: bytes) -> tuple[str, list[tuple[str, str]]]:
    """('urlset' or 'sitemapindex', [(loc, lastmod as written)])."""
    root = _root(gunzip(body))
    kind = _local(root.tag)
    if kind not in ("urlset", "sitemapindex"):
        raise SourceFailure(f"not a sitemap: <{kind}>")
    want = "url" if kind == "urlset" else "sitemap"
    out = []
    for n in root:
        if _local(n.tag) == want:
            parts = {_local(c.tag): c.text or "" for c in n}
            out.append((parts.get("loc", "").strip(), parts.get("lastmod", "")))
    return kind, out


def read_sitemaps(root_url: str, fetch: Callable[[str], tuple[bytes, str]]) -> list[tuple[str, dict[str, str]]]:
    """Candidates of a sitemap and those it refers to, depth first; ``fetch`` gives a body and the URL it came from in the end.

    Visited sitemaps are passed over; at most DEPTH levels, the first included, and
    CHILDREN references; fragments don't make a sitemap another one; children must stay on the root's host or the one it redirected to.
    """
    out: list[tuple[str, dict[str, str]]] = []
    visited: set[str] = set()
    hosts = {urlsplit(root_url).netloc.lower()}
    children = 0

    def visit(url: str, depth: int) -> None:
        nonlocal children
        url = urldefrag(url.strip()).url
        if url in visited:
            return
        visited.add(url)
        body, final = fetch(url)
        if depth == 1:
            hosts.add(urlsplit(final).netloc.lower())
        kind, entries = parse_sitemap(body)
        if kind == "urlset":
            out.extend((loc, {"lastmod": lastmod} if lastmod else {}) for loc, lastmod in entries)
            return
        if depth >= DEPTH:
            raise SourceFailure(f"sitemaps nest deeper than {DEPTH} levels")
        for loc, _ in entries:
            children += 1
            if children > CHILDREN:
                raise SourceFailure(f"more than {CHILDREN} child sitemaps")
            if urlsplit(loc).netloc.lower() not in hosts:
                raise SourceFailure(f"child sitemap {loc} is on another site")
            visit(loc, depth + 1)

    visit(root_url, 1)
    return out


def _text(n: ElementTree.Element | None) -> str:
    return "".join(n.itertext()) if n is not None else ""


def _child(n: ElementTree.Element, name: str, space: str | None = None) -> ElementTree.Element | None:
    return next((c for c in n if _local(c.tag) == name and (space is None or _space(c.tag) == space)), None)


def _plain(n: ElementTree.Element, name: str) -> str:
    """Text of a child without a name space, or that of RSS 1.0."""
    return next((_text(c) for c in n if _local(c.tag) == name and _space(c.tag) not in (ATOM, DC)), "")


def _atom_text(n: ElementTree.Element | None) -> str:
    if n is None:
        return ""
    kind = n.get("type", "text")
    if kind == "html":
        return plain_text(_text(n))
    if kind == "xhtml":
        return plain_text("".join(ElementTree.tostring(c, "unicode") for c in n) or _text(n))
    return _text(n)


def _hints(values: dict[str, str], categories: list[str]) -> dict[str, str]:
    out = {k: c for k, v in values.items() if (c := py_clean_text(v))}
    if cats := [c for v in categories if (c := py_clean_text(v))]:
        out["category"] = "\n".join(cats)
    return out


def parse_feed(body: bytes | str, base: str) -> list[tuple[str, dict[str, str]]]:
    """(url, hints) of the items of a feed; items without a link are left out."""
    root = _root(gunzip(body) if isinstance(body, bytes) else body)
    kind, out = _local(root.tag).lower(), []
    if kind == "feed":
        feed_base = py_resolve(base, root.get(f"{{{XML}}}base", "")) or base
        for e in root:
            if _local(e.tag) != "entry":
                continue
            entry_base = py_resolve(feed_base, e.get(f"{{{XML}}}base", "")) or feed_base
            link = next((c for c in e if _local(c.tag) == "link" and c.get("rel", "") in ("", "alternate") and c.get("href", "").strip()), None)
            if link is None:
                continue
            url = py_resolve(py_resolve(entry_base, link.get(f"{{{XML}}}base", "")) or entry_base, link.get("href", ""))
            author = _child(e, "author")
            published = _text(_child(e, "published")) or _text(_child(e, "updated"))
            values = {"title": _atom_text(_child(e, "title")), "description": _atom_text(_child(e, "summary")), "published": published, "updated": _text(_child(e, "updated")), "author": _text(_child(author, "name")) if author is not None else ""}
            out.append((url, _hints(values, [c.get("term", "") for c in e if _local(c.tag) == "category"])))
        return out
    if kind not in ("rss", "rdf"):
        raise SourceFailure(f"not a feed: <{_local(root.tag)}>")
    for item in root.iter():
        if _local(item.tag) != "item":
            continue
        url = next((t for c in item if _local(c.tag) == "link" and _space(c.tag) != ATOM and (t := _text(c).strip())), "")
        guid = _child(item, "guid")
        if not url and guid is not None and guid.get("isPermaLink") != "false":
            url = _text(guid).strip()
        if not url:
            continue
        values = {
            "title": _plain(item, "title"), "description": plain_text(_plain(item, "description")), "published": _plain(item, "pubDate") or _text(_child(item, "date", DC)),
            "updated": _text(_child(item, "updated", ATOM)), "author": _text(_child(item, "creator", DC)) or _plain(item, "author"),
        }
        out.append((py_resolve(base, url), _hints(values, [_text(c) for c in item if _local(c.tag) == "category" and _space(c.tag) != ATOM])))
    return out


def _candidates(df: DataFrame, url: str, body: str, parse: Callable[[bytes, str], list[tuple[str, dict[str, str]]]], keep: tuple[str, ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a body at a time
                found = parse(batch.column(1)[i].as_py() or b"", batch.column(0)[i].as_py() or "")
                for at in range(0, len(found), OUT_ROWS):
                    part = found[at : at + OUT_ROWS]
                    kept = batch.select(list(keep)).take(pa.array([i] * len(part), pa.int64())).columns if keep else []
                    made = [pa.array([u for u, _ in part], pa.string()), pa.array([list(h.items()) for _, h in part], pa.map_(pa.string(), pa.string())), pa.array(range(at, at + len(part)), pa.int32())]
                    yield pa.RecordBatch.from_arrays([*kept, *made], names=[*keep, "url", "hints", "pos"])

    types = dict(df.dtypes)
    slim = df.select(F.col(url).alias("_u"), F.col(body).cast("binary").alias("_b"), *keep)
    return map_batches(slim, run, "".join(f"`{c}` {types[c]}, " for c in keep) + "url string, hints map<string,string>, pos int")


def sitemap_candidates(df: DataFrame, url: str = "url", body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """(url, hints, pos) of urlset bodies, plain or gzip; a body that is no sitemap fails the query."""
    return _candidates(df, url, body, lambda b, _: [(loc, {"lastmod": m} if m else {}) for loc, m in parse_sitemap(b)[1]], keep)


def feed_candidates(df: DataFrame, url: str = "url", body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """(url, hints, pos) of feed bodies; a body that is no feed fails the query."""
    return _candidates(df, url, body, parse_feed, keep)
