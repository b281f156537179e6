"""A parsed page: meta map, JSON-LD objects, and the values of configured sources."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

from ..functions.text import py_clean_text, py_strip_invisible
from ..functions.url import py_absolute, py_resolve
from ..plans.config import Source
from . import jsonld
from .css import Selector, compile_selector
from .tree import Node, parse
from .write import inner


class Page:
    def __init__(self, html: str | None, url: str, hints: Mapping[str, str] | None = None):
        self.root, self.url, self.hints = parse(html), url, hints or {}
        self.objects, self.warnings = jsonld.objects(self.root)
        self.base = url
        self.meta: dict[str, str] = {}
        based = False
        for n in self.root.elements():
            if n.tag == "base" and "href" in n.attrs and not based:
                based = True
                self.base = py_resolve(url, n.attrs["href"]) or url
            elif n.tag == "meta" and n.get("content").strip():
                for key in ("property", "name", "itemprop"):
                    if name := n.get(key).strip().lower():
                        self.meta.setdefault(name, n.attrs["content"])

    def raw(self, s: Source) -> Iterator[list[str]]:
        """Lists of values of a source; a JSON-LD source gives one list for each object that has any."""
        if s.kind == "jsonld":
            for obj in self.objects:
                if jsonld.has_type(obj, s.path[0]) and (got := list(jsonld.path(obj, list(s.path[1:])))):
                    yield got
        elif s.kind == "meta":
            if (v := self.meta.get(s.expr.strip().lower())) is not None:
                yield [v]
        elif s.kind in ("css", "time"):
            out = []
            for n in compile_selector(s.expr).select(self.root):
                v = n.attrs.get(s.attr) if s.attr else n.content()
                if v is None and s.kind == "time":
                    v = n.content()
                if v is not None and v.strip():
                    out.append(v)
            if out:
                yield out
        elif s.kind == "url":
            if m := re.search(s.expr, self.url):
                v = "-".join(g for g in m.groups() if g) if m.re.groups else m[0]
                if v:
                    yield [v]
        elif s.kind == "listing":
            if v := self.hints.get(s.expr, ""):
                yield [x for x in v.split("\n") if x.strip()] if s.expr == "category" else [v]
        elif s.kind == "request":
            yield [self.url]

    def values(self, sources: tuple[Source, ...], is_url: bool = False) -> tuple[list[str], str]:
        """Values of the first source that has any, and that source."""
        clean = (lambda v: py_absolute(self.base, py_strip_invisible(v))) if is_url else py_clean_text
        for s in sources:
            for got in self.raw(s):
                if out := [c for v in got if (c := clean(v))]:
                    return out, s.raw
                if s.kind == "jsonld":
                    break
        return [], ""

    def date_values(self, sources: tuple[Source, ...]) -> list[tuple[str, str]]:
        """(value, source) of all sources in the order they are tried."""
        return [(v, s.raw) for s in sources for got in self.raw(s) for v in got]

    def content(self, selector: str, exclude: tuple[str, ...]) -> tuple[str, int]:
        """Trimmed inner HTML of the outermost matches without the excluded, by lines, and how many were kept."""
        kept = []
        drop = [compile_selector(x) for x in exclude]
        for n in compile_selector(selector).outermost(self.root):
            for d in drop:
                for x in d.select(n):
                    x.remove()
            if n.content().strip() or any(x.tag in ("img", "video", "iframe") for x in n.elements()):
                kept.append(inner(n).strip())
        return "\n".join(kept), len(kept)


def links(html: str | None, url: str, link_selector: Selector, next_selector: Selector | None = None) -> tuple[list[tuple[str, str]], str]:
    """(url, title hint) of the matches on a listing page, and the next page's URL or ''."""
    page = Page(html, url)
    out = []
    for n in link_selector.select(page.root):
        href = n.attrs.get("href")
        if href is None:
            first = next((x for x in n.elements() if x.tag == "a" and "href" in x.attrs), None)
            href = first.attrs["href"] if first is not None else None
        if href is not None:
            out.append((py_resolve(page.base, href), py_clean_text(n.content())))
    nxt = next_selector.first(page.root) if next_selector else None
    if nxt is not None and "href" not in nxt.attrs:
        nxt = next((x for x in nxt.elements() if x.tag == "a" and "href" in x.attrs), None)
    return out, py_resolve(page.base, nxt.attrs["href"]) if nxt is not None else ""


def element_text(n: Node) -> str:
    return py_clean_text(n.content())
