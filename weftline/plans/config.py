"""Site and global configuration: strict YAML with positions, all errors collected, sources compiled."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from pathlib import Path
from typing import Any, NamedTuple
from urllib.parse import urlsplit
from zoneinfo import ZoneInfo

import yaml

from ..functions.dates import LayoutError, compile_layout, parse_duration, parse_rate
from ..html.css import SelectorError, compile_selector

# The listing fields and which strategy supplies them; default canonical sources.
LISTING_FIELDS = ("published", "updated", "title", "description", "author", "category", "lastmod")
SUPPLIES = {"feed": ("published", "updated", "title", "description", "author", "category"), "sitemap": ("lastmod",), "index": ("title",), "links": ()}
CANONICAL = ("meta:og:url", "css:link[rel=canonical]@href", "request")
OWN_HEADERS = frozenset("host user-agent accept-encoding if-none-match if-modified-since connection content-length transfer-encoding".split())
_ATTR = re.compile(r"@([A-Za-z_:][-A-Za-z0-9_:.]*)$")


class SourceError(ValueError):
    pass


@dataclass(frozen=True)
class Source:
    """One compiled source of a field, ``kind:expr[@attr]``."""

    raw: str
    kind: str
    expr: str = ""
    attr: str = ""
    path: tuple[str, ...] = ()


# Readers turn a raw value into its compiled form, or raise ValueError with what is amiss.


def _regex(raw: str) -> str:
    try:
        re.compile(raw)
    except re.error as e:
        raise ValueError(f"the pattern doesn't compile: {e}") from e
    return raw


def _selector(raw: str) -> str:
    try:
        compile_selector(raw)
    except SelectorError as e:
        raise ValueError(f"the selector doesn't parse: {e}") from e
    return raw


def _layout(raw: str) -> str:
    try:
        compile_layout(raw)
    except LayoutError as e:
        raise ValueError(str(e)) from e
    return raw


def _url(raw: str) -> str:
    parts = urlsplit(raw)
    if parts.scheme not in ("http", "https") or not parts.netloc:
        raise ValueError(f"{raw!r} has no http(s) scheme and host")
    return raw


def _matching(pattern: str, what: str) -> Callable[[str], str]:
    def read(raw: str) -> str:
        if not re.fullmatch(pattern, raw):
            raise ValueError(f"{raw!r} is not {what}")
        return raw

    return read


def _any_of(*names: str) -> Callable[[str], str]:
    return _matching("|".join(map(re.escape, names)), f"one of {', '.join(names)}")


def _from(least: int) -> Callable[[int], int]:
    def read(n: int) -> int:
        if n < least:
            raise ValueError(f"{n} is below {least}")
        return n

    return read


def _zone(raw: str) -> str:
    try:
        ZoneInfo(raw)
    except (KeyError, ValueError, OSError) as e:
        raise ValueError(f"no time zone goes by {raw!r}") from e
    return raw


def _steps(expr: str) -> Source:
    path = tuple(expr.split("."))
    if len(path) < 2 or not all(path):
        raise ValueError("a type and its properties are needed, parted by single dots")
    return Source("", "jsonld", expr, path=path)


def _element(kind: str, attr: str) -> Callable[[str], Source]:
    def read(expr: str) -> Source:
        at = _ATTR.search(expr)
        return Source("", kind, _selector(expr[: at.start()].strip() if at else expr), at[1] if at else attr)

    return read


#: How each kind of source reads what follows its colon.
READERS: dict[str, Callable[[str], Source]] = {
    "jsonld": _steps,
    "meta": lambda expr: Source("", "meta", expr),
    "css": _element("css", ""),
    "time": _element("time", "datetime"),
    "url": lambda expr: Source("", "url", _regex(expr)),
    "listing": lambda expr: Source("", "listing", _any_of(*LISTING_FIELDS)(expr)),
}


def compile_source(raw: str) -> Source:
    """The source that a text names; SourceError says why it names none."""
    kind, _, expr = (part.strip() for part in raw.strip().partition(":"))
    if raw.strip() == "request":
        return Source(raw, "request")
    try:
        if kind not in READERS:
            raise ValueError(f"{kind!r} is no kind of source with an expression ({', '.join(READERS)})")
        if not expr:
            raise ValueError(f"{kind} needs an expression")
        return replace(READERS[kind](expr), raw=raw)
    except ValueError as e:
        raise SourceError(f"{raw!r}: {e}") from e


@dataclass(frozen=True)
class Discovery:
    type: str
    url: str = ""
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    trust_lastmod: bool = False
    link_selector: str = ""
    next_selector: str = ""
    max_pages: int = 5
    urls: tuple[str, ...] = ()


@dataclass(frozen=True)
class DateField:
    sources: tuple[Source, ...] = ()
    layouts: tuple[str, ...] = ()


@dataclass(frozen=True)
class ItemConfig:
    canonical: tuple[Source, ...] = tuple(compile_source(s) for s in CANONICAL)
    title: tuple[Source, ...] = ()
    summary: tuple[Source, ...] = ()
    author: tuple[Source, ...] = ()
    image: tuple[Source, ...] = ()
    categories: tuple[Source, ...] = ()
    published: DateField = DateField()
    updated: DateField = DateField()
    selector: str = "article"
    exclude: tuple[str, ...] = ()
    keep_first_image: bool = True
    keep_video: bool = False
    guid: str = "permalink"
    enclosure: bool = False

    def listing_fields(self) -> list[str]:
        """The listing hints that some field reads, sorted."""
        every = [*self.canonical, *self.title, *self.summary, *self.author, *self.image, *self.categories, *self.published.sources, *self.updated.sources]
        return sorted({s.expr for s in every if s.kind == "listing"})


@dataclass(frozen=True)
class Site:
    id: str
    title: str = ""
    link: str = ""
    description: str = ""
    language: str = ""
    image: str = ""
    author: str = ""
    ttl: int = 0
    interval: float = 3600.0
    refresh_window: float = 14 * 86400.0
    max_items: int = 50
    timezone: str = "UTC"
    rate: float = 1.0
    timeout: float = 20.0
    headers: tuple[tuple[str, str], ...] = ()
    header_hosts: tuple[str, ...] = ()
    respect_robots: bool = True
    discovery: tuple[Discovery, ...] = ()
    item: ItemConfig = ItemConfig()

    @property
    def trust_lastmod(self) -> bool:
        return any(d.trust_lastmod for d in self.discovery)

    def hosts(self) -> list[str]:
        """Host[:port] of the discovery URLs, and those that headers also go to."""
        urls = [u for d in self.discovery for u in (d.url, *d.urls) if u]
        return list(dict.fromkeys([*(urlsplit(u).netloc.lower() for u in urls), *self.header_hosts]))


@dataclass(frozen=True)
class Global:
    sites_dir: str = "sites"
    store_path: str = "state"
    out_dir: str = "public"
    listen: str = ":8080"
    public_base_url: str = ""
    base_path: str = "/"
    contact_url: str = ""
    user_agent: str = ""
    log_format: str = "json"
    log_level: str = "info"
    rate: float = 1.0
    timeout: float = 20.0
    max_body_bytes: int = 10 << 20
    allow_private: bool = False


@dataclass(frozen=True, order=True)
class ConfigError:
    file: str
    line: int
    path: str
    message: str

    def __str__(self) -> str:
        return f"{self.file}:{self.line}: {self.path}: {self.message}" if self.path else f"{self.file}:{self.line}: {self.message}"


SITE_KEYS: dict[str, Any] = {
    "id": str, "version": int,
    "channel": {"title": str, "link": str, "description": str, "language": str, "image": str, "author": str, "ttl": int},
    "schedule": {"interval": str, "refresh_window": str, "max_items": int, "timezone": str},
    "fetch": {"rate": str, "timeout": str, "headers": "map", "respect_robots": bool, "header_hosts": [str]},
    "discovery": [{"type": str, "url": str, "include": [str], "exclude": [str], "trust_lastmod": bool, "link_selector": str, "next_selector": str, "max_pages": int, "urls": [str]}],
    "item": {
        **{k: [str] for k in ("canonical", "title", "summary", "author", "image", "categories")},
        **{k: {"sources": [str], "layouts": [str]} for k in ("published", "updated")},
        "content": {"selector": str, "exclude": [str], "keep_first_image": bool, "keep_video": bool}, "guid": str, "enclosure": bool,
    },
}
GLOBAL_KEYS: dict[str, Any] = {
    "sites_dir": str, "store_path": str, "out_dir": str, "listen": str, "public_base_url": str, "base_path": str, "contact_url": str, "user_agent": str,
    "log": {"format": str, "level": str}, "fetch": {"rate": str, "timeout": str, "max_body_bytes": int, "allow_private": bool},
}


class Document:
    """A YAML document checked against a table of keys; remembers the line of every path."""

    def __init__(self, file: str, text: str, keys: dict[str, Any]):
        self.file, self.errors, self.lines = file, [], {}
        self.data: dict[str, Any] = {}
        try:
            documents = list(yaml.compose_all(text, yaml.SafeLoader))
        except yaml.YAMLError as e:
            mark = getattr(e, "problem_mark", None)
            self.error_at(mark.line + 1 if mark else 1, "", f"is no YAML: {getattr(e, 'problem', e)}")
            return
        if not documents or documents[0] is None:
            self.error_at(1, "", "holds no document")
            return
        if len(documents) > 1:
            self.error_at(documents[1].start_mark.line + 1 if documents[1] is not None else 1, "", "holds a second document")
        got = self._read(documents[0], keys, "")
        self.data = got if isinstance(got, dict) else {}

    def error_at(self, line: int, path: str, message: str) -> None:
        self.errors.append(ConfigError(self.file, line, path, message))

    def error(self, path: str, message: str) -> None:
        """At the line of the path, or of its nearest ancestor that is there."""
        at = path
        while at not in self.lines and at:
            at = re.sub(r"(?:\.?[^.\[\]]+|\[\d+\])$", "", at)
        self.error_at(self.lines.get(at, 1), path, message)

    def _read(self, node: yaml.Node, want: Any, path: str) -> Any:
        line = node.start_mark.line + 1
        self.lines.setdefault(path, line)
        if isinstance(want, dict) or want == "map":
            if not isinstance(node, yaml.MappingNode):
                self.error_at(line, path, "should be a mapping")
                return None
            out = {}
            for k, v in node.value:
                own = f"{path}.{k.value}" if path else k.value
                self.lines[own] = k.start_mark.line + 1
                if want == "map":
                    out[k.value] = v.value
                elif k.value not in want:
                    self.error_at(k.start_mark.line + 1, path, f"{k.value!r} is not a key here")
                elif k.value in out:
                    self.error_at(k.start_mark.line + 1, own, "stands twice")
                else:
                    out[k.value] = self._read(v, want[k.value], own)
            return out
        if isinstance(want, list):
            if not isinstance(node, yaml.SequenceNode):
                self.error_at(line, path, "should be a list")
                return None
            return [self._read(v, want[0], f"{path}[{i}]") for i, v in enumerate(node.value)]
        if not isinstance(node, yaml.ScalarNode):
            self.error_at(line, path, "should be a single value")
            return None
        if node.tag == "tag:yaml.org,2002:null":
            return None
        if want is str:
            return node.value
        value = yaml.SafeLoader("").construct_object(yaml.ScalarNode(node.tag, node.value)) if want in (int, bool) else node.value
        if type(value) is not want:
            self.error_at(line, path, f"{node.value!r} is neither true nor false" if want is bool else f"{node.value!r} is not a whole number")
            return None
        return value

    def get(self, path: str, default: Any = None) -> Any:
        v: Any = self.data
        for key in re.findall(r"[^.\[\]]+", path):
            v = v.get(key) if isinstance(v, dict) else v[int(key)] if isinstance(v, list) else None
        return default if v is None or v == "" else v

    def attempt(self, path: str, read: Callable[[Any], Any], raw: Any, default: Any = None) -> Any:
        try:
            return read(raw)
        except ValueError as e:
            self.error(path, str(e))
            return default

    def value_of(self, f: Field, at: str = "") -> Any:
        """The value that a field has below ``at``: read, or its default."""
        path = f"{at}.{f.path}" if at else f.path
        raw = self.get(path)
        if raw in (None, [], {}):
            if f.needed:
                self.error(path, "is missing")
            return f.default
        if not f.each:
            return self.attempt(path, f.read, raw, f.default)
        read = [self.attempt(f"{path}[{i}]", f.read, v or "") for i, v in enumerate(raw)]
        return tuple(v for v in read if v is not None) or f.default


class Field(NamedTuple):
    """One key: how it is read (each value of it, if it is a list), what stands for it if it is absent, and whether it may be."""

    path: str
    read: Callable[[Any], Any] = lambda v: v
    default: Any = ""
    needed: bool = False
    each: bool = False


def _list(path: str, read: Callable[[str], Any] = lambda v: v, needed: bool = False, default: Any = ()) -> Field:
    return Field(path, read, default, needed, True)


#: Fields of Site by attribute.
SITE_FIELDS = {
    "id": Field("id", _matching("[a-z0-9-]+", "made of lower-case letters, digits and hyphens"), needed=True),
    "title": Field("channel.title", needed=True), "link": Field("channel.link", _url, needed=True), "description": Field("channel.description", needed=True),
    "language": Field("channel.language"), "image": Field("channel.image", _url), "author": Field("channel.author"), "ttl": Field("channel.ttl", _from(0), 0),
    "interval": Field("schedule.interval", parse_duration, 3600.0), "refresh_window": Field("schedule.refresh_window", parse_duration, 14 * 86400.0),
    "max_items": Field("schedule.max_items", lambda n: _from(0)(n) or 50, 50), "timezone": Field("schedule.timezone", _zone, "UTC"),
    "rate": Field("fetch.rate", parse_rate, None), "timeout": Field("fetch.timeout", parse_duration, None), "respect_robots": Field("fetch.respect_robots", default=True),
    "header_hosts": _list("fetch.header_hosts", _matching(r"(?:[A-Za-z0-9_.-]+|\[[0-9a-fA-F:]+\])(?::\d+)?", "a host with or without a port")),
}
ITEM_FIELDS = {
    "canonical": _list("item.canonical", compile_source, default=ItemConfig.canonical), "title": _list("item.title", compile_source, needed=True),
    **{k: _list(f"item.{k}", compile_source) for k in ("summary", "author", "image", "categories")},
    "selector": Field("item.content.selector", _selector, "article", True), "exclude": _list("item.content.exclude", _selector),
    "keep_first_image": Field("item.content.keep_first_image", default=True), "keep_video": Field("item.content.keep_video", default=False),
    "guid": Field("item.guid", _any_of("permalink", "stable-hash"), "permalink"), "enclosure": Field("item.enclosure", default=False),
}
DATE_FIELDS = {"sources": _list("sources", compile_source), "layouts": _list("layouts", _layout)}
_FILTERS = {"include": _list("include", _regex), "exclude": _list("exclude", _regex)}
_ADDRESS = {"url": Field("url", _url, needed=True)}
#: The keys that each way of discovery knows.
DISCOVERY_FIELDS = {
    "feed": _ADDRESS | _FILTERS,
    "sitemap": _ADDRESS | _FILTERS | {"trust_lastmod": Field("trust_lastmod", default=False)},
    "index": _ADDRESS | _FILTERS | {"link_selector": Field("link_selector", _selector, needed=True), "next_selector": Field("next_selector", _selector), "max_pages": Field("max_pages", lambda n: _from(0)(n) or 5, 5)},
    "links": _FILTERS | {"urls": _list("urls", _url, needed=True)},
}
GLOBAL_FIELDS = {
    "sites_dir": Field("sites_dir", default="sites"), "store_path": Field("store_path", default="state"), "out_dir": Field("out_dir", default="public"),
    "listen": Field("listen", _matching(r"[^:]*:\d+|\[[^\]]*\]:\d+", "a port with or without a host, parted by a colon"), ":8080"),
    "contact_url": Field("contact_url", _url), "user_agent": Field("user_agent"), "log_format": Field("log.format", _any_of("json", "text"), "json"),
    "log_level": Field("log.level", _any_of("debug", "info", "warn", "error"), "info"), "rate": Field("fetch.rate", parse_rate, 1.0), "timeout": Field("fetch.timeout", parse_duration, 20.0),
    "max_body_bytes": Field("fetch.max_body_bytes", lambda n: _from(0)(n) or 10 << 20, 10 << 20), "allow_private": Field("fetch.allow_private", default=False),
}


def _discoveries(doc: Document) -> Iterator[Discovery]:
    entries = doc.get("discovery", [])
    if not entries:
        doc.error("discovery", "names no way to find pages")
    for i, entry in enumerate(entries):
        at, kind = f"discovery[{i}]", (entry or {}).get("type") or ""
        if kind not in DISCOVERY_FIELDS:
            doc.error(f"{at}.type", f"{kind!r} is not one of {', '.join(DISCOVERY_FIELDS)}")
            continue
        known = DISCOVERY_FIELDS[kind]
        for key in entry.keys() - known.keys() - {"type"}:
            if entry[key]:
                doc.error(f"{at}.{key}", f"has no meaning for {kind} discovery")
        yield Discovery(kind, **{name: doc.value_of(f, at) for name, f in known.items()})


def _headers(doc: Document) -> Iterator[tuple[str, str]]:
    for name, value in sorted(doc.get("fetch.headers", {}).items()):
        why = (
            "is no header name" if not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name)
            else "is left to the fetcher" if name.lower() in OWN_HEADERS
            else "has control characters in its value" if re.search(r"[\x00-\x08\x0a-\x1f\x7f]", value)
            else ""
        )
        if why:
            doc.error(f"fetch.headers.{name}", why)
        yield name, value


def _across(doc: Document, site: Site, file: str) -> None:
    """What can only be told from several keys."""
    if re.fullmatch("[a-z0-9-]+", site.id) and re.sub(r"\.ya?ml$", "", Path(file).name) != site.id:
        doc.error("id", f"{site.id!r} differs from the file's name, {Path(file).name}")
    if doc.get("version") != 1:
        doc.error("version", "must be 1, the schema that this engine reads")
    supplied = {hint for d in site.discovery for hint in SUPPLIES[d.type]}
    used = [(f"item.{k}", v) for k, v in vars(site.item).items() if isinstance(v, tuple)] + [(f"item.{k}.sources", getattr(site.item, k).sources) for k in ("published", "updated")]
    for path, found in used:
        for s in found:
            if isinstance(s, Source) and s.kind == "listing" and s.expr not in supplied:
                doc.error(f"{path}[{doc.get(path).index(s.raw)}]", f"no way of discovery gives {s.raw}")
    for name in ("published", "updated"):
        if doc.get(f"item.{name}.layouts") and not doc.get(f"item.{name}.sources"):
            doc.error(f"item.{name}.layouts", "are of no use without sources")


def load_site(text: str, file: str = "site.yaml", defaults: Global | None = None) -> tuple[Site | None, list[ConfigError]]:
    """A site and its errors by line; the site is None if there are any."""
    doc = Document(file, text, SITE_KEYS)
    if not doc.data:
        return None, doc.errors
    g = defaults or Global()
    own = {name: doc.value_of(f) for name, f in SITE_FIELDS.items()}
    own |= {name: getattr(g, name) for name in ("rate", "timeout") if own[name] is None}
    dated = {k: DateField(**{name: doc.value_of(f, f"item.{k}") for name, f in DATE_FIELDS.items()}) for k in ("published", "updated")}
    item = ItemConfig(**{name: doc.value_of(f) for name, f in ITEM_FIELDS.items()}, **dated)
    site = Site(**own, headers=tuple(_headers(doc)), discovery=tuple(_discoveries(doc)), item=item)
    _across(doc, site, file)
    errors = sorted(doc.errors, key=lambda e: e.line)
    return (None if errors else site), errors


def load_global(text: str, file: str = "global.yaml", environment: dict[str, str] | None = None) -> tuple[Global | None, list[ConfigError]]:
    """The engine's own file; folders are relative to it, and the environment may name the public address."""
    doc = Document(file, text, GLOBAL_KEYS)
    if not doc.data and doc.errors:
        return None, doc.errors
    env = os.environ if environment is None else environment
    public = env.get("WEFTLINE_PUBLIC_BASE_URL") or doc.get("public_base_url", "")
    own = {name: doc.value_of(f) for name, f in GLOBAL_FIELDS.items()}
    own |= {name: str(Path(file).parent / own[name]) for name in ("sites_dir", "store_path", "out_dir")}
    own["public_base_url"] = doc.attempt("public_base_url", lambda v: _url(v.rstrip("/")), public, "")
    own["base_path"] = doc.attempt("base_path", _matching(r"/(?:(?!\.{1,2}/)[A-Za-z0-9._~-]+/)*", "a path of plain segments from /"), doc.get("base_path", "/").rstrip("/") + "/", "/")
    errors = sorted(doc.errors, key=lambda e: e.line)
    return (None if errors else Global(**own)), errors


def load(path: str) -> tuple[Global | None, list[Site], list[ConfigError]]:
    """The global file and every site file of its folder, sorted by name, with all errors."""
    g, errors = load_global(Path(path).read_text(), path)
    sites = []
    folder = Path(g.sites_dir if g else Path(path).parent / "sites")
    for file in sorted([*folder.glob("*.yaml"), *folder.glob("*.yml")]):
        site, more = load_site(file.read_text(), str(file), g)
        errors = [*errors, *more]
        if site:
            sites.append(site)
    return g, sites, errors


def lint(files: list[str], global_file: str | None = None) -> list[ConfigError]:
    """Errors of the named site files, or of the whole configuration if none is named."""
    if not files:
        return load(global_file)[2]
    g = load_global(Path(global_file).read_text(), global_file)[0] if global_file else None
    return [e for f in files for e in load_site(Path(f).read_text(), f, g)[1]]
