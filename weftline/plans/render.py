"""Feeds from item rows: RSS 2.0, Atom 1.0, OPML and an index page; and the checks a document must pass before it is served."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from typing import NamedTuple
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import atom_date, rss_date
from ..functions.ids import atom_id
from ..functions.text import cdata, entry_title, escape_text, escape_xml, xml_clean
from ..functions.url import image_type
from ..html.write import escape
from .config import Site

# Name spaces of the formats and the RSS documentation link.
CONTENT_NS, ATOM_NS, DC_NS, MEDIA_NS = "http://purl.org/rss/1.0/modules/content/", "http://www.w3.org/2005/Atom", "http://purl.org/dc/elements/1.1/", "http://search.yahoo.com/mrss/"
RSS_DOCS = "https://www.rssboard.org/rss-specification"
HEADER = '<?xml version="1.0" encoding="UTF-8"?>\n'
GENERATOR = "weftline"


def _el(name: str, value: Column, indent: str, omit_empty: bool = False) -> Column:
    out = F.concat(F.lit(f"{indent}<{name}>"), escape_xml(F.coalesce(value, F.lit(""))), F.lit(f"</{name}>\n"))
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit("")).otherwise(out) if omit_empty else out


def _each(values: Column, fn: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(F.coalesce(values, F.array().cast("array<string>")), fn), "")


def rss_item(enclosure: bool = False) -> Column:
    """The <item> of a row (title, url, summary, content_html, author, categories, published_at, guid, permalink, image_url)."""
    c = lambda name: xml_clean(F.coalesce(F.col(name), F.lit("")))
    image = F.coalesce("image_url", F.lit(""))
    has_image = image != ""
    i = "      "
    parts = [
        F.lit("    <item>\n"), _el("title", c("title"), i), _el("link", F.col("url"), i), _el("description", escape_text(c("summary")), i),
        F.concat(F.lit(f"{i}<content:encoded>"), cdata(c("content_html")), F.lit("</content:encoded>\n")), _el("dc:creator", c("author"), i, True),
        _each(F.col("categories"), lambda v: F.concat(F.lit(f"{i}<category>"), escape_xml(xml_clean(v)), F.lit("</category>\n"))),
        _el("pubDate", rss_date(F.col("published_at")), i),
        F.concat(F.lit(f'{i}<guid isPermaLink="'), F.when(F.col("permalink"), "true").otherwise("false"), F.lit('">'), escape_xml(F.col("guid")), F.lit("</guid>\n")),
    ]
    if enclosure:
        parts.append(F.when(has_image, F.concat(F.lit(f'{i}<enclosure url="'), escape_xml(image), F.lit('" length="0" type="'), image_type(image), F.lit('"></enclosure>\n'))).otherwise(F.lit("")))
    parts.append(F.when(has_image, F.concat(F.lit(f'{i}<media:content url="'), escape_xml(image), F.lit('" medium="image"></media:content>\n'))).otherwise(F.lit("")))
    return F.concat(*parts, F.lit("    </item>\n"))


def atom_entry() -> Column:
    """The <entry> of a row; updated is never before published."""
    c = lambda name: xml_clean(F.coalesce(F.col(name), F.lit("")))
    i = "    "
    typed = lambda name, kind, v: F.concat(F.lit(f'{i}<{name} type="{kind}">'), escape_xml(v), F.lit(f"</{name}>\n"))
    author, summary, image = c("author"), c("summary"), F.coalesce("image_url", F.lit(""))
    return F.concat(
        F.lit("  <entry>\n"), _el("id", atom_id(F.col("guid"), F.col("permalink")), i), typed("title", "text", entry_title(F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")), F.col("url"))),
        F.concat(F.lit(f'{i}<link rel="alternate" type="text/html" href="'), escape_xml(F.col("url")), F.lit('"></link>\n')),
        _el("published", atom_date(F.col("published_at")), i), _el("updated", atom_date(F.greatest("published_at", "updated_at")), i),
        F.when(author != "", F.concat(F.lit(f"{i}<author>\n{i}  <name>"), escape_xml(author), F.lit(f"</name>\n{i}</author>\n"))).otherwise(F.lit("")),
        _each(F.col("categories"), lambda v: F.concat(F.lit(f'{i}<category term="'), escape_xml(xml_clean(v)), F.lit('"></category>\n'))),
        F.when(summary != "", typed("summary", "text", summary)).otherwise(F.lit("")), typed("content", "html", c("content_html")),
        F.when(image != "", F.concat(F.lit(f'{i}<media:content url="'), escape_xml(image), F.lit('" medium="image"></media:content>\n'))).otherwise(F.lit("")),
        F.lit("  </entry>\n"),
    )


def _date(t: datetime, rss: bool) -> str:
    t = t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t.astimezone(timezone.utc)
    return t.strftime("%a, %d %b %Y %H:%M:%S +0000") if rss else t.strftime("%Y-%m-%dT%H:%M:%SZ")


def _clean(s: str | None) -> str:
    return re.sub("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]", "", s or "")


def rss_document(site: Site, self_url: str, items: Iterable[str], newest: datetime | None, last_build: datetime | None) -> str:
    e = lambda s: escape(_clean(s))
    el = lambda name, v, must=True: f"    <{name}>{e(v)}</{name}>\n" if must or v else ""
    image = f"    <image>\n      <url>{e(site.image)}</url>\n      <title>{e(site.title)}</title>\n      <link>{e(site.link)}</link>\n    </image>\n" if site.image else ""
    return (
        f'{HEADER}<rss version="2.0" xmlns:content="{CONTENT_NS}" xmlns:atom="{ATOM_NS}" xmlns:dc="{DC_NS}" xmlns:media="{MEDIA_NS}">\n  <channel>\n'
        + el("title", site.title) + el("link", site.link) + el("description", site.description) + f'    <atom:link href="{e(self_url)}" rel="self" type="application/rss+xml"></atom:link>\n'
        + el("language", site.language, False) + el("pubDate", _date(newest, True) if newest else "", False) + el("lastBuildDate", _date(last_build, True) if last_build else "", False)
        + el("docs", RSS_DOCS) + el("generator", GENERATOR) + (el("ttl", str(site.ttl)) if site.ttl else "") + image + "".join(items) + "  </channel>\n</rss>\n"
    )


def atom_document(site: Site, self_url: str, entries: Iterable[str], updated: datetime | None) -> str:
    e = lambda s: escape(_clean(s))
    lang = f' xml:lang="{e(site.language)}"' if site.language else ""
    subtitle = f'  <subtitle type="text">{e(site.description)}</subtitle>\n' if site.description else ""
    return (
        f'{HEADER}<feed xmlns="{ATOM_NS}" xmlns:media="{MEDIA_NS}"{lang}>\n  <id>{e(self_url)}</id>\n  <title type="text">{e(site.title)}</title>\n{subtitle}'
        f"  <updated>{_date(updated or datetime.fromtimestamp(0, timezone.utc), False)}</updated>\n  <author>\n    <name>{e(site.author or site.title)}</name>\n  </author>\n"
        f'  <link rel="self" type="application/atom+xml" href="{e(self_url)}"></link>\n  <link rel="alternate" type="text/html" href="{e(site.link)}"></link>\n'
        f"  <generator>{GENERATOR}</generator>\n" + (f"  <logo>{e(site.image)}</logo>\n" if site.image else "") + "".join(entries) + "</feed>\n"
    )


def feed_rows(items: DataFrame, site: Site) -> DataFrame:
    """The newest ``max_items`` of the site's items as they are rendered: the channel's author where an item has none; missing items stay."""
    own = items.where(F.col("site_id") == site.id).orderBy(F.col("published_at").desc(), F.col("first_seen_at").desc(), "guid").limit(site.max_items)
    return own.withColumn("author", F.when(F.coalesce("author", F.lit("")) == "", F.lit(site.author)).otherwise(F.col("author"))).withColumn("permalink", F.lit(site.item.guid == "permalink"))


def render(items: DataFrame, site: Site, base_url: str, last_build: datetime | None, fmt: str = "rss") -> str:
    """A feed document. At most ``max_items`` rows reach the driver."""
    order = (F.col("published_at").desc(), F.col("first_seen_at").desc(), "guid")
    body = rss_item(site.item.enclosure) if fmt == "rss" else atom_entry()
    rows = feed_rows(items, site).orderBy(*order).select(body.alias("x"), F.col("published_at").alias("p"), F.greatest("published_at", "updated_at").alias("u")).collect()
    url = f"{base_url}/feeds/{site.id}{FORMATS[fmt].extension}"
    if fmt == "rss":
        return rss_document(site, url, (r["x"] for r in rows), max((r["p"] for r in rows), default=None), last_build)
    naive = last_build.astimezone(timezone.utc).replace(tzinfo=None) if last_build and last_build.tzinfo else last_build
    times = [r["u"] for r in rows] + ([naive] if naive else [])
    return atom_document(site, url, (r["x"] for r in rows), max(times, default=None))


def opml(sites: Iterable[Site], base_url: str, title: str = "Feeds") -> str:
    lines = "".join(f'    <outline type="rss" text="{escape(s.title)}" title="{escape(s.title)}" xmlUrl="{escape(base_url)}/feeds/{s.id}.xml" htmlUrl="{escape(s.link)}"></outline>\n' for s in sites)
    return f'{HEADER}<opml version="2.0">\n  <head>\n    <title>{escape(title)}</title>\n  </head>\n  <body>\n{lines}  </body>\n</opml>\n'


def index_page(sites: Iterable[Site], base_url: str, title: str = "Feeds") -> str:
    rows = "".join(f'<li><a href="{escape(s.link)}">{escape(s.title)}</a>: {escape(s.description)} (<a href="{base_url}/feeds/{s.id}.xml">RSS</a>, <a href="{base_url}/feeds/{s.id}.atom">Atom</a>)</li>' for s in sites)
    return f"<!doctype html><html><head><meta charset=utf-8><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><ul>{rows}</ul></body></html>\n"


def well_formed(data: bytes) -> list[str]:
    """Exactly one root, with nothing but white space, comments and instructions about it."""
    try:
        ElementTree.fromstring(data)
    except ElementTree.ParseError as e:
        return [f"is no well-formed XML: {e}"]
    return []


def _absolute(u: str) -> bool:
    return bool(re.match(r"https?://[^/?#\s]+", u))


# What a document must satisfy before it is served is told by tables of rules. A rule reads a text of
# a node and lists the tests it must pass; the first that fails says what is wrong with it.

Test = Callable[[str], str]


def _given(v: str) -> str:
    return "" if v else "is absent or empty"


def _address(v: str) -> str:
    return "" if _absolute(v) else f"is no http(s) address: {v!r}"


def _written_as(pattern: str, what: str) -> Test:
    return lambda v: "" if re.fullmatch(pattern, v) else f"is not {what}: {v!r}"


def _if_given(test: Test) -> Test:
    return lambda v: test(v) if v else ""


_RSS_DATE = _written_as(r"[A-Z][a-z]{2}, \d{2} [A-Z][a-z]{2} \d{4} \d\d:\d\d:\d\d [+-]\d{4}", "a date of RFC 822 with four digits of year and a numeric zone")
_ATOM_DATE = _written_as(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+-]\d\d:\d\d)", "a date of RFC 3339")


class Rule(NamedTuple):
    """``name`` of a part of a node, how its texts are read (each is tested; none counts as one empty text), and its tests."""

    name: str
    read: Callable[[ElementTree.Element], list[str]]
    tests: tuple[Test, ...]

    def problems(self, node: ElementTree.Element) -> Iterator[str]:
        for value in self.read(node) or [""]:
            if why := next((w for t in self.tests if (w := t(value))), ""):
                yield f"{self.name} {why}"


def _child(path: str) -> Callable[[ElementTree.Element], list[str]]:
    return lambda n: [n.findtext(path) or ""]


def _hrefs(tag: str, *rels: str | None) -> Callable[[ElementTree.Element], list[str]]:
    return lambda n: [x.get("href", "") for x in n.findall(tag) if x.get("rel") in rels]


def _permalinks(n: ElementTree.Element) -> list[str]:
    return [x.text or "" for x in n.findall("guid") if x.get("isPermaLink") != "false"]


@dataclass(frozen=True)
class Grammar:
    """The rules of a format: of its root, its head and its items, which must have ids of their own and fall in date."""

    root: str
    head: str
    items: str
    of_root: tuple[Rule, ...]
    of_head: tuple[Rule, ...]
    of_item: tuple[Rule, ...]
    ident: Callable[[ElementTree.Element], list[str]]
    date: Callable[[ElementTree.Element], list[str]]
    when: Callable[[str], datetime]

    def check(self, data: bytes | str) -> list[str]:
        """Problems of a document; none means that it may be served."""
        raw = data.encode() if isinstance(data, str) else data
        if bad := well_formed(raw):
            return bad
        root = ElementTree.fromstring(raw)
        if root.tag != self.root:
            return [f"the root is {root.tag!r} instead of {self.root!r}"]
        head = root if self.head == "." else root.find(self.head)
        if head is None:
            return [f"there is no {self.head}"]
        said = [p for rules, node in ((self.of_root, root), (self.of_head, head)) for r in rules for p in r.problems(node)]
        seen: dict[str, int] = {}
        before: datetime | None = None
        for n, item in enumerate(head.findall(self.items), 1):
            own = [p for r in self.of_item for p in r.problems(item)]
            (ident,), (date,) = self.ident(item), self.date(item)
            if ident and seen.setdefault(ident, n) != n:
                own.append(f"has the id of number {seen[ident]}: {ident!r}")
            if at := self._time(date):
                if before is not None and at > before:
                    own.append("is newer than the one before it")
                before = at
            said += [f"number {n}: {p}" for p in own]
        return said

    def _time(self, date: str) -> datetime | None:
        try:
            return self.when(date)
        except (TypeError, ValueError):
            return None


_A = f"{{{ATOM_NS}}}"
RSS = Grammar(
    "rss", "channel", "item",
    (Rule("version", lambda n: [n.get("version", "")], (_written_as(r"2\.0", "2.0"),)),),
    (
        Rule("title", _child("title"), (_given,)), Rule("link", _child("link"), (_given, _address)), Rule("description", _child("description"), (_given,)),
        Rule("own address", _hrefs(f"{_A}link", "self"), (_given, _address)), Rule("pubDate", _child("pubDate"), (_if_given(_RSS_DATE),)), Rule("lastBuildDate", _child("lastBuildDate"), (_if_given(_RSS_DATE),)),
    ),
    (
        Rule("title or description", lambda n: [n.findtext("title") or n.findtext("description") or ""], (_given,)), Rule("link", _child("link"), (_given, _address)),
        Rule("content", _child(f"{{{CONTENT_NS}}}encoded"), (_given,)), Rule("guid", _child("guid"), (_given,)), Rule("permalink", lambda n: _permalinks(n) or ["http://none/"], (_address,)),
        Rule("pubDate", _child("pubDate"), (_given, _RSS_DATE)),
    ),
    _child("guid"), _child("pubDate"), parsedate_to_datetime,
)
_ALTERNATE = Rule("page address", _hrefs(f"{_A}link", None, "", "alternate"), (_given, _address))
ATOM = Grammar(
    f"{_A}feed", ".", f"{_A}entry", (),
    (
        Rule("id", _child(f"{_A}id"), (_given,)), Rule("title", _child(f"{_A}title"), (_given,)), Rule("updated", _child(f"{_A}updated"), (_given, _ATOM_DATE)),
        Rule("author", _child(f"{_A}author/{_A}name"), (_given,)), Rule("own address", _hrefs(f"{_A}link", "self"), (_given, _address)), _ALTERNATE,
    ),
    (
        Rule("id", _child(f"{_A}id"), (_given,)), Rule("title", _child(f"{_A}title"), (_given,)), _ALTERNATE, Rule("content", _child(f"{_A}content"), (_given,)),
        Rule("updated", _child(f"{_A}updated"), (_given, _ATOM_DATE)), Rule("published", _child(f"{_A}published"), (_given, _ATOM_DATE)),
    ),
    _child(f"{_A}id"), _child(f"{_A}published"), lambda v: datetime.fromisoformat(v.replace("Z", "+00:00")),
)


@dataclass(frozen=True)
class Format:
    name: str
    extension: str
    content_type: str
    check: Callable[[bytes | str], list[str]]


FORMATS = {"rss": Format("rss", ".xml", "application/rss+xml; charset=utf-8", RSS.check), "atom": Format("atom", ".atom", "application/atom+xml; charset=utf-8", ATOM.check)}


def etag(data: bytes) -> str:
    return f'"{hashlib.sha256(data).hexdigest()[:32]}"'


def write_atomic(path: str, data: bytes) -> None:
    """Readers see the old file or the new one, never part of it."""
    folder = os.path.dirname(path) or "."
    os.makedirs(folder, exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=folder, prefix=".new-")
    try:
        with os.fdopen(fd, "wb") as f:
            f.write(data)
        os.chmod(tmp, 0o644)
        os.replace(tmp, path)
    except BaseException:
        os.unlink(tmp)
        raise


def publish(document: str, fmt: str, path: str) -> list[str]:
    """Write a feed unless it is empty or fails its checks; then the last good one stays. Returns the problems."""
    problems = FORMATS[fmt].check(document)
    if not re.search("<item>|<entry>", document):
        problems = [*problems, "the feed has no items"]
    if not problems:
        write_atomic(path, document.encode())
    return problems


def stamp(previous: tuple[str, datetime] | None, data: bytes, now: datetime) -> tuple[str, datetime]:
    """(etag, modified): modified stays while the content does."""
    tag = etag(data)
    return previous if previous and previous[0] == tag else (tag, now.replace(microsecond=0))


def parse_validator_answer(xml: str) -> tuple[bool, list[str], list[str]]:
    """(valid, errors, warnings) of a feed validator's SOAP answer."""
    root = ElementTree.fromstring(xml)
    local = lambda n: n.tag.rpartition("}")[2]
    texts = lambda kind: [f"line {next((c.text for c in n if local(c) == 'line'), '?')}: {next((c.text for c in n if local(c) == 'text'), '')}" for n in root.iter() if local(n) == kind]
    valid = next((n.text for n in root.iter() if local(n) == "validity"), "false")
    return (valid or "").strip() == "true", texts("error"), texts("warning")


def check_documents(df: DataFrame, column: str, fmt: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, problem) of stored documents, a row a problem."""
    check = FORMATS[fmt].check

    def run(batches):
        for b in batches:
            found = [check(d or b"") for d in b.column(0).to_pylist()]
            at = [i for i, f in enumerate(found) for _ in f]
            kept = b.select(list(keep)).take(pa.array(at, pa.int64())).columns if keep else []
            yield pa.RecordBatch.from_arrays([*kept, pa.array([p for f in found for p in f], pa.string())], names=[*keep, "problem"])

    types = dict(df.dtypes)
    return df.select(column, *keep).mapInArrow(run, "".join(f"`{c}` {types[c]}, " for c in keep) + "problem string")
