"""Main text of pages by site style trees.

The pages of a host are merged into one tree of block nodes by presentation (tag, class,
id and role along the path, long numbers taken alike). Two things are learned of a node:

- its importance, the normalised entropy of its contents over the pages that have it: a
  text that stands on every page weighs nothing, one that differs on each weighs all;
- its share of the text outside links of these pages, each node's text weighed by
  its importance.

The trunk of a page is the deepest node of its path through the tree that holds SHARE
of the text and stands once on a page; everything outside it goes, and so does, inside it,
every branch of low importance that is common below its parent. Names of classes only
break ties: they remove a branch of the trunk that holds little text and calls itself an
advert or the like, and they stand in for the tree on hosts of which too few pages are known.

Counts are aggregates with map-side combining, so a host of any size is merged without
gathering its pages; only unimportant nodes and trunks go back to the pages of their host.
A whole article is never removed for being the same on other pages, since copies of an
article are articles: inside one, contents are counted over different articles instead of
pages, and an article whose common blocks hold half of its text or more keeps them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.url import host as host_of
from ..html.tree import Node, parse
from .common import Prefix, map_batches, signed, stored, table

#: A node is boilerplate below LOW importance, if PAGES pages (inside articles: different articles) or more and COMMON of those with its parent node have it.
LOW, PAGES, COMMON = 0.2, 5, 0.5
#: A trunk holds SHARE of the text of PAGES pages or more, with at most ONCE nodes a page. Names break ties on branches of LITTLE of the trunk's text.
SHARE, ONCE, LITTLE = 0.5, 1.05, 0.2
DROPPED = frozenset("script style noscript template nav aside form footer iframe object embed svg canvas button select textarea input dialog menu audio video map head title".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul".split())
HOLDS = frozenset("article main section div td center form".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alerts?|nav\w*|menu|breadcrumbs?|side-?bar|footer|masthead|site-?header|page-?header|comments?|disqus|respond|replies|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|popup|modal|overlay|widget|pagination|pager|skip-?link)(?:$|[\s_-])", re.I)
#: Names that say the same inside an article, where an alert or a widget may be part of the text.
INSIDE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|breadcrumbs?|comments?|disqus|replies|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|popup|pagination|pager)(?:$|[\s_-])", re.I)
MAIN = re.compile(r"(?:^|[\s_-])(?:article|post|entry|story|content|main)(?:-?(?:body|content|text))?(?:$|[\s_-])", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACE, NUMBER = re.compile(r"\s+"), re.compile(r"\d{3,}")


class Place(NamedTuple):
    """A block node of a body: hash of its presentation path, those of the blocks around it, innermost article or main around it, the span of its text without white space, and how much of it is outside links and in no block further in."""

    node: Node
    path: int
    chain: tuple[int, ...]
    article: Node | None
    first: int
    last: int
    own: int


def names_of(node: Node) -> str:
    return f"{node.get('class')} {node.get('id')}".strip()


def presentation(node: Node) -> str:
    return NUMBER.sub("0", f"{node.tag}.{node.get('class')}#{node.get('id')}@{node.get('role')}")


def is_main(node: Node) -> bool:
    return node.tag in ("article", "main") or node.get("role").lower() in ("main", "article") or node.get("itemprop").lower() == "articlebody"


def is_dropped(node: Node) -> bool:
    """By tag: what never is text of an article. A form around a whole article is markup."""
    return node.tag in DROPPED and not (node.tag == "form" and any(is_main(x) for x in node.elements()))


def is_boilerplate(node: Node, inside: bool) -> bool:
    """By its kind alone; ``inside`` an article, headers of sections and footers of quotations may stay."""
    if is_dropped(node) and not (node.tag == "footer" and inside and node.parent is not None and node.parent.tag == "blockquote"):
        return True
    if node.tag == "header" and not inside:
        return True
    return "hidden" in node.attrs or node.get("aria-hidden").lower() == "true" or bool(HIDDEN.search(node.get("style"))) or (node.get("role").lower() in ROLES and not (node.tag == "form" and not is_dropped(node)))


def is_named(node: Node, inside: bool) -> bool:
    """By its names, the tie-break."""
    if node.tag in ("html", "body", "main", "h1") or not (names := names_of(node)):
        return False
    return bool((INSIDE if inside or node.tag == "article" else NAMES).search(names))


def places(root: Node) -> tuple[list[Place], np.ndarray]:
    """Block nodes of the body in page order, and the bytes of its text without white space."""
    found: list[list] = []
    parts: list[bytes] = []
    at = 0
    top = xxhash.xxh64_intdigest("html")
    stack: list[tuple] = [(c, top, (), None, False, -1) for c in reversed(root.children) if c.tag == "body"]
    while stack:
        step = stack.pop()
        if len(step) == 1:
            found[step[0]][5] = at
            continue
        n, up, chain, article, in_link, block = step
        if n.tag is None:
            raw = "".join(n.text.split()).encode()
            parts.append(raw)
            at += len(raw)
            if not in_link and block >= 0:
                found[block][6] += len(raw)
            continue
        if is_dropped(n):
            continue
        own = xxhash.xxh64_intdigest(f"{up}/{presentation(n)}")
        if n.tag in BLOCK or n.tag == "span" or is_main(n):
            path = own - (1 << 64) if own >= 1 << 63 else own
            block = len(found)
            stack.append((block,))
            found.append([n, path, chain, article, at, at, 0])
            chain = (*chain, path)
        if is_main(n):
            article = n
        stack.extend((c, own, chain, article, in_link or n.tag == "a", block) for c in reversed(n.children))
    return [Place(*f) for f in found], np.frombuffer(b"".join(parts), np.uint8)


def blocks_of(root: Node) -> list[str]:
    """Texts of the blocks below a node in page order, white space squeezed, empty ones left out."""
    out: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        if parts:
            if text := SPACE.sub(" ", "".join(parts)).strip():
                out.append(text)
            parts.clear()

    stack: list[tuple[Node | None, bool]] = [(root, False)]
    while stack:
        n, leaving = stack.pop()
        if leaving:
            flush()
        elif n.tag is None:
            parts.append(n.text)
        elif n.tag == "br":
            parts.append(" ")
        else:
            if n.tag in BLOCK:
                flush()
                stack.append((n, True))
            stack.extend((c, False) for c in reversed(n.children))
    flush()
    return out


def link_share(node: Node) -> float:
    total = len(node.content().strip())
    linked = sum(len(n.content()) for n in node.elements() if n.tag == "a")
    return linked / total if total else 1.0


def trunk_of(found: list[Place], trunk: frozenset[int]) -> Node | None:
    """The deepest block of other blocks on a trunk path, or the nearest one around it with the page's first heading, if that isn't inside."""
    own = [p for p in found if p.path in trunk and (p.node.tag in HOLDS or is_main(p.node)) and p.last > p.first]
    if not own:
        return None
    deepest = own[-1]  # the last of a chain of nested nodes: they come in page order
    chain = [p for p in own if p.first <= deepest.first and deepest.last <= p.last]
    for p in reversed(chain):
        if any(x.tag == "h1" for x in p.node.elements()):
            return p.node
    return deepest.node


def main_text(html: str | None, low: frozenset[int] = frozenset(), trunk: frozenset[int] = frozenset()) -> str:
    """The article of a page; ``low``: presentation paths of low importance on its site, ``trunk``: those that hold most of the text. An empty string if there is none."""
    root = parse(html)
    found, _ = places(root)
    main = trunk_of(found, trunk)
    size = {id(p.node): p.last - p.first for p in found}
    if low:
        mains = [p for p in found if is_main(p.node)]
        firsts = np.array([p.first for p in mains] or [0])
        lasts = np.array([p.last for p in mains] or [-1])
        lost: Counter[int] = Counter()
        doomed = []
        end = -1
        for p in found:  # outermost first
            if p.path not in low or p.node is main or p.node.tag in ("html", "body") or ((firsts >= p.first) & (lasts <= p.last) & (lasts > firsts)).any():
                continue
            doomed.append(p)
            if p.article is not None and p.first >= end:
                lost[id(p.article)] += p.last - p.first
                end = p.last
        for p in doomed:
            if p.article is None or 2 * lost[id(p.article)] < size.get(id(p.article), 0):
                p.node.remove()
    whole = size.get(id(main), 0) if main is not None else 0
    stack = [(c, False) for c in root.children]
    while stack:
        n, inside = stack.pop()
        if n.tag is None:
            continue
        here = inside or is_main(n) or n is main
        if n.tag not in ("html", "body") and n is not main:
            if is_boilerplate(n, inside) or (is_named(n, here) and (main is None or size.get(id(n), 0) < LITTLE * whole) and not any(x is main for x in n.elements())):
                n.remove()
                continue
        stack.extend((c, here) for c in n.children)
    if main is not None and root in main.path():
        return "\n".join(blocks_of(main))

    def outermost(test) -> list[Node]:
        found, todo = [], [root]
        while todo:
            n = todo.pop()
            if n.tag is not None and test(n):
                found.append(n)
            else:
                todo.extend(reversed(n.children))
        return found

    tops = outermost(lambda n: n.tag == "article" or n.get("role").lower() == "article" or n.get("itemprop").lower() == "articlebody") or outermost(is_main)
    if not tops:
        named = [n for n in outermost(lambda n: n.tag in ("div", "section", "td") and bool(MAIN.search(names_of(n)))) if n.content().strip()]
        tops = named or [n for n in root.children if n.tag == "body"]
    if len(tops) > 1:
        full = [n for n in tops if link_share(n) < 0.5]
        tops = full or tops
    return "\n".join(b for n in tops for b in blocks_of(n))


NODE = ["host", "path", "chain", "content", "article"]
COUNTS = ["n", "has", "times", "own"]


def _styles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Block nodes by NODE, counted within a batch. Columns: host, html.

    ``chain`` are the paths of the blocks around the node, ``article`` the hash of the article
    around it, 0 outside articles. A page counts a node's content once in n, and once for all its
    contents in ``has``; ``times`` counts nodes and ``own`` their own characters.
    """
    for batch in batches:
        seen: dict[tuple, list[int]] = {}
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found, data = places(parse(html))
            if not found:
                continue
            first, last = (np.array([p[i] for p in found]) for i in (4, 5))
            contents = signed(Prefix(data).of(first, last) + (last - first).astype(np.uint64)).tolist()
            known: dict[int, int] = {}
            on_page: set[tuple] = set()
            for p, content in zip(found, contents, strict=True):
                if is_main(p.node):
                    known[id(p.node)] = around = content  # one content an article: never of low importance
                else:
                    around = 0 if p.article is None else known[id(p.article)]
                key = (host, p.path, p.chain, content, around)
                c = seen.setdefault(key, [0] * 4)
                if key not in on_page:
                    c[0] += 1
                    c[1] += (p.path, around) not in on_page
                c[2] += 1
                c[3] += p.own
                on_page.add(key)
                on_page.add((p.path, around))
        if seen:
            host, path, chain, content, around = zip(*seen, strict=True)
            counts = zip(*seen.values(), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(path, pa.int64()), pa.array(map(list, chain), pa.list_(pa.int64())), *(pa.array(c, pa.int64()) for c in (content, around, *counts))], names=[*NODE, *COUNTS])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(html, frozenset(low or ()), frozenset(trunk or ())) for html, low, trunk in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[3:], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*batch.schema.names[3:], "text", "n_chars"])


def _pages(pages: DataFrame, *columns: str) -> DataFrame:
    return pages.select(F.coalesce(host_of(F.col("url").cast("string")), F.lit("")).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), *columns)


def importance(pages: DataFrame) -> DataFrame:
    """(host, path, n, has, pages, on, times, share, importance) of each block node: importance 0 the same everywhere to 1 different on each page.

    n counts contents, ``has`` the pages with the node, ``pages`` those with its parent; inside
    articles different articles take the place of pages in these, so that copies of one count
    once. ``on`` are pages in any case and ``times`` the nodes on them. ``share`` is the part that
    the node and those below it have of the weighed text of its pages: text elsewhere counts
    as far as the node's pages are many among the host's.
    """
    counted = map_batches(_pages(pages), _styles, "host string, path long, chain array<long>, content long, article long, " + ", ".join(f"{c} long" for c in COUNTS))
    counted = counted.groupBy(*NODE).agg(*[F.sum(c).alias(c) for c in COUNTS])
    once = [F.when(F.col("article") == 0, F.col(c)).otherwise(F.least(F.col(c), F.lit(1))) for c in ("n", "has")]
    sums = [F.sum(c).alias(c) for c in COUNTS[2:]]
    counted = counted.groupBy(*NODE[:-1]).agg(F.sum(once[0]).alias("n"), F.sum(once[1]).alias("has"), F.sum("has").alias("on"), *sums)
    node = counted.groupBy("host", "path", "chain").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.sum("has").alias("has"), F.sum("on").alias("on"), *sums)
    entropy = F.when(F.col("n") > 1, (F.log("n") - F.col("nlogn") / F.col("n")) / F.log("n")).otherwise(1.0)
    node = stored(node.withColumn("importance", entropy))  # read several times: pages are parsed once for it
    above = node.select("host", F.col("path").alias("up"), F.col("has").alias("pages"))
    weighed = F.col("own") * F.col("importance")
    below = node.select("host", F.explode(F.array_append("chain", F.col("path"))).alias("path"), weighed.alias("m")).groupBy("host", "path").agg(F.sum("m").alias("below"))
    whole = node.groupBy("host").agg(F.sum(weighed).alias("whole"), F.max("on").alias("all"))
    full = node.withColumn("up", F.element_at(F.concat(F.array(F.lit(0).cast("long")), "chain"), -1)).join(above, ["host", "up"], "left").join(below, ["host", "path"]).join(whole, "host")
    elsewhere = (F.col("whole") - F.col("below")) * F.col("on") / F.col("all")
    share = F.when(F.col("below") > 0, F.col("below") / (F.col("below") + elsewhere)).otherwise(0.0)
    return full.select("host", "path", "n", "has", F.coalesce("pages", "has").alias("pages"), "on", "times", share.alias("share"), "importance")


def evidence(pages: DataFrame, low: float = LOW, least: int = PAGES, common: float = COMMON, share: float = SHARE) -> DataFrame:
    """(host, low, trunk): paths of low importance, and of trunks, of the hosts that have any. A row a host, as long as its paths are many."""
    known = importance(pages)
    is_low = (F.col("importance") < low) & (F.col("has") >= least) & (F.col("has") >= common * F.col("pages"))
    is_trunk = (F.col("importance") >= low) & (F.col("on") >= least) & (F.col("share") >= share) & (F.col("times") <= ONCE * F.col("on"))
    told = known.select("host", F.when(is_low, F.col("path")).alias("low"), F.when(is_trunk, F.col("path")).alias("trunk")).where("low is not null or trunk is not null")
    return stored(told.groupBy("host").agg(F.collect_list("low").alias("low"), F.collect_list("trunk").alias("trunk")))


def extract(pages: DataFrame, **rules) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page; ``rules`` are those of :func:`evidence`.

    Null and empty html gives an empty text; null and broken urls form a host of their own;
    repeated rows and pages that tie in everything are all returned; pages of any length are
    read whole; other columns, whatever their names, aren't read; an empty table gives no rows.
    """
    # The evidence is a stored table of known size: Spark broadcasts it if small, else pages are shuffled, and a hot host's are split.
    full = _pages(pages, "page_id", "url").join(evidence(pages, **rules), "host", "left").select("html", "low", "trunk", "page_id", "url")
    types = dict(full.dtypes)
    return map_batches(full, _extract, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`extract` over all of pages, one row a page: page_id, url, text, n_chars."""
    return extract(table(spark, sf_dir, "pages"))
