"""Article bodies to feed-safe HTML: media fixed, embeds as links, URLs absolute, an allowlist, tidy blocks."""

from __future__ import annotations

import re

from ..functions.text import py_clean_text, py_strip_invisible
from ..functions.url import py_resolve
from .css import compile_selector
from .tree import VOID, Node, parse
from .write import escape, inner

# Elements and attributes that pass, elements whose content goes with them, blocks and containers.
ALLOWED = frozenset("p br hr h1 h2 h3 h4 h5 h6 blockquote pre code em strong b i u s del ins sub sup small mark abbr cite q kbd samp var ul ol li dl dt dd figure figcaption table thead tbody tfoot tr td th caption div span a img".split())
ATTRIBUTES = {
    "a": ("href", "title"), "img": ("src", "srcset", "alt", "title"), "td": ("colspan", "rowspan", "scope"), "th": ("colspan", "rowspan", "scope"),
    "ol": ("start", "reversed"), "blockquote": ("cite",), "q": ("cite",),
}
VIDEO = {"video": ("src", "poster", "width", "height", "controls"), "source": ("src", "type")}
EMPTIED = frozenset("svg button form select textarea canvas object embed template noscript script style iframe title head".split())
DROPPED = ".w-dyn-bind-empty, .w-condition-invisible, script, style, noscript, template"
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote figure figcaption table hr div".split())
LISTS = frozenset("ul ol dl table thead tbody tfoot tr".split())
CONTAINERS = frozenset("body div figure blockquote".split())
EMPTY_GOES = frozenset("p figure a li figcaption em strong".split())
NEEDS_ATTRIBUTE = frozenset("a img".split())
SPACED = frozenset("p li h1 h2 h3 h4 h5 h6 pre blockquote figcaption td th br div".split())
YOUTUBE = re.compile(r"https?://(?:www\.)?youtube(?:-nocookie)?\.com/embed/([A-Za-z0-9_-]{6,})")
VIMEO = re.compile(r"https?://player\.vimeo\.com/video/(\d+)")
SPACE = re.compile(r"[ \t\r\n\f]+")
SCHEME = re.compile(r"^([a-zA-Z][a-zA-Z0-9+.-]*):")


def fragment(html: str) -> Node:
    return next(c for c in parse(f"<html><body>{html}</body></html>").children if c.tag == "body")


def _nodes(html: str) -> list[Node]:
    return fragment(html).children


def _lazy(body: Node) -> None:
    for n in body.elements():
        if n.tag not in ("img", "source", "video", "iframe"):
            continue
        for name in ("src", "srcset"):
            late = n.attrs.get(f"data-{name}")
            if late is None or not late.strip():
                continue
            now = n.get(name).strip()
            if not now or now.startswith("data:") or "placeholder" in now or now == "about:blank":
                n.attrs[name] = late
            del n.attrs[f"data-{name}"]
        n.attrs.pop("loading", None)
        n.attrs.pop("decoding", None)


def _code_lines(n: Node, out: list[str]) -> None:
    """Text of code; breaks and the edges of line elements are new lines."""

    def end_line() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    for c in n.children:
        if c.tag is None:
            if c.text:
                out.append(c.text)
        elif c.tag == "br":
            out.append("\n")
        elif c.tag in BLOCKS or c.tag in ("li", "tr"):
            end_line()
            _code_lines(c, out)
            end_line()
        else:
            _code_lines(c, out)


def _flatten_code(body: Node) -> None:
    for pre in [n for n in body.elements() if n.tag == "pre"]:
        lines: list[str] = []
        _code_lines(pre, lines)
        pre.children = []
        pre.append(Node("code")).append(Node(None, text="".join(lines).rstrip("\n")))


def embed_html(link: str, poster: str, label: str, title: str) -> str:
    picture = f'<a href="{escape(link)}"><img src="{escape(poster)}" alt="{escape(title)}"/></a><br/>' if poster else ""
    text = f"{label}: {title}" if title else label
    return f'<p>{picture}<a href="{escape(link)}">{escape(text)}</a></p>'


def _embeds(body: Node, keep_video: bool) -> None:
    for n in [n for n in body.elements() if n.tag == "iframe"]:
        src, title = n.get("src").strip(), n.get("title").strip()
        if src.startswith("//"):
            src = "https:" + src
        if m := YOUTUBE.match(src):
            new = embed_html(f"https://www.youtube.com/watch?v={m[1]}", f"https://i.ytimg.com/vi/{m[1]}/hqdefault.jpg", "▶ Watch video", title)
        elif m := VIMEO.match(src):
            new = embed_html(f"https://vimeo.com/{m[1]}", "", "▶ Watch video", title)
        elif src:
            new = embed_html(src, "", "Open embedded content", title)
        else:
            n.remove()
            continue
        n.replace(*_nodes(new))
    for n in [n for n in body.elements() if n.tag == "video"]:
        first = next((s for s in n.elements() if s.tag == "source" and "src" in s.attrs), None)
        src = n.attrs.get("src", first.attrs["src"] if first is not None else "")
        if not src:
            if not keep_video:
                n.remove()
            continue
        new = _nodes(embed_html(src, n.get("poster"), "▶ Watch video", n.get("title")))
        n.replace(*([n, *new] if keep_video else new))


def srcset(value: str, fn) -> str:
    """A srcset with each URL through ``fn``: a URL ends at white space, trailing commas end one without descriptor, commas in parentheses stand."""
    out, i = [], 0
    blank = " \t\n\r\f"
    while True:
        while i < len(value) and (value[i] in blank or value[i] == ","):
            i += 1
        j = i
        while j < len(value) and value[j] not in blank:
            j += 1
        url = value[i:j]
        if not url:
            return ", ".join(out)
        i = j
        bare, words = url.rstrip(","), ""
        if bare == url:
            depth = 0
            while j < len(value) and (value[j] != "," or depth > 0):
                depth += {"(": 1, ")": -1}.get(value[j], 0)
                j += 1
            words, i = " ".join(value[i:j].split()), j
        out.append(f"{fn(bare)} {words}".rstrip())


def _absolute(body: Node, base: str) -> None:
    def fix(v: str) -> str:
        v = v.strip()
        return v if not v or v.startswith("data:") else py_resolve(base, v) or v

    for n in body.elements():
        for name in ("href", "src", "poster", "cite"):
            if name in n.attrs:
                n.attrs[name] = fix(n.attrs[name])
        if "srcset" in n.attrs:
            n.attrs["srcset"] = srcset(n.attrs["srcset"], fix)


def _safe_url(v: str) -> bool:
    bare = re.sub(r"[\x00-\x20]", "", v)
    m = SCHEME.match(bare)
    return not m or m[1].lower() in ("http", "https", "mailto")


def sanitize(body: Node, keep_video: bool = False) -> None:
    """Only allowed elements and attributes stay; others are unwrapped, some with all they hold removed."""
    allowed, attributes = (ALLOWED | VIDEO.keys(), ATTRIBUTES | VIDEO) if keep_video else (ALLOWED, ATTRIBUTES)

    def visit(n: Node) -> list[Node]:
        if n.tag is None:
            return [n]
        if n.tag in EMPTIED:
            return []
        kids = [x for c in n.children for x in visit(c)]
        attrs = {}
        for k, v in n.attrs.items():
            if k not in attributes.get(n.tag, ()):
                continue
            if k in ("href", "src", "cite", "poster") and not _safe_url(v):
                continue
            if k == "srcset" and not all(_safe_url(u) for u in re.findall(r"[^\s,][^\s]*", v) if ":" in u):
                continue
            attrs[k] = v.strip() if k in ("href", "src", "cite", "poster") else v
        if n.tag not in allowed or n.tag in NEEDS_ATTRIBUTE and not attrs:
            return kids
        n.attrs, n.children = attrs, []
        for k in kids:
            n.append(k)
        return [n]

    kids = [x for c in body.children for x in visit(c)]
    body.children = []
    for k in kids:
        body.append(k)


def _is_empty(n: Node) -> bool:
    if n.tag is None:
        return not n.text.strip()
    return n.tag not in ("img", "video", "br", "hr", "table") and all(_is_empty(c) for c in n.children)


def _is_block(n: Node) -> bool:
    return n.tag in BLOCKS


def _wrap_runs(n: Node) -> None:
    """Each run of inline children in a paragraph of its own."""
    kids, n.children = n.children, []
    run: Node | None = None
    for c in kids:
        if _is_block(c):
            run = None
            n.append(c)
        elif run is not None or not _is_empty(c):
            run = run or n.append(Node("p"))
            run.append(c)
        else:
            n.append(c)


def tidy(n: Node, in_pre: bool = False) -> None:
    """White space squeezed outside pre, empty wrappers out, div and span unwrapped."""
    kids = list(n.children)
    for i, c in enumerate(kids):
        if c.tag is None:
            if in_pre:
                continue
            c.text = SPACE.sub(" ", c.text)
            at = next(k for k, x in enumerate(n.children) if x is c)
            before = n.children[at - 1] if at else None
            after = kids[i + 1] if i + 1 < len(kids) else None
            edge = (before is None or _is_block(before)) and (after is None or _is_block(after))
            if not c.text.strip() and (n.tag in LISTS or n.tag in CONTAINERS and edge):
                c.remove()
            continue
        tidy(c, in_pre or c.tag == "pre")
        if c.tag in ("div", "span"):
            if _is_empty(c):
                c.remove()
                continue
            if c.tag == "div" and any(not _is_block(x) and x.content().strip() for x in c.children):
                _wrap_runs(c)
            c.replace(*c.children)
        elif c.tag in EMPTY_GOES and _is_empty(c):
            c.remove()


def normalize(raw: str, base: str = "", keep_video: bool = False, lead_image: str = "") -> str:
    body = fragment(raw or "")
    for n in compile_selector(DROPPED).select(body):
        n.remove()
    _lazy(body)
    _flatten_code(body)
    _embeds(body, keep_video)
    if base:
        _absolute(body, base)
    for n in body.walk():
        if n.tag is None:
            n.text = py_strip_invisible(n.text)
    sanitize(body, keep_video)
    body = fragment(inner(body))
    tidy(body)
    out = inner(body)
    if lead_image and not any(n.tag == "img" for n in body.elements()):
        out = f'<p><img src="{escape(lead_image)}" alt=""/></p>' + out
    return out.strip()


def plain_text(html: str | None) -> str:
    """Text of a fragment; blocks don't run together."""
    return _spaced_text(fragment(html or ""))


def _spaced_text(body: Node) -> str:
    """Text of a tree, which is changed."""
    for n in [n for n in body.elements() if n.tag in SPACED]:
        if n.tag in VOID:
            n.replace(n, Node(None, text=" "))
        else:
            n.append(Node(None, text=" "))
    return py_clean_text(body.content())


def measured(html: str) -> tuple[dict[str, int], dict[str, int], str]:
    """content_stats, element_counts and plain_text of a body, from one tree."""
    body = fragment(html or "")
    counts: dict[str, int] = {}
    for n in body.elements():
        if n is not body:
            counts[n.tag] = counts.get(n.tag, 0) + 1
    stats = {"blocks": len([c for c in body.children if c.tag is not None]), **{k: counts.get(k, 0) for k in ("img", "pre", "table")}, "embeds": len(re.findall("▶ Watch video|Open embedded content", body.content()))}
    plain = _spaced_text(body)
    return {"chars": len(plain), **stats}, dict(sorted(counts.items())), plain


def content_stats(html: str) -> dict[str, int]:
    """Characters, blocks, images, code blocks, tables and embeds of a body."""
    return measured(html)[0]


def element_counts(html: str) -> dict[str, int]:
    return measured(html)[1]
