"""HTML to a tree: a tokenizer on one pattern and the tree-building rules that real pages lean on.

Covered: void and raw-text elements, implied ends of p, li, dt, dd, option and table
parts, formatting elements carried over into following blocks, stray end tags,
character references, comments and doctypes (dropped), implied html, head and body.
Not covered: foster parenting of table text and the full adoption agency. Any text
gives a tree; nothing raises.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset("title textarea".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSE_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul li dt dd".split())
HEAD = frozenset("base link meta title style script template noscript".split())
#: Elements that a start tag ends, looking up no further than the elements after them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
#: What a table part implies around itself, and below which elements.
WITHIN = {
    "tr": (("tbody", {"table"}),),
    "td": (("tbody", {"table"}), ("tr", {"tbody", "thead", "tfoot"})),
    "th": (("tbody", {"table"}), ("tr", {"tbody", "thead", "tfoot"})),
    "col": (("colgroup", {"table"}),),
}
SCOPE = frozenset("html table td th caption button object marquee applet template".split())
TAG = re.compile(r"<(?:!--(?:-?>|(?P<comment>.*?)(?:--!?>|\Z))|(?P<bogus>[!?][^>]*>?|/(?=[^a-zA-Z])[^>]*>?)|(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?P<self>/)?>)", re.S)
ATTR = re.compile(r"([^\s/>=\"'][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.S)


class Node:
    """An element (``tag``) or a text (``tag`` is None, the text in ``text``)."""

    __slots__ = ("attrs", "children", "parent", "tag", "text")

    def __init__(self, tag: str | None, attrs: dict[str, str] | None = None, text: str = ""):
        self.tag, self.attrs, self.text = tag, attrs or {}, text
        self.children: list[Node] = []
        self.parent: Node | None = None

    def append(self, child: Node) -> Node:
        child.parent = self
        self.children.append(child)
        return child

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def replace(self, *new: Node) -> None:
        up = self.parent
        at = next(i for i, c in enumerate(up.children) if c is self)
        for n in new:
            n.parent = up
        up.children[at : at + 1] = new
        self.parent = None

    def walk(self) -> Iterator[Node]:
        """The node and all below it in document order; the tree may change behind the cursor."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.children))

    def elements(self) -> Iterator[Node]:
        return (n for n in self.walk() if n.tag is not None)

    def content(self) -> str:
        return "".join(n.text for n in self.walk() if n.tag is None)

    def get(self, name: str, default: str = "") -> str:
        return self.attrs.get(name, default)

    def path(self) -> list[Node]:
        """Ancestors, nearest first."""
        out, n = [], self.parent
        while n is not None:
            out.append(n)
            n = n.parent
        return out


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTR.finditer(raw):
        out.setdefault(m[1].lower(), unescape(m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""))
    return out


class Builder:
    def __init__(self) -> None:
        self.root = Node("html")
        self.head, self.body = self.root.append(Node("head")), Node("body")
        self.open: list[Node] = [self.root]
        self.active: list[Node] = []
        self.in_body = False

    def start_body(self) -> None:
        if not self.in_body:
            self.in_body = True
            self.root.append(self.body)
            self.open = [self.root, self.body]

    def has(self, tags: frozenset[str] | set[str], stop: frozenset[str] | set[str] = SCOPE) -> bool:
        for n in reversed(self.open):
            if n.tag in tags:
                return True
            if n.tag in stop:
                return False
        return False

    def pop_to(self, tags: frozenset[str] | set[str]) -> None:
        while self.open[-1].tag not in tags:
            self.open.pop()
        self.open.pop()

    def reopen(self) -> None:
        for i, n in enumerate(self.active):
            if not any(o is n for o in self.open):
                self.active[i] = self.open[-1].append(Node(n.tag, dict(n.attrs)))
                self.open.append(self.active[i])

    def text(self, data: str) -> None:
        if not data:
            return
        if not self.in_body:
            if not data.strip():
                return
            self.start_body()
        self.reopen()
        last = self.open[-1].children[-1] if self.open[-1].children else None
        if last is not None and last.tag is None:
            last.text += data
        else:
            self.open[-1].append(Node(None, text=data))

    def start(self, tag: str, attrs: dict[str, str], raw: str | None) -> None:
        if tag in ("html", "head", "body"):
            own = {"html": self.root, "head": self.head, "body": self.body}[tag]
            for k, v in attrs.items():
                own.attrs.setdefault(k, v)
            if tag == "body":
                self.start_body()
            return
        if not self.in_body:
            if tag in HEAD:
                n = self.head.append(Node(tag, attrs))
                if raw is not None:
                    n.append(Node(None, text=raw))
                return
            self.start_body()
        if tag in ENDS:
            ends, stop = ENDS[tag]
            while self.has(ends, stop | {"body"}):
                self.pop_to(ends)
        if tag in CLOSE_P and self.has({"p"}):
            self.pop_to({"p"})
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456" and re.fullmatch("h[1-6]", self.open[-1].tag):
            self.open.pop()
        if tag in ("a", "nobr"):
            for n in [n for n in self.active if n.tag == tag]:
                self.end(tag)
                self.active = [x for x in self.active if x is not n]
        for around in WITHIN.get(tag, ()):  # table parts that a page may leave out
            if self.open[-1].tag in around[1]:
                self.open.append(self.open[-1].append(Node(around[0])))
        if tag not in CLOSE_P and tag not in ENDS:
            self.reopen()
        n = self.open[-1].append(Node(tag, attrs))
        if tag in VOID:
            return
        if raw is not None:
            if raw:
                n.append(Node(None, text=raw))
            return
        self.open.append(n)
        if tag in FORMATTING:
            self.active.append(n)
            same = [x for x in self.active if x.tag == tag and x.attrs == attrs]
            if len(same) > 3:
                self.active = [x for x in self.active if x is not same[0]]

    def end(self, tag: str) -> None:
        if tag in ("html", "head", "body") or not self.in_body:
            return
        if tag == "p" and not self.has({"p"}):
            self.open[-1].append(Node("p"))
            return
        if tag == "br":
            self.start("br", {}, None)
            return
        if tag in FORMATTING:
            for i in range(len(self.active) - 1, -1, -1):
                if self.active[i].tag == tag:
                    del self.active[i]
                    break
            for i in range(len(self.open) - 1, 1, -1):
                if self.open[i].tag == tag:
                    del self.open[i:]
                    return
                if self.open[i].tag in SCOPE or self.open[i].tag in CLOSE_P:
                    return
            return
        for i in range(len(self.open) - 1, 1, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in SCOPE and tag not in ("table", "td", "th", "tr", "tbody", "thead", "tfoot"):
                return


def parse(html: str | None) -> Node:
    """The tree of a page; null and empty texts give an empty body."""
    b, text, at = Builder(), html or "", 0
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\x00", "")
    while at < len(text):
        lt = text.find("<", at)
        if lt < 0:
            b.text(unescape(text[at:]))
            break
        m = TAG.match(text, lt)
        if m is None:
            more = text.find("<", lt + 1)
            cut = len(text) if more < 0 else more
            b.text(unescape(text[at:cut]))
            at = cut
            continue
        if lt > at:
            b.text(unescape(text[at:lt]))
        at = m.end()
        if m["name"] is None:
            continue
        tag = m["name"].lower()
        if m["close"]:
            b.end(tag)
            continue
        raw = None
        if tag in RAW or tag in RCDATA:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(text, at)
            raw, at = (text[at : stop.start()], stop.end()) if stop else (text[at:], len(text))
            if tag in RCDATA:
                raw = unescape(raw)
        b.start(tag, attributes(m["attrs"]) if m["attrs"].strip() else {}, raw)
    b.start_body()
    return b.root
