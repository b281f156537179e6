"""Trees back to HTML."""

from __future__ import annotations

from .tree import RAW, VOID, Node


def escape(s: str) -> str:
    """References for markup and quotes, as feeds expect them."""
    return s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&#34;").replace("'", "&#39;")


def outer(n: Node) -> str:
    if n.tag is None:
        return n.text if n.parent is not None and n.parent.tag in RAW else escape(n.text)
    attrs = "".join(f' {k}="{escape(v)}"' for k, v in n.attrs.items())
    if n.tag in VOID:
        return f"<{n.tag}{attrs}/>"
    return f"<{n.tag}{attrs}>{inner(n)}</{n.tag}>"


def inner(n: Node) -> str:
    return "".join(outer(c) for c in n.children)
