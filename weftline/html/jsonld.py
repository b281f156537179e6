"""JSON-LD objects of a page and the values of a dotted path in them."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html import unescape

from .tree import Node


def objects(root: Node) -> tuple[list[dict], list[str]]:
    """Every object of every ld+json script, parents first and keys sorted, and a warning for each script that isn't JSON."""
    out: list[dict] = []
    warnings: list[str] = []
    for n in root.elements():
        if n.tag != "script" or n.get("type") != "application/ld+json":
            continue
        try:
            stack = [json.loads(n.content())]
        except ValueError:
            warnings.append("bad JSON-LD")
            continue
        while stack:
            v = stack.pop()
            if isinstance(v, dict):
                out.append(v)
                stack.extend(v[k] for k in sorted(v, reverse=True))
            elif isinstance(v, list):
                stack.extend(reversed(v))
    return out, warnings


def has_type(obj: dict, name: str) -> bool:
    kind = obj.get("@type")
    return kind == name or isinstance(kind, list) and name in kind


def _number(v: int | float) -> str:
    return str(int(v)) if float(v).is_integer() and abs(v) < 1e21 else repr(v)


def leaf(v: object) -> Iterator[str]:
    """Texts of a value: strings, numbers, list members, and an object's url, name, @id or @value."""
    if isinstance(v, str):
        text = unescape(v)
        if text.strip():
            yield text
    elif isinstance(v, bool) or v is None:
        return
    elif isinstance(v, (int, float)):
        yield _number(v)
    elif isinstance(v, list):
        for x in v:
            yield from leaf(x)
    elif isinstance(v, dict):
        for key in ("url", "name", "@id", "@value"):
            if got := list(leaf(v.get(key))):
                yield got[0]
                return


def path(v: object, steps: list[str]) -> Iterator[str]:
    """Texts at a dotted path; lists fan out anywhere on the way."""
    if isinstance(v, list):
        for x in v:
            yield from path(x, steps)
    elif not steps:
        yield from leaf(v)
    elif isinstance(v, dict) and steps[0] in v:
        yield from path(v[steps[0]], steps[1:])
