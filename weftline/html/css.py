"""CSS selectors over the tree: types, classes, ids, attributes, combinators, groups and the usual pseudo-classes.

Anything else raises SelectorError when it is compiled, so that a typing error never
becomes a selector that silently matches nothing.
"""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable

from .tree import Node

Test = Callable[[Node], bool]
_IDENT = r"(?:[-_a-zA-Z\u0080-\U0010ffff]|\\.)(?:[-_a-zA-Z0-9\u0080-\U0010ffff]|\\.)*"
_ATTR = re.compile(rf"\[\s*({_IDENT})\s*(?:([~|^$*!]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|({_IDENT}|[^\]\s]+))\s*([iIsS])?\s*)?\]")
_NTH = re.compile(r"\s*(?:(odd|even)|([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))\s*$")


class SelectorError(ValueError):
    pass


def _elements(n: Node) -> list[Node]:
    return [c for c in n.parent.children if c.tag is not None] if n.parent is not None else [n]


def _unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s)


def _attribute(name: str, op: str | None, want: str, fold: bool) -> Test:
    name = name.lower()
    if fold:
        want = want.lower()

    def test(n: Node) -> bool:
        if name not in n.attrs:
            return op == "!="
        have = n.attrs[name].lower() if fold else n.attrs[name]
        if op is None:
            return True
        if op == "=":
            return have == want
        if op == "!=":
            return have != want
        if op == "~=":
            return bool(want) and want in have.split()
        if op == "|=":
            return have == want or have.startswith(want + "-")
        if not want:
            return False
        return have.startswith(want) if op == "^=" else have.endswith(want) if op == "$=" else want in have

    return test


def _nth(arg: str, same_type: bool, last: bool) -> Test:
    m = _NTH.match(arg)
    if not m:
        raise SelectorError(f"bad position {arg!r}")
    if m[1]:
        a, b = 2, 1 if m[1] == "odd" else 0
    elif m[5]:
        a, b = 0, int(m[5])
    else:
        a = int(m[2] + "1") if m[2] in ("", "+", "-") else int(m[2])
        b = int((m[3] or "+") + (m[4] or "0"))

    def test(n: Node) -> bool:
        own = [x for x in _elements(n) if not same_type or x.tag == n.tag]
        at = next(i for i, x in enumerate(own) if x is n)
        k = (len(own) - at if last else at + 1) - b
        return k == 0 if a == 0 else k % a == 0 and k // a >= 0

    return test


class _Parser:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self, why: str) -> SelectorError:
        return SelectorError(f"selector {self.text!r}: {why} at {self.at}")

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def space(self) -> bool:
        was = self.at
        while self.peek().isspace():
            self.at += 1
        return self.at > was

    def ident(self) -> str:
        m = re.compile(_IDENT).match(self.text, self.at)
        if not m:
            raise self.fail("expected a name")
        self.at = m.end()
        return _unescape(m[0])

    def argument(self) -> str:
        if self.peek() != "(":
            raise self.fail("expected (")
        depth, start, quote = 0, self.at + 1, ""
        while self.at < len(self.text):
            ch = self.text[self.at]
            if quote:
                quote = "" if ch == quote else quote
            elif ch in "\"'":
                quote = ch
            elif ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
                if not depth:
                    self.at += 1
                    return self.text[start : self.at - 1]
            self.at += 1
        raise self.fail("missing )")

    def pseudo(self) -> Test:
        name = self.ident().lower()
        if name == "not":
            inner = compile_selector(self.argument())
            return lambda n: not inner.matches(n)
        if name in ("is", "where", "matches"):
            inner = compile_selector(self.argument())
            return inner.matches
        if name == "has":
            arg = self.argument().strip()
            if arg[:1] in (">", "+", "~"):
                inner = compile_selector(arg[1:])
                if arg[0] == ">":
                    return lambda n: any(inner.matches(c) for c in n.children if c.tag is not None)
                return lambda n: any(inner.matches(c) for c in _after(n, arg[0] == "+"))
            inner = compile_selector(arg)
            return lambda n: any(x is not n and inner.matches(x) for x in n.elements())
        if name in ("contains", "-soup-contains"):
            want = self.argument().strip().strip("\"'")
            return lambda n: want in n.content()
        if m := re.fullmatch(r"nth-(last-)?(child|of-type)", name):
            return _nth(self.argument(), m[2] == "of-type", bool(m[1]))
        if m := re.fullmatch(r"(first|last|only)-(child|of-type)", name):
            own = m[2] == "of-type"
            tests = [_nth("1", own, last) for last in {"first": (False,), "last": (True,), "only": (False, True)}[m[1]]]
            return lambda n: all(t(n) for t in tests)
        if name == "empty":
            return lambda n: not any(c.tag is not None or c.text for c in n.children)
        if name == "root":
            return lambda n: n.parent is None
        raise self.fail(f"unsupported pseudo-class :{name}")

    def compound(self) -> Test:
        tests: list[Test] = []
        if self.peek() == "*":
            self.at += 1
            tests.append(lambda n: True)
        elif re.compile(_IDENT).match(self.text, self.at):
            tag = self.ident().lower()
            tests.append(lambda n: n.tag == tag)
        while (ch := self.peek()) in (".", "#", "[", ":") and ch:
            if ch == ".":
                self.at += 1
                tests.append((lambda c: lambda n: c in n.get("class").split())(self.ident()))
            elif ch == "#":
                self.at += 1
                tests.append((lambda c: lambda n: n.get("id") == c)(self.ident()))
            elif ch == "[":
                m = _ATTR.match(self.text, self.at)
                if not m:
                    raise self.fail("bad attribute test")
                self.at = m.end()
                tests.append(_attribute(_unescape(m[1]), m[2], next((g for g in m.groups()[2:5] if g is not None), ""), (m[6] or "").lower() == "i"))
            else:
                self.at += 1
                if self.peek() == ":":
                    raise self.fail("pseudo-elements select nothing")
                tests.append(self.pseudo())
        if not tests:
            raise self.fail("expected a selector")
        return tests[0] if len(tests) == 1 else lambda n: all(t(n) for t in tests)

    def complex(self) -> Test:
        self.space()
        test = self.compound()
        while True:
            gap = self.space()
            ch = self.peek()
            if ch in (">", "+", "~") and ch:
                self.at += 1
                self.space()
            elif not ch or ch == ",":
                return test
            elif gap:
                ch = " "
            else:
                raise self.fail(f"unexpected {ch!r}")
            test = _combined(test, ch, self.compound())

    def group(self) -> list[Test]:
        out = [self.complex()]
        while self.peek() == ",":
            self.at += 1
            out.append(self.complex())
        if self.at < len(self.text):
            raise self.fail(f"unexpected {self.peek()!r}")
        return out


def _after(n: Node, only_next: bool) -> list[Node]:
    own = _elements(n)
    at = next(i for i, x in enumerate(own) if x is n)
    return own[at + 1 : at + 2] if only_next else own[at + 1 :]


def _combined(left: Test, how: str, right: Test) -> Test:
    def up(n: Node) -> bool:
        p = n.parent
        while p is not None:
            if left(p):
                return True
            p = p.parent
        return False

    def beside(n: Node) -> bool:
        own = _elements(n)
        at = next(i for i, x in enumerate(own) if x is n)
        return any(left(x) for x in (own[at - 1 : at] if how == "+" else own[:at]))

    if how == " ":
        return lambda n: right(n) and up(n)
    if how == ">":
        return lambda n: right(n) and n.parent is not None and left(n.parent)
    return lambda n: right(n) and beside(n)


class Selector:
    def __init__(self, raw: str):
        self.raw = raw
        self.tests = _Parser(raw.strip()).group()

    def matches(self, n: Node) -> bool:
        return n.tag is not None and any(t(n) for t in self.tests)

    def select(self, root: Node) -> list[Node]:
        """Matches below ``root`` in document order."""
        return [n for n in root.elements() if n is not root and self.matches(n)]

    def first(self, root: Node) -> Node | None:
        return next((n for n in root.elements() if n is not root and self.matches(n)), None)

    def outermost(self, root: Node) -> list[Node]:
        """Matches that have no match above them."""
        out, stack = [], list(reversed(root.children))
        while stack:
            n = stack.pop()
            if self.matches(n):
                out.append(n)
            else:
                stack.extend(reversed(n.children))
        return out


def compile_selector(raw: str) -> Selector:
    """A selector, compiled once a process; the cache isn't part of what travels to executors."""
    known = sys.modules.setdefault("_weftline_selectors", types.ModuleType("_weftline_selectors")).__dict__
    if raw not in known:
        known[raw] = Selector(raw)
    return known[raw]
