"""CSS selectors: compiled once, matched from right to left."""

from __future__ import annotations

import re
from functools import lru_cache

from pagelake.html.tree import Node

IDENT = r"(?:[-\w\u0080-￿]|\\.)+"
TOKEN = re.compile(
    rf"""(?P<id>\#{IDENT})|(?P<cls>\.{IDENT})|(?P<attr>\[\s*({IDENT}(?::{IDENT})?)\s*(?:([~|^$*!]?=)\s*("[^"]*"|'[^']*'|[^\]\s]+)\s*([iIsS])?)?\s*\])|(?P<pseudo>::?({IDENT}))|(?P<tag>\*|{IDENT})|(?P<comb>\s*[>+~]\s*|\s+)""", re.X
)


class SelectorError(ValueError):
    pass


def _args(s: str, i: int) -> tuple[str, int]:
    """The text within the parentheses that open at i, and where they end."""
    depth, j, quote = 0, i, ""
    while j < len(s):
        c = s[j]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return s[i + 1 : j], j + 1
        j += 1
    raise SelectorError(f"unclosed ( in {s!r}")


def _split(s: str) -> list[str]:
    out, depth, last, quote = [], 0, 0, ""
    for i, c in enumerate(s):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and not depth:
            out.append(s[last:i])
            last = i + 1
    return [*out, s[last:]]


def _nth(arg: str):
    a = arg.replace(" ", "").lower()
    if a in ("odd", "even"):
        return (2, 1) if a == "odd" else (2, 0)
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", a)
    if not m:
        raise SelectorError(f"bad nth {arg!r}")
    if m[3]:
        return 0, int(m[3])
    return int(m[1] + "1" if m[1] in ("", "+", "-") else m[1]), int(m[2] or 0)


def _is_nth(n: int, ab) -> bool:
    a, b = ab
    return n == b if not a else (n - b) % a == 0 and (n - b) // a >= 0


def _siblings(n: Node, same: bool = False) -> list[Node]:
    if n.parent is None:
        return [n]
    return [c for c in n.parent.elements() if not same or c.tag == n.tag]


def _pseudo(name: str, arg: str | None):
    if name in ("not", "is", "where", "matches"):
        inner = compile_selector(arg)
        return (lambda n, s: not inner.matches(n, s)) if name == "not" else inner.matches
    if name == "has":
        relative = compile_selector(",".join(x if re.match(r"\s*[>+~]", x) else f" {x.strip()}" for x in _split(arg)), True)
        return lambda n, s: relative.within(n)
    if name == "contains":
        text = arg.strip().strip("\"'")
        return lambda n, s: text in n.text()
    if name in ("first-child", "last-child", "only-child", "first-of-type", "last-of-type", "only-of-type"):
        same = name.endswith("of-type")

        def edge(n, s):
            sib = _siblings(n, same)
            return (not name.startswith(("first", "only")) or sib[0] is n) and (not name.startswith(("last", "only")) or sib[-1] is n)

        return edge
    if name in ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type"):
        ab, same, back = _nth(arg), name.endswith("of-type"), "last" in name

        def nth(n, s):
            sib = _siblings(n, same)
            return _is_nth((sib[::-1] if back else sib).index(n) + 1, ab)

        return nth
    simple = {
        "empty": lambda n, s: not any(c.is_element or c.tag == "#text" for c in n.children),
        "root": lambda n, s: n.parent is not None and n.parent.tag == "#document",
        "scope": lambda n, s: n is s,
        "checked": lambda n, s: "checked" in n.attrs or "selected" in n.attrs,
        "disabled": lambda n, s: "disabled" in n.attrs,
    }
    if name not in simple:
        raise SelectorError(f"unknown :{name}")
    return simple[name]


def _attribute(name, op, value, flag):
    fold = (flag or "").lower() == "i"
    value = value if value is None else value[1:-1] if value[:1] in "\"'" else value
    want = value.lower() if fold and value else value
    tests = {
        "=": lambda v: v == want, "~=": lambda v: want in v.split(), "|=": lambda v: v == want or v.startswith(want + "-"), "^=": lambda v: bool(want) and v.startswith(want),
        "$=": lambda v: bool(want) and v.endswith(want), "*=": lambda v: bool(want) and want in v, "!=": lambda v: v != want,
    }

    def test(n, s):
        v = n.attrs.get(name.lower())
        if op is None or v is None:
            return v is not None if op is None else op == "!="
        return tests[op](v.lower() if fold else v)

    return test


class Selector:
    def __init__(self, chains, tag: str | None = None):
        self.chains = chains  # each: [(combinator before, [tests])]
        self.tag = tag  # of a selector that is the name of an element and nothing else

    def matches(self, n: Node, scope: Node | None = None) -> bool:
        return n.is_element and any(self._chain(c, len(c) - 1, n, scope) for c in self.chains)

    def _chain(self, chain, i, n, scope) -> bool:
        comb, tests = chain[i]
        if not all(t(n, scope) for t in tests):
            return False
        if i == 0:
            return True
        if comb in (" ", ">"):
            p = n.parent
            while p is not None and p.is_element:
                if self._chain(chain, i - 1, p, scope):
                    return True
                if comb == ">":
                    return False
                p = p.parent
            return False
        sib = _siblings(n)
        before = sib[: sib.index(n)]
        return any(self._chain(chain, i - 1, b, scope) for b in (before[-1:] if comb == "+" else before))

    def within(self, n: Node) -> bool:
        """For :has: whether a node related to n matches; the first step of a chain is n itself."""
        pool = [*n.walk(), *(_siblings(n) if n.parent else [])]
        return any(c.is_element and any(self._chain(chain, len(chain) - 1, c, n) for chain in self.chains) for c in pool)

    def select(self, root: Node) -> list[Node]:
        if self.tag:
            return [n for n in root.walk() if n.tag == self.tag]
        return [n for n in root.walk() if n.is_element and self.matches(n, root)]


@lru_cache(500)
def compile_selector(source: str, relative: bool = False) -> Selector:
    chains = []
    for part in _split(source):
        text = part.rstrip() if relative else part.strip()
        if not text.strip():
            raise SelectorError(f"empty selector in {source!r}")
        chain, tests, comb, i = ([(None, [lambda n, s: n is s])], [], " ", 0) if relative else ([], [], None, 0)
        while i < len(text):
            m = TOKEN.match(text, i)
            if not m:
                raise SelectorError(f"can't read {text[i:]!r} in {source!r}")
            i = m.end()
            kind = m.lastgroup
            un = lambda v: re.sub(r"\\(.)", r"\1", v)
            if m["comb"] is not None:
                if tests:
                    chain.append((comb, tests))
                tests, comb = [], m["comb"].strip() or " "
            elif m["id"]:
                v = un(m["id"][1:])
                tests.append(lambda n, s, v=v: n.attrs.get("id") == v)
            elif m["cls"]:
                v = un(m["cls"][1:])
                tests.append(lambda n, s, v=v: v in n.attrs.get("class", "").split())
            elif m["attr"]:
                tests.append(_attribute(*m.group(4, 5, 6, 7)))
            elif m["pseudo"]:
                arg = None
                if text[i : i + 1] == "(":
                    arg, i = _args(text, i)
                tests.append(_pseudo(m["pseudo"].lstrip(":").lower(), arg))
            elif m["tag"] != "*":
                tests.append(lambda n, s, v=m["tag"].lower(): n.tag == v)
            else:
                tests.append(lambda n, s: True)
            del kind
        if not tests:
            raise SelectorError(f"{source!r} ends with a combinator")
        chain.append((comb, tests))
        chains.append(chain)
    return Selector(chains, source.strip().lower() if not relative and re.fullmatch(r"\s*[a-zA-Z][a-zA-Z0-9]*\s*", source) else None)
