"""XPath 1.0 over the HTML tree, with a few string functions of later versions.

One rule differs from the standard, as in the reference: a predicate of a step is applied to the step's merged candidates
in document order, not per context node, so //li[1] is the first li of the document.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

from pagelake.html.tree import Node

LEX = re.compile(r"""\s*(?:(?P<num>\d+(?:\.\d*)?|\.\d+)|(?P<str>"[^"]*"|'[^']*')|(?P<op>::|//|\.\.|!=|<=|>=|[/.@\[\]()|+\-=<>,*])|(?P<name>[A-Za-z_][\w.\-]*(?::(?!:)[A-Za-z_][\w.\-]*)?))""")
LEVELS = [("or",), ("and",), ("=", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "div", "mod")]
AXES = "child descendant descendant-or-self parent ancestor ancestor-or-self following-sibling preceding-sibling following preceding self attribute namespace".split()


class XPathError(ValueError):
    pass


class Attr:
    """An attribute node."""

    __slots__ = ("name", "value", "parent")

    def __init__(self, name, value, parent):
        self.name, self.value, self.parent = name, value, parent


def lex(s: str) -> list[tuple[str, str]]:
    out, i = [], 0
    s = s.rstrip()
    while i < len(s):
        m = LEX.match(s, i)
        if not m:
            raise XPathError(f"can't read {s[i:]!r}")
        i, kind = m.end(), m.lastgroup
        value = m[kind]
        # after an operand, * and names are operators
        operand = bool(out) and (out[-1][0] in ("num", "str", "name") or out[-1][1] in (")", "]", ".", "..") or out[-1] == ("star", "*"))
        if kind == "op" and value == "*":
            kind = "op" if operand else "star"
        elif kind == "name" and operand and value in ("or", "and", "div", "mod"):
            kind = "op"
        out.append((kind, value))
    return [*out, ("end", "")]


class Parser:
    def __init__(self, source: str):
        self.t, self.i = lex(source), 0

    def peek(self, *values):
        return self.t[self.i][0] == "op" and self.t[self.i][1] in values

    def take(self, *values):
        if self.peek(*values):
            self.i += 1
            return self.t[self.i - 1][1]
        return None

    def need(self, value):
        if not self.take(value):
            raise XPathError(f"expected {value!r}, found {self.t[self.i][1]!r}")

    def parse(self):
        e = self.binary(0)
        if self.t[self.i][0] != "end":
            raise XPathError(f"unexpected {self.t[self.i][1]!r}")
        return e

    def binary(self, level):
        if level == len(LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while op := self.take(*LEVELS[level]):
            left = ("bin", op, left, self.binary(level + 1))
        return left

    def unary(self):
        if self.take("-"):
            return ("neg", self.unary())
        left = self.path()
        while self.take("|"):
            left = ("union", left, self.path())
        return left

    def path(self):
        kind, value = self.t[self.i]
        call = kind == "name" and self.t[self.i + 1] == ("op", "(") and value not in ("node", "text", "comment", "processing-instruction")
        if kind in ("num", "str") or call or (kind == "op" and value == "("):
            base = self.primary()
            predicates = self.predicates()
            steps = self.steps() if self.peek("/", "//") else []
            return ("filter", base, predicates, steps) if predicates or steps else base
        if self.peek("/", "//"):
            root_only = self.peek("/") and not self._step_begins(self.i + 1)
            if root_only:
                self.i += 1
                return ("path", True, [])
            return ("path", True, self.steps())
        return ("path", False, [self.step(), *(self.steps() if self.peek("/", "//") else [])])

    def _step_begins(self, i):
        kind, value = self.t[i]
        return kind in ("name", "star") or kind == "op" and value in ("@", ".", "..")

    def primary(self):
        kind, value = self.t[self.i]
        self.i += 1
        if kind == "num":
            return ("lit", float(value))
        if kind == "str":
            return ("lit", value[1:-1])
        if kind == "op":
            e = self.binary(0)
            self.need(")")
            return e
        self.need("(")
        args = []
        if not self.peek(")"):
            args.append(self.binary(0))
            while self.take(","):
                args.append(self.binary(0))
        self.need(")")
        if value not in FUNCTIONS:
            raise XPathError(f"unknown function {value}()")
        return ("call", value, args)

    def predicates(self):
        out = []
        while self.take("["):
            out.append(self.binary(0))
            self.need("]")
        return out

    def steps(self):
        out = []
        while op := self.take("/", "//"):
            if op == "//":
                out.append(("descendant-or-self", "node()", []))
            out.append(self.step())
        return out

    def step(self):
        if self.take("."):
            return ("self", "node()", [])
        if self.take(".."):
            return ("parent", "node()", [])
        axis = "child"
        if self.take("@"):
            axis = "attribute"
        elif self.t[self.i][0] == "name" and self.t[self.i + 1] == ("op", "::"):
            axis = self.t[self.i][1]
            if axis not in AXES:
                raise XPathError(f"unknown axis {axis}")
            self.i += 2
        kind, value = self.t[self.i]
        if kind not in ("name", "star"):
            raise XPathError(f"expected a node test, found {value!r}")
        self.i += 1
        if kind == "name" and self.take("("):
            if self.t[self.i][0] == "str":
                self.i += 1
            self.need(")")
            value += "()"
        return (axis, value if kind == "star" else value.lower(), self.predicates())


def string_value(n) -> str:
    return n.value if isinstance(n, Attr) else n.text()


def to_string(v) -> str:
    if isinstance(v, list):
        return string_value(v[0]) if v else ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        if math.isinf(v):
            return "Infinity" if v > 0 else "-Infinity"
        return str(int(v)) if v == int(v) else repr(v)
    return v


def to_number(v) -> float:
    if isinstance(v, (bool, float)):
        return float(v)
    s = to_string(v).strip()
    return float(s) if re.fullmatch(r"-?(\d+\.?\d*|\.\d+)", s) else math.nan


def to_boolean(v) -> bool:
    if isinstance(v, float):
        return v != 0 and not math.isnan(v)
    return bool(v)


def order(n):
    return (n.parent.order, 1, list(n.parent.attrs).index(n.name)) if isinstance(n, Attr) else (n.order, 0, 0)


def ordered(nodes: list) -> list:
    seen, out = set(), []
    for n in nodes:
        k = (id(n.parent), n.name) if isinstance(n, Attr) else id(n)
        if k not in seen:
            seen.add(k)
            out.append(n)
    return sorted(out, key=order)


def _up(n):
    while n.parent is not None:
        n = n.parent
        yield n


def axis_nodes(n, axis):
    if isinstance(n, Attr):
        if axis in ("parent", "ancestor", "ancestor-or-self", "self"):
            own = [n] if axis in ("self", "ancestor-or-self") else []
            return own + ([n.parent] if axis == "parent" else [n.parent, *_up(n.parent)] if axis.startswith("ancestor") else [])
        return []
    if axis == "child":
        return n.children
    if axis == "self":
        return [n]
    if axis.startswith("descendant"):
        return ([n] if axis.endswith("self") else []) + list(n.walk())
    if axis == "parent":
        return [n.parent] if n.parent else []
    if axis.startswith("ancestor"):
        return ([n] if axis.endswith("self") else []) + list(_up(n))
    if axis == "attribute":
        return [Attr(k, v, n) for k, v in n.attrs.items()]
    if axis == "namespace" or n.parent is None:
        return []
    sib = n.parent.children
    at = next(i for i, c in enumerate(sib) if c is n)
    if axis == "following-sibling":
        return sib[at + 1 :]
    if axis == "preceding-sibling":
        return sib[:at]
    root = [*_up(n)][-1]
    inside = {id(x) for x in n.walk()}
    above = {id(x) for x in _up(n)}
    if axis == "following":
        return [x for x in root.walk() if x.order > n.order and id(x) not in inside]
    return [x for x in root.walk() if x.order < n.order and id(x) not in above]


def passes(n, test, axis) -> bool:
    if test == "node()":
        return True
    if isinstance(n, Attr):
        return test == "*" or n.name == test or n.name.split(":")[-1] == test
    if test == "text()":
        return n.tag == "#text"
    if test == "comment()":
        return n.tag == "#comment"
    return n.is_element and (test == "*" or n.tag == test or n.tag.split(":")[-1] == test.split(":")[-1])


def compare(op, a, b) -> bool:
    if isinstance(a, list) or isinstance(b, list):
        if isinstance(a, bool) or isinstance(b, bool):
            return compare(op, to_boolean(a), to_boolean(b))
        many = lambda v: [string_value(n) for n in v] if isinstance(v, list) else [v]
        return any(compare(op, x, y) for x in many(a) for y in many(b))
    if op in ("=", "!="):
        if isinstance(a, bool) or isinstance(b, bool):
            same = to_boolean(a) == to_boolean(b)
        elif isinstance(a, float) or isinstance(b, float):
            same = to_number(a) == to_number(b)
        else:
            same = a == b
        return same == (op == "=")
    x, y = to_number(a), to_number(b)
    return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def _round(x: float) -> float:
    return x if math.isnan(x) or math.isinf(x) else float(math.floor(x + 0.5))


def _substring(s, start, length=None):
    a = _round(to_number(start))
    b = math.inf if length is None else a + _round(to_number(length))
    return "".join(c for i, c in enumerate(to_string(s), 1) if i >= a and i < b)


def _translate(s, a, b):
    a, b = to_string(a), to_string(b)
    m = {}
    for i, c in enumerate(a):
        m.setdefault(c, b[i] if i < len(b) else "")
    return "".join(m.get(c, c) for c in to_string(s))


def _matches(s, p, flags=""):
    try:
        return re.search(to_string(p), to_string(s), sum(getattr(re, f.upper(), 0) for f in to_string(flags) if f in "ims")) is not None
    except re.error:
        return False


def _arith(f):
    return lambda x: f(to_number(x)) if math.isfinite(to_number(x)) else to_number(x)


FUNCTIONS = {
    "count": lambda v: float(len(v)),
    "concat": lambda *v: "".join(map(to_string, v)),
    "starts-with": lambda a, b: to_string(a).startswith(to_string(b)),
    "ends-with": lambda a, b: to_string(a).endswith(to_string(b)),
    "contains": lambda a, b: to_string(b) in to_string(a),
    "substring-before": lambda a, b: to_string(a).partition(to_string(b))[0] if to_string(b) in to_string(a) else "",
    "substring-after": lambda a, b: to_string(a).partition(to_string(b))[2] if to_string(b) else to_string(a),
    "substring": _substring,
    "translate": _translate,
    "lower-case": lambda v: to_string(v).lower(),
    "upper-case": lambda v: to_string(v).upper(),
    "matches": _matches,
    "boolean": to_boolean,
    "not": lambda v: not to_boolean(v),
    "true": lambda: True,
    "false": lambda: False,
    "sum": lambda v: float(sum(to_number(string_value(n)) for n in v)),
    "floor": _arith(lambda x: float(math.floor(x))),
    "ceiling": _arith(lambda x: float(math.ceil(x))),
    "round": lambda v: _round(to_number(v)),
}
#: functions that default to the context node
CONTEXT = {
    "string": to_string, "number": to_number, "string-length": lambda v: float(len(to_string(v))), "normalize-space": lambda v: " ".join(to_string(v).split()),
    "name": lambda v: "" if not v else v[0].name if isinstance(v[0], Attr) else v[0].tag.lstrip("#") if v[0].is_element else "",
    "namespace-uri": lambda v: "",
}
CONTEXT["local-name"] = lambda v: CONTEXT["name"](v).split(":")[-1]
FUNCTIONS |= CONTEXT | {"last": None, "position": None}


def evaluate(e, node, position: int = 1, size: int = 1):
    kind = e[0]
    if kind == "lit":
        return e[1]
    if kind == "neg":
        return -to_number(evaluate(e[1], node, position, size))
    if kind == "bin":
        op, a = e[1], evaluate(e[2], node, position, size)
        if op in ("or", "and"):
            if to_boolean(a) == (op == "or"):
                return op == "or"
            return to_boolean(evaluate(e[3], node, position, size))
        b = evaluate(e[3], node, position, size)
        if op in ("=", "!=", "<", "<=", ">", ">="):
            return compare(op, a, b)
        x, y = to_number(a), to_number(b)
        if op in ("div", "mod") and y == 0:
            return math.nan if op == "mod" or x == 0 or math.isnan(x) else math.copysign(math.inf, x)
        return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "div": lambda: x / y, "mod": lambda: math.fmod(x, y)}[op]()
    if kind == "union":
        a, b = evaluate(e[1], node, position, size), evaluate(e[2], node, position, size)
        if not (isinstance(a, list) and isinstance(b, list)):
            raise XPathError("| joins node-sets")
        return ordered(a + b)
    if kind == "call":
        name = e[1]
        if name in ("last", "position"):
            return float(size if name == "last" else position)
        args = [evaluate(a, node, position, size) for a in e[2]]
        if name in CONTEXT and not args:
            args = [[node]]
        return FUNCTIONS[name](*args)
    if kind == "filter":
        base = evaluate(e[1], node, position, size)
        if not isinstance(base, list):
            raise XPathError("only a node-set has predicates and steps")
        for p in e[2]:
            base = kept(base, p)
        return _steps(base, e[3])
    root = node
    if e[1]:
        root = node.parent if isinstance(node, Attr) else node
        root = [root, *_up(root)][-1]
    return _steps([root], e[2])


def kept(nodes, predicate):
    out = []
    for i, n in enumerate(nodes, 1):
        v = evaluate(predicate, n, i, len(nodes))
        if (v == i) if isinstance(v, float) else to_boolean(v):
            out.append(n)
    return out


def _steps(nodes, steps):
    for axis, test, predicates in steps:
        found = ordered([m for n in nodes for m in axis_nodes(n, axis) if passes(m, test, axis)])
        for p in predicates:
            found = kept(found, p)
        nodes = found
    return nodes


@lru_cache(500)
def compile_xpath(source: str):
    return Parser(source).parse()


def xpath(source: str, node: Node):
    return evaluate(compile_xpath(source.removeprefix("xpath:").strip()), node)


def xpath_strings(source: str, node: Node) -> list[str]:
    v = xpath(source, node)
    return [string_value(n) for n in v] if isinstance(v, list) else [to_string(v)]


def is_xpath(s: str) -> bool:
    return bool(re.match(r"\s*(xpath:|/|\(/|\.\.?/|(?:" + "|".join(AXES) + ")::)", s))


def validate_xpath(source: str) -> str | None:
    """What is wrong with an expression, or None."""
    try:
        compile_xpath(source.removeprefix("xpath:").strip())
    except XPathError as e:
        return str(e)
    return None
