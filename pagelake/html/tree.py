"""A light HTML tree over the standard tokenizer: implied html, head and body, void elements, optional end tags.

Approximated: formatting elements that a block leaves open aren't reopened in the next block.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("title meta link base style script noscript template".split())
BLOCK = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "thead": {"tr", "td", "th", "tbody"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}}
LIMIT = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select", "datalist"}, "optgroup": {"select"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}


class Node:
    """An element, text ('#text'), comment ('#comment') or the document ('#document')."""

    __slots__ = ("tag", "attrs", "children", "parent", "data", "order")

    def __init__(self, tag, attrs=None, data="", parent=None):
        self.tag, self.attrs, self.data, self.parent = tag, attrs or {}, data, parent
        self.children: list[Node] = []
        self.order = 0

    @property
    def is_element(self) -> bool:
        return self.tag[0] != "#"

    def elements(self):
        return [c for c in self.children if c.tag[0] != "#"]

    def walk(self):
        """Descendants in document order, without recursion."""
        todo = self.children[::-1]
        while todo:
            n = todo.pop()
            yield n
            if n.children:
                todo += n.children[::-1]

    def text(self) -> str:
        if self.tag in ("#text", "#comment"):
            return self.data
        return "".join(n.data for n in self.walk() if n.tag == "#text")

    def html(self, outer: bool = True) -> str:
        out, todo = [], [self] if outer else self.children[::-1]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag == "#text":
                raw = n.parent is not None and n.parent.tag in ("script", "style")
                out.append(n.data if raw else n.data.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
            elif n.tag == "#comment":
                out.append(f"<!--{n.data}-->")
            else:
                if n.is_element:
                    out.append(f"<{n.tag}" + "".join(f' {k}="{v.replace(chr(34), "&quot;")}"' for k, v in n.attrs.items()) + ">")
                    if n.tag not in VOID:
                        todo.append(f"</{n.tag}>")
                todo += n.children[::-1]
        return "".join(out)


#: Plain tags, as most are; the tokenizer's own, slower way reads the same from them, and all others
_START = re.compile(r"""<([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z][-a-zA-Z0-9_:]*(?:=(?:'[^'<>&]*'|"[^"<>&]*"|[^\s'"<>=`/&]+))?)*)>""")
_ATTR = re.compile(r"""[ \t\n\r\f]+([a-zA-Z][-a-zA-Z0-9_:]*)(?:=(?:'([^']*)'|"([^"]*)"|([^\s'"]+)))?""")
RAW = frozenset("script style textarea title iframe noembed noframes noscript plaintext xmp".split())
_END = re.compile(r"</([a-zA-Z][a-zA-Z0-9]*)>")


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.doc = Node("#document")
        self.html = self._new("html", {}, self.doc)
        self.head = self._new("head", {}, self.html)
        self.body = None
        self.open = [self.html, self.head]

    def updatepos(self, i, j):
        return j  # lines aren't counted

    def parse_starttag(self, i):
        m = _START.match(self.rawdata, i)
        if m is None or (tag := m[1].lower()) in RAW:
            return super().parse_starttag(i)
        self.lasttag = tag
        self.handle_starttag(tag, [(name.lower(), a or b or c) for name, a, b, c in _ATTR.findall(m[2])] if m[2] else ())
        return m.end()

    def parse_endtag(self, i):
        m = _END.match(self.rawdata, i) if self.cdata_elem is None else None
        if m is None:
            return super().parse_endtag(i)
        self.handle_endtag(m[1].lower())
        return m.end()

    def _new(self, tag, attrs, parent):
        n = Node(tag, attrs, parent=parent)
        parent.children.append(n)
        return n

    def _into_body(self):
        if self.body is None:
            self.body = self._new("body", {}, self.html)
            self.open = [self.html, self.body]

    def handle_starttag(self, tag, attrs):
        a = {}
        for k, v in attrs:
            a.setdefault(k, v or "")
        if tag in ("html", "body", "head"):
            if tag == "body":
                self._into_body()
            to = {"html": self.html, "head": self.head, "body": self.body}[tag]
            for k, v in a.items():
                to.attrs.setdefault(k, v)
            return
        if self.body is None and not (tag in HEAD and self.open[-1] is self.head):
            self._into_body()
        if tag in BLOCK:
            self._close({"p"}, {"button", "td", "th", "table", "li", "body"})
        if tag in CLOSES:
            self._close(CLOSES[tag], LIMIT[tag])
        n = self._new(tag, a, self.open[-1])
        if tag not in VOID:
            self.open.append(n)

    def _close(self, tags, limit):
        """Ends the open elements of these tags above the nearest limit."""
        for i in range(len(self.open) - 1, 1, -1):
            t = self.open[i].tag
            if t in limit:
                return
            if t in tags:
                del self.open[i:]

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "head" and self.body is None:
            self._into_body()
        if tag == "br":
            self.handle_starttag("br", [])
        for i in range(len(self.open) - 1, 1, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if self.body is None and self.open[-1] is self.head:
            if not data.strip():
                return
            self._into_body()
        last = self.open[-1].children
        if last and last[-1].tag == "#text":
            last[-1].data += data
        else:
            last.append(Node("#text", data=data, parent=self.open[-1]))

    def handle_comment(self, data):
        at = self.open[-1]
        at.children.append(Node("#comment", data=data, parent=at))


#: An ampersand that begins no closed reference, and what stands for it meanwhile: no text read from a table has it
_OPEN, _HELD = re.compile(r"&(?!(?:#[xX][0-9a-fA-F]+|#[0-9]+|[a-zA-Z][a-zA-Z0-9]*);)"), "\udc26"


def parse_html(text: str | None, closed: bool = False) -> Node:
    """The tree of a page. Character references without a semicolon (&amp) are read as in HTML; with `closed`, they stay as they are."""
    if closed and text:
        doc = parse_html(_OPEN.sub(_HELD, text))
        for n in doc.walk():
            n.data = n.data.replace(_HELD, "&")
            n.tag = n.tag.replace(_HELD, "&")
            n.attrs = {k.replace(_HELD, "&"): v.replace(_HELD, "&") for k, v in n.attrs.items()}
        return doc
    b = _Builder()
    try:
        b.feed(text or "")
        b.close()
    except AssertionError:  # the tokenizer gives up on some broken declarations: what came before stands
        pass
    b._into_body()
    for i, n in enumerate(b.doc.walk(), 1):
        n.order = i
    return b.doc
