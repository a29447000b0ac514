"""Readers of a parsed page: title, text, meta, links, structured data, tables."""

from __future__ import annotations

import json
import re
from functools import cached_property

from pagelake.functions.urls import resolve_text
from pagelake.html.css import compile_selector
from pagelake.html.tree import BLOCK, Node, parse_html
from pagelake.html.xpath import Attr, is_xpath, string_value, to_string, xpath

HIDDEN = frozenset("canvas iframe noscript script style svg template".split())
LINES = BLOCK | frozenset("br li tr td th dt dd caption figcaption option tbody thead tfoot".split())
NEXT = ["a[rel~=next]", "link[rel~=next]", ".pagination a.next", ".pager .next a", "li.next > a", "a.next", "a.next-page", "a.pagination-next", "[aria-label='Next'] ", "a[aria-label*='next' i]"]
NEXT_WORDS = frozenset("next|next page|older|older posts|more|load more|»|›|→|>|suivant|siguiente|weiter|nächste|próximo|successivo|volgende|次へ|下一页|далее".split("|"))


class Page:
    def __init__(self, html: str | None, url: str | None = None, closed: bool = False):
        """closed: only character references that end in a semicolon are read."""
        self.html, self.url = html or "", url or ""
        self.doc = parse_html(self.html, closed)

    @cached_property
    def base(self) -> str:
        base = next((n.attrs.get("href") for n in self.select("base[href]")), None)
        return (resolve_text(base, self.url) if base else None) or self.url

    def resolve(self, href):
        return resolve_text(href, self.base)

    def select(self, selector: str, at: Node | None = None) -> list[Node]:
        at = at or self.doc
        if is_xpath(selector):
            v = xpath(selector, at)
            return [n for n in v if isinstance(n, Node) and n.is_element] if isinstance(v, list) else []
        return compile_selector(selector).select(at)

    def values(self, selector: str, at: Node | None = None) -> list[str]:
        if is_xpath(selector):
            v = xpath(selector, at or self.doc)
            return [string_value(n).strip() for n in v] if isinstance(v, list) else [to_string(v)]
        return [n.text().strip() for n in self.select(selector, at)]

    def exists(self, selector: str, at: Node | None = None) -> bool:
        if is_xpath(selector):
            v = xpath(selector, at or self.doc)
            return bool(v)
        return bool(self.select(selector, at))

    def title(self) -> str:
        for found in ([n.text() for n in self.select("title")][:1], [self.meta.get("og:title", "")], [n.text() for n in self.select("h1")][:1]):
            if found and found[0].strip():
                return found[0].strip()
        return ""

    def text(self, selector: str = "body") -> str:
        out = []
        for top in self.select(selector)[:1]:
            todo = [top]
            while todo:
                n = todo.pop()
                if isinstance(n, str):
                    out.append(n)
                elif n.tag == "#text":
                    out.append(n.data)
                elif n.is_element and n.tag not in HIDDEN:
                    if n.tag in LINES:
                        out.append("\n")
                        if n.children:
                            todo.append("\n")
                    todo += n.children[::-1]
        lines = re.sub(r"[^\S\n]+", " ", "".join(out))
        return re.sub(r"\n{3,}", "\n\n", re.sub(r" ?\n ?", "\n", lines)).strip()

    @cached_property
    def meta(self) -> dict[str, str]:
        out = {}
        for n in self.select("meta"):
            name = next((n.attrs[k] for k in ("name", "property", "itemprop", "http-equiv") if n.attrs.get(k)), None)
            if name and "content" in n.attrs:
                out[name.lower()] = n.attrs["content"]
        return out

    def open_graph(self) -> dict[str, str]:
        return {k[3:]: v for k, v in self.meta.items() if k.startswith("og:")}

    def canonical(self) -> str | None:
        return next((self.resolve(n.attrs.get("href")) for n in self.select("link[rel~=canonical]")), None)

    def links(self, selector: str = "a[href]") -> list[dict]:
        seen = {}
        for n in self.select(selector):
            u = self.resolve(n.attrs.get("href"))
            if u and u not in seen:
                seen[u] = {"url": u, "text": " ".join(n.text().split()), "rel": n.attrs.get("rel", ""), "title": n.attrs.get("title", "")}
        return list(seen.values())

    @cached_property
    def json_ld(self) -> list[dict]:
        out = []

        def add(v):
            if isinstance(v, list):
                for x in v:
                    add(x)
            elif isinstance(v, dict):
                if "@graph" in v:
                    add(v["@graph"])
                else:
                    out.append(v)

        for n in self.select("script[type='application/ld+json' i]"):
            try:
                add(json.loads(n.text()))
            except ValueError:
                continue
        return out

    def json_ld_of(self, kind: str) -> list[dict]:
        types = lambda v: [str(x).lower() for x in (v if isinstance(v, list) else [v])]
        return [b for b in self.json_ld if kind.lower() in types(b.get("@type", ""))]

    @cached_property
    def microdata(self) -> list[dict]:
        def value(n):
            if "itemscope" in n.attrs:
                return item(n)
            for tags, attr in ((("meta",), "content"), (("a", "link", "area"), "href"), (("img", "audio", "video", "source", "embed", "iframe", "track"), "src"), (("time",), "datetime"), (("data", "meter"), "value")):
                if n.tag in tags and attr in n.attrs:
                    return (self.resolve(n.attrs[attr]) or n.attrs[attr]) if attr in ("href", "src") else n.attrs[attr]
            return " ".join(n.text().split())

        def item(n):
            out = {"@type": n.attrs["itemtype"].rstrip("/").split("/")[-1]} if n.attrs.get("itemtype") else {}
            todo = n.children[::-1]
            while todo:
                c = todo.pop()
                for name in c.attrs.get("itemprop", "").split():
                    v = value(c)
                    out[name] = [*out[name], v] if isinstance(out.get(name), list) else [out[name], v] if name in out else v
                if "itemscope" not in c.attrs:
                    todo += c.children[::-1]
            return out

        return [item(n) for n in self.select("[itemscope]") if "itemprop" not in n.attrs]

    def tables(self, selector: str = "table") -> list[dict]:
        out = []
        for t in self.select(selector):
            mine = [r for r in t.walk() if r.tag == "tr" and next(a for a in _parents(r) if a.tag == "table") is t]
            cells = [[c for c in r.elements() if c.tag in ("td", "th")] for r in mine]
            text = lambda c: " ".join(c.text().split())
            head = next((i for i, r in enumerate(mine) if r.parent.tag == "thead"), None)
            if head is None and cells and cells[0] and all(c.tag == "th" for c in cells[0]):
                head = 0
            headers = []
            for c in cells[head] if head is not None else []:
                span = int(c.attrs.get("colspan", "1")) if c.attrs.get("colspan", "1").isdigit() else 1
                headers += [text(c)] + [f"{text(c)}_{k}" for k in range(2, min(span, 1000) + 1)]
            body = [i for i, r in enumerate(mine) if i != head and r.parent.tag != "thead"]
            rows = [r for r in ([text(c) for c in cells[i]] for i in body) if any(r)]
            named = lambda i: headers[i] if i < len(headers) and headers[i] else f"column_{i + 1}"
            records = [{named(i): v for i, v in enumerate(r)} for r in rows] if headers else []
            caption = next((text(c) for c in t.elements() if c.tag == "caption"), None)
            out.append({"caption": caption, "headers": headers, "rows": rows, "records": records})
        return out

    def json(self):
        try:
            return json.loads(self.html)
        except ValueError:
            return None

    def next_page(self, selector: str | None = None) -> str | None:
        """The next page: by a selector, else by the usual marks and words. Never the page itself, nor a disabled link."""
        for s in [selector] if selector else NEXT:
            for n in self.select(s)[:1]:
                off = re.search(r"\b(?:is-)?(?:disabled|inactive)\b", n.attrs.get("class", "")) or n.attrs.get("aria-disabled") == "true"
                u = None if off else self.resolve(n.attrs.get("href"))
                if u and u != self.url:
                    return u
        if selector:
            return None
        for n in self.select("a[href]"):
            if " ".join(n.text().split()).lower() in NEXT_WORDS and (u := self.resolve(n.attrs["href"])) and u != self.url:
                return u
        return None


def _parents(n):
    while n.parent is not None:
        n = n.parent
        yield n


def read(n, attr: str | None = None) -> str | None:
    """What an element gives: its text, or html, outerHTML, value or an attribute."""
    if isinstance(n, Attr):
        return n.value
    if attr in (None, "", "text", "textContent"):
        return n.text().strip()
    if attr in ("html", "innerHTML"):
        return n.html(outer=False).strip()
    if attr == "outerHTML":
        return n.html()
    return n.attrs.get(attr.lstrip("@").lower())
