"""Page analysis: repeated blocks, field suggestions, and a recipe made from them."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.operators.extract import sliced
from pagelake.session import ship

ANALYSIS = "struct<title:string,n_links:int,internal:int,external:int,json_ld:array<string>,n_tables:int,next_page:string,blocks:array<struct<selector:string,count:int,score:double,sample:string,has_link:boolean,has_image:boolean>>>"
HASHED = re.compile(r"(?:^|[-_])[a-z]*\d[a-z0-9]{4,}$|^(?:css|sc|jss|_)[-_]?[a-z0-9]{4,}|[A-Z].*\d.*[A-Z]|__[A-Za-z0-9]{5,}$")
SKIP = frozenset("script style link meta head html body br hr option svg path noscript".split())


def stable(name: str) -> bool:
    """Whether a class looks written by hand."""
    return bool(re.fullmatch(r"[A-Za-z_-][\w-]{1,40}", name)) and not HASHED.search(name)


def classes(n) -> list[str]:
    return [c for c in n.attrs.get("class", "").split() if stable(c)]


def selector_for(n) -> str:
    """A selector for an element by what is likely to last."""
    if n.attrs.get("id") and stable(n.attrs["id"]):
        return f"#{n.attrs['id']}"
    for a in ("data-testid", "data-test", "data-qa", "itemprop"):
        if n.attrs.get(a):
            return f'[{a}="{n.attrs[a]}"]'
    if c := classes(n)[:2]:
        return n.tag + "".join(f".{x}" for x in c)
    return f'{n.tag}[role="{n.attrs["role"]}"]' if n.attrs.get("role") else n.tag


def refined(n, page) -> str:
    """A selector whose first match is the element, qualified by ancestors, then by place."""
    s, up = selector_for(n), n
    for _ in range(4):
        if page.select(s)[:1] == [n]:
            return s
        up = up.parent
        if up is None or not up.is_element:
            break
        s = f"{selector_for(up)} > {s}"
    same = [c for c in n.parent.elements() if c.tag == n.tag]
    return f"{s}:nth-of-type({next(i for i, c in enumerate(same, 1) if c is n)})"


def blocks(page, most: int = 8) -> list[dict]:
    """Groups of alike siblings, scored by number, text, links, images and depth of content."""
    best: dict[str, dict] = {}
    groups = defaultdict(list)
    for n in page.doc.walk():
        if n.is_element and n.tag not in SKIP and n.parent is not None:
            groups[(id(n.parent), n.tag, tuple(sorted(classes(n))[:2]))].append(n)
    for (_, tag, cls), nodes in groups.items():
        if len(nodes) < 3:
            continue
        text = [" ".join(x.text().split()) for x in nodes]
        inner = sum(1 for x in nodes for c in x.walk() if c.is_element) / len(nodes)
        link = sum(any(c.tag == "a" for c in [x, *x.walk()]) for x in nodes) / len(nodes)
        image = sum(any(c.tag == "img" for c in x.walk()) for x in nodes) / len(nodes)
        length = sum(map(len, text)) / len(nodes)
        score = min(len(nodes), 20) + 5 * link + 6 * image + min(inner, 10) + min(length / 20, 8) + 3 * bool(cls)
        if any(p.tag in ("nav", "footer", "header") for p in _up(nodes[0])):
            score -= 25
        if inner < 1:
            score -= 10
        s = selector_for(nodes[0])
        if score > 0 and (s not in best or best[s]["score"] < score):
            best[s] = {"selector": s, "count": len(nodes), "score": round(score, 2), "sample": text[0][:120], "has_link": link > 0, "has_image": image > 0}
    return sorted(best.values(), key=lambda b: (-b["score"], b["selector"]))[:most]


def _up(n):
    while n.parent is not None:
        n = n.parent
        yield n


def suggest_fields(page, block: str, most: int = 8) -> dict[str, dict]:
    """Fields of a block by what its elements look like."""
    at = next(iter(page.select(block)), None)
    out: dict[str, dict] = {}
    if at is None:
        return out

    def rel(n):
        return selector_for(n)

    for n in [x for x in at.walk() if x.is_element]:
        names, text = " ".join(n.attrs.get("class", "").split()).lower() + " " + n.attrs.get("itemprop", ""), n.text().strip()
        if n.tag in ("h1", "h2", "h3", "h4") or re.search(r"title|name", names):
            out.setdefault("title", {"selector": rel(n), "transform": ["collapse"]})
        if n.tag == "a" and n.attrs.get("href"):
            out.setdefault("url", {"selector": rel(n), "attr": "href", "type": "url"})
        if n.tag == "img":
            out.setdefault("image", {"selector": rel(n), "attr": "src", "type": "url"})
        if "price" in names or re.fullmatch(r"[$€£¥]\s?\d[\d.,]*|\d[\d.,]*\s?[$€£¥]", text):
            out.setdefault("price", {"selector": rel(n), "transform": ["number"], "type": "number"})
        if n.tag == "time" or "date" in names:
            out.setdefault("date", {"selector": rel(n), "transform": ["date"]})
        if n.tag == "p" and len(text) > 40 or re.search(r"desc|summary|blurb", names):
            out.setdefault("description", {"selector": rel(n), "transform": ["collapse"]})
        for c in classes(n):
            if "__" in c and len(out) < most:
                out.setdefault(re.sub(r"\W", "_", c.split("__")[-1]), {"selector": f".{c}"})
    return dict(list(out.items())[:most])


def analyze_text(html: str | None, url: str | None) -> dict:
    from pagelake.html.page import Page

    page = Page(html, url)
    links = page.links()
    host = re.sub(r"^https?://(?:www\.)?([^/?#]+).*$", r"\1", url or "")
    internal = sum(re.sub(r"^https?://(?:www\.)?([^/?#]+).*$", r"\1", x["url"]) == host for x in links)
    types = sorted({str(b.get("@type")) for b in page.json_ld if b.get("@type")})
    return {"title": page.title(), "n_links": len(links), "internal": internal, "external": len(links) - internal, "json_ld": types, "n_tables": len(page.select("table")), "next_page": page.next_page(), "blocks": blocks(page)}


def analyze(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    ship(pages.sparkSession)

    @F.pandas_udf(ANALYSIS)
    def analysis(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        return sliced(batches, lambda h, u: pd.DataFrame([analyze_text(a, b) for a, b in zip(h, u)], columns=["title", "n_links", "internal", "external", "json_ld", "n_tables", "next_page", "blocks"]))

    return pages.withColumn("analysis", analysis(F.col(html), F.col(url)))


def generate_recipe(html: str, url: str) -> dict:
    """A recipe for a page: JSON-LD product, else the best list, else tables, else a detail page."""
    from pagelake.html.page import Page

    page = Page(html, url)
    if page.json_ld_of("Product"):
        f = {k: {"from": "jsonld", "entity": "Product", "path": p} for k, p in {"name": "name", "sku": "sku", "price": "offers.price"}.items()}
        spec = {"fields": f}
    elif found := blocks(page):
        spec = {"container": found[0]["selector"], "fields": suggest_fields(page, found[0]["selector"])}
    elif page.select("table"):
        spec = {"tables": True, "fields": {}}
    else:
        spec = {"fields": {"title": {"selector": "h1", "transform": ["collapse"]}, "text": {"from": "text"}}}
    return {"start_urls": [url], "extract": spec} | ({"pagination": {"type": "auto"}} if page.next_page() else {})
