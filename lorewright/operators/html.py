"""HTML pages to Markdown: main content by a table of selectors, own converter on the standard parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SKIP = frozenset("script style noscript template head".split())
_BLOCK = frozenset("p div section article main header footer ul ol table tr blockquote pre figure aside nav form h1 h2 h3 h4 h5 h6".split())


@dataclass(frozen=True)
class Selector:
    """A tag with an id and classes that must all be there; '' stands for any."""

    tags: tuple[str, ...]
    id: str = ""
    classes: tuple[str, ...] = ()

    def fits(self, tag: str, attrs: dict[str, str]) -> bool:
        have = (attrs.get("class") or "").split()
        return tag in self.tags and (not self.id or attrs.get("id") == self.id) and all(c in have for c in self.classes)


# fixed values: where each kind of site keeps its text; alternatives in order, each a list of parts to be joined
SELECTORS: dict[str, list[list[Selector]]] = {
    "wiki": [[Selector(("main",), classes=("page__main",))]],
    "drugs": [[Selector(("div",), id="content", classes=("ddc-main-content",))]],
    "webcopy": [[Selector(("h1",), classes=("page-title",)), Selector(("div",), classes=("card", "card-lg"))]],
    "clinic": [[Selector(("main", "article"), id="main-content")], [Selector(("div",), classes=("aem-container", "cmp-container--centered"))]],
}


class _Node:
    __slots__ = ("attrs", "kids", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []


class _Tree(HTMLParser):
    """A tree that forgives unclosed and stray tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        n = _Node(tag, {k: v or "" for k, v in attrs})
        if tag in ("p", "li", "tr", "td", "th") and self.open[-1].tag == tag:
            self.open.pop()
        self.open[-1].kids.append(n)
        if tag not in _VOID:
            self.open.append(n)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].kids.append(data)


def _find(root: _Node, s: Selector) -> _Node | None:
    stack = [root]
    while stack:
        n = stack.pop()
        if n.tag and s.fits(n.tag, n.attrs):
            return n
        stack.extend(k for k in reversed(n.kids) if isinstance(k, _Node))
    return None


def _render(root: _Node) -> str:
    """Markdown with ATX headings. Works on a stack, so deep nesting is no matter."""
    out: list[str] = []
    stack: list = [root]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            out.append(x[0])
            continue
        if isinstance(x, str):
            out.append(re.sub(r"\s+", " ", x))
            continue
        t = x.tag
        if t in _SKIP:
            continue
        before = after = ""
        if re.fullmatch("h[1-6]", t):
            before, after = f"\n\n{'#' * int(t[1])} ", "\n\n"
        elif t == "li":
            before = "\n- "
        elif t in ("strong", "b"):
            before = after = "**"
        elif t in ("em", "i"):
            before = after = "*"
        elif t == "code":
            before = after = "`"
        elif t == "br":
            before = "\n"
        elif t == "hr":
            before = "\n\n---\n\n"
        elif t in ("td", "th"):
            before, after = " ", " |"
        elif t == "tr":
            before, after = "\n|", ""
        elif t == "a" and x.attrs.get("href"):
            before, after = "[", f"]({x.attrs['href']})"
        elif t == "img":
            before = f"![{x.attrs.get('alt', '')}]({x.attrs.get('src', '')})"
        elif t in _BLOCK:
            before = after = "\n\n"
        stack.append((after,))
        stack.extend(reversed(x.kids))
        stack.append((before,))
    text = "".join(out)
    text = re.sub(r"[ \t]+\n", "\n", re.sub(r"\n[ \t]+", "\n", text))
    return re.sub(r"\n{3,}", "\n\n", text).strip()


def to_markdown(html: str) -> str:
    t = _Tree()
    t.feed(html)
    t.close()
    return _render(t.root)


def main_content(html: str, site: str | None) -> str:
    """The Markdown of the site's main part; an unknown site gives the whole page; no part found gives ''."""
    t = _Tree()
    t.feed(html)
    t.close()
    if site not in SELECTORS:
        return _render(t.root)
    for parts in SELECTORS[site]:
        found = [n for s in parts if (n := _find(t.root, s)) is not None]
        if found:
            return "\n\n".join(_render(n) for n in found)
    return ""


def pages_to_markdown(df: DataFrame, key: str, html: str, site: str, path: str | None = None) -> DataFrame:
    """(key, text): pages without a main part give no row; script mirrors (paths that end in ``js.html`` or
    ``js.htm``) are left out."""
    kind = df.schema[key].dataType.simpleString()
    d = df.where(F.col(html).isNotNull())
    if path:
        d = d.where(~F.coalesce(F.col(path).rlike(r"js\.html?$"), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_content(h, s) for h, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            keep = pa.array([bool(t) for t in texts])
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), pa.array(texts, pa.string()).filter(keep)], names=[key, "text"])

    return d.select(key, html, site).mapInArrow(run, f"`{key}` {kind}, text string")
