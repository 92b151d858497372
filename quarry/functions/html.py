"""Sections of HTML pages, by a walk over the parser's events."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts of links that lead to no page, and paths that are not followed.
ASSETS = (".css", ".js", ".ico", ".jpg", ".jpeg", ".png", ".gif", ".pdf", "javascript:", "mailto:", "tel:", "#")
PRIVATE = ("/login", "/signup", "/register", "/logout", "/search?", "/filter?")
DROPPED = {"script", "style", "footer", "aside"}
DROPPED_CLASSES = {"navbar", "menu", "sidebar", "ad", "ads", "social", "nocontent"}
VOID = {"br", "img", "meta", "link", "input", "hr", "area", "base", "col", "source"}
LEVELS = {f"h{k}": k for k in range(1, 7)}
LABELS = {"pre": "Code example:", "code": "Code example:", "ul": "List:", "ol": "List:", "dl": "List:", "blockquote": "Quote:", "table": "Table:"}
WALKED = {"p", *LABELS}


class Node:
    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def parts(self):
        """All nodes and strings below, in the order of the page; no recursion, as unclosed elements nest without bound."""
        left = self.children[::-1]
        while left:
            c = left.pop()
            yield c
            if isinstance(c, Node):
                left.extend(c.children[::-1])

    def walk(self):
        return (c for c in self.parts() if isinstance(c, Node))

    def text(self) -> str:
        return "".join(c for c in self.parts() if isinstance(c, str))

    def find(self, *tags: str, having=lambda n: True) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags and having(n)), None)


class Tree(HTMLParser):
    """A tree in which an unclosed element holds all that follows."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def prune(node: Node) -> None:
    """Drop boilerplate, but nothing that holds the main region."""
    holds = set()
    for n in node.walk():
        if n.attrs.get("role") == "main" or n.attrs.get("id") == "mc-main-content":
            while (n := n.parent) and id(n) not in holds:
                holds.add(id(n))
    out = lambda c: isinstance(c, Node) and id(c) not in holds and (c.tag in DROPPED or DROPPED_CLASSES & set(c.attrs.get("class", "").split()))
    left = [node]
    while left:
        n = left.pop()
        n.children = [c for c in n.children if not out(c)]
        left += [c for c in n.children if isinstance(c, Node)]


def page_title(root: Node, url: str) -> str:
    meta = lambda k, v: root.find("meta", having=lambda n: n.attrs.get(k) == v)
    for n in (root.find("h1"), root.find("title"), meta("property", "og:title"), meta("name", "twitter:title"), root.find("h2")):
        if n and (t := (n.attrs.get("content", "") if n.tag == "meta" else n.text()).strip()):
            return t[:200]
    path = re.sub(r"^[a-z]+://[^/]*", "", url).split("?")[0].split("#")[0]
    if path not in ("", "/"):
        return path.split("/")[-1].replace("-", " ").replace("_", " ").title()
    return re.sub(r"^[a-z]+://([^/?#]*).*", r"\1", url)


def main_region(root: Node) -> Node:
    named = lambda k: lambda n: re.search("content|main|body", n.attrs.get(k, ""), re.I)
    tries = (
        root.find("div", having=lambda n: n.attrs.get("role") == "main"),
        root.find("div", having=lambda n: n.attrs.get("id") == "mc-main-content"),
        root.find("main"),
        root.find("article"),
        root.find("div", having=named("class")),
        root.find("div", having=named("id")),
        root.find("section"),
    )
    return next((n for n in tries if n), root)


def table_text(node: Node) -> str:
    rows = [[c.text().strip() for c in tr.walk() if c.tag in ("td", "th")] for tr in node.walk() if tr.tag == "tr"]
    return "\n".join(" | ".join(r) for r in rows if any(r))


def sections(url: str, html: str) -> list[dict]:
    """Title, level, section_id and content of each section that has any; headings count even when empty."""
    root = Tree(html).root
    prune(root)
    title = page_title(root, url)
    out, current, seen = [], {"title": title, "level": 1, "section_id": 1, "content": []}, 1
    for n in main_region(root).walk():
        if n.tag in LEVELS:
            if current["content"]:
                out.append(current)
            seen += 1
            current = {"title": n.text().strip(), "level": LEVELS[n.tag], "section_id": seen, "content": []}
        elif n.tag in WALKED:
            t = table_text(n) if n.tag == "table" else n.text().strip()
            if len(t) > 10:
                current["content"].append(f"{LABELS[n.tag]}\n{t}" if n.tag in LABELS else t)
    if current["content"]:
        out.append(current)
    return [{**s, "page_title": title, "content": "\n\n".join(s["content"])} for s in out]


def html_sections(pages: DataFrame) -> DataFrame:
    """page_id, section_id, page_title, title, level, content and word_count of each section; null pages have none."""

    def run(batches):
        for b in batches:
            rows = [(i, s["section_id"], s["page_title"], s["title"], s["level"], s["content"], len(s["content"].split())) for i, u, h in zip(*(c.to_pylist() for c in b.columns), strict=True) if h for s in sections(u or "", h)]
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32())
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "section_id", "page_title", "title", "level", "content", "word_count"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, section_id int, page_title string, title string, level int, content string, word_count int")


def host(url: Column) -> Column:
    """Host and port of a URL."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def links(html: Column, url: Column, most: int = 50) -> Column:
    """The first links of a page that lead to other pages of its site, made absolute; repeats stay."""
    base = F.concat(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    found = F.regexp_extract_all(html, F.lit(r"""(?i)href=["']([^"']+)["']"""), F.lit(1))

    def holds(c: Column, parts) -> Column:
        out = F.lit(False)
        for p in parts:
            out = out | F.lower(c).contains(p)
        return out

    absolute = F.transform(F.filter(found, lambda h: ~holds(h, ASSETS)), lambda h: F.when(h.startswith("http"), h).when(h.startswith("/"), F.concat(base, h)).otherwise(F.concat(base, F.lit("/"), h)))
    return F.slice(F.filter(absolute, lambda h: (host(h) == host(url)) & ~holds(h, PRIVATE)), 1, most)
