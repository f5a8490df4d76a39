"""HTML to blocks: headings, paragraphs, code, list items and table rows in page order."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.text import normalize_service_line, normalize_text

#: Fixed values of the mark-up of the pages that are read: elements and classes that are noise.
SKIP = {"form", "input", "textarea", "button", "script", "style", "nav", "header", "footer", "aside", "img"}
SKIP_CLASSES = {"suggest", "suggest-success", "suggest-failed", "suggest-form", "scrollToFeedback"}
VOID = {"area", "base", "br", "col", "hr", "img", "input", "link", "meta", "wbr"}
CONTAINERS = {"body", "div", "section", "article", "main", "table", "td", "th", "ul", "ol", "li", "dl", "dd", "dt"}
WORD = re.compile(r"\w")
CLOSES_P = {"p", "div", "ul", "ol", "dl", "table", "pre", "h1", "h2", "h3", "h4", "section", "article"}


class Node:
    def __init__(self, tag: str, attrs: dict, parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.classes = set((attrs.get("class") or "").split())
        self.children: list[Node | str] = []

    def below(self) -> Iterator[Node]:
        """All nodes under this one, in page order."""
        waiting = [iter(self.children)]
        while waiting:
            child = next(waiting[-1], None)
            if child is None:
                waiting.pop()
            elif isinstance(child, Node):
                yield child
                waiting.append(iter(child.children))

    def find(self, test) -> Node | None:
        return next((x for x in self.below() if test(x)), None)

    def all(self, tag: str) -> list[Node]:
        return [x for x in self.below() if x.tag == tag]


class _Tree(HTMLParser):
    """open: how many elements of each name are open, so that end tags without a start cost nothing."""

    def __init__(self):
        super().__init__()
        self.root = self.at = Node("", {})
        self.open: Counter[str] = Counter()

    def _up_to(self, node):
        while self.at is not node:
            self.open[self.at.tag] -= 1
            self.at = self.at.parent

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P and self.open["p"] > 0:  # an open paragraph ends, whatever inline elements are open in it
            node = self.at
            while node is not None and node.tag not in CONTAINERS and node.tag != "p":
                node = node.parent
            if node is not None and node.tag == "p":
                self._up_to(node.parent)
        if tag == "li" and self.at.tag == "li":
            self._up_to(self.at.parent)
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] += 1

    def handle_endtag(self, tag):
        if self.open[tag] > 0:
            node = self.at
            while node.tag != tag:
                node = node.parent
            self._up_to(node.parent)

    def handle_data(self, data):
        self.at.children.append(data)


def inline_text(node: Node | str) -> str:
    """Text of a node: code in backticks, br as a newline. Walks with a stack of its own, as
    pages may nest more deeply than Python calls do."""
    out: list[str] = []
    code = 0
    waiting: list = [node]
    while waiting:
        x = waiting.pop()
        if x is None:  # the end of a code element
            code -= 1
            if not code:
                out.append("`")
        elif isinstance(x, str):
            out.append(x)
        elif x.tag == "br":
            out.append("\n")
        elif x.tag not in SKIP and not x.classes & SKIP_CLASSES:
            if x.tag == "code":
                if not code:
                    out.append("`")
                code += 1
                waiting.append(None)
            waiting.extend(reversed(x.children))
    return "".join(out)


def render_code(node: Node) -> str:
    """Text of a code block: a space between word characters that different nodes put side by
    side, no blank lines at the edges, no common indent, no Declaration heading."""
    parts: list[str] = []
    last = ""
    waiting: list[Node | str] = [node]
    while waiting:
        x = waiting.pop()
        if isinstance(x, Node):
            if x.tag == "br":
                parts.append(last := "\n")
            elif x.tag not in ("img", "script", "style") and not (
                x.tag == "h2" and " ".join(inline_text(x).split()).lower() == "declaration"
            ):
                waiting.extend(reversed(x.children))
        elif x:
            if last and WORD.match(last) and WORD.match(x[0]):
                parts.append(" ")
            parts.append(x)
            last = x[-1]
    out = "".join(parts)
    lines = re.split(r"\r\n|\r|\n", out)
    while lines and not lines[0].strip():
        lines.pop(0)
    while lines and not lines[-1].strip():
        lines.pop()
    indent = min((len(x) - len(x.lstrip(" \t")) for x in lines if x.strip()), default=0)
    return "\n".join(x[min(indent, len(x) - len(x.lstrip(" \t"))) :] for x in lines)


def _blocks(root: Node) -> Iterator[tuple[str, int, str]]:
    waiting = [(iter(root.children), 0, "mb20" in root.classes)]
    while waiting:
        children, depth, service = waiting[-1]
        x = next(children, None)
        if x is None:
            waiting.pop()
            continue
        if not isinstance(x, Node) or x.tag in SKIP or x.classes & SKIP_CLASSES or x.tag == "h1":
            continue
        deeper = depth + ("subsection" in x.classes)
        if x.tag in ("h2", "h3", "h4"):
            yield "heading", max(1, int(x.tag[1]) - 1) + max(0, deeper - 1), inline_text(x)
        elif x.tag == "pre" or "signature-CS" in x.classes:
            yield "code", 0, render_code(x)
        elif x.tag == "table":
            for row in x.all("tr") if "list" in x.classes else ():
                cells = [" ".join(inline_text(c).split()) for c in row.all("td")]
                yield "row", 0, " — ".join(c for c in cells if c)
        elif x.tag in ("ul", "ol"):
            for item in x.children:
                if isinstance(item, Node) and item.tag == "li":
                    yield "item", 0, inline_text(item)
        elif x.tag == "dl":
            for item in x.children:
                if isinstance(item, Node):
                    yield "term" if item.tag == "dt" else "definition", 0, inline_text(item)
        elif x.tag == "p":
            yield "service" if service else "paragraph", 0, inline_text(x)
        else:
            yield "paragraph", 0, "".join(c for c in x.children if isinstance(c, str))
            waiting.append((iter(x.children), deeper, service or "mb20" in x.classes))


def page_blocks(html: str | None, container: str | None = "section") -> list[tuple[str, int, str]] | None:
    """(kind, level, raw text) of a page's blocks; None if it has no container. Without a
    container's name the whole body is walked."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    root = tree.root
    if container is not None:
        wrap = root.find(lambda n: n.attrs.get("id") == "content-wrap")
        root = wrap.find(lambda n: container in n.classes) if wrap is not None else None
    return None if root is None else [b for b in _blocks(root) if b[2].strip()]


def html_blocks(pages: DataFrame, key: str = "document_id", container: str | None = "section") -> DataFrame:
    """key, pos, kind, level and text of every block; a page without its container, or one that the
    parser refuses, has one row of kind error. The only Python of this stage; text is normalised by expressions."""
    kind = pages.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            rows = []
            for name, html in zip(frame[key], frame["html"], strict=True):
                try:
                    found, why = page_blocks(html, container), "main content not found"
                except (AssertionError, ValueError):  # what the parser raises on broken declarations
                    found, why = None, "page can't be parsed"
                rows += [(name, 0, "error", 0, why)] if found is None else [(name, i, *b) for i, b in enumerate(found)]
            yield pd.DataFrame(rows, columns=[key, "pos", "kind", "level", "raw"])

    blocks = pages.select(key, "html").mapInPandas(run, f"{key} {kind}, pos int, kind string, level int, raw string")
    raw = F.col("raw")
    clean = F.when(F.col("kind") == "code", raw).when(
        F.col("kind") == "service", normalize_service_line(raw)
    ).otherwise(normalize_text(raw))
    lead = {
        "heading": F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" ")), "row": F.lit("- "), "item": F.lit("- "),
        "term": F.lit("- "), "definition": F.lit("  ")
    }
    text = F.when(F.col("kind") == "code", F.concat(F.lit("```csharp\n"), clean, F.lit("\n```")))
    for name, prefix in lead.items():
        text = text.when(F.col("kind") == name, F.concat(prefix, clean))
    blocks = blocks.withColumn("clean", clean).where(
        (F.col("clean") != "") & ~(F.col("kind").isin("paragraph", "service") & (F.col("clean") == "/"))
    )
    return blocks.select(key, "pos", "kind", "level", text.otherwise(F.col("clean")).alias("text"))


_ATTRIBUTES = r"(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+"
#: A comment, or a tag; an element of plain text is taken up to the end tag of its name.
TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|textarea|title)(?P<own>(?:\s{_ATTRIBUTES})?)>.*?(?=</(?P=raw)\b|\Z)"
    rf"|<(?P<close>/)?(?P<name>[a-zA-Z][^\s/<>]*+)(?P<attrs>{_ATTRIBUTES})>", re.S | re.I
)
ATTRIBUTE = re.compile(r"\b(class|id)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)


def _attribute(tag: re.Match, name: str) -> set[str]:
    return {
        x for kind,
        value in ATTRIBUTE.findall(tag["attrs"] or tag["own"] or "") if kind.lower() == name for x in value.strip("\"'").split()
    }


def _name(tag: re.Match) -> str:
    return (tag["name"] or tag["raw"] or "").lower()


def _element(html: str, test, at: int, stop: int) -> tuple[int, int] | None:
    """Start and end of the inside of the first element from at on whose tag passes the test."""
    name, start, depth = "", 0, 0
    for tag in TAG.finditer(html, at, stop):
        own = _name(tag)
        if not depth and own and not tag["close"] and own not in VOID and test(tag):
            name, start, depth = own, tag.end(), 1
        elif depth and own == name:
            depth += -1 if tag["close"] else 1
            if not depth:
                return start, tag.start()
    return (start, stop) if depth else None


def main_html(html: str | None, container: str | None = "section") -> str | None:
    """The mark-up of a page's main container without noise elements and all that they hold, however
    they nest; None if there is no container. Without a container's name the page is taken whole."""
    html = html or ""
    place: tuple[int, int] | None = (0, len(html))
    if container is not None:
        place = _element(html, lambda t: "content-wrap" in _attribute(t, "id"), 0, len(html))
        place = place and _element(html, lambda t: container in _attribute(t, "class"), *place)
        if place is None:
            return None
    (at, stop), out, skip = place, [], None
    around: Counter[str] = Counter()  # open elements that are kept
    within: Counter[str] = Counter()  # open ones of the noise element
    for tag in TAG.finditer(html, at, stop):
        name = _name(tag)
        if not name:
            continue
        if skip is not None:
            if not tag["close"]:
                within[name] += name not in VOID
            elif within[name] > 0:
                within[name] -= 1
                if name == skip and not within[name]:
                    skip, at = None, tag.end()
            elif around[name] > 0:  # the end of what holds a noise element that has no end
                skip, at = None, tag.start()
                around[name] -= 1
        elif tag["close"]:
            around[name] -= around[name] > 0
        elif name in SKIP or _attribute(tag, "class") & SKIP_CLASSES:
            out.append(html[at : tag.start()])
            at = tag.end()
            if name not in VOID:
                skip, within = name, Counter({name: 1})
        else:
            around[name] += name not in VOID
    return "".join(out) + (html[at:stop] if skip is None else "")


def strip_boilerplate(pages: DataFrame, key: str = "document_id", container: str | None = "section") -> DataFrame:
    """key, html (see main_html) and error of every page; a page without its container is an error."""
    kind = pages.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            yield pd.DataFrame({key: frame[key], "html": [main_html(x, container) for x in frame["html"]]})

    found = pages.select(key, "html").mapInPandas(run, f"{key} {kind}, html string")
    return found.withColumn("error", F.when(F.col("html").isNull(), "main content not found"))


def process_documents(blocks: DataFrame, titles: DataFrame, key: str = "document_id") -> DataFrame:
    """key, content, content_hash and error: `# title`, then the blocks, blank lines between.
    A document of its title alone, or without a container, is an error."""
    texts = blocks.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") != "error", F.struct("pos", "text")))).alias("b"),
        F.max(F.col("kind") == "error").alias("lost")
    )
    joined = F.array_join(
        F.concat(F.array(F.concat(F.lit("# "), F.col("title"))), F.transform("b", lambda x: x["text"])), "\n\n"
    )
    out = titles.join(texts.hint("merge"), key, "left").withColumn("content", normalize_text(joined))
    error = F.when(F.col("lost"), "main content not found").when(
        F.coalesce(F.size("b"), F.lit(0)) < 1, "no useful text"
    )
    return out.select(
        key, F.when(error.isNull(), F.col("content")).alias("content"),
        F.when(error.isNull(), F.sha2("content", 256)).alias("content_hash"), error.alias("error")
    )
