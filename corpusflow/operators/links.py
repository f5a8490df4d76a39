"""Links, the frontier of pages to fetch, and titles."""

from __future__ import annotations

import html as entities
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusflow.functions.text import is_blank, squeeze
from corpusflow.functions.urls import Rules, file_stem, part, resolve_url, url_allowed

MEMBER_HEADINGS = ("propert", "constructor", "operator", "method")


def all_links(pages: DataFrame) -> DataFrame:
    """url and target of every distinct anchor of a page, character references decoded, made absolute."""
    href = F.regexp_extract_all("html", F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"), F.lit(1))
    found = pages.select("url", F.explode(href).alias("href"))
    return found.select(
        "url", resolve_url(F.col("url"), decode_entities(F.col("href"))).alias("target")
    ).where("target is not null").distinct()


class _Members(HTMLParser):
    """Anchors in list tables of a page's direct-member subsections.

    Each open element has its name, whether it is the main section, a direct subsection, a
    nested one or a list table. A subsection's anchors count once its heading is known."""

    def __init__(self):
        super().__init__()
        self.stack: list[dict] = []
        self.main = False
        self.open: Counter[str] = Counter()  # by name, and of list tables and nested subsections
        self.headings: list[list[str]] = []
        self.subsection: dict | None = None
        self.links: list[str] = []

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        names = (attrs.get("class") or "").split()
        node = {"tag": tag}
        if not self.main and "section" in names:
            self.main = node["main"] = True
        elif self.stack and self.stack[-1].get("main") and "subsection" in names:
            self.subsection = {"heading": None, "links": []}
            node["subsection"] = self.subsection
        elif "subsection" in names:
            node["nested"] = True
        if self.subsection is not None:
            if self.subsection["heading"] is None and (tag in ("h2", "h3", "h4") or "subsection-title" in names):
                node["heading"] = []
            node["list"] = tag == "table" and "list" in names
            if tag == "a" and attrs.get("href") and self.open["<list>"] and not self.open["<nested>"]:
                self.subsection["links"].append(attrs["href"].strip())
        if tag not in ("area", "base", "br", "col", "hr", "img", "input", "link", "meta", "wbr"):
            self.stack.append(node)
            self._count(node, 1)
            if "heading" in node:
                self.headings.append(node["heading"])

    def _count(self, node, n):
        self.open[node["tag"]] += n
        self.open["<list>"] += n * bool(node.get("list"))
        self.open["<nested>"] += n * bool(node.get("nested"))

    def handle_data(self, data):
        for heading in self.headings:
            heading.append(data)

    def handle_endtag(self, tag):
        if not self.open[tag]:
            return
        while True:
            node = self.stack.pop()
            self._count(node, -1)
            if "heading" in node:
                self.headings.pop()
            if "heading" in node and self.subsection is not None and self.subsection["heading"] is None:
                self.subsection["heading"] = " ".join("".join(node["heading"]).split()).lower()
            if "subsection" in node:
                heading = node["subsection"]["heading"] or ""
                if not heading.startswith("inherited members") and any(m in heading for m in MEMBER_HEADINGS):
                    self.links += node["subsection"]["links"]
                self.subsection = None
            if node["tag"] == tag:
                return

    def close(self):
        super().close()
        while self.stack:
            self.handle_endtag(self.stack[-1]["tag"])


def member_hrefs(html: str | None) -> list[str]:
    """href of each direct member; a page that can't be read has none."""
    parser = _Members()
    try:
        parser.feed(html or "")
        parser.close()
    except (AssertionError, ValueError):
        return []
    return parser.links


def extract_links(pages: DataFrame, rules: Rules) -> DataFrame:
    """url and target: allowed links to direct members, without the page itself, distinct."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            yield pd.DataFrame({"url": frame["url"], "href": [member_hrefs(h) for h in frame["html"]]})

    found = pages.select("url", "html").mapInPandas(run, "url string, href array<string>").select("url", F.explode("href").alias("href"))
    found = found.select("url", resolve_url(F.col("url"), F.col("href")).alias("target"))
    return found.where(url_allowed(F.col("target"), rules) & (F.col("target") != F.col("url"))).distinct()


def select_frontier(links: DataFrame, seeds: DataFrame | None, max_pages: int) -> DataFrame:
    """url and position of the pages to fetch. Without seeds the first max_pages targets; else
    the sorted seeds, then their targets that aren't seeds, sorted, max_pages in all. The cap
    is the operator's own; a sort and limit takes max_pages rows from each task at most."""
    if seeds is None:
        chosen = links.select(F.col("target").alias("url")).distinct().withColumn("tier", F.lit(1))
    else:
        seeds = seeds.select("url").distinct()
        members = links.join(seeds.hint("merge"), "url", "left_semi").select(F.col("target").alias("url")).distinct().join(seeds.hint("merge"), "url", "left_anti")
        chosen = seeds.withColumn("tier", F.lit(0)).unionByName(members.withColumn("tier", F.lit(1)))
    first = chosen.orderBy("tier", "url").limit(max_pages)
    return first.select("url", "tier", F.row_number().over(Window.orderBy("tier", "url")).alias("position"))


def missing_seeds(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """Seeds that no known page has."""
    return seeds.select("url").distinct().join(links.select(F.col("url")).distinct().hint("merge"), "url", "left_anti")


def link_graph_stats(links: DataFrame) -> DataFrame:
    """url, out_degree and in_degree of every page that links or is linked."""
    out = links.groupBy("url").agg(F.countDistinct("target").alias("out_degree"))
    into = links.groupBy(F.col("target").alias("url")).agg(F.countDistinct(links["url"]).alias("in_degree"))
    zero = F.lit(0)
    return out.join(into.hint("merge"), "url", "full").select(
        "url", F.coalesce("out_degree", zero).alias("out_degree"), F.coalesce("in_degree", zero).alias("in_degree")
    )


@F.pandas_udf(StringType())
def decode_entities(text: pd.Series) -> pd.Series:
    """Character references of all kinds as the characters they stand for."""
    return text.map(entities.unescape, na_action="ignore")


def _text(element: str):
    inner = F.regexp_extract("html", rf"(?is)<{element}(?:\s[^>]*)?>(.*?)</{element}\s*>", 1)
    plain = F.regexp_replace(inner, r"(?s)<[^>]*>", "")
    return squeeze(F.when(plain.contains("&"), decode_entities(plain)).otherwise(plain))


def page_title(pages: DataFrame) -> DataFrame:
    """url and title: the first that isn't blank of <h1>, <title>, file name and host."""
    choices = [_text("h1"), _text("title"), file_stem(F.col("url")), part(F.col("url"), 2)]
    return pages.select("url", F.coalesce(*(F.when(~is_blank(c), c) for c in choices)).alias("title"))


