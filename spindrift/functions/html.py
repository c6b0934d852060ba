"""HTML extraction: the one place that needs Python; Arrow batches of pages, the standard library's parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions.urls import crawl_url, detect_source, is_admissible_link

# Paragraphs that are read, the least text of a page, and the most links that are kept.
PARAGRAPHS, LEAST_TEXT, MOST_LINKS = 10, 100, 25
_ENDS_P = frozenset("address article aside blockquote body div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr html main nav ol p pre section table ul".split())
_SILENT = frozenset(("script", "style", "template"))


class _Reader(HTMLParser):
    """Title, paragraphs and links; an open paragraph ends where the next block starts."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.title: list[str] | None = None
        self.in_title, self.silent = False, 0
        self.paragraphs: list[list[str]] = []
        self.open: list[str] | None = None
        self.hrefs: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in _SILENT:
            self.silent += 1
        elif tag == "title" and self.title is None:
            self.title, self.in_title = [], True
        elif tag == "a":
            href = dict(attrs).get("href")
            if href is not None:
                self.hrefs.append(href)
        if tag in _ENDS_P:
            self.open = None
        if tag == "p":
            self.open = []
            self.paragraphs.append(self.open)

    def handle_startendtag(self, tag, attrs):
        if tag not in _SILENT:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "title":
            self.in_title = False
        elif tag in _ENDS_P:
            self.open = None

    def handle_data(self, data):
        if self.in_title and self.title is not None:
            self.title.append(data)
        elif not self.silent and self.open is not None:
            self.open.append(data)


def parse_html(html: str | None, base: str = "") -> tuple[str, str, list[str], list[str]]:
    """(title, text, hrefs, targets): text of the first paragraphs, links as written and resolved against ``base``."""
    r = _Reader()
    r.feed(html or "")
    r.close()
    pieces = [" ".join(x for x in (d.strip() for d in p) if x) for p in r.paragraphs[:PARAGRAPHS]]
    targets = []
    for h in r.hrefs:
        try:
            targets.append(urljoin(base, h))
        except ValueError:
            targets.append("")
    return "".join(r.title or []).strip(), " ".join(pieces), r.hrefs, targets


def _extract(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        rows = [parse_html(h, u or "") for h, u in zip(pdf["html"], pdf["url"])]
        yield pd.DataFrame({"url": pdf["url"], "title": [r[0] for r in rows], "text": [r[1] for r in rows], "hrefs": [r[2] for r in rows], "targets": [r[3] for r in rows]})


def extract_html(raw: DataFrame) -> DataFrame:
    """url, title, text, hrefs, targets of (url, html) rows; null html is an empty page."""
    return raw.select("url", "html").mapInPandas(_extract, "url string, title string, text string, hrefs array<string>, targets array<string>")


def page_records(raw: DataFrame, least_text: int = LEAST_TEXT, most_links: int = MOST_LINKS) -> DataFrame:
    """Page records of (url, html) rows: pages with a title and enough text, with their first admissible distinct links."""
    pairs = F.arrays_zip(F.col("hrefs").alias("h"), F.transform("targets", crawl_url).alias("t"))
    kept = F.transform(F.filter(pairs, lambda x: is_admissible_link(x["h"], x["t"])), lambda x: x["t"])
    page = extract_html(raw).where((F.length("text") >= least_text) & (F.col("title") != ""))
    return page.select("url", "title", "text", detect_source(F.col("url")).alias("source"), F.slice(F.array_distinct(kept), 1, most_links).alias("links"))
