"""Listings: JSON answers with changing field names, and pages of dated link cards."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.times import english_date
from gristmill.operators.tables import travels
from gristmill.sources.pages import VOID

travels(__name__)

# Names under which an answer holds its list and its fields, most likely first.
LIST_KEYS = ("results", "data", "items", "documents")
FIELDS = {
    "title": ("title",),
    "url": ("url", "link"),
    "published": ("published_date", "published_at", "publishedDate", "date"),
    "snippet": ("content", "snippet", "description"),
    "score": ("score", "relevance_score"),
}
DEPTH = 2


def _first_text(node: Column, keys: tuple[str, ...]) -> Column:
    """The first of some fields that is text or a number and not blank."""

    def value(key: str) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(node, f"$.{key}", "variant"))
        text = F.trim(F.try_variant_get(node, f"$.{key}", "string"))
        return F.when(~kind.rlike("^(BOOLEAN|OBJECT|ARRAY)") & (text != ""), text)

    return F.coalesce(*[value(k) for k in keys], F.lit(""))


def _paths() -> list[tuple[str, ...]]:
    """Ways to a list through objects under the known names, in the order in which they are tried."""

    def below(path: tuple[str, ...]) -> list[tuple[str, ...]]:
        out = []
        for key in LIST_KEYS:
            out.append((*path, key))
            if len(path) < DEPTH:
                out += below((*path, key))
        return out

    return below(())


def results(answers: DataFrame, json: str = "json") -> DataFrame:
    """answers with found (whether there is a list), list_key (where), skipped_no_url and hits (array of rank, title, url, published, snippet, score). No list is not an empty one."""
    doc = F.try_parse_json(json)
    lists = [(".".join(p), F.try_variant_get(doc, "$." + ".".join(p), "array<variant>")) for p in _paths()]

    def holds_rows(value: Column) -> Column:
        return F.coalesce((F.size(value) == 0) | F.exists(value, lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT"))), F.lit(False))

    found = reduce(lambda w, kv: w.when(holds_rows(kv[1]), F.struct(F.lit(kv[0]).alias("key"), kv[1].alias("rows"))), lists[1:], F.when(holds_rows(lists[0][1]), F.struct(F.lit(lists[0][0]).alias("key"), lists[0][1].alias("rows"))))
    rows = answers.withColumn("_found", found)
    hits = F.transform(
        F.coalesce(F.col("_found.rows"), F.expr("CAST(array() AS ARRAY<VARIANT>)")),
        lambda x, i: F.struct(i.alias("place"), *[_first_text(x, keys).alias(name) for name, keys in FIELDS.items()]),
    )
    rows = rows.withColumn("_hits", F.filter(hits, lambda h: h["url"] != ""))
    out = rows.select(
        *answers.columns,
        F.col("_found").isNotNull().alias("found"),
        F.coalesce("_found.key", F.lit("")).alias("list_key"),
        (F.coalesce(F.size("_found.rows"), F.lit(0)) - F.size("_hits")).alias("skipped_no_url"),
        F.transform("_hits", lambda h, i: F.struct((i + 1).alias("rank"), *[h[name].alias(name) for name in FIELDS])).alias("hits"),
    )
    return out


# How many ancestors of a date may be its card, the forms of dates and reading times on a card, its headline tags, and what surrounds a headline.
LEVELS = 8
DATE = re.compile(r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.? \d{1,2}, \d{4}|\b\d{4}-\d{2}-\d{2}\b", re.IGNORECASE)
READING_TIME = re.compile(r"\s*\d+\s*(?:min|minute|minutes)\s+read\s*$", re.IGNORECASE)
HEADLINES = ("h1", "h2", "h3", "h4", "p")
AROUND = " ·|—-–\t"


class Node:
    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.parts: list[Node | str] = []

    def inside(self) -> Iterator[Node | str]:
        """All that this holds, in the order of the page, however deep."""
        waiting = list(reversed(self.parts))
        while waiting:
            part = waiting.pop()
            yield part
            if isinstance(part, Node):
                waiting.extend(reversed(part.parts))

    def text(self) -> str:
        return " ".join(" ".join(p for p in self.inside() if isinstance(p, str)).split())

    def all(self, *tags: str) -> Iterator[Node]:
        return (p for p in self.inside() if isinstance(p, Node) and p.tag in tags)


class Tree(HTMLParser):
    """A page as nodes."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs), self.at)
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.parts.append(data)


def headline(value: str | None) -> str:
    """A card's label up to its date, without a reading time."""
    text = " ".join((value or "").split())
    if found := DATE.search(text):
        text = text[: found.start()]
    return READING_TIME.sub("", text).strip(AROUND)


def _card(date: Node, prefix: str, index: tuple[str, ...]) -> tuple[str, str] | None:
    """href and title of the smallest element around a date that holds an article link."""
    node = date
    for _ in range(LEVELS):
        node = node.parent
        if node is None or node.tag in ("", "body", "html"):
            return None
        links = [a for a in node.all("a") if (a.attrs.get("href") or "").startswith(prefix) and not any(x in a.attrs["href"] for x in index)]
        if links:
            # of a card's links the one with most text is the headline
            link = max(links, key=lambda a: len(a.text()))
            titles = [headline(e.text()) for e in link.all(*HEADLINES)] + [headline(link.text())] + [headline(i.attrs.get("alt")) for part in (link, node) for i in part.all("img")]
            title = next((t for t in titles if t), "")
            return (link.attrs["href"], title) if title else None
    return None


def _cards(page: int, html: str, prefix: str, index: tuple[str, ...], date_class: str) -> list[tuple]:
    """Rows of the dated cards of one page; one row that tells of it if it has no article link."""
    tree, rows, seen = Tree(), [], set()
    tree.feed(html)
    tree.close()
    if not any((a.attrs.get("href") or "").startswith(prefix) for a in tree.root.all("a")):
        rows.append((page, None, None, None, None, False, None))
    for place, date in enumerate(n for n in tree.root.all("p", "span", "time") if n.tag == "time" or date_class in (n.attrs.get("class") or "").split()):
        found, card = DATE.search(date.text()), None
        if found:
            card = _card(date, prefix, index)
        if card and card[0] not in seen:
            seen.add(card[0])
            rows.append((page, place, card[0], card[1], found[0], True, None))
    return rows


def link_cards(pages: DataFrame, prefix: str, base: str, index: tuple[str, ...] = ("/tag/", "/page/", "/category/"), date_class: str = "date") -> DataFrame:
    """page_id, url, title, published_at, found (false on a page without any article link: its structure has changed) and error (of a page that cannot be read) of the dated cards on listing pages; undated ones are skipped, a link counts once."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, html in zip(batch.page_id, batch.html, strict=True):
                try:
                    rows += _cards(page, html or "", prefix, index, date_class)
                except Exception as failed:  # one page never ends the job
                    rows.append((page, None, None, None, None, False, f"{type(failed).__name__}: {failed}"[:200]))
            yield pd.DataFrame(rows, columns=["page_id", "place", "href", "title", "written", "found", "error"])

    cards = pages.select("page_id", "html").mapInPandas(read, "page_id long, place double, href string, title string, written string, found boolean, error string")
    return cards.select("page_id", F.concat(F.lit(base), "href").alias("url"), "title", english_date(F.col("written")).alias("published_at"), "found", "error").where("published_at IS NOT NULL OR NOT found")
