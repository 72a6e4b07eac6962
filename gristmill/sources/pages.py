"""Bodies of web pages: a tree walk inside tasks gives blocks of text, everything after that is columns."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.quality import is_noise, quality
from gristmill.functions.text import without_title
from gristmill.operators import bodies as choice
from gristmill.operators.tables import travels

travels(__name__)

# Tags whose text is never body, tags that start a block, and tags without an end.
SKIPPED = frozenset((
    "script", "style", "noscript", "template", "svg", "nav", "footer", "header", "aside", "form", "button", "iframe",
))
BLOCKS = frozenset((
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "div", "section", "article", "main", "figure", "br",
))
VOID = frozenset((
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr",
))
# Words of class or id that mark page furniture, roles that do, and the roots, which never are.
CHROME = (
    "ad", "ads", "advert", "adsbygoogle", "sponsor", "sponsored", "promo", "cookie", "cookies", "consent", "gdpr", "banner", "paywall", "newsletter",
    "subscribe", "signup", "signin", "sign-in", "login", "log-in", "social", "share", "sharing", "related", "recommend", "recommended", "recommendation",
    "relevant", "advertisement", "readmore", "readnext", "popular", "sidebar", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "masthead",
    "header", "footer", "skip", "search", "modal", "popup", "overlay", "tooltip", "pagination", "pager", "tag", "tags", "byline", "author-card", "authorcard",
    "author-bio", "comment", "comments", "comment-list", "disqus", "backtotop", "back-to-top", "copyright", "legal", "affiliate", "disclaimer",
)
ROLES = frozenset(("navigation", "banner", "contentinfo", "search", "menu", "menubar", "dialog"))
ROOTS = frozenset(("html", "body", "main", "article"))
#: A word counts between hyphens, underscores and the ends of all classes and the id together.
CHROME_WORD = re.compile(rf"(?:^|[-_])(?:{'|'.join(CHROME)})(?:$|[-_])")
MOST = 40_000
# Elements that may hold the article, the more telling first, and for some sources the ones that are tried before.
CONTENT = (
    "[itemprop=articleBody]", ".blog-post-body", ".prose", "#main-content .prose", "article", "main", "[role=main]", ".post-content", ".entry-content",
    ".article-content", ".article-body", ".post-body", ".markdown-body", ".article", ".post", "#content", ".content",
)
SOURCE_CONTENT = {
    "cohere": (".blog-post-body", "article"), "cursor": (".prose--blog", ".prose", "article"), "anthropic": ("[class*=post]", "article", "main"),
    "deepseek": ("article", "main"), "kimi": ("article", "main"),
}
#: One step of a selector: a tag, a class, an id, an attribute's value or a part of it.
STEP = re.compile(r"\[(?P<attr>[\w-]+)(?P<part>\*?)=(?P<value>[^\]]+)\]|\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+)|(?P<tag>[\w-]+)")


def fits(step: str, tag: str, attrs: dict[str, str | None]) -> bool:
    """Whether an element fits one step of a selector."""
    s = STEP.fullmatch(step)
    if s["tag"]:
        return tag == s["tag"]
    if s["cls"]:
        return s["cls"] in (attrs.get("class") or "").split()
    if s["id"]:
        return attrs.get("id") == s["id"]
    value = attrs.get(s["attr"]) or ""
    return s["value"] in value if s["part"] else value == s["value"]


def furniture(tag: str, attrs: dict[str, str | None]) -> bool:
    """Whether an element holds page furniture."""
    if tag in ROOTS:
        return False
    named = " ".join(w for k in ("class", "id") for w in (attrs.get(k) or "").lower().split())
    return tag in SKIPPED or (attrs.get("role") or "").lower() in ROLES or (attrs.get("aria-hidden") or "").lower() == "true" or bool(CHROME_WORD.search(named))


class Blocks(HTMLParser):
    """Blocks of a page with their marks: # for headings, - for list items, > for quotes; and which of them stand in each element that may hold the article."""

    def __init__(self, selectors: tuple[str, ...]):
        super().__init__(convert_charrefs=True)
        self.selectors = [s.split() for s in selectors]
        self.open: list[tuple[str, bool]] = []
        self.ancestors: list[tuple[str, dict]] = []
        self.chars = 0
        #: Of open elements: how many are open above, the selector's place, the first block, the characters before.
        self.begun: list[tuple[int, int, int, int]] = []
        #: Of ended ones: the selector's place, the characters inside, the first block and the one behind the last.
        self.found: list[tuple[int, int, int, int]] = []
        self.blocks: list[str] = []
        self.text: list[str] = []
        self.mark = ""
        self.title = ""

    def skipping(self) -> bool:
        return any(s for _, s in self.open)

    def flush(self) -> None:
        flat = " ".join("".join(self.text).split())
        if flat:
            self.blocks.append(f"{self.mark} {flat}" if self.mark else flat)
        self.text, self.mark = [], ""

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
            self.mark = "#" * int(tag[1]) if tag[0] == "h" and tag[1:].isdigit() else {"li": "-", "blockquote": ">"}.get(tag, "")
        if tag not in VOID:
            attrs = dict(attrs)
            self.open.append((tag, furniture(tag, attrs)))
            self.ancestors.append((tag, attrs))
            places = [k for k, steps in enumerate(self.selectors) if self.selected(steps)] if not self.skipping() else []
            if places:
                mark = self.mark
                self.flush()
                self.mark = mark
                self.begun += [(len(self.open), k, len(self.blocks), self.chars) for k in places]

    def selected(self, steps: list[str]) -> bool:
        """Whether the element just opened fits the last step, and those above it the others in turn."""
        if not fits(steps[-1], *self.ancestors[-1]):
            return False
        left = steps[:-1]
        for above in reversed(self.ancestors[:-1]):
            if left and fits(left[-1], *above):
                left = left[:-1]
        return not left

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass
            self.ended()

    def ended(self) -> None:
        """Takes note of the elements that are no longer open."""
        del self.ancestors[len(self.open) :]
        if self.begun and self.begun[-1][0] > len(self.open):
            self.flush()
        while self.begun and self.begun[-1][0] > len(self.open):
            _, place, first, before = self.begun.pop()
            self.found.append((place, self.chars - before, first, len(self.blocks)))

    def article(self, n_source: int) -> list[str]:
        """The blocks of the element that most likely holds the article. The first `n_source` selectors are the source's: the first that fits anything decides; else the largest of all, of equal ones
        the more telling; else the whole page."""
        own = [f for f in self.found if f[0] < n_source]
        some = [f for f in own if f[0] == min(own)[0]] if own else [f for f in self.found if f[0] >= n_source]
        if not some:
            return self.blocks
        _, _, first, last = max(some, key=lambda f: (f[1], -f[0], -f[2]))
        return self.blocks[first:last]

    def handle_data(self, data):
        if self.open and self.open[-1][0] == "title" and not self.title:
            self.title = " ".join(data.split())
        elif not self.skipping():
            self.text.append(data)
            self.chars += len(data.strip()) + 1 if data.strip() else 0


#: Characters of pages, or pages, that a task walks before it sends what it found; a batch of Arrow may hold thousands of long pages.
SENT_CHARS, SENT_PAGES = 1_000_000, 500


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.string()]

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "title", "blocks", "error"])

    for batch in batches:
        rows, chars = [], 0
        for page, html, source in zip(*(batch.column(c) for c in ("page_id", "html", "source_id")), strict=True):
            html, own = html.as_py() or "", SOURCE_CONTENT.get(source.as_py(), ())
            walk, error = Blocks(own + CONTENT), ""
            try:
                walk.feed(html)
                walk.close()
                walk.flush()
                walk.open.clear()
                walk.ended()
            except (ValueError, AssertionError) as broken:
                error = str(broken)
            rows.append((page.as_py(), walk.title, walk.article(len(own)), error))
            chars += len(html)
            if chars >= SENT_CHARS or len(rows) >= SENT_PAGES:
                yield sent(rows)
                rows, chars = [], 0
        if rows:
            yield sent(rows)


def bodies(pages: DataFrame) -> DataFrame:
    """page_id, title, body, raw, quality of every page (page_id, html, and source_id where it is known): the element that holds the article is chosen; of its text, raw, furniture, repeated blocks and the title's
    own heading are dropped. Both are cut at 40 000 characters. A page that cannot be read has an error."""
    pages = pages.select("page_id", "html", F.col("source_id") if "source_id" in pages.columns else F.lit("").alias("source_id"))
    walked = pages.mapInArrow(_walked, "page_id long, title string, blocks array<string>, error string")
    keys = F.transform("blocks", lambda b: F.lower(F.regexp_replace(b, r"^[#>\- ]+", "")))
    kept = F.filter("blocks", lambda b, i: ~is_noise(b) & ((F.length(b) < 30) | (F.array_position(F.col("keys"), F.element_at("keys", i + 1)) == i + 1)))
    body = F.substring(F.array_join(without_title(kept, F.col("title")), "\n\n"), 1, MOST)
    out = walked.withColumn("keys", keys).withColumn("body", body)
    return out.select("page_id", "title", "body", F.substring(F.array_join("blocks", "\n\n"), 1, MOST).alias("raw"), quality(F.col("body"), F.lit("web")).alias("quality"), "error")


def extracted(articles: DataFrame, fetched: DataFrame, cache: DataFrame) -> DataFrame:
    """id, text, method, quality, error, from_cache of every article: a batch in which a row's failure is that row's error.

    articles: id, url, summary, feed_body; fetched: url, html, content_type, error (of the request, or null); cache: url, text, method, quality. Of pages fetched twice one without an error counts, of
    cached ones the first by text; so each article has one row.
    """
    fetched = fetched.groupBy("url").agg(F.min_by(F.struct("html", "content_type", "error"), F.struct(F.col("error").isNotNull(), "html", "content_type")).alias("x")).select("url", "x.*")
    cache = cache.groupBy("url").agg(F.min(F.struct("text", "method", "quality")).alias("x")).select("url", "x.*")
    numbered = articles.select("id", "url", "summary", "feed_body")
    html = fetched.select("url", F.xxhash64("url").alias("page_id"), "html", "content_type", F.col("error").alias("request_error"))
    pages = html.join(bodies(html), "page_id").select("url", F.col("body").alias("page"), "content_type", F.col("quality.verdict").alias("page_verdict"), F.col("quality.reason").alias("page_reason"), F.coalesce("request_error", F.nullif("error", F.lit(""))).alias("page_error"))
    feeds = bodies(numbered.select(F.xxhash64("id").alias("page_id"), F.col("feed_body").alias("html"))).select(F.col("page_id").alias("feed_id"), F.col("body").alias("feed"), F.col("quality.verdict").alias("feed_verdict"))
    known = cache.select("url", F.struct("text", "method", "quality").alias("cached"))
    rows = numbered.withColumn("feed_id", F.xxhash64("id")).join(feeds, "feed_id").join(pages, "url", "left").join(known, "url", "left")
    error = F.coalesce(F.col("page_error"), F.when(F.col("page").isNull(), "not fetched"))
    body = choice.selected(F.col("cached"), F.col("feed"), F.col("feed_verdict"), F.col("page"), F.col("content_type"), F.col("page_verdict"), F.col("page_reason"), error, F.col("summary"))
    return rows.select("id", body.alias("b")).select("id", "b.*")


def _array_after(html: str, marker: str) -> str | None:
    """The balanced [...] that follows a marker; brackets inside strings do not count. Escaped quotes of scripts in strings are undone first."""
    at = html.find(marker)
    if at < 0:
        return None
    text = html[at + len(marker) :]
    start = text.find("[")
    if start < 0:
        return None
    if text[start:].lstrip("[ {").startswith('\\"'):
        text = text.replace('\\"', '"')
    depth, quoted, skip = 0, False, False
    for i, c in enumerate(text[start:], start):
        if skip:
            skip = False
        elif quoted and c == "\\":
            skip = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "[]":
            depth += 1 if c == "[" else -1
            if not depth:
                return text[start : i + 1]
    return None


def embedded_rows(pages: DataFrame, marker: str, schema: str) -> DataFrame:
    """page_id and the rows of the JSON array that follows the marker in each page; pages without one give none."""

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"page_id": batch.page_id, "json": [_array_after(h or "", marker) for h in batch.html]})

    arrays = pages.select("page_id", "html").mapInPandas(found, "page_id long, json string")
    return arrays.select("page_id", F.explode(F.from_json("json", f"array<struct<{schema}>>")).alias("row")).select("page_id", "row.*")
