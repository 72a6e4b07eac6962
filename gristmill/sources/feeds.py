"""Feeds as rows: RSS and Atom, parsed by Spark's own XML reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.times import published

_ITEM = "struct<title: string, link: string, guid: string, description: string, pubDate: string, content: string, encoded: string>"
_LINK = "struct<_href: string, _rel: string>"
_TEXT = "struct<_VALUE: string, _type: string>"
_ENTRY = f"struct<title: {_TEXT}, link: array<{_LINK}>, id: string, summary: {_TEXT}, content: {_TEXT}, published: string, updated: string>"
#: A channel alone, an RSS document or an Atom document.
FEED = f"item array<{_ITEM}>, channel struct<item: array<{_ITEM}>>, entry array<{_ENTRY}>, _corrupt_record string"


def _absolute(value: Column) -> Column:
    value = F.trim(value)
    return F.when(value.rlike("^https?://"), value)


def _resolved(direct: Column, links: Column, others: list[Column], base: Column) -> Column:
    """The first absolute address among the link and its alternatives, else the first relative one completed with the base."""
    site = F.regexp_extract(F.coalesce(base, F.lit("")), "^https?://[^/]+", 0)
    relative = [F.when(F.startswith(F.trim(x), F.lit("/")) & (site != ""), F.concat(site, F.trim(x))) for x in (direct, *others)]
    return F.coalesce(_absolute(direct), F.get(F.filter(F.transform(links, _absolute), lambda u: u.isNotNull()), F.lit(0)), *relative)


def _longest(*parts: Column) -> Column:
    """The longest text; of equal ones the first."""
    return F.array_max(F.array(*[F.struct(F.length(F.coalesce(p, F.lit(""))).alias("n"), F.lit(-i).alias("i"), F.coalesce(p, F.lit("")).alias("x")) for i, p in enumerate(parts)]))["x"]


def parsed(feeds: DataFrame) -> DataFrame:
    """source_id, base_url, items (title, url, published_at, summary, body), failed of feeds (source_id, xml, and base_url if there is one). A broken feed without items has failed."""
    base = F.col("base_url") if "base_url" in feeds.columns else F.lit(None).cast("string")
    bare = F.regexp_replace("xml", r"(</?)(?:content|atom):", "$1")
    rows = feeds.select("source_id", base.alias("base_url"), F.from_xml(bare, FEED, {"mode": "PERMISSIVE", "valueTag": "_VALUE", "attributePrefix": "_"}).alias("f"))
    none = F.array().cast("array<string>")

    def item(i: Column) -> Column:
        guid = F.coalesce(_resolved(i["link"], F.array(_absolute(i["guid"])), [i["guid"]], F.col("base_url")))
        return F.struct(F.trim(i["title"]).alias("title"), guid.alias("url"), published(i["pubDate"]).alias("published_at"), F.coalesce(i["description"], F.lit("")).alias("summary"), _longest(i["encoded"], i["content"], i["description"]).alias("body"))

    def entry(e: Column) -> Column:
        links = F.coalesce(F.transform(e["link"], lambda x: x["_href"]), none)
        url = _resolved(F.get(links, F.lit(0)), links, [e["id"]], F.col("base_url"))
        return F.struct(F.trim(e["title"]["_VALUE"]).alias("title"), url.alias("url"), published(F.coalesce(e["published"], e["updated"])).alias("published_at"), F.coalesce(e["summary"]["_VALUE"], F.lit("")).alias("summary"), _longest(e["content"]["_VALUE"], e["summary"]["_VALUE"]).alias("body"))

    lists = [F.transform(F.col("f.item"), item), F.transform(F.col("f.channel.item"), item), F.transform(F.col("f.entry"), entry)]
    items = F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists], F.filter(lists[0], lambda x: F.lit(False)), F.filter(F.array(item(F.from_json(F.lit("{}"), _ITEM))), lambda x: F.lit(False)))
    broken = F.col("f").isNull() | F.col("f._corrupt_record").isNotNull()
    return rows.select("source_id", "base_url", items.alias("items"), (broken & (F.size(items) == 0)).alias("failed"))


def feed_items(feeds: DataFrame) -> DataFrame:
    """source_id, title, url, published_at, summary, body, valid of each item of feeds; an item lacks validity without title, address or time."""
    rows = parsed(feeds).select("source_id", F.explode("items").alias("i")).select("source_id", "i.*")
    return rows.withColumn("valid", (F.coalesce("title", F.lit("")) != "") & F.col("url").isNotNull() & F.col("published_at").isNotNull())
