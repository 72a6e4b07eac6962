"""Which body an article gets: the cached one, the feed's, its page's, or the longer of what the feed gave; and the counts of a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters that a feed's body and a page's must have to be taken, and the words of the errors below.
FEED_LEAST, PAGE_LEAST = 600, 200


def selected(cached: Column, feed: Column, feed_verdict: Column, page: Column, page_type: Column, page_verdict: Column, page_reason: Column, page_error: Column, summary: Column) -> Column:
    """Struct of text, method (web, rss_full, rss_summary, none), quality, error and from_cache.

    cached: struct of text, method and quality, or null. page_error: why the page could not be fetched or read; page_type: its content type.
    """
    feed, page, summary = (F.coalesce(c, F.lit("")) for c in (feed, page, summary))
    usable_feed = (F.length(feed) >= FEED_LEAST) & (F.coalesce(feed_verdict, F.lit("good")) != "fallback")
    html = F.lower(F.coalesce(page_type, F.lit(""))).rlike("html|^$")
    error = (
        F.when(page_error.isNotNull(), page_error)
        .when(~html, F.concat(F.lit("not HTML ("), page_type, F.lit(")")))
        .when(F.trim(page) == "", "empty body")
        .when(F.length(page) < PAGE_LEAST, F.concat(F.lit("page too short ("), F.length(page), F.lit(" chars)")))
        .when(page_verdict != "good", F.concat(F.lit("low quality page ("), F.coalesce(F.nullif(page_reason, F.lit("")), page_verdict), F.lit(")")))
    )
    rest = F.when(F.length(summary) > F.length(feed), summary).otherwise(feed)

    def body(text: Column, method: str, quality: Column, error: Column) -> Column:
        return F.struct(text.alias("text"), F.lit(method).alias("method"), quality.alias("quality"), error.alias("error"), F.lit(False).alias("from_cache"))

    none = F.lit(None).cast("string")
    return (
        F.when(cached.isNotNull(), F.struct(cached["text"].alias("text"), cached["method"].alias("method"), cached["quality"].alias("quality"), none.alias("error"), F.lit(True).alias("from_cache")))
        .when(usable_feed, body(feed, "rss_full", F.coalesce(feed_verdict, F.lit("good")), none))
        .when(error.isNull(), body(page, "web", page_verdict, none))
        .when(rest != "", body(rest, "rss_summary", F.lit("low"), error))
        .otherwise(body(F.lit(""), "none", none, F.coalesce(error, F.lit("no content"))))
    )


def stats(bodies: DataFrame) -> DataFrame:
    """One row of counts of a batch of method, error, from_cache: candidates, rss_full, web, fallback, failed, rejected_low_quality, cache_hits."""
    how = F.col("method")
    return bodies.agg(
        F.count("*").alias("candidates"),
        F.count_if(how == "rss_full").alias("rss_full"),
        F.count_if(how == "web").alias("web"),
        F.count_if(~how.isin("rss_full", "web")).alias("fallback"),
        F.count_if(F.coalesce(F.col("error"), F.lit("")) != "").alias("failed"),
        F.count_if(F.startswith(F.col("error"), F.lit("low quality page"))).alias("rejected_low_quality"),
        F.count_if("from_cache").alias("cache_hits"),
    )
