"""One digest from an archive: window, one row a URL, media caps, labels, base score, the best with rank."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import rules, times
from gristmill.operators import dedup, ranking
from gristmill.operators.tables import stored

FIELDS = ("title_cn", "title_original", "summary", "why_it_matters", "source")


def labelled(items: DataFrame) -> DataFrame:
    """items with topic and company."""
    fields = [F.col(c) for c in FIELDS]
    return items.withColumn("topic", rules.topic(*fields)).withColumn("company", rules.company(*fields))


def digest(articles: DataFrame, sources: DataFrame, start: Column, end: Column, most: int = 10) -> DataFrame:
    """rank, id, title_original, topic, company, score of the best articles of (start, end]."""
    inside = articles.where(times.in_window(F.col("published_at"), start, end)).withColumn("title", F.col("title_original"))
    kept = ranking.media_decisions(dedup.by_url(inside, sources)).where("kept")
    order = [F.desc("score"), F.desc_nulls_last("published_at"), F.asc("id")]
    best = labelled(kept).withColumn("score", ranking.base_score(start, end, F.lit(1))).orderBy(*order).limit(most)
    # as few rows as the limit, so numbering them in one task is bounded
    return best.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "id", "title_original", "topic", "company", "score")


@dataclass(frozen=True)
class Refresh:
    """The steps of a refresh: rows of the batch inside the window, one a URL, one a title; with what is linked before, one an event; what media caps leave; and what is linked, with rank."""

    in_window: DataFrame
    distinct_urls: DataFrame
    distinct_titles: DataFrame
    distinct_events: DataFrame
    selected: DataFrame
    linked: DataFrame

    def funnel(self) -> DataFrame:
        """stage, n: rows after each step."""
        return reduce(DataFrame.union, [getattr(self, f.name).agg(F.count("*").alias("n")).select(F.lit(f.name).alias("stage"), "n") for f in fields(self)])


def steps(linked: DataFrame, batch: DataFrame, sources: DataFrame, start: Column, end: Column) -> Refresh:
    """The batch is folded by URL and title; with what is linked before, then, by event, so that a batch never brings back what another told. Media caps, labels and diverse ranks follow. Nothing is cut at the end."""
    columns = linked.columns
    inside = batch.where(times.in_window(F.col("published_at"), start, end)).withColumn("title", F.col("title_original"))
    by_url = dedup.by_url(inside, sources)
    titles = stored(dedup.title_winners(dedup.by_title(by_url)).select(*columns), "titles")
    # what is linked comes first, so of one id the linked row stays
    candidates = stored(linked.unionByName(titles.join(linked.select("id"), "id", "left_anti").select(*columns)), "candidates")
    clusters = dedup.event_clusters(candidates, dedup.event_links(dedup.event_classes(candidates)))
    winners = stored(dedup.event_winners(candidates, clusters, sources).drop("priority", "cluster"), "winners")
    kept = labelled(ranking.media_decisions(winners).where("kept").drop("kept", "reason"))
    scored = kept.withColumn("base_score", ranking.rounded(ranking.base_score(start, end, F.col("cluster_size")))).withColumn("digest_date", F.date_format(end, "yyyy-MM-dd"))
    ranks = ranking.diverse(scored).select("id", "rank", F.col("final_score").alias("score"))
    return Refresh(inside, by_url, titles, winners, kept, kept.join(ranks, "id"))


def merged(linked: DataFrame, batch: DataFrame, sources: DataFrame, start: Column, end: Column) -> DataFrame:
    """The rows that a digest of (start, end] links after a batch, with rank, score, cluster_size, topic and company."""
    return steps(linked, batch, sources, start, end).linked


def digest_windows(links: DataFrame, articles: DataFrame) -> DataFrame:
    """digest_date, window_start, window_end of each stored digest: a window starts where the one before ends, else a day before its own end. One row a day."""
    ends = links.join(articles.select(F.col("id").alias("news_id"), "published_at"), "news_id").groupBy("digest_date").agg(F.max("published_at").alias("window_end"))
    before = F.lag("window_end").over(Window.orderBy("digest_date"))
    return ends.select("digest_date", F.coalesce(before, F.col("window_end") - F.expr("INTERVAL 24 HOURS")).alias("window_start"), "window_end")


def rebuilt(items: DataFrame, windows: DataFrame, most: int | None = None) -> DataFrame:
    """digest_date, news_id, position of the digests of some windows, ranked anew from the archive (labelled), each row's recency in its own window; all rows, or the first of each.

    Windows are cut by days, so that an article meets those of its day by an equality.
    """
    days = windows.withColumn("day", F.explode(F.sequence(F.to_date("window_start"), F.to_date("window_end"))))
    rows = items.withColumn("day", F.to_date("published_at")).join(days, "day").where(times.in_window(F.col("published_at"), F.col("window_start"), F.col("window_end")))
    scored = rows.withColumn("base_score", ranking.rounded(ranking.base_score(F.col("window_start"), F.col("window_end"), F.lit(1))))
    ranks = ranking.diverse(scored) if most is None else ranking.diverse_top(scored, most)
    return ranks.select("digest_date", F.col("id").alias("news_id"), (F.col("rank") - 1).alias("position"))


def rebuild_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """change (added, removed), digest_date, news_id: what storing new (of the dates that both have) would change in old. Store with tables.replaced."""
    keys = ["digest_date", "news_id"]
    added = new.join(old, keys, "left_anti").select(F.lit("added").alias("change"), *keys)
    return added.unionByName(old.join(new, keys, "left_anti").select(F.lit("removed").alias("change"), *keys))
