"""Incremental forms. Each takes a streaming DataFrame; finished() runs one to the end of its input into a table."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gristmill.functions.text import normal_title
from gristmill.operators.dedup import HORIZON, Spans
from gristmill.operators.tables import numbers_in, put_once, travels

travels(__name__)


def first_urls(stream: DataFrame, horizon: str = "48 hours") -> DataFrame:
    """The first row of each URL within the horizon. First seen wins, where the batch form picks the best."""
    return stream.withWatermark("published_at", horizon).dropDuplicatesWithinWatermark(["url"])


def first_titles(stream: DataFrame, horizon: str = "48 hours") -> DataFrame:
    """The first row of each normalised title within the horizon."""
    keyed = stream.withColumn("title_key", normal_title(F.col("title")))
    return keyed.withWatermark("published_at", horizon).dropDuplicatesWithinWatermark(["title_key"])


#: Keyed state with timers needs a store that holds several kinds of state.
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class TitleClusters(StatefulProcessor):
    """The open clusters of one title. A row joins the first that has a member within the horizon, else it begins one; clusters never merge.

    A member came within the horizon of another, so a cluster covers all times from its first member's less the horizon to its last one's plus the horizon: two numbers tell it.
    Founders lie further apart than the horizon, so a title has no more clusters open than the time that is still awaited has horizons.
    """

    def __init__(self, horizon: int):
        self.horizon = horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "number int", "first string, low long, high long, rows long, official int, priority int, at long, canonical_url string, url string")
        self.begun = handle.getValueState("begun", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        found = {n[0]: list(c) for n, c in self.open.iterator()}
        begun = (self.begun.get() or (0,))[0]
        late = timerValues.getCurrentWatermarkInMs() * 1000
        touched, spans = set(), Spans(self.horizon)
        for n, c in found.items():
            spans.put(n, c[1])
            spans.put(n, c[2])
        # the rows of a batch in the order in which the batch form reads them
        for canonical, url, us, official, priority in sorted((r.canonical_url, r.url, r.us, r.official, r.priority) for r in rows if r.us >= late):
            number = spans.find(us)
            if number is None:
                number, begun = begun, begun + 1
                found[number] = [f"{canonical}\n{url}", us, us, 0, official, priority, us, canonical, url]
            spans.put(number, us)
            c = found[number]
            c[1:4] = min(c[1], us), max(c[2], us), c[3] + 1
            c[4:] = min(c[4:], [official, priority, us, canonical, url])
            touched.add(number)
        for number in touched:
            self.open.updateValue((number,), tuple(found[number]))
        self.begun.update((begun,))
        self._wait(found)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Tells the clusters that no row can join any more."""
        now, left = timerValues.getCurrentWatermarkInMs() * 1000, {}
        for number, c in [(n[0], list(c)) for n, c in self.open.iterator()]:
            if c[2] + self.horizon < now:
                self.open.removeKey((number,))
                yield Row(title_key=key[0], cluster=c[0], url=c[8], us=c[6], rows=c[3])
            else:
                left[number] = c
        self._wait(left)

    def _wait(self, found: dict[int, list]) -> None:
        if found:
            self.handle.registerTimer((min(c[2] for c in found.values()) + self.horizon) // 1000 + 1)


def title_clusters(stream: DataFrame, late: str = "0 seconds", horizon: int = HORIZON) -> DataFrame:
    """The clusters of dedup.by_title over a stream: title_key, cluster, url and published_at of the best row by dedup.winner_order, and rows, once no row can join.

    Rows of stream have title, source_type, priority, published_at, canonical_url and url. They join in the order of their batches, and within one in that of the batch form; so a
    stream that comes in that order, and by no more than `late` behind, has the clusters of the batch form. Rows further behind are dropped. Sets the session's state store to RocksDB.
    """
    stream.sparkSession.conf.set(PROVIDER, ROCKS)
    keyed = stream.withColumn("title_key", normal_title(F.col("title"))).where("title_key <> '' AND published_at IS NOT NULL").withWatermark("published_at", late)
    rows = keyed.select("title_key", "canonical_url", "url", "published_at", F.unix_micros("published_at").alias("us"), (F.col("source_type") != "official").cast("int").alias("official"), F.col("priority").cast("int").alias("priority"))
    told = rows.groupBy("title_key").transformWithState(TitleClusters(horizon), "title_key string, cluster string, url string, us long, rows long", "append", "eventTime")
    return told.select("title_key", "cluster", "url", F.timestamp_micros("us").alias("published_at"), "rows")


def source_health(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Runs and failures of each source and day."""
    days = stream.withWatermark("started_at", late).groupBy(F.window("started_at", "1 day").alias("w"), "source_id")
    return days.agg(F.count("*").alias("runs"), F.count_if(~F.col("success")).alias("failures")).select("source_id", F.col("w.start").alias("day"), "runs", "failures")


def finished(stream: DataFrame, folder: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over all of its input now and read what it wrote. keys: an updating stream, of which the last row of each key counts."""
    spark, path = stream.sparkSession, f"{folder}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is run again after a failure replaces its own folder
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    stream.writeStream.outputMode("update" if keys else "append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    rows = spark.read.parquet(f"{path}/rows").drop("batch")
    if not keys:
        return rows.drop("_batch")
    values = [c for c in rows.columns if c not in (*keys, "_batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("v")).select(*keys, "v.*")


def refreshed(stream: DataFrame, path: str, plan: Callable[[DataFrame, DataFrame], DataFrame], projects: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Refresh a digest with each batch: all rows are archived by day, and plan(linked, batch) gives the rows to link anew from those linked before and the batch's.

    projects(batch) gives the projects found with a batch. What a batch made is told by its commit, path/commits/<batch>: which batches' links and projects count from then on. A plan that
    finds nothing keeps the links before, and a batch without projects the projects. A batch that is run again begins from the commit before its own, so it makes the same; what it had written without a
    commit nobody reads. Read with linked() and linked_projects().
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        if number in numbers_in(spark, f"{path}/commits"):
            return
        before = committed(spark, path, number)
        batch = batch.persist()
        batch.withColumn("_day", F.to_date("published_at")).write.partitionBy("_day").mode("overwrite").parquet(f"{path}/archive/batch={number}")
        now = dict(before)
        old = spark.read.parquet(f"{path}/links/{before['links']}").select(*batch.columns) if before["links"] is not None else batch.limit(0)
        made = {"links": plan(old, batch)} | ({"projects": projects(batch)} if projects else {})
        for name, rows in made.items():
            rows.write.mode("overwrite").parquet(f"{path}/{name}/{number}")
            if not spark.read.schema(rows.schema).parquet(f"{path}/{name}/{number}").isEmpty():
                now[name] = number
        batch.unpersist()
        put_once(spark, f"{path}/commits/{number}", json.dumps(now))

    stream.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def committed(spark: SparkSession, path: str, before: int | None = None) -> dict[str, int | None]:
    """The batches whose links and projects count: after the last commit, or the last before a batch."""
    numbers = [n for n in numbers_in(spark, f"{path}/commits") if before is None or n < before]
    return json.loads(spark.read.text(f"{path}/commits/{numbers[-1]}", wholetext=True).first()[0]) if numbers else {"links": None, "projects": None}


def linked(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/links/{committed(spark, path)['links']}")


def linked_projects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/projects/{committed(spark, path)['projects']}")
