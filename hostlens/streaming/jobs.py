"""Streaming jobs over an event source. Watermarks are ten minutes; later rows are dropped. A watermark begins at the start
of 1970, so rows of that time or before are late for keyed state.

Events of one micro-batch are taken in order of time; an event that arrives in a later batch than a newer one is compared
with what was known when it came, unlike in a batch job over all events.
"""

from __future__ import annotations

import threading
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from hostlens.sources import sinks
from hostlens.streaming.state import KEY, Idle, LastTokens, RunningStats

WATERMARK = "10 minutes"
IDLE_MS = 24 * 3600 * 1000  #: event time without an event after which a key's state goes
BUCKETS = 1024  #: lists that the keys of a stream with keyed state are dealt into
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """An event feed from a folder of Parquet files, with times as UTC instants."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def run(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over all that is there into a Parquet table.

    State is kept in RocksDB, which spills to disk and can hold what processors declare; the session's own choice of a
    store is put back.
    """
    conf = df.sparkSession.conf
    before = conf.get(STORE, None)
    conf.set(STORE, ROCKS)
    try:
        query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(out)
        query.awaitTermination()
    finally:
        conf.set(STORE, before) if before is not None else conf.unset(STORE)
    return query


def run_batches(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream through a function of each micro-batch, as stores that replace rows need it."""
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    return query


def _with_state(events: DataFrame, processor: Idle, key: str, schema: str, ts_col: str, buckets: int) -> DataFrame:
    kinds, text = dict(events.dtypes), F.col(key).cast("string")
    bucket = F.pmod(F.xxhash64(text), F.lit(buckets)).cast("int").alias("key_bucket")
    rows = events.withWatermark(ts_col, WATERMARK).select(ts_col, bucket, text.alias(KEY), processor.id_col, processor.value, F.unix_millis(ts_col).alias("ts_ms"))
    names = f"{KEY} string, {processor.id_col} {kinds[processor.id_col]}, {schema}"
    rows = rows.groupBy("key_bucket").transformWithStateInPandas(processor, names, "Append", "EventTime")
    return rows.select(F.col(KEY).cast(kinds[key]).alias(key), *[c for c in rows.columns if c != KEY])


def running_stats(events: DataFrame, key: str, value: str, id_col: str, idle_ms: int = IDLE_MS, ts_col: str = "ts", buckets: int = BUCKETS) -> DataFrame:
    """Each event with count, mean and deviation of the key's events before it, since the key was last idle."""
    return _with_state(events, RunningStats(id_col, value, idle_ms), key, "n_before long, mean_before double, std_before double", ts_col, buckets)


def last_tokens(events: DataFrame, key: str, token: str, id_col: str, most: int = 64, closes: str | None = None, idle_ms: int = IDLE_MS, ts_col: str = "ts", buckets: int = BUCKETS) -> DataFrame:
    """The key's last tokens at each event. A token that ``closes`` ends the key's state after it is reported."""
    return _with_state(events, LastTokens(id_col, token, idle_ms, most, closes), key, "recent string", ts_col, buckets)


def first_alerts(alerts: DataFrame, keys: list[str], ts_col: str = "ts") -> DataFrame:
    """Drop alerts that repeat a key within the watermark."""
    return alerts.withWatermark(ts_col, WATERMARK).dropDuplicatesWithinWatermark(keys)


def split_bad(events: DataFrame, is_bad: str) -> tuple[DataFrame, DataFrame]:
    """Good rows and rows for quarantine; null tests count as bad."""
    bad = F.coalesce(F.expr(is_bad), F.lit(True))
    return events.where(~bad), events.where(bad)


class Totals(StreamingQueryListener):
    """Adds up the metrics that a stream's batches observe under a name, as Spark reports them.

    Metrics come with the batch that was committed, so one that runs again counts once.
    """

    def __init__(self, name: str):
        self.name, self.totals, self.batches, self.over = name, Counter(), set(), threading.Event()
        self.query_id: str | None = None

    def onQueryStarted(self, event) -> None:
        if self.query_id is None and event.name == self.name:
            self.query_id = str(event.id)

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None and str(event.progress.id) == self.query_id and event.progress.batchId not in self.batches:
            self.batches.add(event.progress.batchId)
            self.totals.update({k: v or 0 for k, v in row.asDict().items()})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.id) == self.query_id:
            self.over.set()


def run_counted(events: DataFrame, counters: dict[str, Column], each: Callable[[DataFrame, int], None], checkpoint: str, name: str, wait: float = 60.0) -> dict[str, int]:
    """Run a stream through a function of each micro-batch and count its rows on the way.

    ``counters`` are aggregates over all rows that arrive; ``name`` must be the stream's own. A batch is written down once,
    which is when its rows are counted, and ``each`` reads it as often as it likes.
    """
    spark = events.sparkSession
    totals = Totals(name)

    def once(batch: DataFrame, k: int) -> None:
        path = sinks.scratch(batch.sparkSession)
        batch.write.parquet(path)
        each(batch.sparkSession.read.schema(batch.schema).parquet(path), k)
        sinks.removed(batch.sparkSession, path)

    spark.streams.addListener(totals)
    try:
        first, *more = [c.cast("long").alias(k) for k, c in counters.items()]
        query = events.observe(name, first, *more).writeStream.queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(once).start()
        query.awaitTermination()
        if not totals.over.wait(wait):  # reports come after the last batch, by another thread
            raise TimeoutError(f"no report of the end of {name}")
    finally:
        spark.streams.removeListener(totals)
    return {k: totals.totals[k] for k in counters}


class Newest:
    """The newest ``most`` rows of a stream, kept from batch to batch: never more than those are stored."""

    def __init__(self, folder: str, most: int, order: list[str]):
        self.folder, self.most, self.order = folder, most, order

    def rows(self, spark: SparkSession, k: int) -> DataFrame | None:
        """What is kept after batch k."""
        return spark.read.parquet(f"{self.folder}/batch={k}") if k >= 0 else None

    def on_batch(self, rows: DataFrame, k: int) -> None:
        """A batch that runs again reads what the one before left and writes the same."""
        before = self.rows(rows.sparkSession, k - 1)
        both = rows if before is None else before.unionByName(rows)
        both.orderBy(*[F.desc(c) for c in self.order]).limit(self.most).write.mode("overwrite").parquet(f"{self.folder}/batch={k}")
        self.latest = k
