"""The periodic refresh as Structured Streaming.

Several queries may feed one store, each with its own checkpoint folder, which
holds the name that its batches carry in the store. They take turns: a
micro-batch waits while another run has the store. The file source remembers
what it has read; ids are checked against the stored keys, so history is
unbounded in time without any streaming state, and a micro-batch that is
repeated after a failure rewrites its own partitions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery, StreamingQueryListener

from newsloom.operators import alerts
from newsloom.plans.run import Result, Settings, log_run, run_batch
from newsloom.sources import feeds
from newsloom.sources.tables import Store

REFRESH_SECONDS = 60
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTS = "spark.sql.shuffle.partitions"
WAIT_SECONDS = 3600       # of a micro-batch for another run on the store


def _start(writer, checkpoint: str, once: bool, seconds: int) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    if once:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{seconds} seconds").start()


def stream_name(spark: SparkSession, checkpoint: str) -> str:
    """The name that a checkpoint folder gives its batches: made once, kept beside Spark's own files."""
    path = f"{checkpoint.rstrip('/')}/stream-name"
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path):
        spark.createDataFrame([(uuid.uuid4().hex[:12],)], "name string").coalesce(1).write.mode("overwrite").text(path)
    return spark.read.text(path).head()[0]


class ProgressLog(StreamingQueryListener):
    """Writes what one refresh query reports into the run log: rows read per micro-batch, and when it falls idle."""

    def __init__(self, store: Store, query: StreamingQuery):
        self.store, self.name, self.id = store, query.name, str(query.id)
        self.idle = False

    def _log(self, key: str, status: str, rows: int, message: str) -> None:
        log_run(self.store, f"{self.name}-{key}", status, "progress", F.current_timestamp(), Result(fetched=rows), message)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if str(progress.id) == self.id and progress.numInputRows:
            self.idle = False
            self._log(f"progress-{progress.batchId}", "ok", int(progress.numInputRows), progress.prettyJson)

    def onQueryIdle(self, event) -> None:
        if str(event.id) == self.id and not self.idle:      # once per quiet stretch
            self.idle = True
            self._log(f"idle-{event.timestamp}", "idle", 0, "")

    def onQueryTerminated(self, event) -> None:
        pass


def log_progress(store: Store, query: StreamingQuery) -> ProgressLog:
    """Log the progress of ``query`` from now on; take the result to ``spark.streams.removeListener`` to stop."""
    listener = ProgressLog(store, query)
    store.spark.streams.addListener(listener)
    return listener


def refresh(
    spark: SparkSession,
    landing: str,
    store: Store,
    settings: Settings,
    checkpoint: str,
    as_of: Callable[[], Column] = F.current_timestamp,
    once: bool = False,
    seconds: int = REFRESH_SECONDS,
    atom: bool = False,
    wait_seconds: float = WAIT_SECONDS,
) -> StreamingQuery:
    """Run every landed drop of feed files through ``run_batch``. The query's name is that of its batches."""
    scan = feeds.scan_atom if atom else feeds.scan_rss
    entries = scan(spark, landing, stream=True)
    name = f"stream-{stream_name(spark, checkpoint)}"

    def each(batch: DataFrame, number: int) -> None:
        result = run_batch(
            batch.sparkSession, store, feeds.in_file_order(batch), settings, as_of(),
            f"{name}-{number}", reason="scheduler", wait_seconds=wait_seconds,
        )
        if result.status == "busy":
            raise RuntimeError(f"the store was busy for {wait_seconds} seconds")

    return _start(entries.writeStream.queryName(name).foreachBatch(each), checkpoint, once, seconds)


def each_batch(
    rows: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    once: bool = False,
    seconds: int = REFRESH_SECONDS,
) -> StreamingQuery:
    """Run ``handle`` on every micro-batch of a streaming frame."""
    return _start(rows.writeStream.foreachBatch(handle), checkpoint, once, seconds)


def announce_once(
    signals: DataFrame,
    event_time: str | None = None,
    delay: str = "7 days",
) -> DataFrame:
    """Streaming signals worth an alert, each ``news_id`` a single time.

    With ``event_time`` the state is dropped after ``delay``; without it every
    id is remembered for as long as the query lives.
    """
    due = signals.filter(alerts.should_alert())
    if event_time is None:
        return due.dropDuplicates(["news_id"])
    return due.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["news_id"])


class Announced(StatefulProcessor):
    """Remembers of each id that it was announced, until its time is over."""

    def __init__(self, life_seconds: float):
        self.life_ms = int(life_seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean", self.life_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.seen.exists()
        first = None
        for batch in rows:
            if not known and len(batch):
                batch = batch if first is None else pd.concat([first, batch])
                first = batch.sort_values("message", kind="stable").head(1)
        if first is not None:
            self.seen.update((True,))
            yield first

    def close(self) -> None:
        pass


def announce_while(signals: DataFrame, message: Column, life_seconds: float) -> DataFrame:
    """``news_id, message`` of streaming signals worth an alert, once per ``life_seconds`` (of the clock) for each id.

    The state of an id expires by itself, so it follows the ids of that time,
    not those of all time. It lies in RocksDB, on the executors' disks and in
    the checkpoint folder. Of several rows of an id in one micro-batch the one
    with the smallest message goes out. The session runs no batches without
    data from then on: they would follow each other forever, as there is always
    state that expires next, and what is over is not read anyhow.
    """
    signals.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    signals.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    due = signals.filter(alerts.should_alert()).select("news_id", message.alias("message"))
    return due.groupBy("news_id").transformWithStateInPandas(
        Announced(life_seconds), due.schema, "Append", "ProcessingTime")


def to_files(
    rows: DataFrame, path: str, checkpoint: str, once: bool = False,
    seconds: int = REFRESH_SECONDS, state_parts: int | None = None,
) -> StreamingQuery:
    """Append a stream to Parquet files, exactly once per row.

    ``state_parts`` is the number of partitions that its state is dealt to; the
    checkpoint keeps the number of its first start. Without it the session's
    number of shuffle partitions holds: each is opened in every micro-batch,
    which for a state that Python looks after takes seconds, whatever it holds.
    """
    writer = rows.writeStream.format("parquet").option("path", path).outputMode("append")
    conf = rows.sparkSession.conf
    before = conf.get(PARTS)
    conf.set(PARTS, str(state_parts or before))       # the stream has a copy of these settings
    try:
        return _start(writer, checkpoint, once, seconds)
    finally:
        conf.set(PARTS, before)
