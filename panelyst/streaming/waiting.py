"""Payloads that wait for their pages, as streaming state.

What is kept of a waiting payload is one small entry a page - the file that holds it and its row count - never the
rows. When the pages' counts add up to the total that the payload declares, its files are handed out once and the
entries go. A taken payload is remembered for a while, so that a page that lands again changes nothing; a payload that
never becomes whole is handed out as expired. No earlier page is read again, however long the history.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from panelyst.sources.payloads import PAYLOAD, keyed_pages, parse_pages

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
OUT = "indicator string, vintage string, declared long, page long, file string, rows long, status string"
#: How long a taken payload is remembered, and how long a partial one may wait.
REMEMBERED_MS, PATIENCE_MS = 24 * 3600 * 1000, 7 * 24 * 3600 * 1000


class Waiting(StatefulProcessor):
    """One payload: its pages until they are whole, then that they were taken."""

    def __init__(self, remembered_ms: int, patience_ms: int):
        self.remembered_ms, self.patience_ms = remembered_ms, patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page long", "file string, rows long")
        self.taken = handle.getValueState("taken", "taken boolean")

    def _restart_timer(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)

    def _out(self, key, status: str) -> Iterator[Row]:
        for (page,), (file, rows) in sorted(self.pages.iterator(), key=lambda e: e[0][0]):
            yield Row(indicator=key[0], vintage=key[1], declared=key[2], page=page, file=file, rows=rows, status=status)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        landed = [(r.page, r.file, r.rows) for r in rows]
        if self.taken.exists():
            return
        for page, file, count in landed:
            # Of a page that lands twice the later file counts, whatever the order they are seen in.
            if not self.pages.containsKey((page,)) or self.pages.getValue((page,))[0] < file:
                self.pages.updateValue((page,), (file, count))
        now = timerValues.getCurrentProcessingTimeInMs()
        held = sum(value[1] for value in self.pages.values())
        if key[2] is None or held == key[2]:
            yield from self._out(key, "unknown" if key[2] is None else "complete")
            self.pages.clear()
            self.taken.update((True,))
            self._restart_timer(now + self.remembered_ms)
        else:
            self._restart_timer(now + self.patience_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.taken.exists():
            yield from self._out(key, "expired")
        self.pages.clear()
        self.taken.clear()


def page_facts(pages: DataFrame) -> DataFrame:
    """What the state keeps of good pages: the payload's key, the page, its file and its row count."""
    return keyed_pages(pages).select(
        *PAYLOAD, F.coalesce(F.col("meta.page").cast("long"), F.xxhash64("file")).alias("page"), "file",
        F.size("rows").cast("long").alias("rows"),
    )


def whole_payloads(pages: DataFrame, *, remembered_ms: int = REMEMBERED_MS, patience_ms: int = PATIENCE_MS) -> DataFrame:
    """The files of payloads that became whole (or expired), from a stream of parsed pages: a row for each page."""
    spark = pages.sparkSession
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKSDB)
    return page_facts(pages).groupBy(*PAYLOAD).transformWithState(
        Waiting(remembered_ms, patience_ms), outputStructType=OUT, outputMode="append", timeMode="ProcessingTime"
    )


def landed_text(spark: SparkSession, landing: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of landed files, whole."""
    reader = spark.readStream.format("text").option("wholetext", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(landing).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("body"))


def append_whole(text: DataFrame, target: str, checkpoint: str, *, remembered_ms: int = REMEMBERED_MS,
                 patience_ms: int = PATIENCE_MS) -> StreamingQuery:
    """Starts a stream that appends the files of whole payloads to the Parquet table ``target``, each exactly once.

    ``text`` is a stream of ``file, body``. The query ends when all that has landed is read. Timers that are due fire
    with the next file: batches without any would follow each other for ever.
    """
    text.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    found = whole_payloads(parse_pages(text), remembered_ms=remembered_ms, patience_ms=patience_ms)
    sink = found.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return sink.trigger(availableNow=True).start()
