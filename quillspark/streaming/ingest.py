"""Streams: files that arrive are ingested, generation streams are kept one per conversation, events are counted in windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspark.operators.ingestion import Store, ingest
from quillspark.sources.sections import loader_of

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, root: str) -> DataFrame:
    """path, content, time and size of files as they appear below root; hidden ones and unknown formats are left out."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(root)
    visible = ~F.col("path").rlike(r"/\.[^/]") & loader_of(F.col("path")).isNotNull()
    return files.filter(visible).select("path", "content", F.col("modificationTime").alias("modified"), "length")


def sync_stream(files: DataFrame, root: str, store: Store, checkpoint: str, tallies: list[dict[str, int]] | None = None, **options):
    """Start the sync: every batch of files that arrived is one run of ingest, and what is no longer below root is deleted.

    A run is written under the batch's number, so a batch that runs again after a failure replaces what it wrote. A stream
    of files names each path once; files written anew are found by ingestion.sync_folder, which may run between batches.
    """

    def body(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")  # names only
        told = ingest(batch, Store(spark, store.path), number + 1, listing=listing, **options)
        if tallies is not None:
            tallies.append(told)

    return files.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class NewestStream(StatefulProcessor):
    """State per key: the newest stream, and a timer for its end. Older ones are replaced, late ones refused.

    Rows: key, stream, at. Emits key, stream, at and status: live when a stream becomes the newest, replaced when a newer
    one takes its place (or it came too late to be the newest), expired when `seconds` of event time have passed since it began.
    """

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "stream string, at timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = None
        if self.newest.exists():
            stream, at = self.newest.get()
            held = (pd.Timestamp(at), stream)
        out = []
        for batch in rows:
            for stream, at in sorted(zip(batch["stream"], batch["at"], strict=True), key=lambda r: (r[1], r[0])):
                new = (pd.Timestamp(at), stream)
                if held is None or new > held:
                    if held is not None:
                        out.append((*key, held[1], held[0], "replaced"))
                    held = new
                    out.append((*key, new[1], new[0], "live"))
                elif new != held:
                    out.append((*key, new[1], new[0], "replaced"))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held is not None:
            self.newest.update((held[1], held[0].to_pydatetime()))
            self.handle.registerTimer(int(held[0].tz_localize("UTC").timestamp() * 1000) + self.seconds * 1000)
        yield pd.DataFrame(out, columns=["key", "stream", "at", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        stream, at = self.newest.get()
        self.newest.clear()
        yield pd.DataFrame([(*key, stream, pd.Timestamp(at), "expired")], columns=["key", "stream", "at", "status"])

    def close(self) -> None:
        pass


def newest_streams(rows: DataFrame, key: str, stream: str, at: str, seconds: int = 300, late: str = "0 seconds") -> DataFrame:
    """Changes of the live streams, one per key: key, stream, at, status, by NewestStream on the watermark of `at`.

    The state of a key is one row, and goes when its stream expires. The session's state store must be RocksDB (STATE_STORE).
    """
    named = rows.select(F.col(key).cast("string").alias("key"), F.col(stream).cast("string").alias("stream"), F.col(at).alias("at")).withWatermark("at", late)
    return named.groupBy("key").transformWithStateInPandas(NewestStream(seconds), "key string, stream string, at timestamp, status string", "Append", "EventTime")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Extra, beyond the reference: events per window and type with a watermark, for streams and batches alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
