"""Progress of batches as the state of a stream: each file counted once, and silent ones failed by a timer.

Events name a batch, a file and a status; ``ASKED`` announces a file, any other status ends it. State lies by batch
and shard of its file names, so a batch of millions of files spreads over ``shards`` tasks. A file gives one ASKED
row when it is first heard of and one row when it ends; repeats give none, nor does a result that comes after its
file was failed for silence.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .ingest import PROGRESS_SCHEMA

ASKED = "ASKED"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "batch_id string, filename string, status string, error string"


class Progress(StatefulProcessor):
    """State of one (batch, shard): for each file the time by which it must end (ms), and whether it has."""

    def __init__(self, timeout_ms: int, keep_ms: int):
        self.timeout_ms, self.keep_ms = timeout_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.files = handle.getMapState("files", "filename string", "due long, ended boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, batch, news = timerValues.getCurrentProcessingTimeInMs(), key[0], []
        known: dict[str, bool] = {}
        for frame in map(_in_order, rows):
            for name, status, error in zip(frame["filename"], frame["status"], frame["error"]):
                if name not in known:
                    held = self.files.getValue((name,)) if self.files.containsKey((name,)) else None
                    if held is None:
                        news.append((batch, name, ASKED, None))
                        self.files.updateValue((name,), (now + self.timeout_ms, False))
                    known[name] = bool(held[1]) if held is not None else False
                if status != ASKED and not known[name]:
                    known[name] = True
                    self.files.updateValue((name,), (now + self.keep_ms, True))
                    news.append((batch, name, status, error))
        if not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(now + min(self.timeout_ms, self.keep_ms))
        yield _frame(news)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Fail files that are past their time; forget those that ended ``keep_ms`` ago."""
        now, news, later = timerValues.getCurrentProcessingTimeInMs(), [], []
        for (name,), (due, ended) in list(self.files.iterator()):
            if due > now:
                later.append(due)
            elif ended:
                self.files.removeKey((name,))
            else:
                self.files.updateValue((name,), (now + self.keep_ms, True))
                news.append((key[0], name, "FAILED", f"No result within {self.timeout_ms / 1000:g} seconds."))
                later.append(now + self.keep_ms)
        if later:
            self.handle.registerTimer(min(later))
        yield _frame(news)


def _in_order(frame: pd.DataFrame) -> pd.DataFrame:
    """Announcements first, SUPERSEDED last."""
    return frame.assign(_o=frame["status"].map({ASKED: 0, "SUPERSEDED": 2}).fillna(1)).sort_values(["_o", "status"], kind="stable")


def _frame(news: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(news, columns=["batch_id", "filename", "status", "error"], dtype="object")


def batch_progress(events: DataFrame, seconds: float = 300, keep_seconds: float = 86_400, shards: int = 64) -> DataFrame:
    """Rows (batch_id, filename, status, error) of what is new in a stream of such events.

    A file without a result for ``seconds`` gets a FAILED row. The state of an ended file is kept for
    ``keep_seconds`` after its end, so a later repeat is a new file. Rows without a batch, a file name or a status are
    left out. Of several results of a file in an Arrow batch any but SUPERSEDED goes first, else the least status.
    The session's state store must be ``PROVIDER``. Timers keep such a query going: it takes a processing-time trigger and ends
    when it is stopped.
    """
    known = events.select(*[c.split()[0] for c in SCHEMA.split(", ")]).where("batch_id IS NOT NULL AND filename IS NOT NULL AND status IS NOT NULL")
    keyed = known.withColumn("shard", F.pmod(F.xxhash64("filename"), F.lit(shards)))
    return keyed.groupBy("batch_id", "shard").transformWithStateInPandas(
        statefulProcessor=Progress(int(seconds * 1000), int(keep_seconds * 1000)), outputStructType=SCHEMA, outputMode="append", timeMode="processingTime"
    )


def batch_events(spark: SparkSession, asked_path: str, progress_path: str, batch: str) -> DataFrame:
    """The stream of a batch's events: the file names that ``ask`` wrote and what ``ingest_stream`` reports."""
    asked = spark.readStream.schema("filename string").parquet(asked_path).select("filename", F.lit(ASKED).alias("status"), F.lit(None).cast("string").alias("error"))
    told = spark.readStream.schema(PROGRESS_SCHEMA).option("recursiveFileLookup", "true").parquet(progress_path)
    return asked.unionByName(told).withColumn("batch_id", F.lit(batch))


def ask(files: DataFrame, asked_path: str) -> None:
    """Announce the files (filename) of a batch."""
    files.select("filename").write.mode("append").parquet(asked_path)


def totals(rows: DataFrame) -> DataFrame:
    """One row for each batch of ``batch_progress``'s rows: files asked for, ended, failed, and whole percentage ended."""
    asked, ended = F.count_if(F.col("status") == ASKED), F.count_if(F.col("status") != ASKED)
    return rows.groupBy("batch_id").agg(
        asked.alias("asked"), ended.alias("ended"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.floor(100 * ended / F.greatest(asked, F.lit(1))).cast("long").alias("percent")
    )
