"""What streaming queries tell of their batches and ends, kept as rows that outlive the session."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from ..sources import versions

SCHEMA = "event string, query_id string, run_id string, name string, at string, batch long, rows long, rows_per_second double, milliseconds long, error string"


class QueryLog(StreamingQueryListener):
    """Writes an event of each start, batch and end of the session's streams to ``path``, as one small JSON file each.

    ``spark.streams.addListener(QueryLog(spark, path))`` begins it. Events are ``started``, ``progress``, ``ended`` and
    ``failed``, the last with the query's error. An event that can't be written doesn't stop a stream.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _add(self, event: str, of, **more) -> None:
        row = {"event": event, "query_id": str(of.id), "run_id": str(of.runId), "name": getattr(of, "name", None), "at": getattr(of, "timestamp", None)} | more
        versions.put_text(self.spark, f"{self.path}/{uuid.uuid4().hex}.json", json.dumps(row))

    def onQueryStarted(self, event) -> None:
        self._add("started", event)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._add("progress", p, batch=p.batchId, rows=p.numInputRows, rows_per_second=p.processedRowsPerSecond, milliseconds=p.batchDuration)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._add("failed" if event.exception else "ended", event, error=event.exception)


def events(spark: SparkSession, path: str) -> DataFrame:
    """The rows that a ``QueryLog`` has written."""
    return spark.read.schema(SCHEMA).option("pathGlobFilter", "*.json").json(path)
