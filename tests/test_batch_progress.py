"""Progress kept as the state of a stream: repeats, late results, silent files, restart, and many files of a batch."""

import time

import pytest
from pyspark.sql import functions as F

from lodestar.streaming import batch_progress, ingest

EVENT = batch_progress.SCHEMA


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", batch_progress.PROVIDER)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _put(spark, path, rows):
    spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(path)


def _start(spark, tmp_path, **options):
    events = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
    rows = batch_progress.batch_progress(events, shards=2, **options)
    return rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()


def _told(spark, tmp_path):
    return sorted((r.batch_id, r.filename, r.status) for r in spark.read.schema(EVENT).parquet(str(tmp_path / "out")).collect())


def _until(spark, tmp_path, n, seconds=60):
    end = time.time() + seconds
    while time.time() < end:
        if (tmp_path / "out").exists() and len(_told(spark, tmp_path)) >= n:
            break
        time.sleep(0.3)
    return _told(spark, tmp_path)


def test_each_file_ends_once(rocks, tmp_path):
    """A repeat, a result nobody asked for, odd rows, a dead task, its late result, and a restart in between."""
    path = str(tmp_path / "in")
    _put(rocks, path, [("b", "x.pdf", "ASKED", None), ("b", "y.pdf", "ASKED", None), ("b", "x.pdf", "NEW_CV", None), ("c", "x.pdf", "FAILED", "no text"), (None, "x.pdf", "ASKED", None), ("b", None, "NEW_CV", None), ("b", "z.pdf", None, None)])
    query = _start(rocks, tmp_path, seconds=6)
    try:
        first = _until(rocks, tmp_path, 5)
    finally:
        query.stop()
    assert ("b", "x.pdf", "NEW_CV") in first and ("c", "x.pdf", "ASKED") in first and ("c", "x.pdf", "FAILED") in first
    _put(rocks, path, [("b", "x.pdf", "NEW_CV", None), ("b", "x.pdf", "CACHE_HIT", None)])
    query = _start(rocks, tmp_path, seconds=6)
    try:
        _until(rocks, tmp_path, 6)
        _put(rocks, path, [("b", "y.pdf", "NEW_CV", None), ("b", "w.pdf", "CACHE_HIT", None)])
        told = _until(rocks, tmp_path, 8)
    finally:
        query.stop()
    assert told == [
        ("b", "w.pdf", "ASKED"), ("b", "w.pdf", "CACHE_HIT"), ("b", "x.pdf", "ASKED"), ("b", "x.pdf", "NEW_CV"),
        ("b", "y.pdf", "ASKED"), ("b", "y.pdf", "FAILED"), ("c", "x.pdf", "ASKED"), ("c", "x.pdf", "FAILED"),
    ]
    rows = rocks.read.schema(EVENT).parquet(str(tmp_path / "out"))
    assert {r.error for r in rows.where("filename = 'y.pdf' AND status = 'FAILED'").collect()} == {"No result within 6 seconds."}
    assert {tuple(r) for r in batch_progress.totals(rows).collect()} == {("b", 3, 3, 1, 100), ("c", 1, 1, 1, 100)}


def test_ingestion_reports_to_its_batch(rocks, tmp_path):
    """Files that are asked for, read by the ingesting stream, and followed by file name."""
    (tmp_path / "cvs").mkdir()
    for k in range(6):
        (tmp_path / "cvs" / f"f{k}.pdf").write_bytes(b"%PDF-1.4 (text of cv) Tj")
    names = rocks.createDataFrame([(f"f{k}.pdf",) for k in range(7)], "filename string")
    batch_progress.ask(names, str(tmp_path / "asked"))
    ingest.ingest_stream(rocks, str(tmp_path / "cvs"), str(tmp_path / "s"), str(tmp_path / "cp1"), progress_path=str(tmp_path / "p")).awaitTermination()
    rows = batch_progress.batch_progress(batch_progress.batch_events(rocks, str(tmp_path / "asked"), str(tmp_path / "p"), "monday"), shards=4)
    query = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    try:
        _until(rocks, tmp_path, 13)
    finally:
        query.stop()
    out = rocks.read.schema(EVENT).parquet(str(tmp_path / "out"))
    assert tuple(batch_progress.totals(out).first())[:3] == ("monday", 7, 6) and batch_progress.totals(out).first().percent == 85
    assert {r.filename for r in out.where("status <> 'ASKED'").collect()} == {f"f{k}.pdf" for k in range(6)}


def test_completions_within_a_watermark(spark, tmp_path):
    events = spark.createDataFrame([("a", "2026-01-01 00:00:00"), ("a", "2026-01-01 00:00:05"), ("b", "2026-01-01 00:00:01")], "filename string, t string").select("filename", F.col("t").cast("timestamp").alias("ts"))
    for part in (events, events):
        part.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    done = ingest.completions(stream, "10 minutes")
    done.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.filename for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
