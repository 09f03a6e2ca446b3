"""Idempotent incremental ingestion of document files, as a batch step and as a stream.

State is the result table itself, keyed by cv_key. A batch joins its keys with the store, decides for
each row, parses what must be read, and adds the results as a delta. A stream of files runs the same
step per micro-batch; the store's log tells a batch that is run again. Progress is a table of its own,
which a second stream can follow.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import content_key
from ..sources import versions
from ..sources.files import PARSER_VERSION, SCHEMA_VERSION, Parser, parse_files, plain_parser
from ..sources.store import KEY, originals, utc_now

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
RESULT_SCHEMA = (
    "cv_key string, filename string, cv_hash string, parser_version string, schema_version string, created_at string, updated_at string, "
    "parsed_at string, status string, characters long, structured_doc map<string,string>, page_count int, is_scanned boolean, ocr_applied boolean, markdown string, parse_error string"
)


PROGRESS_SCHEMA = "filename string, status string, error string"


def keys_of(files: DataFrame) -> Column:
    """The cv_key of files with a name and optionally candidate_id and cv_id."""
    have = set(files.columns)
    null = F.lit(None).cast("string")
    ids = [F.col(c) if c in have else null.alias(c) for c in ("candidate_id", "cv_id")]
    return content_key(F.col("filename"), *ids).alias("cv_key")


def _keyed(files: DataFrame) -> DataFrame:
    keyed = files.select("filename", "length", "content", keys_of(files), F.sha2("content", 256).alias("cv_hash"))
    w = Window.partitionBy("cv_key").orderBy(F.desc("cv_hash"), "filename")
    return keyed.withColumn("_k", F.row_number().over(w))


def with_keys(files: DataFrame) -> DataFrame:
    """cv_key and cv_hash of files (filename, content, and optionally candidate_id and cv_id).

    Of several files of one key in a batch the last by content hash counts.
    """
    return _keyed(files).where("_k = 1").drop("_k")


def superseded(files: DataFrame) -> DataFrame:
    """Progress rows of the files that another one of their key and batch has replaced."""
    return _keyed(files).where("_k > 1").select("filename", F.lit("SUPERSEDED").alias("status"), F.lit(None).cast("string").alias("error"))


def decision(stored: Column, same_content: Column, same_versions: Column, force: bool) -> Column:
    """NEW_CV, CACHE_HIT, or REPROCESSED."""
    hit = stored & same_content & same_versions & F.lit(not force)
    return F.when(~stored, "NEW_CV").when(hit, "CACHE_HIT").otherwise("REPROCESSED")


def change(stored: Column, same_content: Column, same_versions: Column) -> Column:
    """Why a stored document is read again."""
    return F.when(stored & ~same_content, "CV_CHANGED").when(stored & ~same_versions, "SCHEMA_CHANGED")


def decided(files: DataFrame, store: DataFrame, force: bool = False) -> DataFrame:
    """Keyed files with status, change and the stored created_at."""
    known = store.select("cv_key", F.col("cv_hash").alias("_hash"), F.col("parser_version").alias("_parser"), F.col("schema_version").alias("_schema"), "created_at")
    joined = with_keys(files).join(known, "cv_key", "left")
    stored, same = F.col("_hash").isNotNull(), F.col("_hash") == F.col("cv_hash")
    versions = (F.col("_parser") == PARSER_VERSION) & (F.col("_schema") == SCHEMA_VERSION)
    return joined.select("cv_key", "filename", "length", "content", "cv_hash", "created_at", decision(stored, same, versions, force).alias("status"), change(stored, same, versions).alias("change"))


def ingest(files: DataFrame, store: DataFrame, force: bool = False, parser: Parser = plain_parser, now: Column | None = None) -> DataFrame:
    """Result rows of the files that are new or must be read again; created_at outlives reprocessing."""
    now = utc_now() if now is None else now
    todo = decided(files, store, force).where("status <> 'CACHE_HIT'")
    parsed = parse_files(todo, parser)
    return parsed.select(
        "cv_key",
        "filename",
        "cv_hash",
        F.lit(PARSER_VERSION).alias("parser_version"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.coalesce("created_at", now).alias("created_at"),
        now.alias("updated_at"),
        now.alias("parsed_at"),
        "status",
        F.length("cv_text").cast("long").alias("characters"),
        "structured_doc",
        "page_count",
        "is_scanned",
        "ocr_applied",
        F.col("cv_text").alias("markdown"),
        "parse_error",
    )


def merged(store: DataFrame, fresh: DataFrame) -> DataFrame:
    """The store with fresh rows in place of those of the same keys; failed rows don't replace results."""
    good = fresh.where("parse_error is null")
    return store.join(good.select("cv_key"), "cv_key", "left_anti").unionByName(good, allowMissingColumns=True)


def progress(fresh: DataFrame) -> DataFrame:
    """One event for each file: filename, status and error."""
    return fresh.select("filename", F.when(F.col("parse_error").isNull(), F.col("status")).otherwise("FAILED").alias("status"), F.col("parse_error").alias("error"))


def latest_by_key(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest event of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def completions(events: DataFrame, watermark: str | None = None, time: str = "ts") -> DataFrame:
    """Events without repeats of a file name; on a stream within the watermark."""
    return events.withWatermark(time, watermark).dropDuplicatesWithinWatermark(["filename"]) if watermark else events.dropDuplicates(["filename"])


def progress_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("filename").alias("files"))


def task_rows(asked: DataFrame, events: DataFrame, running: bool) -> DataFrame:
    """filename, status and error of every file that was asked for.

    A file without an event is RUNNING while its query runs; once that has ended it is FAILED, so a
    task that died without a word shows as well.
    """
    last = events.groupBy("filename").agg(F.max_by(F.struct("status", "error"), F.when(F.col("status") == "SUPERSEDED", 0).otherwise(1)).alias("x"))
    joined = asked.select("filename").distinct().join(last, "filename", "left")
    missing = F.struct(F.lit("RUNNING" if running else "FAILED").alias("status"), F.lit(None if running else "The task ended without a result.").cast("string").alias("error"))
    return joined.select("filename", F.coalesce("x", missing).alias("x")).select("filename", "x.status", "x.error")


def query_status(query: StreamingQuery) -> dict:
    """What is known of a running or ended stream: whether it runs, its batch, the rows it read, and its error."""
    last, problem = query.lastProgress or {}, query.exception()
    return {"running": query.isActive, "batch": last.get("batchId"), "rows": last.get("numInputRows"), "error": str(problem) if problem else None}


def ingest_stream(
    spark: SparkSession, path: str, store_path: str, checkpoint: str, parser: Parser = plain_parser, progress_path: str | None = None, glob: str = "*.{pdf,docx,PDF,DOCX}", compact_every: int = 20
) -> StreamingQuery:
    """Ingest the files that are there, and none twice.

    Each micro-batch reads the store's buckets of its own keys, and commits its results as (query id, batch): a
    batch that runs again after its commit is skipped, and a query with a new checkpoint has another id. Progress is written
    before the commit, under the batch's own name, so it is whole whenever results are. After every ``compact_every`` batches the
    deltas are folded into one base.
    """
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", glob).load(path)

    def add(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        writer = json.loads(versions.read_text(session, f"{checkpoint}/metadata"))["id"]
        if versions.committed(session, store_path, writer, number):
            return
        named = batch.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "length", "content")
        store = read_store(session, store_path, keys=named.select(keys_of(named)))
        fresh = ingest(named, store, parser=parser).persist()
        if progress_path:
            progress(fresh).unionByName(superseded(named)).write.mode("overwrite").parquet(f"{progress_path}/b={writer}-{number:012d}")
        versions.append(fresh.where("parse_error is null"), store_path, writer=writer, batch=number)
        fresh.unpersist()
        if number % compact_every == compact_every - 1:
            versions.compact(session, store_path, KEY)

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress_stream(spark: SparkSession, progress_path: str, handler: Callable[[DataFrame, int], None], checkpoint: str, follow: bool = False) -> StreamingQuery:
    """Hand each new batch of progress events to ``handler``; with ``follow`` for as long as the query runs."""
    events = spark.readStream.schema(PROGRESS_SCHEMA).option("recursiveFileLookup", "true").parquet(progress_path)
    writer = events.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime="1 second") if follow else writer.trigger(availableNow=True)).start()


def read_store(spark: SparkSession, store_path: str, before: int | None = None, keys: DataFrame | None = None) -> DataFrame:
    """The store's newest original rows, or those of commits before a number; empty if there are none.

    With ``keys`` (one column) only the buckets that can hold them are read.
    """
    only = None if keys is None else versions.buckets_of(spark, store_path, keys)
    return originals(versions.read(spark, store_path, KEY, f"{RESULT_SCHEMA}, enriched boolean", before, only)).drop("enriched")
