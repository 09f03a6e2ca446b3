"""Keyed tables with a commit log: each write adds a delta, reads take the newest row of each key.

``data/<folder>`` holds rows in hash buckets of the key, ``_log/<number>`` says which folder a commit added, and a folder
counts only once the log names it. A log file is never overwritten: a writer that finds its number taken takes the next
one, so writers at work at the same time lose nothing, and what they wrote is ordered. A stream's batch is recorded as
(writer, batch); its repeat is skipped, and a stream with a new checkpoint is another writer. ``compact`` folds the
commits up to a number into a base and leaves later ones alone.

The log needs a store whose rename fails on an existing file (HDFS does); on a local disk a hard link does the same.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

#: Hash buckets of a new table; the log keeps the number for the table's life.
BUCKETS = 16


def scratch(spark: SparkSession) -> str:
    """A new folder's name that driver and executors share; only a local session may lack spark.checkpoint.dir."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{found or tempfile.gettempdir()}/lodestar-{uuid.uuid4().hex}"


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.Path, base, base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text, read by the driver."""
    _, file, fs = _files(spark, path)
    stream = fs.open(file)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with this text as a whole, unless there is one already."""
    make, file, fs = _files(spark, path)
    trial = make(f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(trial, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if fs.getScheme() == "file":
            os.link(trial.toUri().getPath(), file.toUri().getPath())
            return True
        return not fs.exists(file) and fs.rename(trial, file)
    except FileExistsError:
        return False
    finally:
        fs.delete(trial, False)


def log(spark: SparkSession, path: str) -> list[dict]:
    """All commits that are still there, in order, each with its ``number``."""
    _, base, fs = _files(spark, f"{path}/_log")
    names = [s.getPath().getName() for s in fs.listStatus(base)] if fs.exists(base) else []
    return [json.loads(read_text(spark, f"{path}/_log/{n}")) | {"number": int(n)} for n in sorted(n for n in names if n.isdigit())]


def snapshot(spark: SparkSession, path: str, before: int | None = None) -> list[dict]:
    """The commits that make up the table: the base that covers most, if any, and the deltas behind it."""
    known = [e for e in log(spark, path) if before is None or e["number"] < before]
    bases = sorted((e for e in known if e["kind"] == "base"), key=lambda e: e["covers"])
    covered = bases[-1]["covers"] if bases else -1
    return bases[-1:] + [e for e in known if e["kind"] == "delta" and e["number"] > covered]


def _batches(commits: Iterable[dict]) -> dict[str, int]:
    """The last batch of each writer."""
    done: dict[str, int] = {}
    for e in commits:
        for writer, batch in [*e.get("writers", {}).items(), *([(e["writer"], e["batch"])] if e.get("writer") else [])]:
            done[writer] = max(batch, done.get(writer, -1))
    return done


def committed(spark: SparkSession, path: str, writer: str, batch: int) -> bool:
    """Whether the table holds this batch of the writer, or a later one."""
    return batch <= _batches(snapshot(spark, path)).get(writer, -1)


def bucket_of(key: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, path: str, key: str, buckets: int) -> dict:
    folder = uuid.uuid4().hex
    placed = rows.withColumn("_bucket", bucket_of(F.col(key), buckets))
    placed.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/data/{folder}")
    return {"folder": folder, "buckets": buckets, "schema": rows.schema.jsonValue()}


def append(rows: DataFrame, path: str, key: str = "cv_key", writer: str | None = None, batch: int | None = None) -> int | None:
    """Add rows as one commit and return its number; None if the table holds this batch of the writer already.

    The rows may be computed from the table itself. Rows of one key in a commit should be one.
    """
    spark = rows.sparkSession
    if writer is not None and committed(spark, path, writer, batch):
        return None
    known = log(spark, path)
    entry = _write(rows, path, key, known[0]["buckets"] if known else BUCKETS) | {"kind": "delta", "writer": writer, "batch": batch}
    return _commit(spark, path, entry)


def _commit(spark: SparkSession, path: str, entry: dict) -> int | None:
    number = max((e["number"] for e in log(spark, path)), default=-1) + 1
    while not put_text(spark, f"{path}/_log/{number:012d}", json.dumps(entry)):
        if entry.get("writer") and committed(spark, path, entry["writer"], entry["batch"]):
            return None
        number += 1
    return number


def rows_of(spark: SparkSession, path: str, commit: dict) -> DataFrame:
    """The rows of one commit, with their _bucket."""
    return spark.read.schema(StructType.fromJson(commit["schema"]).add("_bucket", IntegerType())).parquet(f"{path}/data/{commit['folder']}")


def read(spark: SparkSession, path: str, key: str | list[str], schema: str | None = None, before: int | None = None, only: list[int] | None = None) -> DataFrame | None:
    """The newest row of each key (one or several columns, the first of which buckets go by), or of commits ``before`` a number.

    A null of a boolean key column counts as false, also where a commit lacks the column. ``only`` names buckets, and
    files of others aren't read. With ``schema`` the rows have just its columns. A table without commits is empty, or None without a schema.
    """
    keys = [key] if isinstance(key, str) else key
    commits = snapshot(spark, path, before)
    empty = spark.createDataFrame([], schema) if schema else None
    if not commits:
        return empty
    parts = []
    for e in commits:
        rows = rows_of(spark, path, e)
        parts.append((rows if only is None else rows.where(F.col("_bucket").isin(only))).withColumn("_n", F.lit(e["number"])))
    if empty is not None:
        parts.append(empty)
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if len(commits) > 1 or commits[0]["kind"] == "delta":
        kinds = dict(rows.dtypes)
        parts_of_key = [F.coalesce(c, F.lit(False)) if kinds[c] == "boolean" else F.col(c) for c in keys if c in kinds]
        newest = Window.partitionBy("_bucket", *parts_of_key).orderBy(F.desc("_n"))
        rows = rows.withColumn("_k", F.row_number().over(newest)).where("_k = 1").drop("_k")
    return rows.select(*empty.columns) if empty is not None else rows.drop("_n", "_bucket")


def buckets_of(spark: SparkSession, path: str, keys: DataFrame) -> list[int]:
    """The buckets that hold the keys (one column): at most as many numbers as the table has buckets."""
    known = log(spark, path)
    if not known:
        return []
    return [r[0] for r in keys.select(bucket_of(F.col(keys.columns[0]), known[0]["buckets"])).distinct().collect()]


def compact(spark: SparkSession, path: str, key: str | list[str]) -> int | None:
    """Fold the present commits into one base and return its number; None if there is nothing to fold.

    Commits made meanwhile stay deltas. What the base before this one has made needless is removed; its own
    folders stay until the next call, for readers that began before.
    """
    commits = snapshot(spark, path)
    if not any(e["kind"] == "delta" for e in commits):
        return None
    covers = max(e["covers"] if e["kind"] == "base" else e["number"] for e in commits)
    rows = read(spark, path, key, before=max(e["number"] for e in commits) + 1)
    entry = _write(rows, path, key if isinstance(key, str) else key[0], commits[0]["buckets"])
    number = _commit(spark, path, entry | {"kind": "base", "covers": covers, "writers": _batches(commits)})
    old = max((e["covers"] for e in commits if e["kind"] == "base"), default=-1)
    make, _, fs = _files(spark, path)
    for e in log(spark, path):
        if (e["kind"] == "delta" and e["number"] <= old) or (e["kind"] == "base" and e["covers"] < old):
            fs.delete(make(f"{path}/_log/{e['number']:012d}"), False)
            for kept in ("data", "grams"):
                fs.delete(make(f"{path}/{kept}/{e['folder']}"), True)
    return number
