"""What the corpus operators share: reading, sampling, cutting lineage, Arrow functions and let-bindings."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of the hash by which bounded samples are drawn.
SAMPLE_BUCKETS = 1 << 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's decimal text leaves ``remainder``; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def hash_share(key: Column, share: float, salt: str) -> Column:
    """A deterministic sample of about ``share`` of the keys."""
    return F.pmod(F.xxhash64(F.lit(salt), key), F.lit(SAMPLE_BUCKETS)) < int(min(1.0, share) * SAMPLE_BUCKETS)


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="lodestar-")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the reliable checkpoint folder, which survives lost executors."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def _give_back() -> None:
    """Free memory goes back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, most: int = 1 << 20) -> DataFrame:
    """``mapInArrow`` whose batches come in slices of about ``most`` bytes.

    So a task's Python lists and arrays stay small whatever the rows' length, and Spark's own Arrow
    batches are set to 1,000 rows at most for the session.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(rows)) <= 1000:
        df.sparkSession.conf.set(rows, 1000)

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * most // max(1, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                yield batch.slice(at, step)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(sliced(batches))
        finally:
            _give_back()

    return df.mapInArrow(whole, schema)


def gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have ``least`` bytes; the last one may have fewer."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= least:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)
