"""Token ids of documents in ORC files, in ascending order of document ids.

ORC holds the ids as integers in run-length encoding (version 2), in stripes that separate tasks read. Each stripe has a
row index with the least and greatest document id of every ``stride`` rows and Bloom filters on document ids, so a
reader with a filter on ``doc_id`` skips what can't hold it without decoding ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import gathered, mapped
from .segments import encoder

#: Bytes of rows that are encoded at once.
ENCODED = 8 << 20
FILE = "part int, doc_id long, start long, n_tokens long, ids array<int>"
_FILE = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, files: int | None = None, stripe_bytes: int = 64 << 20, stride: int = 10_000, fpp: float = 0.01) -> None:
    """Write each document's ids, closed by ``end_id``, to ORC files under ``path``.

    Documents are dealt by ranges of ids (to ``files`` files, or as many as the session's shuffles have), so files in
    turn are in ascending order; ``start`` counts the ids before a document in its own file, ``part``. A null id
    comes first. Rows of one id are ordered and dealt by a hash of their texts, so a repeated id can fill more than one file. A
    null or empty text has the closing id alone. Long texts are encoded whole, in parts cut at word borders. Extra
    columns of ``docs`` play no part; an empty table gives files without rows.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    dealt = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, start = encoder(tokenizer, True).encode_all, TaskContext.get().partitionId(), 0
        for batch in gathered(batches, ENCODED):
            coded = encode(batch.column(1))
            bare, n = coded.offsets.to_numpy(), np.arange(batch.num_rows + 1)
            ids = pa.ListArray.from_arrays(pa.array(bare + n, pa.int32()), pa.array(np.insert(coded.values.to_numpy(), bare[1:], end_id)))
            ends = (bare + n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, part, dtype=np.int32)), batch.column(0), pa.array(start + ends[:-1]), pa.array(np.diff(ends)), ids], schema=_FILE)
            start += int(ends[-1])

    options = {"orc.stripe.size": stripe_bytes, "orc.create.index": "true", "orc.row.index.stride": stride, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": fpp, "compression": "zstd"}
    mapped(dealt.sortWithinPartitions(*order), run, FILE).write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of the documents in the files.

    ``where``, over doc_id, goes to the files' indexes and Bloom filters. Ids before each file come from columns of
    numbers alone and are as many rows as files, which is why they are broadcast.
    """
    files = spark.read.schema(FILE).orc(path)
    sizes = files.groupBy("part").agg(F.max(F.col("start") + F.col("n_tokens")).alias("total"))
    before = sizes.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    found = files if where is None else files.where(where)
    return found.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids")


def digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            values, ends = ids.values.to_numpy().astype("<u4", copy=False), ids.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return mapped(tokens.select("doc_id", "start", "ids"), run, DIGEST)
