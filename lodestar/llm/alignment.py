"""Alignment of two tokenizers' tokens over whole texts, with each distinct segment tokenised and aligned once.

Texts are cut before white space where neither vocabulary can merge (``vocabularies_split``), so a text's tokens
are those of its segments in turn, and every segment's end is an end of tokens of both. Blocks of documents become codes
into the block's list of distinct segments; the lists of all blocks meet by segment, and come back to their blocks
with alignments, from which documents are composed. What passes a shuffle is one row for each block and
distinct segment, and the codes; a segment that is in every block has one row a block and is told apart no further.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped
from .packing import _ALPHABET
from .segments import ByteLevelEncoder, folder, segment, segment_keys, stretches, whole_key, written

_BLOCKS = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("codes", pa.binary()), ("n_codes", pa.int64()), ("pos", pa.int32()), ("seg", pa.string()), ("n", pa.int64())])
BLOCKS = "block long, doc_id long, codes binary, n_codes long, pos int, seg string, n long"
_LINK = pa.struct([("a", pa.int32()), ("b", pa.int32())])
_ALIGNED = pa.schema([("seg", pa.string()), ("n", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups", pa.string()), ("links", pa.list_(_LINK))])
ALIGNED = "seg string, n long, n_a long, n_b long, n_groups long, groups string, links array<struct<a: int, b: int>>"
NUMBERS = ("n_a", "n_b", "n_groups", "n_best", "count_sum")
_DOCUMENTS = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", pa.string())])
DOCUMENTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_ZIP = "zstd"


class Pair:
    """A byte-level tokenizer (A) and a piece model (B), with the bytes of every token."""

    def __init__(self, a: str, b: str):
        from sentencepiece import SentencePieceProcessor

        self.a, self.b = ByteLevelEncoder(a, specials=False), SentencePieceProcessor(model_file=b)
        letters = {chr(v): k for k, v in _ALPHABET.items()}
        vocab = self.a.tokenizer.get_vocab()
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, k in vocab.items():
            self.bytes_a[k] = bytes(letters.get(c, ord(c) & 255) for c in token)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(t) for t in x], dtype=np.int64) for x in (self.bytes_a, self.bytes_b))
        crossing = re.compile("[^▁]▁|\n")
        self.splits = not any(re.search(r"\S[ \n]", t.decode("utf-8", "replace")) for t in self.bytes_a) and not any(crossing.search(p) for k, p in enumerate(pieces) if not (self.b.is_byte(k) or self.b.is_control(k)))
        self.line = self.b.encode("\n")

    def keeps(self, text: str) -> bool:
        """Whether both tokenizers' bytes are those of a space and the text."""
        norm = self.a.tokenizer.normalizer
        return self.b.normalize(text).replace("▁", " ") == " " + text and (norm is None or norm.normalize_str(" " + text) == " " + text)

    def keys(self, text: str) -> list[str]:
        return [k for part in stretches(text) for k in segment_keys(part)] if self.splits else whole_key(text)

    def encode_b(self, segments: list[str]) -> list[list[int]]:
        """Ids of segments; a line feed before each, which merges with nothing, stands in for the text before it."""
        if not self.splits:
            return self.b.encode([s[1:] for s in segments], num_threads=1)
        return [ids[len(self.line) :] for ids in self.b.encode(["\n" + s for s in segments], num_threads=1)]


def _packed(codes: np.ndarray) -> bytes:
    """Numbers by planes of bytes, as higher bytes are mostly zero."""
    return pa.compress(codes.view(np.uint8).reshape(-1, 4).T.tobytes(), _ZIP, asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, decompressed_size=4 * n, codec=_ZIP, asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


@lru_cache(maxsize=1)
def pair(a: str, b: str) -> Pair:
    """A worker's tokenizers, kept for its next tasks."""
    return Pair(a, b)


def vocabularies_split(a: str, b: str) -> bool:
    """Whether no token of A and no piece of B goes from another character into a space or line feed."""
    return pair(a, b).splits


def coded_blocks(docs: DataFrame, a: str, b: str, most: int = 1 << 25) -> DataFrame:
    """Documents as codes of segments, and each block's distinct segments with their number in the block.

    A block ends with the document that brings it to ``most`` characters. Rows with a null ``seg`` are documents; those without
    tokens have null codes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, number = pair(a, b), TaskContext.get().partitionId(), 0
        codes: dict[str, int] = {}
        counts, held = np.zeros(1024, dtype=np.int64), 0

        def closed(block: int) -> Iterator[pa.RecordBatch]:
            keys = list(codes)
            for at in range(0, len(keys), 50_000):
                some = [segment(k) for k in keys[at : at + 50_000]]
                n = len(some)
                nulls = [pa.nulls(n, t) for t in (pa.int64(), pa.binary(), pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), *nulls, pa.array(range(at, at + n), pa.int32()), pa.array(some, pa.string()), pa.array(counts[at : at + n])], schema=_BLOCKS)

        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packed, n = None, 0
                if text and tokens.keeps(text):
                    own = np.array([codes.setdefault(k, len(codes)) for k in tokens.keys(text)], dtype="<u4")
                    if len(counts) < len(codes):
                        counts = np.append(counts, np.zeros(2 * len(codes) - len(counts), dtype=np.int64))
                    counts[: len(codes)] += np.bincount(own, minlength=len(codes)) if 8 * len(own) > len(codes) else 0
                    if 8 * len(own) <= len(codes):
                        np.add.at(counts, own, 1)
                    packed, n = _packed(own), len(own)
                    held += len(text)
                rows.append(((part << 32) + number, doc_id, packed, n))
                if held >= most:
                    yield from closed((part << 32) + number)
                    number, held = number + 1, 0
                    codes.clear()
                    counts[:] = 0
            nulls = [pa.nulls(len(rows), t) for t in (pa.int32(), pa.string(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, f.type) for c, f in zip(zip(*rows), _BLOCKS)), *nulls], schema=_BLOCKS)
        yield from closed((part << 32) + number)

    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, BLOCKS)


def aligned_segments(segments: DataFrame, a: str, b: str) -> DataFrame:
    """Groups and links of distinct segments: ``seg`` and ``n`` (its number in all texts), with ALIGNED's columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pair(a, b)
        for batch in batches:
            segs = batch.column(0).to_pylist()
            raw = [s.encode() for s in segs]
            coded = [np.frombuffer(tokens.a.encode_segment(s), dtype="<u4") for s in segs]
            ids_a = np.concatenate(coded).astype(np.int64)
            lists_b = tokens.encode_b(segs)
            ids_b = np.array([k for x in lists_b for k in x], dtype=np.int64)
            last_a, last_b = np.cumsum([len(x) for x in coded]), np.cumsum([len(x) for x in lists_b])
            ends_a, ends_b, ends = np.cumsum(tokens.size_a[ids_a]), np.cumsum(tokens.size_b[ids_b]), np.cumsum([len(r) for r in raw])
            text = b"".join(raw)
            if not ((ends_a[last_a - 1] == ends).all() and (ends_b[last_b - 1] == ends).all() and b"".join([tokens.bytes_a[k] for k in ids_a.tolist()]) == text == b"".join([tokens.bytes_b[k] for k in ids_b.tolist()])):
                raise ValueError("a segment's tokens don't add up to its bytes: these tokenizers can't be aligned by segments")
            every, both = np.union1d(ends_a, ends_b), np.intersect1d(ends_a, ends_b)
            link_a, link_b = ids_a[np.searchsorted(ends_a, every)], ids_b[np.searchsorted(ends_b, every)]
            cuts_a, cuts_b = np.searchsorted(ends_a, both) + 1, np.searchsorted(ends_b, both) + 1
            own = np.searchsorted(both, ends) + 1
            str_a, str_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
            groups, at_a, at_b = [], 0, 0
            for to_a, to_b in zip(cuts_a.tolist(), cuts_b.tolist()):
                groups.append(f"{','.join(str_a[at_a:to_a])}|{','.join(str_b[at_b:to_b])}")
                at_a, at_b = to_a, to_b
            marks = [0, *own.tolist()]
            joined = [";".join(groups[x:y]) for x, y in zip(marks, marks[1:])]
            offsets = np.append(0, np.searchsorted(every, ends) + 1).astype(np.int32)
            links = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(link_a, pa.int32()), pa.array(link_b, pa.int32())], fields=list(_LINK)))
            numbers = [pa.array(np.diff(x, prepend=0), pa.int64()) for x in (last_a, last_b, own)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *numbers, pa.array(joined, pa.string()), links], schema=_ALIGNED)

    return mapped(segments.select("seg", "n"), run, ALIGNED)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b, how many links of all texts hold the pair, and whether that is the most of any pair with this b.

    The pairs of one b are at most as many as A's vocabulary has ids.
    """
    counts = aligned.select("n", F.explode("links").alias("l")).groupBy(F.col("l.a").alias("a"), F.col("l.b").alias("b")).agg(F.sum("n").alias("count"))
    return counts.withColumn("best", (F.col("count") == F.max("count").over(Window.partitionBy("b"))).cast("long"))


def _summed(aligned: DataFrame, counts: DataFrame, small: bool) -> DataFrame:
    """seg, groups and NUMBERS of each segment, with the sums over its links of the pairs' counts.

    A small table of counts is broadcast as sorted arrays and looked up in place; a larger one is joined by pair.
    """
    if not small:
        links = aligned.select("sid", F.explode("links").alias("l")).select("sid", "l.a", "l.b")
        sums = links.join(counts.hint("merge"), ["a", "b"]).groupBy("sid").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
        return aligned.select("sid", "seg", "groups", "n_a", "n_b", "n_groups").join(sums.hint("merge"), "sid").select("seg", "groups", *NUMBERS)
    found = counts.select((F.shiftleft(F.col("a").cast("long"), 32) + F.col("b")).alias("pair"), "best", "count").toPandas().sort_values("pair")
    shared = aligned.sparkSession.sparkContext.broadcast([found[c].to_numpy(dtype=np.int64) for c in ("pair", "best", "count")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, best, count = shared.value
        for batch in batches:
            links = batch.column(5)
            flat, begins = links.flatten(), links.offsets.to_numpy()[:-1] - links.offsets[0].as_py()
            at = np.searchsorted(pairs, (flat.field("a").to_numpy().astype(np.int64) << 32) + flat.field("b").to_numpy())
            sums = [pa.array(np.add.reduceat(x[at], begins)) for x in (best, count)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *sums], names=["seg", "groups", *NUMBERS])

    return mapped(aligned.select("seg", "groups", "n_a", "n_b", "n_groups", "links"), run, "seg string, groups string, " + ", ".join(f"{c} long" for c in NUMBERS))


def _bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one block as one compressed Arrow batch each."""
    for batch in batches:
        blocks = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        out = []
        for x, y in zip(edges, edges[1:]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema(list(batch.schema)[1:]), options=pa.ipc.IpcWriteOptions(compression=_ZIP)) as writer:
                writer.write_batch(pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(x, y - x)]) for c in batch.columns[1:]], schema=pa.schema(list(batch.schema)[1:])))
            out.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(blocks[edges[:-1]]), pa.array(out, pa.binary())], names=["block", "entries"])


def _composed(docs: pa.Table, entries: pa.Table) -> pa.Table:
    """The documents of a block from their codes and the alignments of the block's segments."""
    found = [pa.ipc.open_stream(x).read_all() for x in entries.column("entries").to_pylist()]
    if not found or not docs.num_rows:
        return _DOCUMENTS.empty_table()
    table = pa.concat_tables(found)
    table = table.take(np.argsort(table.column("pos").to_numpy()))
    groups, numbers = table.column("groups").to_pylist(), [table.column(c).to_numpy() for c in NUMBERS]
    rows = []
    for doc_id, packed, n in zip(*(docs.column(c).to_pylist() for c in ("doc_id", "codes", "n_codes"))):
        codes = _unpacked(packed, n)
        sha = hashlib.sha256()
        for at in range(0, n, 1 << 16):
            sha.update((";" * (at > 0) + ";".join([groups[k] for k in codes[at : at + (1 << 16)].tolist()])).encode())
        n_a, n_b, n_groups, n_best, count_sum = (int(x[codes].sum()) for x in numbers)
        rows.append((doc_id, n_a, n_b, n_groups, n_a + n_b - n_groups, n_best, count_sum, sha.hexdigest()))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _DOCUMENTS)], schema=_DOCUMENTS)


def align(docs: DataFrame, a: str, b: str, most: int = 1 << 25, small_pairs: int = 1 << 20) -> DataFrame:
    """Each document's numbers of tokens, groups and links, and a digest of its groups.

    ``a`` is a byte-level tokenizer's file, which encodes a space and the text; ``b`` a piece model's, which adds the
    space itself. Special tokens' strings are plain text. Texts that are null, empty or changed by either tokenizer have no
    tokens: zeros and ''. A group ends where tokens of both end; a link is a pair of tokens whose bytes overlap, of which a
    group with k tokens has k - 1. ``n_best`` and ``count_sum`` come from the counts of id pairs over all documents. Repeated
    rows count as often as they occur; a null doc_id stays null; extra columns play no part. Counts of up to ``small_pairs`` pairs
    (32 MB) are broadcast, and joined by a shuffle beyond; the rows are the same.
    """
    spark, base = docs.sparkSession, folder(docs.sparkSession, "alignment")
    blocks = written(coded_blocks(docs, a, b, most), f"{base}/blocks")
    entries = blocks.where("seg IS NOT NULL").select("block", "pos", "seg", "n")
    distinct = aligned_segments(entries.groupBy("seg").agg(F.sum("n").alias("n")), a, b)
    aligned = written(distinct.withColumn("sid", F.monotonically_increasing_id()), f"{base}/aligned")
    counts = written(pair_counts(aligned), f"{base}/counts")
    known = _summed(aligned, counts, counts.count() <= small_pairs)
    back = entries.select("block", "pos", "seg").join(known.hint("merge"), "seg").select("block", "pos", "groups", *NUMBERS)
    bundles = mapped(back.sortWithinPartitions("block"), _bundled, "block long, entries binary", most=1 << 24)
    texts = blocks.where("seg IS NULL")
    coded = texts.where("codes IS NOT NULL").select("block", "doc_id", "codes", "n_codes")
    done = coded.groupBy("block").cogroup(bundles.groupBy("block")).applyInArrow(_composed, DOCUMENTS)
    none = texts.where("codes IS NULL").select("doc_id", *(F.lit(0).cast("long").alias(f.name) for f in list(_DOCUMENTS)[1:-1]), F.lit("").alias("groups_sha256"))
    return done.unionByName(none)
