"""Near-duplicate classes by order MinHash and banded alignment.

A sketch keeps, for each of ``sketches`` hash orders, the ``length`` least occurrence-labelled shingles
of five words in text order; texts that agree in one sketch share a bucket and are candidates. A
candidate pair is a link if its shingle sequences align with similarity 0.8 or more: matched shingles in
order over all shingles of both. Links make classes by connected components.

Equal texts are one candidate. A bucket of up to ``small`` texts gives all its pairs; in a larger one
each text meets a pivot, another in each bucket, and texts of different classes that still share such a
bucket meet a second pivot. This joins large classes at few pairs. Then all pairs of different classes
that still share a bucket meet, in blocks of bounded size, where the number of shingles in common tells
exactly which pairs can be links; a block returns no more links than it holds texts. So no pair that
shares a bucket is left out, and nothing grows with the square of a group but comparisons inside tasks.

Two texts of similarity 0.8 agree in about 13 of 40 sketches, and in none with a probability below 1e-6
if the longer has over 32 shingles. Texts of up to ``EXACT`` shingles have no sketches: they and all
texts that can be near to them meet by a prefix filter, in which any two that can reach the similarity
share a shingle.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mapped
from .components import components
from .shingles import labelled, mix, shingle_hashes, word_hashes

SKETCHES, LENGTH, WIDTH, SIMILARITY, AGREE, EXACT = 40, 5, 5, 0.8, 2, 32


def _odd(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def sketch(items: np.ndarray, sketches: int = SKETCHES, length: int = LENGTH) -> np.ndarray:
    """One 64-bit key for each hash order: its least ``length`` items in text order, folded."""
    factors, n = _odd(sketches), len(items)
    keys = np.zeros(sketches, dtype=np.uint64)
    block = max(1, (1 << 18) // max(1, n))
    with np.errstate(over="ignore"):
        for a in range(0, sketches, block):
            f = factors[a : a + block]
            if n > length:
                values = items[None, :] * f[:, None]
                values ^= values >> np.uint64(31)
                at = np.sort(np.argpartition(values, length - 1, axis=1)[:, :length], axis=1)
            else:
                at = np.broadcast_to(np.arange(n), (len(f), n))
            own = np.zeros(len(f), dtype=np.uint64)
            for k in range(at.shape[1]):
                own = mix(own + items[at[:, k]])
            keys[a : a + block] = mix(own ^ f)
    return keys


def _sequence(text: str) -> np.ndarray:
    return labelled(shingle_hashes(word_hashes(text), WIDTH))


def _short(least: float) -> int:
    """Shingles of the longest text that can be near to one without sketches."""
    return int(EXACT / least + 1e-9)


def prefix(items: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """Keys of the least items, by hash, of which two sets of similarity ``least`` share one."""
    n = len(items)
    return mix(np.sort(items)[: n - int(np.ceil(least * n - 1e-9)) + 1] ^ _odd(1))


def _texts(docs: DataFrame) -> DataFrame:
    """doc, text and tid (a 128-bit digest of the text) of the rows with an id; a null text has a tid of its own."""
    text = F.col("text").cast("string")
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc"), text.alias("text"))
    return rows.select("doc", "text", F.coalesce(F.unhex(F.md5(F.col("text").cast("binary"))), F.col("doc").cast("string").cast("binary")).alias("tid"))


def sketched(texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc, tid, n shingles, keys of sketches, keys of the prefix of short texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc", pa.int64()), ("tid", pa.binary()), ("n", pa.int32()), ("keys", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64()))])
        for batch in batches:
            ns, keys, starts = [], [], []
            for text in batch.column(2).to_pylist():
                items = _sequence(text) if text else np.zeros(0, np.uint64)
                ns.append(len(items))
                keys.append(sketch(items).view(np.int64) if len(items) > EXACT else [])
                starts.append(prefix(items, least).view(np.int64) if 0 < len(items) <= _short(least) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ns, pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int64()))], schema=schema)

    return mapped(texts.select("doc", "tid", "text"), run, "doc long, tid binary, n int, keys array<long>, prefix array<long>")


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Similarity of two sequences of distinct items: in-order matches over all items of both.

    The band is exact: an alignment that reaches ``least`` strays at most by the edits it can afford.
    The result is 0 where ``least`` can't be reached.
    """
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < least * max(n, m):
        return 0.0
    need = int(np.ceil(least * (n + m) / (1 + least) - 1e-9))
    order = np.argsort(b)
    at = np.searchsorted(b, a, sorter=order)
    at[at == m] = m - 1
    place = order[at]
    hit = np.flatnonzero(b[place] == a)
    place = place[hit]
    inside = np.abs(place - hit) <= n + m - 2 * need
    place = place[inside]
    if len(place) < need:
        return 0.0
    if (np.diff(place) > 0).all():
        best = len(place)
    else:
        tails: list[int] = []
        for x in place.tolist():
            k = bisect_left(tails, x)
            if k == len(tails):
                tails.append(x)
            else:
                tails[k] = x
        best = len(tails)
    return best / (n + m - best)


def _sequences(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """vid and labelled shingles of the ``wanted`` texts (doc, tid, vid), as 32 bits each: two of a text's may fall together once in a great while."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(_sequence(t or "") >> np.uint64(32)).astype(np.uint32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["vid", "seq"])

    once = texts.join(wanted.hint("merge"), ["doc", "tid"]).groupBy("doc", "tid").agg(F.first("vid").alias("vid"), F.first("text").alias("text"))
    return mapped(once.select("vid", "text"), run, "vid long, seq binary")


def _links(pairs: DataFrame, sketches: DataFrame, sequences: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (u, v) that are short or whose sketches agree often enough, and whose texts align."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, a, b = (batch.column(k) for k in range(4))
            keep = [aligned(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), least) >= least for x, y in zip(a.to_pylist(), b.to_pylist())]
            yield pa.RecordBatch.from_arrays([u, v], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    end = lambda table, name, value, new: table.select(F.col("vid").alias(name), F.col(value).alias(new)).hint("merge")
    agree = F.size(F.filter(F.zip_with("a", "b", lambda x, y: x == y), lambda x: x))
    keys = sketches.select("vid", F.struct("n", "keys").alias("s"))
    likely = pairs.join(end(keys, "u", "s", "x"), "u").join(end(keys, "v", "s", "y"), "v").select("u", "v", F.col("x.keys").alias("a"), F.col("y.keys").alias("b"), F.greatest("x.n", "y.n").alias("n"))
    likely = likely.where((F.col("n") <= _short(least)) | (agree >= AGREE)).select("u", "v")
    met = likely.join(end(sequences, "u", "seq", "a"), "u").join(end(sequences, "v", "seq", "b"), "v")
    return mapped(met.select("u", "v", "a", "b"), run, "u long, v long")


def _pairs(rows: DataFrame, small: int, least: float, turn: int) -> DataFrame:
    """Candidate pairs (u < v) of the buckets in ``rows`` (key, vid, n, root); pairs in one class are left out."""
    order = F.xxhash64(F.lit(turn), "key", "vid")
    one = F.struct("vid", "n", "root")
    placed = F.struct(order.alias("o"), one.alias("x"))
    buckets = (
        rows.groupBy("key")
        .agg(F.count("*").alias("c"), F.min(placed)["x"].alias("y"), F.min("root").alias("low"), F.max("root").alias("high"))
        .where("low < high")
        .select("key", "c", "y")
    )
    met = rows.join(buckets.hint("merge"), "key")
    near = F.least("x.n", "y.n") >= F.lit(least) * F.greatest("x.n", "y.n")
    found = met.where(F.col("c") > small).select(one.alias("x"), "y")
    if small:
        few = met.where(F.col("c") <= small).groupBy("key").agg(F.sort_array(F.collect_list(one)).alias("all"))
        pairs = F.flatten(F.transform("all", lambda x, k: F.transform(F.slice("all", k + 2, small), lambda y: F.struct(x.alias("x"), y.alias("y")))))
        found = found.unionByName(few.select(F.explode(pairs).alias("e")).select("e.x", "e.y"))
    found = found.where(near & (F.col("x.root") != F.col("y.root")))
    return found.select(F.least("x.vid", "y.vid").alias("u"), F.greatest("x.vid", "y.vid").alias("v")).distinct()


def block_links(vid: np.ndarray, side: np.ndarray, root: np.ndarray, seqs: list[np.ndarray], i: int, j: int, least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links of one block, enough to join its classes: of texts on side i with those on side j, or all of one side.

    Shingles in common are counted for all pairs at once, by products of 0/1 matrices; aligned are
    pairs that have enough of them and whose classes aren't joined yet.
    """
    n = np.array([len(s) for s in seqs])
    shingles, column = np.unique(np.concatenate(seqs), return_inverse=True)
    owner, many = np.repeat(np.arange(len(seqs)), n), np.bincount(column) > 1
    common, width = np.zeros((len(seqs), len(seqs)), dtype=np.float32), 4096
    number = np.where(many, np.cumsum(many) - 1, -1)[column]
    order = np.argsort(number, kind="stable")
    number, owner = number[order], owner[order]
    edges = np.searchsorted(number, np.arange(0, int(many.sum()) + width, width))
    for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        if b > a:
            held = np.zeros((len(seqs), width), dtype=np.float32)
            held[owner[a:b], number[a:b] - k * width] = 1
            common += held @ held.T
    need = np.ceil(least * (n[:, None] + n[None, :]) / (1 + least) - 1e-9)
    good = np.triu(common >= need, 1)
    if i != j:
        good &= side[:, None] != side[None, :]
    label, out = root.copy(), []
    for u in np.flatnonzero(good.any(axis=1)).tolist():
        for v in np.flatnonzero(good[u] & (label != label[u])).tolist():
            if label[u] != label[v] and aligned(seqs[u], seqs[v], least) >= least:
                out.append((int(min(vid[u], vid[v])), int(max(vid[u], vid[v]))))
                label[label == label[v]] = label[u]
    return out


def _all_links(rows: DataFrame, sequences: DataFrame, least: float, block: int = 512) -> DataFrame:
    """Links (u < v) that join all classes of the buckets of ``rows`` (key, vid, n, root) that have one between them.

    A bucket's texts are dealt to blocks by a hash, of about ``block`` texts of 400 shingles or as many
    shingles in longer ones. The largest class of a bucket is one already, so its texts meet the others
    alone: every two blocks of others meet, and each block of others meets each of the largest class.
    """
    own = rows.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum(1 + F.col("n") / 400).alias("w"))
    total = own.groupBy("key").agg(F.max(F.struct("c", "root", "w")).alias("top"), F.sum("w").alias("w"))
    parts = lambda w: F.greatest(F.lit(1), F.ceil(w / block)).cast("int")
    sizes = total.select("key", F.col("top.root").alias("main"), parts(F.col("top.w")).alias("mains"), parts(F.col("w") - F.col("top.w")).alias("others"))
    deal = lambda c: F.pmod(F.xxhash64(F.lit("block"), "vid"), F.col(c)).cast("int")
    met = rows.join(sizes.hint("merge"), "key").withColumn("is_main", F.col("root") == F.col("main"))
    met = met.withColumn("side", F.when(F.col("is_main"), -1 - deal("mains")).otherwise(deal("others")))
    others, mains = F.sequence(F.lit(0), F.col("others") - 1), F.transform(F.sequence(F.lit(1), F.col("mains")), lambda x: -x)
    met = met.withColumn("other", F.explode(F.when(F.col("is_main"), others).otherwise(F.concat(others, mains))))
    dealt = met.select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "vid", "root").join(sequences.hint("merge"), "vid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            vid, side, root = (np.array([x[c] for x in held], dtype=np.int64) for c in (1, 2, 3))
            found = block_links(vid, side, root, [np.frombuffer(x[4], np.uint32) for x in held], held[0][0][1], held[0][0][2], least)
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["u", "v"])

        for batch in batches:
            for key, i, j, *row in zip(*(batch.column(c).to_pylist() for c in range(7))):
                if held and held[0][0] != (key, i, j):
                    yield close()
                    held = []
                held.append(((key, i, j), *row))
        if held:
            yield close()

    dealt = dealt.select("key", "i", "j", "vid", "side", "root", "seq")
    return mapped(dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j"), run, "u long, v long").distinct()


def _mixed(shared: DataFrame, roots: DataFrame, small: int) -> DataFrame:
    """Texts and classes of the buckets of more than ``small`` texts that hold several classes."""
    relabelled = shared.join(roots.select(F.col("doc").alias("vid"), "root").hint("merge"), "vid", "left").withColumn("root", F.coalesce("root", "vid"))
    spread = relabelled.groupBy("key").agg(F.count("*").alias("c"), F.min("root").alias("low"), F.max("root").alias("high"))
    return cut(relabelled.join(spread.where((F.col("low") < F.col("high")) & (F.col("c") > small)).select("key").hint("merge"), "key", "left_semi"))


def _classes(texts: DataFrame, least: float, small: int) -> DataFrame:
    """doc, tid, class_id and keep (whether the row's text is its class's first, and its id the least) of each row of ``texts``."""
    rows = cut(sketched(texts, least))
    first = rows.groupBy("tid").agg(F.min("doc").alias("doc"), *[F.first(c).alias(c) for c in ("n", "keys", "prefix")])
    distinct = cut(first.withColumn("vid", F.monotonically_increasing_id()))
    keyed = distinct.select("vid", "n", F.explode(F.concat("keys", "prefix")).alias("key"))
    counts = keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    shared = cut(keyed.join(counts.hint("merge"), "key"))
    wanted = distinct.join(shared.select("vid").distinct().hint("merge"), "vid", "left_semi").select("doc", "tid", "vid")
    sequences = cut(_sequences(texts, wanted))
    links = cut(_links(_pairs(shared.withColumn("root", F.col("vid")), small, least, 0), distinct, sequences, least))
    roots = cut(components(links))
    mixed = _mixed(shared, roots, small)
    found = cut(_links(_pairs(mixed, 0, least, 1), distinct, sequences, least))
    if not found.isEmpty():
        links = links.unionByName(found)
        roots = cut(components(links))
        mixed = _mixed(mixed.drop("root"), roots, small)
    found = cut(_all_links(mixed, sequences, least))
    if not found.isEmpty():
        roots = cut(components(links.unionByName(found)))
    place = roots.select(F.col("doc").alias("vid"), "root")
    placed = distinct.select("vid", "tid", "doc").join(place.hint("merge"), "vid", "left").withColumn("root", F.coalesce("root", "vid"))
    heads = placed.groupBy("root").agg(F.min(F.struct("doc", "tid")).alias("head"))
    named = placed.select("tid", "root").join(heads.hint("merge"), "root").select("tid", F.col("head.doc").alias("class_id"), (F.col("tid") == F.col("head.tid")).alias("head"))
    return rows.select("doc", "tid").join(named.hint("merge"), "tid").select("doc", "tid", "class_id", (F.col("head") & (F.col("doc") == F.col("class_id"))).alias("keep"))


def near_duplicate_classes(docs: DataFrame, least: float = SIMILARITY, small: int = 8) -> DataFrame:
    """doc_id and class_id, the least doc_id of its class, for each row of ``docs``.

    Equal texts, empty ones too, are one class; a null text is a class of its own. Texts without five
    words are a single shingle, so they link only to texts with the same words. Repeated rows give
    repeated results; where an id has several texts, each row has the class of its own text. A row
    without an id is in no class: its class_id is null. An empty table gives no rows.
    """
    found = _classes(_texts(docs), least, small).select(F.col("doc").alias("doc_id"), "class_id")
    return found.unionByName(docs.where(F.col("doc_id").isNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id")))


def drop_near_duplicates(docs: DataFrame, least: float = SIMILARITY, small: int = 8) -> DataFrame:
    """One row of each class, with all columns: the row of the class's least doc_id; rows without an id stay.

    Of equal rows one stays; an id with several texts keeps a row for each class of which it is the first.
    """
    keep = _classes(_texts(docs), least, small).where("keep").select(F.col("doc").alias("_doc"), F.col("tid").alias("_tid")).distinct()
    names = [f"c{k}" for k in range(len(docs.columns))]  # whatever the columns are called, they don't clash
    own, text = F.col(names[docs.columns.index("doc_id")]).cast("long"), F.col(names[docs.columns.index("text")]).cast("string")
    rows = docs.toDF(*names).select("*", own.alias("_doc"), F.coalesce(F.unhex(F.md5(text.cast("binary"))), own.cast("string").cast("binary")).alias("_tid"))
    kept = rows.where("_doc is not null").join(keep.hint("merge"), ["_doc", "_tid"], "left_semi").dropDuplicates(["_doc", "_tid"])
    return kept.unionByName(rows.where("_doc is null")).select(*names).toDF(*docs.columns)
