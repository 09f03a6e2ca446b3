"""Removal of repeated byte strings with suffix arrays built by two-stage sorting.

A byte goes if a string of ``length`` bytes around it starts earlier too. A suffix array of all texts
would have to move every text many times over, so suffixes are first brought together that can share
such a string at all:

1. Each window of ``length`` bytes has an anchor, the byte run of 32 with the least hash in it (a
   minimizer). Equal windows have equal anchors. Consecutive windows with one anchor are a context.
2. Equal contexts are told by their hashes: all but the first go as a whole. This happens in every
   batch before the shuffle, so a group of very many copies leaves one row for each batch and context.
3. Different contexts of one anchor that agree for 34 bytes on one side may share windows, and a shared
   window has as many on one side at least. Only these contexts' texts are gathered, by anchor, side
   and a hash of those bytes, and their suffixes sorted: suffixes smaller than their successors
   directly, the others induced by a scan over buckets. Where neighbours have a common prefix of
   ``length`` bytes, all but the first start go. Where very many contexts agree on a side, as at the
   border of a passage that many documents share, their windows are gathered in ranges instead, each
   by a hash of all bytes that its windows have in common, and equal ones are told in every task.

Spans come back by document and are cut out of the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, mapped
from .shingles import mix

ANCHOR = 32
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_POSITION = 20
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []
_ROW = np.dtype([("h", "<u8"), ("c", "<u8"), ("doc", "<i8"), ("a", "<i4"), ("n", "<i2"), ("left", "u1"), ("right", "u1")])
#: Bytes of text whose contexts are packed together, bytes of text for each bucket of contexts, and rows of repeated ids that are broadcast.
_TOGETHER, _BUCKET_BYTES, _FEW = 8 << 20, 16 << 20, 100_000
#: Contexts of one anchor and side from which on they are gathered by more bytes, and windows that are gathered together then.
_HOT, _RANGE = 512, 9


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    if not _POWERS or len(_POWERS[0][0]) <= n:
        _POWERS.clear()
        with np.errstate(over="ignore"):
            for base in _BASES:
                _POWERS.append(tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, dtype=np.uint64)]), dtype=np.uint64) for b in (base, pow(base, -1, 2**64))))
    return _POWERS


def anchored(texts: list[bytes], ids: list[int], length: int) -> np.ndarray:
    """The contexts of some texts: anchor hash, context hash, document, first window, windows, side prints.

    A side print is 0 where no window of the context has 34 bytes on that side of the anchor.
    """
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    total, width, side = len(data), length - ANCHOR + 1, (length - ANCHOR + 1) // 2
    if total < length:
        return np.zeros(0, dtype=_ROW)
    with np.errstate(over="ignore"):
        (up, down), (up2, down2) = _powers(total + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:total], dtype=np.uint64)])
        sums2 = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up2[:total], dtype=np.uint64)])
        grams = mix((sums[ANCHOR:] - sums[:-ANCHOR]) * down[: total - ANCHOR + 1])
        low = (grams >> np.uint64(_POSITION) << np.uint64(_POSITION)) | np.arange(len(grams), dtype=np.uint64)
        span = 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if span < width:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        at = (low & np.uint64((1 << _POSITION) - 1)).astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)[: len(at)]
        valid = np.arange(len(at)) + length <= ends[owner]
        start = np.flatnonzero(valid & np.concatenate([[True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]) | ~valid[:-1]]))
        if not len(start):
            return np.zeros(0, dtype=_ROW)
        counts = np.add.reduceat(valid.astype(np.int64), start)
        p = at[start]
        last = start + counts - 1
        stop = last + length
        offset = (p - start).astype(np.uint64)
        out = np.zeros(len(start), dtype=_ROW)
        out["h"] = grams[p]
        out["c"] = mix((sums2[stop] - sums2[start]) * down2[start] + offset * np.uint64(0x165667B19E3779F9) + counts.astype(np.uint64))
        doc = owner[start]
        out["doc"] = np.array(ids, dtype=np.int64)[doc]
        out["a"] = start - (ends - sizes)[doc]
        out["n"] = counts
        left, right = p - side >= start, p + ANCHOR + side <= stop
        out["left"][left] = mix((sums[p[left]] - sums[p[left] - side]) * down[p[left] - side]) % np.uint64(255) + np.uint64(1)
        q = p[right] + ANCHOR
        out["right"][right] = mix((sums[q + side] - sums[q]) * down[q]) % np.uint64(255) + np.uint64(1)
    return out


def _by_context(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by anchor, context and place; which of them lie elsewhere than the first of their context."""
    rows = rows[np.lexsort((rows["a"], rows["doc"], rows["c"], rows["h"]))]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows["h"][1:] != rows["h"][:-1]) | (rows["c"][1:] != rows["c"][:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
    later = (rows["doc"] != rows["doc"][head]) | (rows["a"] != rows["a"][head])
    return rows, later


def _blocks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    at = total = 0
    for k, n in enumerate(sizes):
        if total and total + n > most:
            yield at, k
            at, total = k, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def _pieces(text: bytes, length: int, most: int) -> list[tuple[int, bytes]]:
    """A text in parts of at most ``most`` bytes that overlap so that each window lies in one of them."""
    if len(text) <= most:
        return [(0, text)]
    step = most - length + 1
    return [(a, text[a : a + most]) for a in range(0, len(text) - length + 1, step)]


def _scan(length: int, buckets: int, most: int = 1 << 18):
    def packed(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows, later = _by_context(np.concatenate(found))
        for chosen, sign in ((rows[~later], 1), (rows[later], -1)):
            bucket = (chosen["h"] >> np.uint64(20)).astype(np.int64) % buckets
            order = np.argsort(bucket, kind="stable")
            chosen, bucket = chosen[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            blobs = [_packed(x) for x in np.split(chosen, cuts)] if len(chosen) else []
            keys = bucket[np.concatenate([[0], cuts])].tolist() if len(chosen) else []
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([sign > 0] * len(keys), pa.bool_()), pa.array(blobs, pa.binary())], names=["bucket", "first", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            parts: list[tuple[int, int, bytes]] = []
            for doc, base, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                raw = (text or "").encode("utf-8", "replace")
                if doc is not None and len(raw) >= length:
                    parts += [(doc, base + a, x) for a, x in _pieces(raw, length, most)]
            for i, j in _blocks([len(x) for _, _, x in parts], most):
                own = anchored([x for _, _, x in parts[i:j]], list(range(i, j)), length)
                place = own["doc"]
                own["a"] += np.array([a for _, a, _ in parts], dtype=np.int64)[place].astype(np.int32)
                own["doc"] = np.array([d for d, _, _ in parts], dtype=np.int64)[place]
                found.append(own)
                held += sum(len(x) for _, _, x in parts[i:j])
                if held >= _TOGETHER:
                    yield from packed(found)
                    found, held = [], 0
        if found:
            yield from packed(found)

    return run


def _packed(rows: np.ndarray) -> bytes:
    """Byte planes, so that the shuffle's compression finds the equal ones."""
    return rows.view(np.uint8).reshape(len(rows), _ROW.itemsize).T.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(_ROW.itemsize, -1).T).view(_ROW).ravel()


def _held(keys: np.ndarray, usable: np.ndarray) -> np.ndarray:
    """How often each usable key occurs, 0 for others."""
    out = np.zeros(len(keys), dtype=np.int64)
    at = np.flatnonzero(usable)
    if len(at):
        _, inverse, counts = np.unique(keys[at], return_inverse=True, return_counts=True)
        out[at] = counts[inverse]
    return out


def _decide(length: int, hot: int):
    """From the rows of each bucket, in order of buckets: spans that go, and contexts that must be compared.

    The last two bits of a context's ``h`` say that it isn't 0 and of which side it is; of ``hot``
    contexts or more of one group, ``n`` is negative.
    """

    def close(blobs: list[tuple[bool, bytes]]) -> pa.RecordBatch:
        known = [_unpacked(b) for first, b in blobs if not first]
        fresh = [_unpacked(b) for first, b in blobs if first]
        rows, later = _by_context(np.concatenate(fresh)) if fresh else (np.zeros(0, _ROW), np.zeros(0, bool))
        alone = rows[~later]
        gone = np.concatenate([rows[later], *known])
        taken, groups, many = [gone], [np.zeros(len(gone), np.uint64)], [np.zeros(len(gone), bool)]
        for k, side in enumerate(("left", "right"), 1):
            with np.errstate(over="ignore"):
                group = mix(mix(alone["h"] + np.uint64(k)) + alone[side].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            held = _held(group, alone[side] > 0)
            need = held > 1
            taken.append(alone[need])
            groups.append((group[need] & ~np.uint64(3)) | np.uint64(2 * k - 1))
            many.append(held[need] >= hot)
        doc, a, n = (np.concatenate([x[c] for x in taken]) for c in ("doc", "a", "n"))
        h, sign = np.concatenate(groups), np.where(np.concatenate(many), -1, 1).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(a.astype(np.int64)), pa.array((n.astype(np.int32) + np.int32(length - 1)) * sign), pa.array(h.view(np.int64))], names=["doc", "a", "n", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            for bucket, first, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if bucket != at and held:
                    yield close(held)
                    held = []
                at = bucket
                held.append((first, raw))
        if held:
            yield close(held)

    return run


def _anchor(ctx: bytes, length: int) -> int:
    """Where the anchor lies that all windows of a context share."""
    data = np.frombuffer(ctx[:length], dtype=np.uint8)
    with np.errstate(over="ignore"):
        up, down = _powers(length + 1)[0]
        sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
        return int(np.argmin(mix((sums[ANCHOR:] - sums[:-ANCHOR]) * down[: len(data) - ANCHOR + 1]) >> np.uint64(_POSITION)))


def _ranges(h: int, ctx: bytes, length: int) -> Iterator[tuple[int, int, int]]:
    """(key, begin, end) of a context's windows on the side of ``h``, in ranges of their place about the anchor.

    The key is a hash of the bytes that all windows of such a range have in common.
    """
    p, side = _anchor(ctx, length), (length - ANCHOR + 1) // 2
    low, high = (side, length - ANCHOR) if (h & 3) == 1 else (0, length - ANCHOR - side)
    for a in range(low, high + 1, _RANGE):
        b = min(a + _RANGE, high + 1)  # windows that begin a to b - 1 bytes before the anchor
        first, last = max(0, p - b + 1), min(p - a, len(ctx) - length)
        if first <= last:
            core = hashlib.blake2b(b"%d %d " % (h, a) + ctx[p - a : p - b + 1 + length], digest_size=8).digest()
            yield int.from_bytes(core, "little", signed=True) or 1, first, last + length


def _contexts(length: int, most: int = 50_000):
    """The bytes of the contexts that must be compared; of a hot group in ranges, of which equal ones go but the first of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        first: dict[tuple[int, bytes], tuple[int, int]] = {}
        for batch in batches:
            for doc, base, text, own in zip(*(batch.column(k).to_pylist() for k in range(4))):
                raw = (text or "").encode("utf-8", "replace")
                for x in own:
                    at, n, h = x["a"] - base, abs(x["n"]), x["h"]
                    if not 0 <= at < len(raw):
                        continue
                    ctx = raw[at : at + n]
                    if x["n"] > 0:
                        out.append((h, doc, x["a"], 0, ctx))
                        continue
                    for key, begin, end in _ranges(h, ctx, length):
                        place, known = (doc, x["a"] + begin), first.get((key, ctx[begin:end]))
                        if known is None or place < known:
                            first[key, ctx[begin:end]] = place
                        if known is not None and known != place:
                            out.append((key, *max(known, place), end - begin, None))
                if len(out) > 4000:
                    yield _batch(out)
                    out = []
                if len(first) > most:
                    yield _batch([(key, *place, 0, ctx) for (key, ctx), place in first.items()])
                    first = {}
        out += [(key, *place, 0, ctx) for (key, ctx), place in first.items()]
        if out:
            yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["h", "doc", "a", "n", "ctx"])


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, in byte order; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), dtype=np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(data)]
    return out


def suffix_array(data: np.ndarray, depth: int = 104) -> np.ndarray:
    """Suffixes in order of their first ``depth`` bytes, by two-stage sorting.

    Suffixes smaller than their successors are sorted directly, eight bytes a round and only while
    they tie. Each of the others is put behind its bucket's smaller ones when the scan passes its
    successor. The end of the text counts as smaller than any byte.
    """
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64)
    change = np.concatenate([np.flatnonzero(data[1:] != data[:-1]), [n - 1]])
    run_end = change[np.searchsorted(change, np.arange(n))]
    follow = np.minimum(run_end + 1, n - 1)
    smaller = (data[follow] > data) & (run_end + 1 < n)  # type: smaller than the successor
    blocks = _words(data)
    order = np.flatnonzero(smaller)
    order = order[np.argsort(blocks[order], kind="stable")]
    group = np.concatenate([[0], np.cumsum(blocks[order][1:] != blocks[order][:-1])]) if len(order) else order
    for at in range(8, depth, 8):
        if not len(order):
            break
        same = np.zeros(len(order), dtype=bool)
        same[1:] = group[1:] == group[:-1]
        tied = same.copy()
        tied[:-1] |= same[1:]
        spots = np.flatnonzero(tied)
        if not len(spots):
            break
        ahead = order[spots] + at
        key = np.where(ahead < n, blocks[np.minimum(ahead, n - 1)], 0)
        turn = np.lexsort((key, group[spots]))
        order[spots] = order[spots][turn]
        key = key[turn]
        new = np.zeros(len(order), dtype=np.int64)
        g = group[spots]
        new[spots[1:]] = (g[1:] == g[:-1]) & (key[1:] != key[:-1])
        fresh = np.concatenate([[0], group[1:] != group[:-1]]).astype(np.int64)
        group = np.cumsum(np.maximum(fresh, new))
    counts = np.bincount(data, minlength=256)
    heads = (np.cumsum(counts) - counts).tolist()
    small = np.bincount(data[order], minlength=256) if len(order) else np.zeros(256, np.int64)
    result = np.full(n, -1, dtype=np.int64)
    tails = np.cumsum(counts)
    first = np.repeat(tails - small, small)
    within = np.arange(len(order)) - np.repeat(np.cumsum(small) - small, small)
    result[first + within] = order
    sa, text, greater = result.tolist(), data.tolist(), (~smaller).tolist()
    last = n - 1  # its successor is the end of the text
    sa[heads[text[last]]] = last
    heads[text[last]] += 1
    for suffix in sa:
        if suffix > 0:
            before = suffix - 1
            if greater[before]:
                c = text[before]
                sa[heads[c]] = before
                heads[c] += 1
    return np.array(sa, dtype=np.int64)


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in ``order``, up to ``most``."""
    n, out = len(data), np.zeros(len(order), dtype=np.int64)
    alive = np.arange(1, len(order))
    for at in range(most):
        if at % 8 == 0 and at + 8 <= most:
            blocks = _words(data) if at == 0 else blocks
            a, b = order[alive] + at, order[alive - 1] + at
            inside = np.maximum(a, b) + 8 <= n
            same = np.zeros(len(alive), dtype=bool)
            same[inside] = blocks[a[inside]] == blocks[b[inside]]
            rest = alive[~same]
            for k in range(8):
                a, b = order[rest] + at + k, order[rest - 1] + at + k
                ok = np.maximum(a, b) < n
                ok[ok] = data[a[ok]] == data[b[ok]]
                rest = rest[ok]
                out[rest] += 1
            alive = alive[same]
            out[alive] += 8
        elif at >= most - most % 8:
            a, b = order[alive] + at, order[alive - 1] + at
            ok = np.maximum(a, b) < n
            ok[ok] = data[a[ok]] == data[b[ok]]
            alive = alive[ok]
            out[alive] += 1
    return out


def later_starts(contexts: list[tuple[int, int, bytes]], length: int) -> list[tuple[int, int]]:
    """(document, start) of each ``length``-byte string of the contexts that starts earlier in another place."""
    data = np.frombuffer(b"".join(c for _, _, c in contexts), dtype=np.uint8)
    sizes = np.array([len(c) for _, _, c in contexts], dtype=np.int64)
    owner = np.repeat(np.arange(len(contexts)), sizes)
    order = suffix_array(data, -(-length // 8) * 8)
    shared = common_prefixes(data, order, length) >= length
    ends = np.cumsum(sizes)
    whole = order + length <= ends[owner[order]]
    run = np.cumsum(~shared)
    order, run = order[whole], run[whole]
    doc = np.array([d for d, _, _ in contexts], dtype=np.int64)[owner[order]]
    start = np.array([a for _, a, _ in contexts], dtype=np.int64)[owner[order]] + order - (ends - sizes)[owner[order]]
    turn = np.lexsort((start, doc, run))
    run, doc, start = run[turn], doc[turn], start[turn]
    new = np.ones(len(run), dtype=bool)
    new[1:] = run[1:] != run[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(run)), 0))
    later = (doc != doc[head]) | (start != start[head])
    return doc[later], start[later]


def _compare(length: int, most: int = 1 << 20):
    def spans(contexts: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        doc, start = later_starts(contexts, length)
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
        at = np.flatnonzero(new)
        end = np.append(at[1:], len(doc))[: len(at)] - 1
        return pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(start[at]), pa.array((start[end] - start[at] + length).astype(np.int64))], names=["doc", "a", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, anchor = [], 0, None
        for batch in batches:
            sure = batch.filter(pc.is_null(batch.column("ctx")))
            if sure.num_rows:  # spans that are known to go
                yield pa.RecordBatch.from_arrays([sure.column(k) for k in ("doc", "a", "n")], names=["doc", "a", "n"])
            for h, doc, a, _, ctx in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if ctx is None:
                    continue
                if h != anchor and size >= most:
                    yield spans(held)
                    held, size = [], 0
                anchor = h
                held.append((doc, a, ctx))
                size += len(ctx)
        if held:
            yield spans(held)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their spans: how much went, and the digest of what stays."""
    for batch in batches:
        rows = []
        for doc, base, text, own in zip(*(batch.column(k).to_pylist() for k in range(4))):
            raw = (text or "").encode("utf-8", "replace")
            kept, at, runs, stop = [], 0, 0, -1
            for begin, end in sorted((x["a"] - base, min(x["a"] - base + x["n"], len(raw))) for x in own or ()):
                if begin < 0 or begin >= end:
                    continue
                if begin > stop:
                    runs += 1
                    kept.append(raw[at:begin])
                stop = at = max(stop, end)
            kept.append(raw[at:])
            rest = b"".join(kept)
            rows.append((doc, len(raw), len(raw) - len(rest), runs, hashlib.sha256(rest).hexdigest(), rest))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _placed(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc, base and text of each row, and how many characters the texts have.

    Texts of one id are one document: each other text starts at a ``base`` behind those of lesser hash,
    and equal ones share theirs. Ids with several texts are looked for first; mostly there is none.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    hashed = texts.select("doc", F.xxhash64("text").alias("t"), F.length("text").cast("long").alias("n"))
    ids = hashed.where("doc is not null").groupBy("doc").agg(F.min("t").alias("low"), F.max("t").alias("high"), F.sum("n").alias("n"))
    several, chars = ids.agg(F.count_if(F.col("low") != F.col("high")), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not several:
        return texts.select("doc", F.lit(0).alias("base"), "text"), chars
    each = texts.join(ids.where("low <> high").select("doc"), "doc", "left_semi").select("doc", F.xxhash64("text").alias("t"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n")).distinct()
    before = F.sum("n").over(Window.partitionBy("doc").orderBy("t")) - F.col("n")
    bases = cut(each.select(F.col("doc").alias("_doc"), F.col("t").alias("_t"), before.cast("int").alias("_base")))
    bases = F.broadcast(bases) if bases.count() <= _FEW else bases.hint("merge")
    joined = texts.join(bases, (F.col("doc") == F.col("_doc")) & (F.xxhash64("text") == F.col("_t")), "left")
    return joined.select("doc", F.coalesce("_base", F.lit(0)).alias("base"), "text"), chars


def repeated_contexts(texts: DataFrame, chars: int, length: int = 100, hot: int = _HOT) -> DataFrame:
    """(doc, a, n, h): with h = 0 a byte span that goes, otherwise a context to compare with those of equal h (n < 0: in ranges)."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2 * parts, -(-chars // _BUCKET_BYTES))
    rows = mapped(texts.select("doc", "base", "text"), _scan(length, buckets), "bucket long, first boolean, rows binary")
    dealt = rows.repartition(-(-buckets // 2), "bucket").sortWithinPartitions("bucket")
    return mapped(dealt, _decide(length, hot), "doc long, a long, n int, h long")


def remove_repeats(docs: DataFrame, length: int = 100, hot: int = _HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of each document.

    A null text is empty. Documents of fewer than ``length`` bytes lose nothing, nor do rows without an
    id. Rows that repeat an id and a text each lose the same spans; several texts of an id count as parts
    of one document, in the order of a hash, and no match crosses from one into another.
    """
    texts, chars = _placed(docs)
    decided = cut(repeated_contexts(texts, chars, length, hot))
    asked = texts.join(decided.where("h <> 0").groupBy("doc").agg(F.collect_list(F.struct("a", "n", "h")).alias("own")), "doc").select("doc", "base", "text", "own")
    contexts = mapped(asked, _contexts(length), "h long, doc long, a long, n long, ctx binary")
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-chars // (2 * _BUCKET_BYTES)))
    compared = mapped(contexts.repartition(parts, "h").sortWithinPartitions("h"), _compare(length), "doc long, a long, n long")
    sure = decided.where("h = 0").select("doc", "a", F.col("n").cast("long").alias("n"))
    spans = sure.unionByName(compared).groupBy("doc").agg(F.collect_list(F.struct("a", "n")).alias("own"))
    cuts = texts.join(spans, "doc", "left").select("doc", "base", "text", "own")
    return mapped(cuts, _cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


#: The same by comparing all windows as they are.
ORACLE_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, s, array_slice(b, s + 1, s + 100) AS g FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - 99)) AS s FROM d WHERE octet_length(b) >= 100)),
l AS (SELECT doc_id, s FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, s) > 1),
n AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS new FROM l),
k AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM n),
r AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS z FROM k GROUP BY doc_id, k),
e AS (SELECT doc_id, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS x, a AS y FROM r UNION ALL SELECT r.doc_id, max(z), any_value(octet_length(b)) FROM r JOIN d ON r.doc_id = d.doc_id GROUP BY r.doc_id),
t AS (SELECT e.doc_id, string_agg(CASE WHEN x < y THEN hex(array_slice(b, x + 1, y)) ELSE '' END, '' ORDER BY x) AS h FROM e JOIN d ON e.doc_id = d.doc_id GROUP BY e.doc_id),
q AS (SELECT doc_id, sum(z - a) AS removed, count(*) AS spans FROM r GROUP BY doc_id)
SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(CASE WHEN h IS NULL THEN b ELSE unhex(h) END) AS kept_sha256
FROM d LEFT JOIN q ON d.doc_id = q.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
