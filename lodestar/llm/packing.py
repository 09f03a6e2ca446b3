"""Best-fit packing of token sequences by hierarchical residual packing.

Each partition best-fits its own pieces; nearly full bins are final at once. The pieces of all others
are numbered by length, and only how many there are of each length goes to the root, which best-fits
these counts and sends back which bin each number of a length belongs to. So the root sees at most
``capacity`` counts at any input size, and every piece left takes part.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, mapped

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_ITEM = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_BINS = pa.schema([("done", pa.bool_()), ("used", pa.int64()), ("items", pa.list_(_ITEM))])
BINS = "done boolean, used long, items array<struct<doc_id: long, piece: int, start: long, length: long, ids_crc32: long>>"
PLACED = PIECES + ", sequence_id long, offset long"
#: Letters below U+0180 whose lower case is one letter below U+0180 and which composition leaves alone.
_SIMPLE = re.compile("[!-~\xa1-\xac\xae-\u012f\u0132-\u0148\u014a-\u017e]+")
_ODD = re.compile("[²³¹¼½¾]")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|[^0-9a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f]+")

#: Byte-level alphabet: bytes without a printable character get the letters from U+0100 on, in order.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


#: Kinds of bytes: white space, letters, digits, other ASCII; 4: a word with one is kept whole.
_KIND = np.full(256, 4, dtype=np.uint8)
_KIND[:128] = 3
_KIND[[9, 10, 32]] = 0
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[[0, 11, 12, 13, 28, 29, 30, 31, 39, 127]] = 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE_BITS = 19
#: Bytes of the longest word that is looked up as two numbers.
_SHORT = 16


class WordEncoder:
    """Token ids of texts by way of their words, each of which the tokenizer sees once.

    The tokenizer drops white space and no token crosses it, so a text's ids are those of its words in
    turn. Words of plain ASCII without an apostrophe are cut further where letters, digits and other
    characters meet, as the tokenizer cuts them. A word of up to 16 bytes is two 64-bit numbers, which
    are compared whole, so different words never pass for each other; longer ones are keys of a
    dictionary. Ids of up to ``cache`` words stay in memory; further words are encoded whenever they occur.
    """

    def __init__(self, path: str, cache: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.limit = min(cache, 1 << (_TABLE_BITS - 1))
        self.parts: dict[str, bytes] = {}
        self.longer: dict[bytes, bytes] = {}
        self.slots = np.full(1 << _TABLE_BITS, -1, dtype=np.int32)
        self.words = np.zeros((1024, 2), dtype=np.uint64)
        self.begin = np.zeros(1025, dtype=np.int64)
        self.pool = np.zeros(4096, dtype=np.uint32)
        self.n = 0

    def _encode_part(self, part: str) -> bytes:
        """A lower-case pre-token by the tokenizer's own model, in its byte alphabet."""
        mapped = part if part.isascii() else part.encode().decode("latin-1").translate(_ALPHABET)
        return b"".join([t.id.to_bytes(4, "little") for t in self.tokenize(mapped)])

    def _encode_words(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = []
        known, room = self.parts, len(self.parts) < self.limit // 4
        for raw in words:
            if raw.isalpha() and raw.isascii():
                out.append(self._encode_part(raw.decode().lower()))
                continue
            word = raw.decode("utf-8", "replace")
            if _SIMPLE.fullmatch(word) and "<|" not in word and not _ODD.search(word):
                ids = []
                for part in _PARTS.findall(word.lower()):
                    got = known.get(part)
                    if got is None:
                        got = self._encode_part(part)
                        if room:
                            known[part] = got
                    ids.append(got)
                out.append(b"".join(ids))
            else:
                out.append(np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes())
        return out

    @staticmethod
    def _slot(words: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (words[:, 0] ^ (words[:, 1] * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
            return (((h ^ (h >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def _find(self, words: np.ndarray) -> np.ndarray:
        """Numbers of known words, -1 for others, by linear probing."""
        at = self._slot(words)
        found = self.slots[at]
        open_ = np.flatnonzero((found >= 0) & (self.words[found] != words).any(axis=1))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << _TABLE_BITS) - 1)
            found[open_] = self.slots[at[open_]]
            open_ = open_[(found[open_] >= 0) & (self.words[found[open_]] != words[open_]).any(axis=1)]
        return found

    def _keep(self, words: np.ndarray, first: int) -> None:
        slots = self.slots
        for k, at in enumerate(self._slot(words).tolist(), first):
            while slots[at] >= 0:
                at = (at + 1) & ((1 << _TABLE_BITS) - 1)
            slots[at] = k

    def _append(self, words: np.ndarray, encoded: list[bytes]) -> None:
        """Ids of new words behind the known ones, from number ``self.n`` on."""
        n, more = self.n, np.frombuffer(b"".join(encoded), dtype="<u4")
        while len(self.words) < n + len(words):
            self.words = np.concatenate([self.words, np.zeros_like(self.words)])
            self.begin = np.concatenate([self.begin, np.zeros(len(self.words) + 1 - len(self.begin), np.int64)])
        start = self.begin[n]
        while len(self.pool) < start + len(more):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.words[n : n + len(words)] = words
        self.pool[start : start + len(more)] = more
        self.begin[n + 1 : n + len(words) + 1] = start + np.cumsum([len(e) // 4 for e in encoded])

    def _encode_longer(self, words: list[bytes]) -> list[bytes]:
        missing = [w for w in dict.fromkeys(words) if w not in self.longer]
        fresh = dict(zip(missing, self._encode_words(missing)))
        out = [fresh[w] if w in fresh else self.longer[w] for w in words]
        if len(self.longer) + len(fresh) <= self.limit // 4:
            self.longer |= fresh
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without a closing id."""
        coded = [t.encode("utf-8", "replace") for t in texts]
        raw = b"\n".join([b"", *coded, b""])
        data = np.frombuffer(raw, dtype=np.uint8)
        kind = _KIND[data]
        if b"<|" in raw:
            kind[data == 124] = 4
        blank = kind == 0
        edge = blank[1:] != blank[:-1]
        change = edge | ((kind[1:] != kind[:-1]) | (kind[1:] == 2)) & ~blank[1:]
        chunks = np.flatnonzero(edge) + 1  # begin and end of white-space words in turn
        whole = np.maximum.reduceat(kind, chunks)[::2] == 4 if len(chunks) else np.zeros(0, bool)
        inner = np.zeros(len(raw) + 1, dtype=np.int8)
        inner[chunks[::2][whole] + 1] += 1
        inner[chunks[1::2][whole]] -= 1
        change &= ~(np.cumsum(inner[1:-1], dtype=np.int8) > 0) | edge
        begin = np.flatnonzero(change & ~blank[1:]) + 1
        ends = np.append(begin[1:], len(raw))
        at = np.searchsorted(chunks[1::2], begin, side="right")
        ends = np.minimum(ends, chunks[1::2][at] if len(begin) else begin)
        lengths = ends - begin
        short = lengths <= _SHORT
        if b"\0" in raw:
            zeros = np.cumsum(data == 0)
            short &= zeros[ends - 1] == zeros[begin - 1]
        padded = np.zeros(len(raw) + _SHORT, dtype=np.uint8)
        padded[: len(raw)] = data
        some = np.lib.stride_tricks.sliding_window_view(padded, _SHORT)[begin[short]]
        plain = ~whole[at[short]]
        some[plain] = _LOWER[some[plain]]
        some[np.arange(_SHORT) >= lengths[short][:, None]] = 0
        words = some.view("<u8")
        number = np.empty(len(begin), dtype=np.int64)
        number[short] = found = self._find(words)
        missing, keep = np.flatnonzero(found < 0), self.n
        if len(missing):
            fresh, first, inverse = np.unique(words[missing], axis=0, return_index=True, return_inverse=True)
            spots = np.flatnonzero(short)[missing[first]]
            self._append(fresh, self._encode_words([raw[a:b] for a, b in zip(begin[spots].tolist(), ends[spots].tolist())]))
            number[np.flatnonzero(short)[missing]] = self.n + inverse.ravel()
            if self.n + len(fresh) <= self.limit:
                self._keep(fresh, self.n)
                keep = self.n + len(fresh)
            self.n += len(fresh)
        rest = np.flatnonzero(~short)
        if len(rest):
            self._append(np.zeros((len(rest), 2), np.uint64), self._encode_longer([raw[a:b] for a, b in zip(begin[rest].tolist(), ends[rest].tolist())]))
            number[rest] = self.n + np.arange(len(rest))
        from_, lengths = self.begin[number], self.begin[number + 1] - self.begin[number]
        self.n = keep
        before = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.pool[np.repeat(from_ - before[:-1], lengths) + np.arange(before[-1])]
        offsets = np.concatenate([[1], 1 + np.cumsum([len(c) + 1 for c in coded])])
        cuts = before[np.searchsorted(begin, offsets)]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def encode_long(self, text: str, most: int = 1 << 17) -> np.ndarray:
        """``encode`` of one text in parts, cut at white space."""
        parts, at = [], 0
        while len(text) - at > most:
            blank = next((k for k in range(at + most, at, -1) if text[k] in " \n"), None)
            stop = blank if blank is not None else next((k for k in range(at + most, len(text)) if text[k] in " \n"), len(text))
            parts.append(text[at:stop])
            at = stop
        return np.concatenate([self.encode([x])[0] for x in [*parts, text[at:]]])


def _blocks(texts: list[str], most: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` characters each."""
    at = size = 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= most:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Cut each document's ids, closed by ``end_id``, into pieces of at most ``capacity``.

    A null or empty text has the closing id alone; a null id stays null. Repeated rows are packed as
    often as they occur. Columns: doc_id, piece, start, length, ids_crc32, and ids (little-endian unsigned 32-bit) if asked.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids)
    step, closing = 4 * capacity, int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _blocks(texts):
                rows: list[tuple] = []
                coded = encoder.encode(texts[a:b]) if b - a > 1 else [encoder.encode_long(texts[a])]
                for doc_id, own in zip(ids[a:b], coded):
                    raw = own.tobytes() + closing
                    for k, at in enumerate(range(0, len(raw), step)):
                        part = raw[at : at + step]
                        rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), *([part] * with_ids)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, PIECES + ", ids binary" * with_ids)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes by best fit, larger items first. A bit set finds the tightest open bin."""
    bins: list[list[int]] = []
    open_bins: dict[int, list[int]] = defaultdict(list)
    mask = 0
    for k in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[k]
        fits = mask >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            at = open_bins[left].pop()
            if not open_bins[left]:
                mask &= ~(1 << left)
            bins[at].append(k)
        else:
            left, at = capacity, len(bins)
            bins.append([k])
        if left > size:
            open_bins[left - size].append(at)
            mask |= 1 << (left - size)
    return bins


def best_fit_counts(counts: dict[int, int], capacity: int) -> np.ndarray:
    """``best_fit`` of so many items of each length, as runs: length, first item, items, first bin, items a bin.

    Items of a length and bins are numbered from 0 on. Bins of equal contents are handled together, so
    time and memory depend on the number of lengths, not of items.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: (first bin, bins)
    mask = opened = 0

    def leave(left: int, first: int, bins: int) -> None:
        nonlocal mask
        if left and bins:
            groups[left].append((first, bins))
            mask |= 1 << left

    for size in sorted(counts, reverse=True):
        at, k = 0, counts[size]
        while at < k:
            fits = mask >> size
            if fits:
                left = size + (fits & -fits).bit_length() - 1
                first, bins = groups[left].pop()
                if not groups[left]:
                    mask &= ~(1 << left)
            else:
                left, first, bins = capacity, opened, -(-(k - at) // (capacity // size))
                opened += bins
            each = left // size
            full = min(bins, (k - at) // each)
            if full:
                runs.append((size, at, full * each, first, each))
                leave(left - each * size, first, full)
                at += full * each
            if full < bins and at < k:
                rest = k - at
                runs.append((size, at, rest, first + full, rest))
                leave(left - rest * size, first + full, 1)
                at, full = k, full + 1
            leave(left, first + full, bins - full)
    return np.array(runs, dtype=np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = 4096, slack: int = 16) -> DataFrame:
    """Place every piece: the columns of ``pieces`` with sequence_id and offset.

    ``pieces`` needs doc_id, piece and length (1 to ``capacity``), and is computed once. Ties between
    equal lengths may fall either way. An empty input gives no rows.
    """
    fields = list(_ITEM)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held).select([f.name for f in fields]).combine_chunks()
        lengths = table.column("length").to_numpy()
        bins = best_fit(lengths.tolist(), capacity)
        totals = [int(lengths[own].sum()) for own in bins]
        full = [own for own, total in zip(bins, totals) if total >= capacity - slack]
        loose = [[k] for own, total in zip(bins, totals) if total < capacity - slack for k in own]
        own_bins = full + loose
        for at in range(0, len(own_bins), 2000):
            some = own_bins[at : at + 2000]
            order = np.concatenate(some)
            items = pa.StructArray.from_arrays([table.column(f.name).take(order).combine_chunks() for f in fields], fields=fields)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in some])]).astype(np.int32)
            used = np.add.reduceat(lengths[order], offsets[:-1])
            done = np.arange(at, at + len(some)) < len(full)
            yield pa.RecordBatch.from_arrays([pa.array(done), pa.array(used), pa.ListArray.from_arrays(offsets, items)], schema=_BINS)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            used = batch.column(1).to_numpy()
            order = np.argsort(used, kind="stable")
            ranked = used[order]
            rank = np.empty(len(used), dtype=np.int64)
            rank[order] = np.arange(len(used)) - np.searchsorted(ranked, ranked) + seen[ranked]
            seen += np.bincount(used, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), part, dtype=np.int32)), batch.column(1), pa.array(rank), batch.column(2)], names=["part", "used", "rank", "items"])

    level = cut(pieces.mapInArrow(local, BINS))
    rest = cut(level.where("not done").mapInArrow(numbered, "part int, used long, rank long, " + BINS[BINS.index("items") :]))
    counts = rest.groupBy("used", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("used").orderBy("part")) - F.col("n")).select("used", "part", "before")
    runs = best_fit_counts({r["used"]: r["n"] for r in counts.groupBy("used").agg(F.sum("n").alias("n")).collect()}, capacity)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((runs[:, 1], runs[:, 0]))
        size, first, _, bins, each = runs[order].T
        start = {int(s): k for k, s in reversed(list(enumerate(size.tolist())))}
        stop = {int(s): k + 1 for k, s in enumerate(size.tolist())}
        for batch in batches:
            used, number = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = np.empty(len(used), dtype=np.int64)
            for s in np.unique(used).tolist():
                own = used == s
                at[own] = start[s] - 1 + np.searchsorted(first[start[s] : stop[s]], number[own], side="right")
            yield pa.RecordBatch.from_arrays([pa.array(bins[at] + (number - first[at]) // each[at]), batch.column(2)], names=["bin", "items"])

    met = rest.join(before.hint("merge"), ["used", "part"]).select("used", (F.col("rank") + F.col("before")).alias("number"), "items")
    root = met.mapInArrow(dealt, "bin long, " + BINS[BINS.index("items") :]).groupBy("bin").agg(F.flatten(F.collect_list("items")).alias("items"))
    bins = level.where("done").select("items").unionByName(cut(root.select("items")))
    return bins.select(F.monotonically_increasing_id().alias("sequence_id"), "items").mapInArrow(_place, PLACED)


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([*_ITEM, pa.field("sequence_id", pa.int64()), pa.field("offset", pa.int64())])
    for batch in batches:
        items = batch.column(1)
        rows = items.flatten()
        lengths = rows.field("length").to_numpy(zero_copy_only=False)
        counts = np.diff(items.offsets.to_numpy())
        before = np.cumsum(lengths) - lengths
        first = np.repeat(np.cumsum(counts) - counts, counts)
        sequence = np.repeat(batch.column(0).to_numpy(), counts)
        yield pa.RecordBatch.from_arrays([*rows.flatten(), pa.array(sequence), pa.array(before - before[first] if len(before) else before, pa.int64())], schema=schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Documents to packed sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts become a piece with the closing id alone; extra columns play no part.
    """
    return pack(token_pieces(docs, tokenizer, capacity, end_id), capacity)
