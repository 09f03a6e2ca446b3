"""Benchmark decontamination by SimHash of item-sized windows.

For each benchmark item, windows of as many words are slid over a document; a document that is shorter,
but long enough to reach the similarity, is one window as a whole. Their 128-bit SimHash fingerprints of
five-word shingles are looked up in a multi-index of eight blocks of 16 bits: of two fingerprints within
``RADIUS`` = 31 bits, one block at least differs in three bits or fewer, so every item within the radius is
found, and of unrelated pairs about one in twelve is looked at. What is found is verified by the exact
weighted-shingle similarity. Texts of similarity 0.8 differ in 19 bits on average; the tests measure how
many are within the radius. A window without any shingle of an item has similarity 0 to it, so windows
are only fingerprinted where they hold one.

The benchmark is read in blocks of bounded size, some of which meet the documents in each pass over them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped
from .shingles import mix, shingle_hashes, word_hashes

WIDTH, SIMILARITY, RADIUS = 5, 0.8, 31
_BLOCKS, _SECOND = 8, np.uint64(0x9E3779B97F4A7C15)
_flips = lambda most: np.array([sum(1 << b for b in own) for k in range(most + 1) for own in combinations(range(16), k)], dtype=np.uint16)
#: What block keys are changed by: two bits in the index and one in the query make three.
_INDEXED, _ASKED = _flips(2), _flips(1)


def _signs(hashes: np.ndarray) -> np.ndarray:
    """One row of 128 signs for each hash."""
    both = np.stack([hashes, mix(hashes ^ _SECOND)], axis=1).view(np.uint8)
    return (np.unpackbits(both, axis=1).astype(np.int8) << 1) - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    """Fingerprints as eight blocks of 16 bits."""
    return np.packbits(sums > 0, axis=1).view(np.uint16)


def simhash(shingles: np.ndarray) -> np.ndarray:
    """Fingerprint of a shingle multiset; a shingle weighs as much as it occurs."""
    return _pack(_signs(shingles).sum(axis=0, keepdims=True, dtype=np.int32))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(a).view(np.uint64) ^ np.ascontiguousarray(b).view(np.uint64)).sum(axis=1)


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Sum of lesser over sum of greater shingle weights."""
    return sum((a & b).values()) / max(1, sum((a | b).values()))


class MultiIndex:
    """Fingerprints by the keys of their blocks, and by all keys two bits away."""

    def __init__(self, prints: np.ndarray):
        self.prints, self.keys, self.items = prints, [], []
        for b in range(_BLOCKS):
            keys = (prints[:, b : b + 1] ^ _INDEXED).ravel()
            order = np.argsort(keys, kind="stable")
            self.keys.append(keys[order])
            self.items.append((order // len(_INDEXED)).astype(np.int32))

    def probed(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs of which a block agrees but for three bits or fewer."""
        found = []
        for b in range(_BLOCKS):
            asked = (prints[:, b : b + 1] ^ _ASKED).ravel()
            low = np.searchsorted(self.keys[b], asked, side="left")
            n = np.searchsorted(self.keys[b], asked, side="right") - low
            before = np.cumsum(n) - n
            at = np.repeat(low - before, n) + np.arange(n.sum())
            found.append(np.repeat(np.arange(len(asked)) // len(_ASKED), n) * len(self.prints) + self.items[b][at])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.prints), pairs % len(self.prints)

    def within(self, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius."""
        window, item = self.probed(prints)
        close = distances(prints[window], self.prints[item]) <= radius
        return window[close], item[close]


class Benchmark:
    """Items by size, with the multi-index of each size, and all their shingles by width."""

    def __init__(self, items: list[tuple[int, str]]):
        self.sizes: dict[int, dict] = {}
        held: dict[int, dict[int, set[int]]] = {}
        for item_id, text in items:
            words = word_hashes(text or "")
            if not len(words):
                continue
            own = shingle_hashes(words, WIDTH)
            size = self.sizes.setdefault(len(words), {"ids": [], "prints": [], "weights": []})
            size["ids"].append(item_id)
            size["prints"].append(simhash(own))
            size["weights"].append(Counter(own.tolist()))
            for s in own.tolist():
                held.setdefault(min(WIDTH, len(words)), {}).setdefault(s, set()).add(len(words))
        for size in self.sizes.values():
            size["index"] = MultiIndex(np.concatenate(size["prints"]))
        self.widths = {}
        for width, shingles in held.items():
            known = np.array(sorted(shingles), dtype=np.uint64)
            bloom = np.zeros(1 << 20, dtype=bool)
            bloom[(known >> np.uint64(44)).astype(np.int64)] = True
            self.widths[width] = (known, [tuple(sorted(shingles[s])) for s in known.tolist()], bloom)

    def matches(self, text: str, least: float = SIMILARITY) -> dict[int, tuple[float, int, int]]:
        """item_id to (similarity, first word, words) of the best window, the first of equals."""
        out: dict[int, tuple[float, int, int]] = {}
        words = word_hashes(text)
        for width in self.widths:
            if len(words):
                self._add(out, words, width, least)
        return out

    def _add(self, out: dict, words: np.ndarray, width: int, least: float) -> None:
        known, of, bloom = self.widths[width]
        own = shingle_hashes(words, width) if len(words) >= width else words[:0]
        at = np.flatnonzero(bloom[(own >> np.uint64(44)).astype(np.int64)])
        if not len(at):
            return
        place = np.minimum(np.searchsorted(known, own[at]), len(known) - 1)
        hit = known[place] == own[at]
        spots: dict[int, list[int]] = {}
        for p, k in zip(at[hit].tolist(), place[hit].tolist()):
            for n in of[k]:
                spots.setdefault(n, []).append(p)

        def better(size: dict, k: int, window: np.ndarray, first: int, n: int) -> None:
            similarity, item = weighted_similarity(Counter(window.tolist()), size["weights"][k]), size["ids"][k]
            if similarity >= least and (item not in out or (similarity, -first) > (out[item][0], -out[item][1])):
                out[item] = (similarity, first, n)

        for n, positions in spots.items():
            span, size = n - width + 1, self.sizes[n]
            if n > len(words):
                if len(own) >= least * span:
                    for k in size["index"].within(simhash(own), RADIUS)[1].tolist():
                        better(size, k, own, 0, len(words))
                continue
            ranges: list[list[int]] = []
            for p in positions:
                a, b = max(0, p - span + 1), min(p, len(words) - n)
                if a > b:
                    continue
                if ranges and a <= ranges[-1][1] + 1:
                    ranges[-1][1] = max(ranges[-1][1], b)
                else:
                    ranges.append([a, b])
            for first, last in ranges:
                for a in range(first, last + 1, 2048):
                    b = min(last, a + 2047)
                    total = np.concatenate([np.zeros((1, 128), np.int32), np.cumsum(_signs(own[a : b + span]), axis=0, dtype=np.int32)])
                    for w, k in zip(*(x.tolist() for x in size["index"].within(_pack(total[span:] - total[:-span]), RADIUS))):
                        better(size, k, own[a + w : a + w + span], a + w, n)


def benchmark_blocks(benchmark: DataFrame, most_items: int = 4096, most_chars: int = 4_000_000, together: int = 4) -> Iterator[list[list[tuple[int, str]]]]:
    """The items in blocks of about so many rows and characters, dealt by a hash of the id; ``together`` blocks at a time."""
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()
    blocks = max(1, -(-n // most_items), -(-chars // most_chars))
    for first in range(0, blocks, together):
        some: list[list[tuple[int, str]]] = [[] for _ in range(min(together, blocks - first))]
        place = F.pmod(F.xxhash64("item_id"), F.lit(blocks)) - first
        for r in rows.select("item_id", "text", place.alias("k")).where(F.col("k").between(0, len(some) - 1)).collect():
            some[r["k"]].append((r["item_id"], r["text"]))
        yield some


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): each item that a document holds, at its best window.

    Null and empty texts hold nothing; a null doc_id stays null; items without an id or a word are left
    out. An item of fewer than five words is one shingle of all its words, so it is held only word for
    word. Of an id that occurs in several benchmark rows the best counts; repeated documents give
    repeated rows.
    """

    def finder(blocks: list[list[tuple[int, str]]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = [Benchmark(items) for items in blocks]
            for batch in batches:
                rows = [(d, i, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for b in known for i, m in b.matches(t, least).items()]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                columns = zip(*rows) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

        return run

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = None
    for blocks in benchmark_blocks(benchmark):
        part = mapped(texts, finder(blocks), "doc_id long, item_id long, similarity double, first_word long, n_words long")
        found = part if found is None else found.unionByName(part)
    return found


def drop_leaking(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The documents, with all columns, that hold no benchmark item; null texts stay."""
    kept, at = docs, docs.columns.index("text")
    for blocks in benchmark_blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], blocks=blocks) -> Iterator[pa.RecordBatch]:
            known = [Benchmark(items) for items in blocks]
            for batch in batches:
                yield batch.filter(pa.array([not (t and any(b.matches(t, least) for b in known)) for t in batch.column(at).to_pylist()], pa.bool_()))

        kept = mapped(kept, run, docs.schema)
    return kept


#: The same over all windows that hold a shingle of an item, without fingerprints.
ORACLE_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT item_id, w, len(w) AS n, least(5, len(w)) AS width, len(w) - least(5, len(w)) + 1 AS span FROM iw WHERE len(w) > 0),
ig AS (SELECT item_id, n, width, span, g, count(*) AS c FROM (SELECT *, unnest(list_transform(range(1, span + 1), lambda k: array_to_string(list_slice(w, k, k + width - 1), ' '))) AS g FROM i) GROUP BY ALL),
dg AS (SELECT doc_id, words, width, unnest(range(0, words - width + 1)) AS p, unnest(list_transform(range(1, words - width + 2), lambda k: array_to_string(list_slice(w, k, k + width - 1), ' '))) AS g
       FROM (SELECT *, len(w) AS words FROM dw), (SELECT DISTINCT width FROM i) WHERE words >= width),
h AS (SELECT doc_id, item_id, words, n, dg.width, span, p, g, c FROM dg JOIN ig USING (g, width)),
s AS (SELECT *, unnest(CASE WHEN n > words THEN [0] ELSE range(greatest(0, p - span + 1), least(p, words - n) + 1) END) AS first FROM h WHERE n <= words OR words - width + 1 >= 0.8 * span),
m AS (SELECT doc_id, item_id, first, least(n, words) AS n_words, least(span, words - width + 1) + span AS total, least(count(*), any_value(c)) AS held FROM s GROUP BY doc_id, item_id, first, n, words, width, span, g),
v AS (SELECT doc_id, item_id, first, n_words, sum(held)::DOUBLE / (any_value(total) - sum(held)) AS similarity FROM m GROUP BY ALL)
SELECT doc_id, item_id, max(similarity)::DOUBLE AS similarity, arg_max(first, {'x': similarity, 'y': -first})::BIGINT AS first_word, any_value(n_words)::BIGINT AS n_words FROM v WHERE similarity >= 0.8 GROUP BY doc_id, item_id
"""
