"""Toxicity by the nearest labelled examples in TF-IDF space.

Terms are a text's words, all of those that two labelled examples share, and such beginnings of words as
lean to label 1. A term weighs (1 + log of its count) times its inverse frequency among all documents, and terms
that lean to label 1 weigh up to three times as much as others. Labelled examples are kept in an inverted
index: rare terms as lists of examples, frequent ones as blocks of 64 examples with the blocks' greatest
weights. A query adds up its rare terms first; with the greatest weights of the others that bounds each
block's cosines, blocks are visited from the most promising on, and only where the bound can beat the
k-th best cosine, so neighbours are exact (cosines in single precision). The neighbours vote
with weights that grow with similarity, and the votes are calibrated on the examples themselves, each
scored without itself.

The examples are a bounded sample of about ``most`` labelled documents; term frequencies are counted in
all documents.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hash_share, mapped

_LETTERS = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6, 7)
BLOCK = 64
#: Share of the examples from which on a term is frequent, and the weight of terms that lean to no label.
_FREQUENT, _PLAIN = 0.08, 0.3


def word_terms(word: str) -> list[str]:
    """A lower-case word's terms: each letter run, and its beginnings of four to seven letters."""
    out = []
    for run in _LETTERS.findall(word):
        out.append(run)
        out += [run[:k] + "*" for k in BEGINNINGS if len(run) > k]
    return out


def text_terms(text: str | None) -> set[str]:
    return {t for w in set((text or "").lower().split()) for t in word_terms(w)}


Vector = tuple[np.ndarray, np.ndarray]


class Index:
    """Unit vectors (terms, weights) of examples by term; ``order`` lists them as they are numbered here.

    Examples with the same heaviest term stand together, and apart from that in the order of ``rows``.
    """

    def __init__(self, rows: list[Vector], labels: np.ndarray, n_terms: int):
        heaviest = np.array([int(t[np.argmax(w)]) if len(t) else n_terms for t, w in rows])
        self.order = np.argsort(heaviest, kind="stable")
        self.labels, self.n = labels[self.order].astype(float), len(rows)
        self.blocks = -(-max(1, self.n) // BLOCK)
        sizes = [len(rows[k][0]) for k in self.order]
        term = np.concatenate([rows[k][0] for k in self.order])
        weight = np.concatenate([rows[k][1] for k in self.order]).astype(np.float32)
        place = np.repeat(np.arange(self.n), sizes)
        many = np.bincount(term, minlength=n_terms) > max(BLOCK / 8, _FREQUENT * self.n)
        self.number = np.where(many, np.cumsum(many) - 1, -1).astype(np.int32)
        dense = many[term]
        self.dense = np.zeros((self.blocks, int(many.sum()), BLOCK), dtype=np.float32)
        self.dense[place[dense] // BLOCK, self.number[term[dense]], place[dense] % BLOCK] = weight[dense]
        self.greatest = np.ascontiguousarray(self.dense.max(axis=2, initial=0).T)
        order = np.argsort(term[~dense], kind="stable")
        self.places, self.weights = place[~dense][order].astype(np.int32), weight[~dense][order]
        self.starts = np.searchsorted(term[~dense][order], np.arange(n_terms + 1)).astype(np.int32)

    def nearest(self, queries: list[Vector], k: int, skip: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Positions and cosines of the ``k`` nearest examples of each query, but that of ``skip``; equal cosines in order of position.

        A block is worked out for those queries alone whose k-th best cosine so far its bound can beat.
        """
        n = self.blocks * BLOCK
        dense, sums = np.zeros((len(queries), self.greatest.shape[0]), dtype=np.float32), np.empty((len(queries), n), dtype=np.float32)
        for i, (terms, weights) in enumerate(queries):
            number, weights = self.number[terms], weights.astype(np.float32)
            rare = number < 0
            dense[i, number[~rare]] = weights[~rare]
            first = self.starts[terms[rare]]
            counts = self.starts[terms[rare] + 1] - first
            at = np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            sums[i] = np.bincount(self.places[at], np.repeat(weights[rare], counts) * self.weights[at], minlength=n)
            if skip is not None:
                sums[i, skip[i]] = -np.inf
        sums[:, self.n :] = -np.inf
        kth = lambda x: np.partition(x, -k, axis=1)[:, -k] if k < n else np.full(len(x), -np.inf)
        known = kth(sums)  # no k-th best cosine is less
        reach = sums.reshape(len(queries), self.blocks, BLOCK).max(axis=2) + dense @ self.greatest * np.float32(1 + 1e-5) + np.float32(1e-6)
        exact = np.full_like(sums, -np.inf)
        for turn, b in enumerate(np.argsort(-reach.sum(axis=0, where=np.isfinite(reach)), kind="stable").tolist()):
            if turn % 12 == 11:
                known = np.maximum(known, kth(exact))
            asked, own = np.flatnonzero(reach[:, b] >= known), slice(b * BLOCK, b * BLOCK + BLOCK)
            if len(asked):
                exact[asked, own] = sums[asked, own] + dense[asked] @ self.dense[b]
        out = []
        for row, least in zip(exact, kth(exact)):
            place = np.flatnonzero((row >= least) & np.isfinite(row))
            best = place[np.lexsort((place, -row[place]))[:k]]
            out.append((best, row[best].astype(float)))
        return out


def vote(labels: np.ndarray, cosine: np.ndarray) -> float:
    """Share of label 1 among the neighbours, weighted by inverse distance."""
    if not len(labels):
        return 0.0
    weight = 1 / (1.02 - np.clip(cosine, 0, 1)) ** 2
    return float(weight @ labels / weight.sum())


def _isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators, smoothed by half an example of the overall rate in each pool."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        pools.append([b, 1.0, a, a])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            s, n, low, high = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2], high]
    rate = y.mean()
    return np.array([(p[2] + p[3]) / 2 for p in pools]), np.array([(p[0] + 0.5 * rate) / (p[1] + 0.5) for p in pools])


class Terms:
    """Terms of texts by number, with those of up to ``cache`` words kept in memory."""

    def __init__(self, terms: list[str], cache: int = 200_000):
        self.whole = {t: k for k, t in enumerate(terms) if t[-1] != "*"}
        self.begin = {t[:-1]: k for k, t in enumerate(terms) if t[-1] == "*"}
        self.words: dict[str, list[int]] = {}
        self.cache = cache

    def _learn(self, word: str) -> list[int]:
        """The known terms among ``word_terms``."""
        out = []
        runs = [word] if word.isalpha() else _LETTERS.findall(word)
        for run in runs:
            known = self.whole.get(run)
            if known is not None:
                out.append(known)
            for k in BEGINNINGS:
                known = self.begin.get(run[:k]) if len(run) > k else None
                if known is not None:
                    out.append(known)
        if len(self.words) >= self.cache:
            self.words.clear()
        self.words[word] = out = list(set(out)) if len(runs) > 1 else out
        return out

    def held(self, text: str) -> list[int]:
        """The known terms of a whole text, in no order."""
        get, learn, out = self.words.get, self._learn, set()
        for w in set(text.lower().split()):
            ids = get(w)
            if ids is None:
                ids = learn(w)
            if ids:
                out.update(ids)
        return list(out)

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The known terms of a whole text and how often each occurs."""
        get, learn, out = self.words.get, self._learn, {}
        for w, n in Counter((text or "").lower().split()).items():
            own = get(w)
            if own is None:
                own = learn(w)
            for t in own:
                out[t] = out.get(t, 0) + n
        return np.fromiter(out, dtype=np.int32, count=len(out)), np.fromiter(out.values(), dtype=np.int64, count=len(out))


def _unit(terms: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> Vector:
    own = (1 + np.log(counts)) * weights[terms]
    return terms, own / (np.linalg.norm(own) or 1.0)


def _lean(a: np.ndarray, b: np.ndarray, good: int, bad: int) -> np.ndarray:
    """From 0 to 1, how surely and how strongly terms lean to label 1; a, b: examples of either label that hold them."""
    pa_, pb, pooled = a / good, b / bad, (a + b) / (good + bad)
    z = (pb - pa_) / np.sqrt(np.maximum(pooled * (1 - pooled), 1e-9) * (1 / good + 1 / bad))
    ratio = (b + 0.5) / bad / ((a + 0.5) / good)
    return np.clip((z - 2) / 6, 0, 1) * np.clip(np.log(ratio) / np.log(8), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, most: int = 3_000, k: int = 15) -> dict:
    """Learn from ``labels`` (doc_id, toxic) where ``learn`` holds; of ``docs`` only texts are read.

    Of an id with several labels the greatest counts; null ids, labels and texts are left out. The
    sample of about ``most`` labels is drawn by a hash of the id; its ids are broadcast, and so is the
    index, whose size ``most`` bounds. Without an example every score is 0.
    """
    known = labels.where(learn & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_known")).agg(F.max("toxic").cast("int").alias("_y"))
    sample = known.where(hash_share(F.col("_known"), most / max(1, known.count()), "toxic"))
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = cut(texts.join(F.broadcast(sample), F.col("doc_id") == F.col("_known")).select("doc_id", "text", "_y"))
    sizes = {r["_y"]: r["n"] for r in joined.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    good, bad = max(1, sizes.get(0, 0)), max(1, sum(n for y, n in sizes.items() if y > 0))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                for t in text_terms(text):
                    seen.setdefault(t, [0, 0])[y > 0] += 1
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1] for v in seen.values()], pa.int64())], names=["t", "a", "b"])

    seen = mapped(joined, held, "t string, a long, b long").groupBy("t").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a + b >= 2").toPandas().sort_values("t")
    seen = seen[~seen.t.str.endswith("*") | (_lean(seen.a.to_numpy(float), seen.b.to_numpy(float), good, bad) > 0)]
    terms = seen.t.tolist()
    fitted = {"shared": None, "k": k, "cal_x": np.array([0.0]), "cal_y": np.array([0.0])}
    if not terms:
        return fitted

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Terms(terms), np.zeros(len(terms), dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total[known.held(text)] += 1
        at = np.flatnonzero(total)
        for a in range(0, len(at), 10_000):
            some = at[a : a + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["t", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms(terms)
        for batch in batches:
            rows = [known.counts(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([t for t, _ in rows], pa.list_(pa.int32())), pa.array([c for _, c in rows], pa.list_(pa.int32()))], names=["doc_id", "y", "t", "c"])

    in_all = mapped(texts.select("text"), frequencies, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toPandas()
    frequency = np.zeros(len(terms))
    frequency[in_all.t.to_numpy()] = in_all.n.to_numpy()
    idf = np.log((texts.count() + 1) / (frequency + 1)) + 1
    weights = idf * (_PLAIN + (1 - _PLAIN) * _lean(seen.a.to_numpy(float), seen.b.to_numpy(float), good, bad))
    rows = mapped(joined, counted, "doc_id long, y int, t array<int>, c array<int>").toPandas()
    rows = rows.iloc[np.argsort([zlib.crc32(b"%d" % d) for d in rows.doc_id.tolist()], kind="stable")]
    vectors = [_unit(np.asarray(t, dtype=np.int32), np.asarray(c, dtype=np.float64), weights) for t, c in zip(rows.t, rows.c)]
    index = Index(vectors, (rows.y.to_numpy() > 0).astype(float), len(terms))
    examples = rows.doc_id.to_numpy()[index.order].tolist()
    del rows, vectors, seen, in_all
    fitted["shared"] = shared = docs.sparkSession.sparkContext.broadcast({"terms": terms, "weights": weights, "index": index, "examples": examples})

    def without_itself(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = shared.value["index"], Terms(shared.value["terms"])
        place = {d: a for a, d in enumerate(shared.value["examples"])}
        for batch in batches:
            queries = [_unit(*known.counts(t), shared.value["weights"]) for t in batch.column(1).to_pylist()]
            near = index.nearest(queries, k, [place[d] for d in batch.column(0).to_pylist()])
            votes = [vote(index.labels[at], cosine) for at, cosine in near]
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), batch.column(2)], names=["vote", "y"])

    votes = mapped(joined, without_itself, "vote double, y int").toPandas()
    fitted["cal_x"], fitted["cal_y"] = _isotonic(votes.vote.to_numpy(), (votes.y.to_numpy() > 0).astype(float))
    return fitted


def score(docs: DataFrame, fitted: dict) -> DataFrame:
    """doc_id, score, and the three nearest examples (evidence: example id and cosine) of each whole text.

    A text without a known term, as a null one, has no neighbour and the score of a vote of 0. Of equally
    near examples those of lower position count, which follows their heaviest term and a hash of their
    id. A null id stays null; repeated rows are scored each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = fitted["shared"].value if fitted["shared"] else {"terms": [], "weights": np.zeros(0)}
        known, evidence = Terms(shared["terms"]), pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64())]))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a in range(0, len(texts), 64):
                queries = [_unit(*known.counts(t), shared["weights"]) for t in texts[a : a + 64]]
                asked = [k for k, (terms, _) in enumerate(queries) if len(terms)]
                found = dict(zip(asked, shared["index"].nearest([queries[k] for k in asked], fitted["k"]))) if asked else {}
                votes = [vote(shared["index"].labels[found[k][0]], found[k][1]) if k in found else 0.0 for k in range(len(queries))]
                shown = [[{"doc_id": shared["examples"][p], "cosine": c} for p, c in zip(found[k][0][:3], found[k][1][:3])] if k in found else [] for k in range(len(queries))]
                yield pa.RecordBatch.from_arrays([ids.slice(a, 64), pa.array(np.interp(votes, fitted["cal_x"], fitted["cal_y"]), pa.float64()), pa.array(shown, evidence)], names=["doc_id", "score", "evidence"])

    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, score double, evidence array<struct<doc_id: long, cosine: double>>")
