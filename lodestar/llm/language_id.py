"""Language identification by segmentation-marginalised unigram models.

A language gives each piece of a fixed public vocabulary a probability. A word's likelihood is the sum
over all its segmentations into pieces, by a forward pass over the word; a text's is the product over
its words. The probabilities are learned by expectation maximisation on word counts of a bounded sample
of labelled documents: about ``most_docs`` documents and ``most_words`` distinct words of each language,
of up to ``LONGEST`` letters. Words to be scored may be of any length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SAMPLE_BUCKETS, cut, mapped

#: Letters of the longest words that are learned from.
LONGEST = 64
_WORDS = re.compile(r"[^\W\d_]+")
_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BITS = 18
START = "▁"
#: What a running likelihood is lifted by when it gets small.
_TINY, _LIFT = 1e-100, 1e100


def word_parts(word: str) -> list[str]:
    """Letter runs of a word in lower case; numbers written by other signs than digits are no letters."""
    out = []
    for run in _WORDS.findall(word.lower()):
        out += [run] if run.isalpha() else ["".join(x) for letters, x in groupby(run, str.isalpha) if letters]
    return out


class PieceModel:
    """Piece probabilities of each language, and the forward pass over words."""

    def __init__(self, pieces: list[str], probabilities: np.ndarray, unknown: np.ndarray):
        self.pieces, self.probabilities, self.unknown = pieces, probabilities, unknown
        self.longest = max(map(len, pieces), default=1)
        codes, lengths = self._codes(pieces)
        hashes = self._hash_all(codes, lengths)
        order = np.argsort(hashes)
        self.sorted, self.number = hashes[order], order
        self.bloom = np.zeros(1 << _BITS, dtype=bool)
        self.bloom[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    @staticmethod
    def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        width = int(lengths.max(initial=1))
        flat = np.frombuffer("".join(words).encode("utf-32-le", "replace"), dtype=np.uint32)
        codes = np.zeros((len(words), width), dtype=np.uint64)
        codes[np.arange(width)[None, :] < lengths[:, None]] = flat
        return codes, lengths

    @staticmethod
    def _hash_all(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        h = np.zeros(len(codes), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(codes.shape[1]):
                h = np.where(k < lengths, h * _STEP + codes[:, k] + np.uint64(1), h)
            h = (h ^ (h >> np.uint64(32))) * _SPREAD
            return h ^ (h >> np.uint64(29))

    def arcs(self, codes: np.ndarray, lengths: np.ndarray) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
        """For each end position, (piece length, rows, piece numbers) of the pieces that end there."""
        n, width = codes.shape
        nothing, rolling = np.zeros(n, dtype=np.uint64), {}
        for end in range(1, width + 1):
            alive = end <= lengths
            fresh: dict[int, np.ndarray] = {}
            found = []
            with np.errstate(over="ignore"):
                for m in range(1, min(end, self.longest) + 1):
                    h = (rolling[m - 1] if m > 1 else nothing) * _STEP + codes[:, end - 1] + np.uint64(1)
                    fresh[m] = h
                    g = (h ^ (h >> np.uint64(32))) * _SPREAD
                    g ^= g >> np.uint64(29)
                    rows = np.flatnonzero(alive & self.bloom[(g >> np.uint64(64 - _BITS)).astype(np.int64)])
                    if len(rows):
                        at = np.minimum(np.searchsorted(self.sorted, g[rows]), len(self.sorted) - 1)
                        hit = self.sorted[at] == g[rows]
                        if hit.any():
                            found.append((m, rows[hit], self.number[at[hit]]))
            rolling = fresh
            yield found

    def log_likelihoods(self, words: list[str]) -> np.ndarray:
        """Of each word (with its start mark), for each language. A character outside all pieces costs ``unknown``.

        Words of like lengths are worked out together, of any length.
        """
        out = np.zeros((len(words), self.probabilities.shape[1]))
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        steps = np.array([6, 10, 15, 25, *(32 * 2**k for k in range(1, 40))])
        kind = np.searchsorted(steps, lengths)
        for k in np.unique(kind).tolist():
            chosen = np.flatnonzero(kind == k)
            some = max(1, 300_000 // int(lengths[chosen].max()))
            for a in range(0, len(chosen), some):
                rows = chosen[a : a + some]
                out[rows] = self._forward([words[r] for r in rows.tolist()])
        return out

    def _forward(self, words: list[str]) -> np.ndarray:
        codes, lengths = self._codes(words)
        alpha = [np.ones((len(words), self.probabilities.shape[1]))]  # of the last positions, as many as a piece is long
        lifted, out = np.zeros_like(alpha[0]), np.zeros_like(alpha[0])
        for end, found in enumerate(self.arcs(codes, lengths), 1):
            here = alpha[-1] * self.unknown
            for m, rows, piece in found:
                here[rows] += alpha[-m][rows] * self.probabilities[piece]
            alpha = [*alpha[1 - self.longest :], here] if self.longest > 1 else [here]
            done = lengths == end
            if done.any():
                out[done] = np.log(np.maximum(here[done], 1e-300)) - lifted[done] * np.log(_LIFT)
            small = here < _TINY
            if small.any():
                factor = np.where(small, _LIFT, 1.0)
                alpha = [x * factor for x in alpha]
                lifted += small
        return out

    def expected(self, words: list[str], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Expected uses of each piece and of unknown characters; ``counts``: words by languages."""
        uses, unknown = np.zeros_like(self.probabilities), np.zeros(self.probabilities.shape[1])
        for a in range(0, len(words), 20_000):
            part, c = words[a : a + 20_000], counts[a : a + 20_000]
            codes, lengths = self._codes(part)
            arcs = list(self.arcs(codes, lengths))
            alpha = [np.ones((len(part), c.shape[1]))]
            for end, found in enumerate(arcs, 1):
                here = alpha[end - 1] * self.unknown
                for m, rows, piece in found:
                    here[rows] += alpha[end - m][rows] * self.probabilities[piece]
                alpha.append(here)
            beta = [np.zeros_like(alpha[0]) for _ in alpha]
            stacked = np.stack(alpha)[lengths, np.arange(len(part))]
            weight = c / np.maximum(stacked, 1e-300)
            for end in range(len(arcs), 0, -1):
                beta[end][lengths == end] = 1.0
                flow = beta[end] * weight
                unknown += (alpha[end - 1] * self.unknown * flow).sum(axis=0)
                beta[end - 1] += self.unknown * beta[end]
                for m, rows, piece in arcs[end - 1]:
                    p = self.probabilities[piece]
                    np.add.at(uses, piece, alpha[end - m][rows] * p * flow[rows])
                    beta[end - m][rows] += p * beta[end][rows]
        return uses, unknown


def load_pieces(vocabulary: str) -> list[str]:
    """The vocabulary's pieces of letters, with or without the start mark, in lower case and once each."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    texts = (model.id_to_piece(k).lower() for k in range(model.vocab_size()))
    return sorted({t for t in texts if t.removeprefix(START).isalpha() or t == START})


def _most_common(words: DataFrame, most: int) -> DataFrame:
    """Of each language the words with the greatest counts, ``most`` at most: all from some count on.

    The count from which on words are taken follows from how many words there are of each count; only
    these numbers come to the driver.
    """
    least: dict[str, int] = {}
    held: dict[str, list[tuple[int, int]]] = {}
    for r in words.groupBy("lang", "n").agg(F.count("*").alias("words")).collect():
        held.setdefault(r["lang"], []).append((r["n"], r["words"]))
    for lang, own in held.items():
        total = 0
        for n, k in sorted(own, reverse=True):
            total += k
            if total > most and lang in least:
                break
            least[lang] = n
    if not least:
        return words
    return words.where(F.col("n") >= F.create_map(*[F.lit(x) for item in least.items() for x in item])[F.col("lang")])


def fit(docs: DataFrame, learn: Column, vocabulary: str, most_docs: int = 1_500, most_words: int = 60_000, rounds: int = 4) -> dict:
    """Learn from text and lang of the documents for which ``learn`` holds; other columns aren't read.

    Null texts, languages and ids are left out. Of each language a sample of about ``most_docs`` is drawn
    by a hash of the id, so rare languages are learned as well; rows that repeat an id are drawn
    together. Without any usable document the model has no language and every text is ``und``.
    """
    usable = docs.where(learn & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    shares = {r["lang"]: r["n"] for r in usable.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not shares:
        return {"langs": [], "pieces": [], "probabilities": None, "unknown": None, "prior": None}
    bound = F.create_map(*[F.lit(x) for lang, n in shares.items() for x in (lang, int(min(1.0, most_docs / n) * SAMPLE_BUCKETS))])
    drawn = F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(SAMPLE_BUCKETS)) < bound[F.col("lang").cast("string")]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, n in Counter(text.lower().split()).items():
                    for part in word_parts(word):
                        if len(part) <= LONGEST:
                            seen[lang, part] += n
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in seen], pa.string()), pa.array([x for _, x in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "w", "n"])

    sample = usable.where(drawn).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    words = cut(mapped(sample, counted, "lang string, w string, n long").groupBy("lang", "w").agg(F.sum("n").alias("n")))
    counts: dict[str, dict[str, int]] = {}
    for r in _most_common(words, most_words).toPandas().itertuples(index=False):
        counts.setdefault(START + r.w, {})[r.lang] = int(r.n)
    langs = sorted({x for own in counts.values() for x in own})
    if not langs:
        return {"langs": [], "pieces": [], "probabilities": None, "unknown": None, "prior": None}
    pieces, k = load_pieces(vocabulary), len(langs)
    matrix = np.array([[own.get(x, 0) for x in langs] for own in counts.values()], dtype=np.float64)
    lengths = np.array([len(p) for p in pieces])
    start = np.repeat((10.0 ** -(1.0 + 0.5 * np.minimum(lengths, 8)))[:, None], k, axis=1)
    model = PieceModel(pieces, start / start.sum(axis=0), np.full(k, 1e-7))
    texts = list(counts)
    for _ in range(rounds):
        uses, unknown = model.expected(texts, matrix)
        total = uses.sum(axis=0) + unknown + 0.01 * len(pieces)
        model.probabilities = (uses + 0.01) / total
        model.unknown = np.clip(unknown / total / 1000, 1e-9, 1e-4)
    seen = np.array([shares.get(x, 0) for x in langs], dtype=np.float64)
    keep = (model.probabilities * total).max(axis=1) > 0.02
    return {"langs": langs, "pieces": [p for p, x in zip(pieces, keep) if x], "probabilities": model.probabilities[keep], "unknown": model.unknown, "prior": np.log((seen + 1) / (seen + 1).sum())}


class _Scorer:
    """Sums of word log likelihoods, with those of up to ``cache`` words kept in memory."""

    def __init__(self, fitted: dict, cache: int = 200_000):
        self.model = PieceModel(fitted["pieces"], fitted["probabilities"], fitted["unknown"])
        self.prior, self.cache = fitted["prior"], cache
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, len(fitted["langs"])))
        self.letters = np.zeros(1024, dtype=bool)
        self.n = 0

    def _learn(self, words: list[str]) -> None:
        owner, parts = [], []
        for k, word in enumerate(words):
            for part in word_parts(word):
                owner.append(k)
                parts.append(START + part)
        while len(self.rows) < self.n + len(words):
            self.rows, self.letters = np.concatenate([self.rows, np.zeros_like(self.rows)]), np.concatenate([self.letters, np.zeros_like(self.letters)])
        own = np.zeros((len(words), self.rows.shape[1]))
        if parts:
            np.add.at(own, owner, self.model.log_likelihoods(parts))
        self.rows[self.n : self.n + len(words)] = own
        has = np.zeros(len(words), dtype=bool)
        has[owner] = True
        self.letters[self.n : self.n + len(words)] = has
        self.known.update(zip(words, range(self.n, self.n + len(words))))
        self.n += len(words)

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors by language, tempered by the root of the number of words, and whether a text has a letter."""
        if self.n > self.cache:
            self.known, self.n = {}, 0
        split = [t.lower().split() for t in texts]
        missing: set[str] = set()
        for words in split:
            missing.update(words)
        missing.difference_update(self.known)
        if missing:
            self._learn(sorted(missing))
        sums, letters, get = np.zeros((len(texts), self.rows.shape[1])), np.zeros(len(texts), dtype=bool), self.known.__getitem__
        for k, words in enumerate(split):
            if words:
                at = np.fromiter(map(get, words), dtype=np.int64, count=len(words))
                own = self.letters[at]
                letters[k] = own.any()
                sums[k] = (self.rows[at].sum(axis=0) + self.prior) / np.sqrt(max(1, own.sum()))
        e = np.exp(sums - sums.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True), letters


def predict(docs: DataFrame, fitted: dict) -> DataFrame:
    """doc_id, lang_pred and score of each whole text.

    A null text, one without a letter, or any text under a model without languages is ``und`` with
    score 0; a null id stays null and repeated rows are scored each. The language is that of greatest likelihood times prior; equal ones go to the first in order. The score is
    that language's share once the logarithms of these products have been divided by the root of the number of words, so
    that words of one text, which depend on each other, don't make every score 1.
    """
    langs = fitted["langs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(fitted) if langs else None
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a in range(0, len(texts), 256):
                names, scores = ["und"] * len(texts[a : a + 256]), np.zeros(len(texts[a : a + 256]))
                if scorer:
                    posterior, letters = scorer.score(texts[a : a + 256])
                    best = posterior.argmax(axis=1)
                    names = [langs[b] if x else "und" for b, x in zip(best.tolist(), letters.tolist())]
                    scores = np.where(letters, posterior.max(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + 256], pa.int64()), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, lang_pred string, score double")
