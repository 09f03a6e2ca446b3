"""Vectorised word and shingle hashes of whole texts, on NumPy arrays."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_FOLD = np.uint64(0xC2B2AE3D27D4EB4F)
#: Word bytes: ASCII letters and digits, and all of the bytes of other characters.
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STATE: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * _MIX
        x = (x ^ (x >> np.uint64(29))) * _FOLD
        return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _STATE or len(_STATE["up"]) < n:
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
                _STATE[name] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base, dtype=np.uint64)]), dtype=np.uint64)
    return _STATE["up"], _STATE["down"]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words in UTF-8 bytes."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _WORD[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of a text's words, in order and without regard to case."""
    data = np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8)
    begin, end = word_spans(data)
    if not len(begin):
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(len(data))
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
        return mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def shingle_hashes(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of runs of ``width`` words; a shorter text with a word is one shingle."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * _FOLD + words[k : k + n]
    return mix(out)


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Shingle hashes made distinct by the number of earlier occurrences."""
    order = np.argsort(shingles, kind="stable")
    ranked = shingles[order]
    new = np.ones(len(ranked), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if new.all():
        return shingles
    at = np.arange(len(ranked))
    occurrence = np.empty(len(ranked), dtype=np.uint64)
    occurrence[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    with np.errstate(over="ignore"):
        return np.where(occurrence > 0, mix(shingles + occurrence * _BASE_STEP), shingles)


_BASE_STEP = np.uint64(0x165667B19E3779F9)
