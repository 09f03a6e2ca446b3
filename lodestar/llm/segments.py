"""Texts cut before white space where byte-level and piece vocabularies can't merge, and the tokens of the segments.

A segment is a run of white space that begins with a space or a line feed, and what follows up to the next such
run. The byte-level tokenizer's pattern never matches across the place before such a run, and looks ahead of
a match only where white space ends it; so the segments' tokens in turn are the text's.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import shared_folder
from .packing import _ALPHABET

#: White space before a space or a line feed: such texts have runs of white space.
_RUN = re.compile(r"\s[ \n]")
_SEGMENT = re.compile(r"[ \n]\s*\S*(?:[^\S \n]\s*\S*)*")
_BOUNDARY = re.compile(r"\S ")
#: White space as in the patterns above, for Arrow's regular expressions.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
#: Bytes of joined segments and of the longest segment worth keeping; characters of texts whose encodings (far larger than
#: their ids) are held at once, and of texts that are encoded part by part.
_CHUNK, _KEPT, _HELD, _LONG = 1 << 14, 32, 1 << 16, 1 << 22
#: Characters that the two patterns below class as the tokenizer does; the Latin letters are those from U+00C0 to U+024F.
_PLAIN = re.compile("[\n !-~\xc0-\xd6\xd8-\xf6\xf8-ɏ]+")
_PARTS = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ɏ]+|\s+(?!\S)|\s+")


def segment_keys(text: str) -> list[str]:
    """Keys of the segments of a space and ``text``: a segment without its space, if that stands alone.

    Keys that begin with a space or a line feed are the segments themselves.
    """
    if text[:1] not in (" ", "\n") and _RUN.search(text) is None:
        return text.replace("\n", " \n").split(" ")
    return [s[1:] if s[0] == " " and s[1:2] not in (" ", "\n") else s for s in _SEGMENT.findall(" " + text)]


def whole_key(text: str) -> list[str]:
    """One segment for the whole text, for vocabularies that merge across white space."""
    return [" " + text if text[:1] in (" ", "\n") else text]


def segment(key: str) -> str:
    return key if key[:1] in (" ", "\n") else " " + key


def stretches(text: str, most: int = 1 << 18) -> Iterator[str]:
    """Parts of a long text whose segments in turn are the text's; a space that begins a part is left out."""
    at = 0
    while len(text) - at > most:
        found = _BOUNDARY.search(text, at + most)
        if not found:
            break
        yield text[at : found.start() + 1]
        at = found.end()
    yield text[at:]


def _letters(part: str) -> str:
    return part.encode().decode("latin-1").translate(_ALPHABET)


class Codes(dict):
    """What ``make`` gives for a key, kept for the first ``limit`` keys."""

    def __init__(self, make: Callable[[str], bytes], limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key: str) -> bytes:
        got = self.make(key)
        if len(self) < self.limit:
            self[key] = got
        return got


class ByteLevelEncoder:
    """Ids of texts by a byte-level tokenizer that sees each segment once while the cache has room.

    The distinct segments of a batch of texts are looked up among the first ``cache`` ones of up to 32 bytes, and the
    tokenizer gets the others joined: they begin with white space, so their tokens in turn are those of each alone, and
    the tokens' bytes tell where each ends. A segment that ends in white space ends what is joined. A text's first segment,
    which has no space before it, and a text with a special token's string (with ``specials``) go to the tokenizer by
    themselves. Where the bytes of tokens don't add up to the texts' bytes, texts are encoded whole.

    ``encode_segment`` serves single segments: those of ASCII and Latin letters are cut into pre-tokens, each of which the
    tokenizer's model encodes, and the first ``cache // 8`` pre-tokens stay in memory.
    """

    def __init__(self, path: str, specials: bool = True, cache: int = 640_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not specials
        added = {k: t.content for k, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.specials = re.compile("|".join(map(re.escape, added.values()))) if specials and added else None
        self.parts = Codes(self._part, cache // 8)
        self.cache, self.chunk = cache, 1 if any(re.search(r"\s", t) for t in added.values()) else _CHUNK
        sizes = {k: len(t) for t, k in self.tokenizer.get_vocab().items()} | {k: len(t.encode()) for k, t in added.items()}
        self.sizes = np.zeros(max(sizes, default=0) + 1, dtype=np.int32)
        self.sizes[list(sizes)] = list(sizes.values())
        self.known, self.codes = pa.array([], pa.string()), pa.array([], pa.list_(pa.int32()))

    def _part(self, part: str) -> bytes:
        return b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(_letters(part))])

    def encode_segment(self, text: str) -> bytes:
        """Ids of text that begins and ends where segments do."""
        if _PLAIN.fullmatch(text):
            found, parts = _PARTS.findall(text), self.parts
            return b"".join([parts[part] for part in found]) if len(found) > 1 else b"".join(map(self._part, found))
        return self.encode_whole(text)

    def encode_whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text])).values.to_numpy().astype("<u4", copy=False).tobytes()

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = [np.zeros(0, dtype=np.int32)]
        for _, some in groupby(zip(accumulate(map(len, texts)), texts), lambda x: x[0] // _HELD):
            coded += [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast([t for _, t in some], add_special_tokens=False)]
        return np.concatenate(coded), np.cumsum([len(c) for c in coded])

    def _keys(self, texts: pa.StringArray) -> pa.ListArray:
        """Each text's head, as a key, and its segments' keys; texts with runs of white space are cut one by one."""
        keys = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        odd = pc.match_substring_regex(texts, rf"{_SPACE}[ \n]").to_numpy(zero_copy_only=False)
        whole = np.array([bool(self.specials.search(t)) for t in texts.to_pylist()], dtype=bool) if self.specials else np.zeros(len(texts), dtype=bool)
        at = np.flatnonzero(odd | whole)
        if not len(at):
            return keys
        cut = []
        for k, text in zip(at.tolist(), texts.take(pa.array(at)).to_pylist()):
            lists = [whole_key(text)] if whole[k] else map(segment_keys, stretches(text))
            cut.append(pa.concat_arrays([pa.array(x, pa.string()) for x in lists]))
        own = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, cut)]), pa.int32()), pa.concat_arrays(cut))
        order = np.arange(len(texts))
        order[at] = len(texts) + np.arange(len(at))
        return pa.concat_arrays([keys, own]).take(pa.array(order))

    def _fresh(self, keys: pa.StringArray, heads: list[str]) -> pa.ListArray | None:
        """Ids of the keys' segments and of the heads; none if tokens don't end where those do."""
        segs = pc.if_else(pc.match_substring_regex(keys, r"\A[ \n]"), keys, pc.binary_join_element_wise("", keys, " "))
        ends = np.cumsum(pc.binary_length(segs).to_numpy(), dtype=np.int64)
        data = "".join(segs.to_pylist()).encode()
        last = pc.match_substring_regex(segs, rf"{_SPACE}\z").to_numpy(zero_copy_only=False).copy()
        last |= np.diff(ends // self.chunk, prepend=0) > 0
        cuts = np.unique([0, *ends[last].tolist(), len(data)]).tolist()
        joined = [data[a:b].decode() for a, b in zip(cuts, cuts[1:])]
        ids, at = self._ids(joined + heads)
        ends = np.append(ends, len(data) + np.cumsum([len(h.encode()) for h in heads], dtype=np.int64))
        reached = np.zeros(len(ids) + 1, dtype=np.int32)
        np.cumsum(self.sizes[ids], out=reached[1:])
        marks = np.append(np.searchsorted(reached, ends[: len(keys)].astype(np.int32)), at[len(joined) + 1 :]).clip(max=len(ids))
        if (reached[marks] != ends).any():
            return None
        return pa.ListArray.from_arrays(pa.array(np.append(0, marks), pa.int32()), pa.array(ids))

    def _batch(self, texts: pa.StringArray) -> pa.ListArray:
        keys = self._keys(texts)
        at, flat = keys.offsets.to_numpy(), keys.flatten()
        inner = np.ones(len(flat), dtype=bool)
        inner[at[:-1]] = False
        heads, drawn = flat.filter(pa.array(~inner)).dictionary_encode(), flat.filter(pa.array(inner)).dictionary_encode()
        found = pc.index_in(drawn.dictionary, value_set=self.known)
        new = found.is_null()
        missed = drawn.dictionary.filter(new)
        fresh = self._fresh(missed, [segment(k)[1:] for k in heads.dictionary.to_pylist()])
        if fresh is None:
            ids, ends = self._ids(texts.to_pylist())
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
        place = pc.fill_null(found, 0).to_numpy().copy()
        place[new.to_numpy(zero_copy_only=False)] = len(self.known) + np.arange(len(missed))
        code = np.empty(len(flat), dtype=np.int32)
        code[inner] = place[drawn.indices.to_numpy()]
        code[~inner] = len(self.known) + len(missed) + heads.indices.to_numpy()
        ids = pa.concat_arrays([self.codes, fresh]).take(pa.array(code))
        keep = pa.array(np.flatnonzero(pc.binary_length(missed).to_numpy() <= _KEPT)[: self.cache - len(self.known)])
        if len(keep):
            self.known, self.codes = pa.concat_arrays([self.known, missed.take(keep)]), pa.concat_arrays([self.codes, fresh.take(keep)])
        return pa.ListArray.from_arrays(pa.array(ids.offsets.to_numpy()[at]), ids.values)

    def _long(self, text: str) -> np.ndarray:
        if self.specials and self.specials.search(text):
            return self._ids([text])[0]
        parts = (" " * (k > 0) + part for k, part in enumerate(stretches(text, _LONG)))
        return np.concatenate([self._batch(pa.array([part])).values.to_numpy() for part in parts])

    def encode_all(self, texts: pa.StringArray) -> pa.ListArray:
        """Ids of each text; a null has none. Of a long text, one part at a time is cut into segments."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        long = np.flatnonzero(pc.utf8_length(texts).to_numpy() > _LONG).tolist()
        if not long:
            return self._batch(texts)
        values, sizes = [], []
        for a, b in zip([0, *(k + 1 for k in long)], [*long, len(texts)]):
            coded = self._batch(texts[a:b])
            values.append(coded.values.to_numpy())
            sizes.append(np.diff(coded.offsets.to_numpy()))
            if b < len(texts):
                values.append(self._long(texts[b].as_py()))
                sizes.append([len(values[-1])])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate([[0], *sizes])), pa.int32()), pa.array(np.concatenate(values)))


@lru_cache(maxsize=2)
def encoder(path: str, specials: bool) -> ByteLevelEncoder:
    """A worker's encoder, kept for its next tasks."""
    return ByteLevelEncoder(path, specials)


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's name under the shared one; who asks for it owns what is written there."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as read back from Parquet at ``path``: computed once, and lineage ends there."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)
