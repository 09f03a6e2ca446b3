"""Tokenizer alignment, token files and importance resampling against brute force, round trips and odd inputs."""

import glob
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.llm import alignment, queries, resampling, segments, token_files

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONG = "word and more words\nthen 12 others, don't " * 9000
ODD = ["", " ", "\n", "  ", " \n", "\n\n x", "a ", "a  b\n\n\tc \n d", "x\ty\x0b z\x1c q \xa0 w\x85 e 　r", "don't WE'LL it's 's", "a▁b", "▁", "<|endoftext|> a<|endoftext|>b", "<s> <0x0A> </s>", "日本語 テスト 😀🏽 ½²x", "é à́ ǅ ﬁ ﷺ", "᠎ a​ b﻿ c", "\x00 a\x00b", "1,234.5 a1b2 x² ---\n---", "x" * 3000, LONG]


def _letters():
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


def plain_alignment(rows):
    """Every text encoded whole; ranges of bytes compared pair by pair as two pointers move on."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b, letters = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), _letters()
    a.encode_special_tokens = True
    done, counts = [], Counter()
    for doc_id, text in rows:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in a.id_to_token(k)) for k in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            done.append((doc_id, [], [], [], ""))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]), np.cumsum([len(x) for x in bytes_b])
        links, i, j, groups, at = [], 0, 0, [], (0, 0)
        while i < len(ids_a):
            links.append((ids_a[i], ids_b[j]))
            x, y = ends_a[i], ends_b[j]
            i, j = i + (x <= y), j + (y <= x)
            if x == y:
                groups.append(",".join(map(str, ids_a[at[0] : i])) + "|" + ",".join(map(str, ids_b[at[1] : j])))
                at = (i, j)
        counts.update(links)
        done.append((doc_id, ids_a, ids_b, links, ";".join(groups)))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return sorted(
        (doc_id, len(x), len(y), groups.count(";") + 1 if groups else 0, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        for doc_id, x, y, links, groups in done
    )


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(5)
    mixed = ["".join(rng.choice([" ", "\n", "  ", "\t", "a", "The", "'s", "é", "日", "12", "…", "▁", "x,", "\xa0", "ſ"]) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    rows = [(k, t) for k, t in enumerate(ODD + mixed)] + [(3, "\n"), (3, "same text"), (3, "same text"), (900, None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS block", "'x' AS seg", "2 AS n", "3 AS part", "4 AS bucket", "5 AS gain", "6 AS n_words")


def test_alignment_of_odd_texts(texts):
    rows, frame = texts
    for most, small in ((1 << 25, 1 << 20), (200, 0)):
        out = alignment.align(frame.repartition(3), A, B, most=most, small_pairs=small)
        assert out.columns == list(COLUMNS)
        assert sorted(tuple(r) for r in out.collect()) == plain_alignment(rows)


def test_alignment_query_equals_plain(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r[c] for c in COLUMNS) for r in queries.op11_tokenizer_alignment(spark, SF).collect()) == plain_alignment(rows)


def test_segments_add_up_and_vocabularies_split():
    assert alignment.vocabularies_split(A, B)
    for text in ODD[1:]:
        keys = [k for part in segments.stretches(text, 50) for k in segments.segment_keys(part)]
        assert "".join(map(segments.segment, keys)) == " " + text
        assert keys == segments.segment_keys(text)
    assert segments.segment_keys("a b") == ["a", "b"] and segments.segment_keys("a  b\nc") == ["a", "  b", "\nc"]


def test_byte_level_encoder_equals_tokenizer(texts):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(A)
    for cache in (10, 100_000):
        fast = segments.ByteLevelEncoder(A, cache=cache)
        for _, text in texts[0]:
            assert np.frombuffer(fast.encode(text or ""), "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids, repr(text)[:50]


def plain_files(rows):
    from tokenizers import Tokenizer

    plain, start, out = Tokenizer.from_file(A), 0, []
    for doc_id, text in sorted(rows):
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_query_round_trip(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in queries.op12_token_files(spark, SF).collect()) == plain_files(rows)


def test_token_files_of_odd_texts(spark, texts, tmp_path):
    rows, frame = texts
    path = f"{tmp_path}/odd"
    token_files.write_tokens(frame.unionByName(frame.limit(1).withColumn("doc_id", F.lit(None).cast("long"))), path, A, files=5)
    got = token_files.digest(token_files.read_tokens(spark, path)).collect()
    own = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in got}
    for doc_id, _, n, crc in plain_files([r for r in rows if r[0] != 3]):
        assert own[doc_id] == (n, crc)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == [sum(r.n_tokens for r in ordered[:k]) for k in range(len(ordered))]
    assert [r.doc_id for r in ordered] == sorted([r.doc_id for r in ordered], key=lambda d: -1 if d is None else d) and ordered[0].doc_id is None and len(ordered) == len(rows) + 1


def test_token_files_have_stripes_and_indexes(spark, tmp_path):
    from pyarrow import orc

    docs = spark.range(40_000).selectExpr("id * 3 AS doc_id", "concat('some words of text number ', id, ' and so on') AS text")
    path = f"{tmp_path}/tokens"
    token_files.write_tokens(docs, path, A, files=2, stripe_bytes=1 << 16, stride=1000)
    names = sorted(glob.glob(f"{path}/*.orc"))
    stored = [orc.ORCFile(n) for n in names]
    assert len(stored) == 2 and all(f.nstripes > 1 and f.row_index_stride == 1000 and str(f.compression).lower() == "zstd" for f in stored)
    found = token_files.read_tokens(spark, path, F.col("doc_id") == 60_000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,60000)" in plan.replace(" ", "")
    every = token_files.read_tokens(spark, path)
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in every.collect() if r.doc_id == 60_000]
    assert token_files.read_tokens(spark, path, F.col("doc_id") == 60_001).count() == 0  # an id between others
    blooms = lambda name: open(name, "rb").read()
    token_files.write_tokens(docs, f"{tmp_path}/loose", A, files=2, stripe_bytes=1 << 16, stride=1000, fpp=0.5)
    assert sum(len(blooms(n)) for n in names) > sum(len(blooms(n)) for n in glob.glob(f"{tmp_path}/loose/*.orc"))  # tighter Bloom filters are larger


def plain_resample(rows, target, percent=10, buckets=10_000, longest=1, least=20, seed=2024):
    def words(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in low).split(" ")

    def features(text):
        own = [w for w in words(text) if w]
        return len(own), [zlib.crc32(" ".join(own[k : k + n]).encode()) % buckets for n in range(1, longest + 1) for k in range(len(own) - n + 1)]

    docs = [(d, *features(t)) for d, t in rows]
    s, t = Counter(b for *_, f in docs for b in f), Counter(b for x in target for b in features(x)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (t_all[0] + buckets) / ((s[b] + 1.0) * (t_all[1] + buckets))))
    t_all = sum(s.values()), sum(t.values())
    out = []
    for d, n, own in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, own))
        out.append([d, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = {id(r): k + 1 for k, r in enumerate(fit[: percent * len(fit) // 100])}
    return sorted(((*r[:4], rank.get(id(r))) for r in out), key=repr)


def test_resampling_of_odd_texts(spark, texts):
    rows, frame = texts
    rows = rows + [(None, "No id but a text of some length " * 4), (5000, "\x7f{}|~`@[AZaz09]" * 30)]
    frame = frame.unionByName(spark.createDataFrame(rows[-2:], "doc_id long, text string"), allowMissingColumns=True)
    target = ["the same words and more words", None, "", "LONG words é É"]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    for options in ({}, {"longest": 3, "buckets": 50, "percent": 60, "least": 2, "seed": 7}):
        given = {{"least": "least_words"}.get(k, k): v for k, v in options.items()}
        got = resampling.resample(frame.repartition(3), goal, **given).select("doc_id", "n_features", "weight", "score", "rank")
        assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_resample(rows, target, **options)


def test_resampling_prefers_the_target(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["court", "law", "judge"] if k % 5 == 0 else ["goal", "ball", "team"]) for _ in range(30))) for k in range(400)]
    ranked = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("law court judge law",)], "text string")).where("rank IS NOT NULL").collect()
    assert len(ranked) == 40 and sum(r.doc_id % 5 == 0 for r in ranked) >= 39 and sorted(r["rank"] for r in ranked) == list(range(1, 41))


def test_resampling_stays_in_the_jvm(spark):
    docs, goal = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    gain = resampling.gains(docs, goal)
    plan = resampling.weights(docs, gain, 10_000, 1)._jdf.queryExecution().executedPlan().toString()
    assert gain.count() == 10_000 and "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


def test_empty_tables(spark, texts, tmp_path):
    none = texts[1].limit(0)
    assert alignment.align(none, A, B).count() == 0
    token_files.write_tokens(none, f"{tmp_path}/none", A)
    assert token_files.digest(token_files.read_tokens(spark, f"{tmp_path}/none")).count() == 0
    assert resampling.resample(none, none).count() == 0
    assert resampling.resample(texts[1], none).count() == texts[1].count()


def test_encoder_fills_its_cache_and_goes_on():
    """A text with more new segments than there is room for: the first ones are kept, and the ids are the tokenizer's."""
    import public_tokenizers

    from lodestar.llm.segments import ByteLevelEncoder

    encoder = ByteLevelEncoder(public_tokenizers.path("byte_bpe_50k.json"), cache=4)
    for text in ("one two, three (four) five six two, seven\n\n eight", "", " ", "two, nine's \u00e9t\u00e9 \u4e2d\u6587 one"):
        assert encoder.encode(text) == encoder.encode_whole(text)
    assert len(encoder.known) == 4


class Counted:
    """A tokenizer that counts the characters it gets."""

    def __init__(self, tokenizer):
        self.tokenizer, self.seen = tokenizer, 0

    def encode_batch_fast(self, texts, **options):
        self.seen += sum(map(len, texts))
        return self.tokenizer.encode_batch_fast(texts, **options)


@pytest.mark.parametrize("cache", [0, 3, 100_000])
def test_batches_of_odd_texts_equal_tokenizer(texts, cache):
    from tokenizers import Tokenizer

    plain, fast = Tokenizer.from_file(A), segments.ByteLevelEncoder(A, cache=cache)
    rows = [t for _, t in texts[0]]
    for batch in (rows, rows[:1], [], rows[::-1]):
        assert fast.encode_all(pa.array(batch, pa.string())).to_pylist() == [plain.encode(t or "", add_special_tokens=False).ids for t in batch]
    assert len(fast.known) <= cache


def test_tokenizer_gets_a_batch_of_missing_segments_once():
    """With a full cache, a segment that is in every text of a batch goes to the tokenizer once, not for each text."""
    fast = segments.ByteLevelEncoder(A, cache=0)
    counted = fast.tokenizer = Counted(fast.tokenizer)
    batch = [f"t {' '.join(f'word{k}, (x{k})' for k in range(50))}\n{n}" for n in range(300)]
    got = fast.encode_all(pa.array(batch)).to_pylist()
    assert got == [e.ids for e in counted.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
    assert counted.seen < 3000 < sum(map(len, batch)) / 50


def test_tokens_that_do_not_add_up_are_encoded_whole(tmp_path):
    """Normalised bytes, and a special token that spans segments."""
    from tokenizers import AddedToken, Tokenizer, normalizers

    batch = ["cafe\u0301 au lait", "stop here", "please stop", "here stop here", "no stop", " here"]
    for name, change in (("nfc", lambda t: setattr(t, "normalizer", normalizers.NFC())), ("spaced", lambda t: t.add_special_tokens([AddedToken("stop here", special=True)]))):
        plain = Tokenizer.from_file(A)
        change(plain)
        plain.save(f"{tmp_path}/{name}.json")
        fast = segments.ByteLevelEncoder(f"{tmp_path}/{name}.json")
        for _ in range(2):
            assert fast.encode_all(pa.array(batch)).to_pylist() == [plain.encode(t, add_special_tokens=False).ids for t in batch]


def test_token_files_gather_batches_and_cut_none(spark, tmp_path, monkeypatch):
    """Starts run on over the gathered batches of one file."""
    docs = spark.range(2500).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 1 + id % 7) AS text").coalesce(1)
    monkeypatch.setattr(token_files, "ENCODED", 30_000)
    token_files.write_tokens(docs, f"{tmp_path}/few", A, files=1)
    got = token_files.digest(token_files.read_tokens(spark, f"{tmp_path}/few")).collect()
    assert sorted(map(tuple, got)) == plain_files([tuple(r) for r in docs.collect()])


def test_encodings_held_at_once_are_bounded(monkeypatch):
    """Texts without spaces reach the tokenizer in small groups; empty texts reach it once."""
    fast = segments.ByteLevelEncoder(A)
    counted, most = Counted(fast.tokenizer), []
    fast.tokenizer = counted
    monkeypatch.setattr(counted, "encode_batch_fast", lambda texts, **o: most.append((len(texts), sum(map(len, texts)))) or counted.tokenizer.encode_batch_fast(texts, **o))
    batch = [chr(0x4E00 + k % 3000) * 400 for k in range(1000)]
    assert fast.encode_all(pa.array(batch)).to_pylist() == [e.ids for e in counted.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
    assert len(most) > 4 and max(n for _, n in most) <= segments._HELD + 400
    most.clear()
    assert fast.encode_all(pa.array([""] * 1000)).to_pylist() == [[]] * 1000
    assert sum(n for n, _ in most) <= 1


def test_long_texts_part_by_part(texts, monkeypatch):
    from tokenizers import Tokenizer

    plain, fast = Tokenizer.from_file(A), segments.ByteLevelEncoder(A)
    monkeypatch.setattr(segments, "_LONG", 20)
    rows = [t for _, t in texts[0] if t is None or len(t) < 10_000]
    for batch in (rows, [r for r in rows if r and len(r) > 20], rows[::-1]):
        assert fast.encode_all(pa.array(batch)).to_pylist() == [plain.encode(t or "", add_special_tokens=False).ids for t in batch]


def test_large_strings_encode_as_strings():
    fast, batch = segments.ByteLevelEncoder(A), ["one two", None, "", "a  b\n c"]
    assert fast.encode_all(pa.array(batch, pa.large_string())) == segments.ByteLevelEncoder(A).encode_all(pa.array(batch))
