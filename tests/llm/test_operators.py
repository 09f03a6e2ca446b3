"""Corpus operators against brute force, exact round trips, held-out labels and odd inputs."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestar.llm import components, decontamination, language_id, license_scan, line_dedup, order_minhash, packing, quality_classifier, quality_rules, queries, suffix_dedup, toxicity
from lodestar.llm.common import held_out

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TOKENS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, tiny and very long texts, ties, repeats, odd characters and columns."""
    long = "word " * 60_000
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "   \n\n ", "en", "s", 6), (4, "a", "en", "s", 1), (5, long, "en", "s", len(long)), (6, "same text here", "en", "s", 5), (7, "same text here", "en", None, 5), (7, "same text here", "en", None, 5), (8, "é 日本 \x0b 😀 1²", "fr", "s", 9), (None, "no id at all", "en", "s", 3)]
    frame = spark.createDataFrame(rows, DOCS)
    return frame.selectExpr("*", "1 AS score", "'x' AS `_drop`", "2 AS key", "3 AS tid", "'h' AS host", "4 AS n", "5 AS doc")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_every_query_runs(spark):
    for name, query in queries.QUERIES.items():
        out = query(spark, SF)
        assert out.limit(1).count() == 1, name


def test_odd_inputs(spark, odd):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (6, 1, 0), (7, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "word word word word word word"), (2, None), (3, ""), (None, "x")], "item_id long, text string")
    everything = F.lit(True)
    packed = packing.pack_documents(odd, TOKENS).toPandas()
    assert packed[packed.doc_id == 1].length.tolist() == [1] and packed.doc_id.isna().sum() == 1
    assert {r.lang_pred for r in language_id.predict(odd, language_id.fit(odd, everything, PIECES)).where("doc_id in (1, 2, 3)").collect()} == {"und"}
    assert line_dedup.dedup_lines(odd).count() == 10
    assert license_scan.scan(odd).count() == 0
    assert quality_rules.apply_rules(odd).where("kept").count() == 0
    assert quality_classifier.score(odd, quality_classifier.fit(odd, labels, everything)).where("score between 0 and 1").count() == 10
    assert toxicity.score(odd, toxicity.fit(odd, labels, everything)).where("score between 0 and 1").count() == 10
    assert {r.doc_id for r in decontamination.find_leaks(odd, bench).collect()} == {5}
    assert decontamination.drop_leaking(odd, bench).count() == 9
    removed = {r.doc_id: r for r in suffix_dedup.remove_repeats(odd).collect()}
    assert removed[5].n_removed == 300_000 - 5 and removed[1].n_bytes == 0
    classes = {r.doc_id: r.class_id for r in order_minhash.near_duplicate_classes(odd).collect()}
    assert classes[None] is None and classes[6] == classes[7] == 6 and classes[1] == 1 and classes[2] == 2


def test_empty_tables(spark, docs, odd):
    none, labels = odd.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    learn = F.lit(True)
    for out in (
        packing.pack_documents(none, TOKENS),
        language_id.predict(none, language_id.fit(none, learn, PIECES)),
        line_dedup.dedup_lines(none),
        license_scan.scan(none),
        quality_rules.apply_rules(none),
        quality_classifier.score(none, quality_classifier.fit(none, labels, learn)),
        toxicity.score(none, toxicity.fit(none, labels, learn)),
        decontamination.find_leaks(none, bench),
        suffix_dedup.remove_repeats(none),
        order_minhash.near_duplicate_classes(none),
    ):
        assert out.count() == 0
    assert decontamination.find_leaks(docs, bench).count() == 0
    assert language_id.predict(docs, language_id.fit(none, learn, PIECES)).where("lang_pred <> 'und'").count() == 0


def test_word_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    plain, fast, rng = Tokenizer.from_file(TOKENS), packing.WordEncoder(TOKENS, cache=300), random.Random(3)
    texts = ["", "don't WE'LL İstanbul ß ǅ ŉ µm ªº 2½³ x²", "<|endoftext|> a<|startoftext|>b", "日本語 テスト　全角", "a\x0bb\x0cc\x85d e\xa0f \x1cq\x1d"]
    texts += ["".join(rng.choice(" \t\n'sdltvéİßǅ\xadaA1²ªʼn<|>") for _ in range(rng.randint(1, 30))) for _ in range(2000)]
    for a in range(0, len(texts), 50):
        for text, ids in zip(texts[a : a + 50], fast.encode(texts[a : a + 50])):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


def test_word_encoder_tells_words_apart():
    """Words whose polynomial hashes modulo 2**64 agree, long words, and a text in parts."""
    from tokenizers import Tokenizer

    plain, fast = Tokenizer.from_file(TOKENS), packing.WordEncoder(TOKENS, cache=50)
    thue = "".join("ab"[bin(k).count("1") % 2] for k in range(4096))
    texts = [thue, thue.translate(str.maketrans("ab", "ba")), "x" * 16, "x" * 17, "a\0", "a", "a\0\0 b", "É é ÉCOLE école", "AbC abc", "<|STARTOFTEXT|> <|startoftext|>"]
    for own in (texts, texts[::-1]):
        for text, ids in zip(own, fast.encode(own)):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text[:20])
    long = "ab cd\n" * 50_000
    assert fast.encode_long(long, most=1000).tolist() == plain.encode(long, add_special_tokens=False).ids


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(TOKENS)
    rows = packing.pack_documents(docs, TOKENS, capacity=512).toPandas()
    ids = {d: [*plain.encode(t, add_special_tokens=False).ids, 1] for d, t in docs.select("doc_id", "text").collect()}
    for r in rows.itertuples():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    assert rows.groupby("doc_id").length.sum().to_dict() == {d: len(x) for d, x in ids.items()}
    ordered = rows.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    assert ordered.groupby("sequence_id").length.sum().max() <= 512
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 512) * 1.01 + 1


def test_best_fit_is_tight():
    rng = random.Random(1)
    sizes = [rng.randint(1, 100) for _ in range(500)]
    bins = packing.best_fit(sizes, 100)
    assert sorted(k for b in bins for k in b) == list(range(500)) and max(sum(sizes[k] for k in b) for b in bins) <= 100
    assert len(bins) <= sum(sizes) / 100 * 1.02 + 1


def test_best_fit_of_counts_equals_best_fit():
    rng = random.Random(8)
    for _ in range(50):
        sizes = [rng.choice([rng.randint(1, 100), 30, 7]) for _ in range(rng.randint(0, 400))]
        counts = {s: sizes.count(s) for s in sizes}
        bins, seen = {}, {}
        for size, first, n, at, each in packing.best_fit_counts(counts, 100).tolist():
            assert first == seen.get(size, 0)
            seen[size] = first + n
            for k in range(n):
                bins.setdefault(at + k // each, []).append(size)
        assert seen == counts and sorted(bins) == list(range(len(bins)))
        assert max(map(sum, bins.values()), default=0) <= 100 and len(bins) == len(packing.best_fit(sizes, 100))


def test_packing_of_many_underfull_bins(spark):
    """Partitions of one length each, with more underfull bins than a task could once pass on."""
    parts = [spark.range(k * 9000, (k + 1) * 9000, 1, 2).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", f"{n}L AS length", "0L AS ids_crc32") for k, n in enumerate((2500, 1500))]
    rows = packing.pack(parts[0].unionByName(parts[1])).toPandas()
    assert len(rows) == rows.doc_id.nunique() == 18_000 and rows.sequence_id.nunique() == 9000
    assert rows.groupby("sequence_id").length.sum().max() == 4000
    ordered = rows.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()


def test_language_forward_sums_all_segmentations():
    model = language_id.PieceModel(["▁", "▁a", "a", "b", "ab", "▁ab"], np.array([[0.1], [0.2], [0.15], [0.25], [0.2], [0.1]]), np.array([0.0]))
    expected = 0.1 + 0.2 * 0.25 + 0.1 * 0.15 * 0.25 + 0.1 * 0.2
    assert np.exp(model.log_likelihoods(["▁ab"])[0, 0]) == pytest.approx(expected)
    uses, unknown = model.expected(["▁ab"], np.array([[1.0]]))
    assert (uses[:, 0] @ np.array([1, 2, 1, 1, 2, 3])) == pytest.approx(3) and unknown[0] == 0


def test_language_likelihoods_equal_plain_sums():
    """Words of all lengths, long ones too, against a sum over segmentations in logarithms."""
    rng = random.Random(17)
    pieces = sorted({"▁", *(rng.choice(["", "▁"]) + "".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(60))})
    model = language_id.PieceModel(pieces, np.random.default_rng(2).random((len(pieces), 3)) / 40, np.array([1e-6, 1e-5, 1e-7]))
    words = ["▁" + "".join(rng.choice("abcd") for _ in range(n)) for n in (1, 2, 3, 5, 9, 14, 24, 25, 64, 65, 300, 2000)]
    number = {x: k for k, x in enumerate(pieces)}
    for word, row in zip(words, model.log_likelihoods(words)):
        logs = [np.zeros(3)]
        for end in range(1, len(word) + 1):
            terms = [logs[-1] + np.log(model.unknown)]
            terms += [logs[end - m] + np.log(model.probabilities[number[word[end - m : end]]]) for m in range(1, min(end, 5) + 1) if word[end - m : end] in number]
            logs.append(np.logaddexp.reduce(terms))
        assert np.allclose(row, logs[-1], rtol=1e-9), len(word)


def test_language_query_equals_plain_scores(spark, docs):
    """Predictions of the operator against likelihoods added up word by word."""
    fitted = language_id.fit(docs, ~held_out(F.col("doc_id"), 4, 2), PIECES)
    model = language_id.PieceModel(fitted["pieces"], fitted["probabilities"], fitted["unknown"])
    got = {r.doc_id: r for r in language_id.predict(docs, fitted).collect()}
    for r in docs.orderBy("doc_id").limit(40).collect():
        parts = [["▁" + x for x in language_id.word_parts(w)] for w in r.text.lower().split()]
        n = sum(bool(x) for x in parts)
        posterior = sum((model.log_likelihoods(x).sum(axis=0) for x in parts if x), np.zeros(len(fitted["langs"]))) + fitted["prior"]
        z = posterior / np.sqrt(max(1, n))
        best = np.exp(z - z.max())
        assert got[r.doc_id].lang_pred == (fitted["langs"][int(posterior.argmax())] if n else "und")
        assert got[r.doc_id].score == pytest.approx(float((best / best.sum()).max()) if n else 0.0)


def test_language_evidence_beats_a_rare_languages_prior(spark):
    """100 words that are each e**0.5 times likelier in a language of one text in a thousand: 50 - 6.9 for that language."""
    pieces = ["▁", "a"]
    fitted = {"langs": ["common", "rare"], "pieces": pieces, "probabilities": np.array([[0.1, 0.1], [0.01, 0.01 * np.exp(0.5)]]), "unknown": np.array([1e-9, 1e-9]), "prior": np.log([0.999, 0.001])}
    asked = spark.createDataFrame([(1, "a " * 100), (2, "a " * 5)], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.predict(asked, fitted).collect()}
    assert got[1].lang_pred == "rare" and got[1].score == pytest.approx(1 / (1 + np.exp(-(50 + np.log(0.001 / 0.999)) / 10)))
    assert got[2].lang_pred == "common" and 0.5 < got[2].score < 1


def test_language_of_signs_and_rare_languages(spark):
    rows = [(k, "the cat and the dog went to the house", "en") for k in range(3000)] + [(5000 + k, "der hund und die katze gehen ins haus", "de") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fitted = language_id.fit(docs, F.lit(True), PIECES, most_docs=50)
    asked = spark.createDataFrame([(1, "½ ² ① Ⅷ 42 _"), (2, "die katze und der hund"), (3, "x" * 5000), (None, "the dog")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language_id.predict(asked, fitted).collect()}
    assert got[1] == "und" and got[2] == "de" and got[3] in ("de", "en") and got[None] == "en"


def test_quality_risk_and_prior():
    rng = np.random.default_rng(3)
    p, u, w = rng.normal(size=(40, 4)), rng.normal(size=(90, 4)), rng.normal(size=4)
    for prior in (0.2, 0.9):
        risk, grad = quality_classifier.nnpu_risk(w, p, u, prior)
        loss = lambda x, y: np.array([np.log1p(np.exp(-y * (r @ w))) for r in x]).mean()  # noqa: B023, E731
        negative = loss(u, -1) - prior * loss(p, -1)
        assert risk == pytest.approx(prior * loss(p, 1) + max(0, negative))
        if negative > 0.01:
            steps = [(quality_classifier.nnpu_risk(w + d, p, u, prior)[0] - quality_classifier.nnpu_risk(w - d, p, u, prior)[0]) / 2e-6 for d in np.eye(4) * 1e-6]
            assert np.allclose(grad, steps, atol=1e-5)
    for share in (0.3, 0.7):
        positive = rng.normal(2, 1, (4000, 3))
        mixed = np.where(rng.random((6000, 1)) < share, rng.normal(2, 1, (6000, 3)), rng.normal(-2, 1, (6000, 3)))
        assert quality_classifier.estimate_prior(positive, mixed) == pytest.approx(share, abs=0.06)


def test_quality_query_equals_plain_scores(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_classifier.fit(docs, labels, ~held_out(F.col("doc_id"), 3, 1))
    w, mean, scale = model["model"]
    got = {r.doc_id: r.score for r in quality_classifier.score(docs, model).collect()}
    kept = {r.doc_id for r in quality_classifier.keep_quality(docs, model).collect()}
    for r in docs.collect():
        z = sum(a * min(8.0, max(-8.0, (x - m) / s)) for a, x, m, s in zip(w[:-1], quality_classifier.features(r.text), mean, scale)) + w[-1]
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-z))) and (r.doc_id in kept) == (got[r.doc_id] >= 0.5)


def test_suffix_dedup_of_repeated_ids(spark):
    """Texts of one id are parts of one document, in the order of a hash; nothing else is cut."""
    rng = random.Random(8)
    shared, tails = prose(rng, 40), [prose(rng, 30) for _ in range(4)]
    rows = [(7, shared + tails[0]), (7, tails[1] + shared), (7, shared + tails[0]), (9, "new " + shared), (3, tails[2]), (None, shared)]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    size = len(shared.encode())
    seven = sorted(r.n_removed for r in out if r.doc_id == 7)
    assert seven in ([0, 0, size], [0, size, size])
    assert [r.n_removed for r in out if r.doc_id == 9] == [size] and [r.n_removed for r in out if r.doc_id in (3, None)] == [0, 0]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    lang = queries.op2_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert lang > 0.98
    for name, column, least in (("op10_quality_classifier", "quality", 0.95), ("op6_toxicity", "toxic", 0.9)):
        rows = queries.QUERIES[name](spark, sf).join(labels, "doc_id").where("held_out")
        assert rows.agg(F.avg((F.col("predicted") == F.col(column)).cast("int"))).first()[0] > least, name


def test_block_max_neighbours_are_exact():
    rng = np.random.default_rng(5)

    def vector(most):
        terms = np.unique(rng.integers(0, 40 if rng.random() < 0.7 else 4000, rng.integers(1, most)))
        weights = rng.random(len(terms)) + 0.1
        return terms, weights / np.linalg.norm(weights)

    rows = [vector(30) for _ in range(700)]
    index, dense = toxicity.Index(rows, rng.integers(0, 2, 700), 4000), np.zeros((700, 4000))
    for k, at in enumerate(index.order.tolist()):
        dense[k, rows[at][0]] = rows[at][1]
    for k in range(100):
        terms, weights = vector(30)
        exact = dense[:, terms] @ weights
        skip = int(np.argmax(exact)) if k % 2 else -1
        if skip >= 0:
            exact[skip] = -1
        at, cosine = index.nearest([vector(5), (terms, weights)], 7, [-1, skip])[1] if skip >= 0 else index.nearest([(terms, weights)], 7)[0]
        assert np.allclose(cosine, np.sort(exact)[::-1][:7], atol=1e-5) and np.allclose(exact[at], cosine, atol=1e-5)


def test_toxicity_equals_brute_force(spark):
    """Scores and evidence of the whole operator against plain cosines of all terms with all examples."""
    rng, bad = random.Random(21), ["vile", "nasty", "horrid"]
    texts = [" ".join([*prose(rng, rng.randint(5, 40)).split(), *(rng.sample(bad, 2) if k % 4 == 0 else [])]) for k in range(160)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(120)], "doc_id int, toxic int")
    fitted = toxicity.fit(docs, labels, F.lit(True), most=100_000)
    held = [toxicity.text_terms(t) for t in texts]
    shared = fitted["shared"].value
    seen = {t: (sum(t in h for h in held[:120]), sum(t in h for h in held[:120:4])) for t in set().union(*held[:120])}
    lean = {t: toxicity._lean(np.array([n - b]), np.array([b]), 90, 30)[0] for t, (n, b) in seen.items()}
    assert shared["terms"] == sorted(t for t, (n, _) in seen.items() if n > 1 and (t[-1] != "*" or lean[t] > 0))
    from collections import Counter

    idf = {t: np.log(161 / (sum(t in h for h in held) + 1)) + 1 for t in shared["terms"]}
    assert all(0.3 * idf[t] - 1e-9 <= w <= idf[t] + 1e-9 for t, w in zip(shared["terms"], shared["weights"]))
    weights = dict(zip(shared["terms"], shared["weights"]))

    def vector(text):
        counts = Counter(t for w in text.lower().split() for t in set(toxicity.word_terms(w)) if t in weights)
        own = {t: (1 + np.log(n)) * weights[t] for t, n in counts.items()}
        size = np.sqrt(sum(w * w for w in own.values()))
        return {t: w / size for t, w in own.items()}

    vectors = [vector(t) for t in texts]
    for r in toxicity.score(docs, fitted).collect():
        if not vectors[r.doc_id]:
            assert not r.evidence
            continue
        cosines = sorted((sum(w * vectors[k].get(t, 0) for t, w in vectors[r.doc_id].items()) for k in range(120)), reverse=True)
        assert np.allclose([e.cosine for e in r.evidence], cosines[:3], atol=1e-5)
        near = sorted(range(120), key=lambda k: -sum(w * vectors[k].get(t, 0) for t, w in vectors[r.doc_id].items()))[:15]
        raw = toxicity.vote(np.array([float(k % 4 == 0) for k in near]), np.array(cosines[:15]))
        assert abs(cosines[14] - cosines[15]) < 1e-5 or r.score == pytest.approx(float(np.interp(raw, fitted["cal_x"], fitted["cal_y"])), abs=1e-3)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(40):
        base = prose(rng, rng.randint(30, 200)).split()
        for _ in range(rng.randint(1, 5)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 8])):
                own[rng.randrange(len(own))] = prose(rng, 1)
            texts.append(" ".join(own))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicate_classes(rows).collect()}
    seq = [order_minhash._sequence(t) for t in texts]
    edges = [(a, b) for b in range(len(texts)) for a in range(b) if order_minhash.aligned(seq[a], seq[b]) >= 0.8]
    roots = dict(components.forest(edges))
    assert got == {k: roots.get(k, k) for k in range(len(texts))}
    kept = {r.doc_id for r in order_minhash.drop_near_duplicates(rows).collect()}
    assert kept == set(got.values())


def test_near_duplicates_of_a_star(spark):
    """Versions that are near to their original alone share its buckets with each other."""
    rng = random.Random(11)
    base = prose(rng, 200).split()
    texts = [" ".join(base)]
    for k in range(400):
        own = list(base)
        for at in range(rng.randrange(5, 45), 200, 50):
            own[at] = f"v{k}x{at}"
        texts.append(" ".join(own))
    seq = [order_minhash._sequence(t) for t in texts]
    assert all(order_minhash.aligned(seq[0], s) >= 0.8 for s in seq)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.class_id for r in order_minhash.near_duplicate_classes(rows).collect()} == {0}


@pytest.mark.parametrize("block", [4, 512])
def test_near_duplicates_in_a_large_bucket(spark, block):
    """Edited copies of one text, of which some are near to many, to few or to none, in blocks of one bucket."""
    rng, base = random.Random(12), prose(random.Random(3), 150).split()
    texts = []
    for k in range(60):
        own = list(base)
        for at in rng.sample(range(150), rng.randint(0, 9)):
            own[at] = f"v{k}x{at}"
        texts.append(" ".join(own))
    seq = [order_minhash._sequence(t) for t in texts]
    edges = [(a, b) for b in range(60) for a in range(b) if order_minhash.aligned(seq[a], seq[b]) >= 0.8]
    roots = dict(components.forest(edges))
    want = {k: roots.get(k, k) for k in range(60)}
    assert 5 < len(set(want.values())) < 50
    sequences = spark.createDataFrame([(k, (s >> np.uint64(32)).astype(np.uint32).tobytes()) for k, s in enumerate(seq)], "vid long, seq binary")
    known = [(7, k, len(s), 0 if want[k] == 0 and k % 2 else k) for k, s in enumerate(seq)]
    rows = spark.createDataFrame(known, "key long, vid long, n int, root long")
    found = [tuple(r) for r in order_minhash._all_links(rows, sequences, 0.8, block=block).collect()]
    assert set(found) <= set(edges) and len(found) < 60 * (1 if block == 512 else 15)
    joined = dict(components.forest([*found, *[(r, k) for _, k, _, r in known if r != k]]))
    assert {k: joined.get(k, k) for k in range(60)} == want
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in order_minhash.near_duplicate_classes(docs).collect()} == want


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    base = prose(random.Random(5), 60)
    rows = [(1, base), (1, "other words of a text that is not near to any"), (3, base + " end"), (1, base), (None, base), (4, None), (4, None), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS tid", "2 AS _doc", "3 AS keep")
    got = sorted(((r.doc_id or 0, r.class_id) for r in order_minhash.near_duplicate_classes(docs).collect()), key=str)
    assert got == [(0, None), (1, 1), (1, 1), (1, 1), (3, 1), (4, 4), (4, 4), (5, 5)]
    kept = sorted(((r.doc_id or 0, (r.text or "")[:5]) for r in order_minhash.drop_near_duplicates(docs).collect()))
    assert kept == [(0, base[:5]), (1, base[:5]), (1, "other"), (4, ""), (5, "")]


def test_near_duplicates_of_short_texts(spark):
    """Texts of 1 to 45 shingles and copies with a word more, less or changed, against brute force."""
    from math import comb

    rng, texts = random.Random(13), []
    for k in range(240):
        base = prose(rng, 5 + k % 45).split()
        texts += [" ".join(base), " ".join([*base, "zz"]) if k % 2 else " ".join([*base[:-1], *["yy"] * (k % 3)])]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicate_classes(rows).collect()}
    seq = [order_minhash._sequence(t) for t in texts]
    edges = [(a, b) for b in range(len(texts)) for a in range(b) if order_minhash.aligned(seq[a], seq[b]) >= 0.8]
    roots = dict(components.forest(edges))
    assert got == {k: roots.get(k, k) for k in range(len(texts))} and len(edges) > 100
    for n in range(order_minhash.EXACT + 1, 300):
        for m in range(n, int(n / 0.8 + 1e-9) + 1):
            i = int(np.ceil(0.8 * (n + m) / 1.8 - 1e-9))
            p = comb(i, 5) / comb(n + m - i, 5)
            assert sum(comb(40, k) * p**k * (1 - p) ** (40 - k) for k in range(order_minhash.AGREE)) < 1e-5, (n, m)


def test_components_in_many_partitions(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)]
    spread = spark.createDataFrame([e for e in edges if e[0] != e[1]], "u long, v long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.doc: r.root for r in components.components(spread, one_task=0).collect()}
        assert got == {r.doc: r.root for r in components.components(spread).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    roots = dict(components.forest(edges))
    assert got == {x: roots.get(x, x) for e in edges if e[0] != e[1] for x in e}


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(4)
    items = [(k, prose(rng, rng.randint(8, 40))) for k in range(12)]
    rows = []
    for k in range(40):
        words = prose(rng, rng.randint(5, 120)).split()
        if k % 2:
            own = items[k % 12][1].split()
            for _ in range(rng.choice([0, 0, 1, 3])):
                own[rng.randrange(len(own))] = "zz"
            at = rng.randrange(len(words))
            words[at:at] = own
        rows.append((k, " ".join(words)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontamination.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    from collections import Counter

    grams = lambda w: Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    want = {}
    for d, text in rows:
        words = text.split()
        for i, item in items:
            n, own = len(item.split()), grams(item.split())
            best = max((decontamination.weighted_similarity(grams(words[a : a + n]), own) for a in range(len(words) - n + 1)), default=0)
            if best >= 0.8:
                want[d, i] = round(best, 9)
    assert got == want and want


def test_decontamination_of_documents_shorter_than_an_item(spark):
    rng = random.Random(14)
    items = [(k, prose(rng, rng.randint(30, 60))) for k in range(12)]
    rows, want = [], {}
    for k, (item_id, item) in enumerate(items):
        words = item.split()
        for cut in (1, 3, len(words) // 2):
            own, doc_id = words[cut:] if k % 2 else words[:-cut], len(rows)
            rows.append((doc_id, " ".join(own)))
            similarity = (len(own) - 4) / (len(words) - 4)
            if similarity >= 0.8:
                want[doc_id, item_id] = (round(similarity, 9), 0, len(own))
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.first_word, r.n_words) for r in decontamination.find_leaks(docs, bench).collect()}
    assert got == want and len(want) == 24
    assert {r.doc_id for r in decontamination.drop_leaking(docs, bench).collect()} == {r[0] for r in rows} - {d for d, _ in want}


def test_decontamination_of_short_items(spark):
    items = [(1, "alpha beta gamma delta"), (2, "omega"), (3, "one two three four five")]
    rows = [(1, "x alpha beta gamma delta y"), (2, "alpha beta gamma"), (3, "so Omega it is"), (4, "one two three four five"), (5, "one two three four")]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.item_id, r.first_word) for r in decontamination.find_leaks(docs, bench).collect()} == {(1, 1, 1), (3, 2, 1), (4, 3, 0)}


def test_multi_index_finds_all_within_radius():
    rng, many = random.Random(6), np.random.default_rng(1).integers(0, 1 << 16, (3000, 8)).astype(np.uint16)
    index = decontamination.MultiIndex(many[:200])
    flip = lambda p: p ^ np.packbits(np.isin(np.arange(128), rng.sample(range(128), rng.randint(0, decontamination.RADIUS)))).view(np.uint16)
    near = np.array([flip(p) for p in many[:200]])
    assert {(k, k) for k in range(200)} <= set(zip(*(x.tolist() for x in index.within(near, decontamination.RADIUS))))
    assert len(index.probed(many[200:])[0]) / (2800 * 200) < 0.1


def test_similar_windows_are_within_the_radius():
    """Recall of the radius on windows of 14 to 60 words whose weighted similarity is 0.8 or a little more."""
    rng, far, n = random.Random(9), 0, 0
    from collections import Counter

    for k in range(1500):
        a = np.array([rng.getrandbits(64) for _ in range(10 + k % 47)], dtype=np.uint64)
        b = a.copy()
        lost = int(len(a) * 0.2 / 1.8)
        b[rng.sample(range(len(a)), lost)] = np.array([rng.getrandbits(64) for _ in range(lost)], dtype=np.uint64)
        assert decontamination.weighted_similarity(Counter(a.tolist()), Counter(b.tolist())) >= 0.8
        far += int(decontamination.distances(decontamination.simhash(a), decontamination.simhash(b))[0]) > decontamination.RADIUS
        n += 1
    assert far / n < 0.005


@pytest.mark.parametrize(("length", "hot"), [(20, 512), (100, 512), (100, 2), (60, 3)])
def test_suffix_dedup_equals_brute_force(spark, length, hot):
    rng = random.Random(length)
    bits = [prose(rng, rng.randint(5, 60)) for _ in range(8)]
    texts = [" ".join(rng.choice(bits) if rng.random() < 0.5 else prose(rng, 20) for _ in range(rng.randint(1, 5))) for _ in range(60)]
    texts += ["é" * 150, "é" * 150, "ab" * 200, texts[0]]
    texts += [prose(rng, rng.randint(0, 4)) + bits[0] + bits[1] + prose(rng, rng.randint(0, 9)) for _ in range(25)]
    length = max(length, 40)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(rows, length, hot).collect()}
    seen = set()
    for k, text in enumerate(texts):
        raw = text.encode()
        gone = np.zeros(len(raw), dtype=bool)
        for a in range(len(raw) - length + 1):
            if raw[a : a + length] in seen:
                gone[a : a + length] = True
            seen.add(raw[a : a + length])
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        assert (got[k].n_removed, got[k].kept_sha256) == (int(gone.sum()), hashlib.sha256(kept).hexdigest()), k


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for _ in range(200):
        data = rng.integers(97, 97 + int(rng.integers(1, 4)), int(rng.integers(1, 60))).astype(np.uint8)
        raw = data.tobytes()
        order = suffix_dedup.suffix_array(data)
        assert order.tolist() == sorted(range(len(raw)), key=lambda k: raw[k:])
        lcp = suffix_dedup.common_prefixes(data, order, 20)
        for k in range(1, len(raw)):
            x, y, n = raw[order[k - 1] :], raw[order[k] :], 0
            while n < min(len(x), len(y), 20) and x[n] == y[n]:
                n += 1
            assert lcp[k] == n


def test_line_templates(spark):
    rows = [(k, f"Page {k} of 90 printed\nown words of document number x{'abc'[k % 3]}y{k}\nline {k} z") for k in range(5)]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0]._n_dropped == 0 and all(out[k]._n_dropped >= 2 for k in range(1, 5))


def test_line_templates_below_the_same_tokens(spark):
    """Two templates with the same leading tokens, a document with three variants of its own, and rows without an id."""
    names = ["ann", "bob", "cid", "dee", "eve", "fay", "gus", "hal", "ida"]
    first = [(k, f"posted by {n} in the general news section of our site\nw{n}") for k, n in enumerate(names[:5])]
    second = [(k + 5, f"posted by {n} at our other regional office far from here\nw{n}") for k, n in enumerate(names[5:])]
    verse = [(20, "\n".join(f"the long and winding {x} leads to your door again" for x in ("road", "street", "path")))]
    footer = [(k, "all rights reserved by us") for k in (None, 30, 31, 32)]
    rows = spark.createDataFrame([*first, *second, *verse, *footer], "doc_id long, text string")
    out = {r.doc_id: r for r in line_dedup.dedup_lines(rows).collect()}
    assert [out[k]._n_dropped for k in range(9)] == [0, 1, 1, 1, 1, 0, 1, 1, 1]
    assert out[20]._n_dropped == 0 and out[None]._n_dropped == 0 and [out[k]._n_dropped for k in (30, 31, 32)] == [0, 1, 1]
    again = line_dedup.dedup_lines(spark.createDataFrame([(1, "a b\nc d"), (1, "c d\nx y\nz"), (2, "x y"), (3, "x y"), (0, "x y")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in again) == [(0, "x y"), (1, "a b\nc d"), (1, "c d\nz"), (2, ""), (3, "")]


def test_license_markers_cover_templates():
    """A window that reaches the containment holds a marker: too few shingles are without one."""
    markers = set(license_scan.markers_of(license_scan.TEMPLATES))
    for name, text in license_scan.TEMPLATES.items():
        grams = license_scan.grams_of(text)
        assert grams and sum(not markers.intersection(g) for g in grams) / len(grams) < license_scan.CONTAINMENT, name


def test_license_scan_finds_notices(spark):
    header = license_scan.TEMPLATES["gpl-3.0-header"].replace("any later version", "some later version")
    rows = [(1, "x y z. Released under the MIT License. more"), (2, "the license of nothing"), (3, "This work is licensed under the GNU General Public License, version 3."), (4, "Licensed under the MIT License"), (5, f"/* {header} */ int main")]
    found = {(r.doc_id, r.template) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(1, "mit"), (3, "gpl-3.0"), (4, "mit-licensed"), (5, "gpl-3.0-header")} <= found and not any(d == 2 for d, _ in found)


def test_license_scan_of_other_templates(spark):
    """Templates without any usual word of licences, and one too short to be found."""
    rows = [(1, "well then the quick brown fox jumps over the lazy dog again"), (2, "nothing of it"), (None, "The quick brown fox jumps over the lazy dog")]
    given = {"fox": "the quick brown fox jumps over the lazy dog", "short": "of it"}
    assert sorted((r.doc_id or 0, r.template, r.containment) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), given).collect()) == [(0, "fox", 1.0), (1, "fox", 1.0)]


def test_held_out_is_crc(spark):
    row = spark.createDataFrame([(17,)], "doc_id long").select(held_out(F.col("doc_id"), 4, zlib.crc32(b"17") % 4)).first()
    assert row[0] is True
