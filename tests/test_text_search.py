"""Search by postings against a scan of every row."""

import random

import pytest

from lodestar.sources import store, text_search, versions

COLUMNS = "cv_key string, filename string, markdown string, enriched boolean"


def _rows(spark, keys, seed, enriched=False):
    make = random.Random(seed)
    word = lambda: "".join(make.choice("abcdeé🙂 İ_") for _ in range(make.randint(1, 9)))
    rows = [(f"cv_{k:05d}", None if make.random() < 0.05 else f"{word()}_{k}.PDF", None if make.random() < 0.05 else " ".join(word() for _ in range(make.choice([0, 3, 40, 300]))), enriched) for k in keys]
    return spark.createDataFrame(rows, COLUMNS)


def _found(df):
    return sorted((r.cv_key, bool(r.enriched), r.filename or "", r.markdown or "") for r in df.collect())


SOUGHT = ["abc", "CV_0001", ".pdf", "é🙂", "é🙂 ", "a b", "_12.", "nowhere at all", "ab", "", "aaa", "İ_"]


def test_search_equals_a_scan_through_all_states_of_the_store(spark, tmp_path):
    """Deltas, newer rows that no longer match, enriched copies, commits without postings, and compaction."""
    path = str(tmp_path / "s")
    store.write_results(_rows(spark, range(600), 1), path)
    assert text_search.index_results(spark, path) == 1
    store.write_results(_rows(spark, range(300, 800), 2), path)
    store.write_results(_rows(spark, range(0, 50), 3, True), path)
    assert text_search.index_results(spark, path) == 2 and text_search.index_results(spark, path) == 0

    def same(some):
        every = store.read_results(spark, path).cache()
        for s in some:
            assert _found(text_search.search_store(spark, path, s)) == _found(every.where(store.matches_search(s))), s
        every.unpersist()

    same(SOUGHT)
    store.write_results(_rows(spark, range(790, 810), 4), path)
    same(["abc", ".pdf"])
    store.compact_results(spark, path)
    same(["é🙂", "CV_0001"])
    assert text_search.index_results(spark, path) == 1
    same(["abc", "_12."])
    store.write_results(_rows(spark, range(5), 5), path)
    store.compact_results(spark, path)
    kept = {e["folder"] for e in versions.log(spark, path)}
    assert {p.name for p in (tmp_path / "s" / "grams").iterdir()} <= kept and len(text_search.runs_of("abcabc")) == 3


def test_search_reads_few_rows(spark, tmp_path):
    """What is sought reaches the scan of postings as a filter, and few rows are left to verify."""
    path = str(tmp_path / "s")
    store.write_results(_rows(spark, range(3000), 7), path)
    text_search.index_results(spark, path)
    keys = text_search.stored_candidates(spark, path, "v_01234")
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "In(gram, [" in plan.split("PushedFilters: ")[1] and [r.cv_key for r in keys.collect()] == ["cv_01234"]
    found = text_search.search_store(spark, path, "v_01234")
    scan = [line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "markdown" in line and "PartitionFilters" in line]
    assert len(scan) == 1 and "_bucket" in scan[0].split("PartitionFilters: ")[1].split("]")[0]
    assert [r.cv_key for r in found.collect()] == ["cv_01234"]


@pytest.mark.parametrize("most", [text_search.MOST_CHARACTERS, 0])
def test_many_texts_at_once(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(text_search, "MOST_CHARACTERS", most)
    rows = _rows(spark, range(400), 9).union(_rows(spark, range(40), 10, True))
    sought = [s for s in SOUGHT if len(s) >= text_search.GRAM]
    texts = spark.createDataFrame([(s,) for s in [*SOUGHT, "abc", None]], "text string")
    many = text_search.search_many(rows, text_search.postings(rows), texts)
    want = {(s, r.cv_key) for s in sought for r in rows.where(store.matches_search(s)).select("cv_key").collect()}
    assert sorted(map(tuple, many.collect())) == sorted(want) and len(want) > 400
    assert text_search.search_many(rows.where("false"), text_search.postings(rows.where("false")), texts).count() == 0
    with pytest.raises(ValueError):
        text_search.candidates(text_search.postings(rows), "ab")
    with pytest.raises(ValueError):
        text_search.search_store(spark, str(tmp_path / "none"), "abc")
