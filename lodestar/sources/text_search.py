"""Substring search in the result store by postings of three-character runs.

``index_results`` gives each commit of the store a folder of postings (gram, cv_key, enriched), one row for each distinct
run of the name, the key and the first 500 characters of text, in ranges of the gram; only commits that lack one are
read. A search looks up the runs of what it seeks, which reach the scan as a filter, reads the store's buckets of the keys
that hold them all, and verifies these rows. Commits without postings are scanned, so results are whole at any time. A
sought text under three characters has no run and scans the store.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import versions
from .store import KEY, matches_search, read_results, searched_fields

#: Characters of a run.
GRAM = 3
#: Postings of one file, about: ranges of grams get that many rows.
ROWS_PER_FILE = 4_000_000
#: Characters of all sought texts together up to which they and their runs are broadcast: at most some 60 MB of rows.
MOST_CHARACTERS = 1_000_000
_POSTINGS = "gram string, cv_key string, enriched boolean"


def _runs(text: Column) -> Column:
    """All runs in one pass; a character beyond 16 bits adds runs that begin at its second half, which no sought text lacks either."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1))


def runs_of(text: str) -> list[str]:
    """The distinct runs of a sought text."""
    low = text.lower()
    return sorted({low[k : k + GRAM] for k in range(len(low) - GRAM + 1)})


def postings(results: DataFrame) -> DataFrame:
    """(gram, cv_key, enriched) of each result, every gram once; a text that repeats its runs has no more rows for it."""
    copy = F.coalesce("enriched", F.lit(False)) if "enriched" in results.columns else F.lit(False)
    low = results.select("cv_key", copy.alias("enriched"), *[F.lower(f).alias(f"_f{k}") for k, f in enumerate(searched_fields())])
    grams = F.array_distinct(F.concat(*[_runs(F.col(f"_f{k}")) for k in range(len(searched_fields()))]))
    return low.select(F.explode(grams).alias("gram"), "cv_key", "enriched")


def candidates(found: DataFrame, text: str) -> DataFrame:
    """(cv_key, enriched) that hold all runs of ``text``, by postings without repeats; what contains the text is among them."""
    runs = runs_of(text)
    if not runs:
        raise ValueError(f"a text of under {GRAM} characters has no run")
    return found.where(F.col("gram").isin(runs)).groupBy("cv_key", "enriched").agg(F.count("*").alias("_n")).where(F.col("_n") == len(runs)).drop("_n")


def search(results: DataFrame, found: DataFrame, text: str) -> DataFrame:
    """The rows of ``results`` that match ``text``, by way of their postings; the same rows as a scan gives."""
    if not runs_of(text):
        return results.where(matches_search(text))
    keys = candidates(found, text).select("cv_key").distinct()
    return results.join(keys, "cv_key", "left_semi").where(matches_search(text))


def search_many(results: DataFrame, found: DataFrame, texts: DataFrame) -> DataFrame:
    """(text, cv_key) for each distinct non-null ``text`` of a table; texts under three characters find nothing here.

    Each text's runs are counted in the postings, and results that hold the rarest of them are verified. Sought texts of
    up to ``MOST_CHARACTERS`` in all are broadcast to the postings; more of them meet by a shuffle.
    """
    sought = texts.select("text").where(F.length("text") >= GRAM).distinct()
    asked = sought.select("text", F.explode(F.array_distinct(_runs(F.lower("text")))).alias("gram"))
    grams = asked.select("gram").distinct()
    characters = sought.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    small = F.broadcast if characters <= MOST_CHARACTERS else (lambda df: df)
    counts = found.join(small(grams), "gram").groupBy("gram").agg(F.count("*").alias("_n"))
    rarest = asked.join(counts, "gram", "left").groupBy("text").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "gram")).alias("_x")).select("text", "_x.gram")
    held = found.join(small(rarest), "gram").select("text", "cv_key", "enriched")
    copy = F.coalesce("enriched", F.lit(False)) if "enriched" in results.columns else F.lit(False)
    bare = results.select("cv_key", copy.alias("enriched"), F.array(*[F.lower(f) for f in searched_fields()]).alias("_fields"))
    met = held.join(bare, ["cv_key", "enriched"])
    return met.where(F.exists("_fields", lambda f: F.contains(f, F.lower("text")))).select("text", "cv_key").distinct()


def _folder(path: str, commit: dict) -> str:
    return f"{path}/grams/{commit['folder']}"


def _indexed(spark: SparkSession, path: str, commit: dict) -> bool:
    make, _, fs = versions._files(spark, path)
    return fs.exists(make(f"{_folder(path, commit)}/_SUCCESS"))


def index_results(spark: SparkSession, path: str) -> int:
    """Write the postings of the commits that lack them, and return how many those were."""
    done = 0
    for commit in versions.snapshot(spark, path):
        if _indexed(spark, path, commit):
            continue
        rows = postings(versions.rows_of(spark, path, commit))
        files = max(1, -(-rows.count() // ROWS_PER_FILE))
        rows.repartitionByRange(files, "gram", "cv_key").sortWithinPartitions("gram", "cv_key").write.mode("overwrite").parquet(_folder(path, commit))
        done += 1
    return done


def stored_candidates(spark: SparkSession, path: str, text: str) -> DataFrame:
    """(cv_key) of all rows, in any commit, that can match; those of commits without postings are found by a scan."""
    parts = []
    for commit in versions.snapshot(spark, path):
        if _indexed(spark, path, commit):
            keys = candidates(spark.read.schema(_POSTINGS).parquet(_folder(path, commit)), text)
        else:
            keys = versions.rows_of(spark, path, commit).where(matches_search(text))
        parts.append(keys.select("cv_key"))
    return reduce(DataFrame.union, parts).distinct() if parts else spark.createDataFrame([], "cv_key string")


def search_store(spark: SparkSession, path: str, text: str) -> DataFrame:
    """The newest stored results that match ``text``, with their columns; only buckets with candidates are read."""
    if not runs_of(text):
        return read_results(spark, path).where(matches_search(text))
    keys = stored_candidates(spark, path, text)
    only = versions.buckets_of(spark, path, keys)
    found = versions.read(spark, path, KEY, only=only)
    if found is None:
        raise ValueError(f"no results are stored at {path}")
    return found.join(keys, "cv_key", "left_semi").where(matches_search(text))
