"""The result store and the feedback log: writes, scans, lookups, search, status, and reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import or_null
from . import versions


#: A result and its enriched copy are two versions of one scan.
KEY = ["cv_key", "enriched"]


def _is_copy(results: DataFrame) -> Column:
    return F.coalesce("enriched", F.lit(False)) if "enriched" in results.columns else F.lit(False)


def originals(results: DataFrame) -> DataFrame:
    """Results that aren't enriched copies."""
    return results.where(~_is_copy(results)) if "enriched" in results.columns else results


def name_of(results: DataFrame) -> Column:
    """A result's name: its key, and for an enriched copy a suffix."""
    return F.when(_is_copy(results), F.concat("cv_key", F.lit("_enriched"))).otherwise(F.col("cv_key")) if "enriched" in results.columns else F.col("cv_key")


def write_results(results: DataFrame, path: str) -> None:
    """Add or replace results by cv_key and ``enriched`` (false where missing); they may have been computed from the store itself."""
    versions.append(results.withColumn("enriched", _is_copy(results)), path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All stored results, the newest of each cv_key, original or enriched; of JSON documents unreadable ones are skipped."""
    if path.rstrip("/").endswith("json"):
        rows = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
        return rows.where(F.col("_corrupt").isNull()).drop("_corrupt") if "_corrupt" in rows.columns else rows
    found = versions.read(spark, path, KEY)
    return spark.read.parquet(path) if found is None else found


def read_result(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The stored result of a name, from the one bucket that can hold it."""
    keys = spark.createDataFrame([(key.removesuffix(".json").removesuffix("_enriched"),), (key.removesuffix(".json"),)], "cv_key string")
    found = versions.read(spark, path, KEY, only=versions.buckets_of(spark, path, keys))
    if found is None:
        raise ValueError(f"no results are stored at {path}")
    return lookup(found, key)


def compact_results(spark: SparkSession, path: str) -> None:
    versions.compact(spark, path, KEY)


def lookup(results: DataFrame, key: str) -> DataFrame:
    """The result of a key or name, with or without its file extension; names with a path in them find nothing.

    A key stands for the original, and for the enriched copy only where that is stored alone.
    """
    bare = key.removesuffix(".json")
    found = results.where(F.lit("/" not in bare and ".." not in bare) & ((F.col("cv_key") == bare) | (name_of(results) == bare)))
    return found.orderBy(_is_copy(results)).limit(1)


def lookup_containing(results: DataFrame, part: str) -> DataFrame:
    return results.where(F.contains(name_of(results), F.lit(part)))


def exists(results: DataFrame, key: str) -> bool:
    return not lookup(results, key).limit(1).isEmpty()


def detail(results: DataFrame, key: str) -> DataFrame:
    """The result of a name, else the first whose name contains it."""
    rank = F.when(name_of(results) == key.removesuffix(".json"), 0).otherwise(1)
    return lookup_containing(results, key.removesuffix(".json")).orderBy(rank, name_of(results)).limit(1)


def newest_first(results: DataFrame) -> DataFrame:
    return results.orderBy(F.coalesce("created_at", F.lit("")).desc(), "cv_key")


def searched_fields() -> tuple[Column, ...]:
    """What a search looks at: file name, key, and the first 500 characters of text."""
    return F.coalesce("filename", F.lit("")), F.coalesce("cv_key", F.lit("")), F.substring(F.coalesce("markdown", F.lit("")), 1, 500)


def matches_search(query: str) -> Column:
    """Whether a result's file name, key, or first 500 characters of text contain the query."""
    q = F.lit(query.lower())
    found = F.lit(False)
    for f in searched_fields():
        found = found | F.contains(F.lower(f), q)
    return found


def listed(summaries: DataFrame, query: str | None) -> DataFrame:
    """Rows of a candidate list whose file name, id, department or job title contain the query."""
    if not (query or "").strip():
        return summaries
    q, found = F.lit(query.strip().lower()), F.lit(False)
    for c in (F.col("filename"), F.col("id"), F.col("primary_department"), F.col("best_match.job_title")):
        found = found | F.contains(F.lower(F.coalesce(c, F.lit(""))), q)
    return summaries.where(found)


def shown_of_total(total: DataFrame, shown: DataFrame) -> DataFrame:
    """One row: how many rows a filtered list shows, and of how many."""
    one = lambda df, name: df.agg(F.count("*").alias(name)).withColumn("_one", F.lit(1))
    return one(shown, "shown").join(one(total, "total"), "_one").drop("_one")


def summary(results: DataFrame, named: bool = False) -> DataFrame:
    """What a list shows of a result, by its key or (``named``) its version's name; a score of 0.0 gives way to the overall score."""
    best = F.col("match_analysis.best_match")
    return results.select(
        (name_of(results) if named else F.col("cv_key")).alias("id"),
        "filename",
        F.coalesce(or_null(F.col("parsed_at")), F.col("created_at")).alias("parsed_at"),
        F.coalesce("page_count", F.lit(1)).alias("page_count"),
        F.coalesce("is_scanned", F.lit(False)).alias("is_scanned"),
        F.coalesce("ocr_applied", F.lit(False)).alias("ocr_applied"),
        F.col("match_analysis.primary_department").alias("primary_department"),
        F.struct(
            best["job_title"].alias("job_title"),
            F.coalesce(or_null(best["department"]), best["department_name"]).alias("department"),
            F.coalesce(F.nullif(best["score"], F.lit(0.0)), best["overall_score"]).alias("score"),
            best["classification"].alias("classification"),
            best["recommendation"].alias("recommendation"),
        ).alias("best_match"),
    )


def search_candidates(results: DataFrame, query: str | None = None, limit: int = 50) -> DataFrame:
    """A page of summaries, newest first."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be between 1 and 200")
    found = results.where(matches_search(query)) if query else results
    return summary(newest_first(found).limit(limit))


def status(keys: DataFrame, results: DataFrame) -> DataFrame:
    """cv_key, progress and message of uploads: 25 without a result, 50 without an analysis, else 100."""
    stored = results.groupBy("cv_key").agg(F.lit(True).alias("_has"), F.max(F.col("match_analysis").isNotNull()).alias("_done"), F.max("parsed_at").alias("parsed_at"))
    joined = keys.select("cv_key").join(stored, "cv_key", "left")
    return joined.select(
        "cv_key",
        F.when(F.col("_has").isNull(), 25).when(~F.col("_done"), 50).otherwise(100).alias("progress"),
        F.when(F.col("_has").isNull(), "waiting to be read").when(~F.col("_done"), "read, waiting to be matched").otherwise("done").alias("message"),
        F.when(F.col("_done"), F.col("parsed_at")).alias("parsed_at"),
    )


def prefer_enriched(results: DataFrame) -> DataFrame:
    """One result per key: the enriched one where there is one."""
    w = Window.partitionBy("cv_key").orderBy(F.col("enriched").desc_nulls_last())
    return results.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def reviews(requests: DataFrame, results: DataFrame, vacancies: DataFrame, now: Column | None = None) -> DataFrame:
    """Training examples of review requests: the reviewed opening of each scan with its requirements.

    requests: scan_id, job_id, corrected_score, corrected_classification, feedback_notes. A request for
    an unknown scan or opening gives no row; a vacancy that is gone leaves job_requirements null. Of a
    scan that was analysed again the enriched result counts.
    """
    results = prefer_enriched(results) if "enriched" in results.columns else results
    openings = results.select(F.col("cv_key").alias("scan_id"), F.col("markdown").alias("cv_text"), F.explode("match_analysis.suitable_openings").alias("o"))
    wanted = requests.join(openings.withColumn("job_id", F.col("o.job_id")), ["scan_id", "job_id"])
    catalogue = vacancies.select(F.col("id").alias("job_id"), F.to_json(F.struct(*[c for c in vacancies.columns if c != "ordinal"])).alias("job_requirements"))
    return wanted.join(catalogue, "job_id", "left").select(
        "scan_id",
        "job_id",
        "cv_text",
        "job_requirements",
        F.struct(F.coalesce(F.col("o.llm_reason"), F.lit("")).alias("llm_reason"), F.col("o.inferred_skills").alias("inferred_skills")).alias("original_llm_analysis"),
        F.coalesce("o.score", F.lit(0.0)).alias("original_score"),
        F.coalesce("o.classification", F.lit("LOW")).alias("original_classification"),
        F.col("corrected_score").alias("hr_corrected_score"),
        F.col("corrected_classification").alias("hr_corrected_classification"),
        F.col("feedback_notes").alias("hr_feedback"),
        (utc_now() if now is None else now).alias("timestamp"),
    )


def correct_range(score: Column) -> Column:
    return score.between(0, 100)


def append_examples(examples: DataFrame, path: str) -> None:
    examples.write.mode("append").json(path)


def training_examples(spark: SparkSession, path: str, limit: int = 100) -> DataFrame:
    """The last examples of the stored log, oldest first."""
    return tail(spark.read.json(path), limit)


def tail(log: DataFrame, limit: int = 100, order: str = "timestamp") -> DataFrame:
    """The last ``limit`` rows of an append-only log, oldest first, without blank rows."""
    last = log.orderBy(F.desc(order)).limit(limit)
    return last.where(F.greatest(*[F.col(c).isNotNull() for c in log.columns])).orderBy(order)


def reanalyzed(results: DataFrame, ids: DataFrame, analysis: DataFrame) -> DataFrame:
    """New enriched copies of the chosen results with a fresh analysis (cv_key, match_analysis)."""
    plain = originals(results).join(ids, "cv_key", "left_semi")
    return plain.drop("match_analysis", "enriched").join(analysis, "cv_key").withColumn("enriched", F.lit(True))


def utc_now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
