"""Whole matching plans: one Spark job evaluates all CVs against all vacancies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..functions.enrichment import Enricher, answer_rows, enrich, told_of
from ..functions.text import or_null, strip
from ..operators.catalog import conform
from ..operators.prefilter import all_pairs, prefilter
from ..operators.rank import analyses, gate, ranked, with_gate
from ..operators.score import score_pairs, with_features, with_rule_score
from ..sources import versions
from ..sources.store import originals, reanalyzed


def as_cvs(cvs: DataFrame) -> DataFrame:
    """cv_key, cv_text, candidate_experience and candidate_ctc, the last two null where missing."""
    out = cvs
    for c in ("candidate_experience", "candidate_ctc"):
        out = out.withColumn(c, F.col(c).cast("double") if c in cvs.columns else F.lit(None).cast("double"))
    return out


def checked(cvs: DataFrame) -> DataFrame:
    """Adds cv_error: why a text can't be analysed, or null."""
    text = F.coalesce("cv_text", F.lit(""))
    return cvs.withColumn(
        "cv_error",
        F.when(~text.rlike(r"(?U)\S"), "CV text is empty.").when(F.contains("cv_text", F.lit("<!-- image -->")) & (F.length(strip(text)) < 50), "CV holds images without readable text."),
    )


def match_rules(cvs: DataFrame, vacancies: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """Every CV against every vacancy by rules alone, ranked."""
    return ranked(score_pairs(all_pairs(with_features(as_cvs(cvs)), conform(vacancies)), config))


def match_prefiltered(cvs: DataFrame, vacancies: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """Every CV against its most promising vacancies by rules alone, ranked."""
    return ranked(score_pairs(prefilter(with_features(as_cvs(cvs)), conform(vacancies), config.prefilter_k), config))


def kept(df: DataFrame) -> DataFrame:
    """``df`` worked out once, as a table in the shared folder that outlives executors."""
    path = versions.scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def match_two_stage(
    cvs: DataFrame, vacancies: DataFrame, config: MatchConfig = MatchConfig(), answers: DataFrame | None = None, enricher: Enricher | None = None, answer_path: str | None = None
) -> DataFrame:
    """Pre-filter, rules, gate, and for the CVs that the gate lets through scoring with enrichment.

    ``answers`` (cv_key, response JSON) is an enrichment table; ``enricher`` answers prompts that it
    lacks, once for each CV, by way of the answer table at ``answer_path`` (without a path: one of this run
    alone), so a run that is started again asks only what is open. Without either, rules decide alone, in one
    pass. With one, pairs meet their CV's answer in the shuffle that ranks them: there the score by rules alone gives the
    gate, and each pair is then scored with what the gate lets through of the answer. Texts are read once and not shuffled.
    """
    valid = checked(as_cvs(cvs)).where("cv_error is null").drop("cv_error")
    featured = with_features(valid)
    pairs = prefilter(featured, conform(vacancies), config.prefilter_k)
    if answers is None and enricher is None:
        return ranked(score_pairs(pairs, config), config)
    if enricher is not None:
        pairs = kept(pairs)
        open_cvs = gate(ranked(score_pairs(pairs, config)), config).where("NOT llm_skipped").select("cv_key")
        asked = pairs.join(open_cvs, "cv_key", "left_semi")
        answers = enrich(asked, enricher, answers, featured, answer_path or versions.scratch(cvs.sparkSession))
    rows = with_gate(with_rule_score(pairs.join(answer_rows(answers), "cv_key", "left"), config), config)
    answer = F.when(~F.col("llm_skipped"), F.col("answer"))
    vacancy = F.coalesce(F.col("v.vacancy_id").cast("string"), or_null(F.col("v.id")))
    rows = rows.withColumn("answer", answer)
    rows = rows.select("*", F.col("answer.candidate_profile").alias("profile"), told_of(F.col("answer"), vacancy).alias("llm")).drop("answer")
    out = ranked(score_pairs(rows, config))
    return out.select(*[c for c in out.columns if c != "llm_skipped"], "llm_skipped")


def match_candidates(candidates: DataFrame, texts: DataFrame, vacancies: DataFrame, limit: int, config: MatchConfig = MatchConfig()) -> DataFrame:
    """Active candidates with a CV, the first ``limit`` by id, matched in two stages.

    candidates: id, first_name, last_name, cv_file_name, total_experience, expected_ctc, active; an
    experience or CTC of 0 is unknown. texts: cv_file_name, cv_text; a missing text gets a stand-in.
    """
    if not 1 <= limit <= 50:
        raise ValueError("limit must be between 1 and 50")
    from ..sources.catalog_tables import active_candidates

    chosen = active_candidates(candidates, limit)
    with_text = chosen.join(texts, "cv_file_name", "left")
    stand_in = F.concat(F.lit("Candidate "), F.col("name"))
    cvs = with_text.select(F.col("id").cast("string").alias("cv_key"), F.coalesce("cv_text", stand_in).alias("cv_text"), "candidate_experience", "candidate_ctc", "name")
    return match_two_stage(cvs, vacancies, config)


def analyze(cvs: DataFrame, vacancies: DataFrame, config: MatchConfig = MatchConfig(), two_stage: bool = True) -> DataFrame:
    """One nested analysis for each CV."""
    rows = match_two_stage(cvs, vacancies, config) if two_stage else match_rules(cvs, vacancies, config)
    return analyses(cvs, rows)


def reanalyze(results: DataFrame, ids: DataFrame, vacancies: DataFrame, config: MatchConfig = MatchConfig(), answers: DataFrame | None = None, enricher: Enricher | None = None) -> DataFrame:
    """Enriched copies of the chosen results (``ids``: cv_key), analysed anew from their texts; results that are such copies stay out."""
    chosen = originals(results).join(ids, "cv_key", "left_semi")
    cvs = chosen.select("cv_key", F.col("markdown").alias("cv_text"))
    nested = analyses(cvs, match_two_stage(cvs, vacancies, config, answers, enricher))
    fresh = nested.select("cv_key", F.struct(*[c for c in nested.columns if c != "cv_key"]).alias("match_analysis"))
    return reanalyzed(results, ids, fresh)
