"""Ranks within a CV, the enrichment gate, and the nested analysis of each CV.

Scored rows are narrow (no text), so the one shuffle by CV moves little.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MatchConfig

#: Fixed value: the policy that every analysis states.
POLICY_NOTE = "Candidates are NEVER automatically rejected based on LOW match scores. HR review is always recommended."
#: What a CV without any vacancy gets.
NO_MATCH = {"job_id": "general", "job_title": "General Role", "department": "General", "department_name": "General", "score": 0.0, "overall_score": 0.0, "coverage": 1.0, "classification": "LOW", "recommendation": "HR review required."}


def ranked(scored: DataFrame, config: MatchConfig | None = None) -> DataFrame:
    """Adds rank, top_score, margin (to the next row, 0.0 after the last) and ranking_reason; with ``config`` also llm_skipped."""
    of = Window.partitionBy("cv_key")
    w = of.orderBy(F.desc("score"), "input_rank")
    rows = scored.select("*", F.row_number().over(w).alias("rank"), F.first("score").over(w).alias("top_score"), (F.col("score") - F.coalesce(F.lead("score").over(w), F.lit(0.0))).alias("margin"))
    # How a rank is explained.
    first = F.concat(F.lit("Ranked #1 with highest verified score of "), F.col("score").cast("string"), F.lit("%."))
    lower = F.concat(F.lit("Ranked #"), F.col("rank"), F.lit(" due to lower score ("), F.col("score").cast("string"), F.lit("% vs top "), F.col("top_score").cast("string"), F.lit("%)."))
    rows = rows.withColumn("ranking_reason", F.when(F.col("rank") == 1, first).otherwise(lower))
    return rows if config is None else rows.withColumn("llm_skipped", F.max(F.when(F.col("rank") == 1, _settled(config))).over(of))


def _settled(config: MatchConfig) -> Column:
    return (F.col("coverage") >= config.skip_coverage) & (F.col("margin") >= config.skip_margin)


def gate(rows: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """(cv_key, llm_skipped): whether the rules alone settle a CV, by its first row's coverage and margin."""
    return rows.where("rank = 1").select("cv_key", _settled(config).alias("llm_skipped"))


def with_gate(rows: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """Pairs with rule_score and rule_coverage, and llm_skipped of their CV in place of these."""
    of = Window.partitionBy("cv_key")
    w = of.orderBy(F.desc("rule_score"), "input_rank")
    margin = F.col("rule_score") - F.coalesce(F.lead("rule_score").over(w), F.lit(0.0))
    placed = rows.select("*", F.row_number().over(w).alias("_rank"), margin.alias("_margin"))
    settled = (F.col("rule_coverage") >= config.skip_coverage) & (F.col("_margin") >= config.skip_margin)
    return placed.select(*[c for c in rows.columns if c not in ("rule_score", "rule_coverage")], F.max(F.when(F.col("_rank") == 1, settled)).over(of).alias("llm_skipped"))


def skip_report(gated: DataFrame) -> DataFrame:
    """One row of a batch's (cv_key, llm_skipped): CVs, those that needed no enrichment, and their whole percentage."""
    skipped = F.count_if(F.coalesce("llm_skipped", F.lit(False)))
    return gated.agg(F.count("*").alias("n"), skipped.alias("skipped"), F.when(F.count("*") > 0, F.floor(100 * skipped / F.count("*"))).otherwise(0).cast("long").alias("percent"))


def evidence_digest(evidence: Column, most: int = 150) -> Column:
    """What the CV shows for each requirement, joined and cut for a log line."""
    told = F.transform(F.map_entries(evidence), lambda e: F.concat(e["key"], F.lit(": "), e["value"]["cv_evidence"]))
    return F.substring(F.array_join(F.array_sort(told), "; "), 1, most)


def best_matches(cvs: DataFrame, rows: DataFrame) -> DataFrame:
    """The first row of each CV; a CV without one gets the general role, with empty lists and zeros."""
    first = rows.where("rank = 1")
    joined = cvs.select("cv_key").join(first, "cv_key", "left")

    def filled(field) -> Column:
        name, kind = field.name, field.dataType.simpleString()
        if name in NO_MATCH:
            return F.coalesce(F.col(name), F.lit(NO_MATCH[name])).alias(name)
        if kind.startswith("array"):
            return F.coalesce(F.col(name), F.array().cast(field.dataType)).alias(name)
        if name.endswith("_score"):
            return F.coalesce(F.col(name), F.lit(0.0)).alias(name)
        return F.col(name)

    return joined.select([filled(f) for f in joined.schema])


def other_openings(rows: DataFrame) -> DataFrame:
    return rows.where("rank > 1")


def analyses(cvs: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each CV: primary_department, best_match, suitable_openings by rank, and the policy note.

    A CV holds at most as many openings as it was paired with, so its array is bounded by the pre-filter
    or, for rules-only matching, by the catalogue.
    """
    keep = [c for c in rows.columns if c not in ("cv_key",)]
    nested = rows.groupBy("cv_key").agg(F.sort_array(F.collect_list(F.struct("rank", *[c for c in keep if c not in ("rank", "evidence")]))).alias("suitable_openings"))
    joined = cvs.select("cv_key").join(nested, "cv_key", "left")
    best = F.get("suitable_openings", F.lit(0))
    return joined.select(
        "cv_key",
        F.coalesce(best["department_name"], best["department"], F.lit(NO_MATCH["department"])).alias("primary_department"),
        best.alias("best_match"),
        F.coalesce("suitable_openings", F.array().cast(nested.schema["suitable_openings"].dataType)).alias("suitable_openings"),
        F.lit(POLICY_NOTE).alias("rejection_policy_note"),
    )


def department_ranking(cvs: DataFrame, vacancies: DataFrame, departments: int = 3, most: int = 10) -> DataFrame:
    """Best vacancies of each CV's best departments: 10 a title term, 30 for the department's name."""
    from .prefilter import catalogue_slices

    slices, _ = catalogue_slices(vacancies)
    lower, parts = F.lower("cv_text"), []
    for number, packed in slices:
        rows = cvs.select("cv_key", lower.alias("t"), F.explode(F.sequence(F.lit(number), F.lit(number))).alias("block")).join(packed, "block")
        terms = lambda v: F.size(F.filter(v["title_terms"], lambda x: F.contains(F.col("t"), x))) * 10
        named = lambda v: F.when((v["dept_lower"] != "") & F.contains(F.col("t"), v["dept_lower"]), 30).otherwise(0)
        one = lambda v: F.struct(v["department"].alias("department"), v["id"].alias("id"), v["ordinal"].alias("ordinal"), (terms(v) + named(v)).alias("s"))
        parts.append(rows.select("cv_key", F.explode(F.transform("vacs", one)).alias("x")).select("cv_key", "x.*"))
    if not parts:
        return cvs.where("false").selectExpr("cv_key", "'' AS department", "'' AS id", "0 AS ordinal", "0 AS s", "0L AS department_score", "0 AS department_rank", "0 AS k")
    flat = reduce(DataFrame.unionByName, parts)
    sums = flat.select("*", F.sum("s").over(Window.partitionBy("cv_key", "department")).alias("department_score"))
    by_department = F.dense_rank().over(Window.partitionBy("cv_key").orderBy(F.desc("department_score"), "department"))
    top = sums.withColumn("department_rank", by_department).where(F.col("department_rank") <= departments)
    return top.withColumn("k", F.row_number().over(Window.partitionBy("cv_key").orderBy("department_rank", F.desc("s"), "ordinal"))).where(F.col("k") <= most)
