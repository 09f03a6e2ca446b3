"""Registered queries for the matching engine's operators, each with the DuckDB SQL that checks it.

The test tables hold no CVs or vacancies, so documents stand in for CVs, eight fixed vacancies for the
catalogue, and the order tables for its star joins. Every query runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import MatchConfig, latest_config, upsert_config
from .functions import enrichment, text
from .operators import catalog, prefilter, rank
from .plans import matching
from .sources import catalog_tables, store
from .streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Stand-in vacancies: id, number, title, department, skills, keywords, least and most experience, budget.
VACANCIES = (
    ("v1", 101, "Senior Python Developer", "Engineering", ("with", "that", "c++"), ("the", "node.js"), 5.0, 10.0, 20.0),
    ("v2", 102, "Backend src1 Engineer", "Engineering (Core)", ("node.js", "der"), ("und", "die"), 2.0, None, 15.0),
    ("v3", 103, "Data Analyst", "Finance", ("les", "des"), ("que",), None, None, None),
    ("v4", 104, "Clinical Nurse", "Healthcare & Support", ("los", "las"), ("del",), 1.0, 3.0, 10.0),
    ("v5", 105, "src3 Lead", "Design & Product", (), (), None, 8.0, None),
    ("v6", 106, "Team Manager", "src5 Operations", ("this", "from"), ("with",), 12.0, 20.0, 25.0),
    ("v7", 107, "Shopify Developer", "E-Commerce", ("zzz",), ("yyy",), 3.0, 5.0, 5.0),
    ("v8", 108, "Full Stack Software Engineer", "Engineering", ("that", "with", "this", "the"), (), 0.5, 14.0, None),
)


def query(sql: str | None = None):
    """Register a function under its own name, with the SQL that must give the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.concat(F.lit("## Senior "), F.col("source"), F.lit(" Developer\nSkills: "), F.col("lang"), F.lit(", c++, node.js\n"), F.col("text"))
    return _table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("cv_key"),
        head.alias("cv_text"),
        F.when(F.col("doc_id") % 7 != 0, (F.col("doc_id") % 15).cast("double")).alias("candidate_experience"),
        F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 30).cast("double")).alias("candidate_ctc"),
    )


def _vacancies(spark: SparkSession) -> DataFrame:
    kinds = "id string, vacancy_id long, title string, department string, required_skills array<string>, preferred_keywords array<string>, min_experience_years double, max_experience_years double, max_ctc double"
    return catalog.conform(spark.createDataFrame([(*v[:4], list(v[4]), list(v[5]), *v[6:]) for v in VACANCIES], kinds))


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]::VARCHAR[]"


def _sql_null(x) -> str:
    return "NULL::DOUBLE" if x is None else f"{x}::DOUBLE"


_EDGE = r"""[\s,;/()\-_"'']"""


def _has(column: str, term: str, word: str = r"\p{L}\p{N}") -> str:
    """SQL for whether a column holds a term between boundaries, with a constant pattern."""
    edge = _EDGE if any(c in term for c in "+#.") else f"[^{word}]"
    escaped = "".join("\\" + c if c in "+#." else c for c in term)
    return f"regexp_matches({column}, '(^|{edge}){escaped}($|{edge})')"


def _found(column: str, terms, word: str = r"\p{L}\p{N}") -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {_has(column, k, word)} THEN '{k}' END" for k in terms) + "], lambda k: k IS NOT NULL)"


def _sql_vacancies(vacancies) -> str:
    return ", ".join(f"({k}, '{v[0]}', {'NULL' if v[1] is None else v[1]}, '{v[2]}', '{v[3]}', {_sql_list(v[4])}, {_sql_list(v[5])}, {_sql_null(v[6])}, {_sql_null(v[7])}, {_sql_null(v[8])})" for k, v in enumerate(vacancies, 1))


_TERMS = sorted({k for v in VACANCIES for k in (*v[4], *v[5])})
_DEPARTMENT_TERMS = ("engineering", "finance", "healthcare", "design", "product", "src5", "commerce")
_CVS = r"""
vac AS (SELECT * FROM (VALUES """ + _sql_vacancies(VACANCIES) + r""") v(ordinal, id, vacancy_id, title, department, skills, keywords, lo, hi, budget)),
cv AS (SELECT CAST(doc_id AS VARCHAR) AS cv_key, '## Senior ' || source || ' Developer' || chr(10) || 'Skills: ' || lang || ', c++, node.js' || chr(10) || text AS cv_text,
       CASE WHEN doc_id % 7 <> 0 THEN (doc_id % 15)::DOUBLE END AS e, CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 30)::DOUBLE END AS ctc, 'Senior ' || source || ' Developer' AS role FROM documents),
low AS (SELECT *, lower(cv_text) AS t FROM cv),
terms AS (SELECT *, list_filter(string_split_regex(lower(title), '[\s/&()\-,]+'), lambda x: length(x) > 2 AND NOT list_contains(""" + _sql_list(text.TITLE_STOP_WORDS) + r""", x)) AS title_terms,
       list_filter(string_split_regex(lower(regexp_replace(department, '\([^)]*\)', ' ', 'g')), '[\s/&()\-,]+'), lambda x: length(x) > 2 AND NOT list_contains(""" + _sql_list(text.DEPARTMENT_DENYLIST) + r""", x)) AS dept_terms FROM vac)"""  # fmt: skip
_PREFILTER = r"""
pre AS (SELECT low.*, terms.*, CASE WHEN contains(t, lower(department)) THEN 30.0 ELSE 0.0 END + len(list_filter(title_terms, lambda k: contains(t, k))) * 15.0
       + len(list_filter(skills, lambda k: contains(t, k))) * 10.0 + len(list_filter(keywords, lambda k: contains(t, k))) * 5.0
       + CASE WHEN e IS NOT NULL AND (lo IS NULL OR e >= lo) AND (hi IS NULL OR e <= hi) THEN 10.0 ELSE 0.0 END AS prefilter_score FROM low, terms),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cv_key ORDER BY prefilter_score DESC, ordinal) AS input_rank FROM pre) WHERE input_rank <= 5)"""
_SCORE = r"""
dom AS (SELECT cv_key, lower(concat_ws(' ', role, role, nullif(array_to_string(list_filter(list_transform(string_split_regex(cv_text, '\r\n|[\n\x0B\f\r\x{85}\x{2028}\x{2029}]'), lambda x: trim(x)),
       lambda x: regexp_matches(x, '^[\p{L}\p{N}_ /&+\-.#]+:\s*\S+')), ' '), ''))) AS d FROM cv),
inf AS (SELECT cv_key, concat_ws(' ', d, """ + ", ".join(f"CASE WHEN list_has_any(regexp_extract_all(d, '[\\p{{L}}\\p{{N}}_]+'), {_sql_list(words)}) THEN '{name}' END" for name, words in text.DOMAIN_KEYWORDS.items()) + r""") AS d FROM dom),
fnd AS (SELECT cv_key, """ + _found("t", _TERMS) + r""" AS found FROM low),
dfd AS (SELECT cv_key, """ + _found("d", _DEPARTMENT_TERMS, r"\p{L}\p{N}_") + r""" AS domains FROM inf),
hit AS (SELECT p.*, domains, list_filter(skills, lambda k: list_contains(found, k)) AS ms, list_filter(keywords, lambda k: list_contains(found, k)) AS mk
        FROM {pairs} p JOIN fnd ON p.cv_key = fnd.cv_key JOIN dfd ON p.cv_key = dfd.cv_key),
part AS (SELECT *, len(skills) - len(ms) + CASE WHEN e < lo THEN 1 ELSE 0 END + CASE WHEN ctc > budget THEN 1 ELSE 0 END AS n_failures, len(keywords) - len(mk) AS n_soft,
       len(list_filter(list_intersect(regexp_extract_all(lower(role), '[\p{L}\p{N}_]+'), regexp_extract_all(lower(title), '[\p{L}\p{N}_]+')), lambda w: NOT list_contains(""" + _sql_list(text.SENIORITY_WORDS) + r""", w))) = 0 AND lower(role) <> lower(title) AS moved,
       CASE WHEN len(skills) + len(keywords) > 0 THEN (len(ms) + len(mk)) / (len(skills) + len(keywords)) * 100.0 END AS s_skills,
       CASE WHEN lo IS NOT NULL OR hi IS NOT NULL THEN greatest(0.0, least(100.0, CASE WHEN e < lo THEN e / lo * 50.0 ELSE 100.0 END - CASE WHEN e > hi THEN 20.0 ELSE 0.0 END)) END AS s_exp,
       CASE WHEN list_has_any(dept_terms, domains) THEN 100.0 ELSE 50.0 END AS s_dom FROM hit),
w AS (SELECT *, CASE WHEN moved THEN 50.0 ELSE 100.0 END AS s_role, ((0.0 + 0.15::DOUBLE) + CASE WHEN s_skills IS NULL THEN 0.0::DOUBLE ELSE 0.25::DOUBLE END) + CASE WHEN s_exp IS NULL THEN 0.0::DOUBLE ELSE 0.15::DOUBLE END + 0.15::DOUBLE AS active FROM part),
r AS (SELECT *, (((CASE WHEN moved THEN 50.0::DOUBLE ELSE 100.0::DOUBLE END * 0.15::DOUBLE) + CASE WHEN s_skills IS NULL THEN 0.0::DOUBLE ELSE s_skills::DOUBLE * 0.25::DOUBLE END) + CASE WHEN s_exp IS NULL THEN 0.0::DOUBLE ELSE s_exp::DOUBLE * 0.15::DOUBLE END + s_dom::DOUBLE * 0.15::DOUBLE) / active AS raw FROM w),
f AS (SELECT *, CASE WHEN n_failures > 0 THEN round_even(greatest(0.0, least(raw - n_failures * 20.0, 65.0)), 1) ELSE
       CASE WHEN round_even(least(100.0, greatest(0.0, raw)), 1) >= 100.0 AND (coalesce(s_skills, 100.0) < 100.0 OR n_soft > 0 OR s_dom < 100.0) THEN 99.0 ELSE round_even(least(100.0, greatest(0.0, raw)), 1) END END AS score FROM r),
scored AS (SELECT *, CASE WHEN active < 0.5 THEN 'LOW' WHEN score >= 70 THEN 'HIGH' WHEN score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS classification FROM f),
ranked AS (SELECT *, row_number() OVER w AS rank, first_value(score) OVER w AS top_score, score - coalesce(lead(score) OVER w, 0.0) AS margin FROM scored WINDOW w AS (PARTITION BY cv_key ORDER BY score DESC, input_rank))"""  # fmt: skip
_ALL_PAIRS = "everything AS (SELECT low.*, terms.*, ordinal AS input_rank FROM low, terms)"
_RULES = f"WITH {_CVS}, {_ALL_PAIRS}, {_SCORE.replace('{pairs}', 'everything')}"
_STAGED = f"WITH {_CVS}, {_PREFILTER}, {_SCORE.replace('{pairs}', 'top')}"


@query(f"WITH {_CVS}, {_PREFILTER} SELECT cv_key, id AS job_id, prefilter_score::DOUBLE AS prefilter_score, input_rank::INT AS input_rank FROM top")
def prefilter_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = prefilter.prefilter(_cvs(spark, sf_dir), _vacancies(spark), 5)
    return pairs.select("cv_key", F.col("v.id").alias("job_id"), "prefilter_score", F.col("input_rank").cast("int").alias("input_rank"))


@query(
    _RULES
    + """
SELECT cv_key, id AS job_id, score::DOUBLE AS score, s_role::DOUBLE AS role_score, coalesce(round_even(s_skills, 1), 0.0)::DOUBLE AS skills_score, coalesce(round_even(s_exp, 1), 0.0)::DOUBLE AS experience_score,
       s_dom::DOUBLE AS domain_score, round_even(active, 2)::DOUBLE AS coverage, classification, n_failures::INT AS n_failures, array_to_string(ms, ',') AS matched_skills, array_to_string(mk, ',') AS matched_keywords,
       (n_failures + n_soft + CASE WHEN active < 0.5 THEN 1 ELSE 0 END)::INT AS n_missing, n_failures > 0 OR score < 70 AS hr_review_required, moved AS career_transition_detected FROM scored"""
)
def rule_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matching.match_rules(_cvs(spark, sf_dir), _vacancies(spark))
    return rows.select(
        "cv_key", "job_id", "score", "role_score", "skills_score", "experience_score", "domain_score", "coverage", "classification",
        F.size("mandatory_failures").alias("n_failures"), F.array_join("matched_skills", ",").alias("matched_skills"), F.array_join("matched_keywords", ",").alias("matched_keywords"),
        F.size("missing_criteria").alias("n_missing"), "hr_review_required", "career_transition_detected",
    )


@query(_RULES + " SELECT cv_key, id AS job_id, rank::INT AS rank, score::DOUBLE AS score, round_even(margin, 1)::DOUBLE AS margin, CASE WHEN rank = 1 THEN 'Ranked #1 with highest verified score of ' || score::DOUBLE || '%.' ELSE 'Ranked #' || rank || ' due to lower score (' || score::DOUBLE || '% vs top ' || top_score::DOUBLE || '%).' END AS ranking_reason FROM ranked")
def rule_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matching.match_rules(_cvs(spark, sf_dir), _vacancies(spark))
    return rows.select("cv_key", "job_id", F.col("rank").cast("int").alias("rank"), "score", F.bround("margin", 1).alias("margin"), "ranking_reason")


@query(_STAGED + " SELECT cv_key, id AS job_id, title AS job_title, score::DOUBLE AS score, classification FROM ranked WHERE rank = 1")
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    cvs = _cvs(spark, sf_dir)
    rows = rank.best_matches(cvs, matching.match_prefiltered(cvs, _vacancies(spark)))
    return rows.select("cv_key", "job_id", "job_title", "score", "classification")


@query(_STAGED + " SELECT cv_key, round_even(active, 2) >= 0.5 AND margin >= 15.0 AS llm_skipped FROM ranked WHERE rank = 1")
def llm_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.gate(matching.match_prefiltered(_cvs(spark, sf_dir), _vacancies(spark)))


_AGAIN = _SCORE.replace("{pairs}", "top").replace("concat_ws(' ', role, role,", "concat_ws(' ', role, role, 'that with', header,").replace("/ active AS raw", "/ active + CASE WHEN vacancy_id = 101 THEN 8.0::DOUBLE ELSE 0.0::DOUBLE END AS raw")
_NEW = "'Senior Python Developer' AS role"


@query(
    _STAGED
    + f""", skip AS (SELECT cv_key, round_even(active, 2) >= 0.5 AND margin >= 15.0 AS llm_skipped FROM ranked WHERE rank = 1),
asked AS (SELECT cv_key FROM skip WHERE NOT llm_skipped AND CAST(cv_key AS BIGINT) % 3 = 0),
cv_new AS (SELECT * REPLACE ({_NEW}), role AS header FROM cv WHERE cv_key IN (FROM asked)),
low_new AS (SELECT * REPLACE ({_NEW}, t || ' that with senior python developer' AS t) FROM low WHERE cv_key IN (FROM asked)),
top_new AS (SELECT * REPLACE ({_NEW}, t || ' that with senior python developer' AS t) FROM top WHERE cv_key IN (FROM asked)),
again AS (WITH cv AS (FROM cv_new), low AS (FROM low_new), top AS (FROM top_new), {_AGAIN} SELECT * FROM ranked)
SELECT cv_key, id AS job_id, rank::INT AS rank, score::DOUBLE AS score, classification, llm_skipped, '' AS llm_reason, '' AS inferred_skills FROM ranked JOIN skip USING (cv_key) WHERE cv_key NOT IN (FROM asked)
UNION ALL SELECT cv_key, id, rank::INT, score::DOUBLE, classification, false, CASE WHEN vacancy_id = 101 THEN 'fits' ELSE '' END, 'with' FROM again"""
)
def two_stage_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With an answer for every third CV, which lifts its first vacancy's score."""
    cvs = _cvs(spark, sf_dir)
    body = '{"candidate_profile":{"core_skills":["that"],"inferred_skills":["with"],"current_role":"Senior Python Developer"},"matched_vacancies":[{"vacancy_id":"101","semantic_reason":"fits","matched_skills":["c++"],"semantic_fit_score":80.0}]}'
    answers = cvs.where(F.col("cv_key").cast("long") % 3 == 0).select("cv_key", F.lit(body).alias("response"))
    rows = matching.match_two_stage(cvs, _vacancies(spark), answers=answers)
    return rows.select("cv_key", "job_id", F.col("rank").cast("int").alias("rank"), "score", "classification", "llm_skipped", "llm_reason", F.array_join("inferred_skills", ",").alias("inferred_skills"))


#: SQL of a row's failed requirements, as they are told.
_FAILURES = """list_concat(list_transform(list_filter(skills, lambda k: NOT list_contains(ms, k)), lambda k: 'Skill: ' || k || ' (Mandatory skill ''' || k || ''' is not present in CV.)'),
       CASE WHEN e < lo THEN ['Minimum Experience: ' || lo || ' years (Candidate experience (' || e || ' yrs) is below mandatory minimum (' || lo || ' yrs).)'] ELSE []::VARCHAR[] END,
       CASE WHEN ctc > budget THEN ['Max CTC Budget: ' || budget || ' (Candidate CTC (' || ctc || ') exceeds vacancy maximum budget (' || budget || ').)'] ELSE []::VARCHAR[] END)"""


@query(
    _STAGED
    + f""" SELECT cv_key, department AS primary_department, id AS job_id, n_openings::INT AS n_openings, CASE WHEN n_failures > 0 THEN 'Mandatory requirement failure(s): ' || array_to_string({_FAILURES}, '; ')
       ELSE 'All mandatory requirements satisfied. Overall match score is ' || score::DOUBLE || '%.' END || CASE WHEN active < 0.5 THEN ' | Note: Low match coverage (' || CAST(floor(active * 100) AS INT) || '%).' ELSE '' END AS reason,
       '{rank.POLICY_NOTE}' AS rejection_policy_note FROM (SELECT *, count(*) OVER (PARTITION BY cv_key) AS n_openings FROM ranked) WHERE rank = 1"""
)
def nested_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested row for each document, flattened to what can be compared."""
    rows = matching.analyze(_cvs(spark, sf_dir), _vacancies(spark))
    return rows.select("cv_key", "primary_department", F.col("best_match.job_id").alias("job_id"), F.size("suitable_openings").alias("n_openings"), F.col("best_match.reason").alias("reason"), "rejection_policy_note")


@query(_STAGED + " SELECT cv_key, id AS job_id, rank::INT AS rank FROM ranked WHERE rank > 1")
def other_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.other_openings(matching.match_prefiltered(_cvs(spark, sf_dir), _vacancies(spark))).select("cv_key", "job_id", F.col("rank").cast("int").alias("rank"))


@query(
    _STAGED
    + """, req AS (SELECT cv_key, id, unnest(skills) AS k, 'MANDATORY' AS tier, ms AS held FROM scored UNION ALL SELECT cv_key, id, unnest(keywords), 'PREFERRED', mk FROM scored)
SELECT cv_key, id AS job_id, CASE tier WHEN 'MANDATORY' THEN 'req_skill_' ELSE 'pref_keyword_' END || replace(lower(k), ' ', '_') AS requirement_id, CASE WHEN list_contains(held, k) THEN 'SATISFIED' ELSE 'FAILED' END AS status,
       CASE tier WHEN 'MANDATORY' THEN CASE WHEN list_contains(held, k) THEN 'CV contains skill: ''' ELSE 'CV missing explicit mention of skill: ''' END ELSE CASE WHEN list_contains(held, k) THEN 'CV mentions preferred keyword: ''' ELSE 'CV missing preferred keyword: ''' END END || k || '''' AS cv_evidence FROM req"""
)
def requirement_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skill and keyword requirements of every pair, with what the CV shows for them."""
    rows = matching.match_prefiltered(_cvs(spark, sf_dir), _vacancies(spark))
    every = rows.select("cv_key", "job_id", "evidence", F.explode(F.concat("mandatory_requirements", "preferred_requirements")).alias("r"))
    every = every.where(F.col("r.requirement_id").rlike("^(req_skill|pref_keyword)_"))
    return every.select("cv_key", "job_id", F.col("r.requirement_id").alias("requirement_id"), F.col("r.status").alias("status"), F.element_at("evidence", F.col("r.requirement_id"))["cv_evidence"].alias("cv_evidence"))


@query(_STAGED + " SELECT count(*)::BIGINT AS n, count_if(s)::BIGINT AS skipped, floor(100 * count_if(s) / count(*))::BIGINT AS percent FROM (SELECT round_even(active, 2) >= 0.5 AND margin >= 15.0 AS s FROM ranked WHERE rank = 1)")
def llm_skip_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.skip_report(rank.gate(matching.match_prefiltered(_cvs(spark, sf_dir), _vacancies(spark))))


@query(
    """SELECT o_orderkey AS id, coalesce(nullif(c.c_name, ''), 'Vacancy #' || o_orderkey) AS title, CASE WHEN n.n_nationkey IS NULL THEN 'Unknown Department' ELSE n.n_name END AS department,
       CASE WHEN r.r_regionkey IS NULL THEN 'Unknown Location' ELSE r.r_name END AS location_name FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
       LEFT JOIN nation n ON nullif(c.c_nationkey, 3) = n.n_nationkey LEFT JOIN region r ON n.n_regionkey = r.r_regionkey"""
)
def star_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation, region = (_table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(nation, F.nullif("c_nationkey", F.lit(3)) == F.col("n_nationkey"), "left").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return rows.select(
        F.col("o_orderkey").alias("id"),
        F.coalesce(text.or_null(F.col("c_name")), F.concat(F.lit("Vacancy #"), F.col("o_orderkey"))).alias("title"),
        F.when(F.col("n_nationkey").isNull(), "Unknown Department").otherwise(F.col("n_name")).alias("department"),
        F.when(F.col("r_regionkey").isNull(), "Unknown Location").otherwise(F.col("r_name")).alias("location_name"),
    )


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as vacancy requests: flags, keys and skills made from their columns."""
    k = F.col("p_partkey")
    flag = lambda m: F.when(k % m == 0, True).when(k % m == 1, False)
    return catalog_tables.read_table(spark, "part", sf_dir).select(
        k.alias("id"),
        F.when(k % 5 != 0, k % 4 != 1).alias("active"),
        flag(11).alias("deleted"),
        flag(13).alias("closed"),
        flag(17).alias("force_closed"),
        F.when(k % 3 != 0, k % 25).alias("job_profile_id"),
        F.when(k % 6 != 0, k % 30).alias("designation_id"),
        (k % 26).alias("company_id"),
        F.when(k % 4 != 0, k % 27).alias("department_id"),
        (k % 7).alias("location_id"),
        F.when(k % 8 == 0, "").otherwise(F.concat(F.col("p_name"), F.lit(", n/a,x, "), F.col("p_type"), F.lit(",NIL"))).alias("skills"),
        F.when(k % 8 != 0, F.col("p_size").cast("decimal(10,2)")).alias("min_experience_years"),
        F.when(k % 10 != 0, (F.col("p_size") + 3).cast("decimal(10,2)")).alias("max_experience_years"),
        F.lit(None).cast("decimal(18,2)").alias("min_ctc"),
        F.col("p_retailprice").cast("decimal(18,2)").alias("max_ctc"),
        F.lit(None).cast("string").alias("preferred_gender"),
    )


_REQUESTS = """
req AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 4 <> 1 END AS active, CASE WHEN p_partkey % 11 = 0 THEN true WHEN p_partkey % 11 = 1 THEN false END AS deleted,
       CASE WHEN p_partkey % 13 = 0 THEN true WHEN p_partkey % 13 = 1 THEN false END AS closed, CASE WHEN p_partkey % 17 = 0 THEN true WHEN p_partkey % 17 = 1 THEN false END AS force_closed,
       CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 25 END AS job_profile_id, CASE WHEN p_partkey % 6 <> 0 THEN p_partkey % 30 END AS designation_id, p_partkey % 26 AS company_id,
       CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 27 END AS department_id, p_partkey % 7 AS location_id,
       CASE WHEN p_partkey % 8 = 0 THEN '' ELSE p_name || ', n/a,x, ' || p_type || ',NIL' END AS skills, CASE WHEN p_partkey % 8 <> 0 THEN p_size::DOUBLE END AS lo, CASE WHEN p_partkey % 10 <> 0 THEN (p_size + 3)::DOUBLE END AS hi FROM part),
live AS (SELECT * FROM req WHERE active AND NOT coalesce(deleted, false) AND NOT coalesce(closed, false) AND NOT coalesce(force_closed, false))"""


def _dimension(spark: SparkSession, sf_dir: str, extra: bool = False) -> DataFrame:
    more = [F.col("n_regionkey").cast("long").alias("department_id"), F.concat(F.lit("Ability to paint "), F.col("n_name"), F.lit("; knowledge of "), F.lower("n_name"), F.lit(" oils (e.g. linseed) and Glazing\n- Skills, "), F.col("n_name")).alias("description")] if extra else []
    return _table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.when(F.col("n_nationkey") % 6 != 0, F.col("n_name")).otherwise("").alias("name"), *more)


@query(
    f"""WITH {_REQUESTS}, dim AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 6 <> 0 THEN n_name ELSE '' END AS name, n_regionkey::BIGINT AS dep FROM nation),
s AS (SELECT *, list_filter(list_transform(string_split(skills, ','), lambda x: trim(x)), lambda x: length(x) > 1 AND NOT list_contains({_sql_list(text.GARBAGE_SKILLS)}, lower(x))) AS k FROM live)
SELECT s.id::VARCHAR AS id, coalesce(nullif(p.name, ''), nullif(g.name, ''), 'Vacancy #' || s.id) AS title, CASE WHEN d.id IS NULL THEN 'Unknown Department' ELSE d.name END AS department,
       CASE WHEN c.id IS NULL THEN 'Unknown Company' ELSE c.name END AS company_name, CASE WHEN l.id IS NULL THEN 'Unknown Location' ELSE l.name END AS location_name,
       coalesce(s.department_id, p.dep, -1)::BIGINT AS department_id, array_to_string(k, '|') AS skills, lo AS min_experience_years, hi AS max_experience_years, len(k) = 0 AND lo IS NULL AND p.id IS NULL AS underspecified
FROM s LEFT JOIN dim p ON s.job_profile_id = p.id LEFT JOIN dim g ON s.designation_id = g.id LEFT JOIN dim c ON s.company_id = c.id LEFT JOIN dim d ON s.department_id = d.id LEFT JOIN dim l ON s.location_id = l.id"""
)
def active_vacancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = _dimension(spark, sf_dir)
    rows = catalog.active_vacancies(_requests(spark, sf_dir), _dimension(spark, sf_dir, True), dim, dim, dim, dim)
    return rows.select("id", "title", "department", "company_name", "location_name", F.coalesce("department_id", F.lit(-1)).alias("department_id"), F.array_join("required_skills", "|").alias("skills"), "min_experience_years", "max_experience_years", "underspecified")


@query("SELECT o_orderkey FROM orders WHERE CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AND NOT coalesce(CASE WHEN o_orderkey % 3 = 0 THEN true WHEN o_orderkey % 3 = 1 THEN false END, false)")
def active_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, k = F.col("o_orderstatus"), F.col("o_orderkey")
    active = F.when(status == "F", True).when(status == "O", False)
    return _table(spark, sf_dir, "orders").where(catalog.is_open(active, F.when(k % 3 == 0, True).when(k % 3 == 1, False))).select("o_orderkey")


@query(
    f"""SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_name || ', n/a,x,' || p_type, ','), lambda x: trim(x)), lambda x: length(x) > 1 AND NOT list_contains({_sql_list(text.GARBAGE_SKILLS)}, lower(x))), '|') AS skills,
       array_to_string(list_filter(string_split_regex(lower(p_name || ' / Senior (' || p_type || ')'), '[\\s/&()\\-,]+'), lambda x: length(x) > 2 AND NOT list_contains({_sql_list(text.TITLE_STOP_WORDS)}, x)), '|') AS title_terms FROM part"""
)
def skills_split_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    skills = F.concat(F.col("p_name"), F.lit(", n/a,x,"), F.col("p_type"))
    title = F.concat(F.col("p_name"), F.lit(" / Senior ("), F.col("p_type"), F.lit(")"))
    return _table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.split_skills(skills), "|").alias("skills"), F.array_join(text.name_terms(title), "|").alias("title_terms"))


_PROBES = ("c++", "node.js", "the", "of", "en", "developer")


@query(f"WITH {_CVS} " + " UNION ALL ".join(f"SELECT cv_key, '{k}' AS term, {_has('t', k)} AS found FROM low" for k in _PROBES))
def term_match_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cvs(spark, sf_dir).select("cv_key", F.lower("cv_text").alias("t"))
    return rows.select("cv_key", "t", F.explode(text.strings(_PROBES)).alias("term")).select("cv_key", "term", text.has_term(F.col("t"), F.col("term")).alias("found"))


@query(f"WITH {_RULES.removeprefix('WITH ')} SELECT cv_key, id AS job_id, s_dom::DOUBLE AS domain_score FROM scored")
def domain_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_rules(_cvs(spark, sf_dir), _vacancies(spark)).select("cv_key", "job_id", "domain_score")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    best = F.struct(F.concat(F.lit("Role "), F.col("lang")).alias("job_title"), F.when(k % 4 != 0, F.col("source")).otherwise("").alias("department"), F.lit("General").alias("department_name"), F.when(k % 5 == 0, 0.0).otherwise((k % 100).cast("double")).alias("score"), F.lit(12.5).alias("overall_score"), F.lit("LOW").alias("classification"), F.lit("HR review required.").alias("recommendation"))
    opening = F.struct(F.col("source").alias("job_id"), F.lit("why").alias("llm_reason"), text.strings(("a", "b")).alias("inferred_skills"), (k % 100).cast("double").alias("score"), F.lit("LOW").alias("classification"))
    analysis = F.when(k % 6 != 0, F.struct(F.col("lang").alias("primary_department"), best.alias("best_match"), F.array(opening).alias("suitable_openings")))
    return docs.select(
        F.concat(F.lit("cv_"), k).alias("cv_key"), F.concat(F.col("source"), F.lit("_"), k, F.lit(".pdf")).alias("filename"), F.col("text").alias("markdown"), analysis.alias("match_analysis"),
        F.when(k % 3 != 0, F.concat(F.lit("2026-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))).alias("created_at"), F.lit("").alias("parsed_at"), F.lit(None).cast("int").alias("page_count"),
        F.lit(None).cast("boolean").alias("is_scanned"), F.lit(None).cast("boolean").alias("ocr_applied"), (k % 2 == 0).alias("enriched"),
    )


_CREATED = "CASE WHEN doc_id % 3 <> 0 THEN '2026-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') END"


@query("SELECT 'cv_' || doc_id AS cv_key FROM documents WHERE contains(lower(source || '_' || doc_id || '.pdf'), 'tion') OR contains(lower('cv_' || doc_id), 'tion') OR contains(lower(substr(text, 1, 500)), 'tion')")
def candidate_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).where(store.matches_search("TION")).select("cv_key")


@query(
    f"""WITH page AS (SELECT *, {_CREATED} AS c FROM documents WHERE contains(lower(source || '_' || doc_id || '.pdf'), 'src1') OR contains(lower(substr(text, 1, 500)), 'src1') ORDER BY coalesce(c, '') DESC, 'cv_' || doc_id LIMIT 50)
SELECT 'cv_' || doc_id AS id, source || '_' || doc_id || '.pdf' AS filename, c AS parsed_at, 1::INT AS page_count, CASE WHEN doc_id % 6 <> 0 THEN lang END AS primary_department,
       CASE WHEN doc_id % 6 <> 0 THEN CASE WHEN doc_id % 4 <> 0 THEN source ELSE 'General' END END AS department, CASE WHEN doc_id % 6 <> 0 THEN coalesce(nullif(CASE WHEN doc_id % 5 = 0 THEN 0.0 ELSE (doc_id % 100)::DOUBLE END, 0.0), 12.5)::DOUBLE END AS score FROM page"""
)
def candidate_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.search_candidates(_results(spark, sf_dir), "src1", 50)
    return rows.select("id", "filename", "parsed_at", "page_count", "primary_department", F.col("best_match.department").alias("department"), F.col("best_match.score").alias("score"))


@query("SELECT 'cv_' || l.doc_id AS cv_key, CASE WHEN d.doc_id IS NULL OR d.doc_id % 5 = 0 THEN 25 WHEN d.doc_id % 6 = 0 THEN 50 ELSE 100 END::INT AS progress FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id")
def status_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _table(spark, sf_dir, "labels").select(F.concat(F.lit("cv_"), F.col("doc_id")).alias("cv_key"))
    known = _results(spark, sf_dir).where(F.substring("cv_key", 4, 20).cast("long") % 5 != 0)
    return store.status(keys, known).select("cv_key", "progress")


@query("SELECT p_partkey, CASE WHEN p_retailprice / 20 >= 70 OR p_type = 'PROMO' THEN 'HIGH MATCH' WHEN p_retailprice / 20 >= 40 THEN 'MEDIUM' ELSE 'LOW MATCH' END AS band, greatest(0.0, least(100.0, p_retailprice / 10))::DOUBLE AS bar FROM part")
def score_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.when(F.col("p_type") == "PROMO", "HIGH")
    return _table(spark, sf_dir, "part").select("p_partkey", text.score_band(F.col("p_retailprice") / 20, named).alias("band"), text.clamp(F.col("p_retailprice") / 10).alias("bar"))


@query(
    """WITH s AS (SELECT p_brand, p_partkey, p_size * 10 AS s FROM part), d AS (SELECT p_brand, sum(s) AS total FROM s GROUP BY p_brand),
r AS (SELECT p_brand, total, row_number() OVER (ORDER BY total DESC, p_brand) AS k FROM d)
SELECT r.p_brand AS department, r.k::INT AS department_rank, s.p_partkey AS id, s.s::INT AS score FROM r JOIN s ON r.p_brand = s.p_brand WHERE r.k <= 3 QUALIFY row_number() OVER (ORDER BY r.k, s.s DESC, s.p_partkey) <= 10"""
)
def dept_rank_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("department"), F.col("p_partkey").alias("id"), (F.col("p_size") * 10).alias("score"))
    top = parts.groupBy("department").agg(F.sum("score").alias("total")).orderBy(F.desc("total"), "department").limit(3)
    ranks = top.select(F.collect_list(F.struct((-F.col("total")).alias("t"), "department")).alias("x")).select(F.posexplode(F.sort_array("x")).alias("k", "y")).select(F.col("y.department").alias("department"), (F.col("k") + 1).alias("department_rank"))
    return parts.join(ranks, "department").orderBy("department_rank", F.desc("score"), "id").limit(10).select("department", "department_rank", "id", "score")


@query(
    f"""WITH {_REQUESTS}, x AS (SELECT *, list_filter(list_transform(string_split(skills, ','), lambda x: trim(x)), lambda x: x <> '') AS raw FROM req),
y AS (SELECT *, active AND NOT coalesce(deleted, false) AND NOT coalesce(closed, false) AND NOT coalesce(force_closed, false) AS up, len(list_filter(raw, lambda x: length(x) > 1 AND NOT list_contains({_sql_list(text.GARBAGE_SKILLS)}, lower(x)))) < len(raw) AS bad FROM x)
SELECT count_if(active)::BIGINT AS raw_active, count_if(up)::BIGINT AS open_active, count_if(up AND trim(skills) = '')::BIGINT AS missing_skills, count_if(up AND bad)::BIGINT AS garbage_skills,
       count_if(up AND lo IS NULL AND hi IS NULL)::BIGINT AS missing_range, count_if(up AND job_profile_id IS NULL)::BIGINT AS missing_profile FROM y"""
)
def data_quality_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.audit(_requests(spark, sf_dir))


@query("SELECT lower(p_name) AS name, count(*) AS n FROM part GROUP BY lower(p_name) HAVING count(*) > 1")
def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.duplicate_names(_table(spark, sf_dir, "part").select(F.col("p_name").alias("name")))


@query(
    """SELECT 'cv_' || l.doc_id AS scan_id, d.source AS job_id, (d.doc_id % 100)::DOUBLE AS original_score, (l.quality * 100)::DOUBLE AS hr_corrected_score, length(d.text)::INT AS n_chars, 'why' AS llm_reason, d.source <> 'src1' AS has_requirements
FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE d.doc_id % 6 <> 0 AND d.source = 'src' || (l.doc_id % 20) AND l.doc_id % 7 <> 0"""
)
def review_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    requests = labels.select(F.concat(F.lit("cv_"), F.col("doc_id")).alias("scan_id"), F.concat(F.lit("src"), F.col("doc_id") % 20).alias("job_id"), F.when(F.col("doc_id") % 7 == 0, 101.0 + F.col("quality")).otherwise((F.col("quality") * 100).cast("double")).alias("corrected_score"), F.lit("LOW").alias("corrected_classification"), F.lit(None).cast("string").alias("feedback_notes"))
    known = _table(spark, sf_dir, "documents").where("source <> 'src1'").select(F.col("source").alias("id")).distinct()
    rows = store.reviews(requests.where(store.correct_range(F.col("corrected_score"))), _results(spark, sf_dir), known)
    return rows.select("scan_id", "job_id", "original_score", "hr_corrected_score", F.length("cv_text").alias("n_chars"), F.col("original_llm_analysis.llm_reason").alias("llm_reason"), F.col("job_requirements").isNotNull().alias("has_requirements"))


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def idempotent_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.latest_by_key(_table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


@query("SELECT event_type AS status, count(*) AS n, count(DISTINCT user_id) AS files FROM events GROUP BY event_type")
def progress_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.progress_counts(_table(spark, sf_dir, "events").select(F.col("event_type").alias("status"), F.col("user_id").cast("string").alias("filename")))


@query("SELECT DISTINCT user_id::VARCHAR AS filename FROM events")
def dedupe_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.completions(_table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("filename"), "ts")).select("filename")


@query("SELECT conv_id, turn, role FROM (SELECT * FROM conversations ORDER BY conv_id DESC, turn DESC LIMIT 100)")
def feedback_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _table(spark, sf_dir, "conversations").withColumn("at", F.struct("conv_id", "turn"))
    return store.tail(log, 100, "at").select("conv_id", "turn", "role")


@query("SELECT doc_id, sha256(text) AS cv_hash, sha256(concat_ws('|', 'm', '3.0', text)) AS llm_key FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("cv_hash"), enrichment.simple_key(F.lit("m"), F.lit("3.0"), F.col("text")).alias("llm_key"))


@query(
    r"""WITH c AS (SELECT doc_id, substr(regexp_replace(array_to_string(list_filter(list_transform(string_split_regex(text, '\r\n|[\n\x0B\f\r\x{85}\x{2028}\x{2029}]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)), '[ \t]{2,}', ' ', 'g'), 1, 3500) AS t FROM documents)
SELECT doc_id, sha256(t) AS compact_hash, length(t)::INT AS char_count, greatest(1, length(t) // 4)::INT AS token_estimate FROM c"""
)
def prompt_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", text.compact_cv(F.col("text")).alias("t"))
    return rows.select("doc_id", F.sha2("t", 256).alias("compact_hash"), F.length("t").alias("char_count"), F.greatest(F.lit(1), (F.length("t") / 4).cast("int")).alias("token_estimate"))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_COMPACT = r"substr(regexp_replace(array_to_string(list_filter(list_transform(string_split_regex(cv_text, '\r\n|[\n\x0B\f\r\x{85}\x{2028}\x{2029}]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)), '[ \t]{2,}', ' ', 'g'), 1, 3500)"
_TOLD = """'{"vacancy_id":"' || vacancy_id || '","title":"' || title || '","department":"' || department || '"' || CASE WHEN len(skills) > 0 THEN ',"required_skills":["' || array_to_string(skills, '","') || '"]' ELSE '' END
       || CASE WHEN len(keywords) > 0 THEN ',"preferred_keywords":["' || array_to_string(keywords, '","') || '"]' ELSE '' END || CASE WHEN lo IS NOT NULL THEN ',"min_exp":' || lo ELSE '' END || '}'"""


@query(
    f"""WITH {_CVS}, {_PREFILTER}, told AS (SELECT cv_key, string_agg({_TOLD}, ',' ORDER BY input_rank) AS v, list_sort(list(concat_ws(':', vacancy_id, title, array_to_string(skills, ',')))) AS k FROM top GROUP BY cv_key),
b AS (SELECT low.cv_key, cv_text, k, {_sql_text('{"task":"' + enrichment.TASK + '","candidate_cv_text":')} || to_json({_COMPACT})::VARCHAR || ',"candidate_vacancies":[' || v || ']}}' || {_sql_text(enrichment.INSTRUCTIONS)} AS p FROM low JOIN told ON low.cv_key = told.cv_key)
SELECT cv_key, sha256(p) AS prompt_hash, length(p)::INT AS char_count, greatest(1, length(p) // 4)::INT AS token_estimate, sha256(concat_ws(':', sha256(cv_text), sha256('["' || array_to_string(k, '","') || '"]'), '{enrichment.PROMPT_VERSION}', 'default')) AS cache_key FROM b"""
)
def enrichment_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = enrichment.prompts(prefilter.prefilter(_cvs(spark, sf_dir), _vacancies(spark), 5))
    return asked.select("cv_key", F.sha2("prompt", 256).alias("prompt_hash"), "char_count", "token_estimate", "cache_key")


@query(f"WITH {_REQUESTS} SELECT req.id, 'paint ' || n_name || ', ' || lower(n_name) || ' oils, e.g. linseed, Glazing, ' || n_name AS skills FROM req JOIN nation ON req.job_profile_id = n_nationkey WHERE trim(skills) = ''")
def backfill_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.backfilled(_requests(spark, sf_dir), _dimension(spark, sf_dir, True), text.skill_terms)
    return rows.select("id", "skills")


@query("SELECT event_id, (props->>'$.k')::INT AS k FROM events")
def events_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return _table(spark, sf_dir, "events").select("event_id", F.from_json(enrichment.clean_answer(fenced), "k int")["k"].alias("k"))


@query("SELECT event_type AS key, arg_max(value, {'t': ts, 'e': event_id})::VARCHAR AS value FROM events WHERE event_id % 2 = CASE WHEN event_type = 'view' THEN 0 ELSE 1 END GROUP BY event_type")
def config_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes beat the table whatever their time; keys without a change stay."""
    rows = _table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("value").cast("string").alias("value"), F.struct("ts", "event_id").alias("updated_at"))
    old, new = rows.where("updated_at.event_id % 2 = 0"), rows.where("updated_at.event_id % 2 = 1 AND key <> 'view'")
    return upsert_config(latest_config(old), latest_config(new)).select("key", "value")


@query("SELECT c_custkey AS id, c_name AS name, nullif(round(c_acctbal), 0)::DOUBLE AS candidate_ctc FROM customer WHERE c_custkey % 3 <> 0 ORDER BY c_custkey LIMIT 50")
def candidate_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("first_name"), F.lit("").alias("last_name"), F.when(F.col("c_custkey") % 3 != 0, "x.pdf").alias("cv_file_name"), F.lit(0).alias("total_experience"), F.round("c_acctbal").alias("expected_ctc"), F.lit(True).alias("active"))
    return catalog_tables.active_candidates(rows, 50).select("id", "name", "candidate_ctc")


@query(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'cand_' || o_orderkey || '_cv_' || o_custkey WHEN 1 THEN 'cand_' || o_orderkey || '_' || s WHEN 2 THEN 'cv_' || o_custkey || '_' || s ELSE 'cv_' || s END AS cv_key
FROM (SELECT *, regexp_replace('my ' || o_orderpriority || '.v2', '[^a-zA-Z0-9_-]', '_', 'g') AS s FROM orders)"""
)
def stable_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = F.concat(F.lit("my "), F.col("o_orderpriority"), F.lit(".v2.pdf"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", text.content_key(name, F.when(k % 4 < 2, k), F.when(k % 2 == 0, F.col("o_custkey"))).alias("cv_key"))


@query(
    """SELECT p_partkey, CASE WHEN lo > 0 AND lo = hi THEN lo || ' Yrs Exp' WHEN lo IS NOT NULL AND hi IS NOT NULL AND (lo > 0 OR hi > 0) THEN lo || ' - ' || hi || ' Yrs Exp' WHEN lo > 0 THEN lo || '+ Yrs Exp' WHEN hi > 0 THEN 'Up to ' || hi || ' Yrs Exp' ELSE 'Any Experience' END AS experience
FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN p_size % 5 END AS lo, CASE WHEN p_partkey % 5 <> 0 THEN p_size % 7 END AS hi FROM part)"""
)
def experience_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    return _table(spark, sf_dir, "part").select("p_partkey", text.experience_label(F.when(k % 3 != 0, s % 5), F.when(k % 5 != 0, s % 7)).alias("experience"))


@query(
    """WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey * 37 % 999999 END AS lo, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey * 91 % 999999 END AS hi FROM part),
l AS (SELECT p_partkey, CASE k WHEN 0 THEN lo ELSE hi END AS p, k FROM r, (SELECT unnest([0, 1]) AS k)),
t AS (SELECT p_partkey, k, CASE WHEN p > 0 THEN CASE WHEN p <= 100 THEN '₹' || p || ' LPA' WHEN p < 1000 THEN '₹' || p WHEN p < 100000 THEN '₹' || (p // 1000) || ',' || lpad((p % 1000)::VARCHAR, 3, '0')
      ELSE '₹' || (p // 100000) || ',' || lpad((p // 1000 % 100)::VARCHAR, 2, '0') || ',' || lpad((p % 1000)::VARCHAR, 3, '0') END END AS s FROM l)
SELECT a.p_partkey, coalesce(a.s || ' - ' || b.s, 'From ' || a.s, 'Up to ' || b.s, 'Not Specified') AS salary FROM t a JOIN t b ON a.p_partkey = b.p_partkey AND a.k = 0 AND b.k = 1"""
)
def salary_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return _table(spark, sf_dir, "part").select("p_partkey", text.salary_label(F.when(k % 7 != 0, (k * 37) % 999999), F.when(k % 5 != 0, (k * 91) % 999999)).alias("salary"))


@query("SELECT p_partkey::VARCHAR AS id FROM part WHERE contains(lower(p_name), 'ar') OR contains(lower(p_brand), 'ar') OR contains(lower(p_type || ', ' || p_type), 'ar')")
def vacancy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("department"), F.array("p_type", "p_type").alias("required_skills"))
    return catalog.search_vacancies(rows, " AR ").select("id")


@query("SELECT DISTINCT department_id FROM (SELECT CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 27 END AS department_id FROM part) WHERE department_id IS NOT NULL")
def distinct_departments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.department_ids(_requests(spark, sf_dir))


@query("SELECT n_name AS foreign_key, r_name AS parent_table, n_name AS parent_column, r_name AS referenced_table, n_name AS referenced_column FROM nation JOIN region ON n_regionkey = r_regionkey")
def foreign_key_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "region")
    keys = nation.select(F.col("n_nationkey").alias("key_id"), F.col("n_name").alias("name"))
    links = nation.select(F.col("n_nationkey").alias("key_id"), *[F.col("n_regionkey").alias(f"{s}_table_id") for s in ("parent", "referenced")], *[F.col("n_nationkey").alias(f"{s}_column_id") for s in ("parent", "referenced")])
    tables = region.select(F.col("r_regionkey").alias("table_id"), F.col("r_name").alias("name"))
    columns = nation.select(F.col("n_regionkey").alias("table_id"), F.col("n_nationkey").alias("column_id"), F.col("n_name").alias("name"))
    return catalog_tables.foreign_keys(keys, links, tables, columns)


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'NEW_CV' WHEN doc_id % 4 = 1 THEN 'REPROCESSED' ELSE 'CACHE_HIT' END AS status FROM documents")
def ingest_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    name = F.concat(F.col("doc_id"), F.lit(".pdf"))
    files = docs.select(name.alias("filename"), F.length("text").cast("long").alias("length"), F.col("text").cast("binary").alias("content"))
    stored = docs.where("doc_id % 4 <> 0").select(text.content_key(name, F.lit(None), F.lit(None)).alias("cv_key"), F.when(F.col("doc_id") % 4 == 1, "old").otherwise(F.sha2("text", 256)).alias("cv_hash"), F.lit(ingest.PARSER_VERSION).alias("parser_version"), F.lit(ingest.SCHEMA_VERSION).alias("schema_version"), F.lit("2026-01-01").alias("created_at"))
    return ingest.decided(files, stored).select(F.regexp_extract("filename", r"^(\d+)", 1).cast("long").alias("doc_id"), "status")


@query(
    f"""WITH {_CVS}, s AS (SELECT cv_key, id, department, ordinal, len(list_filter(title_terms, lambda k: contains(t, k))) * 10 + CASE WHEN contains(t, lower(department)) THEN 30 ELSE 0 END AS s FROM low, terms),
d AS (SELECT *, sum(s) OVER (PARTITION BY cv_key, department) AS total FROM s), r AS (SELECT *, dense_rank() OVER (PARTITION BY cv_key ORDER BY total DESC, department) AS k FROM d)
SELECT cv_key, department, id, total::BIGINT AS department_score, k::INT AS department_rank FROM r WHERE k <= 3 QUALIFY row_number() OVER (PARTITION BY cv_key ORDER BY k, s DESC, ordinal) <= 10"""
)
def department_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.department_ranking(_cvs(spark, sf_dir), _vacancies(spark)).select("cv_key", "department", "id", F.col("department_score").cast("long").alias("department_score"), F.col("department_rank").cast("int").alias("department_rank"))


def _rules_over(vacancies, dept_terms) -> str:
    """The rules' SQL over another catalogue, of rows like those of ``VACANCIES``."""
    terms = sorted({x.lower() for v in vacancies for x in (*v[4], *v[5])})
    return (
        _RULES.replace(_sql_vacancies(VACANCIES), _sql_vacancies(vacancies))
        .replace(_found("t", _TERMS), _found("t", terms))
        .replace(_found("d", _DEPARTMENT_TERMS, r"\p{L}\p{N}_"), _found("d", dept_terms, r"\p{L}\p{N}_"))
        .replace("list_contains(found, k)", "list_contains(found, lower(k))")
    )


_DEFAULTS = [(v[0], None, *v[1:], None, None, None) for v in catalog.DEFAULT_VACANCIES]


@query(_rules_over(_DEFAULTS, ("engineering", "design", "product", "commerce")) + " SELECT cv_key, id AS job_id, rank::INT AS rank, score::DOUBLE AS score, classification, 1.0::DOUBLE AS confidence FROM ranked")
def default_catalogue_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in catalogue against every document."""
    rows = matching.match_rules(_cvs(spark, sf_dir), catalog.default_vacancies(spark), MatchConfig())
    return rows.select("cv_key", "job_id", F.col("rank").cast("int").alias("rank"), "score", "classification", "confidence")
