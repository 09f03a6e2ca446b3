"""The pair scorer: components, coverage, penalties, evidence and classification as plain columns.

Input rows hold cv_text, candidate_experience, candidate_ctc and the vacancy struct ``v``; optionally
``profile`` and ``llm`` structs from an enrichment table. Pairs of the pre-filter have looked up their
terms already (cv_found, cv_domains, cv_role) and need no text. Everything is a row-local expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import COMPONENTS, MatchConfig
from ..functions.text import SENIORITY_WORDS, current_role, domain_text, has_key, has_word, or_null, role_headers, skill_lines, strings, strip, term_key, words_of

PROFILE = "struct<core_skills:array<string>,inferred_skills:array<string>,relevant_experience_years:double,education_domains:array<string>,certifications:array<string>,current_role:string,professional_domains:array<string>>"
LLM = "struct<vacancy_id:string,semantic_reason:string,inferred_skills:array<string>,matched_skills:array<string>,semantic_fit_score:double,career_transition_note:string>"


def _none() -> Column:
    return F.array().cast("array<string>")


def _or_none(x: Column) -> Column:
    return F.coalesce(x, _none())


def _text(x: Column) -> Column:
    return x.cast("string")


def _join(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _requirement(req_id: Column, description: Column, tier: str, status: Column, cv: Column, vacancy: Column, why: Column) -> Column:
    evidence = F.struct(cv.alias("cv_evidence"), vacancy.alias("vacancy_evidence"), F.lit(1.0).alias("confidence_score"))
    return F.struct(req_id.alias("requirement_id"), description.alias("description"), F.lit(tier).alias("tier"), status.alias("status"), evidence.alias("evidence"), why.cast("string").alias("failure_reason"))


def _status(ok: Column, otherwise: str = "FAILED") -> Column:
    return F.when(ok, "SATISFIED").otherwise(otherwise)


def _only(condition: Column, value: Column) -> Column:
    """An array of ``value`` if the condition holds, else an empty one."""
    return F.filter(F.array(F.when(condition, value)), lambda x: x.isNotNull())


def _slug(prefix: str, term: Column) -> Column:
    return _join(prefix, F.replace(F.lower(term), F.lit(" "), F.lit("_")))


def with_features(cvs: DataFrame) -> DataFrame:
    """Adds what scoring takes from a CV's text alone, so that it is worked out once for all its pairs."""
    text = F.col("cv_text")
    parts = F.concat(role_headers(text), skill_lines(text))
    rows = cvs.select("*", F.lower(text).alias("cv_lower"))
    rows = rows.select("*", current_role(text, F.col("cv_lower")).alias("cv_role"), parts.alias("cv_parts"))
    return rows.select("*", domain_text(F.concat(F.array("cv_role"), F.col("cv_parts"))).alias("cv_domain"))


FEATURES = ("cv_lower", "cv_role", "cv_parts", "cv_domain")
#: Columns that pairs do without once terms have been looked up.
TEXTS = ("cv_text", "cv_lower", "cv_parts", "cv_domain")
#: What enriched pairs look up instead of texts: the text's end, and the domains that its parts without the role name.
ENDS = ("cv_tail", "cv_part_domains")


def score_pairs(pairs: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """One scored row for each pair; the CV text itself is left behind.

    Pairs that have looked up their terms need no text for an enriched score either: an answer's words follow the text after a
    space, so a term that they bring lies in them or begins in the text's last characters.

    Unknown experience meets any bound and gives no requirement. Lists keep repeats; the evidence map
    holds each requirement id once, the last of equals. Where a component is unknown it doesn't count.
    A score of 100 with anything missing becomes 99; an unknown component is nothing missing.
    """
    return _told(_judged(pairs, config), config)


def with_rule_score(pairs: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """Adds rule_score and rule_coverage, those of ``score_pairs`` without enrichment, and keeps all columns."""
    rows = _judged(pairs.drop("profile", "llm"), config).select("*", F.col("score").alias("rule_score"), F.bround("_coverage", 2).alias("rule_coverage"))
    return rows.select(*[c for c in pairs.columns if c not in ("profile", "llm")], "rule_score", "rule_coverage")


def _judged(pairs: DataFrame, config: MatchConfig) -> DataFrame:
    """All that a score rests on, the score, and the requirements."""
    have = set(pairs.columns)
    rows = pairs
    for name, kind in (("profile", PROFILE), ("llm", LLM), ("candidate_ctc", "double"), ("candidate_experience", "double")):
        if name not in have:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    p, m, v = F.col("profile"), F.col("llm"), F.col("v")
    prepared = set(rows.schema["v"].dataType.fieldNames()) >= {"terms", "skill_keys"}
    keys_of = lambda terms, ready: v[ready] if prepared else F.transform(_or_none(v[terms]), term_key)
    skill_keys, keyword_keys = keys_of("required_skills", "skill_keys"), keys_of("preferred_keywords", "keyword_keys")
    technology_keys, responsibility_keys = keys_of("technologies", "technology_keys"), keys_of("responsibilities", "responsibility_keys")
    education, certification = or_null(v["education_requirements"]), or_null(v["certifications"])
    enriched = bool({"profile", "llm"} & have)
    role = F.col("cv_role")
    ends = {"cv_found", "cv_domains", *ENDS} <= have
    if enriched or "cv_found" not in have:  # otherwise terms have been looked up once per CV
        if not ends and not have.issuperset(FEATURES):
            rows = with_features(rows)
        lower, domain = F.col("cv_tail" if ends else "cv_lower"), F.col("cv_part_domains" if ends else "cv_domain")
        if enriched:
            role = F.coalesce(or_null(p["current_role"]), role)
            added = F.concat(_or_none(p["core_skills"]), _or_none(p["inferred_skills"]), _or_none(p["professional_domains"]), F.array(p["current_role"]), _or_none(p["education_domains"]), _or_none(p["certifications"]))
            lower = F.concat_ws(" ", lower, or_null(F.lower(F.array_join(F.filter(added, lambda x: x != ""), " "))))
            known = F.concat(F.array(role, p["current_role"]), _or_none(p["core_skills"]), _or_none(p["inferred_skills"]), _or_none(p["professional_domains"]), _or_none(m["inferred_skills"]), _or_none(m["matched_skills"]))
            domain = domain_text(known if ends else F.concat(known, F.col("cv_parts")))
        rows = rows.select("*", lower.alias("_text"), domain.alias("_domain_text"))
        stated = F.transform(F.filter(F.array(education, certification), lambda x: x.isNotNull()), term_key)
        asked = F.array_distinct(F.concat(skill_keys, keyword_keys, technology_keys, responsibility_keys, stated))
        found = F.filter(asked, lambda k: (k != "") & has_key(F.col("_text"), k))
        domains = F.filter(v["dept_terms"], lambda t: has_word(F.col("_domain_text"), t))
        if ends:
            plain = p.isNull() & m.isNull()
            found = F.when(plain, F.col("cv_found")).otherwise(F.concat("cv_found", found))
            domains = F.when(plain, F.col("cv_domains")).otherwise(F.concat("cv_part_domains", domains))
        rows = rows.select(*[c for c in rows.columns if c not in ("cv_found", "cv_domains", "_text", "_domain_text")], found.alias("cv_found"), domains.alias("cv_domains"))
    rows = rows.select(*[c for c in rows.columns if c != "candidate_experience"], F.coalesce(F.col("candidate_experience").cast("double"), p["relevant_experience_years"]).alias("candidate_experience"), role.alias("_current"))
    required, preferred = _or_none(v["required_skills"]), _or_none(v["preferred_keywords"])
    holds = lambda key: F.array_contains(F.col("cv_found"), key)
    matched = lambda terms, keys: F.filter(terms, lambda t, k: holds(F.get(keys, k)))
    missing = lambda terms, keys: F.filter(terms, lambda t, k: (F.get(keys, k) != "") & ~holds(F.get(keys, k)))
    rows = rows.select(
        "*",
        matched(required, skill_keys).alias("_matched"),
        missing(required, skill_keys).alias("_missing"),
        matched(preferred, keyword_keys).alias("matched_keywords"),
        missing(preferred, keyword_keys).alias("missing_keywords"),
    )
    extra = _or_none(m["matched_skills"])
    added = F.array_distinct(F.filter(extra, lambda x: ~F.array_contains(F.col("_matched"), x)))
    first_gone = F.filter(F.transform(F.col("_missing"), lambda x, k: F.when(~(F.array_contains(extra, x) & (F.array_position(F.col("_missing"), x) == k + 1)), x)), lambda x: x.isNotNull())
    rows = rows.select("*", F.concat("_matched", added).alias("matched_skills"), first_gone.alias("missing_skills"))

    exp, ctc, low, high, budget = F.col("candidate_experience"), F.col("candidate_ctc").cast("double"), v["min_experience_years"], v["max_experience_years"], v["max_ctc"]
    has_education = F.coalesce(holds(term_key(education)), F.lit(False)) | (F.size(_or_none(p["education_domains"])) > 0)
    has_certification = F.coalesce(holds(term_key(certification)), F.lit(False)) | (F.size(_or_none(p["certifications"])) > 0)

    # The sentences of requirements, evidence and failures below are what callers compare.
    def skill(s: Column) -> Column:
        ok = F.array_contains("matched_skills", s)
        cv = F.when(ok, _join("CV contains skill: '", s, "'")).otherwise(_join("CV missing explicit mention of skill: '", s, "'"))
        why = F.when(~ok, _join("Mandatory skill '", s, "' is not present in CV."))
        return _requirement(_slug("req_skill_", s), _join("Skill: ", s), "MANDATORY", _status(ok), cv, _join("Mandatory Skill Requirement: ", s), why)

    def keyword(k: Column) -> Column:
        ok = F.array_contains("matched_keywords", k)
        cv = F.when(ok, _join("CV mentions preferred keyword: '", k, "'")).otherwise(_join("CV missing preferred keyword: '", k, "'"))
        why = F.when(~ok, _join("Preferred keyword '", k, "' not mentioned in CV."))
        return _requirement(_slug("pref_keyword_", k), _join("Preferred Keyword: ", k), "PREFERRED", _status(ok), cv, _join("Preferred Keyword: ", k), why)

    def stated(kind: str, wanted: Column, ok: Column) -> Column:
        """A mandatory education or certification."""
        small = kind.lower()
        cv = F.when(ok, _join(f"CV contains {small} matching '", wanted, "'")).otherwise(_join(f"CV does not show required {small} '", wanted, "'"))
        why = F.when(~ok, _join(f"Mandatory {small} '", wanted, "' not found in CV."))
        return _requirement(F.lit(f"req_{small}"), _join(f"{kind}: ", wanted), "MANDATORY", _status(ok), cv, _join(f"Mandatory {kind} Requirement: ", wanted), why)

    enough = exp >= low
    least = _requirement(
        F.lit("req_min_experience"),
        _join("Minimum Experience: ", _text(low), " years"),
        "MANDATORY",
        _status(enough),
        _join("Candidate has ", _text(exp), " years of experience (", F.when(enough, "meets").otherwise("below"), " mandatory ", _text(low), " years)"),
        _join("Mandatory Minimum Experience: ", _text(low), " years"),
        F.when(~enough, _join("Candidate experience (", _text(exp), " yrs) is below mandatory minimum (", _text(low), " yrs).")),
    )
    over_budget = _requirement(
        F.lit("req_max_ctc"),
        _join("Max CTC Budget: ", _text(budget)),
        "MANDATORY",
        F.lit("FAILED"),
        _join("Candidate CTC expectation (", _text(ctc), ") exceeds budget max (", _text(budget), ")"),
        _join("Mandatory Maximum Budget CTC: ", _text(budget)),
        _join("Candidate CTC (", _text(ctc), ") exceeds vacancy maximum budget (", _text(budget), ")."),
    )
    within = exp <= high
    most = _requirement(
        F.lit("pref_max_experience"),
        _join("Max Experience: ", _text(high), " years"),
        "PREFERRED",
        _status(within, "PARTIALLY_SATISFIED"),
        F.when(within, _join("Candidate experience ", _text(exp), " years is within preferred upper bound (", _text(high), " years)")).otherwise(_join("Candidate experience ", _text(exp), " years exceeds preferred upper bound (", _text(high), " years)")),
        _join("Preferred Upper Bound Experience: ", _text(high), " years"),
        F.when(~within, _join("Candidate experience exceeds preferred upper limit (", _text(high), " years).")),
    )
    knows_low, knows_high = low.isNotNull() & exp.isNotNull(), high.isNotNull() & exp.isNotNull()
    rows = rows.select(
        "*",
        F.concat(
            F.transform(required, skill),
            _only(knows_low, least),
            _only(education.isNotNull(), stated("Education", education, has_education)),
            _only(certification.isNotNull(), stated("Certification", certification, has_certification)),
            _only(ctc > budget, over_budget),
        ).alias("mandatory_requirements"),
        F.concat(F.transform(preferred, keyword), _only(knows_high, most)).alias("preferred_requirements"),
    )
    all_of = F.concat("mandatory_requirements", "preferred_requirements")
    failed = F.filter("mandatory_requirements", lambda r: r["status"] == "FAILED")

    def criterion(r: Column) -> Column:
        """How a requirement is named among matched and missing criteria."""
        i, d = r["requirement_id"], r["description"]
        rest = F.regexp_replace(d, "^[^:]*: ", "")
        return (
            F.when(i == "req_max_ctc", _join("CTC Budget (Exceeds max ", rest, ")"))
            .when(i.isin("req_min_experience", "pref_max_experience", "req_education", "req_certification"), _join(F.regexp_extract(d, "^([^:]*): ", 1), " (", rest, ")"))
            .when(r["tier"] == "MANDATORY", _join("Mandatory ", d))
            .otherwise(d)
        )

    rows = rows.select(
        "*",
        F.transform(F.filter(all_of, lambda r: r["status"] == "SATISFIED"), criterion).alias("matched_criteria"),
        F.transform(F.filter(all_of, lambda r: r["status"] == "FAILED"), criterion).alias("_absent"),
        F.transform(failed, lambda r: F.struct(r["requirement_id"].alias("requirement_id"), r["description"].alias("description"), r["failure_reason"].alias("reason"), F.lit(config.failure_penalty).alias("score_impact"))).alias("mandatory_failures"),
        F.transform(all_of, lambda r: r["requirement_id"]).alias("_ids"),
        all_of.alias("_all"),
    )
    title = or_null(v["title"])
    now, then = F.lower(strip(F.col("_current"))), F.lower(strip(title))
    shared = F.array_except(F.array_intersect(words_of(now), words_of(then)), strings(SENIORITY_WORDS))
    transition = F.coalesce((F.size(shared) == 0) & (now != then), F.lit(False))
    note = _join("Dynamic career transition detected: Current role '", F.col("_current"), "' to Target role '", title, "'.", F.coalesce(_join(" LLM analysis: ", or_null(m["career_transition_note"])), F.lit("")))
    ratio = lambda keys: F.when(F.size(keys) > 0, F.size(F.filter(keys, holds)) / F.size(keys) * 100.0)
    below = F.when((exp < low) & (low > 0), exp / low * 50.0).otherwise(100.0)
    experience = F.when(low.isNotNull() | high.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), below - F.when(exp > high, 20.0).otherwise(0.0))))
    total = F.size(required) + F.size(preferred)
    department = F.coalesce(or_null(v["department_name"]), or_null(v["department"]))
    in_domain = F.exists(v["dept_terms"], lambda t: F.array_contains(F.col("cv_domains"), t))
    components = {
        "role": F.when(transition, 50.0).otherwise(100.0),
        "skills": F.when(total > 0, (F.size("matched_skills") + F.size("matched_keywords")) / total * 100.0),
        "experience": experience,
        "education": F.when(education.isNotNull(), F.when(has_education, 100.0).otherwise(0.0)),
        "domain": F.when(department.isNotNull(), F.when(in_domain, 100.0).otherwise(50.0)),
        "technology": ratio(technology_keys),
        "certification": F.when(certification.isNotNull(), F.when(has_certification, 100.0).otherwise(0.0)),
        "responsibilities": ratio(responsibility_keys),
    }
    rows = rows.select("*", transition.alias("career_transition_detected"), F.when(transition, note).alias("career_transition_note"), *[components[c].alias(f"_{c}") for c in COMPONENTS])
    weighted, active = F.lit(0.0), F.lit(0.0)
    for c in COMPONENTS:
        w = float(config.weights[c])
        weighted = weighted + F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}") * w).otherwise(0.0)
        active = active + F.when(F.col(f"_{c}").isNotNull(), w).otherwise(0.0)
    full = sum(float(w) for w in config.weights.values())
    boost = F.when(m["semantic_fit_score"] != 0, F.least(F.lit(config.llm_max_boost), m["semantic_fit_score"] * config.llm_weight)).otherwise(0.0)
    rows = rows.select("*", (F.when(active > 0, weighted / active).otherwise(0.0) + F.coalesce(boost, F.lit(0.0))).alias("_raw"), (active / full).alias("_coverage"))
    # Counted without the requirements' sentences, so that a score alone needs none of them.
    number = lambda condition: F.when(condition, 1).otherwise(0)
    lacks = lambda held: lambda t: ~F.coalesce(F.array_contains(held, t), F.lit(False))
    unmet = [number(knows_low & ~enough), number(education.isNotNull() & ~has_education), number(certification.isNotNull() & ~has_certification), number(ctc > budget)]
    rows = rows.select("*", sum(unmet, F.size(F.filter(required, lacks("matched_skills")))).alias("_n_failed"), F.exists(preferred, lacks("matched_keywords")).alias("_unwanted"))
    n_failed = F.col("_n_failed")
    kept = F.bround(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("_raw"))), 1)
    flawed = (F.coalesce(F.col("_skills"), F.lit(100.0)) < 100.0) | (n_failed > 0) | F.col("_unwanted") | (F.coalesce(F.col("_domain"), F.lit(100.0)) < 100.0)
    punished = F.bround(F.greatest(F.lit(0.0), F.least(F.col("_raw") - n_failed * config.failure_penalty, F.lit(config.failure_cap))), 1)
    score = F.when(n_failed > 0, punished).when((kept >= 100.0) & flawed, 99.0).otherwise(kept)
    return rows.select("*", score.alias("score"))


def _told(rows: DataFrame, config: MatchConfig) -> DataFrame:
    """The scored rows as callers see them."""
    p, m, v = F.col("profile"), F.col("llm"), F.col("v")
    department = F.coalesce(or_null(v["department_name"]), or_null(v["department"]))
    low_coverage, n_failed = F.col("_coverage") < 0.5, F.col("_n_failed")
    high, medium = F.col("score") >= config.high_threshold, F.col("score") >= config.medium_threshold
    failures = F.array_join(F.transform("mandatory_failures", lambda f: _join(f["description"], " (", f["reason"], ")")), "; ")
    reason = F.when(n_failed > 0, _join("Mandatory requirement failure(s): ", failures)).otherwise(_join("All mandatory requirements satisfied. Overall match score is ", _text(F.col("score")), "%."))
    note = F.when(low_coverage, _join(" | Note: Low match coverage (", _text((F.col("_coverage") * 100).cast("int")), "%).")).otherwise("")
    rounded = lambda c: F.coalesce(F.bround(F.col(c), 1), F.lit(0.0))
    last = F.transform(F.array_distinct("_ids"), lambda i: F.struct(i.alias("key"), F.element_at(F.filter("_all", lambda r: r["requirement_id"] == i), -1)["evidence"].alias("value")))
    distinct = F.size(F.array_distinct("_ids"))
    #: Recommendations.
    texts = {
        "underspecified": "Low Confidence Match — Requires HR verification (Vacancy is underspecified).",
        "strong": "Strong candidate — proceed to interview.",
        "potential": "Potential match — HR review recommended.",
        "weak": "Significant requirements missing — Manual HR review required (never auto-rejected).",
    }
    internal = {"_current", "cv_found", "cv_domains", "_matched", "_missing", "_absent", "_ids", "_all", "_raw", "_coverage", "_n_failed", "_unwanted", "v", "cv_role", *TEXTS, *ENDS, "profile", "llm", "score", *(f"_{c}" for c in COMPONENTS)}
    made = {"matched_skills", "missing_skills", "matched_keywords", "missing_keywords", "mandatory_requirements", "preferred_requirements", "matched_criteria", "mandatory_failures", "career_transition_detected", "career_transition_note"}
    carried = [c for c in rows.columns if c not in internal | made]
    return rows.select(
        *carried,
        F.coalesce(or_null(v["id"]), v["vacancy_id"].cast("string")).alias("job_id"),
        v["title"].alias("job_title"),
        v["department"].alias("department"),
        v["vacancy_id"].alias("vacancy_id"),
        v["job_profile_id"].alias("job_profile_id"),
        v["company_id"].alias("company_id"),
        v["department_id"].alias("department_id"),
        department.alias("department_name"),
        v["location_id"].alias("location_id"),
        "score",
        F.col("score").alias("overall_score"),
        *[rounded(f"_{c}").alias(f"{c}_score") for c in COMPONENTS],
        F.bround(F.col("_coverage"), 2).alias("coverage"),
        F.when(low_coverage, "LOW").when(high, "HIGH").when(medium, "MEDIUM").otherwise("LOW").alias("classification"),
        F.when(low_coverage, texts["underspecified"]).when(high, texts["strong"]).when(medium, texts["potential"]).otherwise(texts["weak"]).alias("recommendation"),
        "matched_skills",
        "missing_skills",
        "matched_keywords",
        "missing_keywords",
        "mandatory_requirements",
        "preferred_requirements",
        F.filter("mandatory_requirements", lambda r: F.lit(False)).alias("optional_requirements"),
        "matched_criteria",
        F.concat("_absent", _only(low_coverage, F.lit("LOW_COVERAGE: Vacancy has poorly defined requirements."))).alias("missing_criteria"),
        F.map_from_entries(last).alias("evidence"),
        "mandatory_failures",
        F.when(F.size("_ids") > 0, F.bround(distinct / F.size("_ids"), 2)).otherwise(1.0).alias("confidence"),
        ((n_failed > 0) | (F.col("score") < config.high_threshold)).alias("hr_review_required"),
        F.concat(reason, note).alias("reason"),
        "career_transition_detected",
        "career_transition_note",
        F.coalesce(m["semantic_reason"], F.lit("")).alias("llm_reason"),
        F.coalesce(m["inferred_skills"], p["inferred_skills"], _none()).alias("inferred_skills"),
    )
