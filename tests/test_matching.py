"""Scores worked out by hand from the rules, on small CVs."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from lodestar.config import MatchConfig, upsert_config
from lodestar.functions import enrichment, text
from lodestar.operators import catalog, prefilter, rank, score, term_index
from lodestar.plans import matching
from lodestar.sources import versions

KINDS = "id string, title string, department string, required_skills array<string>, preferred_keywords array<string>, min_experience_years double"


def vacancies(spark, *rows):
    return catalog.conform(spark.createDataFrame(list(rows), KINDS))


def scored(spark, cv, job, experience=None, config=MatchConfig()):
    cvs = spark.createDataFrame([("a", cv, experience)], "cv_key string, cv_text string, candidate_experience double")
    return matching.match_rules(cvs, vacancies(spark, job), config).first()


PYTHON = ("j1", "Senior Python Developer", "Engineering", ["Python", "Docker", "Kubernetes"], ["Git", "CI/CD"], 5.0)


@pytest.mark.parametrize(
    ("cv", "job", "experience", "expected", "band"),
    [
        ("## Senior Python Developer\nSkills: Python, Django, REST API, Git\nExperience: 10 years", PYTHON, 10.0, 38.6, "LOW"),
        ("## Python Developer\nSkills: Python", ("j", "Python Developer", "Engineering", ["Python"], ["Git", "Docker", "Agile", "Redis"], 2.0)[:3] + (["Python"], ["Python", "Docker", "Agile", "Redis"], 2.0), 4.0, 78.6, "HIGH"),
        ("## Python Developer\nSkills: Python, Git", ("j", "Python Developer", "Engineering", ["Python"], ["Git"], 2.0), 4.0, 100.0, "HIGH"),
        ("## Backend Developer\nSkills: Python, Git", ("j", "Python Developer", "Engineering", ["Python"], ["Git"], 2.0), 4.0, 89.3, "HIGH"),
        ("## ICU Nurse\nSkills: patient care", ("j", "ICU Nurse", "Healthcare", ["patient care"], [], 1.0), 8.0, 100.0, "HIGH"),
    ],
)
def test_golden_scores(spark, cv, job, experience, expected, band):
    row = scored(spark, cv, job, experience)
    assert row.score == pytest.approx(expected)
    assert row.classification == band
    assert row.hr_review_required == (bool(row.mandatory_failures) or row.score < 70)


def test_underspecified(spark):
    row = scored(spark, "## Cook\nhello", ("j", "Cook", "Kitchen", [], [], None))
    assert (row.score, row.classification, row.coverage) == (75.0, "LOW", 0.3)
    assert row.missing_criteria == ["LOW_COVERAGE: Vacancy has poorly defined requirements."]
    assert row.reason.endswith("Note: Low match coverage (30%).")


def test_evidence_and_failures(spark):
    row = scored(spark, "## Senior Python Developer\nSkills: Python", PYTHON, 3.0)
    assert {f.requirement_id for f in row.mandatory_failures} == {"req_skill_docker", "req_skill_kubernetes", "req_min_experience"}
    assert row.evidence["req_skill_python"].cv_evidence == "CV contains skill: 'Python'"
    assert "Candidate experience (3.0 yrs) is below mandatory minimum (5.0 yrs)." in row.reason
    assert row.score <= 65


def test_config_replaces_weights_whole(spark):
    with pytest.raises(KeyError):
        scored(spark, "x", PYTHON, config=MatchConfig().updated(weights={"role": 1.0}))


def test_prefilter_order_and_short_circuit(spark):
    cvs = spark.createDataFrame([("a", "python developer in engineering", None)], "cv_key string, cv_text string, candidate_experience double")
    jobs = vacancies(spark, ("1", "Python Developer", "Engineering", ["python"], [], None), ("2", "Java Developer", "Sales", ["java"], ["python"], None), ("3", "Designer", "Art", ["figma"], [], None))
    rows = [(r.v.id, r.prefilter_score) for r in prefilter.prefilter(cvs, jobs, 2).orderBy("input_rank").collect()]
    assert rows == [("1", 55.0), ("2", 5.0)]
    assert [r.v.id for r in prefilter.prefilter(cvs, jobs, 5).orderBy("input_rank").collect()] == ["1", "2", "3"]


def test_symbol_terms(spark):
    df = spark.createDataFrame([("c++ and node.js, go_lang c#",), ("c++. skills:c++x",)], "t string")
    got = df.select(*[text.has_term(F.col("t"), F.lit(k)).alias(k) for k in ("C++", "Node.js", "go", "c#", "c")]).collect()
    assert tuple(got[0]) == (True, True, True, True, True)
    assert got[1][0] is False


def test_skill_section_ends_scan(spark):
    cv = "## Profile\nPhone: 1\n## Skills\nPython\nGo\n## Work\nTool: x"
    assert spark.createDataFrame([(cv,)], "t string").select(text.skill_lines(F.col("t")).alias("x")).first().x == ["Phone: 1", "Python", "Go"]


def test_skill_lines_line_by_line(spark):
    """All orders of a few kinds of lines, against a scan that goes line by line."""
    kinds = ["## Skills", "- s k i l l s ", "## Work", "Tool: x", "plain", "  ", "## a: b"]
    texts = ["\n".join(x) for n in range(5) for x in itertools.product(kinds, repeat=n)]

    def plainly(cv):
        out, inside = [], False
        for line in (x.strip() for x in cv.split("\n")):
            if not line:
                continue
            if re.sub(r"\s+", "", re.sub(r"^[#\- ]+", "", line)).lower() == "skills":
                inside = True
            elif inside and line.startswith("##"):
                break
            elif inside or re.match(r"[\w /&+\-.#]+:\s*\S+", line):
                out.append(line)
        return out

    rows = spark.createDataFrame([(x,) for x in texts + [None]], "t string").select("t", text.skill_lines(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in rows} == {**{x: plainly(x) for x in texts}, None: None}


def test_skill_terms_and_fit(spark):
    d = "Knowledge of SQL, including Spark and Kafka (e.g. streams)\n- skills"
    df = spark.createDataFrame([(d, "aa, bb, cc")], "d string, v string")
    row = df.select(text.skill_terms(F.col("d")).alias("s"), text.fit_terms(F.col("v"), 7).alias("f"), text.fit_terms(F.col("v"), 1).alias("g")).first()
    assert row.s == "SQL, Spark, Kafka, e.g. streams" and row.f == "aa, bb" and row.g == "a"


def test_keys(spark):
    df = spark.createDataFrame([("my resume.pdf", 101, 501), ("resume.pdf", 101, None), ("resume.pdf", None, 501), ("john doe.cv.pdf", None, None)], "f string, a long, b long")
    assert [r[0] for r in df.select(text.content_key(F.col("f"), F.col("a"), F.col("b"))).collect()] == ["cand_101_cv_501", "cand_101_resume", "cv_501_resume", "cv_john_doe_cv"]


def test_gate_and_enrichment(spark, tmp_path):
    cvs = spark.createDataFrame([("a", "## Cook\nwriter of prose", 1.0), ("b", "## Python Developer\nPython Git", 4.0)], "cv_key string, cv_text string, candidate_experience double")
    jobs = vacancies(spark, ("1", "Python Developer", "Engineering", ["Python"], ["Git"], 2.0), ("2", "Nurse", "Healthcare", ["icu"], [], None))
    log = tmp_path / "calls"

    def enricher(prompt):
        with open(log, "a") as f:
            f.write("Cook" if "Cook" in prompt else "other")
            f.write("\n")
        return '```json\n{"candidate_profile": {"core_skills": ["icu"], "current_role": "Nurse"}, "matched_vacancies": [{"vacancy_id": "2", "semantic_reason": "ok", "semantic_fit_score": 90.0}]}\n```'

    rows = {(r.cv_key, r.job_id): r for r in matching.match_two_stage(cvs, jobs, enricher=enricher).collect()}
    assert rows["b", "1"].llm_skipped and rows["b", "1"].llm_reason == ""
    assert not rows["a", "2"].llm_skipped and rows["a", "2"].llm_reason == "ok" and rows["a", "2"].score == 100.0
    assert log.read_text() == "Cook\n"


def test_answers_meet_pairs_without_texts(spark, monkeypatch):
    """Texts are read once, no pairs are written, and a term across the end of a text and its answer counts."""
    monkeypatch.setattr(matching, "kept", None)
    ends = ["we hire a data", "no word here", "c", "data analyst", "x" * 200, "python\n"]
    cvs = spark.createDataFrame([(str(k), f"## Cook\nLabel: src\n{'prose ' * (k % 2 * 60)}{e}", 1.0) for k, e in enumerate(ends)], "cv_key string, cv_text string, candidate_experience double")
    jobs = vacancies(spark, ("1", "Nurse", "src", ["data analyst", "c++"], ["python"], 2.0), ("2", "Cook", "Finance", ["hire a data analyst"], [], None))
    profiles = [(str(k), '{"candidate_profile": {"core_skills": ["Analyst", "++"]}, "matched_vacancies": [{"vacancy_id": "2", "semantic_reason": "a"}, {"vacancy_id": "2", "semantic_reason": "b"}]}') for k in range(5)]
    out = matching.match_two_stage(cvs, jobs, MatchConfig(skip_margin=1000.0), spark.createDataFrame(profiles, "cv_key string, response string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join" in line for line in plan.splitlines()) == 2 and plan.count("LogicalRDD") <= 4
    got = {(r.cv_key, r.job_id): (r.matched_skills, r.llm_reason) for r in out.collect()}
    assert got["0", "1"] == (["data analyst"], "") and got["0", "2"] == (["hire a data analyst"], "b")
    assert got["1", "1"] == ([], "") and got["2", "1"] == ([], "") and got["3", "1"] == (["data analyst"], "") and got["5", "2"] == ([], "")


def test_enricher_is_asked_once_for_each_cv(spark, tmp_path):
    cvs = spark.range(30).selectExpr("cast(id AS string) AS cv_key", "concat('## Cook\n', id) AS cv_text", "1.0D AS candidate_experience").repartition(4)
    jobs = vacancies(spark, ("1", "Python Developer", "Engineering", ["Python"], ["Git"], 2.0))
    log = tmp_path / "calls"

    def enricher(prompt):
        with open(log, "a") as f:
            f.write("x\n")
        return '{"candidate_profile": {"core_skills": ["Python"]}, "matched_vacancies": []}'

    out = matching.match_two_stage(cvs, jobs, enricher=enricher)
    assert out.count() == 30 and out.where("size(matched_skills) = 1").count() == 30
    assert len(log.read_text().split()) == 30


def test_enrichment_goes_on_where_it_was_killed(spark, tmp_path):
    """A run that dies midway; the next one asks what is open, once, and a third one nothing."""
    asked = spark.createDataFrame([(f"cv{k}", f"key{k % 30}", f"prompt {k % 30}") for k in range(40)], "cv_key string, cache_key string, prompt string")
    calls, path = tmp_path / "calls", str(tmp_path / "answers")

    def enricher(dies):
        def answer(prompt):
            with open(calls, "a") as f:
                f.write(f"{prompt}\n")
            if dies and len(calls.read_text().splitlines()) > 15:
                raise SystemExit(1)
            return None if prompt == "prompt 7" else f"answer to {prompt}"

        return answer

    options = {"path": path, "batch": 5, "at_once": 1}
    with pytest.raises(Exception):
        enrichment.answer_in_turn(asked, enricher(True), **options)
    done = {r.cache_key for r in versions.read(spark, path, "cache_key", enrichment.CACHE).collect()}
    assert 0 < len(done) <= 15
    before = len(calls.read_text().splitlines())
    rows = enrichment.answer_in_turn(asked, enricher(False), **options)
    again = calls.read_text().splitlines()[before:]
    assert len(again) == len(set(again)) == 30 - len(done) and not {p.replace("prompt ", "key") for p in again} & done
    assert {r.cv_key: r.response for r in rows.collect()} == {f"cv{k}": f"answer to prompt {k % 30}" for k in range(40) if k % 30 != 7}
    assert enrichment.answer_in_turn(asked, enricher(False), **options).count() == rows.count()
    assert calls.read_text().splitlines()[before + len(again) :] == ["prompt 7"]  # only what has no answer is asked again


def test_pairs_are_scored_once(spark):
    """The plan has one scoring expression; an inner generator would repeat it as a condition of the join."""
    cvs = spark.createDataFrame([("a", "python developer", 3.0)], "cv_key string, cv_text string, candidate_experience double")
    more = spark.createDataFrame([(k, f"t{k}", "d", ["python"], ["git"]) for k in range(9)], "vacancy_id long, title string, department string, required_skills array<string>, preferred_keywords array<string>")
    pairs = prefilter.prefilter(score.with_features(matching.as_cvs(cvs)), catalog.conform(more.withColumn("id", F.col("vacancy_id").cast("string"))), 5)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array(transform(") == 1 and pairs.count() == 5


def test_enricher_tries_again_or_gives_up(spark):
    asked = spark.createDataFrame([("a", "k", "flaky"), ("b", "k", "down")], "cv_key string, cache_key string, prompt string")
    tries = {}

    def enricher(prompt):
        tries[prompt] = tries.get(prompt, 0) + 1
        if prompt == "down":
            raise ConnectionError("no service")
        if tries[prompt] < 3:
            raise ValueError("not yet")
        return f"answer {tries[prompt]}"

    assert {r.cv_key: r.response for r in enrichment.answer_with(asked, enricher).collect()} == {"a": "answer 3", "b": None}


def test_rules_alone_score_once(spark):
    cvs = spark.createDataFrame([("a", "## Cook\nprose", 1.0)], "cv_key string, cv_text string, candidate_experience double")
    plan = matching.match_two_stage(cvs, vacancies(spark, PYTHON))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 1 and plan.count("cv_text") < 40


def test_many_vacancies_in_blocks(spark, monkeypatch):
    """Several blocks and slices give the pairs of one block."""
    cvs = spark.createDataFrame([(str(k), f"skill{k} and skill{k + 1} in dept{k % 3}", 1.0) for k in range(20)], "cv_key string, cv_text string, candidate_experience double")
    jobs = vacancies(spark, *[(f"{k}", f"Title{k % 7}", f"dept{k % 3}", [f"skill{k % 23}"], [], None) for k in range(90)])
    featured = score.with_features(matching.as_cvs(cvs))
    want = sorted((r.cv_key, r.v.id, r.input_rank, r.cv_found) for r in prefilter.prefilter(featured, jobs, 4).collect())
    monkeypatch.setattr(prefilter, "BLOCK", 16)
    monkeypatch.setattr(prefilter, "MOST_BYTES", 30_000)
    assert len(prefilter.catalogue_slices(jobs)[0]) > 1
    got = sorted((r.cv_key, r.v.id, r.input_rank, r.cv_found) for r in prefilter.prefilter(featured, jobs, 4).collect())
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert prefilter.all_pairs(featured, jobs).count() == 20 * 90


def test_all_components(spark):
    """Education, certification, technologies and responsibilities count where a vacancy states them."""
    kinds = KINDS + ", education_requirements string, certifications string, technologies array<string>, responsibilities array<string>"
    job = ("1", "Python Developer", "Engineering", ["Python"], [], 2.0, "BSc Computer Science", "AWS", ["Docker", "Kafka"], ["code review", "mentoring"])
    cvs = spark.createDataFrame([("a", "## Python Developer\nPython, Docker, AWS and code review", 4.0)], "cv_key string, cv_text string, candidate_experience double")
    row = matching.match_rules(cvs, catalog.conform(spark.createDataFrame([job], kinds))).first()
    assert (row.education_score, row.certification_score, row.technology_score, row.responsibilities_score, row.coverage) == (0.0, 100.0, 50.0, 50.0, 1.0)
    assert {f.requirement_id for f in row.mandatory_failures} == {"req_education"} and row.score == 62.5
    assert row.confidence == 1.0 and "req_certification" in row.evidence


def test_catalogue_is_kept_until_refreshed(spark):
    reads = []

    def load():
        reads.append(1)
        return vacancies(spark, PYTHON)

    held = catalog.Catalogue(load)
    assert held.vacancies().count() == held.vacancies().count() == 1 and len(reads) == 1
    held.refresh()
    assert len(reads) == 2 and catalog.Catalogue(load, seconds=-1.0).vacancies().count() == 1
    held.invalidate()
    assert held.vacancies().count() == 1 and len(reads) == 4


def test_config_sources(spark):
    table = spark.createDataFrame([("high_threshold", "85.0", 1)], "key string, value string, updated_at int")
    found = MatchConfig.from_sources(table, {"HIGH_THRESHOLD": 60.0, "skip_margin": 9.0, "other": 1})
    assert (found.high_threshold, found.skip_margin, found.medium_threshold) == (85.0, 9.0, 40.0)
    old = table.selectExpr("*", "timestamp'2020-01-01' AS expires_at")
    assert MatchConfig.from_sources(old, {"high_threshold": 60.0}).high_threshold == 60.0


def test_reanalyze(spark):
    results = spark.createDataFrame([("a", "## Python Developer\nPython Git", False), ("a2", "x", True), ("b", "y", False)], "cv_key string, markdown string, enriched boolean").withColumn("match_analysis", F.lit(None).cast("string"))
    ids = spark.createDataFrame([("a",), ("a2",)], "cv_key string")
    rows = matching.reanalyze(results, ids, vacancies(spark, PYTHON)).collect()
    assert [(r.cv_key, r.enriched, r.match_analysis.best_match.job_id) for r in rows] == [("a", True, "j1")]


def test_evidence_digest(spark):
    cvs = spark.createDataFrame([("a", "## Senior Python Developer\nSkills: Python", 3.0)], "cv_key string, cv_text string, candidate_experience double")
    told = matching.match_rules(cvs, vacancies(spark, PYTHON)).select(rank.evidence_digest(F.col("evidence")).alias("t")).first().t
    assert len(told) == 150 and told.startswith("pref_keyword_ci/cd: CV missing preferred keyword: 'CI/CD'; ")


def test_empty_catalogue_and_invalid_cvs(spark):
    cvs = spark.createDataFrame([("a", "text", None), ("b", "  ", None), ("c", "<!-- image -->", None)], "cv_key string, cv_text string, candidate_experience double")
    assert [r.cv_error is None for r in matching.checked(cvs).orderBy("cv_key").collect()] == [True, False, False]
    none = rank.best_matches(cvs, matching.match_rules(cvs, vacancies(spark, PYTHON).limit(0)))
    assert {r.job_title for r in none.collect()} == {"General Role"}
    assert catalog.vacancies_or_default(None, spark).count() == 5


def test_config_table(spark):
    table = spark.createDataFrame([("high_threshold", "70.0", 1), ("high_threshold", "80.0", 2)], "key string, value string, updated_at int")
    changed = upsert_config(table, spark.createDataFrame([("high_threshold", "85.0", 3)], "key string, value string, updated_at int"))
    assert changed.count() == 1 and MatchConfig.from_df(changed).high_threshold == 85.0


def test_cache_key_ignores_order(spark):
    cvs = spark.createDataFrame([("a", "x", None)], "cv_key string, cv_text string, candidate_experience double")
    jobs = vacancies(spark, PYTHON, ("2", "Nurse", "Healthcare", ["icu"], [], None))
    one = enrichment.prompts(prefilter.prefilter(cvs, jobs)).first()
    turned = prefilter.prefilter(cvs, jobs).withColumn("input_rank", -F.col("input_rank"))
    assert enrichment.prompts(turned).first().cache_key == one.cache_key and one.token_estimate == max(1, one.char_count // 4)


def test_score_needs_no_features(spark):
    cvs = spark.createDataFrame([("a", "## Python Developer\nPython Git", 4.0)], "cv_key string, cv_text string, candidate_experience double")
    jobs = vacancies(spark, ("1", "Python Developer", "Engineering", ["Python"], ["Git"], 2.0))
    assert score.score_pairs(prefilter.all_pairs(cvs, jobs)).first().score == 100.0


def _catalogue(spark, n, terms=4000):
    """``n`` generated vacancies with terms of many frequencies, odd ones among them."""
    k = F.col("id")
    word = lambda salt, m: F.concat(F.lit("t"), F.lpad(F.floor(F.pow(F.pmod(F.xxhash64(k, F.lit(salt)), 1000003) / 1000003.0, 2) * m).cast("string"), 4, "0"))
    return spark.range(n).select(
        k.alias("vacancy_id"),
        k.cast("string").alias("id"),
        F.concat(F.lit("Title "), word(1, 300)).alias("title"),
        F.when(k % 50 != 0, F.concat(F.lit("Dept"), k % 97)).alias("department"),
        F.when(k % 41 != 0, F.array(word(2, terms), word(3, terms), F.concat(word(4, terms), F.lit(" "), word(5, 40)), F.when(k % 60 == 0, "").otherwise("C++"), F.when(k % 7 == 0, "go").otherwise("Ünï"))).alias("required_skills"),
        F.array(word(6, terms), word(2, terms)).alias("preferred_keywords"),
        F.when(k % 3 != 0, (k % 5).cast("double")).alias("min_experience_years"),
        F.when(k % 4 != 0, (5 + k % 9).cast("double")).alias("max_experience_years"),
    )


def _generated_cvs(spark, n):
    k = F.col("id")
    words = F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: F.concat(F.lit("T"), F.lpad(F.pmod(F.xxhash64(k, i), 4000).cast("string"), 4, "0")))
    text = F.when(k == 0, None).when(k == 1, "").otherwise(F.concat(F.lit("## Title t0005\nSkills: Dept"), k % 97, F.lit(" c++ ÜNÏ "), F.array_join(words, " ")))
    return spark.range(n).select(k.cast("string").alias("cv_key"), text.alias("cv_text"), F.when(k % 5 != 0, (k % 12).cast("double")).alias("candidate_experience"))


def _plainly(cv, experience, v):
    """The pre-filter's points, as the rules say it."""
    held = lambda terms: sum(t in cv for t in terms if t is not None) if cv is not None else 0
    fits = experience is not None and (v.min_experience_years is None or experience >= v.min_experience_years) and (v.max_experience_years is None or experience <= v.max_experience_years)
    return 30.0 * held([v.dept_lower] if v.dept_lower else []) + 15.0 * held(v.title_terms) + 10.0 * held(v.skills_lower) + 5.0 * held(v.keywords_lower) + 10.0 * fits


@pytest.mark.parametrize("way", ["scan", "index", "slices"])
def test_best_vacancies_equal_full_scan(spark, monkeypatch, way):
    jobs = catalog.conform(_catalogue(spark, 700))
    cvs = _generated_cvs(spark, 25)
    if way == "scan":
        monkeypatch.setattr(prefilter, "INDEXED", 700)
    if way == "slices":
        monkeypatch.setattr(prefilter, "BLOCK", 100)
        monkeypatch.setattr(prefilter, "MOST_BYTES", 120_000)
        assert len(prefilter.catalogue_slices(jobs)[0]) > 1
    got = {}
    for r in prefilter.prefilter(cvs, jobs, 5).select("cv_key", "input_rank", "prefilter_score", "v.ordinal").collect():
        got.setdefault(r.cv_key, []).append((r.input_rank, r.prefilter_score, r.ordinal))
    vs = catalog.prepared(jobs).collect()
    for cv in cvs.select("*", F.lower("cv_text").alias("low")).collect():
        full = sorted((-_plainly(cv.low, cv.candidate_experience, v), v.ordinal) for v in vs)[:5]
        assert sorted(got[cv.cv_key]) == [(i, -s, o) for i, (s, o) in enumerate(full, 1)]


def test_few_vacancies_are_scored(spark):
    """Of 50,000 vacancies under a tenth are looked at, and the best are those of a full scan."""
    jobs, cvs = catalog.conform(_catalogue(spark, 50_000)), _generated_cvs(spark, 6)
    slices, n = prefilter.catalogue_slices(jobs, 5, index=True)
    assert n == 50_000
    looked, tops = {}, {}
    for number, packed in slices:
        rows = cvs.select("*", F.lower("cv_text").alias("low"), F.explode(F.sequence(F.lit(number), F.lit(number))).alias("block")).join(packed, "block")
        rows = term_index.best(term_index.hits(rows, F.col("low")), F.col("candidate_experience"), 5)
        for r in rows.select("cv_key", "_scored", F.transform("_top", lambda x: F.struct(x["s"], F.get("vacs", x["k"])["ordinal"].alias("o"))).alias("top")).collect():
            looked[r.cv_key] = looked.get(r.cv_key, 0) + r._scored
            tops[r.cv_key] = sorted(tops.get(r.cv_key, []) + [(x.s, x.o) for x in r.top])[:5]
    assert sum(looked.values()) < 6 * n / 10
    vs = catalog.prepared(jobs).select("ordinal", "dept_lower", "title_terms", "skills_lower", "keywords_lower", "min_experience_years", "max_experience_years").collect()
    for cv in cvs.select("*", F.lower("cv_text").alias("low")).collect():
        assert tops[cv.cv_key] == sorted((-_plainly(cv.low, cv.candidate_experience, v), v.ordinal) for v in vs)[:5]


def test_terms_found_by_dictionary(spark):
    """All pairs look terms up in the dictionary: what is found is what each term's own pattern finds."""
    jobs = catalog.conform(_catalogue(spark, 300, 200))
    cvs = score.with_features(matching.as_cvs(_generated_cvs(spark, 12)))
    got = {r.cv_key: set(r.cv_found) for r in prefilter.all_pairs(cvs, jobs).select("cv_key", "cv_found").collect()}
    terms = catalog.prepared(jobs).select(F.explode("terms").alias("t")).distinct()
    want = cvs.join(terms, text.has_key(F.col("cv_lower"), F.col("t"))).groupBy("cv_key").agg(F.collect_set("t").alias("f")).collect()
    assert {r.cv_key: set(r.f) for r in want} == {k: f for k, f in got.items() if f} and len(want) == 10
