"""Registered queries for catalogue upkeep, the store, enrichment answers and ingestion, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import alive, with_expiry
from .functions import enrichment, text
from .operators import catalog, prefilter, rank
from .plans import matching
from .queries import _CVS, _REQUESTS, _STAGED, _cvs, _dimension, _found, _requests, _results, _sql_list, _table, _vacancies, query
from .sources import files, store, text_search, versions
from .streaming import ingest


@query("SELECT p_partkey::VARCHAR AS id, p_name AS title FROM part WHERE p_partkey = 77")
def vacancy_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select(F.concat(F.lit("x"), "p_partkey").alias("id"), F.col("p_partkey").alias("vacancy_id"), F.col("p_name").alias("title"))
    return catalog.vacancy(catalog.conform(rows), "77").select(F.col("vacancy_id").cast("string").alias("id"), "title")


@query(
    f"""WITH {_REQUESTS} SELECT id::VARCHAR AS id, array_to_string(list_filter(list_transform(string_split(skills, ','), lambda x: trim(x)), lambda x: length(x) > 1 AND NOT list_contains({_sql_list(text.GARBAGE_SKILLS)}, lower(x))), '|') AS keywords FROM live"""
)
def preferred_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = _dimension(spark, sf_dir)
    rows = catalog.active_vacancies(_requests(spark, sf_dir), _dimension(spark, sf_dir, True), dim, dim, dim, dim)
    return rows.select("id", F.array_join("preferred_keywords", "|").alias("keywords"))


@query("SELECT event_id, user_id FROM events WHERE epoch(ts) + 3600 > epoch(TIMESTAMP '2024-01-15 00:00:00') UNION ALL SELECT event_id + 1000000000, user_id FROM events WHERE epoch(ts) + 2592000 > epoch(TIMESTAMP '2024-01-15 00:00:00')")
def expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are alive at a moment under the lifetimes of configuration and of enrichment answers."""
    now, rows = F.lit("2024-01-15 00:00:00").cast("timestamp"), _table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("updated_at"))
    config = alive(with_expiry(rows, "config"), now).select("event_id", "user_id")
    answers = alive(with_expiry(rows, "llm"), now)
    return config.unionByName(answers.select((F.col("event_id") + 1_000_000_000).alias("event_id"), "user_id"))


@query("SELECT user_id::VARCHAR AS cache_key, coalesce(arg_max('new' || event_id, event_id) FILTER (event_id % 3 = 0), arg_max('old' || event_id, event_id) FILTER (event_id % 3 = 1)) AS response FROM events GROUP BY user_id HAVING count_if(event_id % 3 < 2) > 0")
def answer_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New answers replace old ones; failures aren't kept."""
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("cache_key"), "event_id")
    last = lambda rest, name: rows.where(F.col("event_id") % 3 == rest).groupBy("cache_key").agg(F.concat(F.lit(name), F.max("event_id")).alias("response"))
    fresh = last(0, "new").unionByName(rows.where("event_id % 3 = 2").select("cache_key", F.lit(None).cast("string").alias("response")))
    return enrichment.cache_with(last(1, "old"), fresh).select("cache_key", "response")


@query("SELECT doc_id::VARCHAR AS cv_key, CASE WHEN doc_id % 2 = 0 THEN 'cached' WHEN doc_id % 5 = 0 THEN NULL ELSE 'asked' END AS response FROM documents")
def answers_from_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a table first; the rest is asked, and some of it stays without an answer."""
    cvs = _cvs(spark, sf_dir).withColumn("cv_text", F.concat(F.lit("key "), "cv_key", F.lit(" end "), "cv_text"))
    cached = cvs.where(F.col("cv_key").cast("long") % 2 == 0).select("cv_key", F.lit("cached").alias("response"))

    def enricher(prompt: str) -> str:
        if int(prompt.split("key ", 1)[1].split(" ", 1)[0]) % 5 == 0:
            raise ConnectionError("no service")
        return "asked"

    return enrichment.enrich(prefilter.prefilter(cvs, _vacancies(spark), 5), enricher, cached).select("cv_key", "response")


@query("SELECT doc_id::VARCHAR AS cv_key, CASE WHEN doc_id % 3 = 0 THEN '101' ELSE '102' END AS vacancy_id, doc_id % 100 + 0.5::DOUBLE AS fit, 'skill ' || lang AS skill FROM documents WHERE doc_id % 4 <> 0")
def answer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers as rows by vacancy: the last of a vacancy counts, and what isn't JSON gives none."""
    docs, k = _table(spark, sf_dir, "documents"), F.col("doc_id")
    vacancy = F.when(k % 3 == 0, "101").otherwise("102")
    one = lambda fit: F.struct(vacancy.alias("vacancy_id"), fit.alias("semantic_fit_score"), F.array(F.concat(F.lit("skill "), "lang")).alias("matched_skills"))
    body = F.to_json(F.struct(F.struct(F.array(F.lit("x")).alias("core_skills")).alias("candidate_profile"), F.array(one(F.lit(1.0)), one(k % 100 + 0.5)).alias("matched_vacancies")))
    answers = docs.select(k.cast("string").alias("cv_key"), F.when(k % 4 == 0, "no answer").otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```"))).alias("response"))
    _, rows = enrichment.enrichment_rows(answers)
    return rows.select("cv_key", F.col("_vacancy").alias("vacancy_id"), F.col("llm.semantic_fit_score").alias("fit"), F.element_at("llm.matched_skills", 1).alias("skill"))


@query(
    f"""WITH {_REQUESTS}, f AS (SELECT req.id, n_name, 'paint ' || n_name || ', ' || lower(n_name) || ' oils, e.g. linseed, Glazing, ' || n_name AS s FROM req JOIN nation ON req.job_profile_id = n_nationkey WHERE trim(skills) = '')
SELECT (SELECT count(*) FROM req WHERE trim(skills) = '')::BIGINT AS blank, (SELECT count(*) FROM f)::BIGINT AS filled, (SELECT string_agg(id || '=' || s, '|' ORDER BY id) FROM (SELECT * FROM f ORDER BY id LIMIT 10)) AS samples"""
)
def backfill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _requests(spark, sf_dir)
    report = catalog.backfill_report(requests, catalog.backfilled(requests, _dimension(spark, sf_dir, True), text.skill_terms))
    return report.select("blank", "filled", F.array_join(F.transform("samples", lambda x: F.concat(x["id"], F.lit("="), x["skills"])), "|").alias("samples"))


@query(
    f"""WITH {_REQUESTS} SELECT req.id, CASE WHEN trim(skills) = '' AND n_nationkey IS NOT NULL THEN left('paint ' || n_name || ', ' || lower(n_name) || ' oils, e.g. linseed, Glazing, ' || n_name, length('paint ' || n_name || ', ' || lower(n_name) || ' oils')) ELSE skills END AS skills
FROM req LEFT JOIN nation ON req.job_profile_id = n_nationkey"""
)
def backfill_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vacancy table with blank skills filled in, as many whole terms as 40 characters hold of three names."""
    requests = _requests(spark, sf_dir)
    found = catalog.backfilled(requests, _dimension(spark, sf_dir, True), text.skill_terms)
    two = F.array_join(F.slice(F.split("skills", ", "), 1, 2), ", ")
    return catalog.apply_backfill(requests, found.withColumn("skills", two), dry_run=False).select("id", "skills")


@query("SELECT 'cv_' || doc_id AS id FROM documents WHERE contains(lower(source || '_' || doc_id || '.pdf'), 'role d') OR contains('cv_' || doc_id, 'role d') OR (doc_id % 6 <> 0 AND (contains(lower(lang), 'role d') OR contains(lower('Role ' || lang), 'role d')))")
def candidate_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.listed(store.summary(_results(spark, sf_dir)), " Role D").select("id")


@query("SELECT count_if(contains(source || '_' || doc_id || '.pdf', 'src1'))::BIGINT AS shown, count(*)::BIGINT AS total FROM documents")
def shown_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.summary(_results(spark, sf_dir))
    return store.shown_of_total(rows, store.listed(rows, "src1"))


@query("SELECT 'cv_' || doc_id AS cv_key, CASE WHEN 'cv_' || doc_id = 'cv_12' THEN 0 ELSE 1 END::INT AS rank FROM documents WHERE contains('cv_' || doc_id, 'cv_12')")
def result_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results whose key contains a text; the exact one, by its file's name, goes first."""
    rows = _results(spark, sf_dir)
    exact = store.lookup(rows, "cv_12.json").select("cv_key", F.lit(0).alias("rank"))
    return exact.unionByName(store.lookup_containing(rows, "cv_12").where("cv_key <> 'cv_12'").select("cv_key", F.lit(1).alias("rank")))


@query("SELECT 'cv_' || min(doc_id) AS cv_key FROM documents WHERE doc_id = (SELECT min_by(doc_id, 'cv_' || doc_id) FROM documents WHERE contains('cv_' || doc_id, '_99'))")
def result_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.detail(_results(spark, sf_dir), "_99").select("cv_key")


@query("SELECT 'cv_' || doc_id AS cv_key, true AS enriched, 'Role x' AS job_title, text AS markdown FROM documents WHERE doc_id % 2 = 1 AND doc_id % 3 = 0")
def reanalyzed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen results that aren't enriched copies already, with a fresh analysis."""
    rows = _results(spark, sf_dir)
    ids = rows.where(F.substring("cv_key", 4, 20).cast("long") % 3 == 0).select("cv_key")
    fresh = ids.select("cv_key", F.struct(F.lit("Role x").alias("job_title")).alias("match_analysis"))
    return store.reanalyzed(rows, ids, fresh).select("cv_key", "enriched", F.col("match_analysis.job_title").alias("job_title"), "markdown")


@query("SELECT 'cv_' || doc_id AS cv_key, doc_id % 3 <> 0 AS enriched FROM documents")
def preferred_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result for each key: of those stored twice the enriched one."""
    rows = _results(spark, sf_dir).withColumn("enriched", F.lit(False))
    copies = rows.where(F.substring("cv_key", 4, 20).cast("long") % 3 != 0).withColumn("enriched", F.lit(True))
    return store.prefer_enriched(rows.unionByName(copies)).select("cv_key", "enriched")


@query(
    """SELECT 'cv_' || d.doc_id AS cv_key, CASE WHEN l.doc_id IS NULL THEN 1 ELSE 2 END::BIGINT AS versions, l.doc_id IS NOT NULL AS enriched,
    CASE WHEN l.doc_id IS NULL THEN 'first' ELSE 'second' END AS job_title, d.text AS markdown
    FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id"""
)
def stored_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results stored, those with a label analysed again and stored beside their originals, and all read back: the preferred version of each."""
    path, analysis = versions.scratch(spark), lambda title: F.struct(F.lit(title).alias("job_title")).alias("match_analysis")
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    key = F.concat(F.lit("cv_"), F.col("doc_id")).alias("cv_key")
    store.write_results(docs.select(key, F.col("text").alias("markdown"), analysis("first")), path)
    ids = labels.select(key).distinct()
    store.write_results(store.reanalyzed(store.read_results(spark, path), ids, ids.select("cv_key", analysis("second"))), path)
    stored = store.read_results(spark, path)
    counts = stored.groupBy("cv_key").agg(F.count("*").alias("versions"))
    return store.prefer_enriched(stored).join(counts, "cv_key").select("cv_key", "versions", "enriched", F.col("match_analysis.job_title").alias("job_title"), "markdown")


_FILES = "f AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'a.txt' WHEN 1 THEN 'noext' ELSE doc_id || CASE WHEN doc_id % 8 < 5 THEN '.pdf' ELSE '.DOCX' END END AS name, CASE doc_id % 8 WHEN 2 THEN '' WHEN 3 THEN '%PDF-' || text WHEN 4 THEN text WHEN 5 THEN 'PK' || chr(3) || chr(4) || text WHEN 6 THEN '%PDF-' ELSE 'x' END AS content FROM documents)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, body = F.col("doc_id"), F.col("text")
    name = F.when(k % 8 == 0, "a.txt").when(k % 8 == 1, "noext").otherwise(F.concat(k, F.when(k % 8 < 5, ".pdf").otherwise(".DOCX")))
    content = F.when(k % 8 == 2, "").when(k % 8 == 3, F.concat(F.lit("%PDF-"), body)).when(k % 8 == 4, body).when(k % 8 == 5, F.concat(F.lit("PK\x03\x04"), body)).when(k % 8 == 6, "%PDF-").otherwise("x")
    rows = _table(spark, sf_dir, "documents").select(k, name.alias("filename"), content.cast("binary").alias("content"))
    return rows.select("doc_id", "filename", F.octet_length("content").cast("long").alias("length"), "content")


@query(
    f"""WITH {_FILES} SELECT doc_id, CASE WHEN content = '' THEN 'The file is empty (0 bytes).' WHEN NOT contains(name, '.') THEN 'The file''s name has no valid extension.' WHEN name = 'a.txt' THEN 'Unsupported file extension ''.txt''; only docx and pdf are read.'
       WHEN doc_id % 8 = 4 THEN 'Not a PDF: its first bytes are of no known kind.' WHEN doc_id % 8 = 6 THEN 'Named as a DOCX, but its first bytes are of another kind.' END AS error FROM f"""
)
def file_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("doc_id", files.file_error(F.col("filename"), F.col("length"), F.col("content")).alias("error"))


def _read(filename: str, content: bytes, ocr: bool) -> files.Parsed:
    """A stand-in parser: what follows the first four bytes is the text, and OCR finds a line more."""
    body = content[4:].decode("utf-8", "replace").removeprefix("-")
    return files.Parsed(body + ("\nread again " * 12 if ocr else ""), pages=2)


@query(
    f"""WITH {_FILES}, t AS (SELECT doc_id, name, regexp_replace(CASE WHEN name LIKE '%.pdf' THEN substr(content, 6) ELSE substr(content, 5) END, '^\\s+|\\s+$', '', 'g') AS t FROM f WHERE doc_id % 8 IN (3, 5))
SELECT doc_id, (doc_id % 8 = 3 AND length(t) < 100) AS ocr_applied, CASE WHEN doc_id % 8 = 3 AND length(t) < 100 THEN 'again' ELSE sha256(t) END AS text_hash, 2::INT AS page_count, (doc_id % 8 = 3 AND length(t) < 100) AS is_scanned FROM t WHERE t <> ''"""
)
def parsed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid files as a parser plug-in reads them; PDF files with little text are read again with OCR."""
    rows = files.parse_files(_files(spark, sf_dir).where("doc_id % 8 in (3, 5)"), _read).where("parse_error is null")
    return rows.select("doc_id", "ocr_applied", F.when(F.col("ocr_applied"), "again").otherwise(F.sha2("cv_text", 256)).alias("text_hash"), "page_count", "is_scanned")


@query("SELECT o_orderkey || '.pdf' AS filename, CASE WHEN o_orderkey % 3 = 0 THEN 'NEW_CV' WHEN o_orderkey % 3 = 1 THEN 'FAILED' ELSE 'FAILED' END AS status, CASE WHEN o_orderkey % 3 = 1 THEN 'broken' WHEN o_orderkey % 3 = 2 THEN 'The task ended without a result.' END AS error FROM orders")
def task_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file that was asked for; those of which nothing was heard have failed."""
    k = F.col("o_orderkey")
    asked = _table(spark, sf_dir, "orders").select(k, F.concat(k, F.lit(".pdf")).alias("filename"))
    fresh = asked.where(k % 3 != 2).select("filename", F.lit("NEW_CV").alias("status"), F.when(k % 3 == 1, "broken").alias("parse_error"))
    return ingest.task_rows(asked, ingest.progress(fresh), running=False)


@query("SELECT c_custkey || '/' || CASE WHEN sha256('a' || c_custkey) > sha256('b' || c_custkey) THEN 'b.v' ELSE 'a v' END || '.pdf' AS filename, 'SUPERSEDED' AS status FROM customer")
def superseded_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of one key in a batch: the one of lesser content hash is replaced, and says so."""
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey"), F.explode(F.array(F.lit("a v"), F.lit("b.v"))).alias("stem"))
    rows = c.select(F.concat("c_custkey", F.lit("/"), "stem", F.lit(".pdf")).alias("filename"), F.concat(F.substring("stem", 1, 1), "c_custkey").cast("binary").alias("content"), F.col("c_custkey").alias("candidate_id"), F.col("c_custkey").alias("cv_id"))
    return ingest.superseded(rows.withColumn("length", F.octet_length("content").cast("long"))).select("filename", "status")


@query(_STAGED.replace("(doc_id % 15)::DOUBLE", "nullif(doc_id % 15, 0)::DOUBLE").replace("(doc_id % 30)::DOUBLE", "nullif(doc_id % 30, 0)::DOUBLE") + " SELECT cv_key, id AS job_id, rank::INT AS rank, score::DOUBLE AS score FROM ranked WHERE cv_key IN (SELECT doc_id::VARCHAR FROM documents WHERE doc_id % 3 <> 1 ORDER BY doc_id LIMIT 50)")
def candidate_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty active candidates with a CV, matched in two stages; an experience or CTC of 0 is unknown."""
    cvs = _cvs(spark, sf_dir)
    k = F.col("cv_key").cast("long")
    people = cvs.select(k.alias("id"), F.lit("A").alias("first_name"), F.lit("B").alias("last_name"), F.concat("cv_key", F.lit(".pdf")).alias("cv_file_name"), F.coalesce("candidate_experience", F.lit(0.0)).alias("total_experience"), F.coalesce("candidate_ctc", F.lit(0.0)).alias("expected_ctc"), (k % 3 != 1).alias("active"))
    texts = cvs.select(F.concat("cv_key", F.lit(".pdf")).alias("cv_file_name"), "cv_text")
    rows = matching.match_candidates(people, texts, _vacancies(spark), 50)
    return rows.select("cv_key", "job_id", F.col("rank").cast("int").alias("rank"), "score")


@query("SELECT doc_id::VARCHAR AS cv_key, 'General Role' AS job_title, 0.0::DOUBLE AS score, 0::INT AS n_skills, 'General' AS department FROM documents")
def no_match_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a CV gets of an empty catalogue."""
    cvs = _cvs(spark, sf_dir)
    rows = rank.best_matches(cvs, matching.match_prefiltered(cvs, _vacancies(spark).limit(0)))
    return rows.select("cv_key", "job_title", "score", F.size("matched_skills").alias("n_skills"), "department")


@query("SELECT doc_id::VARCHAR AS cv_key, CASE WHEN doc_id % 5 = 0 THEN 'CV text is empty.' WHEN doc_id % 5 = 1 THEN 'CV holds images without readable text.' END AS cv_error FROM documents")
def checked_cvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    cvs = _table(spark, sf_dir, "documents").select(k.cast("string").alias("cv_key"), F.when(k % 10 == 0, " \n ").when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, "short <!-- image -->").when(k % 5 == 2, F.concat(F.lit("<!-- image -->"), F.repeat(F.lit("word "), 20))).otherwise(F.col("text")).alias("cv_text"))
    return matching.checked(cvs).select("cv_key", "cv_error")


#: Stand-in vacancies that state every component: id, skills, education, certification, technologies, responsibilities.
_STATED = (
    ("s1", ("that",), "les", "der", ("und", "zzz"), ("que", "die", "the")),
    ("s2", (), None, "zzz", (), ("los", "node.js")),
    ("s3", ("with", "der"), "with", None, ("c++", "the", "les"), ()),
)
_STATED_TERMS = sorted({t for _, s, e, c, x, r in _STATED for t in (*s, e, c, *x, *r) if t})


@query(
    f"""WITH {_CVS}, v AS (SELECT * FROM (VALUES {", ".join(f"('{i}', {_sql_list(s)}, {f"'{e}'" if e else 'NULL'}, {f"'{c}'" if c else 'NULL'}, {_sql_list(x)}, {_sql_list(r)})" for i, s, e, c, x, r in _STATED)}) v(id, skills, edu, cert, tech, resp)),
f AS (SELECT cv_key, {_found("t", _STATED_TERMS)} AS found FROM low),
h AS (SELECT cv_key, v.*, found, len(list_filter(tech, lambda k: list_contains(found, k))) AS nt, len(list_filter(resp, lambda k: list_contains(found, k))) AS nr, len(list_filter(skills, lambda k: NOT list_contains(found, k))) AS missing FROM f, v)
SELECT cv_key, id AS job_id, CASE WHEN list_contains(found, edu) THEN 100.0 ELSE 0.0 END::DOUBLE AS education_score, CASE WHEN list_contains(found, cert) THEN 100.0 ELSE 0.0 END::DOUBLE AS certification_score,
       coalesce(round_even(nt / nullif(len(tech), 0) * 100, 1), 0.0)::DOUBLE AS technology_score, coalesce(round_even(nr / nullif(len(resp), 0) * 100, 1), 0.0)::DOUBLE AS responsibilities_score,
       round_even(0.15 + CASE WHEN len(skills) > 0 THEN 0.25 ELSE 0 END + CASE WHEN edu IS NOT NULL THEN 0.10 ELSE 0 END + CASE WHEN len(tech) > 0 THEN 0.10 ELSE 0 END + CASE WHEN cert IS NOT NULL THEN 0.05 ELSE 0 END + CASE WHEN len(resp) > 0 THEN 0.05 ELSE 0 END, 2)::DOUBLE AS coverage,
       (missing + CASE WHEN NOT list_contains(found, edu) THEN 1 ELSE 0 END + CASE WHEN NOT list_contains(found, cert) THEN 1 ELSE 0 END)::INT AS n_failures FROM h"""
)
def component_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Education, certification, technologies and responsibilities, where vacancies state them."""
    kinds = "id string, required_skills array<string>, education_requirements string, certifications string, technologies array<string>, responsibilities array<string>"
    rows = spark.createDataFrame([(i, list(s), e, c, list(x), list(r)) for i, s, e, c, x, r in _STATED], kinds)
    found = matching.match_rules(_cvs(spark, sf_dir), catalog.conform(rows))
    return found.select("cv_key", "job_id", "education_score", "certification_score", "technology_score", "responsibilities_score", "coverage", F.size("mandatory_failures").alias("n_failures"))


#: What ``search_postings`` seeks beside the names of nations: pieces of names, keys and words, and one too short for postings.
_SOUGHT = ("TION", "pdf", "The", "cv_12", "src1_", "ing ", "zzzz", "é", "of the")


@query(
    f"""WITH sought AS (SELECT unnest([{", ".join(f"'{s}'" for s in _SOUGHT if len(s) >= 3)}]) AS text UNION SELECT n_name FROM nation)
SELECT s.text, 'cv_' || d.doc_id AS cv_key FROM sought s JOIN documents d
ON contains(lower(d.source || '_' || d.doc_id || '.pdf'), lower(s.text)) OR contains(lower('cv_' || d.doc_id), lower(s.text)) OR contains(lower(substr(d.text, 1, 500)), lower(s.text))"""
)
def search_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many sought texts against all results at once, by the postings of their runs."""
    results = _results(spark, sf_dir)
    sought = spark.createDataFrame([(s,) for s in _SOUGHT], "text string").union(_table(spark, sf_dir, "nation").select("n_name"))
    return text_search.search_many(results, text_search.postings(results), sought)
