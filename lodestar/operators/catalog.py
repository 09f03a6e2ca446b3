"""The vacancy relation: star joins, predicates and cleaning, with terms prepared for matching."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import department_terms, name_terms, or_null, split_skills, term_key

#: What matching reads of a vacancy.
VACANCY_SCHEMA = (
    "id string, title string, department string, required_skills array<string>, preferred_keywords array<string>, "
    "min_experience_years double, max_experience_years double, min_ctc double, max_ctc double, preferred_gender string, "
    "company_name string, location_name string, vacancy_id long, job_profile_id long, company_id long, department_id long, "
    "location_id long, department_name string, education_requirements string, certifications string, technologies array<string>, responsibilities array<string>"
)
#: The vacancies that stand in where no catalogue is configured or none is open
#: (id, title, department, skills, keywords).
DEFAULT_VACANCIES = (
    ("job_frontend_dev", "Senior Frontend Developer / React UI Specialist", "Engineering",
     ("HTML5", "CSS3", "JavaScript", "React", "Tailwind CSS", "Bootstrap", "Figma", "Git"),
     ("Figma to Code", "UI Components", "Shopify", "Responsive Design", "Material UI", "REST API", "TypeScript", "Elementor")),
    ("job_backend_dev", "Backend Engineer / Python & Node.js Developer", "Engineering",
     ("Python", "FastAPI", "Node.js", "Express.js", "MongoDB", "SQL", "REST API", "Git"),
     ("JWT", "Microservices", "PostgreSQL", "Docker", "Asyncio", "Nodemailer", "CRUD", "Unit Testing")),
    ("job_fullstack_dev", "Full Stack Software Engineer", "Engineering",
     ("JavaScript", "Python", "React", "Node.js", "HTML5", "CSS3", "SQL", "MongoDB", "Git"),
     ("REST API", "Docker", "FastAPI", "EJS", "Bootstrap", "Tailwind", "Agile", "CI/CD")),
    ("job_ui_ux_designer", "UI/UX & Product Designer", "Design & Product",
     ("Figma", "Adobe Photoshop", "Adobe XD", "Wireframing", "UI/UX Design", "Dashboard Design", "Design Systems"),
     ("Prototyping", "User Experience", "User Interface", "Landing Page", "Web Design", "Visual Design", "Canva")),
    ("job_shopify_developer", "E-Commerce & Shopify Liquid Developer", "E-Commerce",
     ("Shopify", "Shopify Liquid", "HTML5", "CSS3", "JavaScript", "Theme Customization"),
     ("Custom Sections", "Figma to Shopify", "E-Commerce", "Liquid Templates", "Responsive Web")),
)


def conform(vacancies: DataFrame, order_by: str | None = None) -> DataFrame:
    """All columns of the vacancy schema, missing ones as null, and ``ordinal`` for ties.

    ``ordinal`` follows ``order_by``, or the numeric id and then the id. The catalogue is a dimension;
    its one global sort is over open vacancies alone.
    """
    have = set(vacancies.columns)
    columns = []
    for item in VACANCY_SCHEMA.split(", "):
        name, kind = item.split(" ", 1)
        columns.append((F.col(name) if name in have else F.lit(None)).cast(kind).alias(name))
    keep = [F.col("ordinal")] if "ordinal" in have else []
    out = vacancies.select(*columns, *keep)
    if keep:
        return out
    keys = [F.col(order_by)] if order_by else [F.col("vacancy_id").asc_nulls_last(), F.col("id")]
    return out.withColumn("ordinal", F.row_number().over(Window.orderBy(*keys)))


def default_vacancies(spark: SparkSession) -> DataFrame:
    rows = [(k, *v[:3], list(v[3]), list(v[4])) for k, v in enumerate(DEFAULT_VACANCIES)]
    return conform(spark.createDataFrame(rows, "ordinal int, id string, title string, department string, required_skills array<string>, preferred_keywords array<string>"))


def is_open(active: Column, *closed: Column) -> Column:
    """Active, and none of the other flags true: a null active excludes, a null flag does not."""
    keep = active
    for flag in closed:
        keep = keep & (flag.isNull() | ~flag)
    return keep


def active_vacancies(requests: DataFrame, profiles: DataFrame, designations: DataFrame, companies: DataFrame, departments: DataFrame, locations: DataFrame) -> DataFrame:
    """Open vacancy requests with the names of their five dimensions, cleaned for matching.

    requests: id, the five ``*_id`` keys, min/max experience and CTC, skills, gender, and the flags
    active, deleted, closed, force_closed. Dimensions: id and name; profiles also department_id. The
    joins only widen: a missing dimension keeps the vacancy, an inactive one too. Small dimensions are
    broadcast by the optimizer under its size threshold.
    """
    v = requests.where(is_open(F.col("active"), F.col("deleted"), F.col("closed"), F.col("force_closed")))
    v = v.select([F.col(c).alias(f"v_{c}") for c in v.columns])
    for name, table in (("profile", profiles), ("designation", designations), ("company", companies), ("department", departments), ("location", locations)):
        more = [F.col("department_id").alias("profile_department_id")] if name == "profile" else []
        dim = table.select(F.col("id").alias(f"{name}_key"), F.col("name").alias(f"{name}_name"), *more)
        key = {"profile": "v_job_profile_id"}.get(name, f"v_{name}_id")
        v = v.join(dim, F.col(key) == F.col(f"{name}_key"), "left")
    named = lambda d: F.when(F.col(f"{d}_key").isNull(), F.lit(f"Unknown {d.title()}")).otherwise(F.col(f"{d}_name"))
    skills = F.coalesce(split_skills(F.col("v_skills")), F.array().cast("array<string>"))
    number = lambda c: F.col(f"v_{c}").cast("double").alias(c)
    return v.select(
        F.col("v_id").cast("string").alias("id"),
        F.coalesce(or_null(F.col("profile_name")), or_null(F.col("designation_name")), F.concat(F.lit("Vacancy #"), F.col("v_id"))).alias("title"),
        named("department").alias("department"),
        skills.alias("required_skills"),
        skills.alias("preferred_keywords"),
        *map(number, ("min_experience_years", "max_experience_years", "min_ctc", "max_ctc")),
        F.col("v_preferred_gender").alias("preferred_gender"),
        named("company").alias("company_name"),
        named("location").alias("location_name"),
        F.col("v_id").cast("long").alias("vacancy_id"),
        F.col("v_job_profile_id").alias("job_profile_id"),
        F.col("v_company_id").alias("company_id"),
        F.coalesce("v_department_id", "profile_department_id").alias("department_id"),
        F.col("v_location_id").alias("location_id"),
        named("department").alias("department_name"),
        ((F.size(skills) == 0) & F.col("v_min_experience_years").isNull() & F.col("profile_key").isNull()).alias("underspecified"),
    )


def vacancies_or_default(found: DataFrame | None, spark: SparkSession) -> DataFrame:
    """The catalogue's open vacancies, or the stand-ins if there is no catalogue or none is open."""
    return default_vacancies(spark) if found is None or found.isEmpty() else conform(found)


def prepared(vacancies: DataFrame) -> DataFrame:
    """What matching asks of a vacancy, once per vacancy.

    Lower-case department, skills and keywords; the terms of title and department; and the keys by which
    skills and keywords are looked up, with all keys together in ``terms``.
    """
    department = F.coalesce(or_null(F.col("department_name")), or_null(F.col("department")), F.lit(""))
    low = lambda c: F.coalesce(F.transform(c, F.lower), F.array().cast("array<string>"))
    keys = lambda c: F.coalesce(F.transform(c, term_key), F.array().cast("array<string>"))
    stated = F.transform(F.filter(F.array("education_requirements", "certifications"), lambda x: x.isNotNull()), term_key)
    rows = vacancies.select(
        "*",
        F.lower(department).alias("dept_lower"),
        F.coalesce(name_terms(F.col("title")), F.array().cast("array<string>")).alias("title_terms"),
        department_terms(department).alias("dept_terms"),
        low("required_skills").alias("skills_lower"),
        low("preferred_keywords").alias("keywords_lower"),
        keys("required_skills").alias("skill_keys"),
        keys("preferred_keywords").alias("keyword_keys"),
        keys("technologies").alias("technology_keys"),
        keys("responsibilities").alias("responsibility_keys"),
    )
    every = F.array_distinct(F.concat("skill_keys", "keyword_keys", "technology_keys", "responsibility_keys", stated))
    return rows.select("*", F.filter(every, lambda k: k != "").alias("terms"))


def vacancy(vacancies: DataFrame, key: str) -> DataFrame:
    """The first vacancy whose id or numeric id reads ``key``."""
    return vacancies.where((F.col("id") == key) | (F.col("vacancy_id").cast("string") == key)).orderBy("ordinal").limit(1)


def department_ids(vacancies: DataFrame) -> DataFrame:
    return vacancies.select("department_id").where("department_id is not null").distinct().orderBy("department_id")


def search_vacancies(vacancies: DataFrame, query: str) -> DataFrame:
    """Vacancies whose title, department or skills contain the query, without regard to case."""
    q = F.lit(query.strip().lower())
    fields = [F.coalesce(F.lower(c), F.lit("")) for c in (F.col("title"), F.col("department"), F.array_join("required_skills", ", "))]
    return vacancies.where(F.contains(fields[0], q) | F.contains(fields[1], q) | F.contains(fields[2], q))


def audit(requests: DataFrame) -> DataFrame:
    """Data-quality counts of the vacancy table in one pass."""
    skills = split_skills(F.col("skills"))
    raw = F.size(F.filter(F.split("skills", ",", -1), lambda x: F.trim(x) != ""))
    is_live = is_open(F.col("active"), F.col("deleted"), F.col("closed"), F.col("force_closed"))
    return requests.agg(
        F.count_if(F.col("active")).alias("raw_active"),
        F.count_if(is_live).alias("open_active"),
        F.count_if(is_live & (F.coalesce(F.trim("skills"), F.lit("")) == "")).alias("missing_skills"),
        F.count_if(is_live & (F.size(skills) < raw)).alias("garbage_skills"),
        F.count_if(is_live & F.col("min_experience_years").isNull() & F.col("max_experience_years").isNull()).alias("missing_range"),
        F.count_if(is_live & F.col("job_profile_id").isNull()).alias("missing_profile"),
    )


def duplicate_names(dimension: DataFrame) -> DataFrame:
    return dimension.groupBy(F.lower("name").alias("name")).agg(F.count("*").alias("n")).where("n > 1")


def backfilled(requests: DataFrame, profiles: DataFrame, terms, most: int | None = None) -> DataFrame:
    """Vacancies with blank skills and a described profile: id and the skills taken from the description."""
    from ..functions.text import fit_terms

    blank = F.coalesce(F.trim("skills"), F.lit("")) == ""
    named = profiles.where(F.trim("description") != "").select(F.col("id").alias("profile_key"), F.col("name").alias("profile_name"), "description")
    joined = requests.where(blank).join(named, F.col("job_profile_id") == F.col("profile_key"))
    return joined.select("id", "profile_name", fit_terms(terms(F.col("description")), most).alias("skills"))


def backfill_report(requests: DataFrame, found: DataFrame, samples: int = 10) -> DataFrame:
    """One row: vacancies with blank skills, those that ``found`` (of ``backfilled``) fills, and the first few of them by id."""
    blank = requests.where(F.coalesce(F.trim("skills"), F.lit("")) == "").agg(F.count("*").alias("blank"))
    filled = found.where(F.col("skills") != "")
    shown = filled.orderBy("id").limit(samples).agg(F.sort_array(F.collect_list(F.struct("id", "profile_name", "skills"))).alias("samples"))
    counts = filled.agg(F.count("*").alias("filled"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(blank).join(one(counts), "_one").join(one(shown), "_one").drop("_one")


def apply_backfill(requests: DataFrame, found: DataFrame, dry_run: bool = True) -> DataFrame:
    """``requests`` with found skills in place of blank ones; a dry run leaves them as they are."""
    if dry_run:
        return requests
    new = found.where(F.col("skills") != "").select("id", F.col("skills").alias("_found"))
    joined = requests.join(new, "id", "left")
    return joined.select(*[F.coalesce("_found", "skills").alias(c) if c == "skills" else F.col(c) for c in requests.columns])


class Catalogue:
    """Open vacancies, read once and kept until ``refresh``, ``invalidate`` or the end of their lifetime.

    ``load`` gives the relation; ``seconds`` is its lifetime (None: without end).
    """

    def __init__(self, load: Callable[[], DataFrame], seconds: float | None = None):
        self.load, self.seconds = load, seconds
        self.held: DataFrame | None = None
        self.since = 0.0

    def vacancies(self) -> DataFrame:
        if self.held is not None and self.seconds is not None and time.monotonic() - self.since > self.seconds:
            self.invalidate()
        if self.held is None:
            self.held, self.since = self.load().cache(), time.monotonic()
        return self.held

    def invalidate(self) -> None:
        if self.held is not None:
            self.held.unpersist()
            self.held = None

    def refresh(self) -> DataFrame:
        """Read the catalogue anew."""
        self.invalidate()
        return self.vacancies()
