"""Text functions on columns: term matching, CV sections, skill phrases. No Python on the data path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word lists that decide matches.
TITLE_STOP_WORDS = ("and", "team", "for", "the", "with", "senior", "junior", "lead", "manager", "developer", "engineer", "specialist")
SENIORITY_WORDS = ("senior", "junior", "lead", "head", "manager", "developer", "engineer", "specialist")
DEPARTMENT_DENYLIST = ("admin", "department", "development", "management", "maintenance", "operations", "service", "support", "team")
GARBAGE_SKILLS = ("-", ".", "yes", "no", "n/a", "na", "nil", "none", "test", "1", "0", "ok", "good")
SECTION_HEADINGS = ("contact", "education", "languages", "hobbies", "profile summary", "projects", "skills", "work experience")
DOMAIN_KEYWORDS = {
    "engineering": ("api", "backend", "developer", "development", "django", "engineer", "fastapi", "frontend", "java", "javascript", "python", "react", "software", "typescript"),
    "finance": ("analyst", "excel", "financial", "forecasting", "investment", "modeling", "valuation"),
    "healthcare": ("clinical", "hospital", "icu", "nurse", "patient"),
}
LEADING_PHRASES = (
    "ability to", "excellent", "experience in", "experience with", "familiar with", "familiarity with", "good knowledge of", "hands-on experience in",
    "knowledge of", "proficiency in", "proficient in", "should have a knowledge of using", "solid understanding of", "strong communication and", "strong understanding of",
)
NOISE_TERMS = ("ability", "ability to work effectively in a team environment", "excellent problem-solving and debugging skills", "interpersonal skills", "skills", "strong communication")


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row for any number of uses in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column, chars: str = r"\s") -> Column:
    """Without leading and trailing characters of a regex class (all white space, unlike ``trim``)."""
    return F.regexp_replace(text, f"(?U)^[{chars}]+|[{chars}]+$", "")


def or_null(text: Column) -> Column:
    """Null where empty."""
    return F.nullif(text, F.lit(""))


def lines_of(text: Column) -> Column:
    return F.split(text, r"\R", -1)


def words_of(text: Column) -> Column:
    """Distinct runs of word characters, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), 1))


def name_terms(name: Column, denied=TITLE_STOP_WORDS) -> Column:
    """Terms of a title: split at spaces and / & ( ) - , and without short and denied words."""
    return F.filter(F.split(F.lower(name), r"(?U)[\s/&()\-,]+", -1), lambda t: (F.length(t) > 2) & ~t.isin(*denied))


def department_terms(name: Column) -> Column:
    """Terms of a department, without what stands in parentheses."""
    return name_terms(F.regexp_replace(name, r"\([^)]*\)", " "), DEPARTMENT_DENYLIST)


def split_skills(text: Column) -> Column:
    """Comma-separated skills, stripped, without single characters and garbage; order and repeats stay."""
    parts = F.transform(F.split(text, ",", -1), lambda x: strip(x))
    return F.filter(parts, lambda x: (F.length(x) > 1) & ~F.lower(x).isin(*GARBAGE_SKILLS))


def term_key(term: Column) -> Column:
    """What a term is looked up by: stripped, in lower case."""
    return F.lower(strip(term))


def _bounded(quoted: Column, before: str, after: str) -> Column:
    """Regex of a literal between boundaries. The literal comes first, where a search for it is fastest."""
    return F.concat(F.lit("(?U)"), quoted, F.lit(f"(?<={before}"), quoted, F.lit(f"){after}"))


def _quoted(key: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(key, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def term_pattern(key: Column) -> Column:
    """Regex of a term's key with its boundaries.

    Terms with one of + # . must be delimited by white space or , ; / ( ) - _ quotes or the text's ends;
    others by word boundaries or underscores.
    """
    edge = r"[\s,;/()\-_\"']"
    return F.when(key.rlike(r"[+#.]"), _bounded(_quoted(key), f"(?:^|{edge})", f"(?:$|{edge})")).otherwise(_bounded(_quoted(key), r"(?:\b|_)", r"(?:\b|_)"))


def has_key(lower_text: Column, key: Column) -> Column:
    """Whether lower-case text holds a term's key between boundaries; the cheap containment test goes first."""
    return F.contains(lower_text, key) & F.rlike(lower_text, term_pattern(key))


def has_term(lower_text: Column, term: Column) -> Column:
    return has_key(lower_text, term_key(term))


def has_word(lower_text: Column, word: Column) -> Column:
    """Whether lower-case text holds a word between word boundaries."""
    return F.contains(lower_text, word) & F.rlike(lower_text, _bounded(_quoted(word), r"\b", r"\b"))


#: Line breaks, and the white space within a line.
_BREAKS = r"\n\x0B\f\r\x85\u2028\u2029"
_GAP = rf"[^\S{_BREAKS}]"
#: Holds in every text with a heading that reads skills.
_SKILLS_LINE = rf"(?U)(?:^|[{_BREAKS}])[#\-{_GAP}]*+" + rf"{_GAP}*+".join((r"[sS]", r"[kK\u212A]", r"[iI]", r"[lL]", r"[lL]", r"[sS]")) + r"(?!\S)"
_LABELLED = r"(?U)^[\w /&+\-.#]+:\s*\S+"


def skill_lines(text: Column) -> Column:
    """Lines of the skills section, and ``Label: value`` lines before its end.

    A heading that reads skills opens the section; the next ``##`` line ends the whole scan. A text without such a
    heading has only its labelled lines to look at.
    """
    lines = F.filter(F.transform(lines_of(text), lambda x: strip(x)), lambda x: x != "")
    labelled = F.filter(F.transform(F.filter(lines_of(text), lambda x: F.contains(x, F.lit(":"))), lambda x: strip(x)), lambda x: x.rlike(_LABELLED))

    def heading(x: Column) -> Column:
        bare = F.regexp_replace(F.lower(strip(F.regexp_replace(x, "^[#\\- ]+", ""))), r"(?U)\s+", "")
        return x.rlike(r"(?U)^[#\- ]*\s*[sS]") & (bare == "skills")  # the first test is cheap and fails nearly always

    def taken(ls: Column, heads: Column, opens: Column, over: Column) -> Column:
        """``opens`` is the first heading's place from 1 on, 0 without one; ``over`` the place from 0 on that ends the scan."""
        inside = lambda k: (opens > 0) & (k >= opens)
        return F.filter(ls, lambda x, k: (k < over) & ~F.get(heads, k) & (inside(k) | x.rlike(_LABELLED)))

    def end(ls: Column, heads: Column, opens: Column) -> Column:
        ends = F.transform(ls, lambda x, k: F.when((opens > 0) & (k >= opens) & x.startswith("##") & ~F.get(heads, k), k))
        return F.coalesce(F.array_min(ends), F.size(ls))

    def scan(ls: Column, heads: Column, opens: Column) -> Column:
        return let(end(ls, heads, opens), lambda over: taken(ls, heads, opens, over))

    sections = let(lines, lambda ls: let(F.transform(ls, heading), lambda heads: let(F.array_position(heads, F.lit(True)), lambda opens: scan(ls, heads, opens))))
    return F.when(text.rlike(_SKILLS_LINE), sections).otherwise(labelled)


def role_headers(text: Column) -> Column:
    """``##`` headings that name a role: not a section, nor about contact, education or languages."""
    marked = F.filter(lines_of(text), lambda x: F.contains(x, F.lit("##")))
    heads = F.filter(F.transform(marked, lambda x: strip(x)), lambda x: x.startswith("##"))
    clean = F.transform(heads, lambda x: F.regexp_replace(strip(F.regexp_replace(x, "^[# ]+", "")), r"(?U)\s+", " "))

    def keep(h: Column) -> Column:
        low = F.lower(h)
        section = low.isin(*SECTION_HEADINGS) | F.replace(low, F.lit(" "), F.lit("")).isin("skills", "workexperience")
        return (h != "") & ~section & ~low.rlike("contact|education|language")

    return F.filter(clean, keep)


def current_role(text: Column, lower: Column | None = None) -> Column:
    """After the first ``current role:``, ``position:`` or ``title:``, else the first ``##`` heading; or null.

    ``lower`` is the text in lower case, where the caller has it.
    """
    low = F.lower(text) if lower is None else lower
    named = F.contains(low, F.lit("role")) | F.contains(low, F.lit("position")) | F.contains(low, F.lit("title"))
    pattern = r"(?iU)(?:current\s*role|position|title)\s*:\s*([^\n]+)"
    label = F.when(F.contains(text, F.lit(":")) & named, F.regexp_extract(text, pattern, 1)).otherwise("")
    heading = F.when(F.contains(text, F.lit("##")), strip(F.regexp_extract(text, r"(?U)##\s*([^\n]+)", 1)))
    return let(label, lambda x: or_null(F.when(x != "", strip(x)).otherwise(heading)))


def domain_text(parts: Column) -> Column:
    """Lower-case text of the parts, followed by the domains whose keywords it holds."""
    joined = F.lower(F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " "))

    def named(text: Column) -> Column:
        return let(words_of(text), lambda w: F.concat_ws(" ", text, *[F.when(F.arrays_overlap(w, strings(k)), name) for name, k in DOMAIN_KEYWORDS.items()]))

    return F.trim(let(joined, named))


def tail(text: Column, most: Column) -> Column:
    """The text from a white space before its last ``most`` characters on; the whole text where none is near."""
    near = F.regexp_extract(F.right(text, most + 64), r"(?Us)^\S{0,63}(\s.*)", 1)
    return F.when((F.length(text) > most + 64) & (near != ""), near).otherwise(text)


def compact_cv(text: Column, most: int = 3500) -> Column:
    """Stripped non-blank lines with runs of blanks collapsed, cut to ``most`` characters for a prompt."""
    kept = F.filter(F.transform(lines_of(text), lambda x: strip(x)), lambda x: x != "")
    return F.substring(F.regexp_replace(F.array_join(kept, "\n"), "[ \t]{2,}", " "), 1, most)


def _clean_phrase(value: Column) -> Column:
    one = F.regexp_replace(strip(value, r" >•*.#;:\-\t\r\n"), r"(?U)\s+", " ")
    one = F.regexp_replace(one, r"(?iU)^(?:and|or|with|using|particularly)\s+", "")
    rest = let(one, lambda p: F.coalesce(strip(F.substr(p, leading_of(p) + 1), r" .;:\-"), p))
    rest = F.regexp_replace(rest, r"(?i)\b(?:e\.g\.|i\.e\.)\b", "")
    return F.regexp_replace(strip(rest, r" .;:\-\t\r\n"), r"(?U)\s+", " ")


def leading_of(phrase: Column) -> Column:
    """Length of the first listed leading phrase, or null."""
    out = F.lit(None).cast("int")
    for known in reversed(LEADING_PHRASES):
        out = F.when(F.lower(phrase).startswith(known), F.lit(len(known))).otherwise(out)
    return out


def skill_terms(description: Column) -> Column:
    """Skill terms of a free-text description, joined by ``, ``.

    Lines are split at commas, semicolons and ``and``; what stands in parentheses counts again by
    itself. Noise, terms under three characters and those over eight words go; the first of equals stays.
    """
    cut = lambda x: F.split(x, r"(?U),|;|\band\b", -1)
    line_parts = lambda x: F.concat(
        cut(F.regexp_replace(F.regexp_replace(x, r"\(([^)]*)\)", ", $1, "), r"(?iU)\bincluding\b", ",")),
        F.flatten(F.transform(F.regexp_extract_all(x, F.lit(r"\(([^)]*)\)"), 1), cut)),
    )
    lines = F.filter(F.transform(lines_of(description), lambda x: strip(x, r" \-\t\r\n")), lambda x: x != "")
    terms = F.transform(F.flatten(F.transform(lines, line_parts)), _clean_phrase)
    good = F.filter(terms, lambda t: (F.length(t) >= 3) & ~F.lower(t).isin(*NOISE_TERMS) & (F.size(F.split(t, r"\s+")) <= 8))
    return F.array_join(F.array_distinct(good), ", ")


def fit_terms(value: Column, most: int | None) -> Column:
    """As many whole comma-separated terms as fit into ``most`` characters, or the cut text if none does."""
    if not most or most < 0:
        return value
    terms = F.filter(F.transform(F.split(value, ",", -1), lambda x: strip(x)), lambda x: x != "")
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("over"))

    def step(s: Column, t: Column) -> Column:
        longer = F.when(s["out"] == "", t).otherwise(F.concat(s["out"], F.lit(", "), t))
        fits = ~s["over"] & (F.length(longer) <= most)
        return F.struct(F.when(fits, longer).otherwise(s["out"]).alias("out"), (s["over"] | ~fits).alias("over"))

    fitted = F.aggregate(terms, start, step, lambda s: s["out"])
    cut = F.regexp_replace(F.substring(value, 1, most), "[ ,]+$", "")
    return F.when(F.length(value) <= most, value).when(fitted != "", fitted).otherwise(cut)


def content_key(filename: Column, candidate_id: Column, cv_id: Column) -> Column:
    """Stable key of an uploaded file from its ids and its sanitised stem."""
    stem = F.regexp_replace(F.regexp_replace(filename, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")
    safe = F.regexp_replace(stem, "[^a-zA-Z0-9_-]", "_")
    by_candidate, by_cv = candidate_id.cast("string"), cv_id.cast("string")
    return (
        F.when(candidate_id.isNotNull() & cv_id.isNotNull(), F.concat(F.lit("cand_"), by_candidate, F.lit("_cv_"), by_cv))
        .when(candidate_id.isNotNull(), F.concat(F.lit("cand_"), by_candidate, F.lit("_"), safe))
        .when(cv_id.isNotNull(), F.concat(F.lit("cv_"), by_cv, F.lit("_"), safe))
        .otherwise(F.concat(F.lit("cv_"), safe))
    )


def _plain_number(x: Column) -> Column:
    return F.regexp_replace(x.cast("double").cast("string"), r"\.0$", "")


def _indian(x: Column) -> Column:
    """Whole number grouped by the last three digits, then by two."""
    digits = x.cast("long").cast("string")
    head = F.regexp_replace(F.substring(digits, F.lit(1), F.length(digits) - 3), r"(?<=\d)(?=(\d{2})+$)", ",")
    return F.when(F.length(digits) <= 3, digits).otherwise(F.concat(head, F.lit(","), F.right(digits, F.lit(3))))


def salary_label(low: Column, high: Column) -> Column:
    """Salary range for display: up to 100 in LPA, else rupees grouped the Indian way; nothing up to 0."""
    one = lambda x: F.when(x > 0, F.concat(F.lit("₹"), F.when(x <= 100, F.concat(_plain_number(x), F.lit(" LPA"))).otherwise(_indian(x))))
    a, b = one(low), one(high)
    return F.coalesce(F.concat(a, F.lit(" - "), b), F.concat(F.lit("From "), a), F.concat(F.lit("Up to "), b), F.lit("Not Specified"))


def experience_label(low: Column, high: Column) -> Column:
    """Experience range for display."""
    a, b = _plain_number(low), _plain_number(high)
    return (
        F.when((low > 0) & (low == high), F.concat(a, F.lit(" Yrs Exp")))
        .when(low.isNotNull() & high.isNotNull() & ((low > 0) | (high > 0)), F.concat(a, F.lit(" - "), b, F.lit(" Yrs Exp")))
        .when(low > 0, F.concat(a, F.lit("+ Yrs Exp")))
        .when(high > 0, F.concat(F.lit("Up to "), b, F.lit(" Yrs Exp")))
        .otherwise("Any Experience")
    )


def score_band(score: Column, classification: Column, high: float = 70.0, medium: float = 40.0) -> Column:
    """Badge of a score: its band or an explicit class, whichever is better."""
    return F.when((score >= high) | F.coalesce(classification == "HIGH", F.lit(False)), "HIGH MATCH").when((score >= medium) | F.coalesce(classification == "MEDIUM", F.lit(False)), "MEDIUM").otherwise("LOW MATCH")


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
