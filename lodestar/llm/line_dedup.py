"""Line deduplication by a log-template tree, in built-in expressions only.

A line goes down a tree of fixed depth: by its number of tokens, then by its two leading tokens; tokens
with a digit are variable fields from the start. Below that, a run of tokens may be a variable field too:
each run of ``1 - similar`` of the tokens, one after another, is taken as the field, and the tokens around
it are the template. So lines that agree but for one field meet in a template, however many templates
there are below the same leading tokens, and the line without any field is a template as well. A template
that ``least_docs`` documents or more hold is boilerplate: its lines stay in the document of least id and
go from all others.

Templates travel as 64-bit hashes. A document counts a template once before anything is shuffled, and
counts are added up before the shuffle, so a line in very many documents is a row for each task there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let

#: Bits of a place that hold the line's number; the others tell apart texts of one id.
_LINE_BITS = 24


def _templates(line: Column, similar: float) -> Column:
    """Hashes of a line's templates: the whole line's first, then one for each field it may have; none without a token."""

    def fields(t: Column) -> Column:
        n = F.size(t)
        width = F.floor(n * (1 - similar) + 1e-9).cast("int")
        runs = F.sequence(F.lit(0), F.ceil((n - 2) / width).cast("int") - 1)
        around = F.transform(runs, lambda j: F.xxhash64(n, j, F.slice(t, F.lit(1), j * width + 2), F.slice(t, (j + 1) * width + 3, n)))
        whole = F.array(F.xxhash64(t))
        return F.when(n == 0, F.array().cast("array<bigint>")).when((width < 1) | (n < 3), whole).otherwise(F.concat(whole, around))

    return let(F.array_remove(F.split(line, " ", -1), ""), fields)


def _lines(docs: DataFrame, similar: float) -> DataFrame:
    """doc_id, tag (of the text) and lines with a token (k, keys) of the rows with an id and a text."""
    blanks = F.regexp_replace(F.lower(F.col("text").cast("string")), "[\x20\x09\x0b\x0c\x0d]+", " ")
    plain = F.regexp_replace(blanks, r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+", "<*>")
    lines = F.transform(F.split(plain, "\n", -1), lambda x, k: F.struct(k.alias("k"), _templates(x, similar).alias("keys")))
    tag = F.shiftleft(F.xxhash64(F.col("text").cast("string")), _LINE_BITS)
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), tag.alias("tag"), F.filter(lines, lambda x: F.size(x["keys"]) > 0).alias("lines"))


def _boilerplate(lines: DataFrame, least_docs: int) -> DataFrame:
    """key and keep_doc of the templates that enough documents hold."""
    each = lines.select("doc_id", F.explode_outer(F.array_distinct(F.flatten("lines.keys"))).alias("key"))
    held = each.where("key is not null").groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("keep_doc"))
    return held.where(F.col("n") >= least_docs).select("key", "keep_doc")


def dedup_lines(docs: DataFrame, least_docs: int = 3, similar: float = 0.8) -> DataFrame:
    """All rows of ``docs`` with boilerplate lines taken out of ``text``, and two columns more.

    _n_lines counts lines with a token, _n_dropped those taken out; columns of these names are replaced.
    A null text stays null; a text whose lines all go becomes empty. Lines without a token stay where
    they are. Each row counts as a document, so repeated rows count as often as they occur; the rows of
    the least id all keep their lines. A row without an id keeps its text and counts for nothing.
    """
    lines = cut(_lines(docs, similar))
    bad = cut(_boilerplate(lines, least_docs))
    each = lines.select("doc_id", "tag", F.explode_outer("lines").alias("x"))
    each = each.select("doc_id", F.col("tag").bitwiseOR(F.col("x.k").cast("long")).alias("place"), F.explode_outer("x.keys").alias("key"))
    gone = each.join(bad.hint("merge"), "key").where("doc_id <> keep_doc")
    drops = gone.groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set("place").alias("_drop"))
    names = [f"c{k}" for k in range(len(docs.columns))]  # whatever the columns are called, they don't clash
    text = F.col(names[docs.columns.index("text")]).cast("string")
    joined = docs.toDF(*names).join(drops.hint("merge"), F.col(names[docs.columns.index("doc_id")]) == F.col("_doc"), "left")
    tag = lambda x: F.shiftright(x, _LINE_BITS)
    own = F.transform(F.filter("_drop", lambda x: tag(x) == tag(F.shiftleft(F.xxhash64(text), _LINE_BITS))), lambda x: x.bitwiseAND(F.lit((1 << _LINE_BITS) - 1)).cast("int"))
    joined = joined.withColumn("_own", F.when(F.col("_drop").isNotNull(), own))

    def cleaned(parts: Column) -> Column:
        keep = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_own"))
        return F.array_join(F.transform(keep, lambda k: F.get(parts, k)), "\n")

    new = F.when(F.size("_own") > 0, let(F.split(text, "\n", -1), cleaned)).otherwise(text)
    tokened = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D][^\n]*")), F.lit(0)).cast("long")
    rest = [(new if c == "text" else F.col(n)).alias(c) for n, c in zip(names, docs.columns) if c not in ("_n_lines", "_n_dropped")]
    return joined.select(*rest, tokened.alias("_n_lines"), F.when(F.size("_own") > 0, F.size("_own")).otherwise(0).cast("long").alias("_n_dropped"))


ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, k - 1 AS k, list_filter(string_split_regex(lower(ls[k]), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t, ls
           FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents)),
m AS (SELECT doc_id, k, len(t) AS n, len(t) // 5 AS w, list_transform(t, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS t FROM l WHERE len(t) > 0),
x AS (SELECT doc_id, k, array_to_string(t, ' ') AS template FROM m
      UNION ALL SELECT doc_id, k, concat(n, ' ', j, ' ', array_to_string(list_slice(t, 1, 2 + j * w), ' '), ' <field> ', array_to_string(list_slice(t, 3 + (j + 1) * w, n), ' '))
      FROM (SELECT *, unnest(range(0, CAST(ceil((n - 2) / w) AS BIGINT))) AS j FROM m WHERE w >= 1)),
b AS (SELECT template, min(doc_id) AS keep FROM x GROUP BY template HAVING count(DISTINCT doc_id) >= 3),
g AS (SELECT x.doc_id, list(DISTINCT x.k) AS gone FROM x JOIN b ON x.template = b.template WHERE x.doc_id <> b.keep GROUP BY x.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_dropped,
       sha256(array_to_string(list_transform(list_filter(range(0, len(string_split(d.text, chr(10)))), lambda i: gone IS NULL OR NOT list_contains(gone, i)), lambda i: string_split(d.text, chr(10))[i + 1]), chr(10))) AS kept_sha256
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = d.doc_id
"""
