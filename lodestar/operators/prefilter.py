"""Candidate reduction: the K most promising vacancies of each CV, found without a shuffle.

The catalogue is a dimension. It is packed into slices of at most ``MOST_BYTES``, each one row with an
array of vacancies, which is broadcast. A CV row meets a slice by its number and keeps its K best; the
texts stay behind, and what pairs need of them is looked up once per CV. Only where there are several
slices are the few survivors merged by CV. A catalogue of up to ``INDEXED`` vacancies is scored in full. A
larger one comes with an index of its terms, which a text meets by hash, and only vacancies that can be
among the K best are scored; both ways give the same rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import domain_text, has_key, has_word, tail
from ..sources import versions
from .catalog import prepared
from .score import ENDS, TEXTS
from .term_index import IN_RANGE, best, hits, in_range, term_index, with_weights

#: Vacancies whose size is measured together; a slice holds whole blocks.
BLOCK = 1024
#: Bytes of packed catalogue, as JSON, that are broadcast at a time.
MOST_BYTES = 32 << 20
#: Beyond so many vacancies an index pays: building it takes some seconds, once.
INDEXED = 256


def prefilter_score(lower_text: Column, experience: Column, v: Column) -> Column:
    """30 for the department, 15 a title term, 10 a skill, 5 a keyword, 10 for experience in range."""
    held = lambda terms: F.size(F.filter(terms, lambda t: F.contains(lower_text, t)))
    fits = in_range(experience, v["min_experience_years"], v["max_experience_years"])
    return (
        F.when((v["dept_lower"] != "") & F.contains(lower_text, v["dept_lower"]), 30.0).otherwise(0.0)
        + held(v["title_terms"]) * 15.0
        + held(v["skills_lower"]) * 10.0
        + held(v["keywords_lower"]) * 5.0
        + F.when(fits, IN_RANGE).otherwise(0.0)
    )


def catalogue_slices(vacancies: DataFrame, top_k: int = 1, index: bool = False) -> tuple[list[tuple[int, DataFrame]], int]:
    """(number, one row (block, vacs) to broadcast) of the prepared catalogue, and its number of vacancies.

    ``index`` adds, for more than ``INDEXED``, the index of terms; slices are then built once and kept as a
    table in the shared folder.
    """
    ready = prepared(vacancies).withColumn("block", ((F.col("ordinal") - 1) / BLOCK).cast("int"))
    one = F.struct("ordinal", *[c for c in ready.columns if c not in ("ordinal", "block")])
    sizes = ready.groupBy("block").agg(F.count("*").alias("n"), F.sum(F.length(F.to_json(one))).alias("bytes")).orderBy("block").collect()
    firsts, held = [], 0
    for r in sizes:
        if not firsts or held + r["bytes"] > MOST_BYTES:
            firsts.append(r["block"])
            held = 0
        held += r["bytes"]
    if not firsts:
        return [], 0
    number = F.array_max(F.filter(F.array(*map(F.lit, firsts)), lambda f: f <= F.col("block")))
    n, index = sum(r["n"] for r in sizes), index and sum(r["n"] for r in sizes) > INDEXED
    if index:
        ready = with_weights(ready)
        one = F.struct("ordinal", *[c for c in ready.columns if c not in ("ordinal", "block")])
    packed = ready.withColumn("block", number).groupBy("block").agg(F.sort_array(F.collect_list(one)).alias("vacs"))
    if index:
        placed = packed.select("block", F.posexplode("vacs").alias("k", "v")).select("block", "k", "v.*")
        whole, path = packed.join(term_index(placed, top_k), "block"), versions.scratch(vacancies.sparkSession)
        whole.write.parquet(path)
        packed = vacancies.sparkSession.read.schema(whole.schema).parquet(path)
    return [(f, F.broadcast(packed.where(F.col("block") == f))) for f in firsts], n


def _met(cvs: DataFrame, vacancies: DataFrame, top_k: int | None) -> tuple[DataFrame | None, int, int]:
    """Each CV's vacancies of each slice, the ``top_k`` best or all: what isn't text of the CV, with s, o and v. Also the numbers of vacancies and slices."""
    slices, n = catalogue_slices(vacancies, top_k or 1, index=True)
    looked_up = set(cvs.columns) >= {"cv_lower", "cv_parts", "cv_domain"}
    kept = [c for c in cvs.columns if c not in TEXTS] if looked_up else cvs.columns
    whole = top_k is None or n <= top_k
    parts = []
    for number, packed in slices:
        rows = cvs.select("*", F.col("cv_lower").alias("_low")) if looked_up else cvs.select("*", F.lower("cv_text").alias("_low"))
        rows = rows.withColumn("block", F.explode(F.sequence(F.lit(number), F.lit(number)))).join(packed, "block")
        indexed = "files" in packed.columns
        if indexed:
            rows = hits(rows, F.col("_low"))
        if whole:
            chosen = F.transform("vacs", lambda v: F.struct(v["ordinal"].cast("double").alias("s"), v["ordinal"].alias("o"), v.alias("v")))
        elif indexed:
            rows = best(rows, F.col("candidate_experience"), top_k)
            chosen = F.transform("_top", lambda x: F.struct(x["s"], F.get("vacs", x["k"])["ordinal"].alias("o"), F.get("vacs", x["k"]).alias("v")))
        else:
            scored = F.transform("vacs", lambda v, k: F.struct((-prefilter_score(F.col("_low"), F.col("candidate_experience"), v)).alias("s"), v["ordinal"].alias("o"), k.alias("k")))
            chosen = F.transform(F.slice(F.sort_array(scored), 1, top_k), lambda x: F.struct(x["s"], x["o"], F.get("vacs", x["k"]).alias("v")))
        rows = rows.select("*", chosen.alias("_chosen"))
        if looked_up:
            every = lambda c: F.array_distinct(F.flatten(F.transform("_chosen", lambda x: x["v"][c])))
            asked = every("terms")
            if indexed:
                keys = F.transform(F.filter("_hits", lambda e: e["key"]), lambda e: e["term"])
                asked = keys if whole else F.array_intersect(asked, keys)
            rows = rows.select("*", asked.alias("_keys"))
            found = F.filter("_keys", lambda k: has_key(F.col("_low"), k))
            named = lambda c: F.filter(every("dept_terms"), lambda t: has_word(F.col(c), t))
            longest = F.array_max(F.transform("_chosen", lambda x: F.array_max(F.transform(x["v"]["terms"], F.length))))
            rows = rows.select("*", domain_text(F.col("cv_parts")).alias("_part_text"))
            ends = tail(F.col("_low"), F.coalesce(longest, F.lit(0))).alias("cv_tail"), named("_part_text").alias("cv_part_domains")
            rows = rows.select(*kept, found.alias("cv_found"), named("cv_domain").alias("cv_domains"), *ends, "_chosen")
            parts.append(rows.select(*kept, "cv_found", "cv_domains", *ENDS, F.posexplode_outer("_chosen").alias("_at", "_x")))
        else:
            parts.append(rows.select(*kept, F.posexplode_outer("_chosen").alias("_at", "_x")))
        # An inner generator would have the optimizer repeat the whole scoring as a condition of the join.
        parts[-1] = parts[-1].where("_x IS NOT NULL")
    return (reduce(DataFrame.unionByName, parts) if parts else None), n, len(slices)


def prefilter(cvs: DataFrame, vacancies: DataFrame, top_k: int = 5) -> DataFrame:
    """Pairs of each CV with its ``top_k`` vacancies: ``v``, prefilter_score, input_rank and the CV's columns.

    Ties go by the catalogue's order. A catalogue of at most ``top_k`` vacancies is kept whole in its
    order. cvs: cv_key, cv_text, candidate_experience and any others; where they have the features of
    ``with_features``, pairs carry what was found in place of the texts. An empty catalogue gives no pairs.
    """
    pairs, n, slices = _met(cvs, vacancies, top_k)
    if pairs is None:
        return _no_pairs(cvs, vacancies)
    if slices > 1 and n > top_k:
        best = F.row_number().over(Window.partitionBy("cv_key").orderBy("_x.s", "_x.o"))
        pairs = pairs.withColumn("_at", best - 1).where(F.col("_at") < top_k)
    score = F.lit(None).cast("double") if n <= top_k else -F.col("_x.s")
    kept = [c for c in pairs.columns if c not in ("_x", "_at")]
    return pairs.select(*kept, F.col("_x.v").alias("v"), score.alias("prefilter_score"), (F.col("_at") + 1).alias("input_rank"))


def all_pairs(cvs: DataFrame, vacancies: DataFrame) -> DataFrame:
    """Every CV with every vacancy, in catalogue order: rules-only matching asks for all of them."""
    pairs, _, _ = _met(cvs, vacancies, None)
    if pairs is None:
        return _no_pairs(cvs, vacancies)
    kept = [c for c in pairs.columns if c not in ("_x", "_at")]
    return pairs.select(*kept, F.col("_x.v").alias("v"), F.lit(None).cast("double").alias("prefilter_score"), F.col("_x.o").alias("input_rank"))


def _no_pairs(cvs: DataFrame, vacancies: DataFrame) -> DataFrame:
    ready = prepared(vacancies)
    kind = ready.select(F.struct("ordinal", *[c for c in ready.columns if c != "ordinal"]).alias("v")).schema["v"].dataType
    return cvs.where("false").select(*cvs.columns, F.lit(None).cast(kind).alias("v"), F.lit(None).cast("double").alias("prefilter_score"), F.lit(0).alias("input_rank"))
