"""A dictionary of the catalogue's terms with postings, packed beside the vacancies of a slice.

A term is filed under its first ``GRAM`` characters, or under itself where it is shorter. The files are
an array of buckets, so a text's distinct grams look terms up by hash inside one row: no shuffle, and no
work for terms that the text can't hold. What is found is verified by containment.

The best vacancies come from the postings of the terms found. A vacancy that isn't scored is out of
reach: all its found terms together weigh less than the K-th best score found before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 4
#: Buckets of a slice's dictionary.
BUCKETS = 1 << 13
#: How many of a text's rarest terms give the first vacancies to score.
RAREST = 4
#: Points for experience in range, the only ones that don't come from a term.
IN_RANGE = 10.0


def _weights() -> Column:
    """(term, weight) of all that the pre-filter looks for in a text; a term's repeats add up."""
    each = lambda c, w: F.transform(c, lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))
    department = F.filter(F.array("dept_lower"), lambda t: t != "")
    every = F.concat(each(department, 30.0), each("title_terms", 15.0), each("skills_lower", 10.0), each("keywords_lower", 5.0))
    terms = F.array_distinct(F.filter(F.transform(every, lambda x: x["term"]), lambda t: t.isNotNull()))
    total = lambda t: F.aggregate(F.filter(every, lambda x: x["term"] == t), F.lit(0.0), lambda a, x: a + x["w"])
    return F.transform(terms, lambda t: F.struct(t.alias("term"), total(t).alias("w")))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def with_weights(prepared: DataFrame) -> DataFrame:
    return prepared.withColumn("weights", _weights())


def in_range(experience: Column, low: Column, high: Column) -> Column:
    return experience.isNotNull() & (low.isNull() | (experience >= low)) & (high.isNull() | (experience <= high))


def term_index(placed: DataFrame, top_k: int) -> DataFrame:
    """One row for each slice of prepared vacancies (``block``, its number, and ``k``, their place in it).

    files: buckets of (gram, term, key, most, ks): the greatest weight of a term in any vacancy and the
    places of those that ask for it; ``key`` where scoring looks the term up. sizes: the lengths of grams.
    ranges: the first ``top_k`` places of each range of experience.
    """
    keys = F.transform("terms", lambda t: F.struct(t.alias("term"), F.lit(0.0).alias("w"), F.lit(True).alias("key")))
    asked = F.transform("weights", lambda x: F.struct(x["term"], x["w"], F.lit(False).alias("key")))
    flat = placed.select("block", "k", F.explode(F.concat(asked, keys)).alias("x")).select("block", "k", "x.*")
    gram = F.substring("term", 1, GRAM)
    places = F.sort_array(F.collect_list(F.when(~F.col("key"), F.col("k")))).alias("ks")
    terms = flat.groupBy("block", "term").agg(F.max("key").alias("key"), F.max("w").alias("most"), places)
    entry = F.struct(gram.alias("gram"), "term", "key", "most", "ks")
    filed = terms.groupBy("block", _bucket(gram).alias("b")).agg(F.collect_list(entry).alias("entries"), F.collect_set(F.length(gram)).alias("sizes"))
    given = filed.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("b", "entries"))).alias("given"), F.array_distinct(F.flatten(F.collect_list("sizes"))).alias("sizes"))
    # Buckets are laid out in order, the empty ones too: a map would be searched from its start by each gram.
    gaps = F.array_except(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), F.transform("given", lambda g: g["b"]))
    empty = F.transform(gaps, lambda b: F.struct(b.alias("b"), F.array().cast(filed.schema["entries"].dataType).alias("entries")))
    files = given.select("block", F.sort_array(F.concat("given", empty)).alias("laid"), "sizes")
    files = files.select("block", F.transform("laid", lambda g: g["entries"]).alias("files"), "sizes")
    first = placed.groupBy("block", F.col("min_experience_years").alias("low"), F.col("max_experience_years").alias("high")).agg(F.slice(F.sort_array(F.collect_list("k")), 1, top_k).alias("firsts"))
    return first.groupBy("block").agg(F.collect_list(F.struct("low", "high", "firsts")).alias("ranges")).join(files, "block", "left")


def hits(rows: DataFrame, lower: Column) -> DataFrame:
    """Adds ``_hits``: the dictionary's entries whose terms the lower-case text contains. A null text holds none."""
    longest = F.array_distinct(F.regexp_extract_all(lower, F.lit("(?s)(?=(.{1,%d}))" % GRAM), F.lit(1)))
    rows = rows.withColumn("_long", longest)
    shorter = F.transform(F.filter("sizes", lambda s: s < GRAM), lambda s: F.transform("_long", lambda g: F.substring(g, F.lit(1), s)))
    rows = rows.withColumn("_grams", F.array_distinct(F.concat("_long", F.flatten(shorter))))
    # The empty term is in every text, the empty one too.
    rows = rows.withColumn("_grams", F.array_distinct(F.concat("_grams", F.array(F.lit("")))))
    filed = F.transform("_grams", lambda g: F.filter(F.get("files", _bucket(g)), lambda e: (e["gram"] == g) & F.contains(lower, e["term"])))
    nothing = F.array().cast(rows.schema["files"].dataType.elementType)
    kept = F.filter(filed, lambda x: x.isNotNull() & (F.size(x) > 0))
    return rows.withColumn("_hits", F.coalesce(F.flatten(kept), nothing)).drop("_long", "_grams")


def best(rows: DataFrame, experience: Column, top_k: int) -> DataFrame:
    """From ``_hits``: ``_top``, the ``top_k`` best places (s: the score's negative, k) by score and place; ``_scored`` counts those looked at.

    A vacancy without any term found has at most the points of its range: of those only the first
    ``top_k`` of each range, and of the slice, can count.
    """
    nobody = F.array().cast("array<int>")
    ids = F.transform("_hits", lambda e: e["term"])
    by_rarity = F.sort_array(F.transform(F.filter("_hits", lambda e: F.size(e["ks"]) > 0), lambda e: F.struct(F.size(e["ks"]).alias("n"), e["term"].alias("term"), e["most"].alias("most"), e["ks"].alias("ks"))))
    fitting = F.filter("ranges", lambda r: in_range(experience, r["low"], r["high"]))
    rows = rows.select("*", ids.alias("_ids"), by_rarity.alias("_by"), F.flatten(F.transform(fitting, lambda r: r["firsts"])).alias("_near"))
    rare = F.flatten(F.transform(F.slice("_by", 1, RAREST), lambda e: e["ks"]))
    opening = F.sequence(F.lit(0), F.least(F.lit(top_k), F.size("vacs")) - 1)
    rows = rows.withColumn("_one", F.array_distinct(F.concat(opening, F.coalesce("_near", nobody), rare)))

    def scored(k: Column) -> Column:
        v = F.get("vacs", k)
        found = F.aggregate(F.filter(v["weights"], lambda x: F.array_contains("_ids", x["term"])), F.lit(0.0), lambda a, x: a + x["w"])
        range_points = F.when(in_range(experience, v["min_experience_years"], v["max_experience_years"]), IN_RANGE).otherwise(0.0)
        return F.struct((-(found + range_points)).alias("s"), k.alias("k"))

    rows = rows.withColumn("_s1", F.slice(F.sort_array(F.transform("_one", scored)), 1, top_k))
    rows = rows.withColumn("_bar", F.coalesce(-F.get("_s1", F.lit(top_k - 1))["s"], F.lit(float("-inf"))))
    start = F.struct(F.lit(IN_RANGE).alias("sum"), F.array().cast("array<array<int>>").alias("ks"))

    def step(a: Column, e: Column) -> Column:
        """The commonest terms go while vacancies that hold nothing else stay below the bar."""
        out = a["sum"] + e["most"]
        kept = F.struct(F.lit(float("inf")).alias("sum"), F.concat(a["ks"], F.array(e["ks"])).alias("ks"))
        return F.when(out < F.col("_bar"), F.struct(out.alias("sum"), a["ks"].alias("ks"))).otherwise(kept)

    needed = F.flatten(F.aggregate(F.reverse("_by"), start, step, lambda a: a["ks"]))
    rows = rows.withColumn("_two", F.array_except(needed, "_one"))
    rows = rows.withColumn("_top", F.slice(F.sort_array(F.concat("_s1", F.transform("_two", scored))), 1, top_k))
    return rows.withColumn("_scored", F.size("_one") + F.size("_two")).drop("_ids", "_by", "_near", "_one", "_s1", "_bar", "_two")
