"""Importance resampling of documents towards a target text distribution, in built-in expressions only.

Word n-grams are hashed into buckets. A bucket's gain is the log ratio of its shares in the target and in the
documents, both with one added to each bucket; a document's weight is the sum of its features' gains. Gumbel noise from
the document's id added to the weight turns the highest scores into a sample without replacement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, let

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits and of all other characters beyond ASCII; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), _GAPS, -1), "")


def n_grams(own: Column, longest: int) -> Column:
    """All runs of 1 to ``longest`` consecutive words, joined by a space."""
    if longest == 1:
        return own

    def runs(w: Column, n: int) -> Column:
        starts = F.slice(w, 1, F.greatest(F.size(w) - (n - 1), F.lit(0)))
        return F.transform(starts, lambda _, k: F.array_join(F.slice(w, k + 1, n), " "))

    return let(own, lambda w: F.concat(w, *(runs(w, n) for n in range(2, longest + 1))))


def bucket(feature: Column, buckets: int) -> Column:
    """The bucket of a feature with A to Z in lower case; other letters keep their case."""
    low = F.when(F.octet_length(feature) == F.length(feature), F.lower(feature)).otherwise(F.translate(feature, _CAPITALS, _CAPITALS.lower()))
    return (F.crc32(low.cast("binary")) % buckets).cast("int")


def _features(texts: DataFrame, buckets: int, longest: int, *keep: Column) -> DataFrame:
    own = texts.select(*keep, n_grams(words(F.col("text")), longest).alias("_grams"))
    return own.select(*(c for c in own.columns if c != "_grams"), F.size("_grams").cast("long").alias("n_features"), F.explode_outer("_grams").alias("_gram")).select(
        "*", bucket(F.col("_gram"), buckets).alias("bucket")
    ).drop("_gram")


def bucket_counts(texts: DataFrame, buckets: int, longest: int) -> DataFrame:
    """bucket and how many features fall into it; at most ``buckets`` rows, added up before the shuffle."""
    return _features(texts, buckets, longest).where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 1) -> DataFrame:
    """bucket and gain of every bucket: ``buckets`` rows."""
    s = bucket_counts(docs, buckets, longest).withColumnRenamed("n", "s")
    t = bucket_counts(target, buckets, longest).withColumnRenamed("n", "t")
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = cut(every.join(s, "bucket", "left").join(t, "bucket", "left").select("bucket", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st")))
    all_s, all_t = counts.agg(F.sum("s"), F.sum("t")).first()
    ratio = (F.col("t") + 1) * F.lit(all_s + buckets) / ((F.col("s") + 1) * F.lit(all_t + buckets))
    return counts.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weights(docs: DataFrame, gain: DataFrame, buckets: int, longest: int) -> DataFrame:
    """doc_id, n_words, n_features and weight of each document; ``gain`` has one row a bucket and is broadcast.

    A row's features stay in its task, so they are added up before the shuffle and one row a document goes through it.
    """
    number = F.monotonically_increasing_id().alias("_row")
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    exploded = _features(rows, buckets, longest, number, F.col("doc_id"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    met = exploded.join(F.broadcast(gain), "bucket", "left")
    return met.groupBy("_row", "doc_id", "n_words", "n_features").agg(F.coalesce(F.sum("gain"), F.lit(0)).alias("weight")).drop("_row")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the SHA-256 of seed and id; a null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, buckets: int = 10_000, longest: int = 1, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; drawn ones have a rank from 1 on.

    Of the N documents with at least ``least_words`` words, the floor(percent * N / 100) of highest score are drawn, ties to
    the smaller id (a null id last). Null and empty texts have no features and weight 0. Each of several rows of one id
    is a document with the same noise; an empty target leaves all texts to the documents' own rarity. Extra columns
    play no part. Documents are sorted by ranges of score; a document's rank is its place in its range plus the
    rows of all ranges before, of which there are as many rows as ranges.
    """
    weighed = weights(docs, gains(docs, target, buckets, longest), buckets, longest)
    scored = weighed.select("doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("_fit"))
    order = [F.col("_fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc()]
    placed = cut(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part).agg(F.count("*").alias("n"), F.count_if("_fit").alias("fit"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    drawn = (sizes.agg(F.sum("fit")).first()[0] or 0) * percent // 100
    ranked = placed.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn("rank", F.col("_before") + within + 1)
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("_fit") & (F.col("rank") <= drawn), F.col("rank")).alias("rank"))


#: CRC-32 in SQL goes byte by byte through its table of 256 remainders, for each distinct word once.
ORACLE_SQL = r"""
WITH RECURSIVE rem(b, k, c) AS (
  SELECT range, 0, range::BIGINT FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM rem WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS tab FROM rem WHERE k = 8),
w AS (SELECT d, doc_id, unnest(ws) AS word, len(ws) AS n FROM (
  SELECT d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM (SELECT 1 AS d, doc_id, text FROM documents UNION ALL SELECT 2, NULL, text FROM benchmark))),
hx AS (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM w)),
byt AS (SELECT word, list_transform(range(1, length(h), 2), lambda i: (('0x' || substr(h, i, 2))::INT)::BIGINT) AS bs FROM hx),
bk AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, bs), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket FROM byt, tab),
f AS (SELECT d, doc_id, bucket FROM w JOIN bk ON w.word = bk.word),
c AS (SELECT bucket, count(*) FILTER (d = 1) AS s, count(*) FILTER (d = 2) AS t FROM f GROUP BY bucket),
z AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM c),
g AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM c, z),
a AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM f JOIN g ON f.bucket = g.bucket WHERE d = 1 GROUP BY doc_id),
x AS (SELECT o.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             (('0x' || substr(sha256('2024:' || o.doc_id), 1, 8))::BIGINT)::DOUBLE AS h FROM documents o LEFT JOIN a ON o.doc_id = a.doc_id),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k, count(*) FILTER (n_features >= 20) OVER () AS fit FROM y)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
       CASE WHEN n_features >= 20 AND k <= floor(10 * fit / 100) THEN k END::BIGINT AS rank
FROM r
"""
