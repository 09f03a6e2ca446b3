"""Quality rules with host-level verdicts, in built-in expressions only.

A document's measures are taken from its whole text. Failures are added up by host; a host's failure
rate is shrunk towards the rate of all hosts by a beta prior fitted to the hosts' rates by moments,
and its verdict is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def _repeated(words: Column, width: int) -> Column:
    """How many words lie in windows of ``width`` words that occur twice or more in the text."""
    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda k: F.xxhash64(F.slice(words, k, width)))

    def covered(s: Column) -> Column:
        same = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
        starts = F.array_sort(F.transform(same, lambda x: x["k"]))
        step = lambda a, k: F.struct((a["n"] + k + width - F.greatest(a["end"], k)).alias("n"), (k + width).alias("end"))
        return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end")), step)["n"]

    def count(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, k: F.struct(x.alias("h"), k.alias("k"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(placed, covered))

    return F.when(F.size(words) <= width, 0).otherwise(let(hashes, count)).cast("long")


def measures(docs: DataFrame, host: str = "source", width: int = 8) -> DataFrame:
    """doc_id, host and the base measures of each document. A null text has no words; a null host is ''."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), text.alias("t"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    blank = " \t\n\x0b\f\r"
    return rows.select(
        "doc_id",
        "host",
        F.length(F.translate("t", blank, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(
            F.filter(F.split("t", SPACE, -1), lambda x: x != ""),
            lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w, width).alias("n_repeat_words")),
        ).alias("w"),
    ).select("doc_id", "host", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def any_failed() -> Column:
    """What counts against a host: the base rules, one symbol in four words, or mostly repeated lines."""
    return base_failed() | (4 * F.col("n_symbols") > F.col("n_words")) | (10 * F.col("n_dup_lines") > F.col("n_words"))


def host_verdicts(rows: DataFrame) -> DataFrame:
    """host, n, failures, and the rate shrunk by the beta prior; at least one pseudo-document each way.

    Each host's rate counts alike in the prior, so many hosts of one document each pull it towards theirs.
    The prior's strength is ``m (1 - m) / v - 1`` for mean m and variance v of the hosts' rates,
    between 2 and 10,000 (a variance of zero: 10,000). These two numbers alone come to the driver.
    """
    hosts = cut(rows.groupBy("host").agg(F.count("*").alias("host_n"), F.sum(any_failed().cast("long")).alias("host_failures")))
    rate = F.col("host_failures") / F.col("host_n")
    m, v = hosts.agg(F.coalesce(F.avg(rate), F.lit(0.0)), F.coalesce(F.var_pop(rate), F.lit(0.0))).first()
    s = max(2.0, min(10_000.0, m * (1 - m) / v - 1 if v > 1e-12 else 10_000.0))
    return hosts.select("host", "host_n", "host_failures", ((F.col("host_failures") + m * s) / (F.col("host_n") + s)).alias("host_rate"))


def apply_rules(docs: DataFrame, host: str = "source", worst: float = 0.5, width: int = 8, salts: int = 64) -> DataFrame:
    """Each document's measures, base_failed, host_rate and kept.

    ``kept`` is false if a base rule fails or the host's shrunk rate exceeds ``worst``. Empty and null
    texts have no words and fail. Repeated rows count as often as they occur. Verdicts are joined back
    by host and one of ``salts`` numbers, so a host with very many documents meets many tasks; every host
    has that many rows on the other side, which is a small table. A null doc_id stays null.
    """
    rows = cut(measures(docs, host, width))
    verdicts = host_verdicts(rows).select("host", "host_rate", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    out = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "word_chars"), F.lit(salts)).cast("int")).join(verdicts, ["host", "salt"], "left")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & (F.col("host_rate") <= worst)).alias("kept"), F.col("host_rate"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, t, host FROM d),
g AS (SELECT doc_id, k, array_to_string(list_slice(ws, k, k + 7), ' ') AS s
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS k FROM w WHERE len(ws) >= 8)),
r AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM r, (SELECT unnest(range(0, 8)) AS j) GROUP BY doc_id),
m AS (SELECT w.doc_id, host, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT host, count(*) AS n, sum(CASE WHEN base_failed OR 4 * n_symbols > n_words OR 10 * n_dup_lines > n_words THEN 1 ELSE 0 END) AS bad FROM f GROUP BY host),
p AS (SELECT avg(bad / n) AS m, var_pop(bad / n) AS v FROM h),
s AS (SELECT m, greatest(2.0, least(10000.0, CASE WHEN v > 1e-12 THEN m * (1 - m) / v - 1 ELSE 10000.0 END)) AS s FROM p)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (bad + m * s) / (n + s) <= 0.5 AS kept
FROM f JOIN h ON f.host = h.host, s
"""
