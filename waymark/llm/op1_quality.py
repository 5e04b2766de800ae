"""Operator 1, quality rules at host level; DataFrame functions only.

Every document gets base statistics and a base verdict.  Verdicts are counted
per host (here: ``source``), each host's failure rate is shrunk towards the
corpus by a beta prior fitted to the hosts themselves (method of moments), and
the host's verdict is joined back: documents of a host whose shrunk failure
rate exceeds ``max_host_rate`` are not kept, even if they pass on their own.

Defined results: a null or empty text has no words, so all counts are 0 and it
fails; a null host has no host verdict, so the base verdict stands; repeated
rows and repeated ids are judged row by row; an empty table gives an empty
result; other columns of the input are ignored, whatever their names.

Eight-word windows are compared by a 64-bit hash within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, join_lookup, let, settle_table, table

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_HOST_RATE = 0.5


def _covered(hashes: Column) -> Column:
    """Words under windows whose hash occurs twice or more."""
    paired = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def starts(s: Column) -> Column:
        twice = F.filter(s, lambda e, j: (F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"]))
        return F.array_sort(F.transform(twice, lambda e: e["i"]))

    first = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("at"))
    return F.aggregate(
        let(paired, starts),
        first,
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["at"]).cast("long")).alias("n"), i.alias("at")),
        lambda a: a["n"],
    )


def text_stats(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    text = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        n = F.size(words)
        one_each = F.transform(words, lambda w: F.xxhash64(w))
        windows = let(
            one_each,
            lambda hs: F.when(
                F.size(hs) >= WINDOW,
                F.transform(F.sequence(F.lit(1), F.size(hs) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hs, i, WINDOW))),
            ).otherwise(F.array().cast("array<bigint>")),
        )
        repeat = let(
            windows,
            lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(_covered(hs)),
        )
        return F.struct(n.cast("long").alias("n_words"), repeat.alias("n_repeat_words"))

    words = let(F.filter(F.split(text, WHITE), lambda w: w != ""), of_words)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup_lines = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    word_chars = F.length(F.regexp_replace(text, WHITE, "")).cast("long")
    symbols = (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long")
    return F.struct(words.alias("w"), word_chars.alias("word_chars"), symbols.alias("n_symbols"), dup_lines.alias("n_dup_lines"))


def document_stats(docs: DataFrame, host: str = "source", carry: bool = False) -> DataFrame:
    """doc_id, host, the base statistics and ``base_failed`` of every document; with ``carry`` also ``row``, all its columns."""
    row = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []
    s = docs.select("doc_id", F.col(host).cast("string").alias("host"), text_stats(F.col("text")).alias("s"), *row)
    flat = s.select("doc_id", "host", "s.w.n_words", "s.word_chars", "s.n_symbols", "s.n_dup_lines", "s.w.n_repeat_words", *(["row"] if carry else []))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return flat.withColumn("base_failed", failed)


def host_verdicts(stats: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> tuple[DataFrame, int]:
    """One row a host with its shrunk failure rate and ``host_ok``; and how many hosts there are.

    The prior is Beta(a, b) with the corpus' failure rate m as mean and the
    spread of host rates v as variance: a + b = m (1 - m) / v - 1, between 1 and 10,000.
    """
    hosts = stats.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    rate = F.col("failed") / F.col("n")
    prior = hosts.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.var_pop(rate).alias("v")).first()
    k, mean, v = prior["k"], (prior["failed"] or 0) / max(prior["n"] or 0, 1), prior["v"] or 0.0
    strength = min(max(mean * (1 - mean) / v - 1 if v > 0 else 10_000.0, 1.0), 10_000.0)
    shrunk = (F.col("failed") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return hosts.select("host", shrunk.alias("host_rate"), (shrunk <= max_host_rate).alias("host_ok")), k


def judge(docs: DataFrame, host: str = "source", max_host_rate: float = MAX_HOST_RATE, carry: bool = False) -> DataFrame:
    """Every document with base statistics, ``host_rate`` and ``kept`` (and ``row``, see ``document_stats``)."""
    stats = settle_table(document_stats(docs, host, carry))  # the texts are read once, verdicts need the narrow columns
    hosts, k = host_verdicts(stats, max_host_rate)
    joined = join_lookup(stats, hosts, ["host"], k, F.col("doc_id"))
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce("host_ok", F.lit(True))).drop("host_ok")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, source, text,
         list_filter(regexp_split_to_array(text, '{WHITE}'), lambda x: x <> '') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), win AS (
  SELECT rid, i, array_to_string(ws[i : i + {WINDOW - 1}], ' ') AS k
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT rid, sum(least({WINDOW}, coalesce(i - p, {WINDOW}))) AS n
  FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM twice) GROUP BY rid
), s AS (
  SELECT doc_id, source, len(ws)::BIGINT AS n_words,
         length(regexp_replace(text, '{WHITE}', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep USING (rid)
), b AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM s
), h AS (
  SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS failed FROM b WHERE source IS NOT NULL GROUP BY source
), p AS (
  SELECT coalesce(sum(failed) / nullif(sum(n), 0), 0) AS m, coalesce(var_pop(failed / n), 0) AS v FROM h
), q AS (
  SELECT m, least(greatest(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 10000 END, 1), 10000) AS k FROM p
), o AS (
  SELECT source, (failed + (SELECT m * k FROM q)) / (n + (SELECT k FROM q)) <= {MAX_HOST_RATE} AS ok FROM h
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(ok, true) AS kept
FROM b LEFT JOIN o USING (source)
"""
