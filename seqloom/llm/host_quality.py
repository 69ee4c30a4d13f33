"""Host-level quality rules, in DataFrame and SQL functions only.

1. Each document is judged by simple rules: too few words, repeated three-word
   windows, symbols, word length, repeated lines.
2. Failures (of any rule) are counted by host, with partial sums before the
   shuffle, so a host with a third of all rows costs one row for each task.
3. The hosts' failure rates give an empirical beta prior by the method of
   moments; each host's rate is shrunk to the posterior mean.
4. A host is rejected if ``threshold`` lies ``DEVIATIONS`` posterior standard
   deviations below its shrunk rate: beyond doubt more of its documents fail than
   that share, whatever their number.  The verdict is joined back to its documents;
   only numbers travel, never texts, and Spark splits a hot host's partition.

A document is kept if it passes the base rules and its host is not rejected.

Defined cases: null and empty texts have no words and fail; null and empty hosts
are one host; repeated rows each get a row and each count; an empty table gives
an empty result; other columns are not read.  Three-word windows are compared by
their 64-bit XXH64.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import stage, table

#: Only a host most of whose documents fail, surely, takes its clean ones along.
THRESHOLD, DEVIATIONS = 0.5, 3.0
SYMBOLS = "#*$%&|<>"
#: Pseudo-counts of the prior: bounds on alpha + beta.
WEIGHT = (2.0, 10_000.0)

def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once, whatever
    the optimiser merges or pushes down."""
    return f"transform(array({value}), {name} -> {body})[0]"


_WORDS = r"filter(split(_text, '[\\x20\\x09-\\x0D]+'), x -> x <> '')"
_WINDOWS = "CASE WHEN size(words) < 3 THEN CAST(array() AS ARRAY<BIGINT>) ELSE transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) END"
#: Windows sorted by hash; the positions of those with an equal neighbour, in
#: order; the words they cover: 3 each, less where the next one starts.
_SORTED = "array_sort(transform(windows, (h, i) -> struct(h, i)))"
_AGAIN = "array_sort(transform(filter(transform(s, (x, k) -> struct(x.i AS i, (k > 0 AND s[k - 1].h = x.h) OR (k + 1 < size(s) AND s[k + 1].h = x.h) AS again)), x -> x.again), x -> x.i))"
_COVERED = "aggregate(transform(p, (x, k) -> CASE WHEN k + 1 < size(p) THEN least(3, p[k + 1] - x) ELSE 3 END), 0L, (a, x) -> a + x)"
#: Repeated words from ``words``.
_REPEATED = _let("windows", _WINDOWS, f"CASE WHEN size(array_distinct(windows)) = size(windows) THEN 0L ELSE {_let('s', _SORTED, _let('p', _AGAIN, _COVERED))} END")
_COUNTS = _let("words", _WORDS, f"struct(size(words) AS n_words, {_REPEATED} AS n_repeat_words)")


def _rules(base: DataFrame) -> DataFrame:
    """``base`` with the base counts, base_failed and failed, from _text."""
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = base.withColumn("_counts", F.expr(_COUNTS)).withColumn("_lines", lines)
    counted = counted.withColumns(
        {
            "n_words": F.col("_counts.n_words").cast("long"),
            "word_chars": F.length(F.translate("_text", " \t\n\x0b\f\r", "")).cast("long"),
            "n_symbols": (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.col("_counts.n_repeat_words").cast("long"),
            "_n_lines": F.size("_lines").cast("long"),
        }
    ).drop("_text", "_counts", "_lines")
    failed = counted.withColumn("base_failed", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
    return failed.withColumn("failed", F.expr("base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 10 * n_dup_lines > 3 * _n_lines")).drop("_n_lines")


def document_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, the base counts, ``base_failed`` and ``failed`` (any rule)."""
    return _rules(docs.select(F.col(id_col).cast("long").alias("doc_id"), _whole(docs[host_col]).alias("host"), _whole(docs[text_col]).alias("_text")))


def _whole(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(""))


def host_verdicts(judged: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """host, n_docs, n_failed, shrunk_rate, rejected; from host and failed."""
    hosts = stage(judged.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed")), "hosts")
    rate = F.col("n_failed") / F.col("n_docs")
    # one row: the moments of the hosts' rates
    row = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("var")).first()
    mean, var = (row["mean"] or 0.0), (row["var"] or 0.0)
    low, high = WEIGHT
    weight = min(max(mean * (1 - mean) / var - 1, low), high) if var > 0 else high
    shrunk = (F.col("n_failed") + F.lit(mean * weight)) / (F.col("n_docs") + F.lit(weight))
    spread = F.sqrt(F.col("shrunk_rate") * (1 - F.col("shrunk_rate")) / (F.col("n_docs") + F.lit(weight + 1)))
    return hosts.withColumn("shrunk_rate", shrunk).withColumn("rejected", F.col("shrunk_rate") - DEVIATIONS * spread > threshold)


def host_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: the counts, base_failed, the host's shrunk rate, kept."""
    judged = stage(document_rules(docs, id_col, text_col, host_col), "judged")
    hosts = host_verdicts(judged, threshold).select("host", "shrunk_rate", "rejected")
    joined = judged.join(hosts, "host", "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("rejected"))


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are kept, with all their columns.

    The rules are judged once: rows and their verdicts are written to the shared
    folder, whence those that pass are read when the hosts are known.  A struct
    keeps the columns of ``docs`` apart, whatever their names.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), _whole(docs[host_col]).alias("host"), _whole(docs[text_col]).alias("_text"))
    judged = stage(_rules(rows).select("_row", "host", "base_failed", "failed"), "judged-rows")
    hosts = host_verdicts(judged.select("host", "failed"), threshold).filter("rejected").select("host")
    return judged.filter("not base_failed").join(hosts, "host", "left_anti").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = host_quality(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, host, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT r, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS k FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
c AS (SELECT w.r, doc_id, host, len(words)::BIGINT AS n_words, length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines FROM w LEFT JOIN rep ON w.r = rep.r),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c),
f AS (SELECT *, base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 12 * n_words OR 10 * n_dup_lines > 3 * n_lines AS failed FROM b),
h AS (SELECT host, count(*) AS n, sum(failed::INT) AS bad FROM f GROUP BY host),
m AS (SELECT avg(bad / n) AS mean, var_pop(bad / n) AS var FROM h),
p AS (SELECT mean, CASE WHEN var > 0 THEN least(greatest(mean * (1 - mean) / var - 1, 2), 10000) ELSE 10000 END AS weight FROM m),
k AS (SELECT host, n, weight, (bad + mean * weight) / (n + weight) AS rate FROM h, p),
v AS (SELECT host, rate - 3 * sqrt(rate * (1 - rate) / (n + weight + 1)) > 0.5 AS rejected FROM k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM f JOIN v ON f.host = v.host
"""
