"""Quality rules with host verdicts.

Every document is measured and judged by base rules. The failures are then counted by host,
each host's failure rate is shrunk towards the corpus by a beta prior fitted to all hosts, and
a host whose rate is surely too high loses its other documents as well.

Only column expressions are used. Measuring is a projection without a shuffle; hosts meet in
one partially aggregated exchange of (host, documents, failures); the verdicts go back through
a join with the hosts, which is small unless hosts are many.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import SPACE, WORD, bind, missing_columns, q, words, written

SYMBOLS = "#*$%&|<>"
SPACE_CHARACTERS = " \t\n\x0b\f\r"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class HostRules:
    """The limits. ``deviations`` is how many posterior standard deviations a host's rate must
    lie above ``max_host_rate`` before the host is rejected."""

    min_words: int = 20
    max_repeat_percent: int = 30
    window: int = 8
    max_host_rate: float = 0.5
    deviations: float = 2.0


def n_repeat_words(ws: Column, width: int) -> Column:
    """Words inside windows of ``width`` words that occur twice or more in the text.

    Windows are compared by 64-bit hashes of their words' hashes. Texts without a repeated
    window, nearly all, stop after one pass; the others sort their windows.
    """

    def covered(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def lengths(ordered: Column) -> Column:
            same = F.filter(
                ordered,
                lambda x, k: F.coalesce(F.get(ordered, k - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(ordered, k + 1)["h"] == x["h"], F.lit(False)),
            )
            starts = F.array_sort(F.transform(same, lambda x: x["i"]))
            return bind(
                starts,
                lambda at: F.aggregate(
                    F.transform(
                        at, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - p, F.lit(width)))
                    ),
                    F.lit(0).cast("long"),
                    lambda total, n: total + n,
                ),
            )

        return bind(placed, lengths)

    def windows_of(hashes: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(hashes) - width)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))

    def measured(hashes: Column) -> Column:
        return bind(
            windows_of(hashes),
            lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(covered(g)),
        )

    return F.when(F.size(ws) <= width, F.lit(0).cast("long")).otherwise(
        bind(F.transform(ws, lambda w: F.xxhash64(w)), measured)
    )


def measures(text: Column, rules: HostRules = HostRules()) -> Column:
    """A struct of the five measures of a text; a null text has none of anything."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))

    def of(ws: Column) -> Column:
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.translate(text, SPACE_CHARACTERS, "")).cast("long").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            n_repeat_words(ws, rules.window).alias("n_repeat_words"),
        )

    return bind(words(text), of)


def base_failed(measured: Column, rules: HostRules = HostRules()) -> Column:
    few = measured["n_words"] < rules.min_words
    return few | (100 * measured["n_repeat_words"] > rules.max_repeat_percent * measured["n_words"])


def host_rates(judged: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """Per host of (host, failed): documents, failures, the shrunk rate and the verdict.

    The prior's mean is the corpus rate; its strength comes from the spread between hosts
    (analysis of variance, intra-class correlation). Without any spread beyond chance, or
    with one host, every host gets nearly the corpus rate. Rows without a host are left out.
    """
    hosts = judged.where(F.col("host").isNotNull()).groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed")
    )
    total = hosts.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"),
        F.sum(F.col("n_docs").cast("double") * F.col("n_docs")).alias("nn"),
        F.sum(F.col("n_failed").cast("double") * F.col("n_failed") / F.col("n_docs")).alias("ff"),
    ).first()
    mean, strength = prior(total["k"], total["n"] or 0, total["f"] or 0, total["nn"] or 0.0, total["ff"] or 0.0)
    rate = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n_docs") + F.lit(strength + 1)))
    return hosts.withColumn("rate", rate).withColumn(
        "rejected", F.col("rate") - rules.deviations * spread > rules.max_host_rate
    )


def prior(hosts: int, n: int, failed: int, squares: float, weighted: float) -> tuple[float, float]:
    """Mean and strength of the beta prior from sums over hosts of n, f, n² and f²/n."""
    mean = failed / n if n else 0.0
    chance = mean * (1 - mean)
    free = n - squares / n - (hosts - 1) if n else 0.0
    if hosts < 2 or chance == 0 or free <= 0:
        return mean, 1e6
    spread = weighted - mean * failed
    rho = min(max((spread / chance - (hosts - 1)) / free, 1e-6), 0.999)
    return mean, 1 / rho - 1


def judge_documents(
    docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", rules: HostRules = HostRules()
) -> DataFrame:
    """(key, the five measures, base_failed, host_rate, kept), one row per input row.

    A null text has no words and fails. Rows without a host, and every row of an empty prior,
    are judged by the base rules alone (host_rate null). Repeated rows count and come back as
    often as they stand there. Other columns are ignored, whatever their names. The measures
    are written once, without the texts, for they are used twice.
    """
    missing_columns(docs, key, text, host)
    m = F.col("m")
    measured = docs.select(
        q(key).alias("id"), q(host).cast("string").alias("host"), measures(q(text), rules).alias("m")
    ).select("id", "host", *[m[c].alias(c) for c in MEASURES], base_failed(m, rules).alias("failed"))
    judged = written(measured, "host-rules")
    hosts = host_rates(judged, rules).select("host", F.col("rate").alias("host_rate"), "rejected")
    return judged.join(hosts, "host", "left").select(
        F.col("id").alias(key), *MEASURES, F.col("failed").alias("base_failed"), "host_rate",
        (~F.col("failed") & ~F.coalesce("rejected", F.lit(False))).alias("kept"),
    )


def keep_documents(
    docs: DataFrame, text: str = "text", host: str = "source", rules: HostRules = HostRules()
) -> DataFrame:
    """The documents that pass, with their own columns.

    Texts are not shuffled for it: the first pass measures and counts by host, the second
    measures again, drops what fails, and drops rejected hosts by an anti-join with their
    table, whose written size lets the optimiser choose a broadcast.
    """
    missing_columns(docs, text, host)
    failed = bind(measures(q(text), rules), lambda m: base_failed(m, rules))
    judged = docs.select(q(host).cast("string").alias("host"), failed.alias("failed"))
    rates = host_rates(written(judged, "host-failures"), rules)
    rejected = written(rates.where("rejected").select(F.col("host").alias("_rejected_host")), "rejected-hosts")
    passed = docs.where(~failed)
    return passed.join(rejected, passed[_quoted(host)].cast("string") == rejected["_rejected_host"], "left_anti")


def _quoted(name: str) -> str:
    return name if name.isidentifier() else f"`{name}`"


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) > 8)),
dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, range(8) AS r(k) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)),
                                 lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
m AS (
  SELECT d.doc_id, d.source, len(w) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words
  FROM d JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM j
      WHERE source IS NOT NULL GROUP BY source),
t AS (SELECT count(*) AS k, sum(n) AS n, sum(f) AS f, sum(n::DOUBLE * n) AS nn, sum(f::DOUBLE * f / n) AS ff FROM h),
r AS (SELECT *, f / n AS mean, (f / n) * (1 - f / n) AS chance, n - nn / n - (k - 1) AS free FROM t),
s AS (SELECT mean, CASE WHEN k < 2 OR chance = 0 OR free <= 0 THEN 1e6
        ELSE 1 / least(greatest(((ff - mean * f) / chance - (k - 1)) / free, 1e-6), 0.999) - 1 END AS strength FROM r),
p AS (SELECT source, (f + mean * strength) / (n + strength) AS rate, n + strength + 1 AS weight FROM h, s),
v AS (SELECT source, rate - 2 * sqrt(rate * (1 - rate) / weight) > 0.5 AS rejected, rate FROM p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       round(rate, 9) + 0.0 AS host_rate, NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM j LEFT JOIN v USING (source)
"""
