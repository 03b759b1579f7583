"""Quality of documents from their words and from the sites they stand on.

A document classifier gives log odds of a text being of low quality and of being toxic: weights
of hashed words and of style measures, learnt from a bounded sample of labelled documents and
shrunk where words are rare. Logistic regression calibrates them on the same sample, where each
half is weighed by what the other half has taught.

Sites then add what documents alone do not show. Expected bad documents are summed by host and
by path over all documents. A host's rate is shrunk towards the corpus, a path's towards its
host, with strengths fitted to the spread between hosts and between paths (empirical Bayes),
so that sparse sites stay near the prior. A document's odds are multiplied by the odds of its
path against those of the corpus, its own part in that path taken out.

Texts are read where they lie, never shuffled; two grouped sums over narrow rows are the only
exchanges besides the training sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import missing_columns, q, written
from metricloom.llm.host_rules import prior

BUCKETS = 1 << 18
BINS = 16
FEATURES = 5
LARGEST = 30.0  # log odds
CLEAR = 1.0  # weights of words that say something by themselves
BEGINNINGS = (5, 7)  # bytes
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))
DIGITS = b"0123456789"
SIGNS = b"#*$%&|<>@~^=_{}[]\\"
EDGES = b".,;:!?\"'()[]{}#*$%&|<>-"
HEADS = ("low", "toxic")


@dataclass(frozen=True)
class SiteModel:
    """``max_labels`` bounds the training sample: the labelled documents first by a hash of their
    keys. ``pseudo`` documents of the usual classes are added to those that hold a word; ``limit`` is the probability from
    which a document is rejected."""

    max_labels: int = 40_000
    pseudo: float = 3.0
    limit: float = 0.5
    seed: int = 11


def measures(text: str | None) -> np.ndarray:
    """The hashed distinct words of a text and its binned style measures, as table positions."""
    data = (text or "").encode()
    ws = data.split()
    n, size = max(1, len(ws)), max(1, len(data))
    letters = max(1, size - len(data.translate(None, LETTERS)))
    lines = [x for x in data.split(b"\n") if x.strip()]
    style = (
        (size - len(data.translate(None, UPPER))) / letters,
        (size - len(data.translate(None, DIGITS))) / size,
        (size - len(data.translate(None, SIGNS))) / size,
        data.count(b"!") / n,
        data.count(b"|") / n,
        len(set(ws)) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, size / n / 20),
        min(1.0, np.log2(1 + len(ws)) / 16),
    )
    bins = [BUCKETS + k * BINS + min(BINS - 1, int(BINS * min(1.0, x) ** 0.5)) for k, x in enumerate(style)]
    plain = {w.strip(EDGES) for w in set(data.lower().split())}
    # beginnings stand for the inflected and compound words that a sample has not seen
    plain |= {b"<" + w[:n] for w in plain for n in BEGINNINGS if len(w) > n}
    hashed = {xxhash.xxh3_64_intdigest(w) & (BUCKETS - 1) for w in plain}
    return np.fromiter((*hashed, *bins), np.uint32, len(hashed) + len(bins))


SIZE = BUCKETS + 9 * BINS


def evidence(positions: np.ndarray, weights: np.ndarray) -> list[float]:
    """For a head: the words' clear weights summed, the largest, the three largest, the logarithm
    of the number of words, and the style's weights summed."""
    style = positions >= BUCKETS
    words = weights[positions[~style]]
    return [
        float(words[words > CLEAR].sum()), float(words.max(initial=0.0)), float(np.sort(words)[-3:].sum()),
        float(np.log1p(len(words))), float(weights[positions[style]].sum()),
    ]


@dataclass(frozen=True)
class Classifier:
    """Weights of words and style by head, and the calibration of their evidence."""

    weights: np.ndarray  # heads x SIZE
    coefficients: np.ndarray  # heads x features
    intercepts: np.ndarray

    def log_odds(self, text: str | None) -> list[float]:
        positions = measures(text)
        return [
            float(np.clip(np.dot(evidence(positions, w), c) + b, -LARGEST, LARGEST))
            for w, c, b in zip(self.weights, self.coefficients, self.intercepts, strict=True)
        ]


def training_sample(docs: DataFrame, labels: DataFrame, model: SiteModel, key: str, text: str) -> DataFrame:
    """(half, low, toxic, positions) of the sampled documents.

    Labels of one document are merged (low or toxic if any says so); null labels count as good.
    The sample's bound makes its broadcast small.
    """
    rank = F.xxhash64(F.lit(model.seed), F.col("id"))
    merged = labels.where(q(key).isNotNull()).groupBy(q(key).cast("long").alias("id")).agg(
        F.max((F.coalesce(q("quality"), F.lit(1)) == 0).cast("int")).alias("low"),
        F.max((F.coalesce(q("toxic"), F.lit(0)) == 1).cast("int")).alias("toxic"),
    )
    sample = merged.orderBy(rank, "id").limit(model.max_labels).withColumn("half", F.pmod(rank, F.lit(2)).cast("int"))

    @F.pandas_udf("binary")
    def packed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: measures(t).astype("<u4").tobytes())

    rows = docs.select(q(key).cast("long").alias("id"), q(text).cast("string").alias("text"))
    return written(
        rows.join(F.broadcast(sample), "id").select("half", "low", "toxic", packed("text").alias("positions")),
        "quality-sample",
    )


def _word_weights(sample: DataFrame, model: SiteModel) -> np.ndarray:
    """Shrunk log ratios of the rates at which bad and good documents hold each position: from
    either half of the sample, and from both together."""

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((3, SIZE), np.int64)
        for part in parts:
            for low, toxic, data in zip(part["low"], part["toxic"], part["positions"], strict=True):
                at = np.frombuffer(data, "<u4")
                sums[0, at] += 1
                sums[1, at] += low
                sums[2, at] += toxic
        used = np.flatnonzero(sums[0])
        yield pd.DataFrame({"at": used, "n": sums[0, used], "low": sums[1, used], "toxic": sums[2, used]})

    totals = {
        r[0]: r[1:] for r in sample.groupBy("half").agg(F.count(F.lit(1)), F.sum("low"), F.sum("toxic")).collect()
    }
    tables = {half: np.zeros((3, SIZE)) for half in (0, 1)}
    for half, table in tables.items():
        rows = sample.where(F.col("half") == half).select("low", "toxic", "positions")
        rows = rows.mapInPandas(counted, "at long, n long, low long, toxic long")
        # at most SIZE rows come to the driver, whatever the corpus, and as columns
        at, *sums = rows.groupBy("at").agg(F.sum("n"), F.sum("low"), F.sum("toxic")).toArrow().columns
        table[:, at.to_numpy()] = [s.to_numpy() for s in sums]
    none = (0, 0, 0)
    sizes = [np.array([x or 0 for x in totals.get(half, none)]) for half in (0, 1)]
    parts = ((tables[0], sizes[0]), (tables[1], sizes[1]), (tables[0] + tables[1], sizes[0] + sizes[1]))
    return np.stack([_ratios(table, size, model.pseudo) for table, size in parts])


def _ratios(table: np.ndarray, size: np.ndarray, pseudo: float) -> np.ndarray:
    weights = np.zeros((len(HEADS), SIZE))
    n, *bads = size
    if n:
        seen = table[0] > 0
        for k, bad in enumerate(bads):
            share = (bad + 0.5) / (n + 1)
            one = table[k + 1] + pseudo * share
            other = table[0] - table[k + 1] + pseudo * (1 - share)
            weights[k, seen] = np.log(one[seen] / other[seen]) - np.log(share / (1 - share))
    return weights


def fit(docs: DataFrame, labels: DataFrame, model: SiteModel = SiteModel(), key: str = "doc_id", text: str = "text") -> Classifier:
    """The classifier of a bounded labelled sample. With one class only, the evidence counts for
    nothing and the odds are those of the class; without labels, every document is good."""
    missing_columns(docs, key, text)
    missing_columns(labels, key, "quality", "toxic")
    sample = training_sample(docs, labels, model, key, text)
    weights = _word_weights(sample, model)

    @F.pandas_udf("array<double>")
    def evidences(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for halves, packed in parts:
            found = zip(halves, (np.frombuffer(x, "<u4") for x in packed), strict=True)
            # each document is weighed by what the other half has taught
            yield pd.Series([[v for w in weights[1 - half] for v in evidence(at, w)] for half, at in found])

    second = written(sample.select("low", "toxic", evidences("half", "positions").alias("e")), "quality-evidence")
    totals = second.agg(F.count(F.lit(1)), F.sum("low"), F.sum("toxic")).first()
    coefficients, intercepts = np.zeros((len(HEADS), FEATURES)), np.zeros(len(HEADS))
    for k, head in enumerate(HEADS):
        n, bad = totals[0], totals[k + 1] or 0
        if not 0 < bad < n:
            intercepts[k] = np.log((bad + 0.5) / (n - bad + 0.5)) if n else -LARGEST
            continue
        rows = second.select(
            F.col(head).cast("double").alias("label"), array_to_vector(F.slice("e", FEATURES * k + 1, FEATURES)).alias("features")
        )
        line = LogisticRegression(maxIter=50, regParam=1e-3).fit(rows)
        coefficients[k], intercepts[k] = line.coefficients.toArray(), line.intercept
    return Classifier(weights[2], coefficients, intercepts)


def log_odds(spark, classifier: Classifier, text: Column) -> Column:
    """array(low, toxic) of log odds; computed in place, a batch at a time."""
    sent = spark.sparkContext.broadcast(classifier)

    @F.pandas_udf("array<double>")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        judge = sent.value
        for part in parts:
            yield pd.Series([judge.log_odds(t) for t in part])

    return scored(text.cast("string"))


def bad_probability(odds: Column) -> Column:
    """Of being low or toxic, from the two log odds."""
    good = lambda k: 1 / (1 + F.exp(F.get(odds, F.lit(k))))
    return 1 - good(0) * good(1)


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float]:
    """Per (host, path) of (host, path, p): n, the sum, the strength of the path level, the same of
    the host and its posterior rate; and the corpus rate. Null hosts and paths are sites of their own."""
    paths = written(
        scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s")), "quality-paths"
    )
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n_host"), F.sum("s").alias("s_host"))
    mean, strength = prior(*_spread(hosts, "n_host", "s_host"))
    hosts = hosts.withColumn(
        "host_rate", (F.col("s_host") + F.lit(mean * strength)) / (F.col("n_host") + F.lit(strength))
    )
    named = hosts.select(F.col("host").alias("_host"), "host_rate", "n_host", "s_host", F.lit(strength).alias("host_strength"))
    joined = paths.join(named, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    within = joined.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"),
        F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("host_rate"), 2)).alias("spread"),
        F.sum(F.col("n") * F.col("host_rate") * (1 - F.col("host_rate"))).alias("chance"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
    ).first()
    return joined.withColumn("path_strength", F.lit(_path_strength(within))), mean


def _spread(sites: DataFrame, n: str, s: str) -> tuple[int, int, float, float, float]:
    row = sites.agg(
        F.count(F.lit(1)), F.sum(n), F.sum(s), F.sum(F.col(n).cast("double") * F.col(n)),
        F.sum(F.col(s) * F.col(s) / F.col(n)),
    ).first()
    return row[0], row[1] or 0, row[2] or 0.0, row[3] or 0.0, row[4] or 0.0


def _path_strength(row) -> float:
    n = row["n"] or 0
    chance = (row["chance"] or 0.0) / n if n else 0.0
    free = n - (row["nn"] or 0.0) / n - row["k"] if n else 0.0
    if chance <= 0 or free <= 0:
        return 1e6
    rho = min(max((row["spread"] / chance - row["k"]) / free, 1e-6), 0.999)
    return 1 / rho - 1


def _combined(scored: DataFrame, sites: DataFrame, mean: float) -> DataFrame:
    """``scored`` with host_rate, path_rate and probability.

    A document's own part is taken out of its path and of the host that the path is shrunk to: a
    site of one document says no more than the corpus.
    """
    sites = sites.withColumnsRenamed({"host": "_host", "path": "_path"})
    together = scored.join(
        sites, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path"))
    )
    rest = lambda total: F.greatest(F.col(total) - F.col("p"), F.lit(0.0))
    host = (rest("s_host") + F.lit(mean) * F.col("host_strength")) / (F.col("n_host") - 1 + F.col("host_strength"))
    others = (rest("s") + host * F.col("path_strength")) / (F.col("n") - 1 + F.col("path_strength"))
    odds = lambda x: F.log(x) - F.log(1 - x)
    inside = lambda x: F.least(F.greatest(x, F.lit(1e-9)), F.lit(1 - 1e-9))
    middle = float(np.clip(mean, 1e-9, 1 - 1e-9))
    total = odds(inside(F.col("p"))) + odds(inside(F.col("path_rate"))) - float(np.log(middle) - np.log(1 - middle))
    return together.withColumn("path_rate", others).withColumn("probability", 1 / (1 + F.exp(-total)))


def _scores(docs: DataFrame, classifier: Classifier, text: str, host: str, path: str, **more: Column) -> DataFrame:
    odds = log_odds(docs.sparkSession, classifier, q(text))
    columns = [v.alias(k) for k, v in more.items()]
    rows = docs.select(*columns, q(host).cast("string").alias("host"), q(path).cast("string").alias("path"), odds.alias("odds"))
    return rows.withColumn("p", bad_probability(F.col("odds")))


def classify_documents(
    docs: DataFrame, labels: DataFrame, model: SiteModel = SiteModel(), key: str = "doc_id", text: str = "text",
    host: str = "source", path: str = "lang",
) -> DataFrame:
    """(key, low_odds, toxic_odds, host_rate, path_rate, probability, kept), one row per input row.

    A null text is read as an empty one. Null keys get a result like others but never train.
    Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    missing_columns(docs, key, text, host, path)
    classifier = fit(docs, labels, model, key, text)
    scored = written(_scores(docs, classifier, text, host, path, id=q(key)), "quality-scores")
    sites, mean = site_posteriors(scored)
    found = _combined(scored, sites, mean)
    return found.select(
        F.col("id").alias(key), F.get("odds", F.lit(0)).alias("low_odds"), F.get("odds", F.lit(1)).alias("toxic_odds"),
        "host_rate", "path_rate", "probability", (F.col("probability") < model.limit).alias("kept"),
    )


def keep_documents(
    docs: DataFrame, labels: DataFrame, model: SiteModel = SiteModel(), key: str = "doc_id", text: str = "text",
    host: str = "source", path: str = "lang",
) -> DataFrame:
    """The documents that pass, with their own columns. Texts are scored twice, once for the
    sites and once for the verdicts, rather than shuffled."""
    missing_columns(docs, key, text, host, path)
    classifier = fit(docs, labels, model, key, text)
    sites, mean = site_posteriors(written(_scores(docs, classifier, text, host, path).select("host", "path", "p"), "quality-scores"))
    sites = written(sites, "quality-sites")
    own = F.struct(*[q(c) for c in docs.columns])
    kept = _combined(_scores(docs, classifier, text, host, path, own=own), sites, mean).where(
        F.col("probability") < model.limit
    )
    return kept.select(*[F.col("own")[c].alias(c) for c in docs.columns])
