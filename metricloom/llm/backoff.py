"""Stupid-backoff scores of documents under the n-gram counts of all other documents.

The count tables of all orders are partitioned by hash. Documents are dealt to batches; a batch
sends each of its distinct n-grams once, with its count there, to the partition of the n-gram's
hash; the partition adds the counts of all batches and answers each batch; the batch joins the
answers to its documents' n-grams, position by position, and sums by document. A frequent
n-gram is thus one entry for each batch, however many documents hold it.

Rows carry packed arrays, for an n-gram costs six bytes so, a fifth of a row of its own: the
number of the partition and 48 further bits of its hash tell it apart. Batches and partitions
are sized by bytes of text and grow in number only. A document's own counts are taken off
before it is scored, so that it does not vouch for itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import missing_columns, q

MIX = np.uint64(0x9E3779B97F4A7C15)
START = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Backoff:
    order: int = 2
    discount: float = 0.4
    batch_bytes: int = 8 << 20
    bucket_bytes: int = 32 << 20


def hashed_words(text: str | None) -> np.ndarray:
    """Words are runs without ASCII white space, A-Z lower-cased."""
    ws = (text or "").encode().lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))


def grams(words: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each position, the start of the text first; it stands before
    the text as often as needed."""
    padded = np.concatenate([np.full(order, START, np.uint64), words])
    n = len(words) + 1
    found = np.full(n, order, np.uint64)
    for k in range(order):
        found = (found ^ (found >> np.uint64(29))) * MIX + padded[k : k + n]
    found ^= found >> np.uint64(32)
    found *= MIX
    return found ^ (found >> np.uint64(29))


def _cuts(values: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket, an equal range of hashes, starts among sorted hashes."""
    step = (1 << 64) // buckets
    edges = np.array([min(k * step, (1 << 64) - 1) for k in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(values, edges), [len(values)]])


def _packed(counts: np.ndarray) -> bytes:
    kind = "<u1" if counts.max(initial=0) < 256 else "<u4" if counts.max() < 1 << 32 else "<u8"
    return kind[-1].encode() + counts.astype(kind).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[:1].decode()}", offset=1).astype(np.int64)


def _distinct(texts: list, order: int):
    """Word hashes by text; per order the distinct n-grams, their counts and, for each position
    of all texts in a row, which it is."""
    words = [hashed_words(t) for t in texts]
    tables = []
    for n in range(1, order + 1):
        every = np.concatenate([grams(w, n) for w in words])
        tables.append(np.unique(every, return_inverse=True, return_counts=True))
    return words, tables


def _requests(buckets: int, order: int):
    def send(key: tuple, table: pa.Table) -> pa.Table:
        batch = key[0].as_py()
        _, tables = _distinct(table.column("text").to_pylist(), order)
        rows: dict[str, list] = {"batch": [], "bucket": [], "n": [], "grams": [], "counts": []}
        for n, (values, _, counts) in enumerate(tables, 1):
            cuts = _cuts(values, buckets)
            marks = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            for bucket in np.flatnonzero(np.diff(cuts)):
                part = slice(cuts[bucket], cuts[bucket + 1])
                for name, value in zip(rows, (batch, int(bucket), n, marks[part].tobytes(), _packed(counts[part])), strict=True):
                    rows[name].append(value)
        return pa.table(rows, schema=pa.schema([
            ("batch", pa.int64()), ("bucket", pa.int32()), ("n", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())
        ]))

    return send


def _answers(key: tuple, table: pa.Table) -> pa.Table:
    """The counts of a bucket and order, added up over batches and told to each of them."""
    marks = []
    for data in table.column("grams").to_pylist():
        wide = np.zeros((len(data) // 6, 8), np.uint8)
        wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
        marks.append(wide.view("<u8").ravel())
    counts = [_unpacked(data) for data in table.column("counts").to_pylist()]
    _, which = np.unique(np.concatenate(marks), return_inverse=True)
    own = np.concatenate(counts)
    total = np.bincount(which, own).astype(np.int64)
    others = np.split(total[which] - own, np.cumsum([len(c) for c in counts])[:-1])
    return pa.table(
        {
            "batch": table.column("batch"), "bucket": table.column("bucket"), "n": table.column("n"),
            "others": pa.array([_packed(x) for x in others], pa.binary()),
        }
    )


def _scores(order: int, discount: float, tokens: int):
    floor = math.log10(discount)

    def score(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        ids = docs.column("id")
        words, tables = _distinct(docs.column("text").to_pylist(), order)
        lengths = np.array([len(w) for w in words])
        ends = np.cumsum(lengths + 1)
        counts = []
        placed = sorted(zip(answers.column("n").to_pylist(), answers.column("bucket").to_pylist(),
                            answers.column("others").to_pylist(), strict=True), key=lambda x: x[:2])
        for n, (_, which, own) in enumerate(tables, 1):
            others = [_unpacked(x) for k, _, x in placed if k == n]
            total = own + (np.concatenate(others) if others else 0)
            counts.append((total[which], which))
        sums = []
        for end, length in zip(ends, lengths, strict=True):
            part = slice(end - length - 1, end)
            left = []
            for total, which in counts:
                _, here, n = np.unique(which[part], return_inverse=True, return_counts=True)
                left.append(total[part] - n[here])
            rest = max(1, tokens - int(length))
            best = np.full(length, floor * order - math.log10(rest))
            open_ = np.ones(length, bool)
            for k in range(order, 0, -1):
                seen = open_ & (left[k - 1][1:] > 0)
                below = left[k - 2][:-1][seen] if k > 1 else rest
                best[seen] = floor * (order - k) + np.log10(left[k - 1][1:][seen]) - np.log10(below)
                open_ &= ~seen
            sums.append(float(best.sum()))
        return pa.table({"id": ids, "n_words": pa.array(lengths, pa.int64()), "score": pa.array(sums, pa.float64())})

    return score


def score_documents(docs: DataFrame, model: Backoff = Backoff(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, score, mean_score), one row per input row: the sum of log10 scores of the
    words, and their mean (null for texts without words, whose sum is 0).

    A word whose n-gram stands in no other document backs off to the shorter one, at a discount
    for each step; a word that no other document has counts as one occurrence at one more
    discount. Null texts have no words. Repeated rows are documents of their own and vouch for
    each other. Other columns are ignored, whatever their names.
    """
    missing_columns(docs, key, text)
    rows = docs.select(q(key).alias("id"), F.coalesce(q(text).cast("string"), F.lit("")).alias("text"))
    sizes = rows.agg(
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))), F.lit(0)).alias("words"),
    ).first()
    batches = max(1, -(-sizes["bytes"] // model.batch_bytes))
    buckets = max(1, -(-sizes["bytes"] // model.bucket_bytes))
    dealt = rows.withColumn("batch", F.pmod(F.xxhash64("id", "text"), F.lit(batches)))
    kind = dict(rows.dtypes)["id"]
    requests = dealt.groupBy("batch").applyInArrow(
        _requests(buckets, model.order), "batch long, bucket int, n int, grams binary, counts binary"
    )
    answers = requests.groupBy("bucket", "n").applyInArrow(_answers, "batch long, bucket int, n int, others binary")
    found = dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(
        _scores(model.order, model.discount, sizes["words"]), f"id {kind}, n_words long, score double"
    )
    return found.select(
        F.col("id").alias(key), "n_words", "score",
        F.when(F.col("n_words") > 0, F.col("score") / F.col("n_words")).alias("mean_score"),
    )


def oracle(model: Backoff) -> str:
    """The same in SQL for bigrams."""
    a = model.discount
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w[i] AS word, coalesce(w[i - 1], ' ') AS prev, len(w) AS n
      FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d)),
u AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, word FROM p UNION ALL SELECT doc_id, ' ' FROM d) GROUP BY ALL),
b AS (SELECT doc_id, prev, word, count(*) AS n FROM p GROUP BY ALL),
uo AS (SELECT doc_id, word, sum(n) OVER (PARTITION BY word) - n AS others FROM u),
bo AS (SELECT doc_id, prev, word, sum(n) OVER (PARTITION BY prev, word) - n AS others FROM b),
t AS (SELECT count(*) AS total FROM p),
s AS (SELECT p.doc_id, CASE
        WHEN bo.others > 0 THEN log10(bo.others) - log10(v.others)
        WHEN x.others > 0 THEN log10({a}) + log10(x.others) - log10(greatest(1, total - p.n))
        ELSE 2 * log10({a}) - log10(greatest(1, total - p.n)) END AS score
      FROM p JOIN t ON true JOIN bo USING (doc_id, prev, word) JOIN uo x ON x.doc_id = p.doc_id AND x.word = p.word
      JOIN uo v ON v.doc_id = p.doc_id AND v.word = p.prev),
g AS (SELECT doc_id, sum(score) AS score FROM s GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, round(coalesce(score, 0), 4) + 0.0 AS score,
       round(CASE WHEN len(w) > 0 THEN score / len(w) END, 6) + 0.0 AS mean_score
FROM d LEFT JOIN g USING (doc_id)
"""
