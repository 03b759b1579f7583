"""Hard negatives from exact integer products, tile by tile.

Vectors become whole numbers. Anchors are dealt into parts and candidates into blocks; a *cell*
is a part against a block, and no cell grows with the data. A cell multiplies tiles by
Strassen's recursion over int64: seven products of halves instead of eight, odd sides padded
with zeros. Sums and products are exact modulo 2**64, and so are scores below 2**62.

Two passes over the cells. The first keeps, for each anchor, a heap of its best rows of the same
label; the second, for each anchor and positive, a heap of the best rows of other labels within
the positive's window of scores. Heaps of a few entries are all that leaves a cell; heaps of one
anchor merge, in any order, to the heap of their union.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.common import missing_columns, q, written

LEAF = 16  # a side this short is multiplied directly
CELL_ROWS = 4096  # most anchors, and about as many candidates, of a cell
TILE = (512, 1024)
LEAST = np.iinfo(np.int64).min
NORM_LIMIT = 2.0**62


@dataclass(frozen=True)
class Mining:
    """The window is ``low`` to ``high`` hundredths of the positive's score, ends included."""

    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    scale: int = 256
    cell_rows: int = CELL_ROWS

    def window(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest whole number in the window, without leaving int64."""
        whole, rest = np.divmod(score, 100)
        return whole * self.low - (-rest * self.low) // 100, whole * self.high + rest * self.high // 100


# --- products --------------------------------------------------------------------------------


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b`` of int64 matrices, exact modulo 2**64."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
        return strassen(a, b, leaf)[:m, :n]
    r, s, t = m // 2, k // 2, n // 2
    a11, a12, a21, a22 = a[:r, :s], a[:r, s:], a[r:, :s], a[r:, s:]
    b11, b12, b21, b22 = b[:s, :t], b[:s, t:], b[s:, :t], b[s:, t:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((m, n), np.int64)
    out[:r, :t] = p1 + p4 - p5 + p7
    out[:r, t:] = p3 + p5
    out[r:, :t] = p2 + p4
    out[r:, t:] = p1 - p2 + p3 + p6
    return out


# --- heaps -----------------------------------------------------------------------------------


class Heaps:
    """The best ``size`` (score, id) of each of ``count`` rows; ties go to the smaller id."""

    def __init__(self, count: int, size: int):
        self.size = size
        self.rows = self.scores = self.ids = np.empty(0, np.int64)
        self.least = np.full(count, LEAST)  # what a score must reach to enter

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Merge further entries."""
        rows = np.concatenate([self.rows, rows])
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores, rows))
        rows = rows[order]
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        place = np.arange(len(rows)) - np.repeat(starts, np.diff(starts, append=len(rows)))
        stay = place < self.size
        self.rows, self.scores, self.ids = rows[stay], scores[order][stay], ids[order][stay]
        full = place[stay] == self.size - 1
        self.least[self.rows[full]] = self.scores[full]

    def offer(self, first: int, scores: np.ndarray, fits: np.ndarray, ids: np.ndarray) -> None:
        """The fitting scores of a tile, whose rows are those from ``first`` on."""
        span = slice(first, first + len(scores))
        fits = fits & (scores >= self.least[span, None])
        if np.count_nonzero(fits) > 16 * self.size * len(scores) and scores.shape[1] > self.size:
            # Many: what is below the tile's own best need not be sorted.
            shown = np.where(fits, scores, LEAST)
            cut = np.partition(shown, -self.size, axis=1)[:, -self.size]
            fits &= scores >= cut[:, None]
        at, column = np.nonzero(fits)
        if len(at):
            self.add(at + first, scores[at, column], ids[column])


# --- cells -----------------------------------------------------------------------------------


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of lists and all their members in a row."""
    lists = column.combine_chunks()
    return lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists as rows of a matrix, the shorter ones filled up with zeros."""
    lengths, flat = _lists(column)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = flat
    return out


def _width(column: pa.ChunkedArray) -> int:
    return int(_lists(column)[0].max(initial=0))


def _tiles(anchors: pa.Table, others: pa.Table):
    """(first anchor, its span, candidates' span, scores) for every tile of a cell."""
    width = max(_width(anchors["x"]), _width(others["x"]))
    a, b = _matrix(anchors["x"], width), np.ascontiguousarray(_matrix(others["x"], width).T)
    for j in range(0, b.shape[1], TILE[1]):
        for i in range(0, len(a), TILE[0]):
            yield i, slice(i, i + TILE[0]), slice(j, j + TILE[1]), strassen(a[i : i + TILE[0]], b[:, j : j + TILE[1]])


def _positives(size: int):
    def best(anchors: pa.Table, others: pa.Table) -> pa.Table:
        heaps = Heaps(anchors.num_rows, size)
        if anchors.num_rows and others.num_rows:
            own, ids = _numbers(anchors["id"]), _numbers(others["id"])
            label, labels = _numbers(anchors["label"]), _numbers(others["label"])
            for first, i, j, scores in _tiles(anchors, others):
                fits = (label[i, None] == labels[None, j]) & (own[i, None] != ids[None, j])
                heaps.offer(first, scores, fits, ids[j])
            return pa.table({"anchor_id": own[heaps.rows], "id": heaps.ids, "score": heaps.scores})
        return pa.table({n: pa.array([], pa.int64()) for n in ("anchor_id", "id", "score")})

    return best


def _negatives(mining: Mining):
    size = mining.positives

    def best(anchors: pa.Table, others: pa.Table) -> pa.Table:
        names = ("anchor_id", "positive_id", "positive_score", "negative_id", "negative_score")
        if not (anchors.num_rows and others.num_rows):
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        own, ids = _numbers(anchors["id"]), _numbers(others["id"])
        label, labels = _numbers(anchors["label"]), _numbers(others["label"])
        found, goals = _matrix(anchors["found"], size), _matrix(anchors["goal"], size)
        low, high = mining.window(goals)
        missing = np.arange(size)[None, :] >= _lists(anchors["found"])[0][:, None]
        low[missing], high[missing] = 1, 0
        heaps = [Heaps(len(own), mining.negatives) for _ in range(size)]
        for first, i, j, scores in _tiles(anchors, others):
            other = label[i, None] != labels[None, j]
            other &= (scores >= low[i].min(axis=1)[:, None]) & (scores <= high[i].max(axis=1)[:, None])
            if other.any():
                for n in range(size):
                    fits = other & (scores >= low[i, n, None]) & (scores <= high[i, n, None])
                    heaps[n].offer(first, scores, fits, ids[j])
        parts = [(own[h.rows], found[h.rows, n], goals[h.rows, n], h.ids, h.scores) for n, h in enumerate(heaps)]
        return pa.table({name: np.concatenate([p[c] for p in parts]) for c, name in enumerate(names)})

    return best


# --- the operator ----------------------------------------------------------------------------


def whole_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """(id, label, x): the rows that take part, one for each key, with whole numbers.

    Rows without key, label or vector, and rows with a component that is null or not finite, take
    no part. Components are cast to double; x is floor(scale * component). Keys divisible by 7
    move on to the next of ten labels. Rows equal in all three count once; of different rows with
    one key, the one of the smallest label, then vector, counts. A vector whose squares sum to
    2**62 or more raises an error, for its scores may not fit a long.
    """
    missing_columns(rows, key, vector, label)
    values = q(vector).cast("array<double>")
    sound = ~F.exists("values", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == math.inf))
    whole = F.transform("values", lambda v: F.floor(v * F.lit(float(scale))))
    norm = F.aggregate("values", F.lit(0.0), lambda s, v: s + F.pow(F.floor(v * F.lit(float(scale))).cast("double"), 2))
    moved = F.when(F.col("id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    taken = (
        rows.select(q(key).cast("long").alias("id"), q(label).cast("long").alias("label"), values.alias("values"))
        .where("id IS NOT NULL AND label IS NOT NULL AND values IS NOT NULL").where(sound)
        .select("id", moved.alias("label"), F.when(norm < NORM_LIMIT, whole).otherwise(
            F.raise_error(F.lit("a vector is too long for scores in 64 bits"))).alias("x"))
    )
    return taken.groupBy("id").agg(F.min(F.struct("label", "x")).alias("row")).select("id", "row.label", "row.x")


def _cells(anchors: DataFrame, rows: DataFrame, mining: Mining, counts: tuple[int, int]):
    """Anchors and candidates, dealt to cells of bounded size and grouped by them."""
    parts, blocks = (max(1, math.ceil(n / mining.cell_rows)) for n in counts)

    def dealt(df: DataFrame, mine: int, theirs: int, stride: tuple[int, int]) -> DataFrame:
        place = F.pmod(F.xxhash64("id"), F.lit(mine)) * stride[0]
        every = F.sequence(F.lit(0), F.lit((theirs - 1) * stride[1]), F.lit(stride[1]))
        return df.select("*", F.explode(every).alias("_cell")).withColumn("_cell", F.col("_cell") + place)

    left = dealt(anchors, parts, blocks, (blocks, 1))
    right = dealt(rows, blocks, parts, (1, blocks))
    return left.groupBy("_cell").cogroup(right.groupBy("_cell"))


def _first(df: DataFrame, by: list[str], score: str, key: str, size: int) -> DataFrame:
    """Merge heaps: the first ``size`` entries, with their rank. Tasks cut theirs before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(key))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def mine_negatives(
    rows: DataFrame, every: int = 100, mining: Mining = Mining(), key: str = "vec_id",
    vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose key is divisible by ``every``; all rows are candidates. The score is
    the integer inner product; vectors of different lengths count as filled up with zeros. See
    ``whole_vectors`` for nulls and repeated rows. Anchors without positives, and positives
    without a negative in their window, give no row. Other columns are ignored, whatever their names.
    """
    table = written(whole_vectors(rows, key, vector, label, mining.scale), "whole-vectors")
    anchors = table.where(F.col("id") % every == 0)
    counts = anchors.count(), table.count()
    heaps = _cells(anchors, table, mining, counts).applyInArrow(
        _positives(mining.positives), "anchor_id long, id long, score long"
    )
    positives = _first(heaps, ["anchor_id"], "score", "id", mining.positives)
    # At most `positives` entries for each anchor.
    goals = positives.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))
    goals = goals.select("id", F.col("p.id").alias("found"), F.col("p.score").alias("goal"))
    posed = written(anchors.join(goals, "id"), "anchors")
    heaps = _cells(posed, table, mining, counts).applyInArrow(
        _negatives(mining), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    )
    found = _first(heaps, ["anchor_id", "positive_id", "positive_score"], "negative_score", "negative_id", mining.negatives)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda v: floor(256 * CAST(v AS DOUBLE))) AS x
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
  s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
    FROM r AS a, r AS b WHERE a.id % 100 = 0 AND a.id <> b.id),
  p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5"""
