"""Nearest neighbours by inner product: multiprobe hashing with p-stable projections.

Vectors get one more component that makes all of them equally long, so that the largest inner
product becomes the smallest distance; queries get a zero there. That holds within a band of
lengths, each at most ``band`` times the least, scaled to its longest; so a few long vectors do not
move the others out of the queries' reach, and a query, scaled to length one, visits the same
buckets in every band. Bands of at most ``block_rows`` vectors are seen by every query. A table hashes a vector by
``hashes`` rounded Gaussian projections. A query visits its own bucket and the buckets whose
perturbation is likeliest to hold neighbours: its projections' distances to their cell
borders, sorted, are matched with a sequence of perturbation sets in the order of the expected
sum of squares, made once.

Candidates of a bucket lie together with the queries that visit it, and every visit is ranked
by exact inner products in double precision. A task keeps the best of each query; the bests of
all tables and buckets are merged, so the answer is that of reranking the union of all
candidates. Full buckets are cut into blocks of ``block_rows`` vectors which all visits of the
bucket see, so a bucket that holds a third of all vectors is spread over tasks, none left out.
Tasks see ``query_rows`` queries at a time, whose bests are kept as they go on; the vectors go to
each such part. Empty buckets are dropped before a query is sent anywhere, and a task gets a query's vector
once, however many of its buckets it holds. Queries whose buckets hold fewer than they ask for
are compared with every block of one table.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.common import missing_columns, q, written


HELD_ROWS = 1 << 10  # candidates of a query that a task holds before it keeps the best


@dataclass(frozen=True)
class Multiprobe:
    """``width`` is a cell's width in lengths of the band's longest vector. The defaults reach a
    recall of 0.95 and more on vectors without structure; clustered ones need fewer probes."""

    tables: int = 6
    hashes: int = 8
    width: float = 2.5
    probes: int = 80
    band: float = 1.25
    block_rows: int = 2048
    query_rows: int = 4096
    group_rows: int = 1 << 14
    seed: int = 5


def perturbations(hashes: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of places among the 2 x hashes sorted border distances, likeliest first. Place j and
    its mirror belong to one hash, so that no set holds both."""
    n = 2 * hashes
    j = np.arange(1, n + 1)
    near = j * (j + 1) / (4 * (hashes + 1) * (hashes + 2))
    mirrored = n + 1 - j
    far = 1 - mirrored / (hashes + 1) + mirrored * (mirrored + 1) / (4 * (hashes + 1) * (hashes + 2))
    cost = np.where(j <= hashes, near, far)
    found: list[tuple[int, ...]] = [()]
    heap = [(float(cost[0]), (0,))]
    while heap and len(found) < probes:
        total, places = heapq.heappop(heap)
        if len({min(p, n - 1 - p) for p in places}) == len(places):
            found.append(places)
        last = places[-1]
        if last + 1 < n:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*places[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*places, last + 1)))
    return found


class _Hasher:
    def __init__(self, dim: int, model: Multiprobe, longest: float):
        random = np.random.default_rng(model.seed)
        self.model, self.longest, self.width = model, longest, model.width
        self.few = np.zeros(0, np.int64)  # bands that every query sees
        shape = (model.tables, dim + 1, model.hashes)
        self.lines = random.normal(size=shape)
        self.shifts = random.uniform(0, self.width, (model.tables, model.hashes))
        self.factors = random.integers(1 << 40, 1 << 62, (model.tables, model.hashes), np.int64) | 1
        self.sets = perturbations(model.hashes, model.probes)

    def bands(self, vectors: np.ndarray) -> np.ndarray:
        lengths = np.sqrt((vectors**2).sum(axis=1))
        return np.maximum(np.floor(np.log(self.longest / lengths) / np.log(self.model.band)), 0).astype(np.int64)

    def places(self, table: int, vectors: np.ndarray, query: bool) -> np.ndarray:
        if query:
            scaled, more = vectors / np.sqrt((vectors**2).sum(axis=1))[:, None], np.zeros(len(vectors))
        else:
            scaled = vectors / (self.longest * self.model.band ** -self.bands(vectors).astype(np.float64))[:, None]
            more = np.sqrt(np.maximum(1 - (scaled**2).sum(axis=1), 0.0))
        line = self.lines[table]
        return (scaled @ line[:-1] + more[:, None] * line[-1] + self.shifts[table]) / self.width

    def keys(self, table: int, vectors: np.ndarray) -> np.ndarray:
        """Buckets; a band that every query sees is one bucket of the first table."""
        keys = (np.floor(self.places(table, vectors, False)).astype(np.int64) * self.factors[table]).sum(axis=1)
        bands = self.bands(vectors)
        return np.where(np.isin(bands, self.few), -1 - bands, keys)

    def visits(self, table: int, vectors: np.ndarray) -> np.ndarray:
        """queries x probes keys; may name a bucket twice only by a collision of keys."""
        places = self.places(table, vectors, True)
        cells = np.floor(places)
        inside = places - cells
        order = np.argsort(np.concatenate([inside, 1 - inside], axis=1), axis=1, kind="stable")
        steps = np.concatenate([-self.factors[table], self.factors[table]])
        own = (cells.astype(np.int64) * self.factors[table]).sum(axis=1)
        keys = [own + sum((steps[order[:, p]] for p in places), np.int64(0)) for places in self.sets]
        if table == 0:
            keys += [np.full(len(own), -1 - band, np.int64) for band in self.few]
        return np.stack(keys, axis=1)


def usable(vector: Column) -> Column:
    """Not null, no null and no non-finite component, and not zero."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(wide, lambda x: x != 0)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, model: Multiprobe = Multiprobe(), key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """(query_id, rank, key, score): each query's ``k`` best vectors but its own, best first,
    ties by key.

    Both inputs have (key, vector); a vector of an id that is also a query's is not its
    candidate. Rows without an id, and vectors that are null, zero or not finite throughout, take
    no part, nor do those of another length than most. Repeated rows are one candidate, and one
    query. Empty inputs give an empty result. Other columns are ignored.
    """
    missing_columns(vectors, key, vector)
    missing_columns(queries, key, vector)
    kind = "f8" if "double" in dict(vectors.dtypes)[vector] else "f4"
    good = [
        t.where(q(key).isNotNull() & usable(q(vector))).select(q(key).cast("long").alias("id"), q(vector).alias("v"))
        for t in (vectors, queries)
    ]
    lengths = good[0].groupBy(F.size("v").alias("dim")).agg(
        F.count(F.lit(1)).alias("n"), F.max(_square()).alias("most")
    ).orderBy(F.desc("n"), F.desc("dim")).first()
    out = f"query_id long, rank int, {key} long, score double"
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], out)
    dim = lengths["dim"]
    hasher = _Hasher(dim, model, float(np.sqrt(lengths["most"])))
    candidates, asked = (t.where(F.size("v") == dim) for t in good)
    bands = candidates.mapInArrow(_banded(hasher, kind), "band long").groupBy("band").count()
    hasher.few = np.array([x["band"] for x in bands.where(F.col("count") <= model.block_rows).collect()], np.int64)
    placed = written(candidates.mapInArrow(_hashed(hasher, kind), "table int, bucket long, band long, id long, data binary"), "ann-tables")
    groups = max(1, -(-lengths["n"] * model.tables // model.group_rows))
    blocks = placed.groupBy("table", "bucket", "band").agg(
        F.expr(f"(count(1) + {model.block_rows - 1}) div {model.block_rows}").cast("int").alias("blocks")
    )
    bucket = ["table", "bucket"]
    unit = F.xxhash64("table", "bucket", "band", "block")
    own = placed.join(blocks, [*bucket, "band"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select(
        F.pmod(unit, F.lit(groups)).cast("int").alias("task"), unit.alias("unit"), "id", "data", "table"
    )
    visits = written(
        asked.dropDuplicates(["id"]).mapInArrow(_visited(hasher, kind), "id long, data binary, table int, buckets array<long>"),
        "ann-visits",
    )
    sent = visits.select("id", "table", F.explode("buckets").alias("bucket")).join(blocks, bucket).select(
        "id", *bucket, "band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    ).select("id", F.pmod(unit, F.lit(groups)).cast("int").alias("task"), unit.alias("unit"))
    once = visits.where("table = 0").select("id", "data")
    parts = max(1, -(-once.count() // model.query_rows))
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int").alias("part")
    own = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    both = ["task", "part"]
    # a query has at most tables x probes buckets in a band, so its list in a task is short
    lists = sent.groupBy("id", "task").agg(F.collect_set("unit").alias("units"))
    asked_for = lists.join(once, "id").select("task", part, "id", "data", "units")
    pairs = "query long, id long, score double"
    best = written(own.groupBy(*both).cogroup(asked_for.groupBy(*both)).applyInArrow(_ranked(k, kind), pairs), "ann-best")
    # queries that found too few see every block of one table
    enough = best.groupBy("query").agg(F.countDistinct("id").alias("found")).where(F.col("found") >= min(k, lengths["n"] - 1))
    short = written(once.join(enough, once["id"] == enough["query"], "left_anti"), "ann-short")
    if not short.isEmpty():
        everywhere = short.select(
            F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("task"), part, "id", "data", F.lit(None).cast("array<long>").alias("units")
        )
        one = own.where("table = 0")
        best = best.unionByName(one.groupBy(*both).cogroup(everywhere.groupBy(*both)).applyInArrow(_ranked(k, kind), pairs))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    merged = best.groupBy("query", "id").agg(F.max("score").alias("score"))
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        F.col("query").alias("query_id"), "rank", F.col("id").alias(key), "score"
    )


def _square() -> Column:
    return F.aggregate(
        F.transform("v", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda total, x: total + x
    )


def _matrix(batch: pa.RecordBatch, kind: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("v"))
    return column.flatten().to_numpy(zero_copy_only=False).astype(f"<{kind}").reshape(len(column), -1)


def _banded(hasher: _Hasher, kind: str):
    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = hasher.bands(_matrix(batch, kind).astype(np.float64))
                yield pa.RecordBatch.from_arrays([pa.array(found)], names=["band"])

    return banded


def _hashed(hasher: _Hasher, kind: str):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            stored = _matrix(batch, kind)
            data = pa.array([row.tobytes() for row in stored], pa.binary())
            ids = batch.column(batch.schema.get_field_index("id"))
            bands = hasher.bands(stored.astype(np.float64))
            for table in range(hasher.model.tables):
                keys = hasher.keys(table, stored.astype(np.float64))
                made = pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), table, np.int32)), pa.array(keys), pa.array(bands), ids, data],
                    names=["table", "bucket", "band", "id", "data"],
                )
                yield made if table == 0 else made.filter(pa.array(~np.isin(bands, hasher.few)))

    return hashed


def _visited(hasher: _Hasher, kind: str):
    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            stored = _matrix(batch, kind)
            data = pa.array([row.tobytes() for row in stored], pa.binary())
            ids = batch.column(batch.schema.get_field_index("id"))
            for table in range(hasher.model.tables):
                keys = hasher.visits(table, stored.astype(np.float64))
                lists = pa.ListArray.from_arrays(
                    np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), pa.array(keys.ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [ids, data, pa.array(np.full(len(keys), table, np.int32)), lists],
                    names=["id", "data", "table", "buckets"],
                )

    return visited


def _ranked(k: int, kind: str):
    def unpack(column: pa.ChunkedArray) -> np.ndarray:
        rows = column.to_pylist()
        return np.frombuffer(b"".join(rows), f"<{kind}").reshape(len(rows), -1).astype(np.float64)

    def ranked(key: tuple, own: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if own.num_rows and asked.num_rows:
            ids, vectors = own.column("id").to_numpy(), unpack(own.column("data"))
            names, points = asked.column("id").to_numpy(), unpack(asked.column("data"))
            order = np.argsort(own.column("unit").to_numpy(), kind="stable")
            units = own.column("unit").to_numpy()[order]
            edges = np.flatnonzero(np.diff(units, prepend=units[0] - 1))
            rows_of = dict(zip(units[edges].tolist(), np.split(order, edges[1:]), strict=True))
            visits: dict[int, list[int]] = {}
            for row, wanted in enumerate(asked.column("units").to_pylist()):
                for unit in rows_of if wanted is None else wanted:
                    visits.setdefault(unit, []).append(row)
            found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            held = np.zeros(len(names), np.int64)

            def best(row: int) -> tuple[np.ndarray, np.ndarray]:
                return _best(k, names[row], points[row], ids, vectors, found[row])

            for unit, askers in visits.items():
                rows = rows_of.get(unit)
                if rows is None:
                    continue
                for low in range(0, len(rows), HELD_ROWS):
                    some = rows[low : low + HELD_ROWS]
                    products = points[askers] @ vectors[some].T
                    for row, scores in zip(askers, products, strict=True):
                        found.setdefault(row, []).append((some, scores.copy()))
                        held[row] += len(some)
                        if held[row] > max(HELD_ROWS, 2 * k):
                            kept, exact = best(row)
                            found[row], held[row] = [(kept, exact)], len(kept)
            for row in found:
                kept, exact = best(row)
                out.append((np.full(len(kept), names[row], np.int64), ids[kept], exact))
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(
            ("query", "id", "score"), columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)})

    return ranked


def _best(k, name, point, ids, vectors, parts):
    """The k best of some rows, with their scores. Products of matrices may differ in the last place for equal
    vectors, so the rows near the k-th are summed again, component by component."""
    rows = np.concatenate([p[0] for p in parts])
    scores = np.concatenate([p[1] for p in parts])
    other = ids[rows] != name
    rows, scores = rows[other], scores[other]
    _, once = np.unique(ids[rows], return_index=True)
    rows, scores = rows[once], scores[once]
    if len(rows) > k:
        slack = 1e-9 * (1 + np.abs(scores).max())
        near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k] - slack
        rows = rows[near]
    exact = np.zeros(len(rows))
    chosen = vectors[rows]
    for d in range(chosen.shape[1]):
        exact += point[d] * chosen[:, d]
    top = np.lexsort((ids[rows], -exact))[:k]
    return rows[top], exact[top]
