"""Every point with every other, where the triangle inequality rules out too little.

Points are packed side by side, cell after cell, into rows of bounded size, which are written once. Each
two packs meet in one task that reads both from the shared folder: a cartesian product of some thousand
points by some thousand, and so nothing is copied to cells or blocks, shuffled or sent through the driver.
Disk grows with the points and not with what they are compared with; only time does. A task keeps the
points of two packs and a part of ``PAIRS`` pairs. Within it, cells that are too far apart are still passed over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StructType

from metricloom.operators.cells import BLOCK_ROWS, _gaps, _slack, _strips, distances, pairs_within
from metricloom.session import stored

PACK_ROWS, PACK_VALUES = 16_384, 1 << 19  # most points and numbers in a pack
# A writer and a reader hold a file's packs, and as much again for a codec if they are compressed.
FILE = {"maxRecordsPerFile": 4, "compression": "uncompressed"}
_BINARY = ("x", "w", "starts", "centres", "radii")


def pack_rows(points: int, dims: int) -> int:
    """Points of a pack: a few dozen packs at least, unless they would be smaller than blocks."""
    return max(1, min(PACK_ROWS, PACK_VALUES // max(1, dims), max(BLOCK_ROWS, math.ceil(points / 8))))


def packed(points: DataFrame, rows: int, metric: str) -> DataFrame:
    """``points`` (id, x, w, cell) as packs of ``rows`` at most; each point is in one."""
    schema = StructType().add("ids", ArrayType(points.schema["id"].dataType))
    for name in _BINARY:
        schema.add(name, BinaryType())
    parts = max(points.sparkSession.sparkContext.defaultParallelism, math.ceil(points.count() / (4 * rows)))
    # Also by hash, for a cell that cannot be divided may hold most of the points.
    dealt = points.select("id", "x", "w", "cell").repartitionByRange(parts, "cell", F.xxhash64("x"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not batches:
            return
        whole = pa.Table.from_batches(batches)
        step = math.ceil(whole.num_rows / max(1, math.ceil(whole.num_rows / rows)))
        for at in range(0, whole.num_rows, max(1, step)):
            yield _pack(whole.slice(at, step), metric)

    packs = dealt.sortWithinPartitions("cell").mapInArrow(pack, schema)
    return stored(packs.withColumn("pack", F.monotonically_increasing_id()), "packs", **FILE)


def _pack(points: pa.Table, metric: str) -> pa.RecordBatch:
    ids, coordinates = points["id"].combine_chunks(), points["x"].combine_chunks()
    widths = coordinates.value_lengths().to_numpy()
    if (widths != widths[0]).any():
        raise ValueError("points have different numbers of coordinates")
    x = coordinates.flatten().to_numpy().reshape(len(ids), widths[0])
    cell, w = points["cell"].to_numpy(), points["w"].to_numpy().astype("int64")
    starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    sizes = np.diff(np.append(starts, len(ids)))
    centres = np.add.reduceat(x, starts, axis=0) / sizes[:, None]
    gaps = _gaps(x, centres, np.arange(len(ids)), np.repeat(np.arange(len(starts)), sizes), metric)
    single = x.astype("f4")
    values = (single if (single == x).all() else x, w, starts.astype("int64"), centres, np.maximum.reduceat(gaps, starts))
    lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    return pa.RecordBatch.from_arrays(
        [lists, *(pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in values)], names=["ids", *_BINARY]
    )


def meetings(packs: DataFrame) -> DataFrame:
    """Each two packs once, a pack with itself as well; the second's columns end in ``_other``.

    Which of the two comes first follows from a hash, so that no task gets more pairs than others.
    """
    others = packs.select(*[F.col(c).alias(f"{c}_other") for c in packs.columns])
    turn = F.xxhash64("pack").bitwiseXOR(F.xxhash64("pack_other")).bitwiseAND(F.lit(1)) == 0
    once = F.when(turn, F.col("pack") <= F.col("pack_other")).otherwise(F.col("pack") > F.col("pack_other"))
    # The hint is for a product without an exchange, where Spark would send one side to all.
    return packs.crossJoin(others.hint("shuffle_replicate_nl")).where(once)


class Pack:
    """A pack out of a batch of ``meetings``."""

    def __init__(self, batch: pa.RecordBatch, at: int, side: str = ""):
        def numbers(name: str, kind: str) -> np.ndarray:
            return np.frombuffer(batch.column(name + side)[at].as_buffer(), kind)

        self.number = batch.column("pack" + side)[at].as_py()
        self.ids = batch.column("ids" + side)[at].values
        self.w, self.starts, self.radii = numbers("w", "i8"), numbers("starts", "i8"), numbers("radii", "f8")
        self.centres = numbers("centres", "f8").reshape(len(self.starts), -1)
        # Coordinates that are single-precision numbers are kept as such.
        bits = 8 * len(batch.column("x" + side)[at].as_buffer()) // (len(self.w) * self.centres.shape[1])
        self.x = numbers("x", "f4" if bits == 32 else "f8").reshape(len(self.w), -1).astype("f8")
        self.ends = np.append(self.starts[1:], len(self.w))
        self.half = (self.x * self.x).sum(axis=1) / 2
        self._sides: list[np.ndarray] = []

    def __len__(self) -> int:
        return len(self.w)

    def side(self, which: int) -> np.ndarray:
        """Points such that a first side times a second one is minus half the squared distance."""
        if not self._sides:
            one = np.ones(len(self))
            for more in ((-self.half, one), (one, -self.half)):
                self._sides.append(np.column_stack([self.x, *more]).astype("f4"))
        return self._sides[which]


def pairs_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Pack, Pack, pa.RecordBatch, int]]:
    """The packs of each row of ``meetings``; the first one, which stays for many rows, is taken apart once."""
    a = None
    for batch in batches:
        for at in range(batch.num_rows):
            if a is None or a.number != batch.column("pack")[at].as_py():
                a = Pack(batch, at)
            yield a, Pack(batch, at, "_other"), batch, at


def close_pairs(a: Pack, b: Pack, limit: float, metric: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Points of ``a`` and of ``b`` with ``distances <= limit``, a bounded number at a time.

    Within one pack each pair comes once, and no point with itself.
    """
    same, slack = a.number == b.number, _single_slack(a, b, limit, metric)
    sizes = b.ends - b.starts
    for s, (start, end) in enumerate(zip(a.starts, a.ends, strict=True)):
        gaps = distances(a.centres[s : s + 1], b.centres, metric)[0]
        # Not "within reach", for a gap that is no number rules out nothing.
        near = ~(gaps > _slack(a.radii[s] + b.radii + limit))
        if same:
            near[:s] = False
        columns = np.flatnonzero(np.repeat(near, sizes))
        if not len(columns):
            continue
        taken = slice(None) if len(columns) == len(b) else columns
        other = b.side(1)[taken] if slack is not None else b.x[taken]
        # All of them may be near, and then their numbers take more room than their distances.
        for part in _strips(end - start, 4 * len(columns)):
            rows = slice(start + part.start, start + part.stop)
            if slack is None:
                i, j = np.nonzero(pairs_within(a.x[rows], other, limit, metric))
            else:
                i, j = _close_by_product(a, b, rows, columns, other, limit, slack)
            i, j = i + rows.start, columns[j]
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j


def _single_slack(a: Pack, b: Pack, limit: float, metric: str) -> float | None:
    """A bound on the error of half the squared distances in single precision; none where that is no use."""
    most, dims = a.half.max(initial=0.0) + b.half.max(initial=0.0), a.x.shape[1]
    if metric != "euclidean" or dims < 8 or not limit > 1e-12 or not most < 1e30:
        return None
    slack = 4 * (dims + 8) * float(np.finfo("f4").eps) * most
    return slack if slack < limit * limit / 100 else None


def _close_by_product(
    a: Pack, b: Pack, rows: slice, columns: np.ndarray, other: np.ndarray, limit: float, slack: float
) -> tuple[np.ndarray, np.ndarray]:
    """``distances <= limit`` by one matrix product; pairs that its rounding leaves open are measured one by one."""
    found = a.side(0)[rows] @ other.T
    edge = -limit * limit / 2
    least = np.float32(edge - slack)
    some = np.flatnonzero(found.max(axis=1) >= least)
    i, j = np.nonzero(found[some] >= least)
    i = some[i]
    near = found[i, j] > edge + slack
    at = np.flatnonzero(~near)
    near[at] = _gaps(a.x, b.x, i[at] + rows.start, columns[j[at]], "euclidean") <= limit
    return i[near], j[near]
