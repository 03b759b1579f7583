"""Exact neighbourhoods in a metric space, in tasks of bounded size.

Equal points are merged beforehand and carry their number as a weight. ``Cells`` rules out by the
triangle inequality what cannot be near and cuts the rest into blocks; a block gives one line
per point, never its pairs. Where too little is ruled out for density clustering, ``packs`` of points meet
without copies; two packs give no more pairs than they have points.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.functions.scalars import q
from metricloom.operators.cells import BLOCK_ROWS, Cells, block_rows_for, kth_bounds, matrix, nearest_pairs, pairs_within
from metricloom.operators.packs import FILE, Pack, close_pairs, meetings, pack_rows, packed, pairs_of_batches
from metricloom.operators.ranking import ordinal_codes
from metricloom.session import stored


def coordinates(df: DataFrame, features: Sequence[str]) -> Column:
    """The features as one array; a single array column is taken as it is.

    Null where a feature is missing.
    """
    if len(features) == 1 and df.schema[features[0]].dataType.typeName() == "array":
        x = q(features[0]).cast("array<double>")
    else:
        x = F.array(*[q(c).cast("double") for c in features])
    return F.when(~F.exists(x, lambda v: v.isNull() | F.isnan(v)), x)


def merged_points(df: DataFrame, features: Sequence[str], key: str) -> DataFrame:
    """Distinct points (id, x, w): the smallest key, the coordinates, the copies."""
    points = df.select(q(key).alias("_key"), coordinates(df, features).alias("x"))
    return (
        points.where("x IS NOT NULL")
        .groupBy("x")
        .agg(F.min("_key").alias("id"), F.count(F.lit(1)).alias("w"))
        .select("id", "x", "w")
    )


def _attach(df: DataFrame, features: Sequence[str], found: DataFrame) -> DataFrame:
    """Columns of ``found`` (keyed by coordinates ``x``) on every row at that point."""
    placed = df.withColumn("_x", coordinates(df, features))
    return placed.join(found, F.col("_x") == F.col("x"), "left").drop("_x", "x")


# --- density clustering -------------------------------------------------------------------


def dbscan(
    df: DataFrame,
    features: Sequence[str],
    key: str,
    eps: float = 0.5,
    min_samples: int = 5,
    metric: str = "euclidean",
    label: str = "cluster",
    block_rows: int = BLOCK_ROWS,
    seed: int = 42,
) -> DataFrame:
    """Density clusters: numbered by their smallest core key, noise is -1.

    ``min_samples`` counts the point itself. A border point takes the lowest-numbered
    cluster among its core neighbours.
    """
    features = list(features)
    cells = Cells(merged_points(df, features, key), metric, block_rows, seed)
    radius = F.lit(float(eps))
    offered = cells.few_offers(cells.points, radius)
    if offered is None:
        points, links = _met_links(cells, float(eps), min_samples)
    else:
        points, links = _offered_links(cells, offered, eps, min_samples)
    cores = points.where("core").select("id")
    heads = components(links.where("core").select(F.col("id").alias("u"), F.col("head").alias("v")))
    of_core = cores.join(heads, F.col("id") == F.col("u"), "left").select(
        "id", F.coalesce("v", "id").alias("component")
    )
    numbers = ordinal_codes(of_core, "component", "_number")
    of_core = of_core.join(numbers, "component").select("id", "_number")
    border = (
        links.where("NOT core")
        .join(of_core.withColumnRenamed("id", "head"), "head")
        .groupBy("id")
        .agg(F.min("_number").alias("_number"))
    )
    found = of_core.unionByName(border.select("id", "_number"))
    named = points.join(found, "id", "left").select(
        "x", F.coalesce("_number", F.lit(-1)).cast("int").alias(label)
    )
    return _attach(df, features, named).withColumn(label, F.coalesce(F.col(label), F.lit(-1)))


def _offered_links(cells: Cells, offered: DataFrame, eps: float, min_samples: int) -> tuple[DataFrame, DataFrame]:
    """The points with ``degree`` and ``core``; a line (id, head, core) for each that is linked to a core point."""
    metric, radius = cells.metric, F.lit(float(eps))

    def degree(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if mine.empty or theirs.empty:
            return pd.DataFrame({"id": [], "degree": []})
        near = pairs_within(matrix(mine["x"]), matrix(theirs["x"]), eps, metric)
        return pd.DataFrame({"id": mine["id"], "degree": near @ theirs["w"].to_numpy()})

    kind = dict(cells.points.dtypes)["id"]
    degrees = cells.blocks(cells.points, radius, degree, f"id {kind}, degree bigint", offered)
    degrees = degrees.groupBy("id").agg(F.sum("degree").alias("degree"))
    points = stored(cells.points.join(degrees, "id").withColumn("core", F.col("degree") >= min_samples), "degrees")

    def link(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        theirs = theirs[theirs["core"]].reset_index(drop=True)
        if mine.empty or theirs.empty:
            return pd.DataFrame({"id": [], "head": [], "core": []})
        near = pairs_within(matrix(mine["x"]), matrix(theirs["x"]), eps, metric)
        return _link_block(mine["id"].to_numpy(), mine["core"].to_numpy(bool), theirs["id"].to_numpy(), near)

    links = cells.blocks(points, radius, link, f"id {kind}, head {kind}, core boolean").distinct()
    return points, stored(links, "links")


def _met_links(cells: Cells, eps: float, min_samples: int) -> tuple[DataFrame, DataFrame]:
    """As ``_offered_links``, where all packs of points meet.

    Pairs are found once and kept, unless two packs have more of them than points: of these the degrees are
    kept, and once it is known which points are core they meet again, to be joined into groups.
    """
    metric, kind = cells.metric, dict(cells.points.dtypes)["id"]
    dims = len(cells.pivots[0])
    packs = packed(cells.points, pack_rows(cells.points.count(), dims), metric)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, _, _ in pairs_of_batches(batches):
            yield from _met(a, b, close_pairs(a, b, eps, metric))

    met = meetings(packs).mapInArrow(meet, f"id {kind}, other {kind}, degree bigint, a bigint, b bigint")
    met = stored(met, "met")
    # A point at infinity is nowhere near, not even itself.
    far = F.exists("x", lambda v: F.abs(v) == math.inf)
    own = cells.points.select("id", F.when(~far & F.lit(eps >= 0), F.col("w")).otherwise(0).alias("degree"))
    degrees = own.unionByName(met.where("a IS NULL").select("id", "degree"))
    degrees = degrees.groupBy("id").agg(F.sum("degree").alias("degree"))
    points = stored(cells.points.join(degrees, "id").withColumn("core", F.col("degree") >= min_samples), "degrees")
    cores = points.where("core").select("id").distinct()
    links = (
        met.where("other IS NOT NULL").select("id", "other")
        .join(cores.withColumnRenamed("id", "other"), "other")
        .join(points.select("id", "core").distinct(), "id")
        .where("NOT core OR id > other")
        .select("id", F.col("other").alias("head"), "core")
    )
    crowded = met.where("a IS NOT NULL").select("a", "b")
    if crowded.take(1):
        links = links.unionByName(_crowded_links(packs, cores, crowded, eps, metric, f"id {kind}, head {kind}, core boolean"))
    return points, stored(links.distinct(), "links")


def _met(a: Pack, b: Pack, strips: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Both directions of each pair (id, other, the other's copies), or where there are too many of them
    degrees (id, nothing, degree) and the packs (a, b)."""
    kept, count, degrees = [], 0, None
    for i, j in strips:
        kept.append((i, j))
        count += len(i)
        if count > len(a) + len(b):
            degrees = [np.zeros(len(x)) for x in (a, b)] if degrees is None else degrees
            for i, j in kept:
                degrees[0] += np.bincount(i, b.w[j], len(a))
                degrees[1] += np.bincount(j, a.w[i], len(b))
            kept = []

    def lines(ids: pa.Array, others: pa.Array, degree: np.ndarray, numbers: tuple | None = None) -> pa.RecordBatch:
        ends = [pa.nulls(len(ids), pa.int64()) if n is None else pa.array([n], pa.int64()) for n in numbers or (None, None)]
        return pa.RecordBatch.from_arrays([ids, others, pa.array(degree, pa.int64()), *ends], names=["id", "other", "degree", "a", "b"])

    if degrees is not None:
        for pack, degree in zip((a, b), degrees, strict=True):
            at = np.flatnonzero(degree)
            yield lines(pack.ids.take(pa.array(at)), pa.nulls(len(at), pack.ids.type), degree[at].astype("int64"))
        none = pa.nulls(1, a.ids.type)
        yield lines(none, none, np.zeros(1, "int64"), (a.number, b.number))
    elif kept:
        i, j = (np.concatenate(x) for x in zip(*kept, strict=True))
        ids = a.ids.take(pa.array(i)), b.ids.take(pa.array(j))
        yield lines(pa.concat_arrays(ids), pa.concat_arrays(ids[::-1]), np.append(b.w[j], a.w[i]))


def _crowded_links(packs: DataFrame, cores: DataFrame, crowded: DataFrame, eps: float, metric: str, schema: str) -> DataFrame:
    """The lines (id, head, core) of the packs ``crowded`` (a, b), each pack's core points joined into groups."""
    spots = packs.select("pack", F.posexplode("ids").alias("spot", "id")).join(cores, "id")
    spots = spots.groupBy("pack").agg(F.collect_list("spot").alias("cores"))
    of_first = crowded.groupBy(F.col("a").alias("pack")).agg(F.collect_set("b").alias("meets"))
    used = crowded.select(F.explode(F.array("a", "b")).alias("pack")).distinct()
    used = used.join(spots, "pack", "left").join(of_first, "pack", "left")
    again = stored(packs.join(used, "pack"), "crowded-packs", **FILE)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, batch, at in pairs_of_batches(batches):
            core = [np.zeros(len(x), bool) for x in (a, b)]
            for flags, side in zip(core, ("cores", "cores_other"), strict=True):
                if batch.column(side)[at].is_valid:
                    flags[batch.column(side)[at].values.to_numpy()] = True
            ids, heads, kinds = _group_lines(a, b, core, close_pairs(a, b, eps, metric))
            nodes = a.ids if a.number == b.number else pa.concat_arrays([a.ids, b.ids])
            yield pa.RecordBatch.from_arrays(
                [nodes.take(pa.array(ids)), nodes.take(pa.array(heads)), pa.array(kinds)], names=["id", "head", "core"]
            )

    return meetings(again).where(F.array_contains("meets", F.col("pack_other"))).mapInArrow(join, schema)


def _group_lines(
    a: Pack, b: Pack, core: list[np.ndarray], strips: Iterator[tuple[np.ndarray, np.ndarray]]
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A line (point, head, true) for each core point of a group but the head, and (point, head, false) for each
    border point and group; points are numbered through both packs."""
    shift = 0 if a.number == b.number else len(a)
    core = np.concatenate(core) if shift else core[0]
    count = len(core)
    head, border = np.arange(count), np.zeros(0, np.int64)
    for i, j in strips:
        j = j + shift
        both, one = core[i] & core[j], core[i] ^ core[j]
        head = _hung(head, i[both], j[both])
        i, j = i[one], j[one]
        border = np.union1d(border, np.where(core[i], j, i) * count + head[np.where(core[i], i, j)])
    border = np.unique(border // count * count + head[border % count])
    inner = np.flatnonzero(head != np.arange(count))
    kinds = np.arange(len(inner) + len(border)) < len(inner)
    return np.append(inner, border // count), np.append(head[inner], border % count), kinds


def _hung(head: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``head``, by which every node knows the smallest of its group, once the edges (u, v) are added."""
    while True:
        u, v = head[u], head[v]
        apart = u != v
        if not apart.any():
            return head
        u, v = u[apart], v[apart]
        np.minimum.at(head, np.maximum(u, v), np.minimum(u, v))
        while (head[head] != head).any():
            head = head[head]


def _link_block(ids: np.ndarray, core: np.ndarray, other: np.ndarray, near: np.ndarray) -> pd.DataFrame:
    """Join the core points of a block into groups; name each by its smallest id.

    One line per core point (its group's head) and one per border point and group.
    """
    linked = near & core[:, None]
    head_of = other.copy()
    seen_mine, seen_other = ~core, np.zeros(len(other), bool)
    out_id, out_head, out_core = [], [], []
    for start in range(len(other)):
        if seen_other[start]:
            continue
        front = np.zeros(len(other), bool)
        front[start] = True
        in_mine, in_other = np.zeros(len(ids), bool), front.copy()
        while front.any():
            seen_other |= front
            reached = linked[:, front].any(axis=1) & ~seen_mine
            seen_mine |= reached
            in_mine |= reached
            front = linked[reached].any(axis=0) & ~seen_other
            in_other |= front
        head = min(other[in_other].min(), ids[in_mine].min()) if in_mine.any() else other[start]
        head_of[in_other] = head
        if in_mine.any():
            members = np.concatenate([ids[in_mine], other[in_other]])
            out_id.append(members)
            out_head.append(np.full(len(members), head))
            out_core.append(np.ones(len(members), bool))
    for i in np.flatnonzero(~core & near.any(axis=1)):
        heads = np.unique(head_of[near[i]])
        out_id.append(np.full(len(heads), ids[i]))
        out_head.append(heads)
        out_core.append(np.zeros(len(heads), bool))
    if not out_id:
        return pd.DataFrame({"id": [], "head": [], "core": []})
    return pd.DataFrame(
        {"id": np.concatenate(out_id), "head": np.concatenate(out_head), "core": np.concatenate(out_core)}
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (u, v): every u with the smallest node v of its component.

    Alternates the two star contractions of Kiveris et al. (2014): all neighbours are
    re-hung from the smallest one, first the larger, then the smaller ones. Each is a
    minimum per node and a join back to it; no neighbour list is ever collected. The rounds
    end, for each either hangs a node from a smaller one or changes nothing.

    Once so few edges are left that one task takes them, a round is that task: the minimum
    is a window over its edges, and nothing is shuffled or sent through the driver.
    """
    down = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    state = stored(down.distinct(), "edges")
    before, size = None, state.count()
    while True:
        # A round has no more edges than the one before but for the stars' own.
        if size <= TASK_EDGES:
            state = stored(_task_round(state), "edges")
        else:
            state = stored(_small_star(_large_star(state)).coalesce(math.ceil(size / TASK_EDGES)), "edges")
        mark = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before:
            return state
        before, size = mark, mark[0]


TASK_EDGES = 200_000


def _task_round(edges: DataFrame) -> DataFrame:
    """``_small_star(_large_star(edges))`` in one task, for ``TASK_EDGES`` edges at most."""
    least = F.min("v").over(Window.partitionBy("u"))
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(1)
    large = both.select("u", "v", F.least(least, "u").alias("m")).where("v > u and v <> m")
    down = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().select("u", "v", least.alias("m"))
    ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
    return down.select(ends.alias("e")).select("e.u", "e.v").where("u <> v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    hung = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return hung.unionByName(own).where("u <> v").distinct()


# --- nearest neighbours and angles --------------------------------------------------------


def bounded_points(cells: Cells) -> DataFrame:
    """The cells' points with ``near`` cut down to the k-th distance found in their own cell.

    Large cells are searched in parts, which gives a bound as well.
    """
    points, k, metric = cells.points, cells.k, cells.metric
    sizes = points.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (2 * cells.block_rows)).alias("_parts"))
    dealt = points.join(sizes, "cell").withColumn("_part", F.pmod(F.xxhash64("id", F.lit(2)), "_parts")).drop("_parts")
    schema = points.schema

    def bound(mine: pd.DataFrame) -> pd.DataFrame:
        if len(mine) > k:
            mine = mine.assign(near=np.minimum(mine["near"], kth_bounds(matrix(mine["x"]), k, metric)))
        return mine[schema.names]

    return stored(dealt.groupBy("cell", "_part").applyInPandas(bound, schema), "bounded")


def nearest_neighbours(
    points: DataFrame,
    k: int,
    metric: str = "euclidean",
    block_rows: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """The ``k`` nearest other points of each merged point: (id, x, w, other, y, v, gap).

    Every point searches as far as its k-th nearest in its own cell, so how many candidates it
    meets does not grow with the number of points. A block measures only pairs within that reach.
    """
    points = stored(points, "points")
    if block_rows is None:
        some = points.first()
        block_rows = block_rows_for(points.count(), len(some["x"]) if some else 0)
    cells = Cells(points, metric, block_rows, seed, k)
    bounded = bounded_points(cells).withColumn("reach", F.col("near"))
    kind = dict(points.dtypes)["id"]

    def best(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if mine.empty or theirs.empty:
            return pd.DataFrame({"id": [], "other": [], "gap": []})
        ids, others = mine["id"].to_numpy(), theirs["id"].to_numpy()
        reach = mine["reach"].to_numpy()
        # One more, for the point itself may be among them.
        i, j, gap = nearest_pairs(matrix(mine["x"]), matrix(theirs["x"]), others, reach, k + 1, metric)
        out = pd.DataFrame({"id": ids[i], "other": others[j], "gap": gap})
        out = out[(out["id"] != out["other"]) & np.isfinite(out["gap"])]
        return out[out.groupby("id").cumcount() < k]

    near = cells.blocks(bounded, F.col("near"), best, f"id {kind}, other {kind}, gap double")
    first = Window.partitionBy("id").orderBy("gap", "other")
    near = near.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    a = bounded.select("id", "x", "w")
    b = bounded.select(F.col("id").alias("other"), F.col("x").alias("y"), F.col("w").alias("v"))
    return near.join(a, "id").join(b, "other")


def abod_scores(
    df: DataFrame,
    features: Sequence[str],
    key: str,
    n_neighbors: int = 5,
    name: str = "score",
    block_rows: int | None = None,
) -> DataFrame:
    """Minus the variance of weighted angles to all pairs of a point's nearest neighbours.

    Copies of a point fill its neighbourhood first and give no angle; a point with no
    angle gets no score.
    """
    features = list(features)
    near = nearest_neighbours(merged_points(df, features, key), n_neighbors, "euclidean", block_rows)
    # At most n_neighbors entries per point.
    hood = near.groupBy("id").agg(
        F.first("x").alias("x"),
        F.first("w").alias("w"),
        F.array_sort(F.collect_list(F.struct("gap", "other", "v", "y"))).alias("hood"),
    )
    flat = hood.select("x", "w", F.col("hood.v").alias("v"), F.flatten("hood.y").alias("y"))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ANGLE_ROWS):
                part = batch.slice(start, ANGLE_ROWS)
                found = angle_scores(*(_lists(part.column(c)) for c in "xvy"), part.column("w").to_numpy(), n_neighbors)
                yield pa.RecordBatch.from_arrays(
                    [part.column("x"), pa.array(found, pa.float64(), from_pandas=True)], names=["x", "_score"]
                )

    scored = flat.mapInArrow(scores, "x array<double>, _score double")
    return _attach(df, features, scored.withColumnRenamed("_score", name))


ANGLE_ROWS = 2000


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of lists and all their members in a row."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    return lengths, column.flatten().to_numpy(zero_copy_only=False)


def angle_scores(x, v, y, w: np.ndarray, k: int) -> np.ndarray:
    """Scores of points from their coordinates, copies of themselves and of their neighbours; NaN for none.

    ``x``, ``v`` and ``y`` are (lengths, members): coordinates, the neighbours' copies from the nearest
    on, and the neighbours' coordinates, one after another.
    """
    rows = len(w)
    points = x[1].reshape(rows, -1)
    width, most = points.shape[1], int(v[0].max(initial=0))
    # The neighbours of a point as a rectangle; what is missing has no copies.
    given = np.arange(most)[None, :] < v[0][:, None]
    copies = np.zeros((rows, most), np.int64)
    copies[given] = v[1]
    others = np.zeros((rows, most, width))
    others[given] = y[1].reshape(-1, width)
    # Slot s of a neighbourhood holds the neighbour whose copies reach it first.
    slots = np.arange(k)
    upto = copies.cumsum(axis=1)
    holder = (upto[:, None, :] <= slots[None, :, None]).sum(axis=2)
    filled = (holder < v[0][:, None]) & (slots[None, :] < (k - (w - 1))[:, None])
    holder = np.minimum(holder, max(most - 1, 0))
    legs = np.take_along_axis(others, holder[:, :, None], axis=1) - points[:, None, :]
    square = (legs * legs).sum(axis=2)
    i, j = np.triu_indices(k, 1)
    pair = filled[:, i] & filled[:, j]
    with np.errstate(divide="ignore", invalid="ignore"):
        angle = np.where(pair, (legs[:, i] * legs[:, j]).sum(axis=2) / square[:, i] / square[:, j], 0.0)
        n = pair.sum(axis=1)
        mean = angle.sum(axis=1) / n
        spread = np.where(pair, angle - mean[:, None], 0.0)
        return -(spread * spread).sum(axis=1) / n
