"""Global order without a one-task sort.

``running`` computes prefix sums over a globally ordered key: keys are cut into range
blocks, each block is summed in its own task, and the few block totals give every block
its offset. Inputs are first collapsed to one row per key, so a value held by a third of
all rows is a single row here.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metricloom.functions.scalars import q

_SAMPLE_PER_BLOCK = 32
_SAMPLE_LIMIT = 50_000
_SPLIT_BITS = 16
_TREE_LIMIT = 255
_CELLS = 256


def _block_count(df: DataFrame, blocks: int | None) -> int:
    return blocks or max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def with_range_block(
    df: DataFrame, keys: Sequence[str], name: str = "_block", blocks: int | None = None
) -> DataFrame:
    """Add a block number that grows with ``keys``.

    The split points come from the keys with the smallest hashes, a uniform sample of
    bounded size taken without a shuffle.
    """
    blocks = _block_count(df, blocks)
    numeric = len(keys) == 1 and isinstance(df.schema[keys[0]].dataType, T.NumericType)
    if not numeric:
        blocks = min(blocks, _TREE_LIMIT + 1)
    hashed = F.xxhash64(*[q(k) for k in keys])
    sample = (
        df.select(*[q(k) for k in keys])
        .dropna()
        .orderBy(hashed)
        .limit(min(_SAMPLE_PER_BLOCK * blocks, _SAMPLE_LIMIT))
        .collect()
    )
    points = sorted({tuple(r) for r in sample})
    bounds = sorted({points[i * len(points) // blocks] for i in range(1, blocks)}) if points else []
    if not bounds:
        return df.withColumn(name, F.lit(0))
    if numeric:
        splits = sorted({float(b[0]) for b in bounds if math.isfinite(b[0])})
        cutter = Bucketizer(
            splits=[-math.inf, *splits, math.inf],
            inputCol="_block_in",
            outputCol="_block_out",
            handleInvalid="keep",
        )
        cut = cutter.transform(df.withColumn("_block_in", q(keys[0]).cast("double")))
        # Nulls sort before all values, so they have the block before all blocks.
        spot = F.when(q(keys[0]).isNull(), F.lit(-1)).otherwise(F.col("_block_out").cast("int"))
        return cut.withColumn(name, spot).drop("_block_in", "_block_out")
    kinds = [df.schema[k].dataType for k in keys]
    literals = [F.struct(*[F.lit(v).cast(t) for v, t in zip(b, kinds)]) for b in bounds]
    return df.withColumn(name, _search(F.struct(*[q(k) for k in keys]), literals, 0))


def _search(key: Column, bounds: list[Column], first: int) -> Column:
    """Binary search for the number of bounds at or below ``key``."""
    if not bounds:
        return F.lit(first)
    middle = len(bounds) // 2
    return F.when(key < bounds[middle], _search(key, bounds[:middle], first)).otherwise(
        _search(key, bounds[middle + 1 :], first + middle + 1)
    )


def range_search(key: Column, bounds: list[Column]) -> Column:
    """Twice the number of bounds up to ``key``, and one more where none equals it."""
    upto = _search(key, bounds, 0)
    at = F.get(F.array(*bounds), upto - 1) if bounds else F.lit(None)
    return F.when(key == at, 2 * upto).otherwise(2 * upto + 1)


def running(
    df: DataFrame,
    order: Sequence[str],
    sums: dict[str, Column],
    by: Sequence[str] = (),
    descending: bool = False,
    block: str | None = None,
) -> DataFrame:
    """Add inclusive running sums along ``order`` within ``by``.

    Needs one row per (by, order). ``block`` may name a column that grows with the order;
    without it range blocks are cut from a sample.
    """
    base = df
    for name, value in sums.items():
        base = base.withColumn(f"_in_{name}", value)
    own_blocks = block is None
    if own_blocks:
        base = with_range_block(base, order)
        block = "_block"
    direction = (lambda c: c.desc()) if descending else (lambda c: c.asc())
    # A struct of the group columns is never null, so plain equality joins it, null groups
    # included, and the join finds the rows where the window has put them.
    group = F.struct(*[q(c) for c in by]) if by else F.lit(0)
    base = base.withColumn("_group", group).withColumnRenamed(block, "_at")
    inside = Window.partitionBy("_group", "_at").orderBy(*[direction(q(c)) for c in order])
    inside = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("_group").orderBy(direction(F.col("_at")))
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    totals = base.groupBy("_group", "_at").agg(*[F.sum(f"_in_{n}").alias(f"_sum_{n}") for n in sums])
    offsets = totals.select(
        "_group",
        "_at",
        *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in sums],
    )
    if not by and own_blocks:
        # One row per range block, of which there are no more than shuffle partitions.
        offsets = F.broadcast(offsets)
    local = base.select("*", *[F.sum(f"_in_{n}").over(inside).alias(f"_loc_{n}") for n in sums])
    # A left join, though every block has its totals: an inner one would push a not-null
    # test of the block number below the aggregation that precedes it.
    joined = local.join(offsets, ["_group", "_at"], "left")
    return joined.select(
        *[(F.col("_at").alias(c) if c == block else q(c)) for c in df.columns],
        *[(F.col(f"_loc_{n}") + F.col(f"_off_{n}")).alias(n) for n in sums],
    )


def row_numbers(df: DataFrame, order: Sequence[str], name: str = "row_number") -> DataFrame:
    """1-based number along ``order``, which must be unique."""
    return running(df, order, {name: F.lit(1).cast("long")})


def hash_ranks(
    df: DataFrame, by: Sequence[str], key: Sequence[str], seed: int, name: str = "hash_rank"
) -> DataFrame:
    """1-based rank by seeded hash of a unique ``key`` within ``by``.

    Hashes are uniform, so their top bits cut every group, however large, into even blocks,
    four for each shuffle partition and 1024 at least.
    """
    hashed = F.xxhash64(*[q(k) for k in key], F.lit(seed))
    bits = max(10, (4 * _block_count(df, None) - 1).bit_length())
    base = df.withColumn("_hash", hashed).withColumn("_hash_block", F.shiftright("_hash", 64 - bits))
    ranked = running(
        base, ["_hash", *key], {name: F.lit(1).cast("long")}, by=by, block="_hash_block"
    )
    return ranked.drop("_hash", "_hash_block")


def hash_split(
    df: DataFrame, group: str, key: Sequence[str], wanted: Mapping[object, int], seed: int
) -> tuple[DataFrame, DataFrame]:
    """The ``wanted`` number of rows of each group with the smallest seeded hashes, and the others.

    Gives what a cut of ``hash_ranks`` would, but without ordering the groups: rows are counted by
    the top bits of their hash, which shows the one block in which a group's cut lies. The other
    blocks are told apart by a filter, and only that block's rows, one in 65536, are ranked.
    Rows of groups that are not named, null among them, are in neither part; ``key`` is unique.
    """
    base = df.withColumn("_hash", F.xxhash64(*[q(k) for k in key], F.lit(seed)))
    base = base.withColumn("_block", F.shiftright("_hash", 64 - _SPLIT_BITS))
    counts = base.groupBy(q(group).alias("_group"), "_block").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_group").orderBy("_block"))
    limit = _by_group(F.col("_group"), wanted)
    before = F.col("_upto") - F.col("_n")
    crossing = counts.withColumn("_upto", upto).where((F.col("_upto") > limit) & (before <= limit))
    found = {r[0]: (r[1], r[2]) for r in crossing.select("_group", "_block", limit - before).collect()}
    # A group that is wanted whole has no such block.
    beyond = 1 << _SPLIT_BITS
    cut = _by_group(q(group), {g: found.get(g, (beyond, 0))[0] for g in wanted})
    missing = _by_group(q(group), {g: found.get(g, (beyond, 0))[1] for g in wanted})
    order = Window.partitionBy(q(group)).orderBy("_hash", *[q(k) for k in key])
    edge = base.where(F.col("_block") == cut).withColumn("_rank", F.row_number().over(order))
    columns = [q(c) for c in df.columns]
    first = base.where(F.col("_block") < cut).select(*columns).unionByName(
        edge.where(F.col("_rank") <= missing).select(*columns)
    )
    rest = base.where(F.col("_block") > cut).select(*columns).unionByName(
        edge.where(F.col("_rank") > missing).select(*columns)
    )
    return first, rest


def _by_group(group: Column, values: Mapping[object, int]) -> Column:
    """The value of a row's group; null for others."""
    chosen = [F.when(group == F.lit(g), F.lit(v).cast("long")) for g, v in values.items() if g is not None]
    return F.coalesce(*chosen, F.lit(None).cast("long"))


def ordinal_codes(df: DataFrame, column: str, code: str = "code") -> DataFrame:
    """Distinct non-null values with their 0-based rank in sort order."""
    values = df.select(q(column)).where(q(column).isNotNull()).distinct()
    ranked = running(values, [column], {code: F.lit(1).cast("long")})
    return ranked.withColumn(code, F.col(code) - 1)


def value_ranks(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with count ``n`` and running count ``upto``."""
    counts = df.where(q(column).isNotNull()).groupBy(q(column).alias("value")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return running(counts, ["value"], {"upto": F.col("n")})


def average_ranks(
    df: DataFrame, column: str, name: str, among: DataFrame | None = None
) -> DataFrame:
    """Add the 1-based rank of ``column``, ties sharing their mean rank.

    ``among`` are the rows to rank by where ``df`` has been joined to other things since.
    """
    ranks = value_ranks(df if among is None else among, column).select(
        F.col("value").alias("_ranked"),
        (F.col("upto") - (F.col("n") - 1) / F.lit(2.0)).alias(name),
    )
    return df.join(ranks, q(column) == F.col("_ranked"), "left").drop("_ranked")


def exact_quantiles(
    df: DataFrame, column: str, probabilities: Sequence[float], collect_limit: int = 200_000
) -> list[float]:
    """Exact quantiles of one column with linear interpolation between neighbours."""
    return exact_quantiles_of(df, [column], probabilities, collect_limit)[0]


def exact_quantiles_of(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], collect_limit: int = 200_000
) -> list[list[float]]:
    """Exact quantiles of several columns, in passes that all columns and quantiles share.

    One pass sketches every column, one counts the cells between the sketched quantiles, and
    what lies in cells that hold a wanted rank is looked at value by value, at most
    ``collect_limit`` rows; where it is more, these cells are sketched and counted again. Null and
    NaN do not count; a column without values has NaN.
    """
    names = [f"x{i}" for i in range(len(columns))]
    doubles = [q(c).cast("double") for c in columns]
    # Infinite values are counted apart; NaN is above them in Spark's order.
    values = df.select(*[F.when(F.abs(x) < math.inf, x).alias(n) for n, x in zip(names, doubles)])
    ends = [F.when(F.abs(x) == math.inf, x).alias(f"e{i}") for i, x in enumerate(doubles)]
    row = df.select(*ends, *[F.when(F.abs(x) < math.inf, x).alias(n) for n, x in zip(names, doubles)]).agg(
        *[F.struct(F.count(n), _grid(F.col(n)), F.count_if(F.col(f"e{i}") < 0), F.count_if(F.col(f"e{i}") > 0)) for i, n in enumerate(names)]
    ).first()
    found: list[dict[int, float]] = [{} for _ in names]
    places, open_ranges = [], []
    for i, (count, points, least, most) in enumerate(row):
        total = least + count + most
        at = [p * (total - 1) for p in probabilities] if total else []
        places.append(at)
        ranks = sorted({math.floor(p) for p in at} | {math.ceil(p) for p in at})
        found[i].update({r: -math.inf if r < least else math.inf for r in ranks if not least <= r < least + count})
        ranks = [r for r in ranks if least <= r < least + count]
        if ranks:
            open_ranges.append(_Range(i, -math.inf, math.inf, least, count, ranks, list(points)))
    while open_ranges:
        if sum(r.count for r in open_ranges) <= collect_limit:
            _settle(values, names, open_ranges, found)
            break
        open_ranges = _narrow(values, names, open_ranges, found)
        wide = [r for r in open_ranges if r.count > 1]
        if wide and sum(r.count for r in open_ranges) > collect_limit:
            grids = values.agg(*[_grid(F.when(r.holds(names), F.col(names[r.column]))) for r in wide]).first()
            for r, points in zip(wide, grids):
                r.points = list(points)
    out = []
    for i, at in enumerate(places):
        here = [(found[i][math.floor(p)], found[i][math.ceil(p)], p) for p in at]
        # Equal neighbours may both be infinite.
        out.append([a if a == b else a + (b - a) * (p - math.floor(p)) for a, b, p in here] or [math.nan for _ in probabilities])
    return out


@dataclass
class _Range:
    """Values of a column between two bounds, neither included unless infinite: how many there are
    below and inside, the ranks wanted inside, and approximate quantiles."""

    column: int
    low: float
    high: float
    before: int
    count: int
    ranks: list[int]
    points: list[float] = field(default_factory=list)

    def holds(self, names: Sequence[str]) -> Column:
        x = F.col(names[self.column])
        above = x > self.low if math.isfinite(self.low) else x.isNotNull()
        return above & (x < self.high) if math.isfinite(self.high) else above


def _grid(x: Column) -> Column:
    return F.percentile_approx(x, [i / _CELLS for i in range(_CELLS + 1)], 20 * _CELLS)


def _doubles(numbers: Sequence[float]) -> Column:
    """A constant array as one literal; a thousand single ones would slow the planner."""
    return F.split(F.lit(",".join(map(repr, numbers))), ",").cast("array<double>")


def _settle(values: DataFrame, names: Sequence[str], ranges: Sequence[_Range], found: list[dict[int, float]]) -> None:
    """Look up the ranks among the values of the ranges, counted by value."""
    inside = [F.when(r.holds(names), F.struct(F.lit(n).alias("r"), F.col(names[r.column]).alias("x"))) for n, r in enumerate(ranges)]
    rows = values.select(F.explode(F.array_compact(F.array(*inside))).alias("v")).groupBy("v.r", "v.x").count()
    by_range: dict[int, list[tuple[float, int]]] = {}
    for n, x, count in rows.collect():
        by_range.setdefault(n, []).append((x, count))
    for n, r in enumerate(ranges):
        seen, waiting = r.before, list(r.ranks)
        for x, count in sorted(by_range.get(n, [])):
            seen += count
            while waiting and waiting[0] < seen:
                found[r.column][waiting.pop(0)] = x


def _narrow(
    values: DataFrame, names: Sequence[str], ranges: Sequence[_Range], found: list[dict[int, float]]
) -> list[_Range]:
    """Count the cells of all ranges in one pass; the ranges of cells that hold a wanted rank."""
    used = sorted({r.column for r in ranges})
    splits = {}
    for i in used:
        points = {p for r in ranges if r.column == i for p in (r.low, r.high, *r.points) if math.isfinite(p)}
        splits[i] = [-math.inf, *sorted(points), math.inf]
    cutter = Bucketizer(
        splitsArray=[splits[i] for i in used], inputCols=[names[i] for i in used],
        outputCols=[f"b{i}" for i in used], handleInvalid="keep",
    )
    # A split point itself is a cell of its own, so a frequent value never hides others.
    cells = []
    for i in used:
        b, x = F.col(f"b{i}").cast("int"), F.col(names[i])
        start = F.try_element_at(_doubles(splits[i][1:-1]), b)
        inside = F.when(b == 0, 1).otherwise((x != start).cast("int"))
        cells.append(F.when(x.isNotNull(), F.struct(F.lit(i).alias("i"), b.alias("b"), inside.alias("inside"))))
    some = values.where(reduce(lambda a, b: a | b, [r.holds(names) for r in ranges]))
    counted = cutter.transform(some).select(F.explode(F.array_compact(F.array(*cells))).alias("c"))
    counts: dict[int, list[tuple[int, int, int]]] = {}
    for i, b, inside, n in counted.groupBy("c.i", "c.b", "c.inside").count().collect():
        counts.setdefault(i, []).append((b, inside, n))
    deeper = []
    for r in ranges:
        cut, seen, waiting = splits[r.column], r.before, list(r.ranks)
        for b, inside, n in sorted(counts.get(r.column, [])):
            low, high = cut[b], cut[b + 1]
            if (low < r.low or high > r.high) if inside else not r.low < low < r.high:
                continue
            here = [w for w in waiting if w < seen + n]
            waiting = waiting[len(here) :]
            if here and not inside:
                found[r.column].update({w: low for w in here})
            elif here:
                deeper.append(_Range(r.column, low, high, seen, n, here))
            seen += n
    return deeper


def average_rank_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, rank) of the distinct values of all columns, ties sharing their mean rank.

    One count and one running sum serve all columns.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("feature"), q(c).cast("double").alias("value")) for i, c in enumerate(columns)])
    counts = df.select(F.explode(cells).alias("v")).where("v.value IS NOT NULL").groupBy("v.feature", "v.value").agg(
        F.count(F.lit(1)).alias("n")
    )
    # Range blocks of the pair (feature, value) follow the order within every feature.
    blocked = with_range_block(counts, ["feature", "value"], "_cut")
    ranked = running(blocked, ["value"], {"upto": F.col("n")}, by=["feature"], block="_cut")
    return ranked.select("feature", "value", (F.col("upto") - (F.col("n") - 1) / F.lit(2.0)).alias("rank"))
