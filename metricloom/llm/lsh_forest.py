"""Near-duplicate documents by an LSH forest over MinHash signatures.

Documents with equal shingle sets are one node from the start. Every node gets ``trees`` labels
of ``depth`` MinHash values, and in each tree the nodes are put in the order of their labels.
Neighbours in an order share the longest prefixes, so the next ``reach`` nodes are what a
descent to the depth at which the region holds that many would find: a few values deep where
few are alike, as deep as the labels go among many copies. Neighbours must share so many values,
have sizes that allow the threshold, and agree in enough values of the whole signature (four
standard deviations below the threshold still pass). Ties of labels are put in a different
random order in each tree.

Where more nodes than that share the first ``crowd`` values, the nodes next to each other are not enough: one
original may be linked with each of thousands of copies that are not linked with one another.
Such crowded regions that hold several groups after the orders' links are worked through until
every pair in them is settled. First all members meet the region's leaders, the nodes whose
signatures are alike to most others'. What is still apart then is compared pair by pair on the
full sets, in blocks of bounded size, each with each.

Every candidate is confirmed on the full shingle sets. The candidates nearest in each order
come first; the others are confirmed only where they would join different groups, so that a
group of thousands ships each text a few times, not once for every pair.

Texts are read where they lie for signatures. After that only labels are shuffled, and once the
texts of nodes with candidates; texts of crowded regions that stay open go once to each pair of
blocks. No task holds a group: orders are cut by range, anywhere, and regions into blocks. A
pair that a cut parts is still next to each other in the other trees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import missing_columns, q, written
from metricloom.operators.neighbours import components

MIX = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 1 << 13
FILTER_BITS = 1 << 23
FIRST_TREES = 4  # whose nearest candidates are confirmed before all others
BLOCK_NODES, BLOCK_SHINGLES = 1 << 10, 1 << 20  # of a crowded region's block
LEADERS, LEADER_ROUNDS = 2, 2  # what they leave apart is compared pair by pair
COLUMNS = 1 << 12


@dataclass(frozen=True)
class Forest:
    """Shingles of ``shingle`` words; links at ``percent`` % Jaccard similarity and above."""

    shingle: int = 5
    percent: int = 80
    trees: int = 12
    depth: int = 5
    crowd: int = 3
    reach: int = 16
    seed: int = 29

    @property
    def least(self) -> int:
        """Equal values of the whole signature that a candidate needs."""
        n, t = self.trees * self.depth, self.percent / 100
        return max(1, int(np.floor(n * t - 4 * np.sqrt(n * t * (1 - t)))))


def shingles(text: str | None, size: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes.

    Words are runs without ASCII white space, A-Z lower-cased. A text of fewer words than a
    shingle has its whole sequence as one; a text without words has none.
    """
    ws = (text or "").encode().lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
    n = min(size, len(ws))
    found = np.full(len(ws) - n + 1, n, np.uint64)
    for k in range(n):
        found = (found ^ (found >> np.uint64(29))) * MIX + h[k : len(h) - n + k + 1]
    found ^= found >> np.uint64(32)
    found *= MIX
    return np.unique(found ^ (found >> np.uint64(29)))


def signature(items: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(items), CHUNK):
        some = items[at : at + CHUNK]
        np.minimum(least, (some[None, :] * factors[:, None] + offsets[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(">u4")


def nodes(docs: DataFrame, forest: Forest, key: str, text: str) -> DataFrame:
    """(id, n_shingles, node_key, signature) of every row; the last two null without shingles."""
    random = np.random.default_rng(forest.seed)
    n = forest.trees * forest.depth
    factors = random.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    offsets = random.integers(0, 1 << 63, n, np.uint64)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, signatures = [], [], []
            for value in batch.column(1):
                items = shingles(value.as_py(), forest.shingle)
                sizes.append(len(items))
                keys.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
                signatures.append(signature(items, factors, offsets).tobytes() if len(items) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())],
                names=["id", "n_shingles", "node_key", "signature"],
            )

    rows = docs.select(q(key).cast("long").alias("id"), q(text).cast("string").alias("text"))
    return rows.mapInArrow(signed, "id long, n_shingles long, node_key binary, signature binary")


def _labelled(nodes: DataFrame, forest: Forest) -> DataFrame:
    """(tree, label, id, n_shingles, sketch) of (id, n_shingles, signature), a row for each tree."""
    width = forest.depth * 4
    trees = F.explode(F.array(*[
        F.struct(F.lit(t).alias("tree"), F.substring("signature", t * width + 1, width).alias("label"))
        for t in range(forest.trees)
    ])).alias("t")
    # the last byte of each value stands for it when whole signatures are compared
    sketch = F.unhex(F.concat(*[
        F.hex(F.substring("signature", 4 * k + 4, 1)) for k in range(forest.trees * forest.depth)
    ]))
    return nodes.select("id", "n_shingles", sketch.alias("sketch"), "signature").select(
        "id", "n_shingles", "sketch", trees
    ).select(F.col("t.tree").alias("tree"), F.col("t.label").alias("label"), "id", "n_shingles", "sketch")


def candidates(nodes: DataFrame, forest: Forest) -> DataFrame:
    """(a, b, near) of (id, n_shingles, signature): each pair of neighbours once; near = 0 where
    one is the other's first candidate in one of the first trees."""
    rows = _labelled(nodes, forest)
    order = ["tree", "label", F.xxhash64("tree", "id")]
    percent, least, reach = forest.percent, forest.least, forest.reach

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = {
                "label": np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u4").reshape(batch.num_rows, -1),
                "tree": batch.column(0).to_numpy(), "id": batch.column(2).to_numpy(),
                "n": batch.column(3).to_numpy(),
                "sketch": np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(batch.num_rows, -1),
            }
            old = 0 if held is None else len(held["id"])
            rows = fresh if held is None else {k: np.concatenate([held[k], fresh[k]]) for k in fresh}
            a, b, near = _close(rows, old, percent, least, reach)
            held = {k: v[-reach:] for k, v in rows.items()}
            # rows held back have met each other already
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(near)], names=["a", "b", "near"]
            )

    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    pairs = ordered.mapInArrow(neighbours, "a long, b long, near int")
    return pairs.where("a <> b").groupBy("a", "b").agg(F.min("near").alias("near"))


def _close(rows: dict, old: int, percent: int, least: int, reach: int):
    """Pairs of rows at most ``reach`` apart whose later one is at ``old`` or after.

    A row's depth is one value more than it shares with the row ``reach`` ahead: so deep, its
    region holds no more than that. Rows that share less are no candidates; the next two are
    in any case, for among equal labels there is no depth that tells rows apart.
    """
    total = len(rows["id"])
    label, tree = rows["label"], rows["tree"]

    def shared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        same = label[left] == label[right]
        same[:, 0] &= tree[left] == tree[right]
        return np.logical_and.accumulate(same, axis=1).sum(axis=1)

    here = np.arange(total)
    depth = np.ones(total, np.int64)
    depth[: max(0, total - reach)] = shared(here[: max(0, total - reach)], here[reach:]) + 1
    first = np.ones(total, bool)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lag in range(1, min(reach, total - 1) + 1):
        left = np.arange(max(0, old - lag), total - lag)
        right = left + lag
        n, m = rows["n"][left], rows["n"][right]
        fits = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
        left, right = left[fits], right[fits]
        deep = shared(left, right)
        fits = (deep >= depth[left]) | ((deep > 0) & (lag <= 2))
        left, right = left[fits], right[fits]
        alike = (rows["sketch"][left] == rows["sketch"][right]).sum(axis=1) >= least
        left, right = left[alike], right[alike]
        near = np.where(first[left] & (tree[left] < FIRST_TREES), 0, 1)
        out.append((rows["id"][left], rows["id"][right], near.astype(np.int32)))
        first[left] = False
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.int32)
    return tuple(np.concatenate(x) for x in zip(*out))


def confirmed(pairs: DataFrame, texts: DataFrame, forest: Forest) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: dict[int, np.ndarray] = {}

        def items(node: int, text: str) -> np.ndarray:
            if node not in recent:
                if len(recent) >= 256:
                    recent.clear()
                recent[node] = shingles(text, forest.shingle)
            return recent[node]

        for batch in batches:
            keep = []
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one, other = items(a, x), items(b, y)
                common = len(np.intersect1d(one, other, assume_unique=True))
                keep.append(100 * common >= forest.percent * (len(one) + len(other) - common))
            found = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            yield found

    return both.mapInArrow(linked, "a long, b long")


def near_duplicates(
    docs: DataFrame, forest: Forest = Forest(), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, n_shingles, component_id, kept), one row per input row.

    component_id is the smallest key that can be reached over links, the row's own included.
    Texts without words have an empty set and are linked with nothing. Rows without a key take
    no part (component_id null, kept); rows of one key are one document, repeated rows all have
    its result. Keys are integers. Other columns are ignored, whatever their names.
    """
    missing_columns(docs, key, text)
    every = written(nodes(docs, forest, key, text), "forest-rows")
    known = every.where("node_key is not null and id is not null")
    groups = written(
        known.groupBy("node_key").agg(
            F.min("id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")
        ),
        "forest-nodes",
    )
    pairs = written(
        candidates(groups.select(F.col("node").alias("id"), "n_shingles", "signature"), forest), "forest-pairs"
    )
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    rows = docs.select(q(key).cast("long").alias("id"), q(text).cast("string").alias("text"))
    texts = written(_touched(rows, ends).join(ends, "id").dropDuplicates(["id"]), "forest-texts")
    links = written(confirmed(pairs.where("near = 0"), texts, forest), "forest-links")
    roots = _roots(links)
    side = lambda end: roots.select(F.col("u").alias(end), F.col("v").alias(f"root_{end}"))
    apart = pairs.where("near = 1").join(side("a"), "a", "left").join(side("b"), "b", "left").where(
        F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
    )
    roots = _merged(roots, written(confirmed(apart, texts, forest), "forest-more"))
    roots = _settled(_crowds(groups.select(F.col("node").alias("id"), "n_shingles", "signature"), forest), roots, rows, forest)
    members = known.select("id", "node_key").join(groups.select("node_key", "node"), "node_key")
    # rows of one key with different texts tie their nodes together
    found = members.join(roots, members["node"] == roots["u"], "left").select(
        "id", F.coalesce("v", "node").alias("component_id")
    ).groupBy("id").agg(F.min("component_id").alias("component_id"))
    return every.select("id", "n_shingles").join(found, "id", "left").select(
        F.col("id").alias(key), "n_shingles", F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )


def _merged(roots: DataFrame, more: DataFrame) -> DataFrame:
    if more.isEmpty():
        return roots
    # earlier groups stand for their members
    return _roots(more.unionByName(roots.select(F.col("u").alias("a"), F.col("v").alias("b"))))


def _crowds(nodes: DataFrame, forest: Forest) -> DataFrame:
    """(region, blocks, id, n_shingles, sketch): where more than ``reach`` nodes share the
    first ``crowd`` values of a tree."""
    region = F.xxhash64("tree", F.substring("label", 1, 4 * forest.crowd)).alias("region")
    rows = _labelled(nodes, forest).select(region, "id", "n_shingles", "sketch")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_NODES, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    sized = rows.groupBy("region").agg(F.count(F.lit(1)).alias("nodes"), blocks.alias("blocks"))
    crowded = written(sized.where(F.col("nodes") > forest.reach).drop("nodes"), "forest-regions")
    return written(_touched(rows, crowded, "region").join(crowded, "region"), "forest-crowds")


def _open(crowds: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of regions that hold more than one group, each with its group's root."""
    rooted = crowds.join(roots.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").withColumn(
        "root", F.coalesce("root", "id")
    )
    several = rooted.groupBy("region").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
    return written(rooted.join(several.select("region"), "region", "left_semi"), "forest-open")


def _settled(crowds: DataFrame, roots: DataFrame, rows: DataFrame, forest: Forest) -> DataFrame:
    """The roots after all links inside crowded regions."""
    texts = None
    for turn in range(LEADER_ROUNDS + 1):
        still = _open(crowds, roots)
        if still.isEmpty():
            return roots
        if texts is None:
            ends = still.select("id").distinct()
            texts = written(_touched(rows, ends).join(ends, "id").dropDuplicates(["id"]), "forest-open-texts")
        if turn < LEADER_ROUNDS:
            found = confirmed(_led(still, forest), texts, forest)
        else:
            found = _compared(still, texts, forest)
        roots = _merged(roots, written(found, "forest-crowd-links"))
    return roots


def _led(members: DataFrame, forest: Forest) -> DataFrame:
    """(a, b): members and the leaders of their region that are of another group and alike enough."""
    percent, least = forest.percent, forest.least
    wanted = forest.trees * forest.depth * percent / 100

    def central(key: tuple, block: pa.Table) -> pa.Table:
        sketch = np.frombuffer(b"".join(block.column("sketch").to_pylist()), np.uint8).reshape(block.num_rows, -1)
        root = block.column("root").to_numpy()
        equal = np.zeros((len(root), len(root)), np.uint16)
        for column in sketch.T:
            equal += column[:, None] == column[None, :]
        alike = ((equal >= wanted) & (root[:, None] != root[None, :])).sum(axis=1)
        top = np.lexsort((block.column("id").to_numpy(), -alike))[:LEADERS]
        chosen = block.take(pa.array(top)).select(["region", "id", "n_shingles", "root", "sketch"])
        return chosen.append_column("score", pa.array(alike[top] / len(root)))

    kinds = "region long, id long, n_shingles long, root long, sketch binary"
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    leaders = members.withColumn("block", block).groupBy("region", "block").applyInArrow(central, f"{kinds}, score double")
    few = leaders.groupBy("region").agg(F.sort_array(F.collect_list(
        F.struct((-F.col("score")).alias("score"), "id", "n_shingles", "root", "sketch")
    )).alias("leaders")).withColumn("leaders", F.slice("leaders", 1, LEADERS))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for node, n, root, sketch, some in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.frombuffer(sketch, np.uint8)
                for x in some:
                    if x["root"] == root or 100 * min(n, x["n_shingles"]) < percent * max(n, x["n_shingles"]):
                        continue
                    if (np.frombuffer(x["sketch"], np.uint8) == own).sum() >= least:
                        a.append(min(node, x["id"]))
                        b.append(max(node, x["id"]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    both = members.join(few, "region").select("id", "n_shingles", "root", "sketch", "leaders")
    return both.mapInArrow(met, "a long, b long").distinct()


def _compared(members: DataFrame, texts: DataFrame, forest: Forest) -> DataFrame:
    """(a, b): links that join all that is linked within a region, from every pair of its blocks."""
    others = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda i: F.struct(F.least(i, "block").alias("p"), F.greatest(i, "block").alias("q")),
    )
    pairs = F.filter(others, lambda x: (x["p"] < x["q"]) | (F.col("blocks") == 1))
    dealt = members.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select(
        "region", "id", F.explode(pairs).alias("x")
    ).select("region", "x.p", "x.q", "id")

    def linked(key: tuple, both: pa.Table) -> pa.Table:
        ids = both.column("id").to_numpy()
        sets = [shingles(text.as_py(), forest.shingle) for text in both.column("text")]
        a, b = _forest_of(sets, forest.percent)
        return pa.table({"a": pa.array(ids[a], pa.int64()), "b": pa.array(ids[b], pa.int64())})

    return dealt.join(texts, "id").groupBy("region", "p", "q").applyInArrow(linked, "a long, b long")


def _forest_of(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all sets which are linked over any of the others. Common items of all
    pairs are products of a 0/1 matrix, a few columns at a time."""
    sizes = np.array([len(x) for x in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often > 1
    place = np.cumsum(shared) - 1
    row, column = row[shared[column]], place[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(shared.sum()), COLUMNS):
        some = slice(*np.searchsorted(column, [low, low + COLUMNS]))
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[row[some], column[some] - low] = 1
        common += part @ part.T
    left, a, b = np.ones(len(sets), bool), [], []
    for start in range(len(sets)):
        front = [start] if left[start] else []
        left[start] = False
        while front:
            at = front.pop()
            both = common[at].astype(np.int64)
            reached = np.flatnonzero(left & (100 * both >= percent * (sizes[at] + sizes - both)))
            left[reached] = False
            a.extend([at] * len(reached))
            b.extend(reached.tolist())
            front.extend(reached.tolist())
    return np.array(a, np.int64), np.array(b, np.int64)


def _touched(rows: DataFrame, ends: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose key may be among ``ends``: all that are, and some others by the collision of
    hashes. A bit for each hash, 1 MB in all however many ids there are, spares most texts the
    shuffle of the exact join that follows."""
    spot = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    marks = ends.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits")
    )
    placed = rows.withColumn("bucket", F.bitmap_bucket_number(spot)).withColumn("place", F.bitmap_bit_position(spot))
    byte = F.expr("cast(conv(hex(substring(bits, cast(place div 8 as int) + 1, 1)), 16, 10) as int)")
    bit = F.expr("cast(place % 8 as int)")
    found = placed.join(F.broadcast(marks), "bucket").withColumn("byte", byte).withColumn("bit", bit)
    return found.where(F.expr("shiftright(byte, bit) & 1") == 1).select(*rows.columns)


def _roots(links: DataFrame) -> DataFrame:
    return components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))


def drop_duplicates(
    docs: DataFrame, forest: Forest = Forest(), key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One document of each group, with its own columns; rows without a key stay, and of
    repeated rows of one key one stays."""
    found = near_duplicates(docs, forest, key, text).where("kept and n_shingles is not null")
    kept = found.select(q(key).alias("_kept_key")).where("_kept_key is not null").distinct()
    named = docs.where(q(key).isNotNull())
    unique = named.join(kept, named[key].cast("long") == kept["_kept_key"], "left_semi").dropDuplicates([key])
    return unique.unionByName(docs.where(q(key).isNull()))


def oracle(shingle: int, percent: int) -> str:
    """The same in SQL by an inverted index over all shingles and a recursive walk over links."""
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {shingle} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {shingle} + 2),
                        lambda i: array_to_string(w[i:i + {shingle} - 1], ' ')) END) AS g FROM d),
e AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
l AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS reached FROM d
      UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, len(g) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""
