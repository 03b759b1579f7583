"""The trie of conversations' prefixes, summed by parallel tree contraction.

A conversation is a sequence of turns. A turn is known by a digest of its role and text; a prefix
by its depth and the sum of four 32-bit lanes of a digest of (place, turn) over its turns, 128
bits in all. Such sums are prefix sums, so a conversation of any length is cut into blocks, and
one grouping finds the nodes. A node is named by its smallest member and its depth.

Subtree totals take rounds of joins whose number grows with the logarithm of the nodes, whatever
the depth. A round *rakes* the leaves (their totals are final and go to their parents) and
*compresses* chains: a node with one child, whose hashed priority is below its parent's and its
child's, is taken out and its sum put on the edge from child to grandparent. Neighbours are
never taken out together. Each round is one written table, and rounds shrink geometrically; read
backwards, they give every compressed node its child's total and what lay between.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import HOT_KEYS, join_copies, missing_columns, q, written
from metricloom.operators.ranking import running, with_range_block

LONG_TURNS = 65_536  # turns of a conversation in one block
LANES = ["l1", "l2", "l3", "l4"]
NODE = ["depth", *LANES]
TASK_NODES = 250_000  # nodes of a round in one task
UNROLLED = 4  # rounds read backwards between two written tables
CHUNK_IDS = 8192


# --- sequences -------------------------------------------------------------------------------


def sequences(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    long_turns: int = LONG_TURNS,
) -> tuple[DataFrame, DataFrame]:
    """(conv, place, code, n_bytes) for every turn, and (conv, n) for every conversation.

    Places count from 1 by turn, nulls first; turns of one number stand in the order of a digest of
    their contents, and repeated rows are turns of their own. A null role or text is empty. Rows
    without a conversation are in none.
    """
    missing_columns(turns, conv, turn, role, text)
    who, what = (F.coalesce(q(c).cast("string"), F.lit("")) for c in (role, text))
    code = F.unhex(F.sha2(F.concat_ws(":", F.octet_length(who).cast("string"), who, what), 256))
    # The row numbers only part equal rows; once written they stay.
    rows = written(
        turns.where(q(conv).isNotNull()).select(
            q(conv).cast("long").alias("conv"), q(turn).isNotNull().alias("given"),
            F.coalesce(q(turn).cast("long"), F.lit(0)).alias("turn"), code.alias("code"),
            F.octet_length(what).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row"),
        ).withColumn("part", F.xxhash64("code")), "turns",
    )
    sizes = written(rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n")), "conversations")
    order = ["given", "turn", "part", "row"]
    # Fewer than HOT_KEYS conversations can be that long; their turns are cut into ranges.
    long = sizes.where(F.col("n") > max(long_turns, rows.count() // HOT_KEYS)).select("conv")
    if long.count():
        cut = with_range_block(rows.join(F.broadcast(long), "conv", "left_semi"), order)
        rest = rows.join(F.broadcast(long), "conv", "left_anti").withColumn("_block", F.lit(0))
        rows = cut.unionByName(rest)
    else:
        rows = rows.withColumn("_block", F.lit(0))
    placed = running(rows, order, {"place": F.lit(1).cast("long")}, by=["conv"], block="_block")
    return written(placed.select("conv", "place", "code", "n_bytes"), "places"), sizes


def heads(conv: Column, modulus: int) -> Column:
    """How many turns a conversation takes over: a checksum of its number."""
    return F.crc32(conv.cast("string").cast("binary")) % modulus


def rebuilt(turns: DataFrame, sizes: DataFrame, family: int = 5, modulus: int = 9) -> tuple[DataFrame, DataFrame]:
    """Sequences whose first turns are those of the first conversation of their family.

    Conversation c starts with the first h turns of c - c mod ``family`` (fewer, if it has fewer or is
    absent), h being ``heads``; its own turns after the first h follow. The result has the shape of
    the input; a conversation without turns is only in the second table, with n = 0.
    """
    of_family = F.col("conv") - F.pmod("conv", F.lit(family))
    base = sizes.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    known = sizes.withColumn("h", heads(F.col("conv"), modulus)).withColumn("base", of_family).join(base, "base", "left")
    given = F.least("h", F.coalesce("n_base", F.lit(0)))
    known = written(known.select("conv", "n", "h", given.alias("given")), "families")
    spread = turns.where((F.col("place") < modulus) & (F.pmod("conv", F.lit(family)) == 0)).select(
        F.explode(F.sequence(F.lit(0), F.lit(family - 1))).alias("k"), F.col("conv").alias("base"), "place", "code", "n_bytes"
    )
    spread = spread.select(F.try_add("base", F.col("k").cast("long")).alias("conv"), "place", "code", "n_bytes")
    first = spread.join(known, "conv").where("place <= h").select("conv", "place", "code", "n_bytes")
    own = join_copies(turns.where(F.col("place") > heads(F.col("conv"), modulus)), known, "conv", "n", turns.count())
    own = own.select("conv", (F.col("place") - F.col("h") + F.col("given")).alias("place"), "code", "n_bytes")
    length = F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return first.unionByName(own), known.select("conv", length.alias("n"))


# --- nodes -----------------------------------------------------------------------------------


def _members(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """(conv, n_bytes, node, parent) for every prefix of every conversation, the empty one included."""
    mixed = F.sha2(F.concat(F.encode(F.concat(F.col("place").cast("string"), F.lit(":")), "UTF-8"), F.col("code")), 256)
    lanes = [F.conv(F.substring("mixed", 8 * n + 1, 8), 16, 10).cast("long").alias(f"own{n + 1}") for n in range(4)]
    rows = turns.withColumn("mixed", mixed).select("conv", "place", "n_bytes", *lanes)
    rows = rows.withColumn("_block", F.floor((F.col("place") - 1) / LONG_TURNS))
    summed = running(rows, ["place"], {f"l{n}": F.col(f"own{n}") for n in range(1, 5)}, by=["conv"], block="_block")
    node = F.struct(F.col("place").alias("depth"), *LANES)
    parent = F.struct((F.col("place") - 1).alias("depth"), *[(F.col(f"l{n}") - F.col(f"own{n}")).alias(f"l{n}") for n in range(1, 5)])
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in NODE])
    top = sizes.select("conv", F.lit(0).cast("long").alias("n_bytes"), zero.alias("node"), F.lit(None).cast(f"struct<{', '.join(f'{c}: long' for c in NODE)}>").alias("parent"))
    return summed.select("conv", "n_bytes", node.alias("node"), parent.alias("parent")).unionByName(top)


def _nodes(members: DataFrame) -> DataFrame:
    """(node, conv_id, n_convs, n_bytes, n_children, parent_conv_id), one row per distinct prefix."""
    nodes = written(
        members.groupBy("node").agg(
            F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
            F.max("n_bytes").alias("n_bytes"), F.max("parent").alias("parent"),
        ), "nodes",
    )
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes_with = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes_with = written(nodes_with, "children")
    parents = nodes_with.where("n_children > 0").select(
        F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("copies")
    )
    below = join_copies(nodes_with.where("parent IS NOT NULL"), parents, "parent", "copies", nodes.count())
    top = nodes_with.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return written(below.unionByName(top).drop("parent"), "trie")


# --- contraction -----------------------------------------------------------------------------


def _priority(c: Column, d: Column, number: int) -> Column:
    return F.xxhash64(c, d, F.lit(number))


def _round(live: DataFrame, number: int, sums: list[str]) -> DataFrame:
    """Rake the leaves of ``live`` and choose the chain nodes to take out."""
    leaf = F.col("n") == 0
    below = live.where("pc IS NOT NULL").groupBy(F.col("pc").alias("c"), F.col("pd").alias("d")).agg(
        F.count_if(~leaf).alias("left"),
        F.max(F.when(~leaf, F.struct("c", "d", *[f"x_{s}" for s in sums]))).alias("only"),
        *[F.sum(F.when(leaf, F.col(s) + F.col(f"x_{s}")).otherwise(0)).alias(f"add_{s}") for s in sums],
    )
    rows = live.join(below, ["c", "d"], "left")
    own = _priority(F.col("c"), F.col("d"), number)
    lowest = (own < _priority(F.col("pc"), F.col("pd"), number)) & (own < _priority(F.col("only.c"), F.col("only.d"), number))
    out = F.when(leaf, F.lit("raked")).when((F.col("left") == 1) & lowest, F.lit("compressed")).otherwise(F.lit("kept"))
    grown = {s: F.col(s) + F.coalesce(f"add_{s}", F.lit(0)) for s in sums}
    return rows.select(
        "c", "d", "pc", "pd", out.alias("state"), F.coalesce("left", F.lit(0)).alias("n"),
        F.col("only.c").alias("child_c"), F.col("only.d").alias("child_d"),
        *[v.alias(s) for s, v in grown.items()], *[f"x_{s}" for s in sums],
        *[(F.col(f"only.x_{s}") + v).alias(f"between_{s}") for s, v in grown.items()],
    )


def _next(step: DataFrame, sums: list[str]) -> DataFrame:
    """What is left after a round: children of nodes taken out hang from their grandparents."""
    gone = step.where("state = 'compressed'").select(
        F.col("child_c").alias("c"), F.col("child_d").alias("d"), F.col("pc").alias("to_c"), F.col("pd").alias("to_d"),
        *[(F.col(s) + F.col(f"x_{s}")).alias(f"y_{s}") for s in sums],
    )
    return step.where("state = 'kept'").join(gone, ["c", "d"], "left").select(
        "c", "d", F.coalesce("to_c", "pc").alias("pc"), F.coalesce("to_d", "pd").alias("pd"), "n",
        *sums, *[(F.col(f"x_{s}") + F.coalesce(f"y_{s}", F.lit(0))).alias(f"x_{s}") for s in sums],
    )


def subtree_sums(tree: DataFrame, sums: list[str]) -> DataFrame:
    """(c, d, *sums): for every node the sums over its subtree, itself included.

    ``tree`` has the nodes' names (c, d), their parents' (pc, pd; null for the root), the number ``n``
    of their children, and a long column for each of ``sums``.
    """
    live = tree.select("c", "d", "pc", "pd", "n", *sums, *[F.lit(0).cast("long").alias(f"x_{s}") for s in sums])
    steps, left = [], tree.count()
    while left:
        step = _round(live, len(steps), sums).coalesce(max(1, math.ceil(left / TASK_NODES)))
        steps.append((written(step, "contraction"), left))
        left = steps[-1][0].where("state <> 'raked'").count()
        live = _next(steps[-1][0], sums)
    totals = None
    for number, (step, count) in enumerate(reversed(steps), 1):
        raked = step.where("state = 'raked'").select("c", "d", *sums)
        if totals is None:
            totals = raked
            continue
        known = totals.select(F.col("c").alias("child_c"), F.col("d").alias("child_d"), *[F.col(s).alias(f"of_{s}") for s in sums])
        out = step.where("state = 'compressed'").join(known, ["child_c", "child_d"])
        out = out.select("c", "d", *[(F.col(f"of_{s}") + F.col(f"between_{s}")).alias(s) for s in sums])
        totals = totals.unionByName(raked).unionByName(out)
        if number % UNROLLED == 0 and number < len(steps):
            totals = written(totals.coalesce(max(1, math.ceil(count / TASK_NODES))), "totals")
    return totals if totals is not None else tree.select("c", "d", *sums)


# --- ends ------------------------------------------------------------------------------------


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (lanes, depth, id) rows as one row per run of a node and at most CHUNK_IDS ids."""
    for batch in batches:
        keys = list(zip(*[batch.column(n).to_pylist() for n in range(len(NODE))]))
        ids = batch.column(len(NODE)).to_pylist()
        starts = [n for n in range(len(keys)) if n == 0 or keys[n] != keys[n - 1]]
        cuts = [m for a, b in zip(starts, [*starts[1:], len(keys)]) for m in range(a, b, CHUNK_IDS)]
        spans = list(zip(cuts, [*cuts[1:], len(keys)]))
        yield pa.RecordBatch.from_arrays(
            [*[pa.array([keys[a][n] for a in cuts], pa.int64()) for n in range(len(NODE))],
             pa.array([ids[a] for a in cuts], pa.int64()), pa.array([",".join(map(str, ids[a:b])) for a, b in spans], pa.string())],
            names=[*NODE, "first", "ids"],
        )


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks as one digest per node; only the digest's state is kept between them."""

    def rows(found: list) -> pa.RecordBatch:
        columns = [*zip(*found)] or [()] * (len(NODE) + 1)
        kinds = [*[pa.int64()] * len(NODE), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*NODE, "sha256"])

    at, state = None, None
    for batch in batches:
        found = []
        for *key, _, ids in zip(*[c.to_pylist() for c in batch.columns]):
            if key != at:
                if at is not None:
                    found.append((*at, state.hexdigest()))
                at, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield rows(found)
    if at is not None:
        yield rows([(*at, state.hexdigest())])


def _ends(members: DataFrame) -> DataFrame:
    """(node, sha256) of the ids of the conversations that end there, in ascending order.

    A digest of a sequence has to be taken in its order: a node's ids are joined in chunks, by
    ranges of all ids, and one task takes each node's chunks as they come.
    """
    last = members.groupBy("conv").agg(F.max("node").alias("node")).select("node.*", "conv")
    order = [*LANES, "depth", "conv"]
    sorted_ids = last.repartitionByRange(*order).sortWithinPartitions(*order)
    names = ", ".join(f"{c} long" for c in NODE)
    chunks = sorted_ids.select(*NODE, "conv").mapInArrow(_chunks, f"{names}, first long, ids string")
    dealt = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return dealt.mapInArrow(_hashes, f"{names}, sha256 string").select(F.struct(*NODE).alias("node"), "sha256")


# --- the operator ----------------------------------------------------------------------------


def prefix_trie(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """The trie's nodes: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``turns`` and ``sizes`` are as ``sequences`` gives them. A node is a distinct prefix; its
    ``conv_id`` is the smallest of its ``n_convs`` members. ``n_leaves`` and ``saved_tokens`` are sums over
    its subtree: of nodes without children, and of (n_convs - 1) * bytes of the last text. Without
    conversations there is no node, not even a root.
    """
    members = written(_members(turns, sizes), "members")
    trie = _nodes(members)
    tree = trie.select(
        F.col("conv_id").alias("c"), F.col("node.depth").alias("d"), F.col("parent_conv_id").alias("pc"),
        F.when(F.col("parent_conv_id").isNotNull(), F.col("node.depth") - 1).alias("pd"), F.col("n_children").alias("n"),
        F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved_tokens"),
    )
    totals = subtree_sums(tree, ["n_leaves", "saved_tokens"])
    totals = totals.select(F.col("c").alias("conv_id"), F.col("d").alias("depth"), "n_leaves", "saved_tokens")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    found = trie.join(_ends(members), "node", "left").withColumn("depth", F.col("node.depth"))
    return found.join(totals, ["conv_id", "depth"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha256", nothing).alias("ends_sha256"),
    )


# The checksum is taken bit by bit; key digests stand for turns.
ORACLE = """
WITH z AS (SELECT conv_id AS c, xor(CAST(4294967295 AS UBIGINT), list_reduce(
        list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT)),
        lambda a, b: list_reduce(list_transform(range(8), lambda i: CAST(i AS UBIGINT)),
            lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN CAST(3988292384 AS UBIGINT) ELSE 0 END), xor(a, b)),
        CAST(4294967295 AS UBIGINT))) % 9 AS h
    FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
  t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p,
        strlen(coalesce(text, '')) AS bytes, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')) AS code
    FROM conversations WHERE conv_id IS NOT NULL),
  r AS (SELECT z.c, 0 AS part, t.p, t.bytes, t.code FROM z JOIN t ON t.c = z.c - z.c % 5 AND t.p <= z.h
    UNION ALL SELECT z.c, 1, t.p, t.bytes, t.code FROM z JOIN t ON t.c = z.c AND t.p > z.h),
  s AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, p) AS d, bytes, code FROM r),
  k AS (SELECT c, d, bytes, string_agg(code, '') OVER (PARTITION BY c ORDER BY d) AS key FROM s
    UNION ALL SELECT c, 0, 0, '' FROM z),
  m AS (SELECT *, max(d) OVER (PARTITION BY c) = d AS ends FROM k),
  n AS (SELECT d, key, min(c) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
        sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256 FROM m GROUP BY d, key),
  x AS (SELECT m.c, m.d, n.conv_id FROM m JOIN n USING (d, key)),
  f AS (SELECT n.*, x.conv_id AS parent_conv_id FROM n LEFT JOIN x ON x.c = n.conv_id AND x.d = n.d - 1),
  g AS (SELECT f.*, coalesce(q.n_children, 0) AS n_children FROM f LEFT JOIN
    (SELECT parent_conv_id AS conv_id, d - 1 AS d, count(*) AS n_children FROM f WHERE d > 0 GROUP BY 1, 2) AS q USING (conv_id, d)),
  u AS (SELECT x.conv_id, x.d, count(*) FILTER (WHERE g.n_children = 0) AS n_leaves, sum((g.n_convs - 1) * g.bytes) AS saved_tokens
    FROM g JOIN x ON x.c = g.conv_id AND x.d <= g.d GROUP BY 1, 2)
SELECT conv_id, CAST(d AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM g JOIN u USING (conv_id, d)"""
