"""Mixing a corpus to target weights along a tree of domains, languages and sources.

A budget of tokens goes down the tree. At each node it is shared among the children by weight,
up to what each can give (its tokens times the allowed epochs); what a child cannot give goes
to its siblings, and only what all of them cannot give is missing above, where the next
siblings take it. Every leaf then passes over its documents as many whole epochs as its share
holds, and takes a prefix of one more epoch, in an order seeded by epoch.

Column expressions only. Documents are read once for their token counts; the narrow counts are
written and summed by leaf. A prefix needs no sorted leaf: hashes are cut into bins of about
``bin_rows`` documents, bin totals show in which bin the prefix ends, and only that bin is
sorted. Each document is then compared with its leaf's cut. Only tables of leaves and of
bins are put in order: the children of one node, and the bins of one leaf.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.common import WORD, missing_columns, q, written

TREE = ("domain", "lang", "source")
HASH_BITS = 60


@dataclass(frozen=True)
class Mix:
    """``weights`` gives integer weights by path ("web", "web/en", "web/en/src0"); a path that is
    not listed falls back to its last name ("en") and then to ``default_weight``. ``budget`` is a
    number of tokens, or with ``budget_share`` a share of all tokens."""

    weights: Mapping[str, int] = field(default_factory=dict)
    default_weight: int = 1
    budget: int | None = None
    budget_share: float = 0.5
    max_epochs: int = 4
    seed: int = 17
    bin_rows: int = 4096


def count_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def domain_of(source: Column) -> Column:
    """The domain of a source where the table names none: sources with an even last digit are
    'web', with an odd one 'reference', and others 'other'."""
    digit = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d)$", 1)
    return F.when(digit == "", "other").when(digit.cast("int") % 2 == 0, "web").otherwise("reference")


def leaf_plan(counted: DataFrame, mix: Mix) -> DataFrame:
    """Per leaf of (domain, lang, source, tokens, ...): its share, whole epochs and rest.

    Each level's shares are written, a row per node: the plan of the next reads a small table, and
    the driver never holds the levels above, which every use would repeat, in one plan.
    """
    leaves = written(
        counted.groupBy(*TREE).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs")), "leaves"
    ).withColumn("capacity", F.col("tokens") * mix.max_epochs)
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    budget = mix.budget if mix.budget is not None else int(total * mix.budget_share)
    shares = None
    for depth in range(1, len(TREE) + 1):
        nodes = leaves.groupBy(*TREE[:depth]).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.withColumn("weight", _weight(TREE[:depth], mix))
        if shares is None:
            nodes = nodes.withColumn("amount", F.lit(budget).cast("long"))
        else:
            nodes = nodes.join(shares.withColumnRenamed("share", "amount"), list(TREE[: depth - 1]))
        shares = written(_fill(nodes, TREE[:depth]), "mixing-shares")
    plan = leaves.join(shares, list(TREE))
    nothing = F.col("tokens") == 0
    found = plan.select(
        *TREE, "tokens", "n_docs", "share",
        F.when(nothing, 0).otherwise(F.expr("share div tokens")).cast("int").alias("whole"),
        F.when(nothing, 0).otherwise(F.expr("share % tokens")).cast("long").alias("rest"),
    )
    return written(found, "mixing-leaves")


def _weight(levels: tuple[str, ...], mix: Mix) -> Column:
    if not mix.weights:
        return F.lit(mix.default_weight).cast("long")
    table = F.create_map(*[F.lit(x) for pair in mix.weights.items() for x in pair])
    own, path = F.col(levels[-1]), F.concat_ws("/", *levels)
    return F.coalesce(F.try_element_at(table, path), F.try_element_at(table, own), F.lit(mix.default_weight)).cast("long")


def _fill(nodes: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """(levels, share): ``amount`` shared by weight among the children of each parent, none above
    its capacity. Children in order of capacity per weight are full up to some child; from it
    on all are given the same amount per weight."""
    parent = Window.partitionBy(*[F.col(c) for c in levels[:-1]] or [F.lit(0)])
    # capacity / weight in order, children without weight last
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf")))
    order = parent.orderBy("ratio", levels[-1])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("amount") - F.col("full")) / F.col("left")
    return (
        nodes.withColumn("ratio", ratio)
        .withColumn("full", F.coalesce(F.sum("capacity").over(before), F.lit(0)))
        .withColumn("left", F.sum("weight").over(after))
        .withColumn("level", F.when((F.col("left") > 0) & (F.col("amount") > F.col("full")), level).otherwise(0.0))
        .withColumn("open", F.col("capacity") > F.col("weight") * F.col("level"))
        .withColumn("first_open", F.min(F.when(F.col("open"), F.struct("ratio", levels[-1], "level"))).over(parent))
        .select(
            *levels,
            F.when(
                F.col("first_open").isNull() | (F.struct("ratio", levels[-1]) < F.struct(
                    F.col("first_open.ratio").alias("ratio"), F.col(f"first_open.{levels[-1]}").alias(levels[-1])
                )),
                F.col("capacity"),
            ).otherwise(F.floor(F.col("weight") * F.col("first_open.level") + 1e-6)).cast("long").alias("share"),
        )
    )


def _place(seed: int) -> Column:
    """The place of a document in the order of its leaf's last epoch: 60 bits of a hash."""
    name = F.concat_ws(":", F.lit(seed), "whole", F.coalesce(F.col("id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, HASH_BITS // 4), 16, 10).cast("long")


def cuts(counted: DataFrame, plan: DataFrame, mix: Mix) -> DataFrame:
    """The plan with the last document of each leaf's prefix: its place and key, and the tokens
    taken of it. Leaves without a rest have none."""
    bins = F.greatest(F.lit(1), F.expr(f"n_docs div {mix.bin_rows}"))
    wanted = plan.where("rest > 0").select(*TREE, "whole", "rest", bins.alias("bins"))
    placed = counted.join(wanted, list(TREE)).withColumn("place", _place(mix.seed)).withColumn(
        "bin", F.floor(F.col("place") / float(1 << HASH_BITS) * F.col("bins")).cast("long")
    )
    leaf = Window.partitionBy(*TREE)
    before = leaf.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*TREE, "bin").agg(F.sum("n_tokens").alias("n"), F.first("rest").alias("rest"))
    ending = written(
        sums.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .where("start < rest and rest <= start + n")
        .select(*TREE, F.col("bin").alias("last_bin"), "start"),
        "mixing-bins",
    )
    last = placed.join(ending, list(TREE)).where("bin = last_bin and n_tokens > 0")
    inside = leaf.orderBy("place", "id").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("at", F.col("start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    cut = last.where("at < rest").groupBy(*TREE).agg(
        F.max(F.struct("place", "id", F.least(F.col("n_tokens"), F.col("rest") - F.col("at")).alias("taken"))).alias("cut")
    )
    return plan.join(cut, list(TREE), "left").select(
        *TREE, "whole", F.col("cut.place").alias("cut_place"), F.col("cut.id").alias("cut_id"),
        F.col("cut.taken").alias("cut_taken"),
    )


def _tree(docs: DataFrame, domain: Column | None, lang: str, source: str) -> list[Column]:
    missing_columns(docs, lang, source)
    of = domain if domain is not None else domain_of(q(source).cast("string"))
    return [
        F.coalesce(of, F.lit("")).alias("domain"), F.coalesce(q(lang).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(q(source).cast("string"), F.lit("")).alias("source"),
    ]


def mix_documents(
    docs: DataFrame, mix: Mix = Mix(), key: str = "doc_id", text: str = "text", lang: str = "lang",
    source: str = "source", domain: Column | None = None,
) -> DataFrame:
    """(key, domain, lang, source, epoch, n_tokens, taken): the chosen documents of every epoch.

    ``taken`` is below n_tokens only for the document at the end of a leaf's prefix. Tokens are
    words; null and empty texts have none and are chosen in whole epochs only. Null languages
    and sources make leaves named ''. Keys should be unique: rows of one key at a prefix's end
    are all taken alike. Other columns are ignored, whatever their names.
    """
    missing_columns(docs, key, text)
    counted = written(
        docs.select(
            q(key).cast("long").alias("id"), *_tree(docs, domain, lang, source),
            count_words(q(text).cast("string")).alias("n_tokens"),
        ),
        "mixing",
    )
    plan = written(cuts(counted, leaf_plan(counted, mix), mix), "mixing-plan")
    rows = counted.join(plan, list(TREE)).withColumn("place", _place(mix.seed))
    epochs = F.col("whole") + F.when(_in_prefix(), 1).otherwise(0)
    # the rest of a leaf is below its tokens, so at most max_epochs rows come from a document
    rows = rows.where(epochs > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs - 1)))
    at_cut = (F.col("epoch") == F.col("whole")) & (F.col("id").eqNullSafe(F.col("cut_id")))
    return rows.select(
        F.col("id").alias(key), *TREE, "epoch", "n_tokens",
        F.when(at_cut, F.col("cut_taken")).otherwise(F.col("n_tokens")).alias("taken"),
    )


def _in_prefix() -> Column:
    first = (F.col("place") < F.col("cut_place")) | (
        (F.col("place") == F.col("cut_place"))
        & (F.col("id").isNull() | F.coalesce(F.col("id") <= F.col("cut_id"), F.lit(False)))
    )
    return F.coalesce(first, F.lit(False)) & (F.col("n_tokens") > 0)


def select_documents(
    docs: DataFrame, mix: Mix, key: str = "doc_id", text: str = "text", lang: str = "lang",
    source: str = "source", domain: Column | None = None,
) -> DataFrame:
    """The documents of a mix of one epoch, whole, with their own columns and nothing else.

    Texts are not shuffled unless leaves are too many to broadcast: each row is compared with
    the cut of its leaf.
    """
    if mix.max_epochs != 1:
        raise ValueError("documents are chosen once: max_epochs must be 1")
    missing_columns(docs, key, text)
    tree = _tree(docs, domain, lang, source)
    own = F.struct(*[q(c) for c in docs.columns]).alias("own")
    counts = F.coalesce(F.col("own")[text].cast("string"), F.lit(""))
    counted = written(
        docs.select(q(key).cast("long").alias("id"), *tree, count_words(q(text).cast("string")).alias("n_tokens")),
        "mixing",
    )
    plan = written(cuts(counted, leaf_plan(counted, mix), mix), "mixing-plan")
    rows = docs.select(q(key).cast("long").alias("id"), *tree, own)
    rows = rows.join(plan, list(TREE)).withColumn("place", _place(mix.seed))
    rows = rows.withColumn("n_tokens", F.when(counts.rlike(WORD), 1).otherwise(0))
    kept = rows.where((F.col("whole") > 0) | _in_prefix())
    return kept.select(*[F.col("own")[c].alias(c) for c in docs.columns])


def oracle(mix: Mix) -> str:
    """The same in SQL, leaves sorted whole."""
    cases = lambda path, own: "CASE WHEN false THEN 0 " + " ".join(
        f"WHEN {path} = '{k}' THEN {w}" for k, w in mix.weights.items()
    ) + " " + " ".join(f"WHEN {own} = '{k}' THEN {w}" for k, w in mix.weights.items()) + f" ELSE {mix.default_weight} END"
    steps = []
    for depth in range(1, len(TREE) + 1):
        levels, own, up = TREE[:depth], TREE[depth - 1], TREE[: depth - 1]
        part = ("PARTITION BY " + ", ".join(up)) if up else ""
        path = " || '/' || ".join(levels)
        source = "leaves, total" if depth == 1 else f"leaves JOIN s{depth - 1} USING ({', '.join(up)})"
        amount = "any_value(budget)" if depth == 1 else "any_value(share)"
        over = f"({part} ORDER BY ratio, {own} ROWS BETWEEN"
        steps.append(f"""
n{depth} AS (SELECT {', '.join(levels)}, sum(capacity)::BIGINT AS capacity, {cases(path, own)} AS weight,
       {amount} AS amount FROM {source} GROUP BY {', '.join(levels)}),
r{depth} AS (SELECT *, CASE WHEN weight > 0 THEN capacity / weight ELSE 'inf'::DOUBLE END AS ratio FROM n{depth}),
o{depth} AS (SELECT *, coalesce(sum(capacity) OVER {over} UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS filled,
       (sum(weight) OVER {over} CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS rest_weight,
       row_number() OVER ({part} ORDER BY ratio, {own}) AS n FROM r{depth}),
l{depth} AS (SELECT *, CASE WHEN rest_weight > 0 AND amount > filled THEN (amount - filled) / rest_weight ELSE 0.0::DOUBLE END AS level
       FROM o{depth}),
f{depth} AS (SELECT *, min(CASE WHEN capacity > weight * level THEN n END) OVER ({part}) AS first_open FROM l{depth}),
x{depth} AS (SELECT *, max(CASE WHEN n = first_open THEN level END) OVER ({part}) AS open_level FROM f{depth}),
s{depth} AS (SELECT {', '.join(levels)}, CASE WHEN first_open IS NULL OR n < first_open THEN capacity
       ELSE floor(weight * open_level + 1e-6) END::BIGINT AS share FROM x{depth}),""")
    tree = ", ".join(TREE)
    budget = str(mix.budget) if mix.budget is not None else f"floor(sum(tokens) * {mix.budget_share})"
    return rf"""
WITH d AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens,
         CASE WHEN NOT regexp_matches(coalesce(source, ''), '\d$') THEN 'other'
              WHEN right(source, 1)::INT % 2 = 0 THEN 'web' ELSE 'reference' END AS domain,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
leaves AS (SELECT {tree}, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * {mix.max_epochs} AS capacity
           FROM d GROUP BY {tree}),
total AS (SELECT ({budget})::BIGINT AS budget FROM leaves),
{''.join(steps)}
p AS (SELECT {tree}, CASE WHEN tokens = 0 THEN 0 ELSE share // tokens END AS whole,
             CASE WHEN tokens = 0 THEN 0 ELSE share % tokens END AS rest FROM leaves JOIN s3 USING ({tree})),
h AS (SELECT d.*, whole, rest,
             ('0x' || substr(md5('{mix.seed}:' || whole || ':' || doc_id), 1, 15))::BIGINT AS place
      FROM d JOIN p USING ({tree})),
c AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY {tree} ORDER BY place, doc_id
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM h),
e AS (SELECT *, unnest(range(whole + 1)) AS epoch FROM c)
SELECT doc_id, {tree}, epoch::INT AS epoch, n_tokens,
       CASE WHEN epoch < whole THEN n_tokens ELSE least(n_tokens, rest - pos) END::BIGINT AS taken
FROM e WHERE epoch < whole OR (pos < rest AND n_tokens > 0)
"""
