"""Tool calls of chats: linked to results, ordered, validated and written as canonical JSON.

Calls and results meet by identifier in a hash join; each identifier is reduced to one call and
one result first, partially before the shuffle, so that a repeated one stays a single row.
Dependencies are peeled off in rounds, all conversations at once: a round places every call
whose dependencies stand, and drops the dependencies on what it placed. The number of rounds is
the depth of the deepest chain. Positions come from counts of (conversation, level, block of
turns) and a rank inside a block, so that a long conversation is no single group.

Column expressions only; arguments are parsed once into variants, whose objects keep their
keys in order.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.common import missing_columns, q, written

# Parameter types of schemas, and what a parsed value of each looks like.
TYPES: Mapping[str, str] = {
    "string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$",
    "array": "^ARRAY<", "object": "^OBJECT<", "null": "^VOID$",
}
BLOCK = 256

Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]


def argument_errors(name: Column, fields: Column, schemas: Schemas) -> Column:
    """The faults of arguments, parsed to a map of variants, under the tool's schema (parameter -> type, required), in
    the order of the schema, then unexpected parameters in the order of their names."""
    text = lambda x: x.cast("array<string>")
    found = F.array(F.lit("unknown tool"))
    for tool, parameters in schemas.items():
        checks = []
        for parameter, (kind, required) in parameters.items():
            value = F.try_element_at(fields, F.lit(parameter))
            absent = F.lit(f"missing: {parameter}") if required else F.lit(None).cast("string")
            given = F.array_contains(F.map_keys(fields), parameter)
            wrong = ~F.coalesce(F.schema_of_variant(value).rlike(TYPES[kind]), F.lit(False))
            checks.append(F.when(~given, absent).when(wrong, f"type: {parameter}"))
        others = F.array_sort(F.array_except(F.map_keys(fields), F.array(*[F.lit(p) for p in parameters])))
        mine = F.concat(
            F.array_compact(F.array(*checks)) if checks else text(F.array()),
            F.transform(others, lambda k: F.concat(F.lit("unexpected: "), k)),
        )
        found = F.when(name == tool, F.when(fields.isNull(), F.array(F.lit("malformed arguments"))).otherwise(mine)).otherwise(found)
    return found


def levels(edges: DataFrame) -> DataFrame:
    """(call_id, level) of calls with dependencies (call_id, needs), all of which exist; level 0
    is for calls without any, which are not returned. Calls on or behind a cycle are missing."""
    left = written(edges.distinct(), "call-edges")
    pending = written(left.select("call_id").distinct(), "call-pending")
    found: DataFrame | None = None
    # the first round drops the dependencies on calls that depend on nothing
    placed = written(left.select(F.col("needs").alias("call_id")).distinct().join(pending, "call_id", "left_anti"), "call-level")
    level = 0
    while not placed.isEmpty():
        level += 1
        left = written(left.join(placed.withColumnRenamed("call_id", "needs"), "needs", "left_anti"), "call-edges")
        waiting = written(pending.join(left.select("call_id").distinct(), "call_id", "left_semi"), "call-pending")
        placed = written(pending.join(waiting, "call_id", "left_anti"), "call-level")
        pending = waiting
        here = placed.withColumn("level", F.lit(level))
        found = here if found is None else found.unionByName(here)
    return found if found is not None else pending.where("false").withColumn("level", F.lit(0))


def link_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """(conv_id, position, level, call_id, name, n_results, errors, valid, json) for every
    identifier of ``calls``.

    Calls are (conv_id, turn, call_id, name, arguments, depends_on: array of call ids), results
    (call_id, turn, content). Of repeated identifiers the earliest turn counts, then the smallest
    values. Calls without an identifier link with nothing and are left out, as are results of
    none. Null and malformed arguments are errors, as are dependencies that no call has, and
    cycles; calls on or behind a cycle have no level or position. Positions count from 1 by level,
    turn and identifier. A null turn is turn 0. Empty inputs give an empty result; other columns
    are ignored, whatever their names.
    """
    missing_columns(calls, "conv_id", "turn", "call_id", "name", "arguments", "depends_on")
    missing_columns(results, "call_id", "turn", "content")
    columns = ["conv_id", "name", "arguments", "depends_on"]
    turn = F.coalesce(q("turn").cast("long"), F.lit(0)).alias("turn")
    one = calls.where(q("call_id").isNotNull()).groupBy(q("call_id").cast("string").alias("call_id")).agg(
        F.min(F.struct(turn, *[q(c) for c in columns])).alias("c")
    ).select("call_id", "c.*")
    answer = results.where(q("call_id").isNotNull()).groupBy(q("call_id").cast("string").alias("call_id")).agg(
        F.min(F.struct(turn, q("content").alias("content"))).alias("r"), F.count(F.lit(1)).alias("n_results")
    ).select("call_id", F.col("r.content").alias("result"), "n_results")
    linked = written(one.join(answer, "call_id", "left"), "calls")
    wanted = linked.select("call_id", F.explode(F.array_distinct("depends_on")).alias("needs")).where("needs is not null")
    known = linked.select(F.col("call_id").alias("needs"))
    edges = written(wanted.join(known, "needs", "left_semi").select("call_id", "needs"), "call-links")
    unknown = wanted.join(known, "needs", "left_anti").groupBy("call_id").agg(F.count(F.lit(1)).alias("unknown"))
    deep = levels(edges).withColumnRenamed("call_id", "_deep")
    held = edges.select(F.col("call_id").alias("_held")).distinct()
    rows = (
        linked.join(held, F.col("call_id") == F.col("_held"), "left")
        .join(deep, F.col("call_id") == F.col("_deep"), "left")
        .join(unknown, "call_id", "left")
        .withColumn("level", F.when(F.col("_held").isNull(), 0).otherwise(F.col("level")))
        .withColumn("parsed", F.try_parse_json("arguments"))
        .withColumn("fields", F.expr("try_variant_get(parsed, '$', 'map<string,variant>')"))
    )
    more = F.array_compact(F.array(
        F.when(F.col("unknown") > 0, "unknown dependency"), F.when(F.col("level").isNull(), "cyclic dependency")
    ))
    errors = F.concat(argument_errors(F.col("name"), F.col("fields"), schemas), more)
    rows = written(
        rows.select(
            "conv_id", "turn", "level", "call_id", "name", F.coalesce("n_results", F.lit(0)).alias("n_results"),
            errors.alias("errors"),
            # fields in the order of their names; absent ones are left out
            F.to_json(F.struct(
                F.when(F.col("fields").isNotNull(), F.col("parsed")).alias("arguments"), F.col("call_id").alias("id"),
                "name", "result",
            )).alias("json"),
        ),
        "calls-checked",
    )
    return _placed(rows).select(
        "conv_id", "position", "level", "call_id", "name", "n_results", "errors", (F.size("errors") == 0).alias("valid"), "json"
    )


def _placed(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("block", F.floor(F.col("turn") / BLOCK))
    group = ["conv_id", "level", "block"]
    sized = rows.where("level is not null").groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("level", "block").rowsBetween(Window.unboundedPreceding, -1)
    before = sized.select(
        F.col("conv_id").alias("_conv"), F.col("level").alias("_level"), F.col("block").alias("_block"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
    )
    inside = Window.partitionBy(*group).orderBy("turn", "call_id")
    ranked = rows.withColumn("inside", F.row_number().over(inside))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("level") == F.col("_level")) & (F.col("block") == F.col("_block"))
    return ranked.join(before, same, "left").withColumn("position", F.col("before") + F.col("inside"))


# --- calls and results derived from plain conversations ------------------------------------------

SCHEMAS: Schemas = {
    "search": {"query": ("string", True), "limit": ("integer", True)},
    "calculate": {"values": ("array", True), "precision": ("integer", False)},
    "translate": {"text": ("string", True), "options": ("object", False)},
}


def calls_of(conversations: DataFrame) -> DataFrame:
    """A call for every assistant turn. Tool and arguments follow from the whole text and
    its length; some lengths give arguments that are cut off, of a wrong type, or for no known
    tool. A turn builds on the call of a quarter of its number, of the same parity."""
    length = F.length(F.coalesce("text", F.lit("")))
    quoted = F.regexp_extract(F.to_json(F.array(F.coalesce("text", F.lit("")))), r"(?s)^\[(.*)\]$", 1)
    kind = F.pmod(length, F.lit(4))
    limit = F.when(length % 7 == 0, F.lit('"ten"')).otherwise(F.pmod(length, F.lit(50)).cast("string"))
    arguments = (
        F.when(kind == 0, F.concat(F.lit('{ "query": '), quoted, F.lit(', "limit": '), limit, F.lit(" }")))
        .when(kind == 1, F.concat(F.lit('{"values":[1, 2.50, '), length.cast("string"), F.lit('], "precision" : '), limit, F.lit("}")))
        .when(kind == 2, F.concat(F.lit('{"text":'), quoted, F.lit(', "options":{"to":"de", "from":"en"}, "id":null}')))
        .otherwise(F.lit("{}"))
    )
    quarter = F.floor(F.col("turn") / 4)
    base = quarter - F.pmod(quarter - F.col("turn"), F.lit(2))
    name = F.element_at(F.array(*map(F.lit, ("search", "calculate", "translate", "browse"))), kind + 1)
    cut = F.when(length % 11 == 0, F.regexp_replace(arguments, r"(?s).$", "")).otherwise(arguments)
    return conversations.where((q("role") == "assistant") & q("conv_id").isNotNull() & q("turn").isNotNull()).select(
        "conv_id", "turn", _identifier(F.col("turn")).alias("call_id"), name.alias("name"), cut.alias("arguments"),
        F.when((base >= 0) & (base != F.col("turn")), F.array(_identifier(base))).alias("depends_on"),
    )


def results_of(conversations: DataFrame) -> DataFrame:
    """The user turn after a call is its result."""
    return conversations.where((q("role") == "user") & q("conv_id").isNotNull() & q("turn").isNotNull()).select(
        _identifier(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content")
    )


def _identifier(turn: Column) -> Column:
    return F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("long").cast("string"))
