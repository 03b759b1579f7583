"""Nearest neighbours and tool calls: equal to plain Python, whatever the rows look like."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.llm import multiprobe, tool_calls
from metricloom.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"


def best(vectors, queries, k):
    found = {}
    for name, point in queries.items():
        scores = {}
        for other, x in vectors.items():
            if other != name:
                scores[other] = sum(a * b for a, b in zip(point, x, strict=True))
        found[name] = sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:k]
    return found


def test_recall_and_scores(spark):
    table = {r.vec_id: [float(x) for x in r.embedding] for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()}
    want = best(table, {k: v for k, v in table.items() if k % 20 == 0}, 20)
    got = {}
    for r in QUERIES["op1_multiprobe"](spark, SF_DIR).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert set(got) == set(want) and hits >= 0.93 * sum(map(len, want.values()))
    for q, some in got.items():
        assert all(abs(s - sum(a * b for a, b in zip(table[q], table[i], strict=True))) < 1e-12 for i, s in some)
        assert some == sorted(some, key=lambda x: (-x[1], x[0]))


def test_odd_vectors_copies_and_ties(spark):
    random = np.random.default_rng(2)
    same = [float(x) for x in random.normal(size=8)]
    data = [(i, [float(x) for x in random.normal(size=8)]) for i in range(60)] + [(100 + i, same) for i in range(3000)]
    odd = [(5000, None), (5001, [0.0] * 8), (5002, [1.0, None] + [0.0] * 6), (5003, [float("nan")] * 8),
           (5004, [float("inf")] * 8), (5005, [1.0, 2.0]), (None, same), (100, same)]
    frame = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>").select(
        "*", F.lit(1).alias("id"), F.lit(2).alias("table"), F.lit(3).alias("task")
    )
    asked = frame.where("vec_id in (0, 1, 2, 100, 101, 3000, 5001, 5003)")
    model = multiprobe.Multiprobe(probes=400, block_rows=64, group_rows=300)
    got = {}
    for r in multiprobe.nearest(frame, asked, 5, model).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = best(dict(data), {k: v for k, v in data if k in (0, 1, 2, 100, 101, 3000)}, 5)
    assert {q: [i for i, _ in s] for q, s in got.items()} == {q: [i for i, _ in s] for q, s in want.items()}
    assert multiprobe.nearest(frame.where("false"), asked).count() == 0
    assert multiprobe.nearest(frame, asked.where("false")).count() == 0
    few = frame.where("vec_id < 4")
    assert multiprobe.nearest(few, few, 20, model).groupBy("query_id").count().where("count = 3").count() == 4


@pytest.mark.parametrize("lengths", ["outlier", "lognormal"])
def test_recall_with_uneven_lengths(spark, lengths):
    """Neither one long vector nor uneven lengths cost recall, nor do parts of few queries."""
    random = np.random.default_rng(6)
    points = random.normal(size=(4000, 24))
    points /= np.linalg.norm(points, axis=1)[:, None]
    points *= random.lognormal(0, 0.5, 4000)[:, None] if lengths == "lognormal" else np.where(np.arange(4000) == 7, 3.0, 1.0)[:, None]
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(points)], "vec_id long, embedding array<double>")
    model = multiprobe.Multiprobe(block_rows=256, query_rows=50)
    got = {}
    for r in multiprobe.nearest(frame, frame.where("vec_id % 20 = 0"), 20, model).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for i in range(0, 4000, 20):
        scores = points @ points[i]
        scores[i] = -np.inf
        hits += len(got[i] & set(np.argsort(-scores)[:20].tolist()))
    assert hits >= 0.9 * 20 * 200


def test_perturbations_come_likeliest_first():
    sets = multiprobe.perturbations(4, 81)
    assert sets[0] == () and len(set(sets)) == len(sets) == 81  # every cell next to one of 4 dimensions
    assert all(len({min(p, 7 - p) for p in s}) == len(s) for s in sets)


SCHEMAS = {"f": {"a": ("integer", True), "b": ("string", False)}, "g": {}}
CALLS = [
    (1, 1, "x", "f", '{"b":"é\\n","a":1}', None), (1, 2, "y", "f", '{"a":1.5}', ["x"]), (1, 3, "z", "g", "{}", ["y", "x", None]),
    (1, 3, "z", "g", "{}", ["y", "x", None]), (1, 9, "x", "g", "later", None), (1, 4, "c1", "g", "[1]", ["c2"]),
    (1, 5, "c2", "g", '{"k":1}', ["c1"]), (1, 6, "after", "g", "{}", ["c2"]), (1, 0, "lost", "h", "{}", ["nowhere"]),
    (None, None, "n", None, None, []), (2, 1, None, "f", "{}", None), (2, 7, "last", "f", "{", ["n", "z"]),
    (2, 2, "self", "g", "{}", ["self"]),
]
RESULTS = [("x", 2, "second"), ("x", 1, "first"), ("y", 1, None), (None, 1, "none"), ("other", 1, "o"), ("z", 1, 'q"')]


def test_calls(spark):
    calls = spark.createDataFrame(CALLS, "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame(RESULTS, "call_id string, turn long, content string")
    calls = calls.select("*", *[F.lit(0).alias(c) for c in ("level", "position", "block", "parsed", "fields", "result", "needs")])
    found = {r.call_id: r for r in tool_calls.link_calls(calls, results, SCHEMAS).collect()}
    assert {k: (r.conv_id, r.level, r.position, r.errors) for k, r in found.items()} == {
        "lost": (1, 0, 1, ["unknown tool", "unknown dependency"]), "x": (1, 0, 2, []), "y": (1, 1, 3, ["type: a"]),
        "z": (1, 2, 4, []), "c1": (1, None, None, ["malformed arguments", "cyclic dependency"]),
        "c2": (1, None, None, ["unexpected: k", "cyclic dependency"]), "after": (1, None, None, ["cyclic dependency"]),
        "n": (None, 0, 1, ["unknown tool"]), "last": (2, 3, 1, ["malformed arguments"]),
        "self": (2, None, None, ["cyclic dependency"]),
    }
    assert found["x"].json == '{"arguments":{"a":1,"b":"é\\n"},"id":"x","name":"f","result":"first"}'
    assert found["z"].json == '{"arguments":{},"id":"z","name":"g","result":"q\\""}' and found["x"].n_results == 2
    assert tool_calls.link_calls(calls.where("false"), results, SCHEMAS).count() == 0
    assert tool_calls.link_calls(calls, results.where("false"), SCHEMAS).count() == len(found)


def test_whole_conversations(spark):
    """Every assistant turn is a call; its order, validity and result follow from the turns."""
    turns = spark.read.parquet(f"{SF_DIR}/conversations.parquet").collect()
    text = {(r.conv_id, r.turn): r.text for r in turns}
    role = {(r.conv_id, r.turn): r.role for r in turns}
    found = QUERIES["op3_tool_calls"](spark, SF_DIR).collect()
    assert {r.call_id for r in found} == {f"call_{c}_{t}" for (c, t), x in role.items() if x == "assistant"}
    level = {r.call_id: r.level for r in found}
    for r in found:
        conv, turn = map(int, r.call_id.split("_")[1:])
        data = json.loads(r.json)
        assert data.get("result") == (text[conv, turn + 1] if role.get((conv, turn + 1)) == "user" else None)
        assert list(data) == sorted(data) and r.json == json.dumps(data, ensure_ascii=False, separators=(",", ":"), sort_keys=True)
        base = turn // 4 - (turn // 4 - turn) % 2
        parent = f"call_{conv}_{base}"
        assert r.level == (level[parent] + 1 if base >= 0 and base != turn and parent in level else 0)
        assert r.valid == (not r.errors)
    for conv in {r.conv_id for r in found}:
        mine = sorted((r for r in found if r.conv_id == conv), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(1, len(mine) + 1))
        assert [(r.level, int(r.call_id.split("_")[2])) for r in mine] == sorted((r.level, int(r.call_id.split("_")[2])) for r in mine)


def test_calls_have_whole_texts(spark):
    """Search and translation take the text of the turn as it is, however long."""
    texts = ["one two  three\nfour \"five\" six\tséven eight " * 50 + "x" * n for n in range(12)]
    turns = spark.createDataFrame([(1, n, "assistant", t) for n, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    rows = tool_calls.link_calls(tool_calls.calls_of(turns), tool_calls.results_of(turns), tool_calls.SCHEMAS).collect()
    got = {int(r.call_id.split("_")[2]): json.loads(r.json).get("arguments") or {} for r in rows if "malformed arguments" not in r.errors}
    asked = {n: a.get("query", a.get("text")) for n, a in got.items() if len(texts[n]) % 4 in (0, 2)}
    assert asked and asked == {n: texts[n] for n in asked}
