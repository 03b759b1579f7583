"""Queries written as search bodies, and areas of several classes, against plain Python."""

import copy
import json
import random
from datetime import datetime, timedelta

import pytest

from metricloom.learning.evaluate import roc_auc_ovr
from metricloom.operators.buckets import BucketQuery, run_bucket_query

BODY = {
    "query": {
        "filtered": {
            "query": {"query_string": {"query": 'kind:"load" AND host:"a b"'}},
            "filter": {"bool": {"must": [{"range": {"ts": {"gte": 60_000, "lte": 300_000}}}], "must_not": []}},
        }
    },
    "aggs": {
        "2": {
            "date_histogram": {"field": "ts", "interval": "1m", "min_doc_count": 0, "extended_bounds": {"min": 0, "max": 360_000}},
            "aggs": {"1": {"avg": {"field": "x"}}, "3": {"avg": {"field": "y"}}},
        }
    },
}


def changed(*path_and_value):
    *path, value = path_and_value
    body = copy.deepcopy(BODY)
    at = body
    for step in path[:-1]:
        at = at[step]
    at[path[-1]] = value
    return json.dumps(body)


def test_body_is_read():
    query = BucketQuery.from_json(json.dumps(BODY))
    assert query == BucketQuery(60, ["x", "y"], {"kind": "load", "host": "a b"}, 60.0, 300.0, (), "ts", (0.0, 360.0))
    must = ("query", "filtered", "filter", "bool", "must")
    recent = BucketQuery.from_json(changed(*must, [{"range": {"ts": {"gte": "now-2h", "lte": "now"}}}]), 10_000.0)
    assert (recent.gte, recent.lte) == (2800.0, 10_000.0)
    assert BucketQuery.from_json(changed(*must, [])).gte is None
    assert BucketQuery.from_json(changed("aggs", "2", "date_histogram", "min_doc_count", 1)).bounds is None


@pytest.mark.parametrize(
    "body",
    [
        changed("query", "filtered", "query", "query_string", "query", 'kind:"load" OR host:"a"'),
        changed("query", "filtered", "filter", "bool", "must", [{"range": {"ts": {"gte": "now-2h"}}}]),
        changed("query", "filtered", "filter", "bool", "must", [{"range": {"other": {"gte": 1}}}]),
        changed("query", "filtered", "filter", "bool", "must_not", [{"term": {"kind": "x"}}]),
        changed("aggs", {**BODY["aggs"], "4": BODY["aggs"]["2"]}),
        changed("aggs", "2", "date_histogram", "interval", "soon"),
    ],
)
def test_what_has_no_meaning_is_an_error(body):
    with pytest.raises(ValueError):
        BucketQuery.from_json(body)


def test_body_runs_with_empty_buckets(spark):
    start = datetime(1970, 1, 1)
    rows = [
        (start + timedelta(seconds=s), kind, host, x, y)
        for s, kind, host, x, y in [
            (59, "load", "a b", 9.0, 9.0), (60, "load", "a b", 1.0, None), (119, "load", "a b", 3.0, None),
            (200, "load", "a", 7.0, 7.0), (200, "memory", "a b", 7.0, 7.0), (300, "load", "a b", 5.0, 2.0),
            (301, "load", "a b", 8.0, 8.0),
        ]
    ]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, kind string, host string, x double, y double")
    got = run_bucket_query(df, BucketQuery.from_json(json.dumps(BODY)))
    found = {r["key"]: (r["x"], r["y"]) for r in got.collect()}
    none = (None, None)
    assert found == {0: none, 60: (2.0, None), 120: none, 180: none, 240: none, 300: (5.0, 2.0), 360: none}


def test_areas_of_classes_with_ties_and_missing_values(spark):
    rng = random.Random(4)
    rows = [
        (rng.choice(["a", "b", "c", None]), *[rng.choice([None, 0.1, 0.2, 0.5, 0.5, 0.9]) for _ in range(3)])
        for _ in range(400)
    ]
    df = spark.createDataFrame(rows, "label string, pa double, pb double, pc double")
    total = 0.0
    for i, name in enumerate("abc", start=1):
        own = [r[i] for r in rows if r[0] == name and r[i] is not None]
        others = [r[i] for r in rows if r[0] not in (name, None) and r[i] is not None]
        wins = sum((x > y) + (x == y) / 2 for x in own for y in others)
        total += wins / len(own) / len(others) * sum(r[0] == name for r in rows)
    got = roc_auc_ovr(df, "label", {"a": "pa", "b": "pb", "c": "pc"}).first()[0]
    assert got == pytest.approx(total / sum(r[0] is not None for r in rows))
