"""Hard negatives: products, heaps and the whole operator against plain Python."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from metricloom.llm import strassen_negatives as sn

ROWS = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())),
    T.StructField("label", T.IntegerType()), T.StructField("x", T.StringType()), T.StructField("score", T.StringType()),
])


@given(st.integers(0, 40), st.integers(0, 40), st.integers(0, 40), st.integers(1, 9), st.integers(0, 2**32 - 1))
@settings(max_examples=60, deadline=None)
def test_products_are_exact_even_where_sums_wrap(m, k, n, leaf, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-(2**62), 2**62, (m, k)), rng.integers(-(2**62), 2**62, (k, n))
    assert (sn.strassen(a, b, leaf) == a @ b).all()


def test_window_bounds_are_those_of_whole_numbers():
    scores = np.array([0, 1, 4, 5, 99, 100, 101, 12345, -1, -5, -99, -100, -12345, 2**61, -(2**61)])
    low, high = sn.Mining().window(scores)
    for s, a, b in zip(scores.tolist(), low.tolist(), high.tolist()):
        assert a == math.ceil(80 * s / 100) if abs(s) < 10**6 else a == -(-80 * s // 100)
        assert b == s


def test_heaps_merge_in_any_order():
    rng = random.Random(3)
    entries = [(rng.randrange(4), rng.randrange(12), i) for i in range(400)]
    want = [sorted((-s, i) for r, s, i in entries if r == row)[:5] for row in range(4)]
    for _ in range(5):
        rng.shuffle(entries)
        heaps = sn.Heaps(4, 5)
        for start in range(0, 400, 37):
            part = entries[start : start + 37]
            heaps.add(*(np.array([e[c] for e in part]) for c in range(3)))
        got = [[(-s, i) for r, s, i in zip(heaps.rows, heaps.scores, heaps.ids) if r == row] for row in range(4)]
        assert got == want


def brute(rows, every, mining=sn.Mining()):
    """Rows by plain loops; of the rows of one key the smallest (label, vector) counts."""
    taken = {}
    for vec_id, vector, label, *_ in rows:
        if vec_id is None or vector is None or label is None or any(v is None or not math.isfinite(v) for v in vector):
            continue
        row = ((label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(mining.scale * v) for v in vector])
        taken[vec_id] = min(taken.get(vec_id, row), row)
    found = []
    for a, (label, x) in taken.items():
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, other) for i, (other, y) in taken.items() if i != a)
        for minus, positive, _ in [s for s in scored if s[2] == label][: mining.positives]:
            fits = [(-s, i) for s, i, other in scored if other != label and mining.low * -minus <= -100 * s <= mining.high * -minus]
            found += [(a, positive, n, i, -minus, s) for n, (s, i) in enumerate(fits[: mining.negatives], 1)]
    return sorted(found)


def sample(count, seed, width=12, labels=3):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0.2, 1) for _ in range(width)], rng.randrange(labels), "x", "s") for i in range(count)]
    rows += rows[:9]  # repeated rows
    rows += [(i + 10_000, rows[i % 3][1], i % labels, None, None) for i in range(40)]  # copies: ties of score
    return rows


@pytest.mark.parametrize("cell_rows", [4096, 50])
def test_equals_brute_force(spark, cell_rows):
    rows = sample(400, 1)
    rows += [
        (20_000, None, 1, None, None), (20_100, [1.0, None], 1, None, None), (20_200, [math.nan] * 12, 1, None, None),
        (20_300, [math.inf] * 12, 1, None, None), (20_400, [0.5] * 12, None, None, None), (None, [9.0] * 12, 1, None, None),
        (20_500, [], 1, None, None), (20_600, [3.0, 2.0], 2, None, None), (20_700, [1.0] * 30, 0, None, None),
        (100, [5.0] * 12, 9, None, None), (-100, [0.7] * 12, 1, None, None),
    ]
    frame = spark.createDataFrame(rows, ROWS).repartition(5)
    got = sn.mine_negatives(frame, every=20, mining=sn.Mining(cell_rows=cell_rows))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 20)


def test_one_label_ties_and_empty(spark):
    same = [(i, [1.0, 2.0], i // 150, None, None) for i in range(300)]  # all scores equal
    frame = spark.createDataFrame(same, ROWS)
    assert sorted(tuple(r) for r in sn.mine_negatives(frame).collect()) == brute(same, 100)
    assert sn.mine_negatives(spark.createDataFrame([], ROWS)).collect() == []
    assert sn.mine_negatives(spark.createDataFrame([(1, [1.0], 1, None, None)], ROWS)).collect() == []


def test_scores_that_fit_no_long_are_an_error(spark):
    frame = spark.createDataFrame([(100, [1e30], 1, None, None)], ROWS)
    with pytest.raises(Exception, match="too long for scores"):
        sn.mine_negatives(frame).collect()
