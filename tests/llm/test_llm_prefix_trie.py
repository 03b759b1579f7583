"""The trie of rebuilt conversations against plain Python, and subtree sums on awkward trees."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from metricloom.llm import prefix_trie as pt

TURNS = "conv_id long, turn long, role string, text string, place string, depth int, node string"
TREE = "c long, d long, pc long, pd long, n long, w long"


def brute(rows):
    """Nodes by dictionaries of whole prefixes."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            code = hashlib.sha256(f"{len(role.encode())}:{role}:{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0), code, role, text))
    # Turns of one number stand by their digests' hash; the tests only repeat equal ones there.
    texts = {c: [t[2:] for t in sorted(v, key=lambda t: t[0])] for c, v in own.items()}
    members = defaultdict(list)
    for c in sorted(texts):
        h = zlib.crc32(str(c).encode()) % 9
        turns = texts.get(c - c % 5, [])[:h] + texts[c][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append((c, d == len(turns)))
    children = defaultdict(int)
    for key in members:
        if key:
            children[key[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for key in sorted(members, key=len, reverse=True):
        leaves[key] += children[key] == 0
        saved[key] += (len(members[key]) - 1) * (len(key[-1][1].encode()) if key else 0)
        if key:
            leaves[key[:-1]] += leaves[key]
            saved[key[:-1]] += saved[key]
    return sorted(
        (m[0][0], len(k), members[k[:-1]][0][0] if k else -(10**9), len(m), children[k], leaves[k], saved[k],
         hashlib.sha256(",".join(str(c) for c, end in m if end).encode()).hexdigest())
        for k, m in members.items()
    )


def found(spark, rows, **options):
    frame = spark.createDataFrame(rows, TURNS).repartition(6)
    turns, sizes = pt.sequences(frame, **options)
    nodes = pt.prefix_trie(*pt.rebuilt(turns, sizes)).collect()
    return sorted((r[0], r[1], -(10**9) if r[2] is None else r[2], *r[3:]) for r in nodes)


def turn(c, n, text, role="user"):
    return (c, n, role, text, "x", 1, "y")


def test_shared_prefixes_copies_and_nulls(spark):
    rng = random.Random(5)
    rows = []
    for c in range(120):
        rows += [turn(c, n, rng.choice("abé") * rng.randrange(3), rng.choice(["user", "tool"])) for n in range(rng.randrange(1, 14))]
    rows += [turn(c, n, f"same {n}") for c in range(1000, 1400) for n in range(3)]  # equal conversations
    rows += [turn(c, n, "start" if n == 0 else f"{c} {n}") for c in range(2000, 2300) for n in range(2)]  # a node with many children
    rows += [turn(7000, 3, "twice"), turn(7000, 3, "twice"), turn(7000, None, None, None), turn(7001, 1, ""), turn(None, 1, "nobody"),
             turn(-3, 0, "minus"), turn(-5, 0, "base"), turn(9001, 0, "one turn only"), turn(9002, 0, "a" * 50_000)]
    assert found(spark, rows) == brute(rows)


def test_a_conversation_longer_than_its_blocks(spark, monkeypatch):
    monkeypatch.setattr(pt, "LONG_TURNS", 64)
    rows = [turn(c, n, f"{n % 7}") for c in (5, 6, 7) for n in range(900)] + [turn(6, 5000 + n, "tail") for n in range(60)]
    rows += [turn(8, None if n % 2 else n // 4, "equal") for n in range(300)]
    assert found(spark, rows, long_turns=64) == brute(rows)


def test_empty(spark):
    assert found(spark, []) == []
    assert found(spark, [turn(None, 1, "x")]) == []


def shape(kind, count, rng):
    """Parents by number; 0 is the root."""
    if kind == "chain":
        return [None, *range(count - 1)]
    if kind == "star":
        return [None] + [0] * (count - 1)
    if kind == "caterpillar":  # a chain whose every node has a leaf
        return [None] + [n - 1 if n % 2 else max(0, n - 2) for n in range(1, count)]
    return [None] + [rng.randrange(max(0, n - 30), n) for n in range(1, count)]


@pytest.mark.parametrize("kind", ["chain", "star", "caterpillar", "random"])
def test_subtree_sums(spark, kind):
    rng = random.Random(8)
    count = 1500
    parent = shape(kind, count, rng)
    weight = [rng.randrange(-5, 100) for _ in range(count)]
    want, kids = list(weight), [0] * count
    for n in range(count - 1, 0, -1):
        want[parent[n]] += want[n]
        kids[parent[n]] += 1
    rows = [(n % 11, n, None if p is None else p % 11, p, kids[n], weight[n]) for n, p in enumerate(parent)]
    got = pt.subtree_sums(spark.createDataFrame(rows, TREE), ["w"]).collect()
    assert sorted((r.d, r.w) for r in got) == list(enumerate(want))


def test_rounds_do_not_follow_the_depth(spark, monkeypatch):
    rounds = []
    plain = pt._round
    monkeypatch.setattr(pt, "_round", lambda *a: rounds.append(1) or plain(*a))
    rows = [(0, n, 0 if n else None, n - 1 if n else None, int(n < 3999), 1) for n in range(4000)]
    got = pt.subtree_sums(spark.createDataFrame(rows, TREE), ["w"])
    assert got.agg(F.sum("w")).first()[0] == 4000 * 4001 // 2
    assert len(rounds) < 40


def test_ends_of_many_conversations(spark, monkeypatch):
    monkeypatch.setattr(pt, "CHUNK_IDS", 100)
    rows = [turn(c, 0, "only") for c in range(5, 4000, 5)]
    assert found(spark, rows) == brute(rows)
