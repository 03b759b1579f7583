"""Operators on documents: equal to plain Python, whatever the rows look like."""

import hashlib
import itertools
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from metricloom.llm import backoff, bpe_automaton, host_rules, licenses, lsh_forest, mixing, rans, site_bayes
from metricloom.llm.common import written
from metricloom.llm.queries import vocabulary
from metricloom.session import scratch_path

tokenizers = pytest.importorskip("tokenizers")

SENTENCE = "the quick brown fox jumps over the lazy dog while seven old men sit on a wall and sing songs of home to no one"
ROWS = [
    (1, SENTENCE, "en", "src0"), (2, SENTENCE.upper(), "en", "src1"), (3, None, "en", "src1"), (4, "", None, None),
    (5, "  \n\t ", "de", "src1"), (6, "one", "de", "src0"), (7, SENTENCE + " again", "en", "src0"),
    (8, "one two three four five six seven eight nine " * 400, "fr", "src3"), (9, "a\nb\na\n\na", "fr", "src3"),
    (10, "Released under the MIT license.\n" + SENTENCE, "fr", "src3"), (None, SENTENCE, "en", "src0"),
    (7, SENTENCE + " again", "en", "src0"), (12, "x" * 3000, "en", "src0"), (13, "été 漢字 🎉 #1 <|endoftext|> &&&", None, "src0"),
    (14, SENTENCE.replace("dog", "cat"), "en", None), (15, "one", "de", "src0"), (16, "the end the end", "en", "src9"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like the operators' own."""
    frame = spark.createDataFrame(ROWS, SCHEMA)
    clash = ("id", "host", "path", "m", "p", "own", "n", "node", "batch", "whole", "kept", "n_words", "n_tokens", "failed", "u", "v")
    return frame.select("*", *[F.lit("?").alias(c) for c in clash])


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def words(text, lower=False):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)} if lower else {}))


def rows(frame, *names):
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


# --- host rules ---------------------------------------------------------------------------------


def measured(text):
    ws, text = words(text), text or ""
    windows = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if words(x)]
    signs = sum(c in "#*$%&|<>" for c in text)
    return len(ws), sum(map(len, ws)), signs, len(lines) - len(set(lines)), len(repeated)


def test_measures(docs):
    got = rows(host_rules.judge_documents(docs), "doc_id", *host_rules.MEASURES, "base_failed")
    want = []
    for key, text, _, _ in ROWS:
        m = measured(text)
        want.append((key, *m, m[0] < 20 or 100 * m[4] > 30 * m[0]))
    assert got == sorted(want, key=repr)


def test_host_verdicts(spark):
    good, bad = SENTENCE, "too short"
    data = [(i, good if i % 10 else bad, "fine") for i in range(200)] + [(300 + i, bad if i % 10 else good, "poor") for i in range(200)]
    data += [(600, bad, "tiny"), (601, good, "tiny"), (602, good, None)]
    found = {r.doc_id: r for r in host_rules.judge_documents(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert not found[300].kept and not found[300].base_failed and found[1].kept and found[601].kept and found[602].kept
    assert 0.4 < found[601].host_rate < 0.6 and found[602].host_rate is None
    kept = host_rules.keep_documents(spark.createDataFrame(data, "doc_id long, text string, source string"))
    assert {r.doc_id for r in kept.collect()} == {k for k, r in found.items() if r.kept}


# --- licences -----------------------------------------------------------------------------------


def test_licenses(docs, spark):
    found = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert found[10].license == "MIT" and found[10].dice == 1.0 and found[10].matched.startswith("Released")
    assert all(r.license is None for k, r in found.items() if k != 10)
    header = "x\n\nLicensed under the Apache License, Version 2.0 (the\n\"License\"); you may not use this file except\nin compliance with the License.\n\ny"
    one = licenses.scan_licenses(spark.createDataFrame([(1, header)], "doc_id long, text string")).first()
    assert one.license == "Apache-2.0" and one.dice == 1.0 and "\n" in one.matched


PUBLISHED = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0""",
}


def test_licenses_inside_longer_text(spark):
    long = " ".join(f"word{i}" for i in range(3000))
    texts = [f"{long}\n{text} {long}" for text in PUBLISHED.values()]
    texts += [
        "This project is released under the MIT License. See the LICENSE file for details.",
        "Permission is granted to use any copy of the Software, and files of this license.", "MIT License", "mit", "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [r.license for r in licenses.scan_licenses(docs).orderBy("doc_id").collect()]
    assert found == [*PUBLISHED, "MIT", None, None, None, None]
    matched = licenses.scan_licenses(docs).where("doc_id = 3").first()
    assert matched.matched == "released under the mit license" and matched.dice == 1.0


def test_license_windows_against_python(spark):
    rng = random.Random(8)
    templates = [("A", "a b c a d"), ("B", "b c b c d"), ("C", "c a b b a c a")]
    texts = ["\n".join(" ".join(rng.choices("abcd", k=rng.randrange(12))) for _ in range(rng.randrange(4))) for _ in range(150)]

    def windows(text):
        ws = text.split()
        for k, (name, t) in enumerate(templates):
            n, own = len(t.split()), set(licenses.template_bigrams(t))
            for i in range(len(ws) - n + 1):
                a = {f"{x} {y}" for x, y in zip(ws[i:i + n], ws[i + 1:i + n])}
                if f"{ws[i]} {ws[i + 1]}" in own:
                    yield 2 * len(a & own) / (len(a) + len(own)), -k, -i

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = docs.select("doc_id", licenses.best_window(F.col("text"), F.lit(0), templates).alias("m")).collect()
    hits = 0
    for row in got:
        best = max(windows(texts[row.doc_id]), default=(0, 0, 0))
        if best[0] >= 0.8:
            hits += 1
            assert (row.m["dice"], row.m["rank"], row.m["at"]) == pytest.approx(best)
        else:
            assert row.m is None or row.m["dice"] < 0.8
    assert hits > 5


# --- tokens -------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(vocabulary())


def test_automaton_is_the_library(docs, library):
    got = rows(bpe_automaton.digests(bpe_automaton.decode_ids(bpe_automaton.encode_texts(docs, vocabulary()), vocabulary())),
               "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for key, text, _, _ in ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        data = np.array(ids, "<u4").tobytes()
        decoded = library.decode(ids, skip_special_tokens=False).encode()
        want.append((key, len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(decoded).hexdigest()))
    assert got == sorted(want, key=repr)


def test_automaton_on_odd_texts(library):
    coder = bpe_automaton.Coder(bpe_automaton.read_vocabulary(vocabulary()))
    random = np.random.default_rng(3)
    letters = list("aaabbeehtinorsd   \n\n\t'''!!..,,001239éü漢🎉 　\x1c\x85")
    for size in [*range(40)] * 10 + [500, 3000]:
        text = "".join(random.choice(letters, size))
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert coder.decode(coder.encode(text)) == text


def test_automaton_of_small_merges():
    """Against merging by rank, over every word of a small alphabet."""
    merges = [(b"a", b"a"), (b"a", b"b"), (b"aa", b"b"), (b"b", b"ab"), (b"aab", b"ab"), (b"b", b"b")]
    tokens = [b"a", b"b", *[x + y for x, y in merges]]
    ids = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
    automaton = bpe_automaton.MergeAutomaton(merges, ids)
    for size in range(1, 11):
        for letters in itertools.product((b"a", b"b"), repeat=size):
            parts = list(letters)
            for x, y in merges:
                at = 0
                while at + 1 < len(parts):
                    if (parts[at], parts[at + 1]) == (x, y):
                        parts[at : at + 2] = [x + y]
                    at += 1
            assert automaton.encode(b"".join(letters)) == [ids[p] for p in parts]


def test_id_files(docs, spark, library):
    path = scratch_path(spark, "ids")
    rans.write_ids(docs, path, vocabulary(), end_id=0)
    got = [tuple(r) for r in rans.read_ids(spark, path).orderBy("start").select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()]
    start, want = 0, {}
    assert [g[0] for g in got] == sorted((r[0] for r in ROWS), key=lambda k: -1 if k is None else k)
    texts = {k: t for k, t, _, _ in ROWS}
    for key, at, n, crc in got:
        data = np.array([*library.encode(texts[key] or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert (at, n, crc) == (start, len(data) // 4, zlib.crc32(data))
        start += n
    assert want == {}


def test_units_are_handed_to_the_library_in_lines(library, monkeypatch):
    """Any mix of white space, marks and added tokens has the library's ids; new words do not go one by one."""
    with open(vocabulary(), "rb") as file:
        ids = rans.LibraryIds(file.read())
    dice = random.Random(3)
    parts = [*rans.WHITE_CHARS, " ", "\n", "a", "foo.", "Été", "漢字", "🎉", "1", "'s", "<|endoftext|>", "\x1c", "\u200b", "à"]
    texts = ["", *("".join(dice.choices(parts, k=dice.randrange(14))) for _ in range(3000))]
    want = [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(rans, "KEPT_UNITS", 50)
    assert [x for at in range(0, 3001, 500) for x in ids.encode(texts[at : at + 500])] == want
    handed = []
    real = ids._library
    monkeypatch.setattr(ids, "_library", lambda some: handed.extend(some) or real(some))
    words = " ".join(f"x{n}" for n in range(4000))
    assert ids.encode([words]) == [np.array(library.encode(words, add_special_tokens=False).ids, "<u4").tobytes()]
    assert len(handed) <= 8


def test_workers_keep_their_encoder(spark):
    """Tasks of one worker share an encoder, with the units that it knows."""
    with open(vocabulary(), "rb") as file:
        sent = spark.sparkContext.broadcast(rans.Vocabulary(file.read()))

    def learnt(batches):
        for _ in batches:
            pass
        encoder = sent.value.encoder
        yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "known": [len(encoder.units)]})
        encoder.encode(["a word"])

    rows = spark.range(0, 400, 1, 40).mapInArrow(learnt, "pid long, known long").collect()
    assert len({r["pid"] for r in rows}) == sum(r["known"] == 0 for r in rows) < len(rows)


@pytest.mark.parametrize("n", [1, 63, 64, 5000, 300_000])
def test_coder_blocks_and_checkpoints(n):
    ids = np.random.default_rng(n).zipf(1.2, n) % 50_000
    table = rans.Table.unpacked(rans.Table.of(ids).packed())
    block = rans.encode_block(ids, table, lanes=64, every=16)
    slots = rans.slots_of(table)
    assert (rans.decode_block(block, table, slots) == ids).all()
    for k, point in enumerate(block["checkpoints"]):
        assert (rans.decode_block(block, table, slots, k) == ids[point["step"] * block["lanes"] :]).all()
    with pytest.raises(ValueError):
        rans.decode_block(block | {"checksum": block["checksum"] ^ 1}, table, slots)


# --- near-duplicates ----------------------------------------------------------------------------


def components_of(texts, size, percent):
    sets = {}
    for key, text in texts.items():
        ws = words(text, lower=True)
        n = min(size, len(ws))
        sets[key] = {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if ws else set()
    root = {k: k for k in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = root[a], root[b]
            root = {k: min(x, y) if r in (x, y) else r for k, r in root.items()}
    return {k: (len(sets[k]), root[k], root[k] == k) for k in sets}


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, spark, size, percent):
    forest = lsh_forest.Forest(shingle=size, percent=percent)
    want = components_of({k: t for k, t, _, _ in ROWS if k is not None}, size, percent)
    found = lsh_forest.near_duplicates(docs, forest)
    assert {tuple(r) for r in found.where("doc_id is not null").collect()} == {(k, *v) for k, v in want.items()}
    assert found.count() == len(ROWS)
    assert [tuple(r)[2:] for r in found.where("doc_id is null").collect()] == [(None, True)]
    kept = lsh_forest.drop_duplicates(docs, forest)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([k for k, v in want.items() if v[2]] + [None])


def test_groups_of_edited_copies(spark):
    """Chains of edits, many copies, and mere neighbours: components are those of all pairs."""
    random = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = {}
    for group in range(30):
        text = list(random.choice(vocabulary, 90))
        for _ in range(int(random.integers(1, 25))):
            texts[len(texts)] = " ".join(text)
            if random.random() < 0.7:
                text = list(text)
                for _ in range(int(random.integers(1, 4))):
                    text[random.integers(len(text))] = random.choice(vocabulary)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {tuple(r) for r in lsh_forest.near_duplicates(frame, lsh_forest.Forest(shingle=3, percent=85)).collect()}
    assert got == {(k, *v) for k, v in components_of(texts, 3, 85).items()}


@pytest.mark.parametrize("leader_rounds", [lsh_forest.LEADER_ROUNDS, 0])
def test_stars_of_copies(spark, monkeypatch, leader_rounds):
    """Each copy is linked with its original and with hardly any other copy; without leaders the
    comparison of all blocks finds the same."""
    monkeypatch.setattr(lsh_forest, "LEADER_ROUNDS", leader_rounds)
    monkeypatch.setattr(lsh_forest, "BLOCK_NODES", 200)
    random = np.random.default_rng(4)
    texts, want = {}, {}
    for size in (30, 100, 300) if leader_rounds == 0 else (30, 100, 300, 1000, 3000):
        first, text = len(texts), [f"{size}w{i}" for i in random.integers(0, 5000, 302)]
        for copy in range(size + 1):
            own = list(text)
            for place in random.choice(np.arange(2, 300, 4), 7 if copy else 0, replace=False):
                own[place] = f"new{random.integers(1 << 60)}"
            want[len(texts)] = first
            texts[len(texts)] = " ".join(own)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    found = lsh_forest.near_duplicates(frame, lsh_forest.Forest(shingle=3, percent=85)).collect()
    assert {r.doc_id: r.component_id for r in found} == want


# --- language model -----------------------------------------------------------------------------


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff(docs, order):
    model = backoff.Backoff(order=order, batch_bytes=900, bucket_bytes=1500)
    texts = [words(t, lower=True) for _, t, _, _ in ROWS]
    total = sum(map(len, texts))
    count = []
    for ws in texts:
        padded = ["<s>"] * order + ws
        count.append(Counter(tuple(padded[i - k + 1 : i + 1]) for k in range(1, order + 1) for i in range(order - 1, len(padded))))
    every = sum(count, Counter())
    want = []
    for (key, *_), ws, own in zip(ROWS, texts, count, strict=True):
        padded, score = ["<s>"] * order + ws, 0.0
        for i in range(order, len(padded)):
            others = lambda g: every[g] - own[g]  # noqa: E731, B023
            for k in range(order, 0, -1):
                gram = tuple(padded[i - k + 1 : i + 1])
                if others(gram) > 0:
                    below = others(gram[:-1]) if k > 1 else max(1, total - len(ws))
                    score += np.log10(0.4 ** (order - k) * others(gram) / below)
                    break
            else:
                score += np.log10(0.4**order / max(1, total - len(ws)))
        want.append((key, len(ws), round(score, 6) + 0.0))
    got = [(r.doc_id, r.n_words, round(r.score, 6) + 0.0) for r in backoff.score_documents(docs, model).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


# --- mixing -------------------------------------------------------------------------------------


def test_shares_of_leaves_are_a_written_table(spark):
    """What uses the shares reads them: no plan repeats the levels, their windows and their joins."""
    rows = [("web", "en", "src0", 30), ("web", "de", "src2", 20), ("reference", "en", "src1", 50)]
    counted = spark.createDataFrame(rows, "domain string, lang string, source string, n_tokens long")
    found = mixing.leaf_plan(counted, mixing.Mix(weights={"web": 3}, budget=40, max_epochs=1))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and "Exchange" not in plan
    assert sorted((r["domain"], r["lang"], r["share"]) for r in found.collect()) == [("reference", "en", 10), ("web", "de", 15), ("web", "en", 15)]


def test_mixing_keeps_to_shares(docs):
    mix = mixing.Mix(weights={"en": 3}, budget_share=0.5, max_epochs=2, bin_rows=2)
    named = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    found = mixing.mix_documents(named, mix).collect()
    total = sum({k: len(words(t)) for k, t, _, _ in ROWS if k is not None}.values())
    assert total * 0.5 - 20 <= sum(r.taken for r in found) <= total * 0.5
    assert all(0 < r.taken <= r.n_tokens or r.n_tokens == 0 for r in found)
    assert max(Counter((r.doc_id, r.epoch) for r in found).values()) == 1
    once = mixing.Mix(budget_share=1.0, max_epochs=1)
    everything = mixing.select_documents(docs, once)
    assert everything.columns == docs.columns
    assert {r.doc_id for r in everything.collect()} >= {k for k, t, _, _ in ROWS if words(t)}


# --- classifier ---------------------------------------------------------------------------------


def test_classifier_without_labels_keeps_all(docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = site_bayes.classify_documents(docs, labels)
    assert found.count() == len(ROWS) and found.where("not kept or kept is null").count() == 0


def test_classifier_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    table, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    table = table.join(labels.select("doc_id"), "doc_id", "left_semi").repartition(8)
    known = labels.where("doc_id % 3 <> 0").unionByName(spark.createDataFrame([(None, 0, None), (5, None, None)], labels.schema))
    unseen = written(site_bayes.classify_documents(table, known), "test").join(labels.where("doc_id % 3 = 0"), "doc_id")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    n, caught, wrong = unseen.agg(
        F.count_if(bad), F.count_if(bad & ~F.col("kept")), F.count_if(~bad & ~F.col("kept"))
    ).first()
    assert caught >= 0.9 * n and wrong <= 0.02 * unseen.count()


def test_site_posteriors_by_hand(spark):
    """Rates of sites from plain sums; a document does not speak for itself."""
    random = np.random.default_rng(4)
    rows = [(f"h{h}", f"p{random.integers(3)}", float(random.beta(1 + h, 6))) for h in range(5) for _ in range(40)]
    rows += [("alone", "p0", 0.99), (None, None, 0.4), (None, None, 0.2)]
    scored = spark.createDataFrame(rows, "host string, path string, p double")
    sites, mean = site_bayes.site_posteriors(scored)
    first = sites.first()
    k, m = first.host_strength, first.path_strength
    assert mean == pytest.approx(sum(p for *_, p in rows) / len(rows)) and k > 0 and m > 0
    found = site_bayes._combined(scored, sites, mean).collect()
    assert len(found) == len(rows)
    for r in found:
        at_host = [p for h, _, p in rows if h == r.host]
        at_path = [p for h, x, p in rows if (h, x) == (r.host, r.path)]
        assert r.host_rate == pytest.approx((sum(at_host) + mean * k) / (len(at_host) + k))
        host = (sum(at_host) - r.p + mean * k) / (len(at_host) - 1 + k)
        path = (sum(at_path) - r.p + host * m) / (len(at_path) - 1 + m)
        assert r.path_rate == pytest.approx(path)
        odds = r.p / (1 - r.p) * path / (1 - path) * (1 - mean) / mean
        assert r.probability == pytest.approx(odds / (1 + odds))
    [alone] = [r for r in found if r.host == "alone"]
    assert alone.path_rate == pytest.approx(mean) and alone.probability == pytest.approx(0.99)


# --- empty tables -------------------------------------------------------------------------------


def test_empty_tables(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = scratch_path(spark, "ids")
    rans.write_ids(empty, path, vocabulary())
    found = [
        host_rules.judge_documents(empty), host_rules.keep_documents(empty), licenses.scan_licenses(empty),
        bpe_automaton.decode_ids(bpe_automaton.encode_texts(empty, vocabulary()), vocabulary()),
        rans.read_ids(spark, path), lsh_forest.near_duplicates(empty), lsh_forest.drop_duplicates(empty),
        backoff.score_documents(empty), mixing.mix_documents(empty), mixing.select_documents(empty, mixing.Mix(max_epochs=1)),
        site_bayes.classify_documents(empty, labels), site_bayes.keep_documents(empty, labels),
    ]
    assert [f.count() for f in found] == [0] * len(found)


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="text"):
        backoff.score_documents(spark.createDataFrame([(1,)], "doc_id long"))
