"""Every stage of the pipeline on what the one before it kept, against plain Python."""

import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from metricloom.llm import host_rules, mixing, site_bayes
from metricloom.llm.common import read_table, written
from metricloom.llm.queries import vocabulary

tokenizers = pytest.importorskip("tokenizers")
SF_DIR = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fails(text):
    ws = words(text)
    windows = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    return len(ws) < 20 or 100 * len(repeated) > 30 * len(ws)


def one_of_each_group(texts):
    sets = {}
    for key, text in texts.items():
        ws = words(text.translate({c: c + 32 for c in range(65, 91)}))
        n = min(5, len(ws))
        sets[key] = {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if ws else set()
    root = {k: k for k in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = root[a], root[b]
            root = {k: min(x, y) if r in (x, y) else r for k, r in root.items()}
    return set(root.values())


@pytest.fixture(scope="module")
def stages(spark):
    """(name, input, output) of each stage; two rows are odd: a null text and a null key."""
    table = read_table(spark, SF_DIR, "documents")
    odd = table.limit(1).select(F.lit(10**6).alias("doc_id"), F.lit(None).cast("string").alias("text"), "lang", "source", "n_chars")
    docs = written(table.unionByName(odd), "test")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        kept = written(stage(spark, docs, SF_DIR), "test")
        out.append((docs, kept))
        docs = kept
    return out


def rows(frame):
    return {r.doc_id: r for r in frame.collect()}


def test_stages_keep_the_columns(stages, spark):
    columns = read_table(spark, SF_DIR, "documents").columns
    assert all(kept.columns == columns for _, kept in stages[:-1])
    for docs, kept in stages[:-1]:
        before, after = rows(docs), rows(kept)
        assert all(before[k] == r for k, r in after.items()) and len(after) == kept.count()


def test_quality_rules(stages):
    docs, kept = stages[0]
    before, after = rows(docs), rows(kept)
    judged = {r.doc_id: r for r in host_rules.judge_documents(docs).collect()}
    good = {k for k, r in before.items() if not fails(r.text)}
    assert good == {k for k, r in judged.items() if not r.base_failed}
    assert set(after) == {k for k, r in judged.items() if r.kept} <= good
    # a host is rejected as a whole, and only with most of its documents failing
    failed = Counter(r.source for k, r in before.items() if k not in good)
    total = Counter(r.source for r in before.values())
    gone = {before[k].source for k in good - set(after)}
    assert all(2 * failed[s] > total[s] for s in gone) and not any(r.source in gone for r in after.values())


def test_quality_classifier(stages, spark):
    docs, kept = stages[1]
    judged = site_bayes.classify_documents(docs, read_table(spark, SF_DIR, "labels"))
    assert set(rows(kept)) == {r.doc_id for r in judged.where("kept").collect()}


def test_near_duplicates(stages):
    before, after = (rows(f) for f in stages[2])
    assert set(after) == one_of_each_group({k: r.text for k, r in before.items()})


def test_mix(stages):
    """A prefix of each leaf in the seeded order, up to the leaf's share."""
    docs, kept = stages[3]
    before, after = rows(docs), rows(kept)
    size = {k: len(words(r.text)) for k, r in before.items()}
    assert sum(size[k] for k in after) >= corpus_pipeline.MIX.budget_share * sum(size.values()) - 100
    chosen = rows(mixing.mix_documents(docs, corpus_pipeline.MIX))
    assert set(after) == set(chosen)
    leaves = {}
    for k, r in before.items():
        leaves.setdefault((r.lang, r.source), []).append(k)
    for keys in leaves.values():
        place = lambda k: (hashlib.md5(f"{corpus_pipeline.MIX.seed}:0:{k}".encode()).hexdigest()[:15], k)
        order = sorted(keys, key=place)
        taken = [k in after for k in order]
        assert taken == sorted(taken, reverse=True)


def test_encoding(stages):
    docs, found = stages[4]
    library = tokenizers.Tokenizer.from_file(vocabulary())
    want = {}
    for k, r in rows(docs).items():
        ids = library.encode(r.text, add_special_tokens=False).ids
        want[k] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
    assert {k: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for k, r in rows(found).items()} == want
