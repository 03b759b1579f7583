"""Token counts against the libraries themselves, with cold, warm and damaged caches."""

import pytest
import public_tokenizers
from pyspark.sql import functions as F

from metricloom.llm import token_cache as tc
from metricloom.llm.queries import QUERIES
from metricloom.session import scratch_path

SF_DIR = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def library_counts(name, texts):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(model.encode(t)) for t in texts]
    import tokenizers

    model = tokenizers.Tokenizer.from_file(path)
    return [len(model.encode(t, add_special_tokens=False).ids) for t in texts]


ODD = ["", None, " ", "\n\n", "a", "<|endoftext|>", "x<|endoftext|> y", "naïve ﬁ Å    日本 🙂", "word " * 40_000, "a" * 3000]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_are_the_libraries(spark, name):
    rows = [(None if n == 3 else n // 2, t, n, "s") for n, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int, copies string")
    got = tc.count_tokens(docs, public_tokenizers.path(name), scratch_path(spark, "cache"), limit=3).collect()
    plain = [t or "" for t in ODD]
    want = [(k[0], len(t.encode()), c, c > 3) for k, t, c in zip(rows, plain, library_counts(name, plain))]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_query_equals_the_library_on_whole_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_token_cache"](spark, SF_DIR).collect()}
    counts = library_counts("byte_bpe_50k.json", [d.text or "" for d in docs])
    assert got == {d.doc_id: (len((d.text or "").encode()), c, c > 512) for d, c in zip(docs, counts)}


def stored(spark, cache):
    return spark.read.parquet(cache).groupBy("run").count().collect()


def test_only_distinct_misses_are_encoded(spark, monkeypatch):
    cache = scratch_path(spark, "cache")
    texts = [f"text number {n % 50}" for n in range(3000)] + ["the same everywhere"] * 2000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    want = dict(enumerate(library_counts("byte_bpe_50k.json", texts)))
    count = lambda some: {r.doc_id: r.n_tokens for r in tc.count_tokens(some, BYTES, cache).collect()}
    assert count(docs) == want
    assert [r["count"] for r in stored(spark, cache)] == [51]
    assert count(docs) == want  # all known: nothing is appended
    assert [r["count"] for r in stored(spark, cache)] == [51]
    more = docs.withColumn("text", F.concat("text", F.when(F.col("doc_id") % 50 < 10, " more").otherwise("")))
    for limit in (200_000, 0):  # few misses are sent to the tasks, many are joined
        monkeypatch.setattr(tc, "SENT_MISSES", limit)
        some = more if limit else more.withColumn("text", F.concat("text", F.when(F.col("doc_id") % 50 < 5, "!").otherwise("")))
        assert count(some) == dict(enumerate(library_counts("byte_bpe_50k.json", [r.text for r in some.orderBy("doc_id").collect()])))
    assert sorted(r["count"] for r in stored(spark, cache)) == [6, 11, 51]


def test_versions_and_repeated_entries(spark):
    cache = scratch_path(spark, "cache")
    docs = spark.createDataFrame([(1, "one two three"), (2, "two")], "doc_id long, text string")
    first = tc.count_tokens(docs, BYTES, cache).collect()
    version = tc.version_digest("tokenizers", tc._contents(BYTES))
    tc.read_cache(spark, cache, version).write.parquet(f"{cache}/version={version}/run=again")
    assert sorted(tc.count_tokens(docs, BYTES, cache).collect()) == sorted(first)
    assert tc.version_digest("tokenizers", b"other") != version != tc.version_digest("sentencepiece", tc._contents(BYTES))
    other = public_tokenizers.path("piece_bpe_32k.model")
    assert {r.doc_id: r.n_tokens for r in tc.count_tokens(docs, other, cache).collect()} == dict(
        zip((1, 2), library_counts("piece_bpe_32k.model", ["one two three", "two"]))
    )


def test_empty_table_and_broken_bytes(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tc.count_tokens(empty, BYTES, scratch_path(spark, "cache")).collect() == []
    broken = spark.range(1).select(F.col("id").alias("doc_id"), F.expr("cast(X'61FF62' AS string)").alias("text"))
    [row] = tc.count_tokens(broken, BYTES, scratch_path(spark, "cache")).collect()
    assert (row.n_bytes, row.n_tokens) == (3, library_counts("byte_bpe_50k.json", ["a�b"])[0])
