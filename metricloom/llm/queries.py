"""The named queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm import backoff, bpe_automaton, host_rules, licenses, lsh_forest, mixing, multiprobe, prefix_trie, rans, site_bayes, strassen_negatives, token_cache, tool_calls
from metricloom.llm.common import read_table
from metricloom.session import scratch_path

# The vocabulary that the contracted queries name; the operators take any path.
VOCABULARY = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query("op8_host_rules", host_rules.ORACLE)
def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.judge_documents(read_table(spark, sf_dir, "documents"))
    return judged.withColumn("host_rate", F.round("host_rate", 9) + F.lit(0.0))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@query("op9_bpe_automaton")
def op9_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe_automaton.encode_texts(read_table(spark, sf_dir, "documents"), vocabulary())
    return bpe_automaton.digests(bpe_automaton.decode_ids(encoded, vocabulary()))


@query("op10_rans_ids")
def op10_rans_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    rans.write_ids(read_table(spark, sf_dir, "documents"), path, vocabulary(), end_id=0)
    found = rans.read_ids(spark, path)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


# The targets of the mix: domains 3 to 2, languages by size, the largest source doubled.
MIX = mixing.Mix(
    weights={"web": 60, "reference": 40, "en": 50, "de": 20, "fr": 20, "es": 10, "src0": 2, "src9": 3},
    budget_share=0.7,
)


@query("op2_mixing", mixing.oracle(MIX))
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(read_table(spark, sf_dir, "documents"), MIX)


@query("op5_licenses", licenses.oracle())
def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(read_table(spark, sf_dir, "documents"))
    return found.withColumn("dice", F.round("dice", 9) + F.lit(0.0))


@query("op6_lsh_forest", lsh_forest.oracle(3, 85))
def op6_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = lsh_forest.Forest(shingle=3, percent=85)
    return lsh_forest.near_duplicates(read_table(spark, sf_dir, "documents"), forest)


@query("op4_site_bayes")
def op4_site_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return site_bayes.classify_documents(docs, labels)


@query("op7_backoff", backoff.oracle(backoff.Backoff()))
def op7_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = backoff.score_documents(read_table(spark, sf_dir, "documents"), backoff.Backoff())
    return scored.select(
        "doc_id", "n_words", (F.round("score", 4) + F.lit(0.0)).alias("score"),
        (F.round("mean_score", 6) + F.lit(0.0)).alias("mean_score"),
    )


@query("op1_multiprobe")
def op1_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return multiprobe.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


@query("op3_tool_calls")
def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    return tool_calls.link_calls(tool_calls.calls_of(turns), tool_calls.results_of(turns), tool_calls.SCHEMAS)


@query("op11_token_cache")
def op11_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = scratch_path(spark, "token-counts")
    return token_cache.count_tokens(read_table(spark, sf_dir, "documents"), vocabulary(), cache, limit=512)


@query("op12_prefix_trie", prefix_trie.ORACLE)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, sizes = prefix_trie.sequences(read_table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(*prefix_trie.rebuilt(turns, sizes))


@query("op13_strassen_negatives", strassen_negatives.ORACLE)
def op13_strassen_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strassen_negatives.mine_negatives(read_table(spark, sf_dir, "embeddings"), every=100)
