"""From raw documents to token ids: the corpus operators in a row.

Each stage works on all that the one before it kept, and returns the columns of ``documents``;
the last returns the ids' digests. Between stages the documents are written as Parquet in the
shared folder, so that a lost executor costs a stage's tasks and no earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from metricloom.llm import bpe_automaton, host_rules, lsh_forest, mixing, site_bayes
from metricloom.llm.common import read_table, written
from metricloom.llm.queries import vocabulary

# The targets of the mix; documents are chosen once at most, so that none comes back twice.
MIX = mixing.Mix(
    weights={"web": 60, "reference": 40, "en": 50, "de": 20, "fr": 20, "es": 10, "src0": 8},
    budget_share=0.9, max_epochs=1,
)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host does."""
    return host_rules.keep_documents(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are likelier good than of low quality or toxic, their site considered."""
    return site_bayes.keep_documents(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by five-word shingles, 80 % alike."""
    return lsh_forest.drop_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf's prefix of the budget, the domains, languages and sources at their weights."""
    return mixing.select_documents(docs, MIX)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the texts decoded from them."""
    encoded = bpe_automaton.encode_texts(docs, vocabulary())
    return bpe_automaton.digests(bpe_automaton.decode_ids(encoded, vocabulary()))


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near-duplicates", near_duplicates),
    ("mixing", mix),
    ("encoding", encode),
]

# Learnt weights and hashed orders of neighbours have no SQL; tests/llm runs it by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
