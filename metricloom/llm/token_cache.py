"""Token counts by way of a cache keyed by digests.

A text is known by the SHA-256 of its normalised content, a tokenizer by a digest of its file and
library version. Counts already stored are joined to the documents' digests; of what is missing,
each distinct text is encoded once, and its count is appended to the cache.

Only digests are joined to the cache. Texts move once, those that are missing, and copies are
merged before they move. The cache is a folder of Parquet tables, one folder per version and
append: an append is visible as a whole or not at all, appends can run at the same time, and
what two of them have counted alike is merged on reading.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator
from importlib.metadata import version as library_version

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.llm.common import join_copies, missing_columns, q, small_batches, written

TEXTS = 64  # texts encoded at a time
SENT_MISSES = 200_000  # digests of 32 bytes that may be sent to every task
_STORED = "digest binary, n_tokens long"


# --- tokenizers ------------------------------------------------------------------------------


def library_of(vocabulary: str) -> str:
    return "sentencepiece" if vocabulary.endswith(".model") else "tokenizers"


def version_digest(library: str, file: bytes) -> str:
    """What counts depend on besides the text: the file and the library's version."""
    name = f"{library} {library_version(library)} ".encode()
    return hashlib.sha256(name + hashlib.sha256(file).digest()).hexdigest()


class Counter:
    """Counts the tokens of texts as the library does by default, without added tokens."""

    def __init__(self, library: str, file: bytes):
        if library == "sentencepiece":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=file)
            self.encode = lambda texts: model.encode(texts, num_threads=1)
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            import tokenizers

            model = tokenizers.Tokenizer.from_buffer(file)
            model.no_truncation()
            model.no_padding()
            self.encode = lambda texts: model.encode_batch_fast(texts, add_special_tokens=False)

    def count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.encode(texts)]


_COUNTERS: dict[str, Counter] = {}


def _counter(library: str, file: bytes, version: str) -> Counter:
    """The counter of this worker, kept from task to task."""
    if version not in _COUNTERS:
        _COUNTERS[version] = Counter(library, file)
    return _COUNTERS[version]


# --- the cache -------------------------------------------------------------------------------


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) stored for a version, one row per digest; empty where there is no cache."""
    try:
        stored = spark.read.schema(_STORED).parquet(f"{cache}/version={version}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _STORED)
    return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def append_counts(texts: DataFrame, cache: str, vocabulary: str) -> None:
    """Encode (digest, content) rows and add their counts to the cache."""
    spark = texts.sparkSession
    library, content = library_of(vocabulary), _contents(vocabulary)
    version = version_digest(library, content)
    file = spark.sparkContext.broadcast(content)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(library, file.value, version)
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                part = batch.slice(start, TEXTS)
                counts = counter.count(part.column("content").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    with small_batches(spark):
        new = texts.select("digest", "content").mapInArrow(counted, _STORED)
        new.write.parquet(f"{cache}/version={version}/run={uuid.uuid4().hex}")
    file.destroy()


def _contents(vocabulary: str) -> bytes:
    with open(vocabulary, "rb") as file:
        return file.read()


# --- the operator ----------------------------------------------------------------------------


def plain_content(text: Column) -> Column:
    """Null as empty, and bytes that are no UTF-8 replaced; nothing else may change a count."""
    return F.make_valid_utf8(F.coalesce(text, F.lit("")))


def count_tokens(
    docs: DataFrame, vocabulary: str, cache: str, limit: int = 512, key: str = "doc_id", text: str = "text",
    normalise: Callable[[Column], Column] = plain_content,
) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row, and the cache completed on the way.

    ``normalise`` maps a text to the content that is digested and encoded; it must not change the
    tokenizer's count. ``n_bytes`` are the UTF-8 bytes of the text as it stands. A null text is read
    as an empty one and has 0 of both. Rows come back as often as they stand there; keys may be
    null or repeated; other columns are ignored, whatever their names. ``over_limit`` is true
    above ``limit`` tokens.
    """
    missing_columns(docs, key, text)
    spark = docs.sparkSession
    version = version_digest(library_of(vocabulary), _contents(vocabulary))
    content = normalise(q(text).cast("string"))
    digest = F.unhex(F.sha2(content, 256)).alias("digest")
    n_bytes = F.coalesce(F.octet_length(q(text).cast("string")), F.lit(0)).cast("long").alias("n_bytes")
    keyed = written(docs.select(q(key).alias("id"), n_bytes, digest), "digests")
    contents = written(keyed.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")), "contents")
    misses = written(contents.join(read_cache(spark, cache, version), "digest", "left_anti").select("digest"), "misses")
    wanted, known = misses.count(), contents.count()
    if wanted:
        texts = docs.select(digest, content.alias("content"))
        if wanted <= SENT_MISSES and wanted < known:
            texts = texts.join(F.broadcast(misses), "digest", "left_semi")
        # Copies are merged in the tasks that read them, then across tasks.
        texts = texts.groupBy("digest").agg(F.first("content").alias("content"))
        if SENT_MISSES < wanted < known:
            texts = texts.join(misses, "digest", "left_semi")
        append_counts(texts, cache, vocabulary)
    found = contents.join(read_cache(spark, cache, version), "digest")
    counted = join_copies(keyed, found, "digest", "copies", keyed.count())
    return counted.select(
        F.col("id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
