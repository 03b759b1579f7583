"""Token ids in compressed files: static range asymmetric numeral systems.

A *segment* is a run of whole documents in ascending key order. Its ids share one frequency
table and are cut into blocks. A block is coded by interleaved states, 64 bits each, that
share one stream of 32-bit words; it can be decoded alone, and from each of its checkpoints on,
and carries a checksum of its ids.

Files are Parquet tables with a row per segment, so Spark commits them, on any file system,
and tasks that are lost are simply run again. Texts are shuffled once, by ranges of the key;
each task codes its range in order and keeps one segment in memory. A segment knows its offset
in its range; the ranges' totals, one number for each partition, give the global positions.
"""

from __future__ import annotations

import itertools
import os
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metricloom.llm.bpe_automaton import ROWS, read_vocabulary
from metricloom.llm.common import missing_columns, q

SEGMENT_IDS = 1 << 22
BLOCK_IDS = 1 << 19
LANES = 2048
CHECKPOINT_STEPS = 128
KEPT_UNITS = 1_000_000  # known units from which a worker forgets those not used since it last did
TEXT_BYTES = 1 << 22  # of texts encoded at a time, if it is not a longer one
LINES = 512  # new units in a text for the library
LOW = 31  # states stay in [2**LOW, 2**(LOW + 32))


# --- the coder -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Table:
    """Frequencies that sum to ``2**bits``, with their running sums, by symbol."""

    bits: int
    frequency: np.ndarray
    start: np.ndarray

    @staticmethod
    def of(ids: np.ndarray) -> Table:
        counts = np.bincount(ids).astype(np.int64)
        used = int(np.count_nonzero(counts))
        bits = min(28, max(16, int(used).bit_length() + 4))
        wanted = 1 << bits
        frequency = np.where(counts > 0, np.maximum(1, counts * wanted // max(1, counts.sum())), 0)
        spare = wanted - int(frequency.sum())
        order = np.argsort(-frequency, kind="stable")
        for symbol in order:  # the frequent ones make up the difference
            if spare == 0:
                break
            change = spare if spare > 0 else -min(-spare, int(frequency[symbol]) - 1)
            frequency[symbol] += change
            spare -= change
        return Table.built(bits, frequency)

    @staticmethod
    def built(bits: int, frequency: np.ndarray) -> Table:
        start = np.concatenate([[0], np.cumsum(frequency)[:-1]])
        return Table(bits, frequency.astype(np.uint64), start.astype(np.uint64))

    def packed(self) -> bytes:
        symbols = np.flatnonzero(self.frequency).astype("<u4")
        plain = np.concatenate([[self.bits, len(self.frequency), len(symbols)], np.diff(symbols, prepend=0),
                                self.frequency[symbols]]).astype("<u4")
        return zlib.compress(plain.tobytes())

    @staticmethod
    def unpacked(data: bytes) -> Table:
        plain = np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64)
        bits, size, used = plain[:3]
        frequency = np.zeros(size, np.int64)
        frequency[np.cumsum(plain[3 : 3 + used])] = plain[3 + used :]
        return Table.built(int(bits), frequency)


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = CHECKPOINT_STEPS) -> dict:
    """One block: the last symbols are coded first, so that decoding runs forwards."""
    lanes = max(1, min(lanes, len(ids) // 64))
    bits, top = np.uint64(table.bits), np.uint64(LOW + 32 - table.bits)
    state = np.full(lanes, 1 << LOW, np.uint64)
    steps = -(-len(ids) // lanes)
    chunks, marks, written = [], [], 0
    low, word = np.uint64(0xFFFFFFFF), np.uint64(32)
    for step in range(steps - 1, -1, -1):
        symbols = ids[step * lanes : (step + 1) * lanes]
        x = state[: len(symbols)]
        frequency, start = table.frequency[symbols], table.start[symbols]
        full = x >= frequency << top
        chunk = (x[full] & low).astype("<u4")
        chunks.append(chunk)
        written += len(chunk)
        x[full] >>= word
        whole, rest = np.divmod(x, frequency)
        state[: len(symbols)] = (whole << bits) + rest + start
        if step and step % every == 0:
            marks.append((step, written, state.copy()))
    words = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, "<u4")
    points = [{"step": s, "word": written - at, "states": x.astype("<u8").tobytes()} for s, at, x in reversed(marks)]
    return {
        "n_ids": len(ids), "lanes": lanes, "states": state.astype("<u8").tobytes(), "words": words.tobytes(),
        "checkpoints": points, "checksum": zlib.crc32(ids.astype("<u4").tobytes()),
    }


def decode_block(block: dict, table: Table, slots: np.ndarray, checkpoint: int | None = None) -> np.ndarray:
    """The ids of a block, or those from one of its checkpoints on. ``slots`` is slot -> symbol."""
    lanes, n = block["lanes"], block["n_ids"]
    point = {"step": 0, "word": 0, "states": block["states"]} if checkpoint is None else block["checkpoints"][checkpoint]
    state = np.frombuffer(point["states"], "<u8").astype(np.uint64)
    words = np.frombuffer(block["words"], "<u4").astype(np.uint64)
    at, first = point["word"], point["step"]
    bits, mask, word = np.uint64(table.bits), np.uint64((1 << table.bits) - 1), np.uint64(32)
    least = np.uint64(1 << LOW)
    out = np.empty(n - first * lanes, np.int64)
    for step in range(first, -(-n // lanes)):
        here = min(lanes, n - step * lanes)
        x = state[:here]
        slot = x & mask
        symbols = slots[slot.astype(np.int64)]
        out[(step - first) * lanes : (step - first) * lanes + here] = symbols
        x = table.frequency[symbols] * (x >> bits) + slot - table.start[symbols]
        short = np.flatnonzero(x < least)
        x[short] = (x[short] << word) | words[at : at + len(short)]
        at += len(short)
        state[:here] = x
    if checkpoint is None and zlib.crc32(out.astype("<u4").tobytes()) != block["checksum"]:
        raise ValueError("a block of token ids does not match its checksum")
    return out


def slots_of(table: Table) -> np.ndarray:
    return np.repeat(np.arange(len(table.frequency)), table.frequency.astype(np.int64))


# --- ids from the tokenizers library ---------------------------------------------------------

# White space as the pre-splitting pattern means it: characters of one byte, first bytes of longer ones, and those.
WHITE_CHARS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
LETTER = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
MARK = np.isin(np.arange(256), list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_{|}~"))  # all but the apostrophe, which contractions begin with
LONG_WHITE = [np.frombuffer(c.encode(), np.uint8) for c in WHITE_CHARS if ord(c) > 127]
ONE_BYTE = np.isin(np.arange(256), [ord(c) for c in WHITE_CHARS if ord(c) < 128])
FIRST_BYTE = np.isin(np.arange(256), [c[0] for c in LONG_WHITE])


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the units of texts start, that the pattern never joins to their neighbours; text k is
    ``data[offsets[k]:offsets[k + 1]]`` in UTF-8.

    A unit is a word with the space before it, if there is one, or what is left of a run of white
    space: all but its last character, that character where it is no space, the whole run at a text's end.
    Words are cut between a letter and a mark, where the pattern always cuts them.
    """
    total = len(data)
    at = np.flatnonzero(ONE_BYTE[data])
    size = np.ones(len(at), np.int64)
    first = np.flatnonzero(FIRST_BYTE[data])
    if len(first):
        follow = np.concatenate([data, np.zeros(2, np.uint8)])
        for char in LONG_WHITE:
            found = first[np.all([follow[first + k] == x for k, x in enumerate(char)], axis=0)]
            if len(found):
                at, size = np.concatenate([at, found]), np.concatenate([size, np.full(len(found), len(char))])
        order = np.argsort(at, kind="stable")
        at, size = at[order], size[order]
    edge = np.zeros(total + 1, bool)
    edge[offsets] = True
    after = at + size
    joined = (after[:-1] == at[1:]) & ~edge[after[:-1]]  # with the next white character
    opens = np.concatenate([[True], ~joined])[: len(at)]
    before_word = np.concatenate([~joined, [True]])[: len(at)] & ~edge[after]
    starts = edge
    starts[at[opens | before_word]] = True
    starts[after[before_word & (data[at] != 32)]] = True
    starts[1:total] |= LETTER[data[:-1]] & MARK[data[1:]]
    return np.flatnonzero(starts[:total])


class LibraryIds:
    """Ids of whole texts by the tokenizers library.

    Where the vocabulary splits texts by the byte-level pattern, the library is asked once for
    each distinct unit that the pattern never joins to its neighbours; texts repeat most of
    theirs. The units of many texts are found, numbered and put together as columns; new ones are handed
    to the library in lines. Texts that hold an added token, and all texts of any other
    vocabulary, are handed over whole.
    """

    def __init__(self, file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json
        import re

        from tokenizers import Tokenizer

        data = json.loads(file)
        split = data.get("pre_tokenizer") or {}
        added = [t["content"] for t in data.get("added_tokens", [])]
        self.tokenizer = Tokenizer.from_str(file.decode())
        self.line = self.tokenizer.token_to_id("\u010a")  # the letter of the line break's byte
        self.by_unit = (
            data.get("normalizer") is None and split.get("type") == "ByteLevel"
            and split.get("use_regex", True) and not split.get("add_prefix_space")
            and data.get("truncation") is None and data.get("padding") is None
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in data.get("added_tokens", []))
            and not any("\n" in t for t in added)
            and self._library(["\n"])[0].ids == [self.line]
        )
        self.added = "|".join(map(re.escape, added))
        # known units, and those used since some were last forgotten; unit k has the ids from ends[k] to ends[k + 1]
        self.units = pa.array([], pa.string())
        self.used = np.zeros(0, bool)
        self.ids, self.ends = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text, little-endian unsigned 32-bit integers; no text is null."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not self.by_unit:
            return self._whole(texts)
        if not self.added:
            return self._by_unit(texts)
        whole = pc.match_substring_regex(texts, self.added)
        if not pc.any(whole).as_py():
            return self._by_unit(texts)
        each = {True: iter(self._whole(texts.filter(whole))), False: iter(self._by_unit(texts.filter(pc.invert(whole))))}
        return [next(each[x]) for x in whole.to_pylist()]

    def _whole(self, texts: pa.Array) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self._library(texts.to_pylist())]

    def _by_unit(self, texts: pa.Array) -> list[bytes]:
        if not len(texts):
            return []
        texts.validate(full=True)
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, "<i4")[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        starts = unit_starts(data, offsets)
        if not len(starts):
            return [b""] * len(texts)
        edges = pa.py_buffer(np.append(starts, len(data)).astype("<i4"))
        units = pa.Array.from_buffers(pa.string(), len(starts), [None, edges, pa.py_buffer(data)]).dictionary_encode()
        unit = self._rows(units.dictionary)[units.indices.to_numpy()]
        sizes = np.diff(self.ends)[unit]
        ends = np.append(0, sizes.cumsum())
        # id n of the texts is id n of the units' ids, moved by how far its unit is from its place
        place = np.repeat(self.ends[unit] - ends[:-1], sizes)
        place += np.arange(len(place))
        ids = self.ids[place].tobytes()
        cuts = (4 * ends[np.searchsorted(starts, offsets)]).tolist()
        return [ids[a:b] for a, b in itertools.pairwise(cuts)]

    def _rows(self, units: pa.Array) -> np.ndarray:
        """Where distinct units stand among the known ones; the library is asked for those that do not."""
        if len(self.units) >= KEPT_UNITS:
            keep, sizes = self.used, np.diff(self.ends)
            self.ids, self.ends = self.ids[np.repeat(keep, sizes)], np.append(0, sizes[keep].cumsum())
            self.units, self.used = self.units.filter(pa.array(keep)), np.zeros(keep.sum(), bool)
        found = pc.index_in(units, value_set=self.units)
        rows = found.fill_null(-1).to_numpy().astype(np.int64)
        if found.null_count:
            rows[rows < 0] = len(self.units) + np.arange(found.null_count)
            self._learn(units.filter(found.is_null()))
        self.used[rows] = True
        return rows

    def _learn(self, units: pa.Array) -> None:
        """Words go to the library in lines, for a line break is a word and an id of its own beside
        them; white space goes alone."""
        texts = units.to_pylist()
        white = [u[-1] in WHITE_CHARS for u in texts]
        words = [u for u, alone in zip(texts, white, strict=True) if not alone]
        lines = ["\n".join(words[at : at + LINES]) for at in range(0, len(words), LINES)]
        lone = iter(self._whole(units.filter(pa.array(white, pa.bool_()))))
        word = itertools.chain.from_iterable(self._split(x.ids) for x in self._library(lines))
        found = [next(lone if alone else word) for alone in white]
        self.units = pa.concat_arrays([self.units, units])
        self.used = np.append(self.used, np.zeros(len(units), bool))
        self.ids = np.append(self.ids, np.frombuffer(b"".join(found), "<u4"))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        self.ends = np.append(self.ends, self.ends[-1] + sizes.cumsum())

    def _split(self, ids: list[int]) -> list[bytes]:
        """The ids of the words of a line."""
        line = np.array(ids, "<u4")
        breaks = 4 * np.flatnonzero(line == self.line)
        packed = line.tobytes()
        return [packed[a:b] for a, b in zip([0, *(breaks + 4).tolist()], [*breaks.tolist(), len(packed)], strict=True)]

    def _library(self, texts: list[str]):
        return self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else []


class Vocabulary:
    """A vocabulary file as it is broadcast. The encoder is built where it is first asked for and
    stays there with what it learns: a worker keeps a broadcast from task to task, while functions
    and the module's globals come anew with each task, for this package travels by value."""

    def __init__(self, file: bytes):
        self.file = file

    @cached_property
    def encoder(self) -> LibraryIds:
        return LibraryIds(self.file)


# --- files -----------------------------------------------------------------------------------

_BLOCK = (
    "struct<n_ids: int, lanes: int, states: binary, words: binary, "
    "checkpoints: array<struct<step: int, word: int, states: binary>>, checksum: long>"
)
_BLOCK_ARROW = pa.struct([
    ("n_ids", pa.int32()), ("lanes", pa.int32()), ("states", pa.binary()), ("words", pa.binary()),
    ("checkpoints", pa.list_(pa.struct([("step", pa.int32()), ("word", pa.int32()), ("states", pa.binary())]))),
    ("checksum", pa.int64()),
])


def write_ids(
    docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, key: str = "doc_id", text: str = "text"
) -> None:
    """Encode every text, append ``end_id`` to it, and write the ids in ascending key order.

    Keys are integers; null keys come first, equal ones in the order of a hash of their texts,
    so that even a key held by a third of all rows is spread over ranges. A null text is read
    as an empty one. An empty table gives an empty file. Other columns are ignored.
    """
    missing_columns(docs, key, text)
    sent = docs.sparkSession.sparkContext.broadcast(Vocabulary(read_vocabulary(vocabulary)))
    rows = docs.select(
        q(key).cast("long").alias("id"), F.coalesce(q(text).cast("string"), F.lit("")).alias("text")
    )
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    last = array("I", [end_id]).tobytes()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = sent.value.encoder
        part = TaskContext.get().partitionId()
        keys: list = []
        held: list[bytes] = []
        size = offset = number = 0
        for some in _bounded(batches, 1):
            keys.extend(some.column(0).to_pylist())
            found = [ids + last for ids in encoder.encode(some.column(1))]
            held.extend(found)
            size += sum(map(len, found)) // 4
            if size >= SEGMENT_IDS:
                yield _segment(part, number, offset, keys, held)
                keys, held, offset, number, size = [], [], offset + size, number + 1, 0
        if held:
            yield _segment(part, number, offset, keys, held)

    schema = (
        "part int, segment int, part_offset long, n_ids long, keys array<long>, sizes array<int>, "
        f"frequencies binary, blocks array<{_BLOCK}>"
    )
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(segments, schema).write.option("compression", "uncompressed").parquet(path)


def _bounded(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The same rows, ``TEXT_BYTES`` of their texts at a time."""
    for batch in batches:
        ends = pc.cumulative_sum(pc.cast(pc.binary_length(batch.column(column)), pa.int64())).to_numpy()
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + TEXT_BYTES, "right")))
            yield batch.slice(at, to - at)
            at = to


def _segment(part: int, number: int, offset: int, keys: list, held: list[bytes]) -> pa.RecordBatch:
    ids = np.frombuffer(b"".join(held), "<u4").astype(np.int64)
    table = Table.of(ids)
    blocks = [encode_block(ids[at : at + BLOCK_IDS], table) for at in range(0, len(ids), BLOCK_IDS)]
    columns = {
        "part": pa.array([part], pa.int32()), "segment": pa.array([number], pa.int32()),
        "part_offset": pa.array([offset], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()),
        "keys": pa.array([keys], pa.list_(pa.int64())),
        "sizes": pa.array([[len(h) // 4 for h in held]], pa.list_(pa.int32())),
        "frequencies": pa.array([table.packed()], pa.binary()), "blocks": pa.array([blocks], pa.list_(_BLOCK_ARROW)),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def read_ids(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids) per document; start counts the ids of all documents before it.

    The table of range starts has a row per written partition, which bounds its broadcast.
    """
    stored = spark.read.parquet(path)
    totals = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("base"))
    placed = stored.join(F.broadcast(starts), "part").select(
        (F.col("base") + F.col("part_offset")).alias("start"), "keys", "sizes", "frequencies", "blocks"
    )

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                start, keys, sizes, frequencies, blocks = (c[row].as_py() for c in batch.columns)
                table = Table.unpacked(frequencies)
                slots = slots_of(table)
                ids = np.concatenate([decode_block(b, table, slots) for b in blocks]).astype("<u4")
                ends = np.cumsum(sizes)
                for at in range(0, len(sizes), ROWS):
                    some = slice(at, at + ROWS)
                    cuts = [(int(e - n), int(e)) for e, n in zip(ends[some], sizes[some], strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys[some], pa.int64()), pa.array([start + a for a, _ in cuts], pa.int64()),
                            pa.array([b - a for a, b in cuts], pa.int64()),
                            pa.array([ids[a:b].tobytes() for a, b in cuts], pa.binary()),
                        ],
                        names=["id", "start", "n_tokens", "ids"],
                    )

    found = placed.mapInArrow(documents, "id long, start long, n_tokens long, ids binary")
    return found.select(F.col("id").alias(key), "start", "n_tokens", "ids")
