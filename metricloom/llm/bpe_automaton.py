"""Byte-pair encoding by a deterministic automaton over tokens, and decoding by its labels.

The automaton is built from the merges, one gadget after another. It starts with one state and
an arc for every byte. The gadget of a merge (a, b) -> c, at time m, redirects every arc a to a
copy of its target without the arc b, and lays an arc c beside each arc a whose target had b.
An arc's target depends on its label alone, so a state is "after token t". The sequences of
arcs the final automaton accepts are exactly the canonical encodings, one for each text.

States are immutable and share their history: the state after a token is a *lane* of removals,
(token, removed label) -> time, that starts from the state its last part had when the token was
made. A label made later than a removal is allowed where its first part is. Resolved arcs are
kept in a transition table.

A pre-split word is encoded from left to right: at each position one token on one path ends,
found by the transition table from the states reached before. The path is read back from the
end. Texts are mapped in place, without any shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricloom.llm.common import missing_columns, q

# White space as the pre-splitting pattern means it (the Unicode property).
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed value: the pre-splitting pattern of byte-level vocabularies.
PRESPLIT = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+"
    rf"|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)
# A coarser split that never cuts a word of the finer one.
UNITS = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

ROWS = 64  # rows turned at a time; bounds the memory of a task
KEPT_UNITS = 300_000  # entries in each generation that a worker keeps
KEPT_ARCS = 600_000
KEPT_STEPS = 600_000


class MergeAutomaton:
    """The automaton of one vocabulary."""

    def __init__(self, merges: list[tuple[bytes, bytes]], ids: dict[bytes, int]):
        self.ids = ids
        self.spelling = {i: b for b, i in ids.items()}
        self.width = max(self.spelling) + 1
        self.made = dict.fromkeys(self.spelling, -1)
        self.first: dict[int, int] = {}
        self.last: dict[int, int] = {}
        self.removed: dict[int, int] = {}
        self.table: dict[int, bool] = {}
        for time, (a, b) in enumerate(merges):
            self._gadget(time, ids[a], ids[b], ids[a + b])
        self._spell()

    def _gadget(self, time: int, a: int, b: int, c: int) -> None:
        if c not in self.first and self.made[c] < 0:
            # the arc c leads where b led so far: lane b, cut off at this time
            self.made[c], self.first[c], self.last[c] = time, a, b
        self.removed.setdefault(a * self.width + b, time)

    def _spell(self) -> None:
        """The matching table: a state per prefix of a token; with each, the tokens that end there."""
        step: dict[int, int] = {}
        own: list[int] = [-1]
        for token, label in self.ids.items():
            at = 0
            for byte in token:
                key = at << 8 | byte
                if key not in step:
                    step[key] = len(own)
                    own.append(-1)
                at = step[key]
            own[at] = label
        children: dict[int, list[int]] = {}
        for key in step:
            children.setdefault(key >> 8, []).append(key)
        self.ending: list[tuple[int, ...]] = [()] * len(own)
        self.shorter = shorter = [0] * len(own)
        level = [0]
        while level:
            below = []
            for at in level:
                for key in children.get(at, ()):
                    to, back = step[key], shorter[at]
                    if at:
                        while back and (back << 8 | key & 255) not in step:
                            back = shorter[back]
                        shorter[to] = step.get(back << 8 | key & 255, 0)
                    tail = self.ending[shorter[to]]
                    self.ending[to] = (own[to], *tail) if own[to] >= 0 else tail
                    below.append(to)
            level = below
        self.step = step
        self.size = {i: len(b) for i, b in self.spelling.items()}

    def allows(self, before: int, label: int) -> bool:
        """Whether the state after ``before`` has an arc ``label``: walks both histories."""
        removed, made, first, width = self.removed, self.made, self.first, self.width
        lane, until = before, len(made) * 2
        x, later = label, until
        while True:
            while made[x] >= until:
                later, x = made[x], first[x]
            while True:
                time = removed.get(lane * width + x)
                if time is not None and made[x] < time <= later and made[lane] < time < until:
                    return False
                if made[x] <= made[lane] or made[x] < 0:
                    break
                later, x = made[x], first[x]
            if made[lane] < 0:
                return True
            until, lane = made[lane], self.last[lane]

    def encode(self, word: bytes) -> list[int]:
        """The labels of the one path that spells ``word``."""
        step, shorter, ending, size = self.step, self.shorter, self.ending, self.size
        table, width = self.table, self.width
        ends = [-1]
        at, end = 0, 0
        for byte in word:
            end += 1
            key = at << 8 | byte
            to = step.get(key)
            if to is None:  # follow shorter endings, then remember the transition
                back = at
                while to is None and back:
                    back = shorter[back]
                    to = step.get(back << 8 | byte)
                to = to or 0
                if len(step) < KEPT_STEPS:
                    step[key] = to
            at = to
            for label in ending[at]:
                start = end - size[label]
                if start:
                    arc = ends[start] * width + label
                    known = table.get(arc)
                    if known is None:
                        if len(table) >= KEPT_ARCS:
                            table.clear()
                        known = table[arc] = self.allows(ends[start], label)
                    if not known:
                        continue
                ends.append(label)
                break
        found = []
        while end:
            label = ends[end]
            found.append(label)
            end -= size[label]
        found.reverse()
        return found


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabulary files: printable ones for
    themselves, the others from 256 on in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


def spellings(data: dict) -> dict[bytes, int]:
    """The tokens of a vocabulary file as bytes, with their ids."""
    letters = byte_letters()
    return {bytes(letters[x] for x in token): i for token, i in data["model"]["vocab"].items()}


class Coder:
    """Encodes whole texts; built from the contents of a vocabulary file."""

    def __init__(self, file: bytes):
        self.file = file
        data = json.loads(file)
        letters = byte_letters()
        spelled = lambda token: bytes(letters[x] for x in token)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in data["model"]["merges"]]
        self.automaton = MergeAutomaton([(spelled(a), spelled(b)) for a, b in pairs], spellings(data))
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.cut = re.compile("|".join(f"({re.escape(t)})" for t in sorted(self.special, key=len, reverse=True)) or "(?!)")
        self.units = Recent(self._unit)

    def _piece(self, word: str) -> bytes:
        return np.array(self.automaton.encode(word.encode()), "<u4").tobytes()

    def _unit(self, unit: str) -> bytes:
        """A word of the pattern is a unit of its own and is remembered as one."""
        words = PRESPLIT.findall(unit)
        return self._piece(unit) if len(words) == 1 else b"".join([self.units[word] for word in words])

    def encode(self, text: str) -> bytes:
        """The ids of a text, little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        look = self.units.__getitem__
        at = 0
        for special in self.cut.finditer(text):
            out.extend(map(look, UNITS.findall(text, at, special.start()) if at < special.start() else ()))
            out.append(self.special[special.group()].to_bytes(4, "little"))
            at = special.end()
        out.extend(map(look, UNITS.findall(text[at:] if at else text)))
        return b"".join(out)

    @cached_property
    def labels(self) -> Labels:
        return Labels(self.file)

    def decode(self, ids: bytes) -> str:
        return self.labels.decode(ids)


class Labels:
    """Decodes ids by emitting labels: all labels in a row, and where each starts and ends."""

    def __init__(self, file: bytes):
        data = json.loads(file)
        labels = {i: b for b, i in spellings(data).items()}
        labels |= {t["id"]: t["content"].encode() for t in data.get("added_tokens", [])}
        row = [labels.get(i, b"") for i in range(max(labels) + 1)]
        self.bytes = np.frombuffer(b"".join(row), np.uint8)
        self.size = np.array([len(x) for x in row])
        self.start = self.size.cumsum() - self.size
        self.known = np.array([i in labels for i in range(len(row))])

    def decode(self, ids: bytes) -> str:
        """The labels of the ids in a row; bytes that are no UTF-8 become replacement marks."""
        arcs = np.frombuffer(ids, "<u4")
        if len(arcs) and (arcs.max() >= len(self.size) or not self.known[arcs].all()):
            raise KeyError("an id of no token")
        size = self.size[arcs]
        # Byte n of the text is byte n of the labels, moved by how far its label is from its place.
        place = np.repeat(self.start[arcs] - (size.cumsum() - size), size) + np.arange(size.sum())
        return self.bytes[place].tobytes().decode("utf-8", "replace")


class Recent(dict):
    """What a worker has computed lately, by key: two generations of at most ``limit`` each."""

    def __init__(self, compute, limit: int = KEPT_UNITS):
        super().__init__()
        self.compute, self.limit = compute, limit
        self.old: dict = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value


_KEPT: dict[tuple[type, int], object] = {}


def _kept(kind: type, file: bytes):
    """The coder of this worker; kept, with what it has learnt, from task to task."""
    key = kind, hash(file)
    if key not in _KEPT:
        _KEPT[key] = kind(file)
    return _KEPT[key]


def read_vocabulary(path: str) -> bytes:
    """The vocabulary file, read on the driver and sent to the tasks (a few MB)."""
    with open(path, "rb") as file:
        return file.read()


def encode_texts(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids) for every row; ids are packed little-endian 32-bit integers.

    A null text is read as an empty one and has no ids. Rows come back as often as they stand
    there; keys may be null or repeated; other columns are ignored, whatever their names.
    """
    missing_columns(docs, key, text)
    spark = docs.sparkSession
    file = spark.sparkContext.broadcast(read_vocabulary(vocabulary))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _kept(Coder, file.value)
        for part in _parts(batches):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([coder.encode(t or "") for t in part.column(1).to_pylist()], pa.binary())],
                names=["id", "ids"],
            )

    kind = dict(docs.dtypes)[key]
    found = docs.select(q(key).alias("id"), q(text).cast("string").alias("text")).mapInArrow(
        encoded, f"id {kind}, ids binary"
    )
    return found.select(F.col("id").alias(key), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def decode_ids(encoded: DataFrame, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids, decoded): the texts of the ids. Null ids give a null text."""
    missing_columns(encoded, key, "ids", "n_tokens")
    file = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = _kept(Labels, file.value)
        for part in _parts(batches):
            texts = [None if ids is None else labels.decode(ids) for ids in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(texts, pa.string())], names=["id", "n_tokens", "ids", "decoded"]
            )

    kind = dict(encoded.dtypes)[key]
    found = encoded.select(q(key).alias("id"), "n_tokens", "ids").mapInArrow(
        decoded, f"id {kind}, n_tokens long, ids binary, decoded string"
    )
    return found.withColumnRenamed("id", key) if key != "id" else found


def _parts(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def digests(decoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of what ``decode_ids`` returns."""
    return decoded.select(
        q(key), "n_tokens", F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
