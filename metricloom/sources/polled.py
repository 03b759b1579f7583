"""Polling a metric store as a stream: every ``delay`` the last ``interval`` of its samples.

A poll is a number. Poll n looks back over (origin + n * delay - interval, origin + n * delay], so an
offset is the number of the last poll taken, a restarted stream goes on with the next one, and a
poll that has to be repeated asks for the same range. Polls are fetched by executors, one task
each; the driver only counts them. Responses come as text and are taken apart by Spark.
"""

from __future__ import annotations

import math
import re
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from metricloom.functions.scalars import q, seconds_of
from metricloom.sources.responses import metric_matrix

POLLS = "poll long, start double, stop double, body string"


@dataclass
class Poll(InputPartition):
    number: int
    start: float
    stop: float


class PollReader(DataSourceStreamReader):
    """Counts polls and fetches them from a store, which has ``newest()`` and ``fetch(start, stop)``.

    ``fetch`` gives the texts of the responses that hold the samples of (start, stop]; they may hold
    others too. ``newest`` is the time up to which the store is complete.
    """

    def __init__(self, store, interval: float, delay: float, origin: float):
        self.store, self.interval, self.delay, self.origin = store, interval, delay, origin

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def latestOffset(self) -> dict:
        newest = self.store.newest()
        return {"poll": 0 if newest is None else max(0, math.floor((newest - self.origin) / self.delay))}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        stops = ((n, self.origin + n * self.delay) for n in range(start["poll"] + 1, end["poll"] + 1))
        return [Poll(n, stop - self.interval, stop) for n, stop in stops]

    def read(self, partition: Poll) -> Iterator[tuple]:
        for body in self.store.fetch(partition.start, partition.stop):
            yield partition.number, partition.start, partition.stop, body


class RecordedResponses:
    """A folder of responses, a subfolder ``start=<seconds>`` for each ``span`` seconds of samples.

    Any file system that Arrow reads will do. Each line of a file is a response.
    """

    def __init__(self, folder: str, span: float):
        self.folder, self.span = folder, span

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder)

    def _starts(self) -> list[tuple[float, str]]:
        system, path = self._open()
        found = []
        for info in system.get_file_info(fs.FileSelector(path, allow_not_found=True)):
            match = re.fullmatch(r"start=(-?\d+(?:\.\d+)?)", info.base_name)
            if match:
                found.append((float(match[1]), info.path))
        return sorted(found)

    def newest(self) -> float | None:
        return max((start + self.span for start, _ in self._starts()), default=None)

    def fetch(self, start: float, stop: float) -> Iterator[str]:
        system, _ = self._open()
        for at, path in self._starts():
            if at <= stop and at + self.span > start:
                for info in system.get_file_info(fs.FileSelector(path)):
                    if info.is_file and not info.base_name.startswith(("_", ".")):
                        with system.open_input_stream(info.path) as file:
                            yield from (line for line in file.read().decode().split("\n") if line)


class LiveStore:
    """A store that answers at once: ``ask(start, stop)`` gives the text of a response."""

    def __init__(self, ask, clock=time.time):
        self.ask, self.clock = ask, clock

    def newest(self) -> float:
        return self.clock()

    def fetch(self, start: float, stop: float) -> Iterator[str]:
        yield self.ask(start, stop)


def poll_source(source: str, store) -> type[DataSource]:
    """A data source over ``store``, to be registered with a session under the name ``source``."""

    class Polled(DataSource):
        @classmethod
        def name(cls) -> str:
            return source

        def schema(self) -> str:
            return POLLS

        def streamReader(self, schema) -> PollReader:
            given = self.options
            return PollReader(store, *(float(seconds_of(given[n])) for n in ("interval", "delay")), float(given["origin"]))

    return Polled


def read_polls(spark: SparkSession, store, interval: str, delay: str, origin: float, source: str = "metric_polls") -> DataFrame:
    """The polls of a store as a stream of (poll, start, stop, body)."""
    spark.dataSource.register(poll_source(source, store))
    reader = spark.readStream.format(source).option("interval", interval).option("delay", delay)
    return reader.option("origin", repr(float(origin))).load()


def polled_samples(polls: DataFrame) -> DataFrame:
    """The samples of each look-back, as ``metric_matrix`` gives them, with ``ts``.

    Look-backs overlap, so a sample comes as often as polls have seen it.
    """
    seen = metric_matrix(polls).where((q("time") > q("start")) & (q("time") <= q("stop")))
    return seen.drop("start", "stop").withColumn("ts", F.timestamp_micros(F.round(q("time") * 1e6).cast("long")))


def record_responses(samples: DataFrame, folder: str, span: int, series: Sequence[str] = ("metric", "instance")) -> None:
    """Write samples (time, value, labels) as responses, as RecordedResponses reads them.

    A response is one series in ``span`` seconds. Sample times are written to the microsecond;
    labels that are null are left out. Spans that exist are added to.
    """
    names = [F.lit("__name__" if c == "metric" else c) for c in series]
    labels = F.map_from_arrays(F.array(*names), F.array(*[q(c).cast("string") for c in series]))
    pair = F.format_string('[%s,"%s"]', q("time").cast("decimal(20,6)").cast("string"), q("value").cast("string"))
    start = (F.floor(q("time") / span) * span).cast("long").alias("start")
    text = F.to_json(F.map_filter(labels, lambda _, v: v.isNotNull())).alias("labels")
    grouped = samples.groupBy(start, text).agg(F.array_join(F.array_sort(F.collect_list(pair)), ",").alias("pairs"))
    matrix = '{"status":"success","data":{"resultType":"matrix","result":[{"metric":%s,"values":[%s]}]}}'
    body = F.format_string(matrix, "labels", "pairs").alias("value")
    grouped.select("start", body).write.partitionBy("start").mode("append").text(folder)
