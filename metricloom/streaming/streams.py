"""Structured Streaming forms of the polling loops.

Each function maps a streaming frame to a streaming frame; ``drain`` runs one over all
data there is and stops, ``follow`` keeps polling.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from metricloom.functions.scalars import q
from metricloom.operators.points import point_threshold


def read_files(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*", format: str = "parquet",
    files: int | None = None,
) -> DataFrame:
    """New files of a folder as a stream; at most ``files`` in a micro-batch, oldest first."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.format(format).load(folder)


def read_kafka(spark: SparkSession, servers: str, topic: str, schema: T.StructType) -> DataFrame:
    """JSON messages of a topic; needs the Kafka connector on the class path."""
    raw = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .load()
    )
    body = F.from_json(F.col("value").cast("string"), schema)
    return raw.select(body.alias("m")).select("m.*")


def drain(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process what is there into ``path`` and read it back."""
    started = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", f"{path}-progress")
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def follow(stream: DataFrame, path: str, delay: str, format: str = "parquet"):
    """Process new data every ``delay`` until stopped; progress survives restarts."""
    return (
        stream.writeStream.format(format)
        .option("path", path)
        .option("checkpointLocation", f"{path}-progress")
        .trigger(processingTime=delay)
        .start()
    )


def stream_bucket_avg(
    samples: DataFrame,
    interval: str,
    delay: str,
    late: str,
    by: Sequence[str] = (),
    ts: str = "ts",
    value: str = "value",
) -> DataFrame:
    """Averages over the last ``interval``, renewed every ``delay``; ``late`` data counts."""
    look_back = F.window(q(ts), interval, delay)
    return (
        samples.withWatermark(ts, late)
        .groupBy(look_back, *[q(c) for c in by])
        .agg(F.avg(q(value)).alias(value))
        .select(
            F.unix_seconds("window.start").alias("start"),
            F.unix_seconds("window.end").alias("stop"),
            *[q(c) for c in by],
            value,
        )
    )


def stream_points(samples: DataFrame, rules: Sequence[tuple[str, str, float]], **names) -> DataFrame:
    """Threshold rules; no state."""
    return point_threshold(samples, rules, **names)


def stream_dedup(
    samples: DataFrame, late: str, keys: Sequence[str] = ("series", "time"), ts: str = "ts"
) -> DataFrame:
    """Overlapping look-backs deliver a sample repeatedly; keep it once."""
    return samples.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def stream_sessions(
    anomalies: DataFrame, gap: str, late: str, by: Sequence[str] = ("type",), ts: str = "ts"
) -> DataFrame:
    """Anomalies less than ``gap`` apart as one interval.

    Sessions are merged before the shuffle too, so one frequent type does not send all its
    rows to one task.
    """
    spark = anomalies.sparkSession
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    return (
        anomalies.withWatermark(ts, late)
        .groupBy(F.session_window(q(ts), gap).alias("session"), *[q(c) for c in by])
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.unix_micros("session.start").alias("start_us"),
            F.unix_micros("session.end").alias("stop_us"),
            *[q(c) for c in by],
            "n",
        )
    )


SALTS = 64
_FIRED = T.StructType([T.StructField("watch", T.StringType()), T.StructField("fired", T.LongType())])


class Throttle(StatefulProcessor):
    """Ticks of one watch wait until the watermark has passed them and are then taken in order.

    Kept are the waiting ticks and the last one that fired; the latter goes as soon as no tick
    still to come could be within its period. A timer is set for either.
    """

    def __init__(self, period: int):
        self.period = period

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "tick long", "seen boolean")
        self.last = handle.getValueState("last", "fired long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for tick in sorted({int(t) for part in rows for t in part["tick"]}):
            if not self.waiting.containsKey((tick,)):
                self.waiting.updateValue((tick,), (True,))
                self.handle.registerTimer(tick * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        passed = max(timerValues.getCurrentWatermarkInMs(), at)
        # The first timer takes all that is due; those behind it find their ticks gone.
        known = self.waiting.containsKey((at // 1000,))
        due = sorted(t for (t,) in self.waiting.keys() if t * 1000 <= passed) if known else []
        before = self.last.get()[0] if self.last.exists() else None
        last, fired = before, []
        for tick in due:
            self.waiting.removeKey((tick,))
            if last is None or tick >= last + self.period:
                fired.append(tick)
                last = tick
        if last is not None and (last + self.period) * 1000 <= passed:
            self.last.clear()
        elif last != before:
            self.last.update((last,))
            self.handle.registerTimer((last + self.period) * 1000)
        if fired:
            yield pd.DataFrame({"watch": [key[0]] * len(fired), "fired": fired})

    def close(self) -> None:
        pass


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of its own for streams with timers, which need the state store on disk.

    It shares the context and the settings that results depend on; ``spark`` itself stays as it is.
    """
    session = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.ansi.enabled"):
        session.conf.set(name, spark.conf.get(name))
    session.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    return session


def stream_throttle(
    alarms: DataFrame, watch: Column, period: int, tick: str, late: str, ts: str = "ts"
) -> DataFrame:
    """Each watch is looked at once per ``tick`` and fires at most once per ``period`` seconds.

    A tick is settled when the watermark passes its end, so the result is that of the whole data
    in one batch, however they arrive, as long as no row is later than ``late``. Alarms are thinned
    to one per watch and tick, first within salted groups and then across them: a watch with very
    many alarms gives one row per tick to the stateful step. An idle watch has no state. The
    stream must come from a ``stateful_session``. A null watch is a watch of its own; alarms
    without a time are left out.
    """
    ticks = alarms.where(q(ts).isNotNull()).withWatermark(ts, late).select(
        q(ts),
        watch.alias("watch"),
        F.unix_seconds(F.window(q(ts), tick)["end"]).alias("tick"),
        F.pmod(F.xxhash64(q(ts)), F.lit(SALTS)).alias("_salt"),
    )
    for keys in (["watch", "tick", "_salt"], ["watch", "tick"]):
        ticks = ticks.dropDuplicatesWithinWatermark(keys)
    return ticks.groupBy("watch").transformWithStateInPandas(
        Throttle(period), _FIRED, "append", "eventTime"
    )
