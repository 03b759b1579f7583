"""Streams over several micro-batches: late rows, restarts, state that ends, polls."""

import json
import random

import pytest
from pyspark.sql import functions as F

from metricloom.functions.scalars import q
from metricloom.session import scratch_path
from metricloom.sources import polled
from metricloom.sources.responses import metric_matrix, read_json_text
from metricloom.streaming import streams as st

ALARMS = "ts timestamp, watch string"


def alarms(count=400, seed=1):
    """(seconds, watch); one watch has most of them, one is null."""
    rng = random.Random(seed)
    return [(rng.randrange(0, 40_000), rng.choice(["busy"] * 8 + ["idle", None])) for _ in range(count)]


def throttled(rows, period, tick, until):
    fired = []
    for watch in {w for _, w in rows}:
        last = None
        for at in sorted({s // tick * tick + tick for s, w in rows if w == watch}):
            if at <= until and (last is None or at >= last + period):
                fired.append((watch or "", at))
                last = at
    return sorted(fired)


def arrive(spark, folder, rows):
    """One file, that is one micro-batch, written after those that are there."""
    frame = spark.createDataFrame([(s, w) for s, w in rows], "s long, watch string")
    frame.select(F.timestamp_seconds("s").alias("ts"), "watch").coalesce(1).write.mode("append").parquet(folder)


def in_polls(rows, polls, late):
    """Rows in the order of their times, some up to ``late`` seconds behind, cut into polls."""
    rng = random.Random(2)
    order = sorted(rows, key=lambda r: r[0] + rng.randrange(late))
    size = -(-len(order) // polls)
    return [order[i : i + size] for i in range(0, len(order), size)]


def stream_of(spark, folder):
    schema = spark.createDataFrame([], ALARMS).schema
    arriving = st.read_files(st.stateful_session(spark), folder, schema, "*.parquet", files=1)
    return st.stream_throttle(arriving, q("watch"), 1800, "1 minute", "10 minutes")


@pytest.mark.parametrize("polls", [1, 2, 7])
def test_throttle_does_not_depend_on_the_batches(spark, polls):
    rows = alarms()
    folder, path = scratch_path(spark, "alarms"), scratch_path(spark, "fired")
    for part in in_polls(rows, polls, 300):
        arrive(spark, folder, part)
    got = st.drain(stream_of(spark, folder), path).collect()
    until = max(s for s, _ in rows) - 600
    assert sorted((r.watch or "", r.fired) for r in got) == throttled(rows, 1800, 60, until)


def test_throttle_goes_on_after_a_restart_and_forgets(spark):
    rows = alarms(120)
    folder, path = scratch_path(spark, "alarms"), scratch_path(spark, "fired")
    parts = in_polls(rows, 3, 300)
    for part in (*parts, [(100_000, None)]):  # the last row moves the watermark past all others
        arrive(spark, folder, part)
        st.drain(stream_of(spark, folder), path)  # a new query each time, from the progress of the last
    got = spark.read.schema("watch string, fired long").parquet(path).collect()
    assert sorted((r.watch or "", r.fired) for r in got) == throttled(rows, 1800, 60, 99_000)
    for name in ("last", "waiting"):
        state = spark.read.format("statestore").option("path", f"{path}-progress").option("operatorId", 0)
        left = state.option("stateVarName", name).load().select("key.watch").distinct().collect()
        assert [r.watch for r in left] == ([None] if name == "waiting" else [])


def test_the_caller_s_session_keeps_its_settings(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    own = st.stateful_session(spark)
    assert spark.conf.get(name) == before != own.conf.get(name)
    assert own.conf.get("spark.sql.session.timeZone") == spark.conf.get("spark.sql.session.timeZone")


# --- polls ---------------------------------------------------------------------------------

SPAN, INTERVAL, DELAY = 600, "20m", "5m"


def record(spark, folder, first, last):
    rng = random.Random(first)
    rows = [(float(t) + 0.25, m, i, rng.random()) for t in range(first, last, 7) for m in ("cpu", "mem") for i in ("a", None)]
    frame = spark.createDataFrame(rows, "time double, metric string, instance string, value double")
    polled.record_responses(frame, folder, SPAN)
    return rows


def test_polls_are_taken_once_and_equal_the_batch(spark):
    folder, path = scratch_path(spark, "responses"), scratch_path(spark, "polls")
    rows, counts = [], []
    for first, last in ((0, 1800), (1800, 3000), (3000, 3600)):
        rows += record(spark, folder, first, last)
        polls = polled.read_polls(spark, polled.RecordedResponses(folder, SPAN), INTERVAL, DELAY, 0)
        st.drain(polls.select("poll", "start", "stop", "body"), path)
        seen = spark.read.parquet(path).where("body IS NOT NULL")
        counts.append(seen.select("poll").distinct().count())
    assert counts == [6, 10, 12]
    # Poll n comes once: as many responses of a span as the span has series.
    assert seen.groupBy("poll", "body").count().where("count > 1").count() == 0
    whole = metric_matrix(read_json_text_lines(spark, folder)).select("series", "time", "value")
    once = polled.polled_samples(seen).select("series", "time", "value").distinct()
    assert once.exceptAll(whole).count() == 0 and whole.exceptAll(once).count() == 0
    assert whole.count() == len(rows)
    # Overlapping look-backs bring a sample as often as its time lies in one.
    often = polled.polled_samples(seen).groupBy("series", "time").count()
    assert often.where("time > 600 and time <= 2400").agg(F.min("count"), F.max("count")).first() == (4, 4)


def read_json_text_lines(spark, folder):
    return spark.read.text(folder).select(F.col("value").alias("body"))


def test_duplicates_across_polls_and_restarts_go(spark):
    folder, path = scratch_path(spark, "responses"), scratch_path(spark, "once")
    rows = []
    for first, last in ((0, 1800), (1800, 3600)):
        rows += record(spark, folder, first, last)
        polls = polled.read_polls(spark, polled.RecordedResponses(folder, SPAN), INTERVAL, DELAY, 0)
        once = st.stream_dedup(polled.polled_samples(polls), "30 minutes").select("series", "time", "value")
        got = st.drain(once, path)
    assert sorted(map(tuple, got.select("time", "value").collect())) == sorted((r[0], r[3]) for r in rows)


def test_a_live_store_is_asked_for_each_look_back(spark, tmp_path):
    def ask(start, stop):
        return json.dumps({"data": {"result": [{"metric": {"__name__": "up"}, "values": [[stop, "1"], [start, "0"]]}]}})

    path = scratch_path(spark, "live")
    polls = polled.read_polls(spark, polled.LiveStore(ask, clock=lambda: 100.0), "20s", "10s", 0, source="live_polls")
    got = st.drain(polled.polled_samples(polls).select("poll", "time", "value"), path).collect()
    assert sorted(tuple(r) for r in got) == [(n, 10.0 * n, 1.0) for n in range(1, 11)]


def test_an_empty_folder_has_no_polls(spark):
    polls = polled.read_polls(spark, polled.RecordedResponses(scratch_path(spark, "none"), SPAN), INTERVAL, DELAY, 0)
    assert st.drain(polls, scratch_path(spark, "nothing")).count() == 0


def test_whole_files_are_responses_too(spark, tmp_path):
    body = {"data": {"result": [{"metric": {"__name__": "m"}, "values": [[1, "2"]]}]}}
    (tmp_path / "one.json").write_text(json.dumps(body, indent=1))
    [row] = metric_matrix(read_json_text(spark, str(tmp_path))).collect()
    assert (row.series, row.time, row.value) == ("m", 1.0, 2.0)
