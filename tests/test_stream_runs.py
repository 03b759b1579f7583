"""Detection on a stream: failures, restarts and newer models."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import StreamingQueryException

from metricloom.plans import runs, stream_runs
from metricloom.session import scratch_path
from metricloom.streaming import streams as st


@pytest.fixture(scope="module")
def rows(spark):
    x = np.random.default_rng(1).normal(size=(300, 2))
    frame = pd.DataFrame({"time": range(300), "a": x[:, 0], "b": x[:, 1], "target": np.where(x[:, 0] > 0.5, "cpu", "0")})
    return spark.createDataFrame(frame).cache()


def arrive(rows, folder, low, high):
    rows.drop("target").where(f"time >= {low} and time < {high}").coalesce(1).write.mode("append").parquet(folder)


class Fails(stream_runs.Detection):
    """Dies in its second batch, after the records are written."""

    def __call__(self, batch, number):
        super().__call__(batch, number)
        if number == 1:
            raise OSError("lost")


def test_records_come_once_after_a_failure_and_a_newer_model_is_used(spark, rows):
    spec = runs.RunSpec(scratch_path(spark, "run"), method="decision_tree", target="target", options={"maxDepth": 3})
    folder, path = scratch_path(spark, "rows"), scratch_path(spark, "records")
    for low in (0, 100, 200):
        arrive(rows, folder, low, low + 100)
    stream = lambda: st.read_files(spark, folder, rows.drop("target").schema, "*.parquet", files=1)
    with pytest.raises(StreamingQueryException, match="no model"):
        stream_runs.detect_stream(stream(), stream_runs.Detection(spec, path)).awaitTermination()
    runs.train(rows, spec)
    with pytest.raises(StreamingQueryException, match="lost"):
        stream_runs.detect_stream(stream(), Fails(spec, path)).awaitTermination()
    detection = stream_runs.Detection(spec, path)
    stream_runs.detect_stream(stream(), detection).awaitTermination()
    whole = runs.detect(rows.drop("target"), spec)
    found = stream_runs.detections(spark, path)
    assert sorted(r.utc for r in found.collect()) == sorted(r.utc for r in whole.collect())
    assert detection.loads == 1 and found.select("batch").distinct().count() == 3
    # A newer model: all rows of a fourth batch are of another class.
    runs.train(rows.withColumn("target", F.lit("mem")), spec)
    arrive(rows, folder, 0, 50)
    stream_runs.detect_stream(stream(), detection).awaitTermination()
    assert detection.loads == 2
    late = stream_runs.detections(spark, path, since=3)
    assert late.count() == 50 and late.where("type <> 'mem'").count() == 0
