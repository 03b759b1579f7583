"""Detection on a stream: a saved model over micro-batches, every record written once.

A micro-batch writes its records into a folder of its number. A batch that is run again after a
failure writes the same folder again, so nothing comes twice, and progress is the stream's own
checkpoint. The model is loaded again when the store has a newer one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.learning import store
from metricloom.plans import runs


class Detection:
    """What is done with a micro-batch: detect, and write the records under the batch's number."""

    def __init__(self, spec: runs.RunSpec, path: str):
        self.spec, self.path = spec, path
        self.changed_at: int | None = None
        self.loaded = None
        self.loads = 0

    def refresh(self, spark: SparkSession) -> None:
        """Load the model if it is not the one at hand. Without a model the batch fails, and comes
        again when the stream is restarted."""
        changed_at = store.changed_at(spark, runs.model_place(self.spec))
        if changed_at is None:
            raise RuntimeError(f"no model of {self.spec.name} at {runs.model_place(self.spec)}")
        if changed_at != self.changed_at:
            self.loaded, self.changed_at = runs.load(spark, self.spec), changed_at
            self.loads += 1

    def __call__(self, batch: DataFrame, number: int) -> None:
        self.refresh(batch.sparkSession)
        records = runs.detect(batch, self.spec, self.loaded)
        records.write.mode("overwrite").parquet(f"{self.path}/batch={number}")


def detect_stream(rows: DataFrame, detection: Detection, delay: str | None = None):
    """Start detection on a stream of wide rows: over all there is, or every ``delay`` until stopped."""
    trigger = {"processingTime": delay} if delay else {"availableNow": True}
    writer = rows.writeStream.foreachBatch(detection).option("checkpointLocation", f"{detection.path}-progress")
    return writer.trigger(**trigger).start()


def detections(spark: SparkSession, path: str, since: int = 0) -> DataFrame:
    """The records of all batches from number ``since`` on, with ``batch``."""
    return spark.read.parquet(path).where(F.col("batch") >= since)
