"""Fault-injection logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metricloom.functions.scalars import q

# The two line formats of the fault injector.
_PREFIX = (
    r"([+-]?\d+(?:\.\d+)?)\s+anomalies\.py:(\d+)\s+"
    r"(TRACE|DEBUG|NOTICE|INFO|WARN(?:ING)?|ERR(?:OR)?|CRIT(?:ICAL)?|FATAL)\s+(\w+) (\w+) "
)
_WITH_OPTIONS = _PREFIX + r"with options (.*) and uuid (.*)"
_FOR = _PREFIX + r"of uuid (.*) for"


def read_fault_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log lines parsed; ``line`` grows along each file."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    return parse_fault_logs(lines, "value")


def parse_fault_logs(lines: DataFrame, text: str = "value") -> DataFrame:
    """Fields of each log line; a line in neither format keeps its row, with nulls."""
    first, second = q(text).rlike(_WITH_OPTIONS), q(text).rlike(_FOR)

    def part(i: int, j: int | None):
        one = F.when(first, F.regexp_extract(q(text), _WITH_OPTIONS, i))
        if j is None:
            return one
        return F.coalesce(one, F.when(second, F.regexp_extract(q(text), _FOR, j)))

    kept = [q(c) for c in lines.columns if c != text]
    return lines.select(
        *kept,
        part(1, 1).alias("unixtime"),
        part(2, 2).alias("linenumber"),
        part(3, 3).alias("loglevel"),
        part(4, 4).alias("status"),
        part(5, 5).alias("anomaly"),
        part(6, None).alias("settings"),
        F.trim(part(7, 6)).alias("uuid"),
    )
