"""Named queries over the test tables. Importing the modules registers them."""

from metricloom.plans.catalog import (  # noqa: F401
    analysis,
    buckets,
    clean,
    evaluate,
    files,
    invariants,
    joins,
    learning,
    outliers,
    points,
    scale,
    streams,
)
from metricloom.plans.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
