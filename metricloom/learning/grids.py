"""Model answers over a mesh, for decision boundaries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The mesh of the boundary plot.
X_RANGE, Y_RANGE, STEPS = (-15.0, 25.0), (-5.0, 20.0), 80


def decision_grid(
    spark: SparkSession,
    answer: Callable[[DataFrame], DataFrame],
    names: Sequence[str] = ("pc1", "pc2"),
    x_range: tuple[float, float] = X_RANGE,
    y_range: tuple[float, float] = Y_RANGE,
    steps: int = STEPS,
) -> DataFrame:
    """``steps`` x ``steps`` points over the plane, with the model's answer at each."""
    at = F.col("id")

    def along(index, ends):
        return F.lit(ends[0]) + index * ((ends[1] - ends[0]) / (steps - 1))

    mesh = spark.range(steps * steps).select(
        along(F.floor(at / steps), x_range).alias(names[0]), along(at % steps, y_range).alias(names[1])
    )
    return answer(mesh)
