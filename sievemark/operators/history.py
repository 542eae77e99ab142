"""Best epoch and patience over a training history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def early_stopping(history: DataFrame) -> DataFrame:
    """Adds best_so_far, stale (epochs since the last improvement) and is_best.

    ``history``: (epoch, primary_metric, secondary), one row per epoch, so one window over all of it. Best is the greatest
    primary_metric, then the least secondary, then the first epoch.
    """
    order = Window.partitionBy(F.lit(1)).orderBy("epoch")
    past, until = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    improved = F.coalesce(F.col("primary_metric") > F.max("primary_metric").over(past), F.lit(True))
    whole = Window.partitionBy(F.lit(1))
    best = F.max(F.struct("primary_metric", -F.col("secondary"), -F.col("epoch"))).over(whole)
    return (
        history.withColumn("_improved", improved)
        .withColumn("best_so_far", F.max("primary_metric").over(until))
        .withColumn("stale", F.col("epoch") - F.max(F.when(F.col("_improved"), F.col("epoch"))).over(until))
        .withColumn("is_best", F.struct("primary_metric", -F.col("secondary"), -F.col("epoch")) == best)
        .drop("_improved")
    )
