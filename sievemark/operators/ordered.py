"""Running totals and row numbers over a total order, spread over all tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Workspace


def running(frame: DataFrame, ws: Workspace, order: list[Column], sums: dict[str, str], by: tuple[str, ...] = ()) -> DataFrame:
    """Adds, for each name in ``sums``, the running total of a column along ``order``, per ``by``.

    Rows are range-partitioned by (by, order) and written once with their range's number, so
    the ranges hold still. Totals per range, one row per range and group in it, are summed up
    ahead of each range; within a range a window adds the rest. No task sees more than one range. ``order`` must be total,
    or ties share nothing but an arbitrary order.
    """
    keys = [F.col(c) for c in by]
    placed = ws.keep(frame.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    totals = placed.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    ahead = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_range").alias("_k_range"), *[F.coalesce(F.sum(f"_t_{n}").over(ahead), F.lit(0)).alias(f"_s_{n}") for n in sums])
    on = F.col("_range") == F.col("_k_range")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(starts, on)
    for n, c in sums.items():
        joined = joined.withColumn(n, F.sum(c).over(inside) + F.col(f"_s_{n}"))
    return joined.select(*frame.columns, *sums)


def numbered(frame: DataFrame, ws: Workspace, order: list[Column], name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds the row's number along ``order``, from 1, per ``by``."""
    counted = frame.withColumn("_unit", F.lit(1).cast("bigint"))
    return running(counted, ws, order, {name: "_unit"}, by).drop("_unit")
