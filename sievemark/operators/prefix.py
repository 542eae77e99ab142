"""Running sums over an order without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sections of the 64-bit order key, at least. A group is summed in so many parts, so that one with a
#: third of all rows is spread over as many tasks.
SECTIONS = 512
#: Rows of a section, about, where the number of rows is known.
SECTION_ROWS = 1 << 20


def sections_for(rows: int) -> int:
    """Sections that keep a group of all rows at about SECTION_ROWS to a task, a power of two."""
    return max(SECTIONS, 1 << (max(0, rows - 1) // SECTION_ROWS).bit_length())


def hash_order(key: Column, seed: int) -> Column:
    """A pseudo-random bigint that fixes the row's place in a random order."""
    return F.xxhash64(key, F.lit(seed))


def running_sum(frame: DataFrame, group: str, order: str, tie: str, amount: str, name: str, sections: int = SECTIONS) -> DataFrame:
    """Adds ``name``: the sum of ``amount`` over the group's rows up to and with this one.

    Rows are ordered by ``order`` (a bigint spread over its whole range, as from
    ``hash_order``), then by ``tie``. The range is cut into sections; a section's sums are
    combined map-side, and the running sum of the section totals (groups x sections rows) is
    added to the running sum within the section. Both steps shuffle by (group, section) only.
    """
    cut = F.shiftrightunsigned(F.col(order), 64 - (sections - 1).bit_length()).cast("int")
    placed = frame.withColumn("_section", cut)
    totals = placed.groupBy(group, "_section").agg(F.sum(amount).alias("_amount"))
    ahead = Window.partitionBy(group).orderBy("_section").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col(group).alias("_group"), F.col("_section").alias("_at"), F.coalesce(F.sum("_amount").over(ahead), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_section").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.join(starts, placed[group].eqNullSafe(F.col("_group")) & (F.col("_section") == F.col("_at")))
        .withColumn(name, F.sum(amount).over(inside) + F.col("_start"))
        .drop("_section", "_group", "_at", "_start")
    )
