"""Running confusion counts over a stream of scored events (an extension, for monitoring)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_confusion(events: DataFrame, threshold: float, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, n, tp, tn, fp, fn) per window of ``ts``; works on streams and on tables.

    ``events``: (ts, label, probability). On a stream, state is kept until the watermark, ``late`` behind the
    latest event, has passed a window; later events are dropped, as watermarks do.
    """
    y, p = F.col("label") == 1, F.col("probability") >= threshold
    rows = events.where("ts is not null and label in (0, 1) and probability is not null")
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return (
        rows.groupBy(F.window("ts", width).alias("w"))
        .agg(F.count("*").alias("n"), F.count_if(y & p).alias("tp"), F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"))
        .select(F.col("w.start").alias("start"), "n", "tp", "tn", "fp", "fn")
    )
