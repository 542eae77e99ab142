"""Queries that also run as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from ..streaming.confusion import windowed_confusion
from .catalogue import query

_DAILY = "select date_trunc('day', ts)::timestamp as start, count(*) as n, count(*) filter (y = 1 and p >= 0.1) as tp, count(*) filter (y = 0 and p < 0.1) as tn, count(*) filter (y = 0 and p >= 0.1) as fp, count(*) filter (y = 1 and p < 0.1) as fn from (select ts, (event_type = 'purchase')::int as y, least(value / 600, 1.0) as p from events where ts is not null and value is not null) group by 1"


@query("daily_confusion", _DAILY)
def daily_confusion(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events", "ts", "event_type", "value").where("value is not null")
    scored = events.select("ts", (F.col("event_type") == "purchase").cast("int").alias("label"), F.least(F.col("value") / 600, F.lit(1.0)).alias("probability"))
    return windowed_confusion(scored, 0.1)
