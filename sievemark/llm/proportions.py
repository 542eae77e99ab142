"""Problem 1: a sample whose strata follow given target shares (divisor method)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.identity import level
from ..operators.prefix import hash_order, running_sum, sections_for
from ..sources.tables import table
from ..storage import Workspace

SEED = 20260912
REPORT = T.StructType(
    [
        T.StructField("stratum_id", T.IntegerType()),
        T.StructField("available", T.LongType()),
        T.StructField("needed", T.LongType()),
        T.StructField("seats", T.LongType()),
        T.StructField("shortfall", T.LongType()),
        T.StructField("target_share", T.DoubleType()),
        T.StructField("actual_share", T.DoubleType()),
    ]
)


def strata_of(image_record: DataFrame, targets: DataFrame) -> DataFrame:
    """(image_id, stratum_id): each distinct image with its stratum; null if in none listed.

    A null fractured belongs to no stratum. Deliveries of an image count once; should they
    disagree, the greatest stratum_id holds. The targets are a fixed, small table.
    """
    named = targets.select("stratum_id", F.col("fractured").alias("_f"), F.col("anatomy").alias("_a"), F.col("view").alias("_v"))
    rows = image_record.where(F.col("image_id").isNotNull()).select("image_id", "fractured", level(F.col("anatomy")).alias("_anatomy"), level(F.col("view")).alias("_view"))
    joined = rows.join(F.broadcast(named), (F.col("fractured") == F.col("_f")) & (F.col("_anatomy") == F.col("_a")) & (F.col("_view") == F.col("_v")), "left")
    return joined.groupBy("image_id").agg(F.max("stratum_id").alias("stratum_id"))


def seats(available: dict[int, int], shares: dict[int, int], floors: dict[int, int], size: int) -> dict[int, int]:
    """Seats per stratum: floors first, then the smallest priorities (rank - 0.5) / share.

    Equals taking the ``size`` smallest of all records' (is beyond floor, priority, stratum),
    where an exhausted stratum has no further records, so its seats go to the others. The
    floors are kept even if they exceed ``size``. Found by bisection on the priority, over the
    strata alone.
    """
    kept = {s: min(available.get(s, 0), floors[s]) for s in shares}
    left = size - sum(kept.values())
    room = {s: available.get(s, 0) - kept[s] for s in shares if shares[s] > 0}
    if left <= 0:
        return kept
    if left >= sum(room.values()):
        return {s: kept[s] + room.get(s, 0) for s in shares}

    def upto(limit: float) -> dict[int, int]:
        """Records beyond the floor whose priority is at most the limit."""
        return {s: max(0, min(room[s], math.floor(limit * shares[s] + 0.5) - kept[s])) for s in room}

    low, high = 0.0, (max(available.values()) + 1) / min(shares[s] for s in room)
    for _ in range(200):
        middle = (low + high) / 2
        if not low < middle < high:
            break
        low, high = (middle, high) if sum(upto(middle).values()) <= left else (low, middle)
    taken = upto(low)
    open_ = sorted((s for s in room if taken[s] < room[s]), key=lambda s: ((kept[s] + taken[s] + 0.5) / shares[s], s))
    for s in open_[: left - sum(taken.values())]:
        taken[s] += 1
    return {s: kept[s] + taken.get(s, 0) for s in shares}


def _plan(strata: DataFrame, targets: DataFrame, one_in: int) -> list[tuple]:
    """The report's rows. Only counts per stratum of the target table reach the driver."""
    goal = targets.select("stratum_id", "target_ppm", "min_rows").collect()
    counts = {r["stratum_id"]: r["n"] for r in strata.groupBy("stratum_id").agg(F.count("*").alias("n")).collect()}
    size = sum(counts.values()) // one_in
    available = {g["stratum_id"]: counts.get(g["stratum_id"], 0) for g in goal}
    shares = {g["stratum_id"]: max(0, g["target_ppm"] or 0) for g in goal}
    floors = {g["stratum_id"]: max(0, g["min_rows"] or 0) for g in goal}
    given = seats(available, shares, floors, size) if goal else {}
    total = sum(given.values())
    rows = []
    for s in sorted(shares):
        needed = max(floors[s], -(-size * shares[s] // 1_000_000))
        rows.append((s, available[s], needed, given[s], max(0, needed - available[s]), shares[s] / 1e6, given[s] / total if total else 0.0))
    return rows


def ranked_records(image_record: DataFrame, targets: DataFrame, ws: Workspace, one_in: int = 10, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(ranked, report): every record of a listed stratum with its rank and whether it is drawn, and the report of ``draw``.

    ranked: (image_id, stratum_id, priority, drawn).
    """
    spark = image_record.sparkSession
    strata = ws.keep(strata_of(image_record, targets), "strata")
    rows = _plan(strata, targets, one_in)
    report = spark.createDataFrame(rows, REPORT)
    limits = report.select(F.col("stratum_id").alias("_s"), F.col("seats").alias("_seats"), F.col("target_share").alias("_share"))
    ranked = running_sum(
        strata.where(F.col("stratum_id").isNotNull()).select("image_id", "stratum_id", hash_order(F.col("image_id"), seed).alias("_order"), F.lit(1).cast("bigint").alias("_one")),
        "stratum_id", "_order", "image_id", "_one", "_rank", sections_for(strata.count()),
    )
    priority = F.when(F.col("_share") > 0, (F.col("_rank") - 0.5) / F.col("_share"))
    marked = ranked.join(F.broadcast(limits), F.col("stratum_id") == F.col("_s")).select("image_id", "stratum_id", priority.alias("priority"), (F.col("_rank") <= F.col("_seats")).alias("drawn"))
    return marked, report


def draw(image_record: DataFrame, targets: DataFrame, ws: Workspace, one_in: int = 10, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(sample, report) of one image in ``one_in``, in the target's proportions.

    sample: (image_id, stratum_id, priority), the images with the smallest priorities, floor
    records first, in a random order per stratum that depends only on image_id and seed.
    report: one row per listed stratum with available, needed, seats, shortfall and shares.
    Null or unlisted strata get no seat. With no images both are zero rows or zero counts.
    """
    ranked, report = ranked_records(image_record, targets, ws, one_in, seed)
    return ranked.where("drawn").drop("drawn"), report


_COLUMNS = ("image_id", "fractured", "anatomy", "view")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Strata that fall short: what the draw gave them and what it left of them don't reach what they need."""
    ws = Workspace(spark, "p1")
    ranked, report = ranked_records(table(spark, folder, "image_record", *_COLUMNS), table(spark, folder, "sample_target"), ws)
    counts = ws.keep(ranked, "ranked").groupBy("stratum_id").agg(F.count_if("drawn").alias("got"), F.count_if(~F.col("drawn")).alias("left"))
    short = F.coalesce(F.col("got") + F.col("left"), F.lit(0)) < F.col("needed")
    return report.join(counts, "stratum_id", "left").where(short).select("stratum_id")


def p1_sample(spark: SparkSession, folder: str) -> DataFrame:
    sample, _ = draw(table(spark, folder, "image_record", *_COLUMNS), table(spark, folder, "sample_target"), Workspace(spark, "p1s"))
    return sample


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    _, report = draw(table(spark, folder, "image_record", *_COLUMNS), table(spark, folder, "sample_target"), Workspace(spark, "p1r"))
    return report
