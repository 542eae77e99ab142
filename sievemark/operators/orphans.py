"""References to rows that do not exist, found down a graph of foreign keys."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import reference_key
from ..sources.tables import table
from ..storage import Workspace

#: Output of the cascade.
COLUMNS = ("ref_table", "ref_id", "kind", "month")


@dataclass(frozen=True)
class Reference:
    """A foreign key: rows of ``child`` name a row of ``parent`` by ``key``.

    Both tables have a column ``key``. A child whose parent rows are all orphans is an indirect
    orphan, and with ``required`` so is a child without any parent row; ``direct`` is kept for rows that come as orphans.
    """

    child: str
    parent: str
    key: str
    required: bool = False


def image_life(image_record: DataFrame) -> DataFrame:
    """(image_key, born, gone, fractures): first delivery, withdrawal and fracture count."""
    return (
        image_record.where("image_id is not null")
        .groupBy(reference_key(F.col("image_id")).alias("image_key"))
        .agg(F.min("ingested_at").alias("born"), F.max("withdrawn_at").alias("gone"), F.max("fracture_count").alias("fractures"))
    )


def direct_orphans(children: DataFrame, life: DataFrame, instances: Column | None = None) -> DataFrame:
    """``children`` (ref_table, ref_id, image_key, recorded_at, ...) with a key, and a boolean ``orphan``.

    Orphan: the key names no image, or recorded_at lies before the image's
    first delivery or after its withdrawal, or ``instances`` exceeds its fracture count. A null
    time or count decides nothing. A null key refers to nothing: its row is left out before the join, so
    null keys don't meet in one task. ``life`` is a written table, so that a key with very many rows can be split.
    """
    when = F.col("recorded_at")
    faults = F.col("known").isNull() | (when < F.col("born")) | (when > F.col("gone"))
    if instances is not None:
        faults = faults | (instances > F.col("fractures"))
    joined = children.where("image_key is not null").join(life.withColumn("known", F.lit(True)), "image_key", "left")
    return joined.withColumn("orphan", F.coalesce(faults, F.lit(False))).drop("born", "gone", "fractures", "known")


def cascade(rows: dict[str, DataFrame], references: list[Reference], ws: Workspace) -> DataFrame:
    """(ref_table, ref_id, kind, month) of all orphans; kind is direct or inherited.

    ``rows``: per table (ref_id, orphan, recorded_at and the keys named by references), written once. A
    round starts from the orphans that the round before found, its frontier: the keys they hold are kept if no other row of the
    parent table holds them alive, and semi-joins with these keys give the children lost with them. So a
    round reads the tables but writes only what it found, and the last one finds nothing; cycles of references
    end too. Rows are told apart by a number given when they are written, so null and repeated ref_ids do no harm.
    """
    whole = {name: ws.keep(frame.withColumn("_row", F.monotonically_increasing_id()), name) for name, frame in rows.items()}

    def lost(parts: list[DataFrame]) -> DataFrame:
        return ws.keep(reduce(DataFrame.union, parts).dropDuplicates(["_row"]) if len(parts) > 1 else parts[0], "lost")

    at = lambda frame, depth: frame.withColumn("depth", F.lit(depth))
    first: dict[str, list[DataFrame]] = {name: [at(frame.where("orphan"), 0)] for name, frame in whole.items()}
    for ref in references:
        if ref.required:
            child = whole[ref.child].where(F.col(ref.key).isNotNull() & ~F.col("orphan"))
            first[ref.child].append(at(child.join(whole[ref.parent].select(ref.key), ref.key, "left_anti").select(*whole[ref.child].columns), 1))
    frontier = {name: lost(parts) for name, parts in first.items()}
    known = {name: [frame] for name, frame in frontier.items()}
    orphaned = lambda name: reduce(DataFrame.union, known[name]).select("_row")
    depth = 0
    while frontier:
        depth += 1
        found: dict[str, list[DataFrame]] = {}
        for ref in references:
            if ref.parent not in frontier:
                continue
            touched = ws.keep(frontier[ref.parent].where(F.col(ref.key).isNotNull()).select(ref.key).distinct(), "touched")
            alive = whole[ref.parent].join(touched, ref.key, "left_semi").join(orphaned(ref.parent), "_row", "left_anti").select(ref.key)
            dead = ws.keep(touched.join(alive, ref.key, "left_anti"), "dead")
            child = whole[ref.child]
            found.setdefault(ref.child, []).append(at(child.join(dead, ref.key, "left_semi").join(orphaned(ref.child), "_row", "left_anti").select(*child.columns), depth))
        frontier = {}
        for name, parts in found.items():
            new = lost(parts)
            if not new.isEmpty():
                frontier[name] = new
        for name, new in frontier.items():
            known[name].append(new)
    every = {name: reduce(DataFrame.union, parts) for name, parts in known.items()}
    listed = [frame.select(F.lit(name).alias("ref_table"), "ref_id", F.when(F.col("depth") == 0, "direct").otherwise("inherited").alias("kind"), F.date_format("recorded_at", "yyyy-MM").alias("month")) for name, frame in every.items()]
    return reduce(DataFrame.union, listed)


#: What refers to images, by its unique key. This project's graph: an image's listing is the parent of its annotations,
#: and these of its predictions, by the image they share.
CHILDREN = {"official_split": "split_row_id", "annotation": "annotation_id", "classifier_prediction": "prediction_id"}
LISTING = [Reference("annotation", "official_split", "image_key"), Reference("classifier_prediction", "annotation", "image_key")]


def _children(spark: SparkSession, folder: str, ws: Workspace) -> dict[str, DataFrame]:
    life = ws.keep(image_life(table(spark, folder, "image_record", "image_id", "ingested_at", "withdrawn_at", "fracture_count")), "life")
    parts = []
    for name, key in CHILDREN.items():
        source = table(spark, folder, name)
        instances = F.col("instance_count") if name == "official_split" else F.lit(None).cast("int")
        parts.append(source.select(F.lit(name).alias("ref_table"), F.col(key).alias("ref_id"), reference_key(F.col("image_id")).alias("image_key"), "recorded_at", instances.alias("instance_count")))
    judged = ws.keep(direct_orphans(reduce(DataFrame.union, parts), life, F.col("instance_count")), "judged")
    return {name: judged.where(F.col("ref_table") == name).select("ref_id", "image_key", "recorded_at", "orphan") for name in CHILDREN}


def orphans(spark: SparkSession, folder: str, name: str, references: list[Reference] = LISTING) -> DataFrame:
    """All orphaned references of the radiograph tables, direct and inherited."""
    ws = Workspace(spark, name)
    return cascade(_children(spark, folder, ws), references, ws)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphans(spark, folder, "p5").where("kind = 'direct'").select("ref_table", "ref_id")


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """(ref_table, month, kind, orphans): counts per table and month of recorded_at."""
    return orphans(spark, folder, "p5r").groupBy("ref_table", "month", "kind").agg(F.count("*").alias("orphans"))
