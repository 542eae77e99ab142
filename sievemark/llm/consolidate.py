"""Problem 6: every image gets one group over all matches, direct or through others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import hash64, label_key, reference_key
from ..sources.tables import image_keys, table
from ..storage import Workspace
from .star_components import components


def match_edges(near_pair: DataFrame, exclusions: DataFrame, image_record: DataFrame, ws: Workspace) -> DataFrame:
    """(u, v): links between known images, as image_record writes their ids.

    near_pair rows link their two sides; images that share an exact_group label, a
    near_group label or a phash value are each linked to the smallest image of it, so that a
    value with a third of all images costs as many rows, not their square. Unknown, null
    and equal ids give no link.
    """
    known = ws.keep(image_keys(image_record.select("image_id")), "ids")
    sides = near_pair.select(reference_key(F.col("left_image_id")).alias("l"), reference_key(F.col("right_image_id")).alias("r"))
    left = sides.where("l is not null and r is not null and l != r").select("l", "r")
    names = known.select(F.col("image_key").alias("l"), F.col("image_id").alias("u"))
    names_r = known.select(F.col("image_key").alias("r"), F.col("image_id").alias("v"))
    direct = left.distinct().join(names, "l").join(names_r, "r").select("u", "v")

    labelled = exclusions.select(
        reference_key(F.col("image_id")).alias("l"),
        F.inline(F.array(F.struct(F.lit("x").alias("kind"), label_key(F.col("exact_group")).alias("label")), F.struct(F.lit("n").alias("kind"), label_key(F.col("near_group")).alias("label")))),
    ).where("l is not null and label is not null").distinct().join(names, "l").select("kind", "label", "u")
    values = image_record.where("image_id is not null").select("image_id", hash64(F.col("phash")).alias("p")).where("p is not null")
    labelled = ws.keep(labelled, "labels")

    def stars(rows: DataFrame, keys: list[str], node: str) -> DataFrame:
        # written, so that adaptive execution can split the rows of a value that very many images share
        hubs = ws.keep(rows.groupBy(*keys).agg(F.min(node).alias("v"), F.max(node).alias("_last")).where(F.col("v") != F.col("_last")).drop("_last"), "hubs")
        return rows.join(hubs, keys).where(F.col(node) != F.col("v")).select(F.col(node).alias("u"), "v")

    return reduce(DataFrame.union, [direct, stars(labelled, ["kind", "label"], "u"), stars(values, ["p"], "image_id")])


def consolidate(near_pair: DataFrame, exclusions: DataFrame, image_record: DataFrame, ws: Workspace) -> DataFrame:
    """(image_id, group_id): images with a link to another, named by the smallest image_id.

    Empty tables give no rows; repeated rows count once; other columns are not read.
    """
    roots = components(match_edges(near_pair, exclusions, image_record, ws), ws)
    return roots.select(F.col("node").alias("image_id"), F.col("root").alias("group_id"))


def _groups(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return consolidate(
        table(spark, folder, "near_pair", "left_image_id", "right_image_id"),
        table(spark, folder, "exclusions", "image_id", "exact_group", "near_group"),
        table(spark, folder, "image_record", "image_id", "phash"),
        Workspace(spark, name),
    )


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _groups(spark, folder, "p6")


def p6_group_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """(size, groups): how many groups there are of each size."""
    sizes = _groups(spark, folder, "p6s").groupBy("group_id").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("groups"))
