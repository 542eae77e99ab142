"""Problem 4: images that differ by small edits, as pairs and as groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import hashed_images, table
from ..storage import Workspace
from .near_hashes import near_vectors
from .star_components import components

IMAGE_COLUMNS = ("image_id", "phash", "dhash", "pixel_md5")


def _classes(images: DataFrame) -> DataFrame:
    """One row per (p, d, hi, lo): images of a class are copies of each other as far as known."""
    return images.groupBy("p", "d", "hi", "lo").agg(F.count("*").alias("n"))


def near_members(images: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """(members, class pairs) of the near pairs among ``images`` (image_id, p, d, hi, lo).

    members: images whose hashes take part in a pair. Class pairs: (p, d, hi, lo) of both
    sides with suffix 1 and 2, the lower first; a class without pixel digest is paired with
    itself if it has several images, and classes with the same digest are not paired.
    """
    hashed = images.where("p is not null and d is not null")
    vectors = ws.keep(hashed.groupBy("p", "d").agg(F.count("*").alias("n")), "vectors")
    apart = ws.keep(near_vectors(vectors.select("p", "d"), ws), "near")
    same = vectors.where("n > 1").select(F.col("p").alias("p1"), F.col("d").alias("d1"), F.col("p").alias("p2"), F.col("d").alias("d2"))
    pairs = apart.union(same)
    # Written, as all that is joined back on its own key: the images of one hash value can then be split.
    touched = pairs.select(F.inline(F.array(F.struct(F.col("p1").alias("p"), F.col("d1").alias("d")), F.struct(F.col("p2").alias("p"), F.col("d2").alias("d"))))).distinct()
    touched = ws.keep(touched, "touched")
    members = ws.keep(hashed.join(touched, ["p", "d"], "left_semi"), "members")
    classes = _classes(members)
    one = classes.select(*[F.col(c).alias(f"{c}1") for c in ("p", "d", "hi", "lo", "n")])
    two = classes.select(*[F.col(c).alias(f"{c}2") for c in ("p", "d", "hi", "lo")])
    differ = ~(F.col("hi1").eqNullSafe(F.col("hi2")) & F.col("lo1").eqNullSafe(F.col("lo2")))
    unknown = F.col("hi1").isNull() & F.col("hi2").isNull()
    within = (F.col("p1") == F.col("p2")) & (F.col("d1") == F.col("d2"))
    low = F.struct(F.coalesce("hi1", F.lit(-(1 << 63))), F.coalesce("lo1", F.lit(-(1 << 63)))) < F.struct(F.coalesce("hi2", F.lit(-(1 << 63))), F.coalesce("lo2", F.lit(-(1 << 63))))
    found = pairs.join(one, ["p1", "d1"]).join(two, ["p2", "d2"]).where(
        F.when(within, (differ & low) | (unknown & (F.col("n1") > 1))).otherwise(differ | unknown)
    )
    return members, found.select(*[f"{c}{i}" for i in (1, 2) for c in ("p", "d", "hi", "lo")])


def _class_key(side: str = "") -> F.Column:
    """hash columns as one non-null join key"""
    return F.concat_ws("/", *[F.coalesce(F.col(f"{c}{side}").cast("string"), F.lit("-")) for c in ("p", "d", "hi", "lo")])


def near_pairs(images: DataFrame, ws: Workspace) -> DataFrame:
    """(image_id_a, image_id_b), a < b: all near pairs of images.

    ``images``: (image_id, p, d, hi, lo), one row per image. Images that lack a hash are in
    no pair; two images with the same pixel digest are no pair; the others are even if all
    hashes agree. Empty input gives no rows. Columns besides these are not read.
    """
    members, pairs = near_members(images, ws)
    keyed = members.select(_class_key().alias("class"), "image_id")
    ends = pairs.select(_class_key("1").alias("class1"), _class_key("2").alias("class2"))
    a, b = F.col("id1"), F.col("id2")
    return (
        ends.join(keyed.select(F.col("class").alias("class1"), F.col("image_id").alias("id1")), "class1")
        .join(keyed.select(F.col("class").alias("class2"), F.col("image_id").alias("id2")), "class2")
        .where((F.col("class1") != F.col("class2")) | (a < b))
        .select(F.least(a, b).alias("image_id_a"), F.greatest(a, b).alias("image_id_b"))
    )


def near_groups(images: DataFrame, ws: Workspace) -> DataFrame:
    """(image_id, group_id, links): images with a near partner, their group and number of partners.

    Groups are the connected components of the near pairs, named by their smallest image_id.
    Copies (same hashes and pixel digest) take part as one class, so their pairs are not listed.
    """
    members, pairs = near_members(images, ws)
    pairs = ws.keep(pairs.select(_class_key("1").alias("class1"), _class_key("2").alias("class2")), "class-pairs")
    keyed = members.select(_class_key().alias("class"), "image_id")
    classes = ws.keep(keyed.groupBy("class").agg(F.count("*").alias("n"), F.min("image_id").alias("first_id")), "classes")
    both = pairs.union(pairs.where("class1 != class2").select("class2", "class1"))
    links = (
        both.join(classes.select(F.col("class").alias("class2"), "n"), "class2")
        .groupBy(F.col("class1").alias("class"))
        .agg(F.sum(F.when(F.col("class1") == F.col("class2"), F.col("n") - 1).otherwise(F.col("n"))).alias("links"))
    )
    roots = components(pairs.where("class1 != class2").select(F.col("class1").alias("u"), F.col("class2").alias("v")), ws)
    placed = (
        classes.join(links, "class")
        .join(roots.select(F.col("node").alias("class"), "root"), "class", "left")
        .withColumn("root", F.coalesce("root", "class"))
    )
    placed = ws.keep(placed, "placed")
    names = ws.keep(placed.groupBy("root").agg(F.min("first_id").alias("group_id")), "names")
    return placed.join(names, "root").join(keyed, "class").select("image_id", "group_id", "links")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    ws = Workspace(spark, "p4")
    images = ws.keep(hashed_images(table(spark, folder, "image_record", *IMAGE_COLUMNS)), "images")
    return near_pairs(images, ws)


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    ws = Workspace(spark, "p4g")
    images = ws.keep(hashed_images(table(spark, folder, "image_record", *IMAGE_COLUMNS)), "images")
    return near_groups(images, ws)
