"""Problem 2: records of the evaluation splits that also occur, or almost, in train.

Candidates come from winnowed fingerprints (``winnowing``): selected grams of phash are joined
across splits, extended by alignment over phash and dhash, and chained per pair of hash values.
Equal pixel digests and images listed on both sides are added by key. Images with
the same hash values are one class throughout, so counts never spell out the pairs of two classes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import digest128, hash64, level, reference_key, split_name
from ..sources.tables import table
from ..storage import Workspace
from .winnowing import RING, chained_pairs


def listed_images(image_record: DataFrame, official_split: DataFrame) -> DataFrame:
    """(image_id, source, p, d, hi, lo, train, val, test): known images with the splits that list them.

    Ids are matched without case and outer white space; rows without a split or a known
    image are left out. A null source reads unknown. Deliveries are one row.
    """
    flags = [F.max(F.col("split") == s).alias(s) for s in ("train", "val", "test")]
    listed = official_split.select(reference_key(F.col("image_id")).alias("image_key"), split_name(F.col("split")).alias("split")).where("image_key is not null and split is not null").groupBy("image_key").agg(*flags)
    digest = digest128(F.col("pixel_md5"))
    rows = (
        image_record.where("image_id is not null")
        .select(reference_key(F.col("image_id")).alias("image_key"), "image_id", level(F.col("source")).alias("source"), "phash", "dhash", "pixel_md5")
        .join(listed, "image_key")
        .withColumn("m", digest)
    )
    values = {"p": hash64(F.col("phash")), "d": hash64(F.col("dhash")), "hi": F.col("m.hi"), "lo": F.col("m.lo")}
    return (
        rows.groupBy("image_key")
        .agg(F.min("image_id").alias("image_id"), F.max("source").alias("source"), *[F.max(v).alias(k) for k, v in values.items()], *[F.max(s).alias(s) for s in ("train", "val", "test")])
        .drop("image_key")
    )


def vector_pairs(listed: DataFrame, ws: Workspace) -> DataFrame:
    """(p1, d1, p2, d2, seeds, agree): near hash pairs of an evaluation and a train image."""
    whole = "p is not null and d is not null"
    sides = [ws.keep(listed.where(side).where(whole).select("p", "d").distinct(), "vectors") for side in ("val or test", "train")]
    return ws.keep(chained_pairs(*sides, ws), "near")


def overlaps(listed: DataFrame, ws: Workspace) -> DataFrame:
    """(eval_id, train_id, coverage): each evaluation image with each of its counterparts in train.

    coverage is the share of the 128 hash bits that the alignment matches, 1 for the same pixel digest. An image
    listed on both sides is its own counterpart. ``listed`` is as from ``listed_images``. Only this
    form spells out every pair; ``counterparts`` counts them by class.
    """
    evals, trains = listed.where("val or test"), listed.where("train")
    near = (
        vector_pairs(listed, ws)
        .join(evals.select(F.col("p").alias("p1"), F.col("d").alias("d1"), F.col("image_id").alias("eval_id")), ["p1", "d1"])
        .join(trains.select(F.col("p").alias("p2"), F.col("d").alias("d2"), F.col("image_id").alias("train_id")), ["p2", "d2"])
        .select("eval_id", "train_id", (F.col("agree") / (2.0 * RING)).alias("coverage"))
    )
    same = (
        evals.where("hi is not null").select("hi", "lo", F.col("image_id").alias("eval_id"))
        .join(trains.where("hi is not null").select("hi", "lo", F.col("image_id").alias("train_id")), ["hi", "lo"])
        .select("eval_id", "train_id", F.lit(1.0).alias("coverage"))
    )
    itself = listed.where("train and (val or test)").select(F.col("image_id").alias("eval_id"), F.col("image_id").alias("train_id"), F.lit(1.0).alias("coverage"))
    return near.union(same).union(itself).groupBy("eval_id", "train_id").agg(F.max("coverage").alias("coverage"))


def counterparts(listed: DataFrame, ws: Workspace) -> DataFrame:
    """(image_id, source, val, test, counterparts, coverage, seeds): evaluation images with a counterpart in train.

    The number and best coverage of the rows that ``overlaps`` would give, and the longest chain of seeds, by classes of
    equal hash values: the train images near in hashes, plus those with the same digest, less
    those that are both, plus the image itself if it is listed in train and neither counts it.
    Two classes of a third of all images each meet in one row.
    """
    four = ("p", "d", "hi", "lo")
    evals, trains = listed.where("val or test"), listed.where("train")
    pairs = vector_pairs(listed, ws)
    sizes = lambda *keys: ws.keep(trains.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.count("*").alias("n")), "sizes")
    by_hash, by_digest, by_both = sizes("p", "d"), sizes("hi", "lo"), sizes(*four)
    classes = ws.keep(evals.groupBy(*four).agg(F.count("*").alias("_")).drop("_"), "classes")
    second = lambda f: f.withColumnsRenamed({"p": "p2", "d": "d2"})
    near = ws.keep(pairs.join(second(by_hash), ["p2", "d2"]).groupBy(F.col("p1").alias("p"), F.col("d1").alias("d")).agg(F.sum("n").alias("near"), F.max("agree").alias("agree"), F.max("seeds").alias("seeds")), "near-counts")
    first = pairs.select(F.col("p1").alias("p"), F.col("d1").alias("d"), "p2", "d2")
    twice = ws.keep(
        classes.where("hi is not null").join(first, ["p", "d"]).join(second(by_both), ["p2", "d2", "hi", "lo"]).groupBy(*four).agg(F.sum("n").alias("twice")),
        "twice",
    )
    counted = (
        classes.join(near, ["p", "d"], "left").join(by_digest.withColumnRenamed("n", "same"), ["hi", "lo"], "left")
        .join(twice, list(four), "left").select(*four, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("near", "same", "twice")], "agree", "seeds")
    )
    counted = ws.keep(counted, "counted")
    on = [F.col(f"e.{c}").eqNullSafe(F.col(f"c.{c}")) for c in four]
    rows = evals.alias("e").join(counted.alias("c"), on)
    # listed on both sides, an image is its own counterpart; hashes or digest have counted it already if it has any
    alone = F.when(F.col("train") & ~(F.col("e.p").isNotNull() & F.col("e.d").isNotNull()) & F.col("e.hi").isNull(), 1).otherwise(0)
    total = F.col("near") + F.col("same") - F.col("twice") + alone
    best = F.when((F.col("same") > 0) | F.col("train"), 1.0).otherwise(F.col("agree") / (2.0 * RING))
    return rows.select("image_id", "source", "val", "test", total.alias("counterparts"), best.alias("coverage"), F.coalesce("seeds", F.lit(0)).alias("seeds")).where("counterparts > 0")


def _prepared(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, Workspace]:
    ws = Workspace(spark, name)
    images = table(spark, folder, "image_record", "image_id", "source", "phash", "dhash", "pixel_md5")
    return ws.keep(listed_images(images, table(spark, folder, "official_split", "image_id", "split")), "listed"), ws


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    listed, ws = _prepared(spark, folder, "p2")
    found = overlaps(listed, ws)
    return found.select(F.least("eval_id", "train_id").alias("image_id_a"), F.greatest("eval_id", "train_id").alias("image_id_b")).distinct()


def p2_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """(image_id, counterparts, coverage): each overlapping evaluation image."""
    listed, ws = _prepared(spark, folder, "p2c")
    return counterparts(listed, ws).select("image_id", "counterparts", "coverage")


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    """(split, source, images, overlapping, pairs, share, coverage): per evaluation split and source.

    share is that of the source's images with a counterpart in train, coverage the mean of
    their best agreement with it, as in ``p2_coverage``; null if there are none.
    """
    listed, ws = _prepared(spark, folder, "p2r")
    found = ws.keep(counterparts(listed, ws), "found")
    splits = F.explode(F.array_compact(F.array(F.when(F.col("val"), "val"), F.when(F.col("test"), "test")))).alias("split")
    whole = listed.where("val or test").select("source", splits).groupBy("split", "source").agg(F.count("*").alias("images"))
    part = found.select("source", splits, "counterparts", "coverage").groupBy("split", "source").agg(F.count("*").alias("overlapping"), F.sum("counterparts").alias("pairs"), F.avg("coverage").alias("coverage"))
    zero = F.lit(0)
    return whole.join(part, ["split", "source"], "left").select(
        "split", "source", "images", F.coalesce("overlapping", zero).alias("overlapping"), F.coalesce("pairs", zero).alias("pairs"), (F.coalesce("overlapping", zero) / F.col("images")).alias("share"), "coverage"
    )
