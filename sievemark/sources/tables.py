"""Readers for parquet tables, by explicit column list so that scans stay narrow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import digest128, hash64, reference_key


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The named parquet table under ``folder``, only with ``columns`` if any are given."""
    frame = spark.read.parquet(f"{folder}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def hashed_images(image_record: DataFrame) -> DataFrame:
    """(image_id, p, d, hi, lo): one row per image with its hash values as bit patterns.

    Deliveries of an image are one row; where they disagree the greatest value holds.
    A null image_id names no image. Missing values are null; hi and lo are both null or not.
    """
    digest = digest128(F.col("pixel_md5"))
    return (
        image_record.where(F.col("image_id").isNotNull())
        .select("image_id", hash64(F.col("phash")).alias("p"), hash64(F.col("dhash")).alias("d"), digest.alias("m"))
        .select("image_id", "p", "d", F.col("m.hi").alias("hi"), F.col("m.lo").alias("lo"))
        .groupBy("image_id")
        .agg(*[F.max(c).alias(c) for c in ("p", "d", "hi", "lo")])
    )


def image_keys(image_record: DataFrame) -> DataFrame:
    """(image_key, image_id): how references name an image, and how image_record writes it.

    Should two ids differ only in case or outer white space, the smaller one is meant.
    """
    return (
        image_record.where(F.col("image_id").isNotNull())
        .groupBy(reference_key(F.col("image_id")).alias("image_key"))
        .agg(F.min("image_id").alias("image_id"))
    )
