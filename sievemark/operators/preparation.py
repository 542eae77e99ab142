"""Constraints of a dataset's preparation: annotation documents, label files, batches; and joins that insist.

Checks come in two forms: as a relation of faults, and strict, raising ConstraintError at the first
rows found. Strict forms run a job each and return their input unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import numbered
from .validate import ConstraintError, box_fault, label_fault, polygon_fault, require_empty, require_same_members, require_unique
from ..storage import Workspace


def segmentation_faults(polygons: Column, width: Column, height: Column) -> Column:
    """How many faults an annotation's polygons have: one if there are none, else one for each bad polygon."""
    bad = F.size(F.filter(polygons, lambda p: polygon_fault(p, width, height)))
    return F.when(F.coalesce(F.size(polygons), F.lit(0)) <= 0, 1).otherwise(bad)


def annotation_faults(images: DataFrame, annotations: DataFrame, records: DataFrame) -> DataFrame:
    """(fault, key, n) of annotation documents against the inventory.

    ``images`` (id, file_name, width, height), ``annotations`` (id, image_id, bbox, segmentation), ``records``
    (image_id, width, height, fractured). Faults: image_unknown, size_mismatch, annotation_without_image, invalid_bbox,
    invalid_segmentation (n may exceed one for an annotation of several polygons), image_without_annotation,
    positive_missing, image_not_positive. Keys are file names, or annotation ids as text.
    """
    known = records.select(F.col("image_id").alias("file_name"), F.col("width").alias("_w"), F.col("height").alias("_h"), "fractured", F.lit(True).alias("_known"))
    seen = images.join(known, "file_name", "left")
    unlike = ~(F.col("width").eqNullSafe(F.col("_w")) & F.col("height").eqNullSafe(F.col("_h")))
    image_fault = F.when(F.col("_known").isNull(), "image_unknown").when(unlike, "size_mismatch")
    one = F.lit(1).cast("bigint").alias("n")
    sized = annotations.select(F.col("id").alias("_id"), F.col("image_id").alias("id"), "bbox", "segmentation").join(images.select("id", F.lit(True).alias("_there"), "width", "height"), "id", "left")
    at = lambda i: F.get("bbox", F.lit(i))
    there = F.col("_there").isNotNull()
    counts = {
        "annotation_without_image": F.when(there, 0).otherwise(1),
        "invalid_bbox": F.when(there & box_fault(at(0), at(1), at(2), at(3), F.col("width"), F.col("height")), 1).otherwise(0),
        "invalid_segmentation": F.when(there, segmentation_faults(F.col("segmentation"), F.col("width"), F.col("height"))).otherwise(0),
    }
    each = sized.select(F.col("_id").cast("string").alias("key"), F.inline(F.array(*[F.struct(F.lit(k).alias("fault"), v.cast("bigint").alias("n")) for k, v in counts.items()]))).where("n > 0")
    names, positives = images.select("file_name"), records.where("fractured = 1").select(F.col("image_id").alias("file_name"))
    lone = lambda rows, fault: rows.select(F.lit(fault).alias("fault"), F.col("file_name").alias("key"), one)
    return (
        seen.select(image_fault.alias("fault"), F.col("file_name").alias("key"), one).where("fault is not null")
        .union(each.select("fault", "key", "n"))
        .union(lone(images.join(annotations.select(F.col("image_id").alias("id")), "id", "left_anti"), "image_without_annotation"))
        .union(lone(positives.join(names, "file_name", "left_anti"), "positive_missing"))
        .union(lone(names.join(positives, "file_name", "left_anti"), "image_not_positive"))
    )


def strict_labels(lines: DataFrame, stem: str = "stem") -> DataFrame:
    """(stem, lines) of label files, raising if any line has a fault or a file has no line. A null line is none."""
    require_empty(lines.select(stem, "line", label_fault().alias("fault")).where("fault is not null"), "bad label line")
    counts = lines.groupBy(stem).agg(F.count("line").alias("lines"))
    require_empty(counts.where("lines = 0").select(stem), "label file without a line")
    return counts


def preparation_faults(manifest: DataFrame, labels: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(fault, key) of a prepared set: ``manifest`` (image_id, split, fractured), ``labels`` (image_id, lines).

    Faults: repeated_image, unknown_split, split_size (a split of ``expected`` with another number of images),
    positive_without_label and negative_with_label (null lines are none).
    """
    spark = manifest.sparkSession
    wanted = spark.createDataFrame(sorted(expected.items()), "split string, wanted bigint")
    sizes = manifest.groupBy("split").agg(F.count("*").alias("n"))
    counted = manifest.join(labels.groupBy("image_id").agg(F.sum("lines").alias("lines")), "image_id", "left").withColumn("lines", F.coalesce("lines", F.lit(0)))
    label = F.when((F.col("fractured") == 1) & (F.col("lines") == 0), "positive_without_label").when((F.col("fractured") == 0) & (F.col("lines") > 0), "negative_with_label")
    return (
        manifest.groupBy("image_id").count().where("count > 1").select(F.lit("repeated_image").alias("fault"), F.col("image_id").alias("key"))
        .union(manifest.join(wanted, "split", "left_anti").select(F.lit("unknown_split"), "image_id"))
        .union(wanted.join(sizes, "split", "left").where("wanted != coalesce(n, 0)").select(F.lit("split_size"), "split"))
        .union(counted.select(label.alias("fault"), "image_id").where("fault is not null"))
    )


def strict_preparation(manifest: DataFrame, labels: DataFrame, expected: dict[str, int]) -> DataFrame:
    """The manifest, if ``preparation_faults`` finds nothing."""
    require_empty(preparation_faults(manifest, labels, expected), "the prepared set")
    return manifest


def materialised(manifest: DataFrame) -> DataFrame:
    """``manifest`` (image_id, split, fractured, decode_status) with where its files go and how they come there.

    action: reencode for a recovered image, else link; label_action: link for a positive, else empty.
    """
    name = F.regexp_replace("image_id", r"\.[^.]*$", "")
    return manifest.select(
        "*", F.concat_ws("/", F.lit("images"), "split", "image_id").alias("image_path"), F.concat(F.lit("labels/"), F.col("split"), F.lit("/"), name, F.lit(".txt")).alias("label_path"),
        F.when(F.col("decode_status").contains("recovered"), "reencode").otherwise("link").alias("action"), F.when(F.col("fractured") == 1, "link").otherwise("empty").alias("label_action"),
    )


def batch_faults(samples: DataFrame) -> DataFrame:
    """(image_id, fault) of training samples: ``samples`` (image_id, fractured, width, height, channels, boxes, masks, mask_width, mask_height).

    The first fault of a sample counts: channels other than three, unlike numbers of boxes and masks, masks of another
    size than the image, a negative with boxes, a positive without. Nulls in a count read zero.
    """
    n, m = F.coalesce("boxes", F.lit(0)), F.coalesce("masks", F.lit(0))
    unlike = ~(F.col("mask_width").eqNullSafe(F.col("width")) & F.col("mask_height").eqNullSafe(F.col("height")))
    fault = (
        F.when(~F.col("channels").eqNullSafe(F.lit(3)), "channels").when(n != m, "box_mask_count").when((m > 0) & unlike, "mask_size")
        .when((F.col("fractured") == 0) & (n > 0), "negative_with_box").when((F.col("fractured") == 1) & (n == 0), "positive_without_box")
    )
    return samples.select("image_id", fault.alias("fault")).where("fault is not null")


def strict_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The inner join of two relations with the same, unique keys; raises if they are not."""
    for side in (left, right):
        require_unique(side, key)
    require_same_members(left, right, key)
    return left.join(right, key)


def strict_lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Each row with the table's row of its key; raises for keys that the table lacks, null included, or has twice."""
    require_unique(table, key)
    require_empty(rows.select(key).where(F.col(key).isNull()), f"null {key}")
    require_empty(rows.select(key).join(table.select(key), key, "left_anti"), f"{key} not found")
    return rows.join(table, key)


def strict_zip(left: DataFrame, right: DataFrame, ws: Workspace, left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """Rows paired by their place along each side's total order; raises if the sides differ in length."""
    a, b = ws.keep(numbered(left, ws, left_order, "_place"), "left"), ws.keep(numbered(right, ws, right_order, "_place"), "right")
    if (n := a.count()) != (m := b.count()):
        raise ConstraintError(f"sides of {n} and {m} rows")
    return a.join(b, "_place").drop("_place")
