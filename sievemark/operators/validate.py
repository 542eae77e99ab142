"""Constraint checks: each returns the violations, or counts of them, as a relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import bound

SLACK = 1e-3


class ConstraintError(ValueError):
    """A constraint that must hold does not."""


def require_empty(violations: DataFrame, what: str) -> None:
    """Raises if there is any violation; shows up to three. Stops at the first rows found."""
    some = violations.take(3)
    if some:
        raise ConstraintError(f"{what}: {[r.asDict() for r in some]}")


def require_unique(frame: DataFrame, key: str) -> None:
    """Raises unless the column exists, is never null or empty, and has no repeated value."""
    if key not in frame.columns:
        raise ConstraintError(f"column {key} is missing")
    require_empty(frame.where(F.col(key).isNull() | (F.col(key).cast("string") == "")).select(key), f"{key} is missing in rows")
    require_empty(frame.groupBy(key).count().where("count > 1"), f"{key} is repeated")


def require_same_members(left: DataFrame, right: DataFrame, key: str) -> None:
    require_empty(left.select(key).join(right.select(key), key, "left_anti"), f"{key} only on the left")
    require_empty(right.select(key).join(left.select(key), key, "left_anti"), f"{key} only on the right")


def box_fault(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Whether a corner-and-size box is degenerate or out of its frame; null parts are a fault."""
    return F.coalesce((w <= 0) | (h <= 0) | (x < 0) | (y < 0) | (x + w > width + SLACK) | (y + h > height + SLACK), F.lit(True))


def polygon_fault(points: Column, width: Column, height: Column) -> Column:
    """Whether a polygon x, y, x, y... has under three points, an odd count or leaves the frame."""
    xs, ys = F.filter(points, lambda v, i: i % 2 == 0), F.filter(points, lambda v, i: i % 2 == 1)
    outside = (F.array_min(xs) < 0) | (F.array_min(ys) < 0) | (F.array_max(xs) > width + SLACK) | (F.array_max(ys) > height + SLACK)
    return F.coalesce((F.size(points) < 6) | (F.size(points) % 2 == 1) | outside, F.lit(True))


def label_fields(line: Column) -> Column:
    """A YOLO label line's fields."""
    return F.split(F.trim(line), r"\s+")


def label_fault(line: str = "line") -> Column:
    """malformed, out of range, or null for a good label line of class 0; a null line is no line."""

    def numbers(parts: Column) -> Column:
        return bound(F.transform(parts, lambda x: x.try_cast("double")), fault)

    def fault(v: Column) -> Column:
        malformed = (F.size(v) != 5) | F.exists(v, lambda x: x.isNull())
        at = lambda i: F.get(v, F.lit(i))
        outside = (at(0) != 0) | (at(3) <= 0) | (at(4) <= 0) | F.exists(F.slice(v, 2, 4), lambda x: (x < 0) | (x > 1) | F.isnan(x))
        return F.when(malformed, "malformed").when(outside, "out of range")

    return F.when(F.col(line).isNotNull(), bound(label_fields(F.col(line)), numbers))


def split_listing_faults(listing: DataFrame, positives: DataFrame) -> DataFrame:
    """(fault, image_key): ids listed more than once, positives not listed, listed ids not positive.

    ``listing`` (image_key) has a row per listing; ``positives`` (image_key) are distinct.
    """
    listed = listing.groupBy("image_key").agg(F.count("*").alias("n"))
    return (
        listed.where("n > 1").select(F.lit("repeated").alias("fault"), "image_key")
        .union(positives.join(listed, "image_key", "left_anti").select(F.lit("positive_not_listed").alias("fault"), "image_key"))
        .union(listed.join(positives, "image_key", "left_anti").select(F.lit("listed_not_positive").alias("fault"), "image_key"))
    )


def archive_gate(size: Column, digest: Column, expected_size: int, expected_digest: str) -> Column:
    """accepted, size mismatch or digest mismatch; size is checked first, the digest without case."""
    return F.when(size != expected_size, "size mismatch").when(F.lower(digest) != expected_digest.lower(), "digest mismatch").when(size.isNotNull() & digest.isNotNull(), "accepted")


def upload_gate(content_type: Column, size: Column, limit: int = 25 * 1024 * 1024) -> Column:
    """HTTP status an upload deserves: 415 for another type, 413 for none or too many bytes, else 200."""
    good = content_type.startswith("image/") | (content_type == "application/octet-stream")
    return F.when(~F.coalesce(good, F.lit(False)), 415).when(~F.coalesce((size >= 1) & (size <= limit), F.lit(False)), 413).otherwise(200)
