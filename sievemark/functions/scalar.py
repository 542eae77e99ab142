"""Scalar functions of the audit and evaluation, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CLIP = 1e-7


def joined_flags(flags: list[str], default: str = "unknown") -> Column:
    """Names of the flags equal to 1, joined by +, in the order given; ``default`` if none."""
    parts = F.concat_ws("+", *[F.when(F.col(c) == 1, F.lit(c)) for c in flags])
    return F.when(parts == "", F.lit(default)).otherwise(parts)


def first_flag(flags: list[str], default: str = "unknown") -> Column:
    """The first flag equal to 1."""
    return F.coalesce(*[F.when(F.col(c) == 1, F.lit(c)) for c in flags], F.lit(default))


def canonical_path(image_id: Column, fractured: Column) -> Column:
    """images/<folder by label>/<id>"""
    return F.concat(F.lit("images/"), F.when(fractured == 1, "Fractured").otherwise("Non_fractured"), F.lit("/"), image_id)


def with_suffix(name: Column, suffix: str) -> Column:
    """The file name with its last suffix replaced."""
    return F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit(suffix))


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits of two 64-bit patterns."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming_hex(a: Column, b: Column) -> Column:
    """The same for two hexadecimal texts of at most 16 digits."""
    return hamming(F.conv(a, 16, -10).cast("bigint"), F.conv(b, 16, -10).cast("bigint"))


def bits_to_long(bits: Column) -> Column:
    """An array of 64 booleans, first one highest, as a bit pattern."""
    weighted = F.transform(bits, lambda b, i: F.when(b, F.expr("1L")).otherwise(F.expr("0L")))
    return F.aggregate(weighted, F.expr("0L"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))


def bits_to_hex(bits: Column) -> Column:
    """The same as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(bits_to_long(bits)), 16, "0"))


def perceptual_bits(block: Column) -> Column:
    """Bits of an 8 x 8 block of frequencies: value above the median of the 63 after the first."""
    median = F.get(F.array_sort(F.slice(block, 2, 63)), F.lit(31))
    return F.transform(block, lambda v: v > median)


def difference_bits(rows: Column) -> Column:
    """Bits of eight rows of nine values (72 in one array): right one above left one."""
    places = F.sequence(F.lit(0), F.lit(63))
    at = lambda i: F.get(rows, i)
    return F.transform(places, lambda i: at(F.floor(i / 8).cast("int") * 9 + i % 8 + 1) > at(F.floor(i / 8).cast("int") * 9 + i % 8))


def structural_similarity(a: Column, b: Column, peak: float = 255.0) -> Column:
    """One-window SSIM of two equally long arrays; 0 where its denominator is 0."""
    n = F.size(a).cast("double")
    zero = F.lit(0.0)
    total = lambda x: F.aggregate(x, zero, lambda s, v: s + v)
    mean_a, mean_b = total(a) / n, total(b) / n
    var_a = total(F.transform(a, lambda v: v * v)) / n - mean_a * mean_a
    var_b = total(F.transform(b, lambda v: v * v)) / n - mean_b * mean_b
    covariance = total(F.zip_with(a, b, lambda x, y: x * y)) / n - mean_a * mean_b
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    below = (mean_a * mean_a + mean_b * mean_b + c1) * (var_a + var_b + c2)
    return F.when(below == 0, 0.0).otherwise((2 * mean_a * mean_b + c1) * (2 * covariance + c2) / below)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def temperature_scaled(p: Column, temperature: Column | float) -> Column:
    """A probability with its logit divided by the temperature; both are clipped away from 0 and 1."""
    t = F.lit(temperature) if isinstance(temperature, float) else temperature
    clipped = F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), p))
    return sigmoid(F.log(clipped / (1 - clipped)) / t)


def confidence_tier(score: Column, medium: float, high: float) -> Column:
    """high, medium or low; scores outside [0, 1] and null give null."""
    if medium > high:
        raise ValueError("the medium cut-off lies above the high one")
    return F.when((score < 0) | (score > 1), None).when(score >= high, "high").when(score >= medium, "medium").when(score.isNotNull(), "low")


def safe_ratio(a: Column, b: Column) -> Column:
    """a / max(1, b)"""
    return a / F.greatest(b, F.lit(1))


def nan_ratio(a: Column, b: Column) -> Column:
    """a / b, NaN where b is 0."""
    return F.when(b == 0, F.lit(float("nan"))).otherwise(a / b)


def corners_from_xywh(x: Column, y: Column, w: Column, h: Column) -> list[Column]:
    return [x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2")]


def corners_from_yolo(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> list[Column]:
    """Normalised centre and size to pixel corners."""
    return [((cx - w / 2) * width).alias("x1"), ((cy - h / 2) * height).alias("y1"), ((cx + w / 2) * width).alias("x2"), ((cy + h / 2) * height).alias("y2")]


def iou(a: str, b: str) -> Column:
    """Intersection over union of two corner boxes with column prefixes a and b; 0 without union."""
    x1, y1, x2, y2 = ((F.col(f"{a}{c}"), F.col(f"{b}{c}")) for c in ("x1", "y1", "x2", "y2"))
    zero = F.lit(0.0)
    overlap = F.greatest(F.least(*x2) - F.greatest(*x1), zero) * F.greatest(F.least(*y2) - F.greatest(*y1), zero)
    area = [F.greatest(x2[i] - x1[i], zero) * F.greatest(y2[i] - y1[i], zero) for i in (0, 1)]
    union = area[0] + area[1] - overlap
    return F.when(union > 0, overlap / union).otherwise(0.0)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often the expression names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def fixed(value: Column, digits: int) -> Column:
    """A double below about 1e6 in size with so many decimals, rounded from its exact binary value.

    The value is split so that the coarse part's product is exact; of the fine part's product the rounding error is
    computed too, by halving the factor's bits, and decides what looks like a tie. Exact ties go to the even digit.
    """
    power = float(10**digits)

    def split(size: Column) -> Column:
        coarse = F.floor(size * float(1 << 26)) / float(1 << 26)
        return bound(F.struct((coarse * power).alias("scaled"), (size - coarse).alias("fine")), halve)

    def halve(t: Column) -> Column:
        spread = t["fine"] * 134217729.0
        return bound(F.struct(t["scaled"].alias("scaled"), t["fine"].alias("fine"), (spread - (spread - t["fine"])).alias("high"), F.floor(t["scaled"]).alias("whole")), weigh)

    def weigh(t: Column) -> Column:
        product = t["fine"] * power
        error = (t["high"] * power - product) + (t["fine"] - t["high"]) * power
        # halves are even or odd with the whole part, so its last bit goes into the rounding
        bit = F.pmod(t["whole"], F.lit(2))
        return bound(F.struct(((t["scaled"] - t["whole"]) + product + bit).alias("rest"), error.alias("error"), (t["whole"] - bit).alias("even")), settle)

    def settle(t: Column) -> Column:
        below = F.floor(t["rest"])
        tie = t["rest"] - below == 0.5
        return (t["even"] + F.when(tie & (t["error"] > 0), below + 1).when(tie & (t["error"] < 0), below).otherwise(F.rint(t["rest"]))).cast("bigint")

    def show(number: Column) -> Column:
        return F.concat(F.floor(number / F.lit(10**digits)).cast("string"), F.lit("."), F.lpad(F.pmod(number, F.lit(10**digits)).cast("string"), digits, "0"))

    return F.concat(F.when(value < 0, "-").otherwise(""), bound(split(F.abs(value)), show))


def yolo_polygon(points: Column, width: Column, height: Column) -> Column:
    """A polygon x, y, x, y... as a normalised label line of class 0; null if it is none.

    At least three points and an even count; values up to 1e-9 outside [0, 1] are clamped, others make it null.
    """
    scaled = F.transform(points, lambda v, i: v / F.when(i % 2 == 0, width).otherwise(height))
    good = (F.size(points) >= 6) & (F.size(points) % 2 == 0) & F.forall(scaled, lambda v: (v >= -1e-9) & (v <= 1 + 1e-9))
    texts = F.transform(scaled, lambda v: fixed(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)), 8))
    return F.when(good, F.concat(F.lit("0 "), F.array_join(texts, " ")))


def fused(classifier: Column, regions: Column) -> dict[str, Column]:
    """Decisions of a classifier and a detector combined; negative region counts give null."""
    found = F.when(regions >= 0, regions > 0)
    agree = classifier == found
    return {
        "local_evidence": found,
        "triage_positive": classifier | found,
        "strict_positive": classifier & found,
        "agreement": agree,
        "review_required": ~agree,
        "status": F.when(agree & classifier, "fracture_signal_with_local_evidence")
        .when(agree, "no_fracture_signal")
        .when(found.isNull(), None)
        .when(classifier, "global_signal_without_local_evidence")
        .otherwise("local_evidence_without_global_signal"),
    }


def error_category(label: Column, classifier: Column, detector: Column) -> Column:
    """Which of the eight cells of (label, classifier, detector) a row is in."""
    y, c, d = label == 1, classifier == 1, detector == 1
    return (
        F.when(y & c & d, "consensus_true_positive")
        .when(y & c, "detector_miss_classifier_rescue")
        .when(y & d, "classifier_miss_detector_rescue")
        .when(y, "both_miss")
        .when(c & d, "both_false_alarm")
        .when(c, "classifier_only_false_alarm")
        .when(d, "detector_only_false_alarm")
        .otherwise("consensus_true_negative")
    )


def category_rank(category: Column, classifier_score: Column, detector_score: Column) -> Column:
    """The score by which examples of a category are ranked, greatest first."""
    local = F.coalesce(detector_score, F.lit(0.0))
    return (
        F.when(category.isin("classifier_miss_detector_rescue", "detector_only_false_alarm", "both_false_alarm"), local)
        .when(category == "both_miss", -classifier_score)
        .otherwise(classifier_score)
    )


def error_type(label: Column, prediction: Column) -> Column:
    return F.when((label == 1) & (prediction == 0), "false_negative").when((label == 0) & (prediction == 1), "false_positive").otherwise("correct")
