"""Box operators: suppression, matching, threshold sweeps, alignment.

Boxes are rows (image, box, conf, x1, y1, x2, y2), targets rows (image, box, x1...).
The sequential rules (greedy suppression, greedy matching) run on Arrow batches of whole images
after rows have been brought together by image and sorted: images with the same number of boxes
take each step together, as arrays. A task holds a batch, and of an image that exceeds one all boxes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import Workspace
from .ordered import running

CORNERS = ["x1", "y1", "x2", "y2"]


#: Images with more boxes than this are worked on one by one; cells of the IoU arrays made at a time.
MANY, CELLS = 64, 1 << 21


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """IoU of each box in a (..., m, 4) with each in b (..., n, 4); 0 where the union is empty."""
    left, right = np.moveaxis(a, -1, 0)[..., :, None], np.moveaxis(b, -1, 0)[..., None, :]

    def extent(i: int) -> np.ndarray:
        return np.maximum(np.minimum(left[i + 2], right[i + 2]) - np.maximum(left[i], right[i]), 0.0)

    def area(box: np.ndarray) -> np.ndarray:
        return np.maximum(box[2] - box[0], 0.0) * np.maximum(box[3] - box[1], 0.0)

    shared = extent(0) * extent(1)
    union = area(left) + area(right) - shared
    return np.where(union > 0, shared / np.where(union > 0, union, 1.0), 0.0)


def _kept(overlap: np.ndarray, limit: float) -> np.ndarray:
    """(n, m): greedy suppression in n images of m boxes each, boxes in order of falling confidence."""
    over = overlap > limit
    kept = np.ones(over.shape[:2], bool)
    for i in range(1, over.shape[1]):
        kept[:, i] = ~(over[:, i, :i] & kept[:, :i]).any(axis=1)
    return kept


def _paired(overlap: np.ndarray, threshold: float, usable: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """((n, boxes) target or -1, IoU): one-to-one matching in n images at once, given (n, boxes, targets)."""
    n, boxes, targets = overlap.shape
    found, value, free, every = np.full((n, boxes), -1), np.zeros((n, boxes)), np.ones((n, targets), bool), np.arange(n)
    for i in range(boxes if targets else 0):
        open_ = np.where(free, overlap[:, i], -1.0)
        best = open_.argmax(axis=1)
        most = open_[every, best]
        hit = (most >= threshold) & (most >= 0)
        if usable is not None:
            hit &= usable[:, i]
        found[hit, i], value[hit, i] = best[hit], most[hit]
        free[every[hit], best[hit]] = False
    return found, value


def suppressed(boxes: np.ndarray, iou_threshold: float) -> np.ndarray:
    """Places kept by greedy suppression of one image's boxes, in order of falling confidence; memory by MANY x kept."""
    kept = np.zeros(0, np.int64)
    for start in range(0, len(boxes), MANY):
        block = np.arange(start, min(start + MANY, len(boxes)))
        block = block[~(iou_matrix(boxes[block], boxes[kept]) > iou_threshold).any(axis=1)]
        kept = np.concatenate([kept, block[_kept(iou_matrix(boxes[block], boxes[block])[None], iou_threshold)[0]]]) if len(block) else kept
    return kept


def matched(targets: np.ndarray, boxes: np.ndarray, iou_threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(target or -1, IoU) of each box of one image, boxes in order of falling confidence.

    Each box takes the unmatched target it overlaps most (the earliest of equals), if enough.
    """
    found, value = _paired(iou_matrix(boxes, targets)[None], iou_threshold)
    return found[0], value[0]


def alike(sizes: np.ndarray, cells: np.ndarray) -> Iterator[np.ndarray]:
    """Places of images with the same sizes (n, k), so many at a time that their arrays have CELLS cells; large ones one by one."""
    order = np.lexsort(sizes.T)
    cuts = np.flatnonzero((np.diff(sizes[order], axis=0) != 0).any(axis=1)) + 1
    for group in np.split(order, cuts) if len(order) else []:
        step = 1 if sizes[group[0]].max() > MANY else max(1, int(CELLS // max(1, cells[group[0]])))
        yield from (group[i : i + step] for i in range(0, len(group), step))


def per_image(rows: DataFrame, image: str, order: list, function: Callable[[pa.Table, np.ndarray], pa.Table], schema) -> DataFrame:
    """Applies a function to whole images, many at a time, each image's rows sorted by ``order``.

    Rows are hash-partitioned and sorted by image in the JVM; Python sees Arrow batches and
    holds back only the image that the next batch may continue. The function gets a batch's images and
    where each begins, with the end as last entry.
    """
    names = [f.name for f in schema.fields]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # pieces of one image, so that a long one is not copied again and again
        def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            keys = table[image].to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            yield from function(table, starts).select(names).combine_chunks().to_batches()

        for part in parts:
            if not part.num_rows:
                continue
            keys = part[image].to_numpy(zero_copy_only=False)
            last = int(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[-1])
            if held and keys[0] == held[0][image][0].as_py() and last == 0:
                held.append(part)
                continue
            whole = [*held, part.slice(0, last)]
            if sum(p.num_rows for p in whole):
                yield from run(pa.Table.from_batches(whole))
            held = [part.slice(last)]
        if held:
            yield from run(pa.Table.from_batches(held))

    return rows.repartition(image).sortWithinPartitions(image, *order).mapInArrow(batches, schema)


def _corners(table: pa.Table) -> np.ndarray:
    return np.column_stack([table[c].to_numpy(zero_copy_only=False) for c in CORNERS]).astype(np.float64).reshape(-1, 4)


def suppress(boxes: DataFrame, iou_threshold: float) -> DataFrame:
    """The boxes (image, box, conf, corners) kept by class-agnostic greedy suppression.

    Boxes go by falling confidence, ties by box. A box goes if its IoU with one kept exceeds the threshold.
    """
    if not 0 <= iou_threshold <= 1:
        raise ValueError("the IoU threshold lies outside [0, 1]")
    clean = boxes.where("image is not null and conf is not null").select("image", "box", "conf", *CORNERS)

    def keep(table: pa.Table, starts: np.ndarray) -> pa.Table:
        corners, size = _corners(table), np.diff(starts)
        kept = np.zeros(len(corners), bool)
        for group in alike(size[:, None], size * size):
            if size[group[0]] > MANY:
                kept[starts[group[0]] + suppressed(corners[starts[group[0]] : starts[group[0] + 1]], iou_threshold)] = True
                continue
            at = starts[group][:, None] + np.arange(size[group[0]])
            kept[at] = _kept(iou_matrix(corners[at], corners[at]), iou_threshold)
        return table.filter(pa.array(kept))

    return per_image(clean, "image", [F.col("conf").desc(), F.col("box")], keep, clean.schema)


def _both(targets: DataFrame, boxes: DataFrame) -> DataFrame:
    """Targets and boxes as rows of one kind; within an image targets come first, then boxes by falling confidence."""
    clean = boxes.where("image is not null and conf is not null").select("image", "box", F.col("conf").cast("double").alias("conf"), F.lit(False).alias("is_target"), *CORNERS)
    aims = targets.where("image is not null").select("image", "box", F.lit(None).cast("double").alias("conf"), F.lit(True).alias("is_target"), *CORNERS)
    return aims.union(clean)


def _order() -> list[Column]:
    return [F.col("is_target").desc(), F.col("conf").desc(), F.col("box")]


def _sides(table: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(is_target, number of targets, number of boxes) of a batch's images."""
    is_target = table["is_target"].to_numpy(zero_copy_only=False).astype(bool)
    aims = np.add.reduceat(is_target.astype(np.int64), starts[:-1]) if len(starts) > 1 else np.zeros(0, np.int64)
    return is_target, aims, np.diff(starts) - aims


def match(targets: DataFrame, boxes: DataFrame, iou_threshold: float = 0.5) -> DataFrame:
    """(image, box, conf, target, iou): every box with the target it is matched to, or nulls.

    One-to-one, boxes by falling confidence (ties by box), targets by box id. Boxes of images without
    targets come out unmatched.
    """
    rows = _both(targets, boxes)
    kinds = [("image", rows.schema["image"].dataType), ("box", boxes.schema["box"].dataType), ("conf", T.DoubleType()), ("target", targets.schema["box"].dataType), ("iou", T.DoubleType())]
    out = T.StructType([T.StructField(n, k) for n, k in kinds])

    def pair(table: pa.Table, starts: np.ndarray) -> pa.Table:
        corners = _corners(table)
        is_target, aims, own = _sides(table, starts)
        target, value = np.full(len(corners), -1), np.zeros(len(corners))
        for group in alike(np.column_stack([aims, own]), aims * own):
            t, b = aims[group[0]], own[group[0]]
            if not t or not b:
                continue
            first = starts[group][:, None]
            at = first + t + np.arange(b)
            found, value[at] = _paired(iou_matrix(corners[at], corners[first + np.arange(t)]), iou_threshold)
            target[at] = np.where(found >= 0, first + found, -1)
        hit = target >= 0
        boxes_ = pa.array(~is_target)
        return pa.table({
            "image": table["image"], "box": table["box"], "conf": table["conf"],
            "target": table["box"].combine_chunks().take(pa.array(target, mask=~hit)), "iou": pa.array(value, mask=~hit),
        }).filter(boxes_)

    return per_image(rows, "image", _order(), pair, out)


def suppression_sweep(targets: DataFrame, boxes: DataFrame, limits: list[float], iou_threshold: float = 0.5) -> DataFrame:
    """(image, nms_iou, ground_truth_instances, boxes, kept, tp): each image under suppression at each limit, then matched.

    One pass for all limits: an image's overlaps are computed once and its boxes are shuffled once.
    """
    rows = _both(targets, boxes)
    kinds = [("image", rows.schema["image"].dataType), ("nms_iou", T.DoubleType()), *[(n, T.LongType()) for n in ("ground_truth_instances", "boxes", "kept", "tp")]]
    out = T.StructType([T.StructField(n, k) for n, k in kinds])

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        corners = _corners(table)
        _, aims, own = _sides(table, starts)
        kept, hits = (np.zeros((len(own), len(limits)), np.int64) for _ in range(2))
        for group in alike(np.column_stack([aims, own]), own * (own + aims)):
            t, b = aims[group[0]], own[group[0]]
            first = starts[group][:, None]
            at, on = first + t + np.arange(b), first + np.arange(t)
            if b > MANY:
                alone = corners[at[0]]
                for k, limit in enumerate(limits):
                    left = suppressed(alone, limit)
                    kept[group[0], k], hits[group[0], k] = len(left), (matched(corners[on[0]], alone[left], iou_threshold)[0] >= 0).sum()
                continue
            among, across = iou_matrix(corners[at], corners[at]), iou_matrix(corners[at], corners[on])
            for k, limit in enumerate(limits):
                left = _kept(among, limit)
                kept[group, k] = left.sum(axis=1)
                hits[group, k] = (_paired(across, iou_threshold, left)[0] >= 0).sum(axis=1)
        n = len(limits)
        return pa.table({
            "image": table["image"].combine_chunks().take(pa.array(np.repeat(starts[:-1], n))), "nms_iou": pa.array(np.tile(np.array(limits, np.float64), len(own))),
            "ground_truth_instances": np.repeat(aims, n), "boxes": np.repeat(own, n), "kept": kept.ravel(), "tp": hits.ravel(),
        })

    return per_image(rows, "image", _order(), run, out)


def image_counts(targets: DataFrame, boxes: DataFrame, matches: DataFrame) -> DataFrame:
    """(image, ground_truth_instances, predictions, tp, fp, fn, max_confidence) of every image with either."""
    gt = targets.groupBy("image").agg(F.count("*").alias("gt"))
    own = matches.groupBy("image").agg(F.count("*").alias("pred"), F.count("target").alias("hit"), F.max("conf").alias("max_confidence"))
    zero = F.lit(0)
    return gt.join(own, "image", "full").select(
        "image", F.coalesce("gt", zero).alias("ground_truth_instances"), F.coalesce("pred", zero).alias("predictions"), F.coalesce("hit", zero).alias("tp"),
        (F.coalesce("pred", zero) - F.coalesce("hit", zero)).alias("fp"), (F.coalesce("gt", zero) - F.coalesce("hit", zero)).alias("fn"), "max_confidence",
    )


def detection_summary(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Micro-averaged counts and ratios, with the false alarms on images without targets."""
    clean = F.col("ground_truth_instances") == 0
    total = counts.groupBy(*by).agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.count_if(clean).alias("negative_images"),
        F.coalesce(F.sum(F.when(clean, F.col("fp"))), F.lit(0)).alias("false_positives_on_negative_images"), F.count_if(clean & (F.col("fp") > 0)).alias("_alarms"),
    )
    return _ratios(total).drop("_alarms")


def _ratios(total: DataFrame) -> DataFrame:
    one = F.lit(1)
    return (
        total.withColumn("precision", F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), one))
        .withColumn("lesion_sensitivity", F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), one))
        .withColumn("f1", 2 * F.col("precision") * F.col("lesion_sensitivity") / F.greatest(F.col("precision") + F.col("lesion_sensitivity"), F.lit(1e-12)))
        .withColumn("false_positives_per_negative_image", F.col("false_positives_on_negative_images") / F.greatest("negative_images", one))
        .withColumn("negative_image_false_alarm_rate", F.col("_alarms") / F.greatest("negative_images", one))
    )


def sweep(targets: DataFrame, matches: DataFrame, images: DataFrame, thresholds: list[float]) -> DataFrame:
    """Detection summary at each threshold from one matching.

    Greedy matching goes by falling confidence, so what it does above a threshold does not
    depend on what lies below it. Each box counts at the thresholds up to its confidence: boxes are
    binned by the highest such threshold, and the bins, at most one per threshold, are summed from above.
    ``images``: all images, with or without boxes.
    """
    spark = matches.sparkSession
    ordered = sorted(thresholds)

    def reached(low: int, high: int) -> Column:
        """Number of thresholds that the confidence reaches, known to be from low to high: a binary search, as one expression."""
        if low == high:
            return F.lit(low)
        middle = (low + high + 1) // 2
        return F.when(F.col("conf") >= ordered[middle - 1], reached(middle, high)).otherwise(reached(low, middle - 1))

    reach = reached(0, len(ordered))
    totals = targets.select(F.count("*").alias("gt")).first()["gt"]
    clean = images.select("image").distinct().join(targets.select("image").distinct(), "image", "left_anti")
    negatives = clean.count()
    marked = matches.withColumn("_reach", reach).where("_reach > 0")
    hits = marked.groupBy("_reach").agg(F.count("target").alias("tp"), F.count("*").alias("pred"))
    on_clean = marked.join(clean, "image", "left_semi")
    alarms = on_clean.groupBy("_reach").agg(F.count("*").alias("fp_clean"))
    first = on_clean.groupBy("image").agg(F.max("_reach").alias("_reach")).groupBy("_reach").agg(F.count("*").alias("alarms"))
    base = spark.createDataFrame([(i + 1, t) for i, t in enumerate(ordered)], "_reach int, threshold double")
    from pyspark.sql import Window

    # As many rows as thresholds.
    above = Window.partitionBy(F.lit(1)).orderBy(F.col("_reach").desc()).rowsBetween(Window.unboundedPreceding, 0)
    table = base.join(hits, "_reach", "left").join(alarms, "_reach", "left").join(first, "_reach", "left")
    sums = {c: F.coalesce(F.sum(c).over(above), F.lit(0)) for c in ("tp", "pred", "fp_clean", "alarms")}
    out = table.select("threshold", sums["tp"].alias("tp"), (sums["pred"] - sums["tp"]).alias("fp"), (F.lit(totals) - sums["tp"]).alias("fn"), F.lit(negatives).alias("negative_images"), sums["fp_clean"].alias("false_positives_on_negative_images"), sums["alarms"].alias("_alarms"))
    return _ratios(out).drop("_alarms")


def select_threshold(curve: DataFrame) -> DataFrame:
    """The row of a sweep with the greatest f1, then fewest false alarms, then the lowest threshold."""
    return curve.orderBy(F.col("f1").desc(), F.col("false_positives_per_negative_image"), "threshold").limit(1)


def froc(targets: DataFrame, matches: DataFrame, images: DataFrame, ws: Workspace) -> DataFrame:
    """(conf, sensitivity, false_positives_per_image) at every confidence, by one distributed running total."""
    gt, n = targets.count(), images.select("image").distinct().count()
    steps = matches.groupBy("conf").agg(F.count("target").alias("_hit"), F.count_if(F.col("target").isNull()).alias("_miss"))
    run = running(steps, ws, [F.col("conf").desc()], {"tp": "_hit", "fp": "_miss"})
    return run.select("conf", (F.col("tp") / F.greatest(F.lit(gt), F.lit(1))).alias("sensitivity"), (F.col("fp") / F.greatest(F.lit(n), F.lit(1))).alias("false_positives_per_image"))


def bottleneck(a: np.ndarray, b: np.ndarray) -> float:
    """The least greatest coordinate difference over all one-to-one pairings; inf if sizes differ.

    Binary search over the differences, with augmenting paths as the test: any number of boxes.
    """
    if len(a) != len(b):
        return float("inf")
    if not len(a):
        return 0.0
    gap = np.abs(a[:, None, :] - b[None, :, :]).max(axis=2)
    levels = np.unique(gap)

    def possible(limit: float) -> bool:
        taken = np.full(len(b), -1)
        for start in range(len(a)):
            seen, stack, via = set(), [start], {}
            end = None
            while stack and end is None:
                row = stack.pop()
                for col in np.flatnonzero(gap[row] <= limit):
                    if col in seen:
                        continue
                    seen.add(col)
                    via[col] = row
                    if taken[col] < 0:
                        end = col
                        break
                    stack.append(int(taken[col]))
            if end is None:
                return False
            while True:
                row = via[end]
                before = [c for c in range(len(b)) if taken[c] == row]
                taken[end] = row
                if row == start:
                    break
                end = before[0]
        return True

    low, high = 0, len(levels) - 1
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if possible(levels[middle]) else (middle + 1, high)
    return float(levels[low])


def alignment_errors(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """(image, error): bottleneck distance of an image's boxes in two formats, for images with reference boxes."""
    a = reference.select("image", F.lit(0).alias("side"), *CORNERS)
    b = candidate.join(reference.select("image").distinct(), "image", "left_semi").select("image", F.lit(1).alias("side"), *CORNERS)
    schema = T.StructType([T.StructField("image", a.schema["image"].dataType), T.StructField("error", T.DoubleType())])

    def align(table: pa.Table, starts: np.ndarray) -> pa.Table:
        side, boxes = table["side"].to_numpy(zero_copy_only=False), _corners(table)
        errors = [bottleneck(boxes[a:b][side[a:b] == 0], boxes[a:b][side[a:b] == 1]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        return pa.table({"image": table["image"].combine_chunks().take(pa.array(starts[:-1])), "error": pa.array(errors, pa.float64())})

    return per_image(a.union(b), "image", ["side", *CORNERS], align, schema)
