"""Box operators: golden values, invariants, brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.functions import scalar
from sievemark.operators import boxes as bx

BOX = "image bigint, box bigint, conf double, x1 double, y1 double, x2 double, y2 double"
AIM = "image bigint, box bigint, x1 double, y1 double, x2 double, y2 double"


def test_iou():
    m = bx.iou_matrix(np.array([[0.0, 0, 10, 10]]), np.array([[0.0, 0, 10, 10], [5, 5, 15, 15]]))
    assert m[0, 0] == 1 and math.isclose(m[0, 1], 25 / 175)
    assert bx.iou_matrix(np.zeros((0, 4)), np.zeros((2, 4))).shape == (0, 2)


def test_suppression_and_matching(spark):
    b = spark.createDataFrame([(1, 0, 0.7, 0.0, 0.0, 10.0, 10.0), (1, 1, 0.9, 1.0, 1.0, 11.0, 11.0), (1, 2, 0.6, 20.0, 20.0, 30.0, 30.0)], BOX)
    assert [r.box for r in bx.suppress(b, 0.5).orderBy(F.col("conf").desc()).collect()] == [1, 2]
    t = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0)], AIM)
    p = spark.createDataFrame([(1, 0, 0.4, 0.0, 0.0, 10.0, 10.0), (1, 1, 0.9, 0.0, 0.0, 10.0, 10.0)], BOX)
    got = {r.box: (r.target, r.iou) for r in bx.match(t, p).collect()}
    assert got == {1: (0, 1.0), 0: (None, None)}
    with pytest.raises(ValueError):
        bx.suppress(b, 1.1)


def test_empty_and_null(spark):
    b, t = spark.createDataFrame([], BOX), spark.createDataFrame([], AIM)
    assert bx.suppress(b, 0.5).count() == 0 and bx.match(t, b).count() == 0
    only = spark.createDataFrame([(1, 0, None, 0.0, 0.0, 1.0, 1.0), (None, 0, 0.5, 0.0, 0.0, 1.0, 1.0), (2, 0, 0.5, 0.0, 0.0, 1.0, 1.0)], BOX)
    assert [(r.image, r.target) for r in bx.match(t, only).collect()] == [(2, None)]


def test_sweep_equals_matching_again(spark):
    rng = random.Random(2)
    box = lambda: (x := rng.uniform(0, 20), y := rng.uniform(0, 20), x + rng.uniform(5, 15), y + rng.uniform(5, 15))
    t = spark.createDataFrame([(i, k, *box()) for i in range(20) for k in range(rng.randrange(3))], AIM)
    p = spark.createDataFrame([(i, k, rng.random(), *box()) for i in range(25) for k in range(rng.randrange(5))], BOX)
    images = spark.range(25).select(F.col("id").alias("image"))
    levels = [0.1, 0.5, 0.9]
    curve = {r.threshold: r for r in bx.sweep(t, bx.match(t, p), images, levels).collect()}
    for level in levels:
        counts = bx.image_counts(t, p.where(F.col("conf") >= level), bx.match(t, p.where(F.col("conf") >= level)))
        whole = images.join(counts, "image", "left").na.fill(0)
        want = bx.detection_summary(whole).first()
        got = curve[level]
        assert (got.tp, got.fp, got.fn, got.negative_images, got.negative_image_false_alarm_rate) == (want.tp, want.fp, want.fn, want.negative_images, want.negative_image_false_alarm_rate)


def test_bottleneck_against_permutations():
    rng = np.random.default_rng(1)
    for n in range(6):
        for _ in range(20):
            a, b = rng.random((n, 4)), rng.random((n, 4))
            want = min((max((np.abs(a[i] - b[j]).max() for i, j in enumerate(o)), default=0.0) for o in itertools.permutations(range(n))), default=0.0)
            assert math.isclose(bx.bottleneck(a, b), want)
    assert bx.bottleneck(np.zeros((1, 4)), np.zeros((2, 4))) == math.inf
    assert bx.bottleneck(np.arange(240.0).reshape(60, 4), np.arange(240.0).reshape(60, 4)[::-1]) == 0


def test_polygons(spark):
    poly = lambda points: spark.range(1).select(scalar.yolo_polygon(F.array(*map(F.lit, points)), F.lit(200), F.lit(100))).first()[0]
    assert poly([0.0, 0.0, 100.0, 0.0, 100.0, 50.0]) == "0 0.00000000 0.00000000 0.50000000 0.00000000 0.50000000 0.50000000"
    assert poly([0.0, 0.0, 1.0, 1.0]) is None
    assert "1.00000000" in poly([200.00000000000003, 0.0, 0.0, 0.0, 0.0, 50.0])


def test_fixed_rounds_like_the_exact_value(spark):
    rng = random.Random(3)
    values = [rng.random() for _ in range(2000)] + [0.0, 1.0, 0.5, 0.000000005, 0.000000015, 0.25 / 2**20, 1 / 512, 3 / 1024] + [k / 2**10 for k in range(1024)]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(scalar.fixed(F.col("v"), 8)).collect()]
    assert got == [f"{v:.8f}" for v in values]


def plain_iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    shared = max(w, 0) * max(h, 0)
    union = sum(max(x[2] - x[0], 0) * max(x[3] - x[1], 0) for x in (a, b)) - shared
    return shared / union if union > 0 else 0.0


def plain_kept(boxes, limit):
    kept = []
    for box in sorted(boxes, key=lambda r: (-r[2], r[1])):
        if all(plain_iou(box[3:], k[3:]) <= limit for k in kept):
            kept.append(box)
    return kept


def plain_match(targets, boxes, least):
    free, out = sorted(targets, key=lambda r: r[1]), {}
    for box in sorted(boxes, key=lambda r: (-r[2], r[1])):
        best = max(free, key=lambda t: plain_iou(t[2:], box[3:]), default=None)  # the first of equals
        hit = best is not None and plain_iou(best[2:], box[3:]) >= least
        out[box[0], box[1]] = best[1] if hit else None
        if hit:
            free.remove(best)
    return out


def test_many_images_at_once_equal_one_by_one(spark):
    """Images of every size, some beyond what is worked on together and cut by Arrow batches, one without boxes or targets."""
    rng = random.Random(8)
    box = lambda: (x := float(rng.randrange(40)), y := float(rng.randrange(40)), x + rng.randrange(20), y + rng.randrange(20))
    sizes = {i: (rng.randrange(4), rng.randrange(7)) for i in range(60)} | {60: (70, 150), 61: (3, 90), 62: (80, 2), 63: (0, 70)}
    aims = [(i, k, *box()) for i, (t, _) in sizes.items() for k in range(t)]
    own = [(i, k, rng.randrange(9) / 10, *box()) for i, (_, b) in sizes.items() for k in range(b)]
    t, p = spark.createDataFrame(aims, AIM), spark.createDataFrame(own, BOX)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        kept = {(r.image, r.box) for r in bx.suppress(p, 0.3).collect()}
        found = {(r.image, r.box): r.target for r in bx.match(t, p, 0.2).collect()}
        swept = {(r.image, r.nms_iou): tuple(r)[2:] for r in bx.suppression_sweep(t, p, [0.1, 0.6], 0.2).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    by = lambda rows, i: [r for r in rows if r[0] == i]
    assert kept == {(r[0], r[1]) for i in sizes for r in plain_kept(by(own, i), 0.3)}
    assert found == {k: v for i in sizes for k, v in plain_match(by(aims, i), by(own, i), 0.2).items()}
    for i, (n, b) in sizes.items():
        for limit in (0.1, 0.6):
            left = plain_kept(by(own, i), limit)
            hits = sum(v is not None for v in plain_match(by(aims, i), left, 0.2).values())
            assert not n and not b or swept[i, limit] == (n, b, len(left), hits)
