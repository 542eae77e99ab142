"""Golden values of the classifier metrics."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sievemark.functions import scalar
from sievemark.operators import ranking


def scored(spark, labels, probabilities):
    rows = [(str(i), y, p) for i, (y, p) in enumerate(zip(labels, probabilities, strict=True))]
    return spark.createDataFrame(rows, "key string, label int, probability double")


def test_perfect_ranking(spark, ws):
    s = scored(spark, [0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9])
    assert ranking.roc_auc(s, ws).first()[0] == 1
    assert ranking.average_precision(s, ws, "key").first()[0] == 1
    assert ranking.youden_threshold(s, ws).first()["threshold"] == 0.8


def test_counts_at_threshold(spark):
    r = ranking.threshold_metrics(scored(spark, [0, 0, 1, 1], [0.1, 0.7, 0.8, 0.4]), 0.5).first()
    assert (r.tp, r.tn, r.fp, r.fn, r.balanced_accuracy) == (1, 1, 1, 1, 0.5)
    assert math.isclose(r.brier, (0.01 + 0.49 + 0.04 + 0.36) / 4)
    r = ranking.threshold_metrics(scored(spark, [0, 0, 1, 1], [0.1, 0.7, 0.6, 0.9]), 0.6).first()
    assert (r.tp, r.fp, r.tn, r.fn, r.sensitivity, r.specificity) == (2, 1, 1, 0, 1, 0.5)
    assert math.isclose(r.brier, 0.1675)


def test_ties_and_single_class(spark, ws):
    s = scored(spark, [0, 1], [0.5, 0.5])
    assert ranking.roc_auc(s, ws).first()[0] == 0.5
    assert ranking.calibration_error(s).first()[0] == 0
    assert math.isnan(ranking.roc_auc(scored(spark, [1, 1], [0.2, 0.8]), ws).first()[0])
    assert ranking.youden_threshold(scored(spark, [1, 1], [0.2, 0.8]), ws).count() == 0


def test_empty_and_null(spark, ws):
    s = scored(spark, [None, 2], [0.5, None])
    assert ranking.by_score(s).count() == 0
    assert ranking.violations(s).first().asDict() == {"n": 2, "missing": 2, "bad_labels": 1, "bad_probabilities": 0}
    assert ranking.calibration_error(s).first()[0] is None
    assert ranking.fit_temperature(s).count() == 0


def test_temperature(spark):
    s = scored(spark, [0, 1], [0.2, 0.8]).select(scalar.temperature_scaled(F.col("probability"), 1.0))
    assert [round(r[0], 12) for r in s.collect()] == [0.2, 0.8]


def test_against_plain_python(spark, ws):
    rng = random.Random(5)
    y = [rng.randrange(2) for _ in range(300)]
    p = [round(rng.random(), 2) for _ in y]
    s = scored(spark, y, p)
    pos, neg = [a for a, b in zip(p, y, strict=True) if b], [a for a, b in zip(p, y, strict=True) if not b]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    assert math.isclose(ranking.roc_auc(s, ws).first()[0], auc)
    best = max(((sum(a >= t for a in pos) * len(neg) - sum(b >= t for b in neg) * len(pos), sum(a >= t for a in pos), t) for t in {0.0, 1.0, *p}))
    assert ranking.youden_threshold(s, ws).first()["threshold"] == best[2]


def test_bootstrap_brackets_the_estimate(spark, ws):
    rng = random.Random(7)
    y = [rng.randrange(2) for _ in range(400)]
    p = [min(1.0, max(0.0, 0.3 + 0.4 * a + rng.gauss(0, 0.2))) for a in y]
    s = scored(spark, y, p)
    r = {x["metric"]: x for x in ranking.bootstrap(s, 0.5, 100, 1).union(ranking.bootstrap_ranked(s, ws, 50, 1)).collect()}
    point = ranking.threshold_metrics(s, 0.5).first()
    for name in ("sensitivity", "specificity", "brier", "f1"):
        assert r[name]["lower_95"] <= point[name] <= r[name]["upper_95"]
    assert r["auroc"]["lower_95"] <= ranking.roc_auc(s, ws).first()[0] <= r["auroc"]["upper_95"]


@pytest.mark.parametrize("cells", [400, 8_000_000])
def test_bootstrap_ranked_against_plain_python(spark, ws, cells):
    rng = random.Random(11)
    rows = [(f"k{i}", rng.randrange(2), round(rng.random(), 1 + i % 2)) for i in range(150)]
    s = spark.createDataFrame(rows, "key string, label int, probability double")
    u = (F.pmod(F.xxhash64("key", "replicate", F.lit(3)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    drawn = {}
    for r in s.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(40)))).withColumn("u", u).collect():
        total, w = 0.0, 0
        for k in range(12):
            total += math.exp(-1.0) / math.factorial(k)
            w += r.u > total
        drawn.setdefault(r.replicate, []).extend([(-r.probability, r.key, r.label)] * w)
    values = {"auroc": [], "auprc": []}
    for sample in drawn.values():
        sample.sort()
        tp, hits = 0, 0.0
        for n, (_, _, y) in enumerate(sample, 1):
            tp += y
            hits += y * tp / n
        values["auprc"].append(hits / tp)
        pos, neg = [-a for a, _, y in sample if y], [-a for a, _, y in sample if not y]
        values["auroc"].append(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
    got = {r["metric"]: r for r in ranking.bootstrap_ranked(s, ws, 40, 3, cells).collect()}
    assert set(got) == set(values)
    for name, v in values.items():
        v.sort()
        for column, q in (("lower_95", 0.025), ("upper_95", 0.975)):
            at = q * (len(v) - 1)
            want = v[int(at)] + (at - int(at)) * (v[int(at) + 1] - v[int(at)])
            assert math.isclose(got[name][column], want, rel_tol=1e-9), (name, column)


def test_bootstrap_ci_is_whole(spark):
    import inspect

    import oracle
    from sievemark.plans.scores import bootstrap_ci

    assert inspect.signature(bootstrap_ci).parameters["replicates"].default == 1000
    found = {r["metric"] for r in bootstrap_ci(spark, oracle.DATA).collect()}
    assert found == {"auroc", "auprc", "sensitivity", "specificity", "balanced_accuracy", "f1", "ece_10_bin", "brier"}


@pytest.mark.parametrize(("score", "tier"), [(0.243522, "low"), (0.30314465408805, "medium"), (0.40, "medium"), (0.40748427672956, "high"), (0.95, "high"), (-0.01, None), (1.01, None)])
def test_tiers(spark, score, tier):
    assert spark.range(1).select(scalar.confidence_tier(F.lit(score), 0.30314465408805, 0.40748427672956)).first()[0] == tier


def test_tier_order():
    with pytest.raises(ValueError):
        scalar.confidence_tier(None, 0.5, 0.4)


def test_fusion_truth_table(spark):
    rows = spark.createDataFrame([(False, 0), (True, 1), (True, 0), (False, 2), (True, -1)], "c boolean, n int")
    made = scalar.fused(F.col("c"), F.col("n"))
    got = [tuple(r) for r in rows.select(made["triage_positive"], made["strict_positive"], made["review_required"]).collect()]
    assert got[:4] == [(False, False, False), (True, True, False), (True, False, True), (True, False, True)]
    assert rows.select(made["status"]).collect()[4][0] is None


def test_contingency(spark):
    cells = [(1, 1, 1, 62), (1, 1, 0, 47), (1, 0, 1, 13), (1, 0, 0, 19), (0, 0, 0, 579), (0, 1, 0, 74), (0, 0, 1, 1), (0, 1, 1, 4)]
    rows = spark.createDataFrame([(y, c, d) for y, c, d, n in cells for _ in range(n)], "y int, c int, d int")
    rows = rows.withColumn("o", F.greatest("c", "d")).withColumn("a", F.least("c", "d"))
    get = lambda p: ranking.confusion(rows, "y", p).first()
    assert (get("c").tp, get("c").tn, get("c").fp, get("c").fn) == (109, 580, 78, 32)
    assert round(get("c").balanced_accuracy, 4) == 0.8273 and round(get("d").balanced_accuracy, 4) == 0.7622
    assert round(get("o").balanced_accuracy, 4) == 0.8726 and round(get("a").balanced_accuracy, 4) == 0.7168
    agree = ranking.confusion(rows.where("c = d"), "y", "c").first()
    assert (agree.n, round(agree.accuracy, 4), round(agree.sensitivity, 4), round(agree.specificity, 4)) == (664, 0.9654, 0.7654, 0.9931)
    counts = {r[0]: r[1] for r in rows.groupBy(scalar.error_category(F.col("y"), F.col("c"), F.col("d"))).count().collect()}
    assert counts["both_miss"] == 19 and counts["detector_only_false_alarm"] == 1 and len(counts) == 8
