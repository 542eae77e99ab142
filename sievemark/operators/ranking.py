"""Classifier evaluation over (label, probability): ranking, calibration, thresholds.

Inputs are first collapsed to one row per distinct score with its positives and
negatives, which leaves every metric but average precision unchanged and combines map-side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import CLIP, nan_ratio
from ..storage import Workspace
from .ordered import running

GRID = 2001
#: Bootstrap weights, rows x replicates, to a task.
CELLS = 8_000_000


def violations(scores: DataFrame, label: str = "label", probability: str = "probability") -> DataFrame:
    """One row of counts: rows, nulls, labels other than 0 and 1, probabilities outside [0, 1]."""
    p, y = F.col(probability), F.col(label)
    return scores.agg(
        F.count("*").alias("n"),
        F.count_if(p.isNull() | y.isNull()).alias("missing"),
        F.count_if(~y.isin(0, 1)).alias("bad_labels"),
        F.count_if(F.isnan(p) | (p < 0) | (p > 1)).alias("bad_probabilities"),
    )


def by_score(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., probability, pos, neg) per distinct score; null labels and scores are left out."""
    return (
        scores.where("label in (0, 1) and probability is not null")
        .groupBy(*by, "probability")
        .agg(F.sum("label").cast("bigint").alias("pos"), F.sum(1 - F.col("label")).cast("bigint").alias("neg"))
    )


def roc_auc(scores: DataFrame, ws: Workspace, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., auroc): rank statistic with mid-ranks for ties; NaN if a class is missing."""
    table = running(by_score(scores, by), ws, [F.col("probability")], {"_below": "neg"}, by)
    won = F.sum(F.col("pos") * (F.col("_below") - F.col("neg") / 2))
    return table.groupBy(*by).agg(nan_ratio(won, F.sum("pos").cast("double") * F.sum("neg")).alias("auroc"))


def average_precision(scores: DataFrame, ws: Workspace, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., auprc): mean precision at each positive, rows by falling score, ties by ``key``."""
    rows = scores.where("label in (0, 1) and probability is not null").select(*by, key, "probability", F.col("label").cast("bigint").alias("label"), F.lit(1).cast("bigint").alias("_one"))
    table = running(rows, ws, [F.col("probability").desc(), F.col(key)], {"_tp": "label", "_seen": "_one"}, by)
    hit = F.sum(F.when(F.col("label") == 1, F.col("_tp") / F.col("_seen")))
    return table.groupBy(*by).agg(nan_ratio(F.coalesce(hit, F.lit(0.0)), F.sum("label").cast("double")).alias("auprc"))


def threshold_table(scores: DataFrame, ws: Workspace) -> DataFrame:
    """(threshold, tp, fp, positives, negatives) at every distinct score, 0 and 1."""
    spark = scores.sparkSession
    ends = spark.createDataFrame([(0.0, 0, 0), (1.0, 0, 0)], "probability double, pos long, neg long")
    table = by_score(scores).union(ends).groupBy("probability").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    table = ws.keep(table, "scores")
    whole = table.agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives")).first()
    run = running(table, ws, [F.col("probability").desc()], {"tp": "pos", "fp": "neg"})
    return run.select(F.col("probability").alias("threshold"), "tp", "fp", *[F.lit(whole[c]).alias(c) for c in ("positives", "negatives")])


def youden_threshold(scores: DataFrame, ws: Workspace) -> DataFrame:
    """(threshold, sensitivity, specificity) with the greatest sum of the two; then by
    sensitivity, then by threshold. No row unless both classes are present.

    The sum is compared as the integer tp * negatives - fp * positives.
    """
    table = threshold_table(scores, ws).where("positives > 0 and negatives > 0")
    gain = F.col("tp").cast("decimal(38,0)") * F.col("negatives") - F.col("fp").cast("decimal(38,0)") * F.col("positives")
    best = table.agg(F.max_by(F.struct("threshold", "tp", "fp", "positives", "negatives"), F.struct(gain, "tp", "threshold")).alias("b")).where("b is not null")
    return best.select(F.col("b.threshold").alias("threshold"), (F.col("b.tp") / F.col("b.positives")).alias("sensitivity"), (1 - F.col("b.fp") / F.col("b.negatives")).alias("specificity"))


def edge_bin(p: Column, bins: int = 10) -> Column:
    """The bin whose edges i / bins hold p, the last one closed; edges are i * (1 / bins) as doubles."""
    step = 1.0 / bins
    inner = [F.when(p >= i * step, 1).otherwise(0) for i in range(1, bins)]
    total = inner[0]
    for x in inner[1:]:
        total = total + x
    return total


def binned(scores: DataFrame, bin_: Column, by: tuple[str, ...] = ()) -> DataFrame:
    return scores.where("label in (0, 1) and probability is not null").groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg("probability").alias("mean_probability"), F.avg("label").alias("mean_label"))


def calibration_error(scores: DataFrame, bins: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., ece): size-weighted gap between mean score and mean label over equal bins."""
    table = binned(scores, edge_bin(F.col("probability"), bins), by)
    return table.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("mean_probability") - F.col("mean_label"))) / F.sum("n")).alias("ece"))


def confusion(frame: DataFrame, label: str, prediction: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., n, tp, tn, fp, fn) and ratios that are 0 where their denominator is."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    counts = frame.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(y & p).alias("tp"), F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"))
    one = F.lit(1)
    return (
        counts.withColumn("accuracy", (F.col("tp") + F.col("tn")) / F.greatest("n", one))
        .withColumn("sensitivity", F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), one))
        .withColumn("specificity", F.col("tn") / F.greatest(F.col("tn") + F.col("fp"), one))
        .withColumn("balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / 2)
    )


def threshold_metrics(scores: DataFrame, threshold: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and ratios at one threshold; sensitivity and specificity are NaN without their class."""
    good = scores.where("label in (0, 1) and probability is not null")
    y, p = F.col("label") == 1, F.col("probability") >= threshold
    counts = good.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(y).alias("positives"), F.count_if(~y).alias("negatives"),
        F.count_if(y & p).alias("tp"), F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"),
        F.avg((F.col("probability") - F.col("label")) * (F.col("probability") - F.col("label"))).alias("brier"),
    )
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    out = (
        counts.withColumn("threshold", F.lit(threshold))
        .withColumn("accuracy", (tp + tn) / F.col("n"))
        .withColumn("sensitivity", nan_ratio(tp, tp + fn))
        .withColumn("specificity", nan_ratio(tn, tn + fp))
        .withColumn("precision", F.when(tp + fp == 0, 0.0).otherwise(tp / (tp + fp)))
    )
    both = F.col("precision") + F.col("sensitivity")
    return out.withColumn("balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / 2).withColumn("f1", F.when(both == 0, 0.0).otherwise(2 * F.col("precision") * F.col("sensitivity") / both))


def classification_report(scores: DataFrame, ws: Workspace, threshold: float, key: str, by: tuple[str, ...] = ()) -> DataFrame:
    """All metrics, one row per ``by``: counts and ratios, auroc, auprc, ece and brier."""
    base = threshold_metrics(scores, threshold, by)
    parts = [roc_auc(scores, ws, by), average_precision(scores, ws, key, by), calibration_error(scores, 10, by).withColumnRenamed("ece", "ece_10_bin")]
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by]
    base = base.withColumn("_row", F.concat_ws("\x00", F.lit("r"), *keys))
    for part in parts:
        base = base.join(part.withColumn("_row", F.concat_ws("\x00", F.lit("r"), *keys)).drop(*by), "_row")
    return base.drop("_row")


def fit_temperature(scores: DataFrame) -> DataFrame:
    """(temperature, loss): the first of 2001 log-spaced temperatures with the least log loss.

    Rows are collapsed to distinct scores. A task adds up the losses of its scores at all temperatures as
    one vector, so what it puts out and shuffles are 2001 sums, however many scores it has.
    """
    spark = scores.sparkSession
    lo, hi = math.log(0.1), math.log(10.0)
    grid = np.exp(lo + np.arange(GRID) * ((hi - lo) / (GRID - 1)))

    def summed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        losses, n = np.zeros(GRID), 0
        for part in parts:
            p, pos, neg = (part.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(3))
            p = np.clip(p, CLIP, 1 - CLIP)
            logit = np.log(p / (1 - p))
            n += int(pos.sum() + neg.sum())
            for i in range(0, len(p), 256):
                rows = slice(i, i + 256)
                q = np.clip(1 / (1 + np.exp(-logit[rows, None] / grid)), CLIP, 1 - CLIP)
                losses -= pos[rows] @ np.log(q) + neg[rows] @ np.log(1 - q)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(GRID), pa.int32()), pa.array(grid), pa.array(losses), pa.array([n] * GRID, pa.int64())], names=["i", "temperature", "loss", "n"])

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = by_score(scores).repartition(tasks, "probability").mapInArrow(summed, "i int, temperature double, loss double, n bigint")
    lossy = parts.groupBy("i", "temperature").agg((F.sum("loss") / F.sum("n")).alias("loss"))
    return lossy.agg(F.min(F.struct("loss", "temperature")).alias("b")).where("b is not null").select("b.temperature", "b.loss")


def _parts(rows: DataFrame, replicates: int, cells: int = CELLS) -> int:
    """Tasks for rows x replicates weights: the work goes by those, not by the bytes of the rows."""
    return max(1, min(10_000, -(-rows.count() * replicates // cells)))


def _intervals(per: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """(metric, lower_95, upper_95) over the rows of ``per``, one a replicate; no row for a metric without a finite value."""
    long = per.select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in metrics.items()]))).where("value is not null and not isnan(value)")
    cut = F.percentile("value", F.array(F.lit(0.025), F.lit(0.975)))
    return long.groupBy("metric").agg(cut.alias("q")).select("metric", F.col("q")[0].alias("lower_95"), F.col("q")[1].alias("upper_95"))


def bootstrap(scores: DataFrame, threshold: float, replicates: int, seed: int) -> DataFrame:
    """(metric, lower_95, upper_95) by resampling rows with replacement.

    A replicate gives each row a Poisson(1) weight from a hash of (row key, replicate, seed), the large-sample form of
    drawing n of n rows, so replicates need no index join: the rows are read once,
    weights are expanded and combined map-side into one row per replicate and score bin.
    ``scores``: (key, label, probability).
    """
    good = scores.where("label in (0, 1) and probability is not null")
    good = good.repartition(_parts(good, replicates))
    # Poisson(1) by inversion of a hash-based uniform number.
    u = (F.pmod(F.xxhash64("key", "replicate", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    cdf, total, term = [], 0.0, math.exp(-1.0)
    for k in range(12):
        total += term
        cdf.append(total)
        term /= k + 1
    weight = F.lit(0)
    for c in cdf:
        weight = weight + F.when(u > c, 1).otherwise(0)
    drawn = good.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", weight).where("w > 0")
    y, p = F.col("label") == 1, F.col("probability") >= threshold
    w = F.col("w")
    binned_ = drawn.groupBy("replicate", edge_bin(F.col("probability")).alias("bin")).agg(
        F.sum(w).alias("n"), F.sum(w * F.col("probability")).alias("sp"), F.sum(w * F.col("label")).alias("sy"),
        F.sum(F.when(y & p, w).otherwise(0)).alias("tp"), F.sum(F.when(~y & p, w).otherwise(0)).alias("fp"), F.sum(F.when(y & ~p, w).otherwise(0)).alias("fn"), F.sum(F.when(~y & ~p, w).otherwise(0)).alias("tn"),
        F.sum(w * (F.col("probability") - F.col("label")) * (F.col("probability") - F.col("label"))).alias("se"),
    )
    per = binned_.groupBy("replicate").agg(*[F.sum(c).alias(c) for c in ("n", "tp", "fp", "fn", "tn", "se")], F.sum(F.abs(F.col("sp") - F.col("sy"))).alias("gap"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    sensitivity, specificity = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    metrics = {
        "sensitivity": sensitivity, "specificity": specificity, "balanced_accuracy": (sensitivity + specificity) / 2,
        "f1": F.try_divide(2 * tp, 2 * tp + fp + fn), "ece_10_bin": F.col("gap") / F.col("n"), "brier": F.col("se") / F.col("n"),
    }
    return _intervals(per, metrics)


def _drawn(hashed: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Rows x replicates: the weights of ``bootstrap``, whose xxhash64 goes on from the key's hash."""
    p1, p2, p3, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = hashed.view(np.uint64)[:, None]
    for number in (np.arange(1, replicates + 1, dtype=np.uint64)[None, :], np.array([[seed & 0xFFFFFFFF]], dtype=np.uint64)):
        h = (h + p5 + np.uint64(4)) ^ (number * p1)
        h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * p2 + p3
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h = h ^ (h >> np.uint64(32))
    u = ((h & np.uint64((1 << 52) - 1)).astype(np.float64) + 0.5) / float(1 << 52)
    weight, total, term = np.zeros(u.shape, dtype=np.int64), 0.0, math.exp(-1.0)
    for k in range(12):
        total += term
        weight += u > total
        term /= k + 1
    return weight


def bootstrap_ranked(scores: DataFrame, ws: Workspace, replicates: int, seed: int, cells: int = CELLS) -> DataFrame:
    """The same for auroc and auprc, from one order of the rows that all replicates share.

    Rows are range-partitioned by falling score once, at ``cells`` weights to a range. A first
    pass counts each replicate's rows and positives per range, a running total over the ranges
    gives where each starts, and a second pass sums within a range: no replicate's rows are ever
    written or shuffled. A row of weight w stands for w rows in a sequence; ties go by ``key``
    for auprc and count half for auroc, for which equal scores share a range.
    """
    good = scores.where("label in (0, 1) and probability is not null").select("key", F.xxhash64("key").alias("hashed"), F.col("label").cast("bigint").alias("label"), F.col("probability").cast("double").alias("probability"))
    good = ws.keep(good, "rows")
    parts = _parts(good, replicates, cells)
    placed = ws.keep(good.repartitionByRange(parts, F.col("probability").desc()).withColumn("_range", F.spark_partition_id()), "ranged").repartition(parts, "_range")
    step = max(1, (1 << 19) // replicates)

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        seen, tp = np.zeros(replicates, dtype=np.int64), np.zeros(replicates, dtype=np.int64)
        y, hashed = rows["label"].to_numpy(), rows["hashed"].to_numpy()
        for i in range(0, len(y), step):
            w = _drawn(hashed[i : i + step], replicates, seed)
            seen += w.sum(axis=0)
            tp += w[y[i : i + step] == 1].sum(axis=0)
        return pd.DataFrame({"_range": rows["_range"].iloc[0], "replicate": np.arange(1, replicates + 1), "seen": seen, "tp": tp})

    def rank(rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        rows, start = rows.sort_values(["probability", "key"], ascending=[False, True]), start.sort_values("replicate")
        y, hashed, p = (rows[c].to_numpy() for c in ("label", "hashed", "probability"))
        seen, tp = start["_seen"].to_numpy().copy(), start["_tp"].to_numpy().copy()
        above, hit, won = tp.astype(np.float64), np.zeros(replicates), np.zeros(replicates)
        open_pos, open_neg = np.zeros(replicates), np.zeros(replicates)  # of the score that the step before ended in
        for i in range(0, len(y), step):
            w, one = _drawn(hashed[i : i + step], replicates, seed), y[i : i + step] == 1
            pos = np.where(one[:, None], w, 0)
            drawn = w[one]
            before, among = (np.cumsum(pos, axis=0) + tp)[one] - drawn, (np.cumsum(w, axis=0) + seen)[one] - drawn
            for j in range(1, int(drawn.max(initial=0)) + 1):
                hit += np.where(drawn >= j, (before + j) / (among + j), 0.0).sum(axis=0)
            here = p[i : i + step]
            first = np.flatnonzero(np.r_[True, here[1:] != here[:-1]])
            ties_pos, ties_neg = (np.add.reduceat(x, first, axis=0).astype(np.float64) for x in (pos, w - pos))
            if i and here[0] == p[i - 1]:
                ties_pos[0] += open_pos
                ties_neg[0] += open_neg
            else:
                won += open_neg * (above + open_pos / 2)
                above = above + open_pos
            open_pos, open_neg = ties_pos[-1], ties_neg[-1]
            ahead = np.cumsum(ties_pos, axis=0) - ties_pos + above
            won += (ties_neg[:-1] * (ahead[:-1] + ties_pos[:-1] / 2)).sum(axis=0)
            above = ahead[-1]
            seen, tp = seen + w.sum(axis=0), tp + pos.sum(axis=0)
        won += open_neg * (above + open_pos / 2)
        pos = tp - start["_tp"].to_numpy()
        return pd.DataFrame({"replicate": start["replicate"].to_numpy(), "hit": hit, "won": won, "pos": pos, "neg": seen - start["_seen"].to_numpy() - pos})

    totals = ws.keep(placed.groupBy("_range").applyInPandas(count, "_range int, replicate int, seen bigint, tp bigint"), "totals")
    ahead = Window.partitionBy("replicate").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", "replicate", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"_{c}") for c in ("seen", "tp")])
    sums = placed.groupBy("_range").cogroup(starts.groupBy("_range")).applyInPandas(rank, "replicate int, hit double, won double, pos bigint, neg bigint")
    per = sums.groupBy("replicate").agg(*[F.sum(c).alias(c) for c in ("hit", "won", "pos", "neg")])
    metrics = {"auroc": F.try_divide(F.col("won"), F.col("pos").cast("double") * F.col("neg")), "auprc": F.try_divide(F.col("hit"), F.col("pos").cast("double"))}
    return _intervals(per, metrics)
