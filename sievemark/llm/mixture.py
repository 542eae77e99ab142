"""Problem 8: documents combined so that sources hold target shares of the total size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.identity import stripped
from ..operators.prefix import hash_order, running_sum, sections_for
from ..sources.tables import table
from ..storage import Workspace
from .byte_bpe import token_counts

SEED = 20260912


def source_name(source: Column) -> Column:
    """A source as regularly spelled: trimmed, lower case, words joined by underscores."""
    return F.regexp_replace(F.lower(stripped(source)), r"[\s-]+", "_")


def mixture(documents: DataFrame, targets: DataFrame, ws: Workspace, total: int | None = None, seed: int = SEED, tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen, report) for ``documents`` (doc_id, text, source) and targets (source, target_weight, max_repeats).

    The total size is ``total`` tokens, or what the listed sources hold once. A source's budget is its
    weight's part of it. Its documents stand in a random order fixed by doc_id and seed, repeated
    at most max_repeats times; the order is cut where the budget ends, and the document
    across the cut is taken if at least half of it lies before the cut. chosen: (doc_id, source, tokens,
    repeats). A source whose documents, repeated as often as allowed, are smaller than its budget is taken
    whole and reported as falling short; sources not listed, null sources and texts without tokens are
    left out. The targets are few rows and clean; token counts are per document, whole texts.
    """
    spark = documents.sparkSession
    goals = targets.collect()
    listed = spark.createDataFrame([(g["source"],) for g in goals], "source string")
    rows = documents.select("doc_id", "text", source_name(F.col("source")).alias("source")).join(F.broadcast(listed), "source", "left_semi")
    sized = ws.keep(token_counts(rows, tokenizer).where("tokens > 0"), "sizes")
    # One row per listed source.
    held = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    whole = sum(held.values()) if total is None else total
    limits = []
    for g in goals:
        have, cap = held.get(g["source"], 0), int(g["max_repeats"] or 0)
        budget = round(whole * float(g["target_weight"] or 0.0))
        epochs, rest = divmod(min(budget, have * cap), have) if have else (0, 0)
        limits.append((g["source"], int(epochs), int(rest)))
    cuts = spark.createDataFrame(limits, "_source string, _epochs long, _rest long")
    ordered = running_sum(sized.withColumn("_order", hash_order(F.col("doc_id"), seed)), "source", "_order", "doc_id", "tokens", "_upto", sections_for(sized.count()))
    repeats = F.col("_epochs") + F.when((F.col("_upto") - F.col("_rest")) * 2 <= F.col("tokens"), 1).otherwise(0)
    # An epoch that is cut at zero takes nothing.
    repeats = F.when(F.col("_rest") > 0, repeats).otherwise(F.col("_epochs"))
    chosen = ordered.join(F.broadcast(cuts), F.col("source") == F.col("_source")).select("doc_id", "source", "tokens", repeats.cast("int").alias("repeats")).where("repeats > 0")
    return chosen, _report(spark, chosen, goals, held, whole)


def _report(spark: SparkSession, chosen: DataFrame, goals: list, held: dict[str, int], whole: int) -> DataFrame:
    """Targets and what was taken, one row per listed source."""
    plan = [
        (g["source"], float(g["target_weight"] or 0.0), round(whole * float(g["target_weight"] or 0.0)), held.get(g["source"], 0), int(g["max_repeats"] or 0))
        for g in goals
    ]
    wanted = spark.createDataFrame(plan, "source string, target_share double, budget long, available long, max_repeats int")
    taken = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("taken"))
    joined = wanted.join(taken, "source", "left").withColumn("_total", F.sum("taken").over(Window.partitionBy(F.lit(1))))  # as few rows as targets
    return joined.select(
        "source", "target_share", "budget", "available", F.coalesce("taken", F.lit(0)).alias("taken"),
        F.coalesce(F.col("taken") / F.col("_total"), F.lit(0.0)).alias("actual_share"), "max_repeats",
        (F.col("available") * F.col("max_repeats") < F.col("budget")).alias("falls_short"),
    )


def _mixed(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, DataFrame]:
    return mixture(table(spark, folder, "documents", "doc_id", "text", "source"), table(spark, folder, "mix_target"), Workspace(spark, name))


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder, "p8")[0]


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return _mixed(spark, folder, "p8r")[1]
