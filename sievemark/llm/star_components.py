"""Connected components by alternating large-star and small-star edge rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace


def _lowest(directed: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """((a, b, m), table): every directed edge with the smallest node among a and its neighbours b.

    The minimum is combined before the shuffle, so a node with a third of all edges costs
    one row per task. It is written before the join back: then both inputs of the join are plain
    exchanges, and adaptive execution splits the partition of such a node.
    """
    least = ws.keep(directed.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
    return directed.join(least, "a"), least


def large_star(edges: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Every node's larger neighbours are linked to the smallest node around it; and the table of minima read."""
    directed = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).union(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
    starred, least = _lowest(directed, ws)
    return starred.where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).distinct(), least


def small_star(edges: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """Every node and its smaller neighbours are linked to the smallest of them; and the table of minima read."""
    starred, least = _lowest(edges.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")), ws)
    links = F.array(F.struct(F.col("a").alias("u"), F.col("m").alias("v")), F.struct(F.col("b").alias("u"), F.col("m").alias("v")))
    return starred.select(F.inline(links)).where("u != v").distinct(), least


def _state(edges: DataFrame) -> tuple:
    """Number and order-free checksum of the edges, to tell whether a rewrite changed them."""
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")).first()
    return (row["n"], row["x"], row["s"])


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(node, root): each node that has an edge, with the smallest node of its component.

    ``edges``: (u, v) of one orderable type. Loops, repeated edges and edges with a null
    end are ignored; a node that has no other edge is in no row. Rounds run until the edges stay as
    they are, at most about log2 of the longest chain squared; each round is a written
    table, so a lost executor costs no more than that round.
    """
    current = ws.keep(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(current)
    while True:
        for star in (large_star, small_star):
            rewritten, least = star(current, ws)
            after_star = ws.keep(rewritten, star.__name__)
            ws.drop(current)
            ws.drop(least)
            current = after_star
        after = _state(current)
        if after == before:
            break
        before = after
    # Stars are final: every edge leads from a node to its root.
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
