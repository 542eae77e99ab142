"""Winnowing fingerprints of 64-bit hashes: seeds, chains, extension.

A hash is read as a ring of 64 bits. Its fingerprint is the set of grams (runs of so many
bits, with their place) whose rank is the least in some window of consecutive grams, as
in document winnowing. Two rings that agree on a run of gram + window - 1 bits see the same
window there and select the same gram. Four changed bits leave 60 bits in at most four arcs, so
15 in one of them: grams of 13 bits and windows of 3 lose no pair of phash. Six changed bits
leave 58 in six arcs, so 10 in one: grams of 8 and windows of 3 for dhash.

Hashes of two images are aligned bit by bit, so a chain is collinear only on the main diagonal:
a gram's place is part of its fingerprint, and the seeds of a pair form one chain.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace
from .near_hashes import D_BITS, P_BITS, near

RING = 64


@dataclass(frozen=True)
class Winnow:
    """Grams of ``gram`` bits, one selected in every ``window`` consecutive ones."""

    gram: int
    window: int

    def lossless(self, changed: int) -> bool:
        """Whether two rings with so many changed bits always share a fingerprint."""
        return self.gram + self.window - 1 <= -(-(RING - changed) // max(1, changed))

    def fingerprints(self, value: Column) -> Column:
        """The selected grams of a 64-bit pattern: an array of distinct ints, rank * 64 + place.

        The rank is a bijection of the gram that puts the empty run, the commonest gram, last; equal ranks go by place.
        """
        size = 1 << self.gram
        places = F.sequence(F.lit(0), F.lit(RING - 1))
        turned = lambda i: F.call_function("shiftrightunsigned", value, i).bitwiseOR(F.call_function("shiftleft", value, F.lit(RING) - i))
        rank = lambda i: ((turned(i).bitwiseAND(F.lit(size - 1)) * 5419 + (size - 1)).bitwiseAND(F.lit(size - 1)) * RING + i).cast("int")
        ranks = F.transform(places, rank)
        least = lambda r: F.array_distinct(F.transform(places, lambda i: F.least(*[F.get(r, (i + j) % RING) for j in range(self.window)])))
        # the ranks are computed once and then read window by window
        return F.get(F.transform(F.array(ranks), least), F.lit(0))


PHASH, DHASH = Winnow(13, 3), Winnow(8, 3)
assert PHASH.lossless(P_BITS) and DHASH.lossless(D_BITS)
#: A seed under which more pairs than the square of this would be compared is split by the seeds of dhash.
CROWDED = 4096


def _seeded(vectors: DataFrame) -> DataFrame:
    return vectors.select("p", "d", F.explode(PHASH.fingerprints(F.col("p"))).alias("seed"))


def crowded_seeds(left: DataFrame, right: DataFrame, ws: Workspace, crowded: int = CROWDED) -> DataFrame | None:
    """(seed) of both sides under which too many pairs meet; None if there are none.

    There are at most 64 x 8192 seeds whatever the data: counts combine map-side, and the table can be broadcast.
    """
    both = left.select("seed", F.lit(1).alias("l"), F.lit(0).alias("r")).union(right.select("seed", F.lit(0).alias("l"), F.lit(1).alias("r")))
    counts = both.groupBy("seed").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    found = ws.keep(counts.where(F.col("l") * F.col("r") > crowded * crowded).select("seed"), "crowded")
    return None if found.isEmpty() else found


def chained_pairs(left: DataFrame, right: DataFrame, ws: Workspace, crowded: int = CROWDED) -> DataFrame:
    """(p1, d1, p2, d2, seeds, agree): near pairs of a left and a right vector, equal ones included, each once.

    ``left`` and ``right``: distinct non-null (p, d). Fingerprints of phash are joined; each hit
    is extended over both whole hashes with at most 4 and 6 substitutions, which drops chance hits before
    anything is grouped; the seeds of a pair are then chained. seeds: length of the chain; agree: bits
    of 128 that the alignment matches. No pair is lost: a near pair shares at least one seed of phash and one of
    dhash, so crowded seeds are joined with those of dhash in exactly the same way.
    """
    a, b = ws.keep(_seeded(left), "seeds-left"), ws.keep(_seeded(right), "seeds-right")
    hot = crowded_seeds(a, b, ws, crowded)
    p1, d1, p2, d2 = (F.col(c) for c in ("p1", "d1", "p2", "d2"))

    def met(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
        x, y = x.withColumnsRenamed({"p": "p1", "d": "d1"}), y.withColumnsRenamed({"p": "p2", "d": "d2"})
        return x.join(y.hint("merge"), keys).where(near(p1, d1, p2, d2)).select("p1", "d1", "p2", "d2", "seed")

    if hot is None:
        hits = met(a, b, ["seed"])
    else:
        marks = F.broadcast(hot)
        hits = met(a.join(marks, "seed", "left_anti"), b.join(marks, "seed", "left_anti"), ["seed"])
        twice = lambda rows: rows.join(marks, "seed", "left_semi").withColumn("second", F.explode(DHASH.fingerprints(F.col("d"))))
        hits = hits.union(met(twice(a), twice(b), ["seed", "second"]))
    chains = hits.groupBy("p1", "d1", "p2", "d2").agg(F.size(F.collect_set("seed")).alias("seeds"))
    agree = 2 * RING - F.bit_count(p1.bitwiseXOR(p2)) - F.bit_count(d1.bitwiseXOR(d2))
    return chains.withColumn("agree", agree)
