"""Hash join on bands: pairs of 64-bit hashes within a few bits, without comparing all.

``most`` differing bits leave at least one of ``most + 1`` disjoint bands whole, so records
that share no band cannot be near. Exact; each pair is verified by bit counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import hamming


def band_mask(bands: int, *chosen: int) -> int:
    """The bits i with i mod bands in ``chosen``, as a signed 64-bit number."""
    value = sum(1 << i for i in range(64) if i % bands in chosen)
    return value - (1 << 64) if value >= 1 << 63 else value


def band_keys(hash_: Column, most: int, tag: str) -> list[Column]:
    return [F.struct(F.lit(f"{tag}{b}").alias("band"), hash_.bitwiseAND(F.lit(band_mask(most + 1, b))).alias("value")) for b in range(most + 1)]


def near_candidates(records: DataFrame, block: str, key: str, limits: dict[str, int]) -> DataFrame:
    """(left, right) keys of records of one block, near in at least one of the hash columns.

    ``limits`` gives the greatest number of differing bits per hash column. left < right; each
    pair once. Null hashes are near nothing. Records with equal hashes are first brought together, so copies
    share their candidates until the pairs are spelled out.
    """
    hashes = list(limits)
    classes = records.where(" or ".join(f"{h} is not null" for h in hashes)).groupBy(block, *hashes).agg(F.count("*").alias("n"), F.min(key).alias("_first"))
    keys = [k for h, most in limits.items() for k in (F.when(F.col(h).isNotNull(), s) for s in band_keys(F.col(h), most, h))]
    banded = classes.select(F.col(block), *hashes, F.inline(F.array_compact(F.array(*keys))))
    a = banded.select("band", "value", F.col(block).alias("_block"), *[F.col(h).alias(f"{h}_a") for h in hashes])
    b = banded.select("band", "value", F.col(block).alias("_block"), *[F.col(h).alias(f"{h}_b") for h in hashes])
    near = reduce(lambda x, y: x | y, [F.coalesce(hamming(F.col(f"{h}_a"), F.col(f"{h}_b")) <= most, F.lit(False)) for h, most in limits.items()])
    low = F.struct(*[f"{h}_a" for h in hashes]) <= F.struct(*[f"{h}_b" for h in hashes])
    pairs = a.join(b, ["_block", "band", "value"]).where(near & low).select("_block", *[f"{h}_{s}" for s in "ab" for h in hashes]).distinct()
    on = lambda side, r: reduce(lambda x, y: x & y, [F.col(f"{h}_{side}").eqNullSafe(r[h]) for h in hashes], pairs["_block"].eqNullSafe(r[block]))
    left = records.select(block, *hashes, F.col(key).alias("_l")).alias("l")
    right = records.select(block, *hashes, F.col(key).alias("_r")).alias("r")
    one = pairs.join(left, on("a", left)).select("_block", *[f"{h}_{s}" for s in "ab" for h in hashes], "_l")
    same = reduce(lambda x, y: x & y, [F.col(f"{h}_a").eqNullSafe(F.col(f"{h}_b")) for h in hashes])
    on_b = reduce(lambda x, y: x & y, [one[f"{h}_b"].eqNullSafe(right[h]) for h in hashes], one["_block"].eqNullSafe(right[block]))
    both = one.join(right, on_b).where((~same & (F.col("_l") != F.col("_r"))) | (F.col("_l") < F.col("_r")))
    return both.select(F.least("_l", "_r").alias("left"), F.greatest("_l", "_r").alias("right"))
