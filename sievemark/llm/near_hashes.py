"""Exact neighbour search over pairs of 64-bit hashes (phash, dhash) by tensored banding.

Two records are near if their phash differ in at most ``P_BITS`` bits and their dhash in
at most ``D_BITS``. A record has two small collections of band values: six bands of phash
and eight of dhash (10 to 11 and 8 bits each). Table keys are not bands but pairs of them: each of the
fifteen pairs of phash bands is a key of 21 to 22 bits, made of six values. Four
changed bits touch at most four of six bands, so two near records agree on at least one pair: where minhash
would find a pair with some probability, bands lose none.

A key that many records share (copies of a scan with other noise in dhash) would compare them
all. Records under such a crowded key are tabled once more, under that key and
each of the 28 pairs of their dhash bands: six changed bits leave two of eight bands whole. Which keys are crowded is
counted over all records and decides only how candidates are found, not which: both ways are
exact, and every candidate is verified by bit counts. Nothing is capped or sampled.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace, parts_for

P_BITS, D_BITS = 4, 6
P_BANDS, D_BANDS = 6, 8
P_PAIRS, D_PAIRS = list(combinations(range(P_BANDS), 2)), list(combinations(range(D_BANDS), 2))
#: A key held by more records is tabled again by dhash. Comparing so many costs about as much as shuffling them 28 times.
CROWDED = 4096
#: Crowded keys up to this number are broadcast (16 bytes each); more are joined by shuffle.
LISTED = 100_000
#: A row under a key, as it is shuffled.
ROW_BYTES = 24


def mask(bands: int, *chosen: int) -> int:
    """The bits dealt to the chosen bands, as a signed 64-bit number."""
    value = sum(1 << i for i in range(64) if i % bands in chosen)
    return value - (1 << 64) if value >= 1 << 63 else value


def near(p1: Column, d1: Column, p2: Column, d2: Column) -> Column:
    return (F.bit_count(p1.bitwiseXOR(p2)) <= P_BITS) & (F.bit_count(d1.bitwiseXOR(d2)) <= D_BITS)


def _keys(value: Column, bands: int, pairs: list[tuple[int, int]], names: tuple[str, str]) -> Column:
    """One row per pair of bands: which pair, and the value of the two bands."""
    return F.inline(F.array(*[F.struct(F.lit(k).cast("int").alias(names[0]), value.bitwiseAND(F.lit(mask(bands, *pair))).alias(names[1])) for k, pair in enumerate(pairs)]))


def _first_shared(difference: Column, bands: int, pairs: list[tuple[int, int]]) -> Column:
    """The first pair of bands on which two values agree, given their difference."""
    chain = F.lit(-1)
    for k in reversed(range(len(pairs))):
        chain = F.when(difference.bitwiseAND(F.lit(mask(bands, *pairs[k]))) == 0, k).otherwise(chain)
    return chain


def crowded_keys(vectors: DataFrame, ws: Workspace, crowded: int = CROWDED) -> DataFrame | None:
    """(k, v): the keys that more than ``crowded`` records hold; None if there are none.

    A key holds no more records than either of its bands. Bands have 6 x 2048 values at most whatever
    the data, so they are counted first, map-side; only where two bands of a record both hold enough
    records are its keys counted.
    """
    p = F.col("p")
    bands = F.array(*[F.struct(F.lit(b).alias("b"), p.bitwiseAND(F.lit(mask(P_BANDS, b))).alias("x")) for b in range(P_BANDS)])
    full = vectors.select(F.inline(bands)).groupBy("b", "x").count().where(F.col("count") > crowded).select("b", "x")
    values: list[list[int]] = [[] for _ in range(P_BANDS)]
    for row in full.toLocalIterator():
        values[row["b"]].append(row["x"])
    if sum(map(bool, values)) < 2:
        return None
    keyed = vectors.select("p", _keys(p, P_BANDS, P_PAIRS, ("k", "v")))
    if sum(map(len, values)) <= 256:  # otherwise most records have such a pair, and a test would not pay
        held = [p.bitwiseAND(F.lit(mask(P_BANDS, b))).isin(values[b]) if values[b] else F.lit(False) for b in range(P_BANDS)]
        flags = vectors.select("p", F.array(*[held[a] & held[b] for a, b in P_PAIRS]).alias("open"))
        keyed = flags.select("open", _keys(p, P_BANDS, P_PAIRS, ("k", "v"))).where(F.get("open", F.col("k")))
    found = ws.keep(keyed.groupBy("k", "v").count().where(F.col("count") > crowded).select("k", "v"), "crowded")
    return None if found.isEmpty() else found


def near_vectors(vectors: DataFrame, ws: Workspace, crowded: int = CROWDED) -> DataFrame:
    """(p1, d1, p2, d2), (p1, d1) < (p2, d2): all near pairs of different hash pairs, each once.

    ``vectors``: distinct, non-null (p, d), as a table that can be read again. A pair is emitted under the first key that it shares,
    so no distinct is needed. Cost: 15 rows a record are shuffled on a 21-bit key.
    """
    p1, d1, p2, d2 = (F.col(c) for c in ("p1", "d1", "p2", "d2"))
    ordered = (p1 < p2) | ((p1 == p2) & (d1 < d2))
    first = F.col("k") == _first_shared(p1.bitwiseXOR(p2), P_BANDS, P_PAIRS)
    keyed = vectors.select("p", "d", _keys(F.col("p"), P_BANDS, P_PAIRS, ("k", "v")))
    hot = crowded_keys(vectors, ws, crowded)
    loose = keyed
    if hot is not None:
        marks = hot.withColumn("hot", F.lit(True))
        marked = keyed.join(F.broadcast(marks) if hot.count() <= LISTED else marks, ["k", "v"], "left")
        loose = marked.where("hot is null").drop("hot")

    # The keys are fifteen times the records, which neither the session's number of partitions nor the planner's estimate knows.
    tasks = parts_for(vectors.sparkSession, vectors.count() * len(P_PAIRS), 2 * ROW_BYTES)

    def sides(rows: DataFrame, keys: list[str]) -> DataFrame:
        rows = rows.repartition(tasks, *keys)
        a, b = rows.select(*keys, F.col("p").alias("p1"), F.col("d").alias("d1")), rows.select(*keys, F.col("p").alias("p2"), F.col("d").alias("d2"))
        return a.join(b.hint("merge"), keys).where(ordered & near(p1, d1, p2, d2) & first)

    out = sides(loose, ["k", "v"]).select("p1", "d1", "p2", "d2")
    if hot is None:
        return out
    again = marked.where("hot").select("k", "v", "p", "d", _keys(F.col("d"), D_BANDS, D_PAIRS, ("k2", "v2")))
    second = F.col("k2") == _first_shared(d1.bitwiseXOR(d2), D_BANDS, D_PAIRS)
    return out.union(sides(again, ["k", "v", "k2", "v2"]).where(second).select("p1", "d1", "p2", "d2"))
