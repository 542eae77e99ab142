"""Sampling, overlaps, splits, near images and groups against brute force and edge cases."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import oracle
from sievemark.llm import consolidate, group_splits, near_hashes, near_images, proportions, queries, split_overlap, star_components, winnowing

IMAGES = "image_id string, p bigint, d bigint, hi bigint, lo bigint"


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def flipped(rng, v, n):
    return v ^ sum(1 << b for b in rng.sample(range(64), n))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    oracle.same(queries.QUERIES[name](spark, oracle.DATA), queries.SQL[name])


def test_changed_bits_leave_a_key_whole():
    assert all(any(not set(pair) & set(hit) for pair in near_hashes.P_PAIRS) for hit in combinations(range(near_hashes.P_BANDS), near_hashes.P_BITS))
    assert all(any(not set(pair) & set(hit) for pair in near_hashes.D_PAIRS) for hit in combinations(range(near_hashes.D_BANDS), near_hashes.D_BITS))
    assert winnowing.PHASH.lossless(4) and not winnowing.PHASH.lossless(5) and winnowing.DHASH.lossless(6) and not winnowing.DHASH.lossless(7)


def test_fingerprints_are_window_minima(spark):
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(300)] + [0, (1 << 64) - 1, 1]
    flips = [flipped(rng, v, rng.randrange(5)) for v in values]
    frame = spark.createDataFrame([(i, signed(a), signed(b)) for i, (a, b) in enumerate(zip(values, flips, strict=True))], "i int, a bigint, b bigint")
    rows = frame.select("i", winnowing.PHASH.fingerprints(F.col("a")).alias("a"), winnowing.PHASH.fingerprints(F.col("b")).alias("b")).collect()
    for r in rows:
        turned = [(values[r.i] >> k | values[r.i] << (64 - k)) & 0x1FFF for k in range(64)]
        ranks = [(g * 5419 + 8191 & 0x1FFF) * 64 + k for k, g in enumerate(turned)]
        assert set(r.a) == {min(ranks[(k + j) % 64] for j in range(3)) for k in range(64)}
        assert set(r.a) & set(r.b)  # up to four changed bits always leave a common one


@pytest.mark.parametrize("crowded", [1, 6, 4096])
def test_near_vectors_and_chains_however_crowded(spark, ws, crowded):
    """A third of the vectors share one phash; small limits send most keys the second way."""
    rng = random.Random(crowded)
    bases = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(9)]
    vectors = sorted({(bases[0][0], flipped(rng, bases[0][1], rng.randrange(9))) if k % 3 == 0 else tuple(flipped(rng, x, rng.randrange(6)) for x in rng.choice(bases)) for k in range(240)})
    frame = ws.keep(spark.createDataFrame([(signed(p), signed(d)) for p, d in vectors], "p bigint, d bigint"), "vectors")
    found = near_hashes.near_vectors(frame, ws, crowded).collect()
    close = {(a, b) for a in vectors for b in vectors if (a[0] ^ b[0]).bit_count() <= 4 and (a[1] ^ b[1]).bit_count() <= 6}
    lift = lambda r: ((r.p1 % 2**64, r.d1 % 2**64), (r.p2 % 2**64, r.d2 % 2**64))
    assert len(found) == len({frozenset(lift(r)) for r in found}) and {frozenset(lift(r)) for r in found} == {frozenset(x) for x in close if x[0] != x[1]}
    left, right = frame.where("p % 2 = 0"), frame.where("p % 3 != 0")
    chained = winnowing.chained_pairs(left, right, ws, crowded).collect()
    want = {x for x in close if signed(x[0][0]) % 2 == 0 and signed(x[1][0]) % 3 != 0}
    assert len(chained) == len(want) and {lift(r) for r in chained} == want
    assert all(1 <= r.seeds <= 64 and r.agree == 128 - (r.p1 % 2**64 ^ r.p2 % 2**64).bit_count() - (r.d1 % 2**64 ^ r.d2 % 2**64).bit_count() for r in chained)


SKEW = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2.0", "spark.sql.shuffle.partitions": "12"}


@pytest.fixture
def splits_skew(spark):
    """Runs a frame under small thresholds and tells whether the plan split a skewed join."""
    before = {k: spark.conf.get(k, None) for k in SKEW}
    for k, v in SKEW.items():
        spark.conf.set(k, v)

    def split(frame):
        frame.collect()
        return "skew=true" in frame._jdf.queryExecution().executedPlan().toString()

    yield split
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_joins_on_a_hot_key_are_split(spark, ws, splits_skew):
    """A third of all rows share one key: adaptive execution must split their partition."""
    n = 30000
    edges = ws.keep(spark.range(0, n, 1, 16).select(F.concat(F.lit("x"), F.col("id")).alias("u"), F.when(F.col("id") % 3 == 0, "a").otherwise(F.concat(F.lit("w"), F.col("id") % 5000)).alias("v")), "edges")
    assert splits_skew(star_components.large_star(edges, ws)[0])
    above = ws.keep(edges.select("u", F.when(F.col("v") == "a", "z").otherwise(F.col("v")).alias("v")), "edges")  # small stars go by the greater end
    assert splits_skew(star_components.small_star(above, ws)[0])
    record = ws.keep(spark.range(0, n, 1, 16).select(F.concat(F.lit("x"), F.col("id")).alias("image_id"), F.when(F.col("id") % 3 == 0, "ff").otherwise(F.hex(F.col("id") % 5000 + 4096)).alias("phash")), "record")
    none = spark.createDataFrame([], "left_image_id string, right_image_id string"), spark.createDataFrame([], "image_id string, exact_group string, near_group string")
    assert splits_skew(consolidate.match_edges(*none, record, ws))
    labelled = ws.keep(spark.range(0, n, 1, 16).select(F.when(F.col("id") % 3 == 0, "L").otherwise((F.col("id") % 5000).cast("string")).alias("label"), F.col("id").cast("string").alias("image_key"), F.concat(F.lit("u"), F.col("id")).alias("unit")), "labelled")
    assert splits_skew(group_splits.label_edges(labelled, ws))


def brute(rows):
    return sorted(
        (a[0], b[0]) for a in rows for b in rows
        if a[0] < b[0] and None not in (a[1], a[2], b[1], b[2]) and (a[1] ^ b[1]).bit_count() <= 4 and (a[2] ^ b[2]).bit_count() <= 6 and not (a[3] is not None and a[3] == b[3])
    )


@pytest.mark.parametrize("hot", [False, True])
def test_near_pairs(spark, ws, hot):
    """With ``hot``, over a third of the images share one phash and so every key of it."""
    rng = random.Random(11)
    bases = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(25)]
    rows = []
    for k in range(400):
        p, d = rng.choice(bases)
        p, d = (bases[0][0], rng.choice([rng.getrandbits(64), flipped(rng, bases[0][1], rng.randrange(9))])) if hot and k % 5 < 2 else (flipped(rng, p, rng.randrange(6)), flipped(rng, d, rng.randrange(8)))
        rows.append((f"i{k:04d}", rng.choice([p] * 20 + [None]), rng.choice([d] * 20 + [None]), rng.choice([None, k, rng.randrange(5)])))
    rows += [(f"{i}x", p, d, m) for i, p, d, m in rows[:40]]
    frame = spark.createDataFrame([(i, None if p is None else signed(p), None if d is None else signed(d), m, m) for i, p, d, m in rows], IMAGES)
    got = sorted((r.image_id_a, r.image_id_b) for r in near_images.near_pairs(frame, ws).collect())
    want = brute(rows)
    assert got == want and want
    groups = {r.image_id: r for r in near_images.near_groups(frame, ws).collect()}
    links = Counter(x for pair in want for x in pair)
    assert {i: r.links for i, r in groups.items()} == links
    for a, b in want:
        assert groups[a].group_id == groups[b].group_id


def test_near_pairs_of_nothing(spark, ws):
    empty = spark.createDataFrame([], IMAGES)
    assert near_images.near_pairs(empty, ws).count() == 0 and near_images.near_groups(empty, ws).count() == 0
    assert near_images.near_pairs(spark.createDataFrame([("a", None, None, None, None)], IMAGES), ws).count() == 0


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def graph(kind):
    rng = random.Random(kind)
    return {
        0: [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(80)],
        1: [("hub", f"s{i:03d}") for i in range(200)] + [("a", "hub")],
        2: [(f"n{rng.randrange(150):03d}", f"n{rng.randrange(150):03d}") for _ in range(140)] + [(None, "q"), ("z", "z"), ("b", "a"), ("a", "b")],
        3: [],
    }[kind]


@pytest.mark.parametrize("kind", range(4))
def test_components_and_forest(spark, ws, kind):
    edges = graph(kind)
    frame = spark.createDataFrame(edges, "u string, v string")
    want = union_find(edges)
    assert {r.node: r.root for r in star_components.components(frame, ws).collect()} == want
    forest, roots = group_splits.spanning_forest(frame, ws)
    label = {r.node: r.root for r in roots.collect()}
    assert set(label) == set(want)
    assert len({(label[x], want[x]) for x in want}) == len(set(want.values()))
    kept = [(r.u, r.v) for r in forest.collect()]
    assert len(kept) == len(want) - len(set(want.values())) and union_find(kept) == want


RECORD = "image_id string, study_id string, fractured int, anatomy string, unit string"


def test_splits_keep_groups_and_shares(spark, ws):
    rng = random.Random(3)
    rows = [(f"I{i:05d}", "big" if i % 10 == 0 else rng.choice([None, f" s{rng.randrange(900)}", f"S{rng.randrange(900)}"]), rng.choice([0, 0, 1, None]), rng.choice(["leg", "Hand ", None]), "x") for i in range(4000)]
    images = ws.keep(group_splits.related_images(spark.createDataFrame(rows + rows[:50], RECORD)), "images")
    out = spark.createDataFrame([(f"i{i:05d} ", f"n{i % 40}") for i in range(0, 4000, 13)] + [("I00001", None), (None, "n1"), ("gone", "n1")], "image_id string, near_group string")
    labelled = group_splits.labelled_units(out, images)
    _, roots = group_splits.spanning_forest(group_splits.label_edges(labelled, ws), ws)
    targets = spark.createDataFrame([("train", 0.7), ("validation", 0.1), ("test", 0.2)], "split string, share double")
    placed = {r.image_id: r for r in group_splits.assign(images, roots, targets, ws).collect()}
    assert len(placed) == 4000
    links = [(f"I{i:05d}", f"n{i % 40}") for i in range(0, 4000, 13)] + [(i, "st" + s.strip().upper()) for i, s, *_ in rows if s]
    comps = defaultdict(set)
    for x, root in union_find([(a, "~" + b) for a, b in links]).items():
        comps[root].add(x)
    for members in comps.values():
        assert len({placed[m].split for m in members if m in placed}) == 1
    counts = Counter(r.split for r in placed.values())
    assert abs(counts["train"] - 2800) < 60 and abs(counts["test"] - 800) < 60
    assert group_splits.assign(images.limit(0), roots, targets, ws).count() == 0
    assert {r.split for r in group_splits.assign(images, roots, targets.limit(0), ws).collect()} == {None}


def test_torn_labels(spark, ws):
    images = ws.keep(group_splits.related_images(spark.createDataFrame([(x, "s" if x in "cd" else None, 0, "leg", "") for x in "abcdef"], RECORD)), "images")
    out = spark.createDataFrame([("A", "n1"), ("b ", "N1 "), ("c", "n2"), ("d", "n2"), ("e", "n3"), ("f", "n3"), ("f", " ")], "image_id string, near_group string")
    listing = spark.createDataFrame([("a", "Train"), ("B", "valid"), ("c", "train"), ("d", "train"), ("e", "test"), ("f", None), ("zz", "val")], "image_id string, split string")
    labelled = group_splits.labelled_units(out, images)
    _, roots = group_splits.spanning_forest(group_splits.label_edges(labelled, ws), ws)
    assert [r.near_group for r in group_splits.torn_labels(listing, labelled, roots, ws).collect()] == ["N1"]


def test_seats_equal_a_global_sort():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randrange(1, 8)
        shares = {s: rng.choice([0, rng.randrange(1, 1000)]) for s in range(n)}
        available = {s: rng.randrange(40) for s in range(n)}
        floors = {s: rng.randrange(5) for s in range(n)}
        size = rng.randrange(60)
        records = sorted((r > floors[s], (r - 0.5) / shares[s] if shares[s] else float("inf"), s, r) for s in range(n) for r in range(1, available[s] + 1) if r <= floors[s] or shares[s])
        kept = sum(min(available[s], floors[s]) for s in shares)
        want = Counter(x[2] for x in records[: max(size, kept)])
        assert proportions.seats(available, shares, floors, size) == {s: want[s] for s in shares}


def test_sample_and_report(spark, ws):
    rows = [(f"I{i:04d}", i % 2, [" Leg", "hand"][i % 3 == 0], "frontal", 0) for i in range(1000)] + [("I0001", 1, " Leg", "frontal", 1), (None, 1, "leg", "frontal", 0), ("N", None, "leg", "frontal", 0), ("E", 1, "", None, 0)]
    images = spark.createDataFrame(rows, "image_id string, fractured int, anatomy string, view string, stratum_id int").drop("stratum_id")
    targets = spark.createDataFrame([(1, 0, "leg", "frontal", 500000, 1), (2, 1, "leg", "frontal", 400000, 1), (3, 1, "unknown", "unknown", 100000, 2), (4, 0, "hip", "frontal", 0, 3)], "stratum_id int, fractured int, anatomy string, view string, target_ppm int, min_rows int")
    sample, report = proportions.draw(images, targets, ws)
    got = Counter(r.stratum_id for r in sample.collect())
    lines = {r.stratum_id: r for r in report.collect()}
    assert sum(got.values()) == 100 and got[3] == 1 and abs(got[1] - 55) <= 1
    assert {s for s, r in lines.items() if r.available < r.needed} == {3, 4}
    assert all(lines[s].seats == got.get(s, 0) for s in lines)
    nothing, report = proportions.draw(images.limit(0), targets, ws)
    assert nothing.count() == 0 and report.count() == 4


def test_overlaps(spark, ws):
    images = [("A", "0xff", "0", "ab" * 16, "s"), ("B", "00fe", "0", None, "s"), ("C", "-", "0", "AB" * 16, None), ("D", "f" * 16, "1", None, "t"), ("E", None, None, None, "t"), ("F", "0f", "f" * 16, None, "t"), (None, "ff", "0", None, "t")]
    record = spark.createDataFrame([(*x, 0) for x in images] + [(*images[0], 1)], "image_id string, phash string, dhash string, pixel_md5 string, source string, n int")
    listing = spark.createDataFrame([("a ", "train"), ("b", "valid"), ("C", "test"), ("D", "train"), ("D", "Val"), ("e", "train"), ("E", "train"), ("F", "test"), ("zz", "val"), (None, "val"), ("A", None)], "image_id string, split string")
    listed = split_overlap.listed_images(record, listing)
    got = {(r.eval_id, r.train_id): r.coverage for r in split_overlap.overlaps(listed, ws).collect()}
    assert set(got) == {("B", "A"), ("C", "A"), ("D", "D")} and got["C", "A"] == 1 and got["B", "A"] == 1 - 1 / 128
    assert split_overlap.overlaps(listed.limit(0), ws).count() == 0 and split_overlap.counterparts(listed.limit(0), ws).count() == 0


def test_counterparts_count_what_overlaps_lists(spark, ws):
    rng = random.Random(12)
    bases = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(5)]
    rows = []
    for k in range(220):
        p, d = bases[0] if k % 3 == 0 else (flipped(rng, x, rng.randrange(4)) for x in rng.choice(bases))
        train, val, test = (rng.random() < 0.5 for _ in range(3))
        m = rng.choice([None, rng.randrange(9)])
        rows.append((f"i{k:03d}", "s", rng.choice([signed(p)] * 6 + [None]), rng.choice([signed(d)] * 6 + [None]), m, m, train, val, test))
    listed = ws.keep(spark.createDataFrame(rows, "image_id string, source string, p bigint, d bigint, hi bigint, lo bigint, train boolean, val boolean, test boolean"), "listed")
    want = defaultdict(list)
    for r in split_overlap.overlaps(listed, ws).collect():
        want[r.eval_id].append(r.coverage)
    got = {r.image_id: (r.counterparts, r.coverage) for r in split_overlap.counterparts(listed, ws).collect()}
    assert got == {i: (len(c), max(c)) for i, c in want.items()} and got


def test_consolidation(spark, ws):
    record = spark.createDataFrame([("A", "ff", 1), ("B", "0xFF", 1), ("C", None, 1), ("D", "1", 1), ("E", "-", 1), ("F", "-", 1), ("G", "2", 1), (None, "ff", 1), ("A", "ff", 2)], "image_id string, phash string, u int").drop("u")
    pairs = spark.createDataFrame([("b", "C "), ("C", "b"), ("D", "D"), ("D", "gone"), (None, "E")], "left_image_id string, right_image_id string")
    out = spark.createDataFrame([("d", "x1", ""), ("g\t", "X1 ", None), ("E", None, " n"), ("F", "", "N"), ("gone", None, "n")], "image_id string, exact_group string, near_group string")
    got = {r.image_id: r.group_id for r in consolidate.consolidate(pairs, out, record, ws).collect()}
    assert got == {"A": "A", "B": "A", "C": "A", "D": "D", "G": "D", "E": "E", "F": "E"}
    assert consolidate.consolidate(pairs.limit(0), out.limit(0), record.limit(0), ws).count() == 0


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    for path in (root / "sievemark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text()



def test_p1_found_runs_the_draw(spark, monkeypatch):
    kept = {}
    keep = proportions.Workspace.keep

    def seen(self, frame, label):
        kept[label] = keep(self, frame, label)
        return kept[label]

    monkeypatch.setattr(proportions.Workspace, "keep", seen)
    short = {r[0] for r in proportions.p1_found(spark, oracle.DATA).collect()}
    ranked = kept["ranked"]
    sample = proportions.p1_sample(spark, oracle.DATA)
    assert sample.count() and sorted(ranked.where("drawn").drop("drawn").collect()) == sorted(sample.collect())
    report = {r.stratum_id: r for r in proportions.p1_report(spark, oracle.DATA).collect()}
    counts = {r["stratum_id"]: r["count"] for r in ranked.groupBy("stratum_id").count().collect()}
    assert all(counts.get(s, 0) == r.available for s, r in report.items())
    assert short == {s for s, r in report.items() if r.shortfall}


def test_p2_report_has_coverage(spark):
    best = {r.image_id: r.coverage for r in split_overlap.p2_coverage(spark, oracle.DATA).collect()}
    listed, _ = split_overlap._prepared(spark, oracle.DATA, "p2t")
    rows = defaultdict(list)
    for r in listed.where("val or test").collect():
        for split in ("val", "test"):
            if r[split]:
                rows[split, r.source].append(best.get(r.image_id))
    report = split_overlap.p2_report(spark, oracle.DATA).collect()
    assert len(report) == len(rows) and any(r.overlapping for r in report)
    for r in report:
        every = rows[r.split, r.source]
        found = [c for c in every if c is not None]
        assert (r.images, r.overlapping) == (len(every), len(found)) and abs(r.share - len(found) / len(every)) < 1e-12
        assert r.coverage is None if not found else abs(r.coverage - sum(found) / len(found)) < 1e-12


def test_p3_forest_spans_the_groups(spark):
    edges = [(r.image_id_a, r.image_id_b) for r in group_splits.p3_forest(spark, oracle.DATA).collect()]
    group = {r.image_id: r.group_id for r in group_splits.p3_assignment(spark, oracle.DATA).collect()}
    parent = {x: x for x in group}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        assert group[a] == group[b] and find(a) != find(b)
        parent[find(a)] = find(b)
    assert len(edges) == len(group) - len(set(group.values())) > 0
