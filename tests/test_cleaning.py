"""Duplicates, components, decisions, splits, samples, references."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sievemark.functions import scalar
from sievemark.functions.identity import digest128, hash64, label_key, level, reference_key, split_name
from sievemark.operators import cleaning, hamming, orphans, validate
from sievemark.operators.ordered import numbered, running
from sievemark.operators.prefix import hash_order, running_sum


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def test_values_whatever_the_notation(spark):
    texts = ["0xFF", "ff", " FF\t", "00:00:00:ff", "00000000000000ff", "-", "none", "n/a", "", None, "f" * 17, "ffffffffffffffff"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in rows.orderBy("i").select(hash64(F.col("t"))).collect()]
    assert got == [255] * 5 + [None] * 6 + [-1]
    digests = ["ab" * 16, "AB" * 16 + " ", "md5:" + "ab" * 16, "abababab-abab-abab-abab-abababababab", "ab", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(digests)], "i int, t string")
    got = [r[0] for r in rows.orderBy("i").select(digest128(F.col("t"))).collect()]
    assert len(set(got[:4])) == 1 and got[4:] == [None, None]
    one = spark.createDataFrame([("  Img1.JPG\t", " ", None, "Validation ", " Hand ")], "a string, b string, c string, d string, e string")
    assert tuple(one.select(reference_key(F.col("a")), label_key(F.col("b")), level(F.col("c")), split_name(F.col("d")), level(F.col("e"))).first()) == ("IMG1.JPG", None, "unknown", "val", "hand")


def test_components(spark, ws):
    rng = random.Random(4)
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)]
    edges = chain + [(f"n{rng.randrange(80):02d}", f"n{rng.randrange(80):02d}") for _ in range(60)] + [("x", "x"), (None, "y"), ("a", "b"), ("a", "b")]
    got = {r.node: r.root for r in cleaning.label_components(spark.createDataFrame(edges, "u string, v string"), ws).collect()}
    assert got == union_find(edges)
    assert cleaning.label_components(spark.createDataFrame([], "u string, v string"), ws).count() == 0


def test_near_candidates_against_all_pairs(spark):
    rng = random.Random(6)
    bases = [rng.getrandbits(64) for _ in range(6)]
    flip = lambda v, n: v ^ sum(1 << b for b in rng.sample(range(64), n))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    rows = [(f"i{k:03d}", rng.choice("ab"), flip(rng.choice(bases), rng.randrange(7)), rng.choice([None, flip(bases[0], rng.randrange(4))])) for k in range(150)]
    frame = spark.createDataFrame([(i, g, signed(p), None if d is None else signed(d)) for i, g, p, d in rows], "key string, block string, p bigint, d bigint")
    got = sorted((r.left, r.right) for r in hamming.near_candidates(frame, "block", "key", {"p": 4, "d": 2}).collect())
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and ((a[2] ^ b[2]).bit_count() <= 4 or (a[3] is not None and b[3] is not None and (a[3] ^ b[3]).bit_count() <= 2)))
    assert got == want and want


def test_hamming(spark):
    assert tuple(spark.range(1).select(scalar.hamming_hex(F.lit("0f"), F.lit("0f")), scalar.hamming_hex(F.lit("00"), F.lit("ff"))).first()) == (0, 8)


def test_decisions(spark, ws):
    rows = [("a", "d1", 0, "strict"), ("b", "d1", 0, "truncated"), ("c", "d2", 0, "strict"), ("d", "d2", 1, "strict"), ("e", None, 1, "strict"), ("f", None, 1, "strict"), ("g", None, 0, "strict"), ("h", None, 1, "strict")]
    records = spark.createDataFrame(rows, "image_id string, digest string, fractured int, decode_status string")
    pairs = spark.createDataFrame([("e", "f"), ("g", "h"), ("c", "e"), ("b", "a")], "left string, right string")
    got = {r.image_id: r for r in cleaning.cleaning_decisions(records, pairs, ws).collect()}
    assert got["a"].decision == "keep_exact_group_representative" and got["b"].reason == "exact_pixel_duplicate_of_a"
    assert got["c"].reason == got["d"].reason == "exact_pixel_duplicate_with_label_conflict"
    assert got["e"].decision == got["f"].decision == "keep_grouped_near_candidate" and got["e"].split_group == "NEAR001"
    assert got["g"].near_review_decision == "exclude_conflicting_component" and not got["h"].include_provisional


def test_deal_keeps_groups_and_shares(spark, ws):
    rng = random.Random(1)
    members = [(f"g{rng.randrange(300)}", 0, "leg") for _ in range(1000)]
    frame = spark.createDataFrame(members, "split_group string, fractured int, anatomy string")
    dealt = {r.split_group: r.split for r in cleaning.deal_groups(frame, ws).collect()}
    assert set(dealt) == {m[0] for m in members}
    sizes = defaultdict(int)
    for m in members:
        sizes[dealt[m[0]]] += 1
    assert abs(sizes["train"] - 700) < 15 and abs(sizes["test"] - 200) < 15
    assert cleaning.deal_groups(frame.limit(0), ws).count() == 0


def test_pick_middle_against_popping(spark, ws):
    rows = [(f"i{k:03d}", k % 3, "b" if k % 7 else None) for k in range(45)]
    frame = spark.createDataFrame(rows, "image_id string, x int, y string")
    got = [r.image_id for r in cleaning.pick_middle(frame, ws, ["x", "y"], 30).collect()]
    buckets = defaultdict(list)
    for i, x, y in sorted(rows):
        buckets[f"{x}|{y or ''}"].append(i)
    want = []
    while len(want) < 30:
        for k in sorted(buckets):
            if buckets[k] and len(want) < 30:
                want.append(buckets[k].pop(len(buckets[k]) // 2))
    assert got == want


def test_running_totals(spark, ws):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b", None]), rng.randrange(10)) for i in range(500)]
    frame = spark.createDataFrame(rows, "id bigint, g string, n bigint").repartition(7)
    got = {r.id: (r.a, r.b) for r in running(running_sum(frame.withColumn("o", hash_order(F.col("id"), 1)), "g", "o", "id", "n", "a"), ws, [F.col("id")], {"b": "n"}, ("g",)).select("id", "a", "b").collect()}
    order = {r.id: r.o for r in frame.withColumn("o", hash_order(F.col("id"), 1)).collect()}
    for i, g, _ in rows:
        own = [r for r in rows if r[1] == g]
        unsigned = lambda v: v % (1 << 64)
        assert got[i][1] == sum(r[2] for r in own if r[0] <= i)
        assert got[i][0] == sum(r[2] for r in own if (unsigned(order[r[0]]) >> 55, order[r[0]], r[0]) <= (unsigned(order[i]) >> 55, order[i], i))
    assert sorted(r.no for r in numbered(frame, ws, [F.col("id")], "no").collect()) == list(range(1, 501))


def test_constraints(spark):
    frame = spark.createDataFrame([("a.jpg",), ("a.jpg",)], "image_id string")
    with pytest.raises(validate.ConstraintError):
        validate.require_unique(frame, "image_id")
    with pytest.raises(validate.ConstraintError):
        validate.require_unique(frame, "other")
    with pytest.raises(validate.ConstraintError):
        validate.require_same_members(frame, frame.where("false"), "image_id")
    validate.require_unique(frame.distinct(), "image_id")
    lines = spark.createDataFrame([("0 0.5 0.4 0.2 0.1",), ("0 0.5 0.4 0.0 0.1",), ("0 0.5",), ("x 1 1 1 1",), ("1 0.5 0.4 0.2 0.1",), ("",), (None,)], "line string")
    assert [r[0] for r in lines.select(validate.label_fault()).collect()] == [None, "out of range", "malformed", "malformed", "out of range", "malformed", None]
    gate = lambda s, d: spark.range(1).select(validate.archive_gate(F.lit(s), F.lit(d), 12, "AB")).first()[0]
    assert (gate(12, "ab"), gate(11, "ab"), gate(12, "cd")) == ("accepted", "size mismatch", "digest mismatch")
    assert [r[0] for r in spark.createDataFrame([("text/plain", 5), ("image/png", 0), ("image/png", 5), (None, None)], "t string, n bigint").select(validate.upload_gate(F.col("t"), F.col("n"))).collect()] == [415, 413, 200, 415]


LIFE = "image_id string, ingested_at timestamp_ntz, withdrawn_at timestamp_ntz, fracture_count int, n int"


def test_orphans(spark, ws):
    from datetime import datetime as t

    images = spark.createDataFrame([("IMG1.jpg", t(2024, 1, 5), None, 2, 0), ("IMG1.jpg", t(2024, 1, 3), None, 2, 0), ("IMG2.jpg", t(2024, 1, 1), t(2024, 2, 1), None, 0), (None, t(2024, 1, 1), None, 1, 0)], LIFE)
    life = orphans.image_life(images)
    rows = [(1, "IMG1.JPG", t(2024, 1, 4), 2), (2, "IMG1.JPG", t(2024, 1, 2), 2), (3, "IMG1.JPG", t(2024, 3, 1), 3), (4, "IMG2.JPG", t(2024, 2, 2), 9), (5, "IMG2.JPG", t(2024, 1, 2), 9), (6, "NONE", None, None), (7, None, t(2024, 1, 1), 1), (8, "IMG1.JPG", None, None), (9, "", t(2024, 1, 1), 1)]
    frame = spark.createDataFrame(rows, "ref_id bigint, image_key string, recorded_at timestamp_ntz, c int")
    got = {r.ref_id for r in orphans.direct_orphans(frame, life, F.col("c")).where("orphan").collect()}
    assert got == {2, 3, 4, 6, 9}
    empty = frame.limit(0)
    assert orphans.direct_orphans(empty, life, F.col("c")).count() == 0
    assert orphans.direct_orphans(frame, life.limit(0), F.col("c")).where("orphan").count() == 8


def test_cascade_inherits_down_the_graph(spark, ws):
    make = lambda rows: spark.createDataFrame([(i, k, k2, o, None) for i, k, k2, o in rows], "ref_id bigint, a string, b string, orphan boolean, recorded_at timestamp_ntz")
    tables = {
        "one": make([(1, "x", None, True), (2, "y", None, False), (3, "y", None, True), (4, None, None, False)]),
        "two": make([(1, "x", "p", False), (2, "y", "q", False), (3, "z", "r", False), (4, None, "s", False)]),
        "three": make([(1, None, "p", False), (2, None, "q", False), (3, None, None, False), (4, None, "nowhere", False)]),
    }
    refs = [orphans.Reference("two", "one", "a"), orphans.Reference("three", "two", "b", required=True)]
    got = {(r.ref_table, r.ref_id, r.kind) for r in orphans.cascade(tables, refs, ws).collect()}
    assert got == {("one", 1, "direct"), ("one", 3, "direct"), ("two", 1, "inherited"), ("three", 1, "inherited"), ("three", 4, "inherited")}
    loop = [orphans.Reference("one", "two", "a"), orphans.Reference("two", "one", "a")]
    assert orphans.cascade({k: tables[k] for k in ("one", "two")}, loop, ws).count() >= 3


def test_every_near_pair_reaches_a_page(spark, tmp_path):
    from sievemark import plans

    rows = [(1, None, 1, 0.9), (2, 0, None, 0.9), (3, 0, 2, None), (4, 0, 2, 0.5), (5, 4, 0, 0.99), (6, None, None, None)] + [(i, 3, 3, 0.5) for i in range(7, 13)]
    spark.createDataFrame(rows, "pair_id bigint, phash_distance int, dhash_distance int, global_ssim double").write.parquet(f"{tmp_path}/near_pair.parquet")
    pages = sorted(plans.QUERIES["contact_sheet_all_pages"](spark, str(tmp_path)).collect(), key=lambda r: r.place)
    assert [r.pair_id for r in pages] == [4, 3, 2, *range(7, 13), 5, 1, 6]
    assert [r.place for r in pages] == list(range(1, 13)) and [r.page for r in pages] == [0] * 10 + [1] * 2


def test_near_pair_places_rank_the_pairs(spark):
    import oracle
    from sievemark import plans

    pairs = {tuple(r) for r in plans.QUERIES["near_pair_ranking"](spark, oracle.DATA).collect()}
    rows = sorted(plans.QUERIES["near_pair_places"](spark, oracle.DATA).collect(), key=lambda r: r.place)
    assert {(r.left_image_id, r.right_image_id) for r in rows} == pairs and len(rows) == len(pairs) > 0
    last = lambda x: (x is None, x or 0)
    order = [(last(r.phash_distance), last(r.dhash_distance), last(None if r.global_ssim is None else -r.global_ssim), r.pair_id) for r in rows]
    assert order == sorted(order) and [r.place for r in rows] == list(range(1, len(rows) + 1))
    assert any(r.phash_distance is None for r in rows) and {"anatomy", "label_conflict"} <= set(rows[0].asDict())


def test_references_to_one_image_are_split(spark, ws):
    """A third of all references name one image: adaptive execution must split their partition."""
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2.0", "spark.sql.shuffle.partitions": "12"}
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        moment = F.lit("2024-01-01").cast("timestamp_ntz")
        images = spark.range(5000).select(F.concat(F.lit("I"), F.col("id")).alias("image_id"), moment.alias("ingested_at"), F.lit(None).cast("timestamp_ntz").alias("withdrawn_at"), F.lit(1).alias("fracture_count"))
        life = ws.keep(orphans.image_life(images), "life")
        refs = ws.keep(spark.range(0, 30000, 1, 16).select(F.col("id").alias("ref_id"), F.when(F.col("id") % 3 == 0, "I7").otherwise(F.concat(F.lit("I"), F.col("id") % 6000)).alias("image_key"), moment.alias("recorded_at")), "refs")
        joined = orphans.direct_orphans(refs, life)
        assert joined.where("orphan").count() == sum(i % 3 > 0 and i % 6000 >= 5000 for i in range(30000))
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
