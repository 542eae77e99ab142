"""Problem 3: train, validation and test splits that keep related images together.

Related images form units first: images of one study are one unit, an image without a
study is one of its own. near_group labels link units. A spanning forest of these links is
built by minimum-edge contraction (Boruvka); ``p3_forest`` returns it, and its trees are the groups that
must not be torn. Groups are stratified by fractured, anatomy and size band and dealt to
the splits along a random order, systematically by cumulated size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import label_key, level, reference_key, split_name
from ..operators.prefix import hash_order, running_sum, sections_for
from ..sources.tables import table
from ..storage import Workspace

SEED = 20260912
#: A group with over one image in GIANT is placed by itself: there are at most GIANT of them.
GIANT = 1000


def spanning_forest(edges: DataFrame, ws: Workspace, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(forest, roots) of an undirected graph given as edges (u, v).

    forest: (root, u, v), a written table of the edges kept, one fewer than nodes in each component. roots: (node,
    root) for each node with an edge to another, read off the forest. In each round every component picks its smallest edge
    by (hash, u, v); picked edges are contracted. At least half of the components vanish
    each round, so rounds are logarithmic; each ends in written tables, and those of the round before are
    deleted. Loops, repeated edges and null ends are ignored.
    """
    tidy = edges.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    left = ws.keep(tidy.select(F.col("u").alias("a"), F.col("v").alias("b"), "u", "v", F.xxhash64("u", "v", F.lit(seed)).alias("w")), "edges")
    nodes = left.select(F.inline(F.array(F.struct(F.col("u").alias("node")), F.struct(F.col("v").alias("node"))))).distinct()
    labels = ws.keep(nodes.select("node", F.col("node").alias("root")), "labels")
    rounds = [left.select("u", "v").limit(0)]
    while not left.isEmpty():
        ends = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b"), "u", "v", "w"))
        picked = ws.keep(ends.groupBy("a").agg(F.min(F.struct("w", "u", "v", "b")).alias("e")).select("a", F.col("e.b").alias("b"), F.col("e.u").alias("u"), F.col("e.v").alias("v")), "picked")
        rounds.append(picked.select("u", "v"))
        # Edges are totally ordered, so picks form trees with one pair that picked each other.
        back = picked.select(F.col("a").alias("b"), F.col("b").alias("beyond"))
        up = ws.keep(picked.join(back, "b").select("a", F.when((F.col("beyond") == F.col("a")) & (F.col("a") < F.col("b")), F.col("a")).otherwise(F.col("b")).alias("to"), F.lit(True).alias("moved")), "up")
        while not up.where("moved").isEmpty():
            further = up.join(up.select(F.col("a").alias("to"), F.col("to").alias("top")), "to").select("a", F.col("top").alias("to"), (F.col("top") != F.col("to")).alias("moved"))
            further = ws.keep(further, "jump")
            ws.drop(up)
            up = further
        tops = up.select("a", "to")
        joined = labels.join(tops.select(F.col("a").alias("root"), "to"), "root", "left")
        new_labels = ws.keep(joined.select("node", F.coalesce("to", "root").alias("root")), "labels")
        on_a = left.join(tops, "a").select(F.col("to").alias("a"), "b", "u", "v", "w")
        on_b = on_a.join(tops.select(F.col("a").alias("b"), "to"), "b").select("a", F.col("to").alias("b"), "u", "v", "w")
        new_left = ws.keep(on_b.where("a != b"), "edges")
        for old in (labels, left, up):
            ws.drop(old)
        labels, left = new_labels, new_left
    kept = reduce(DataFrame.union, rounds).distinct()
    forest = ws.keep(kept.join(labels.select(F.col("node").alias("u"), "root"), "u").select("root", "u", "v"), "forest")
    roots = forest.select("root", F.inline(F.array(F.struct(F.col("u").alias("node")), F.struct(F.col("v").alias("node"))))).distinct()
    return forest, ws.keep(roots.select("node", "root"), "roots")


def related_images(image_record: DataFrame) -> DataFrame:
    """(image_key, image_id, unit, fractured, anatomy): one row per image with its unit.

    A study is compared without case and outer white space; null or blank is no study.
    Deliveries that disagree count by their greatest value.
    """
    study = label_key(F.col("study_id"))
    return (
        image_record.where("image_id is not null")
        .select(reference_key(F.col("image_id")).alias("image_key"), "image_id", study.alias("study"), "fractured", level(F.col("anatomy")).alias("anatomy"))
        .groupBy("image_key")
        .agg(F.min("image_id").alias("image_id"), F.max("study").alias("study"), F.max("fractured").alias("fractured"), F.max("anatomy").alias("anatomy"))
        .select("image_key", "image_id", F.coalesce(F.concat(F.lit("S:"), F.col("study")), F.concat(F.lit("I:"), F.col("image_key"))).alias("unit"), F.coalesce("fractured", F.lit(-1)).alias("fractured"), "anatomy")
    )


def labelled_units(exclusions: DataFrame, images: DataFrame) -> DataFrame:
    """(label, image_key, unit): the images of each near_group label."""
    rows = exclusions.select(reference_key(F.col("image_id")).alias("image_key"), label_key(F.col("near_group")).alias("label")).where("image_key is not null and label is not null").distinct()
    return rows.join(images.select("image_key", "unit"), "image_key").select("label", "image_key", "unit")


def label_edges(labelled: DataFrame, ws: Workspace) -> DataFrame:
    """Each unit of a label linked to the label's smallest unit."""
    # written, so that adaptive execution can split the rows of a label that very many images share
    hubs = ws.keep(labelled.groupBy("label").agg(F.min("unit").alias("v"), F.max("unit").alias("last")).where("v != last").select("label", "v"), "hubs")
    return labelled.select("label", F.col("unit").alias("u")).join(hubs, "label").where("u != v").select("u", "v")


def _place_large(large: DataFrame, whole: int, shares: list[tuple[str, float]]) -> list[tuple[str, str]]:
    """(group_id, split) of the groups with over 1/GIANT of all images: at most GIANT rows come to the driver.

    Largest first, each to a split that has room for half of it at least, and there to the one that lacks most in the
    stratum the group counts to.
    """
    placed: list[tuple[str, str]] = []
    have = dict.fromkeys((s for s, _ in shares), 0.0)
    taken: dict[tuple[str, str], float] = {}
    rows = large.select("group_id", "size", "stratum", "own", "n").collect()
    for r in sorted(rows, key=lambda r: (-r["size"], r["group_id"])):
        best = max(shares, key=lambda s: (s[1] * whole - have[s[0]] >= r["size"] / 2, s[1] * r["n"] - taken.get((r["stratum"], s[0]), 0.0), s[0]))[0]
        placed.append((r["group_id"], best))
        have[best] += r["size"]
        taken[r["stratum"], best] = taken.get((r["stratum"], best), 0.0) + r["own"]
    return placed


def assign(images: DataFrame, roots: DataFrame, targets: DataFrame, ws: Workspace, seed: int = SEED) -> DataFrame:
    """(image_id, split, group_id): every image with its split; a group is in one split only.

    ``images`` as from ``related_images``, ``roots`` (node, root) over units, ``targets``
    (split, share), a few rows. Groups of over 1/GIANT of all images are placed one by one; there are at most GIANT of them. All others are dealt per lane, a stratum
    (commonest fractured and anatomy) and size band (powers of two), along a hash order: a group
    goes where the middle of its place in the cumulated size falls, counted from a random start of the lane, the shares corrected
    for what the large groups took of that stratum. No target rows: no split (null).
    """
    spark = images.sparkSession
    stratum = F.concat_ws("|", F.col("fractured").cast("string"), "anatomy")
    grouped = images.join(roots.select(F.col("node").alias("unit"), "root"), "unit", "left").select("image_id", F.coalesce("root", "unit").alias("group_id"), stratum.alias("stratum"))
    grouped = ws.keep(grouped, "grouped")
    shares = sorted((r["split"], float(r["share"])) for r in targets.where("split is not null and share is not null").collect())
    if not shares:
        return grouped.select("image_id", F.lit(None).cast("string").alias("split"), "group_id")
    mixes = ws.keep(grouped.groupBy("group_id", "stratum").agg(F.count("*").alias("n")), "mixes")
    groups = ws.keep(
        mixes.groupBy("group_id").agg(F.sum("n").alias("size"), F.max(F.struct("n", "stratum")).alias("m"))
        .select("group_id", "size", F.col("m.stratum").alias("stratum"), F.col("m.n").alias("own"), F.log2("size").cast("int").alias("band")),
        "groups",
    )
    strata = ws.keep(mixes.groupBy("stratum").agg(F.sum("n").alias("n")), "strata")
    whole = strata.agg(F.sum("n").alias("n")).first()["n"] or 0
    large = groups.where(F.col("size") * GIANT > whole)
    placed = spark.createDataFrame(_place_large(large.join(strata, "stratum"), whole, shares), "group_id string, split string")
    # What the large groups took of each stratum leaves the rest of it other shares.
    took = mixes.join(F.broadcast(placed), "group_id").groupBy("stratum").agg(*[F.sum(F.when(F.col("split") == s, F.col("n")).otherwise(0)).alias(f"_t{i}") for i, (s, _) in enumerate(shares)])
    wanted = [F.greatest(F.lit(0.0), F.lit(share) * F.col("n") - F.coalesce(f"_t{i}", F.lit(0))) for i, (_, share) in enumerate(shares)]
    total, run = reduce(lambda a, b: a + b, wanted), reduce(lambda a, b: [*a, a[-1] + b], wanted[1:], wanted[:1])
    given = reduce(lambda a, b: [*a, a[-1] + b[1]], shares[1:], [shares[0][1]])
    ends = F.array(*[F.struct(F.lit(s).alias("split"), F.when(total > 0, r / total).otherwise(F.lit(g)).alias("upto")) for (s, _), r, g in zip(shares, run, given, strict=True)])
    cuts = ws.keep(strata.join(took, "stratum", "left").select("stratum", ends.alias("ends")), "cuts")
    rest = groups.join(F.broadcast(placed.select("group_id")), "group_id", "left_anti").withColumn("lane", F.concat_ws("|", "stratum", F.col("band").cast("string"))).withColumn("_order", hash_order(F.col("group_id"), seed))
    rest = ws.keep(rest, "rest")
    lanes = ws.keep(rest.groupBy("lane").agg(F.sum("size").alias("_whole")), "lanes")
    start = F.pmod(F.xxhash64("lane", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    middle = F.pmod((F.col("_upto") - F.col("size") / 2) / F.col("_whole") + start, F.lit(1.0))
    chosen = F.filter("ends", lambda e: e["upto"] >= F.col("_middle"))
    dealt = (
        running_sum(rest, "lane", "_order", "group_id", "size", "_upto", max(64, sections_for(rest.count()) // 8)).join(lanes, "lane").withColumn("_middle", middle).join(cuts, "stratum")
        .select("group_id", F.coalesce(F.get(chosen, F.lit(0))["split"], F.element_at("ends", -1)["split"]).alias("split"))
    )
    return grouped.join(ws.keep(dealt.union(placed), "dealt"), "group_id").select("image_id", "split", "group_id")


def torn_labels(official_split: DataFrame, labelled: DataFrame, roots: DataFrame, ws: Workspace) -> DataFrame:
    """near_group labels whose images are listed under more than one split.

    A torn label lies in a tree of the forest that more than one split lists: the trees give the
    candidates, and within those trees each label is then looked at by itself.
    """
    listed = official_split.select(reference_key(F.col("image_id")).alias("image_key"), split_name(F.col("split")).alias("split")).where("image_key is not null and split is not null").distinct()
    rows = labelled.join(listed, "image_key").join(roots.select(F.col("node").alias("unit"), "root"), "unit", "left").select(F.coalesce("root", "unit").alias("root"), "label", "split").distinct()
    rows = ws.keep(rows, "listed")
    crossed = ws.keep(rows.groupBy("root").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a != b").select("root"), "crossed")
    within = rows.join(crossed, "root", "left_semi").groupBy("label").agg(F.min("split").alias("a"), F.max("split").alias("b"))
    return within.where("a != b").select(F.col("label").alias("near_group"))


def image_forest(images: DataFrame, forest: DataFrame, ws: Workspace) -> DataFrame:
    """(image_id_a, image_id_b, link): a spanning forest of the images, one edge fewer than images in each group.

    link study: an image and the smallest of its unit. link near_group: the smallest images of
    two units that ``forest`` (root, u, v) joins. A group without an edge is a single image.
    """
    heads = ws.keep(images.groupBy("unit").agg(F.min("image_id").alias("head")), "heads")
    inside = images.join(heads, "unit").where("image_id != head").select(F.col("head").alias("image_id_a"), F.col("image_id").alias("image_id_b"), F.lit("study").alias("link"))
    u, v = heads.select(F.col("unit").alias("u"), F.col("head").alias("a")), heads.select(F.col("unit").alias("v"), F.col("head").alias("b"))
    across = forest.join(u, "u").join(v, "v").select(F.least("a", "b").alias("image_id_a"), F.greatest("a", "b").alias("image_id_b"), F.lit("near_group").alias("link"))
    return inside.union(across)


def _related(spark: SparkSession, folder: str, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    images = ws.keep(related_images(table(spark, folder, "image_record", "image_id", "study_id", "fractured", "anatomy")), "images")
    return images, ws.keep(labelled_units(table(spark, folder, "exclusions", "image_id", "near_group"), images), "labelled")


def _forest(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, DataFrame, DataFrame, Workspace]:
    ws = Workspace(spark, name)
    images, labelled = _related(spark, folder, ws)
    _, roots = spanning_forest(label_edges(labelled, ws), ws)
    return images, labelled, roots, ws


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    _, labelled, roots, ws = _forest(spark, folder, "p3")
    return torn_labels(table(spark, folder, "official_split", "image_id", "split"), labelled, roots, ws)


def p3_assignment(spark: SparkSession, folder: str) -> DataFrame:
    images, _, roots, ws = _forest(spark, folder, "p3a")
    return assign(images, roots, table(spark, folder, "split_target"), ws)


def p3_forest(spark: SparkSession, folder: str) -> DataFrame:
    """The spanning forest behind the groups, for a caller to write and use again."""
    ws = Workspace(spark, "p3f")
    images, labelled = _related(spark, folder, ws)
    forest, _ = spanning_forest(label_edges(labelled, ws), ws)
    return image_forest(images, forest, ws)


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """(split, fractured, anatomy, images): how the assignment is spread."""
    images, _, roots, ws = _forest(spark, folder, "p3r")
    placed = assign(images, roots, table(spark, folder, "split_target"), ws)
    return placed.join(images.select("image_id", "fractured", "anatomy"), "image_id").groupBy("split", "fractured", "anatomy").agg(F.count("*").alias("images"))
