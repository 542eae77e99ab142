"""From duplicates to a clean manifest: groups, components, conflicts, decisions, splits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import Workspace
from .ordered import numbered, running

SEED = 20260912
RATIOS = {"test": 0.2, "train": 0.7, "validation": 0.1}


def duplicate_groups(records: DataFrame, digest: str) -> DataFrame:
    """Groups of more than one record with the same digest; null digests group nothing.

    Label sets are sorted and distinct; they grow with the values of a label, not with the
    members. Members stay in a relation of their own (``duplicate_members``).
    """
    sets = {"fractured": "fractured_labels", "fracture_count": "fracture_counts", "anatomy": "anatomies", "view": "views"}
    return (
        records.where(F.col(digest).isNotNull())
        .groupBy(F.col(digest).alias("digest"))
        .agg(F.count("*").alias("count"), F.min("image_id").alias("first_id"), *[F.array_sort(F.collect_set(c)).alias(n) for c, n in sets.items()])
        .where(F.col("count") > 1)
        .withColumn("redundant_count", F.col("count") - 1)
        .withColumn("label_conflict", F.size("fractured_labels") > 1)
    )


def duplicate_members(records: DataFrame, groups: DataFrame, digest: str) -> DataFrame:
    return records.join(groups.select(F.col("digest").alias(digest)), digest, "left_semi").select(F.col(digest).alias("digest"), "image_id")


def label_components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(node, root) of each node with an edge: root is the smallest node of its component.

    In each round every node, and the root it hangs from, takes the smallest root around the node, and then its
    root's root; trees merge and flatten at once, so rounds are logarithmic. Each is a written table.
    """
    tidy = edges.where("u != v").select("u", "v").union(edges.where("u != v").select(F.col("v"), F.col("u"))).distinct()
    both = ws.keep(tidy, "edges")
    labels = ws.keep(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("v"), F.col("root").alias("near")), "v").groupBy("u").agg(F.min("near").alias("near"))
        seen = labels.join(around, F.col("node") == F.col("u"))
        offers = seen.select("node", "near").union(seen.select(F.col("root").alias("node"), "near")).groupBy("node").agg(F.min("near").alias("near"))
        hooked = ws.keep(labels.join(offers, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("old")), "hooked")
        jump = hooked.select(F.col("node").alias("root"), F.col("root").alias("top"))
        new = ws.keep(hooked.join(jump, "root").select("node", F.least("root", "top").alias("root"), "old"), "labels")
        ws.drop(hooked)
        ws.drop(labels)
        labels = new
        if labels.where("root != old").isEmpty():
            return labels.select("node", "root")


def cleaning_decisions(records: DataFrame, near_pairs: DataFrame, ws: Workspace) -> DataFrame:
    """One decision per record (image_id, digest, fractured, decode_status).

    Exact groups with several labels lose all members; others keep one representative, strictly
    decoded ones first, then by id. Near pairs between surviving records form components; one with several
    labels loses all members, one without ties its members to one split group. Group ids number
    exact groups by falling size and digest, and components by their smallest member.
    """
    known = records.where("digest is not null")
    exact = (
        known.groupBy("digest")
        .agg(F.count("*").alias("n"), F.count_distinct("fractured").alias("labels"), F.min(F.struct((F.col("decode_status") != "strict").alias("bad"), "image_id")).alias("best"))
        .where("n > 1")
    )
    exact = numbered(exact, ws, [F.col("n").desc(), F.col("digest")], "no")
    exact = exact.select("digest", F.format_string("PX%03d", "no").alias("exact_group"), (F.col("labels") > 1).alias("exact_conflict"), F.col("best.image_id").alias("representative"))
    placed = ws.keep(
        records.join(exact, "digest", "left").withColumn("survives", F.col("exact_group").isNull() | (~F.col("exact_conflict") & (F.col("image_id") == F.col("representative")))),
        "placed",
    )
    alive = placed.where("survives").select("image_id")
    edges = (
        near_pairs.join(alive.select(F.col("image_id").alias("left")), "left", "left_semi")
        .join(alive.select(F.col("image_id").alias("right")), "right", "left_semi")
        .select(F.col("left").alias("u"), F.col("right").alias("v"))
    )
    roots = label_components(edges, ws)
    members = placed.select("image_id", "fractured").join(roots.select(F.col("node").alias("image_id"), "root"), "image_id")
    near = numbered(members.groupBy("root").agg((F.count_distinct("fractured") > 1).alias("near_conflict")), ws, [F.col("root")], "no")
    near = roots.join(near, "root").select(F.col("node").alias("image_id"), F.format_string("NEAR%03d", "no").alias("near_group"), "near_conflict")
    full = placed.join(near, "image_id", "left")
    torn, grouped = F.coalesce("near_conflict", F.lit(False)), F.col("near_group").isNotNull()
    single, lost = F.col("exact_group").isNull(), ~F.col("survives")
    return full.select(
        "image_id", "fractured",
        (F.col("survives") & ~torn).alias("include_provisional"),
        F.when(lost | torn, "exclude").when(~single, "keep_exact_group_representative").when(grouped, "keep_grouped_near_candidate").otherwise("keep_unique").alias("decision"),
        F.when(lost & F.col("exact_conflict"), "exact_pixel_duplicate_with_label_conflict").when(lost, F.concat(F.lit("exact_pixel_duplicate_of_"), F.col("representative")))
        .when(torn, "near_duplicate_group_with_label_conflict").when(grouped & single, "conservative_same_split_after_visual_review").otherwise("").alias("reason"),
        F.coalesce("exact_group", F.lit("")).alias("exact_group"), F.coalesce("near_group", F.lit("")).alias("near_group"),
        F.when(torn, "exclude_conflicting_component").when(grouped & single, "keep_same_split").otherwise("not_applicable").alias("near_review_decision"),
        F.when(grouped, F.col("near_group")).otherwise(F.concat(F.lit("IMAGE::"), F.col("image_id"))).alias("split_group"),
    )


def cleaning_summary(decisions: DataFrame) -> DataFrame:
    included = F.col("include_provisional")
    near_lost = F.col("reason") == "near_duplicate_group_with_label_conflict"
    return decisions.agg(
        F.count("*").alias("initial_records"),
        F.count_if(F.col("reason") == "exact_pixel_duplicate_with_label_conflict").alias("exact_conflict_members"),
        F.count_if(F.col("reason").startswith("exact_pixel_duplicate_of_")).alias("exact_redundant"),
        F.count_if(included | near_lost).alias("before_near_exclusions"),
        F.count_distinct(F.when(F.col("near_group") != "", F.col("near_group"))).alias("near_groups"),
        F.count_if(F.col("near_group") != "").alias("near_images"),
        F.count_if(near_lost).alias("near_conflict_members"),
        F.count_if(included).alias("after_exclusions"),
    )


def _group_strata(members: DataFrame, seed: int) -> DataFrame:
    """(split_group, size, stratum, place) of each group, place being its key in the order of dealing."""
    counts = members.groupBy("split_group", "fractured", "anatomy").agg(F.count("*").alias("n"))
    return (
        counts.withColumn("anatomy", F.coalesce("anatomy", F.lit("unknown")))
        .groupBy("split_group")
        .agg(F.sum("n").alias("size"), F.max("fractured").alias("label"), F.min(F.struct((-F.col("n")).alias("few"), "anatomy")).alias("m"))
        .select("split_group", "size", F.concat_ws("|", F.coalesce(F.col("label").cast("string"), F.lit("")), "m.anatomy").alias("stratum"), F.md5(F.concat(F.lit(f"{seed}:"), F.col("split_group"))).alias("place"))
    )


def deal_groups_by_size(members: DataFrame, ws: Workspace, seed: int = SEED, ratios: dict[str, float] | None = None) -> DataFrame:
    """(split_group, split, stratum) as from ``deal_groups``, for any size: groups stand in the same order, and a group goes to the
    split in whose part of the stratum the middle of its place in the cumulated size falls.

    The cumulated size is a running total over ranges of all strata together, so a stratum is as many tasks as it has
    ranges. Each stratum meets its shares within one group's size; which group goes where differs from the sequential rule.
    """
    shares = ratios or RATIOS
    named = ws.keep(_group_strata(members, seed), "groups")
    run = running(named, ws, [F.col("place"), F.col("split_group")], {"upto": "size"}, ("stratum",))
    totals = ws.keep(named.groupBy("stratum").agg(F.sum("size").alias("total")), "totals")
    middle = (F.col("upto") - F.col("size") / 2) / F.col("total")
    chosen, ends = None, 0.0
    names = sorted(shares, key=lambda s: (shares[s], s), reverse=True)
    for name in names[:-1]:
        ends += shares[name]
        chosen = F.when(middle <= ends, name) if chosen is None else chosen.when(middle <= ends, name)
    split = F.lit(names[-1]) if chosen is None else chosen.otherwise(names[-1])
    return run.join(totals, "stratum").select("split_group", split.alias("split"), "stratum")


def deal_groups(members: DataFrame, ws: Workspace, seed: int = SEED, ratios: dict[str, float] | None = None) -> DataFrame:
    """(split_group, split) for ``members`` (split_group, fractured, anatomy), one row per record.

    A stratum is a group's label and commonest anatomy (ties: the smaller name). Within it, groups
    go in the order of md5(seed:group) to the split that lacks most against its share of the
    stratum's records; ties go to the greater share, then the later name. The order is sequential by
    definition; a stratum streams through one task that holds one counter per split.
    """
    shares = ratios or RATIOS
    named = ws.keep(_group_strata(members, seed), "groups")
    totals = named.groupBy("stratum").agg(F.sum("size").alias("total"))
    rows = named.join(totals, "stratum").select("stratum", "place", "split_group", "size", "total")
    names = sorted(shares, key=lambda s: (shares[s], s), reverse=True)

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, lack = None, []
        for part in parts:
            chosen = []
            for stratum, size, total in zip(part["stratum"].to_pylist(), part["size"].to_pylist(), part["total"].to_pylist(), strict=True):
                if stratum != current:
                    current, lack = stratum, [total * shares[s] for s in names]
                best = max(range(len(names)), key=lambda i: (lack[i], -i))
                lack[best] -= size
                chosen.append(names[best])
            yield pa.RecordBatch.from_arrays([part["split_group"], pa.array(chosen, pa.string()), part["stratum"]], names=["split_group", "split", "stratum"])

    return rows.repartition("stratum").sortWithinPartitions("stratum", "place", "split_group").mapInArrow(deal, "split_group string, split string, stratum string")


def torn_keys(manifest: DataFrame, key: str) -> DataFrame:
    """Values of a key that lie in more than one split; must be empty after a split."""
    return manifest.where(F.col(key).isNotNull() & F.col("split").isNotNull()).groupBy(F.col(key).alias("value")).agg(F.min("split").alias("a"), F.max("split").alias("b"), F.count("*").alias("records")).where("a != b").select(F.lit(key).alias("key"), "value", "records")


def pick_middle(records: DataFrame, ws: Workspace, bucket: list[str], count: int) -> DataFrame:
    """Quality sample: buckets take turns, each giving the middle one of its remaining records.

    Closed form: with 0-based place i by id in a bucket of n and m = n div 2, records leave in the order of
    |i - m|, the side depending on whether n is odd. Only the first ``count`` turns matter.
    """
    keyed = records.withColumn("bucket", F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in bucket])).select("image_id", "bucket")
    placed = numbered(keyed, ws, [F.col("image_id")], "i", ("bucket",))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("n"))
    i, m = F.col("i") - 1, F.floor(F.col("n") / 2)
    # odd n: the upper neighbour leaves first; even n: the lower one does
    early = F.when(F.col("n") % 2 == 1, i > m).otherwise(i < m)
    turn = 2 * F.abs(i - m) - F.when(early, 1).otherwise(0)
    return placed.join(sizes, "bucket").select("image_id", "bucket", turn.cast("bigint").alias("turn")).orderBy("turn", "bucket").limit(count)


def pick_in_turns(records: DataFrame, ws: Workspace, bucket: Column, order: str, count: int) -> DataFrame:
    """Sample: buckets take turns by name, each giving its next record by ``order``."""
    placed = numbered(records.select(F.col(order), bucket.alias("bucket")), ws, [F.col(order)], "turn", ("bucket",))
    return placed.orderBy("turn", "bucket").limit(count)
