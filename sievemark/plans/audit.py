"""Queries on the inventory: duplicates, cleaning, splits, samples, label formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.identity import label_key, level, reference_key
from ..operators import cleaning, hamming, validate
from ..operators.boxes import alignment_errors
from ..operators.ordered import numbered
from ..sources import files
from ..sources.tables import table
from ..storage import Workspace
from . import views
from .catalogue import query
from .views import SQL_ANNOTATIONS, SQL_INVENTORY, SQL_SPLIT, inventory, listing, sql_key

INV = f"with {SQL_INVENTORY} "


@query("scan_inventory", INV + "select image_id, 'images/' || case when fractured = 1 then 'Fractured' else 'Non_fractured' end || '/' || image_id as canonical_path, regexp_replace(image_id, '\\.[^.]*$', '') || '.txt' as label_file, fractured, fracture_count, anatomy, view, width, height, decode_status, size_bytes, digest from inv")
def scan_inventory(spark: SparkSession, folder: str) -> DataFrame:
    rows = inventory(spark, folder, "image_id", "fractured", "fracture_count", "anatomy", "view", "width", "height", "decode_status", "size_bytes", "digest")
    return rows.select("image_id", scalar.canonical_path(F.col("image_id"), F.col("fractured")).alias("canonical_path"), scalar.with_suffix(F.col("image_id"), ".txt").alias("label_file"), "fractured", "fracture_count", "anatomy", "view", "width", "height", "decode_status", "size_bytes", "digest")


_STATUS = "case when decode_status = 'strict' then 'record' when decode_status like '%recovered%' then 'warning' else 'error' end"


@query("decode_outcomes", INV + f"select {_STATUS} as outcome, decode_status, mode, count(*) as images from inv group by 1, 2, 3")
def decode_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """The scan's three outputs by status: good records, recovered ones, errors."""
    status = F.col("decode_status")
    outcome = F.when(status == "strict", "record").when(status.contains("recovered"), "warning").otherwise("error")
    return inventory(spark, folder, "image_id", "decode_status", "mode").groupBy(outcome.alias("outcome"), "decode_status", "mode").agg(F.count("*").alias("images"))


@query("anatomy_flags", "select image_id, flags, first_anatomy, coalesce(nullif(flags, 'unknown'), '') as plain from (select o_orderkey as image_id, coalesce(nullif(concat_ws('+', case when o_orderkey % 2 = 0 then 'hand' end, case when o_orderkey % 3 = 0 then 'leg' end, case when o_orderkey % 5 = 0 then 'hip' end), ''), 'unknown') as flags, case when o_orderkey % 2 = 0 then 'hand' when o_orderkey % 3 = 0 then 'leg' when o_orderkey % 5 = 0 then 'hip' else 'unknown' end as first_anatomy from orders)")
def anatomy_flags(spark: SparkSession, folder: str) -> DataFrame:
    """One-hot flags to one label, in the three conventions."""
    key = F.col("o_orderkey")
    flags = table(spark, folder, "orders", "o_orderkey").select(key.alias("image_id"), *[(key % m == 0).cast("int").alias(n) for n, m in (("hand", 2), ("leg", 3), ("hip", 5))])
    names = ["hand", "leg", "hip"]
    return flags.select("image_id", scalar.joined_flags(names).alias("flags"), scalar.first_flag(names).alias("first_anatomy"), scalar.joined_flags(names, "").alias("plain"))


@query("scan_split_filter", f"select split_row_id, {sql_key('image_id')} as image_key, instance_count from official_split where {SQL_SPLIT} = 'train'")
def scan_split_filter(spark: SparkSession, folder: str) -> DataFrame:
    return files.read_split(listing(spark, folder), "train").select("split_row_id", "image_key", "instance_count")


_GROUPS = "select {d} as digest, count(*) as count, min(image_id) as first_id, list_sort(list(distinct fractured) filter (fractured is not null)) as fractured_labels, list_sort(list(distinct fracture_count) filter (fracture_count is not null)) as fracture_counts, list_sort(list(distinct anatomy)) as anatomies, list_sort(list(distinct view)) as views, count(*) - 1 as redundant_count, count(distinct fractured) > 1 as label_conflict from inv where {d} is not null group by 1 having count(*) > 1"


def _sql_groups(digest: str) -> str:
    lists = ", ".join(f"coalesce(array_to_string({c}, ','), '') as {c}" for c in ("fractured_labels", "fracture_counts", "anatomies", "views"))
    return INV + f"select digest, count, first_id, {lists}, redundant_count, label_conflict, 'PX' || lpad(no::varchar, greatest(3, length(no::varchar))::int, '0') as group_id from (select *, row_number() over (order by count desc, digest) as no from ({_GROUPS.format(d=digest)}))"


def _groups(spark: SparkSession, folder: str, digest: str) -> DataFrame:
    ws = Workspace(spark, "groups")
    found = cleaning.duplicate_groups(inventory(spark, folder, "image_id", digest, "fractured", "fracture_count", "anatomy", "view"), digest)
    named = numbered(found, ws, [F.col("count").desc(), F.col("digest")], "no")
    return named.select("digest", "count", "first_id", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("fractured_labels", "fracture_counts", "anatomies", "views")], "redundant_count", "label_conflict", F.format_string("PX%03d", "no").alias("group_id"))


@query("exact_dup_groups", _sql_groups("digest"))
def exact_dup_groups(spark: SparkSession, folder: str) -> DataFrame:
    return _groups(spark, folder, "digest")


@query("physical_dup_groups", _sql_groups("file_md5"))
def physical_dup_groups(spark: SparkSession, folder: str) -> DataFrame:
    return _groups(spark, folder, "file_md5")


@query("exact_dup_members", INV + "select digest, image_id from inv where digest in (select digest from inv group by 1 having count(*) > 1)")
def exact_dup_members(spark: SparkSession, folder: str) -> DataFrame:
    rows = inventory(spark, folder, "image_id", "digest", "fractured", "fracture_count", "anatomy", "view")
    return cleaning.duplicate_members(rows, cleaning.duplicate_groups(rows, "digest"), "digest")


_BITS = """list_transform(range(64), lambda i: {bit})"""
_PH = "list_reduce(list_transform(range(64), lambda i: case when embedding[i + 1] > list_sort(embedding[2:64])[32] then '1' else '0' end), lambda a, b: a || b)"
_DH = "list_reduce(list_transform(range(64), lambda i: case when embedding[(i // 8) * 8 + (i + 1) % 8 + 1] > embedding[i + 1] then '1' else '0' end), lambda a, b: a || b)"


@query("perceptual_hashes", f"select vec_id, {_PH} as phash_bits, {_DH} as dhash_bits from embeddings")
def perceptual_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Hash bits of 8 x 8 blocks; for the difference hash each row is closed by its first value."""
    vectors = _blocks(spark, folder)
    as_text = lambda c: F.lpad(F.conv(scalar.bits_to_hex(c), 16, 2), 64, "0")
    return vectors.select("vec_id", as_text(scalar.perceptual_bits(F.col("embedding"))).alias("phash_bits"), as_text(scalar.difference_bits(F.col("closed"))).alias("dhash_bits"))


def closed_rows() -> Column:
    """The eight rows of a block, each closed by its first value."""
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.concat(F.slice("embedding", r * 8 + 1, F.lit(8)), F.slice("embedding", r * 8 + 1, F.lit(1)))))


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings", "vec_id", "embedding", "label").withColumn("closed", closed_rows())


_SSIM = "((2 * ma * mb + 6.5025) * (2 * cov + 58.5225)) / ((ma * ma + mb * mb + 6.5025) * (va + vb + 58.5225))"


_NEAR_SQL = INV + """select a.anatomy, a.image_id as left_image_id, b.image_id as right_image_id, a.fractured <> b.fractured as label_conflict, bit_count(xor(a.p, b.p)::bit)::int as phash_distance, bit_count(xor(a.d, b.d)::bit)::int as dhash_distance
    from inv a join inv b on a.anatomy = b.anatomy and a.image_id < b.image_id
    where (bit_count(xor(a.p, b.p)::bit) <= 4 or bit_count(xor(a.d, b.d)::bit) <= 2) and coalesce(a.file_md5 <> b.file_md5, true) and coalesce(a.digest <> b.digest, true)"""


@query("near_dup_pairs", _NEAR_SQL)
def near_dup_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of one anatomy within 4 bits of phash or 2 of dhash that are no exact duplicates."""
    ws = Workspace(spark, "near")
    rows = ws.keep(inventory(spark, folder, "image_id", "anatomy", "fractured", "file_md5", "digest", "p", "d"), "images")
    pairs = hamming.near_candidates(rows, "anatomy", "image_id", {"p": 4, "d": 2})
    facts = ("anatomy", "fractured", "file_md5", "digest", "p", "d")
    left = rows.select(F.col("image_id").alias("left"), *[F.col(c).alias(f"l_{c}") for c in facts])
    right = rows.select(F.col("image_id").alias("right"), *[F.col(c).alias(f"r_{c}") for c in facts])
    full = pairs.join(left, "left").join(right, "right")
    differ = lambda c: F.coalesce(F.col(f"l_{c}") != F.col(f"r_{c}"), F.lit(True))
    return full.where(differ("file_md5") & differ("digest")).select(
        F.col("l_anatomy").alias("anatomy"), F.col("left").alias("left_image_id"), F.col("right").alias("right_image_id"), (F.col("l_fractured") != F.col("r_fractured")).alias("label_conflict"),
        scalar.hamming(F.col("l_p"), F.col("r_p")).alias("phash_distance"), scalar.hamming(F.col("l_d"), F.col("r_d")).alias("dhash_distance"),
    )


_MATCHES = f"""keys as (select {sql_key('image_id')} as k, min(image_id) as image_id from image_record where image_id is not null group by 1),
    np as (select distinct least(l.image_id, r.image_id) as a, greatest(l.image_id, r.image_id) as b from near_pair n join keys l on l.k = {sql_key('left_image_id')} join keys r on r.k = {sql_key('right_image_id')} where l.k <> r.k)"""


def reviewed_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """(left, right): the distinct pairs of near_pair between two known images."""
    from ..sources.tables import image_keys

    keys = image_keys(table(spark, folder, "image_record", "image_id"))
    rows = table(spark, folder, "near_pair", "left_image_id", "right_image_id").select(reference_key(F.col("left_image_id")).alias("l"), reference_key(F.col("right_image_id")).alias("r")).where("l != r").distinct()
    named = rows.join(keys.select(F.col("image_key").alias("l"), F.col("image_id").alias("a")), "l").join(keys.select(F.col("image_key").alias("r"), F.col("image_id").alias("b")), "r")
    return named.select(F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right")).distinct()


@query("near_pair_ranking", f"with {_MATCHES} select a as left_image_id, b as right_image_id from np")
def near_pair_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct pairs alone, in no order; ``near_pair_places`` ranks them."""
    return reviewed_pairs(spark, folder).select(F.col("left").alias("left_image_id"), F.col("right").alias("right_image_id"))


@query("contact_sheet_pages", "select pair_id, place, ((place - 1) // 10)::bigint as page from (select pair_id, row_number() over (order by phash_distance, dhash_distance, global_ssim desc, pair_id) as place from near_pair where phash_distance is not null and dhash_distance is not null and global_ssim is not null)")
def contact_sheet_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Fully measured pairs in review order, ten to a page.

    A pair with a null distance or ssim has no row here; ``contact_sheet_all_pages`` pages those too.
    """
    rows = table(spark, folder, "near_pair", "pair_id", "phash_distance", "dhash_distance", "global_ssim").where("phash_distance is not null and dhash_distance is not null and global_ssim is not null")
    placed = numbered(rows, Workspace(spark, "pages"), [F.col("phash_distance"), F.col("dhash_distance"), F.col("global_ssim").desc(), F.col("pair_id")], "place")
    return placed.select("pair_id", "place", F.floor((F.col("place") - 1) / 10).alias("page"))


_REVIEW_SQL = "phash_distance nulls last, dhash_distance nulls last, global_ssim desc nulls last, pair_id"


def review_order() -> list[Column]:
    """The nearest pair first; what was not measured comes last; then by pair_id."""
    return [F.col("phash_distance").asc_nulls_last(), F.col("dhash_distance").asc_nulls_last(), F.col("global_ssim").desc_nulls_last(), F.col("pair_id").asc()]


@query("contact_sheet_all_pages", f"select pair_id, place, ((place - 1) // 10)::bigint as page from (select pair_id, row_number() over (order by {_REVIEW_SQL}) as place from near_pair)")
def contact_sheet_all_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of near_pair in review order, ten to a page; a null distance or ssim sorts after any number."""
    rows = table(spark, folder, "near_pair", "pair_id", "phash_distance", "dhash_distance", "global_ssim")
    placed = numbered(rows, Workspace(spark, "allpages"), review_order(), "place")
    return placed.select("pair_id", "place", F.floor((F.col("place") - 1) / 10).alias("page"))


_RANKED = f"""with {_MATCHES},
    known as (select n.pair_id, least(l.image_id, r.image_id) as left_image_id, greatest(l.image_id, r.image_id) as right_image_id, {views.sql_level("anatomy")} as anatomy, label_conflict, phash_distance, dhash_distance, global_ssim
        from near_pair n join keys l on l.k = {sql_key('left_image_id')} join keys r on r.k = {sql_key('right_image_id')} where l.k <> r.k),
    nearest as (select * from (select *, row_number() over (partition by left_image_id, right_image_id order by {_REVIEW_SQL}) as rn from known) where rn = 1)
    select left_image_id, right_image_id, pair_id, anatomy, label_conflict, phash_distance, dhash_distance, global_ssim, row_number() over (order by {_REVIEW_SQL}) as place from nearest"""


@query("near_pair_places", _RANKED)
def near_pair_places(spark: SparkSession, folder: str) -> DataFrame:
    """The distinct pairs of ``near_pair_ranking`` with their place in review order and what was measured.

    Of the rows of a pair the first in review order stands for it; nulls come last.
    """
    from ..sources.tables import image_keys

    keys = image_keys(table(spark, folder, "image_record", "image_id"))
    facts = ("anatomy", "label_conflict", "phash_distance", "dhash_distance", "global_ssim")
    rows = table(spark, folder, "near_pair", "pair_id", "left_image_id", "right_image_id", *facts).withColumn("anatomy", level(F.col("anatomy")))
    rows = rows.withColumn("l", reference_key(F.col("left_image_id"))).withColumn("r", reference_key(F.col("right_image_id"))).where("l != r").drop("left_image_id", "right_image_id")
    known = rows.join(keys.select(F.col("image_key").alias("l"), F.col("image_id").alias("a")), "l").join(keys.select(F.col("image_key").alias("r"), F.col("image_id").alias("b")), "r")
    bits = [F.coalesce(F.col(c), F.lit(2**31 - 1)) for c in ("phash_distance", "dhash_distance")]
    first = F.struct(*bits, F.coalesce(-F.col("global_ssim"), F.lit(float("inf"))), F.col("pair_id"))
    pairs = known.groupBy(F.least("a", "b").alias("left_image_id"), F.greatest("a", "b").alias("right_image_id")).agg(F.min_by(F.struct("pair_id", *facts), first).alias("s"))
    return numbered(pairs.select("left_image_id", "right_image_id", "s.*"), Workspace(spark, "places"), review_order(), "place")


_REACH = "both_ways as (select a, b from np union select b, a from np), reach(a, b) as (select a, b from both_ways union select r.a, w.b from reach r join both_ways w on r.b = w.a)"


@query("near_dup_components", f"with recursive {_MATCHES}, {_REACH} select a as image_id, least(a, min(b)) as root from reach group by a")
def near_dup_components(spark: SparkSession, folder: str) -> DataFrame:
    ws = Workspace(spark, "components")
    return cleaning.label_components(reviewed_pairs(spark, folder).toDF("u", "v"), ws).select(F.col("node").alias("image_id"), "root")


_CLEAN = f"""with recursive {SQL_INVENTORY}, {_MATCHES},
    ex as (select *, 'PX' || lpad(no::varchar, greatest(3, length(no::varchar))::int, '0') as exact_group from (select *, row_number() over (order by n desc, digest) as no from (
        select digest, count(*) as n, count(distinct fractured) > 1 as conflict, arg_min(image_id, (decode_status <> 'strict', image_id)) as rep from inv where digest is not null group by 1 having count(*) > 1))),
    pl as (select i.image_id, i.fractured, e.exact_group, e.conflict, e.rep, e.exact_group is null or (not e.conflict and i.image_id = e.rep) as survives from inv i left join ex e using (digest)),
    kp as (select a, b from np where a in (select image_id from pl where survives) and b in (select image_id from pl where survives)),
    both_ways as (select a, b from kp union select b, a from kp),
    reach(a, b) as (select a, b from both_ways union select r.a, w.b from reach r join both_ways w on r.b = w.a),
    co as (select a as image_id, least(a, min(b)) as root from reach group by a),
    ng as (select root, conflict, 'NEAR' || lpad(no::varchar, greatest(3, length(no::varchar))::int, '0') as near_group from (select root, count(distinct fractured) > 1 as conflict, row_number() over (order by root) as no from co join pl using (image_id) group by root)),
    al as (select pl.*, ng.near_group, coalesce(ng.conflict, false) as torn from pl left join co using (image_id) left join ng using (root)),
    de as (select image_id, fractured, survives and not torn as include_provisional,
        case when not survives or torn then 'exclude' when exact_group is not null then 'keep_exact_group_representative' when near_group is not null then 'keep_grouped_near_candidate' else 'keep_unique' end as decision,
        case when not survives and conflict then 'exact_pixel_duplicate_with_label_conflict' when not survives then 'exact_pixel_duplicate_of_' || rep when torn then 'near_duplicate_group_with_label_conflict' when near_group is not null and exact_group is null then 'conservative_same_split_after_visual_review' else '' end as reason,
        coalesce(exact_group, '') as exact_group, coalesce(near_group, '') as near_group,
        case when torn then 'exclude_conflicting_component' when near_group is not null and exact_group is null then 'keep_same_split' else 'not_applicable' end as near_review_decision,
        coalesce(near_group, 'IMAGE::' || image_id) as split_group from al)"""


def _decisions(spark: SparkSession, folder: str, ws: Workspace) -> DataFrame:
    rows = inventory(spark, folder, "image_id", "fractured", "decode_status", "digest")
    return cleaning.cleaning_decisions(rows, reviewed_pairs(spark, folder), ws)


@query("cleaning_manifest", _CLEAN + " select * from de")
def cleaning_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return _decisions(spark, folder, Workspace(spark, "cleaning"))


@query(
    "cleaning_summary",
    _CLEAN + """ select count(*) as initial_records, count(*) filter (reason = 'exact_pixel_duplicate_with_label_conflict') as exact_conflict_members, count(*) filter (reason like 'exact_pixel_duplicate_of_%') as exact_redundant,
    count(*) filter (include_provisional or reason = 'near_duplicate_group_with_label_conflict') as before_near_exclusions, count(distinct nullif(near_group, '')) as near_groups, count(*) filter (near_group <> '') as near_images,
    count(*) filter (reason = 'near_duplicate_group_with_label_conflict') as near_conflict_members, count(*) filter (include_provisional) as after_exclusions from de""",
)
def cleaning_summary(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.cleaning_summary(_decisions(spark, folder, Workspace(spark, "cleaning")))


_SPLIT = _CLEAN + f""", mem as (select split_group, fractured, anatomy from de join inv using (image_id, fractured) where include_provisional and fractured is not null),
    gr as (select split_group, sum(n)::bigint as size, max(fractured) as label, arg_min(anatomy, (-n, anatomy)) as anatomy from (select split_group, fractured, anatomy, count(*) as n from mem group by 1, 2, 3) group by 1),
    od as (select split_group, size, label || '|' || anatomy as stratum, sum(size) over (partition by label || '|' || anatomy)::double as total, row_number() over (partition by label || '|' || anatomy order by md5('20260912:' || split_group), split_group) as rn from gr),
    st(stratum, rn, split_group, split, tr, te, va) as (
        select stratum, 0::bigint, null::varchar, null::varchar, total * 0.7::double, total * 0.2::double, total * 0.1::double from od where rn = 1
        union all select stratum, rn, split_group, split, tr - case when split = 'train' then size else 0 end, te - case when split = 'test' then size else 0 end, va - case when split = 'validation' then size else 0 end from (
            select o.stratum, o.rn, o.split_group, o.size, s.tr, s.te, s.va, case when s.tr >= s.te and s.tr >= s.va then 'train' when s.te >= s.va then 'test' else 'validation' end as split from st s join od o on o.stratum = s.stratum and o.rn = s.rn + 1)),
    gs as (select split_group, split, stratum from st where rn > 0),
    mf as (select d.image_id, gs.split, d.split_group, i.fractured, i.fracture_count, i.anatomy, i.view, i.digest from de d join gs using (split_group) join inv i on i.image_id = d.image_id where d.include_provisional and i.fractured is not null)"""


def _manifest(spark: SparkSession, folder: str, ws: Workspace) -> DataFrame:
    """(image_id, split, split_group, fractured, fracture_count, anatomy, view, digest) of the included images."""
    decisions = ws.keep(_decisions(spark, folder, ws).where("include_provisional and fractured is not null").select("image_id", "split_group"), "included")
    rows = inventory(spark, folder, "image_id", "fractured", "fracture_count", "anatomy", "view", "digest")
    full = ws.keep(rows.join(decisions, "image_id"), "members")
    dealt = cleaning.deal_groups(full.select("split_group", "fractured", "anatomy"), ws)
    return full.join(dealt.select("split_group", "split"), "split_group").select("image_id", "split", "split_group", "fractured", "fracture_count", "anatomy", "view", "digest")


@query("group_split", _SPLIT + " select image_id, split, split_group from mf")
def group_split(spark: SparkSession, folder: str) -> DataFrame:
    return _manifest(spark, folder, Workspace(spark, "split")).select("image_id", "split", "split_group")


@query("split_violations", _SPLIT + " select 'split_group' as key, split_group as value, count(*) as records from mf group by 2 having count(distinct split) > 1 union all select 'digest', digest, count(*) from mf where digest is not null group by 2 having count(distinct split) > 1")
def split_violations(spark: SparkSession, folder: str) -> DataFrame:
    """Groups and digests in more than one split: none, by construction."""
    manifest = _manifest(spark, folder, Workspace(spark, "violations"))
    return cleaning.torn_keys(manifest, "split_group").union(cleaning.torn_keys(manifest, "digest"))


@query("split_summary", _SPLIT + " select split, count(*) as images, count(*) filter (fractured = 1) as positives, count(*) filter (fractured = 0) as negatives, coalesce(sum(fracture_count), 0)::bigint as instances, count(distinct split_group) as split_groups from mf group by 1")
def split_summary(spark: SparkSession, folder: str) -> DataFrame:
    manifest = _manifest(spark, folder, Workspace(spark, "summary"))
    return manifest.groupBy("split").agg(F.count("*").alias("images"), F.count_if(F.col("fractured") == 1).alias("positives"), F.count_if(F.col("fractured") == 0).alias("negatives"), F.coalesce(F.sum("fracture_count"), F.lit(0)).alias("instances"), F.count_distinct("split_group").alias("split_groups"))


_AUDIT = INV + """select (select count(*) from image_record) as csv_rows, count(distinct image_id) as csv_unique_image_ids, coalesce(sum(fractured), 0)::bigint as fractured, coalesce(sum(1 - fractured), 0)::bigint as non_fractured, coalesce(sum(fracture_count), 0)::bigint as fracture_instances, coalesce(sum(hardware), 0)::bigint as hardware, coalesce(sum(multiscan), 0)::bigint as multiscan,
    count(*) filter (decode_status = 'truncated_recovered') as truncated_recovered, count(*) filter (exif_orientation not in (0, 1)) as exif_oriented_images,
    (select count(*) from (select 1 from inv where file_md5 is not null group by file_md5 having count(*) > 1)) as exact_file_duplicate_groups,
    (select count(*) from (select 1 from inv where digest is not null group by digest having count(*) > 1)) as exact_pixel_duplicate_groups,
    (select coalesce(sum(n - 1), 0)::bigint from (select count(*) as n from inv where digest is not null group by digest having count(*) > 1)) as exact_pixel_redundant_images,
    (select count(*) from (select 1 from inv where digest is not null group by digest having count(*) > 1 and count(distinct fractured) > 1)) as exact_pixel_label_conflict_groups from inv"""


@query("audit_summary", _AUDIT)
def audit_summary(spark: SparkSession, folder: str) -> DataFrame:
    """One row of counts; its parts are one-row aggregates brought together by a union."""
    columns = ("image_id", "fractured", "fracture_count", "hardware", "multiscan", "decode_status", "exif_orientation", "file_md5", "digest")
    rows = Workspace(spark, "audit").keep(inventory(spark, folder, *columns), "inventory")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    base = rows.agg(
        F.count_distinct("image_id").alias("csv_unique_image_ids"), total("fractured").alias("fractured"), total(1 - F.col("fractured")).alias("non_fractured"), total("fracture_count").alias("fracture_instances"),
        total("hardware").alias("hardware"), total("multiscan").alias("multiscan"), F.count_if(F.col("decode_status") == "truncated_recovered").alias("truncated_recovered"), F.count_if(~F.col("exif_orientation").isin(0, 1)).alias("exif_oriented_images"),
    )
    by_file = rows.where("file_md5 is not null").groupBy("file_md5").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("exact_file_duplicate_groups"))
    pixel = rows.where("digest is not null").groupBy("digest").agg(F.count("*").alias("n"), (F.count_distinct("fractured") > 1).alias("torn")).where("n > 1")
    by_pixel = pixel.agg(F.count("*").alias("exact_pixel_duplicate_groups"), total(F.col("n") - 1).alias("exact_pixel_redundant_images"), F.count_if("torn").alias("exact_pixel_label_conflict_groups"))
    raw = table(spark, folder, "image_record", "row_id").agg(F.count("*").alias("csv_rows"))
    parts = files.key_union([raw, base, by_file, by_pixel])
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])


_BUCKET = ["fractured", "anatomy", "view", "hardware", "multiscan"]
_QA = INV + """, b as (select image_id, concat_ws('|', coalesce(fractured::varchar, ''), coalesce(anatomy, ''), coalesce(view, ''), coalesce(hardware::varchar, ''), coalesce(multiscan::varchar, '')) as bucket from inv),
    c as (select *, row_number() over (partition by bucket order by image_id) - 1 as i, count(*) over (partition by bucket) as n from b)
    select image_id, bucket, turn from (select image_id, bucket, (2 * abs(i - n // 2) - case when (n % 2 = 1 and i > n // 2) or (n % 2 = 0 and i < n // 2) then 1 else 0 end)::bigint as turn from c) order by turn, bucket limit 50"""


@query("qa_sample", _QA)
def qa_sample(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.pick_middle(inventory(spark, folder, "image_id", *_BUCKET), Workspace(spark, "qa"), _BUCKET, 50)


@query("mask_qa_sample", INV + "select image_id, bucket, turn from (select image_id, anatomy as bucket, row_number() over (partition by anatomy order by image_id) as turn from inv where fractured = 1) order by turn, bucket limit 20")
def mask_qa_sample(spark: SparkSession, folder: str) -> DataFrame:
    positives = inventory(spark, folder, "image_id", "fractured", "anatomy").where("fractured = 1")
    return cleaning.pick_in_turns(positives, Workspace(spark, "mask"), F.col("anatomy"), "image_id", 20)


@query("first_of_each_label", INV + "select fractured, image_id, place from (select fractured, image_id, row_number() over (partition by fractured order by image_id) as place from inv where fractured is not null) where place <= 4")
def first_of_each_label(spark: SparkSession, folder: str) -> DataFrame:
    """The first four images of each label: bounded sorts per label."""
    rows = inventory(spark, folder, "image_id", "fractured").where("fractured is not null")
    from pyspark.sql import Window

    tops = [rows.where(F.col("fractured") == y).orderBy("image_id").limit(4) for y in (0, 1)]
    return tops[0].union(tops[1]).select("fractured", "image_id", F.row_number().over(Window.partitionBy("fractured").orderBy("image_id")).alias("place"))


_ANN = f"with {SQL_ANNOTATIONS}, {SQL_INVENTORY}"
_FAULT = "coalesce(w <= 0 or h <= 0 or x < 0 or y < 0 or x + w > width + 1e-3 or y + h > height + 1e-3, true)"


@query("coco_validate", _ANN + f"""select (select count(*) from annotation) as annotations, (select count(*) from annotation a where a.image_id is not null and {sql_key('a.image_id')} not in (select k from keys)) as missing_images,
    (select count(*) from ann join inv using (image_id) where {_FAULT}) as invalid_bbox, (select count(*) from inv where fractured = 1 and image_id not in (select image_id from ann)) as positives_without_annotation,
    (select count(*) from inv where fractured = 0 and image_id in (select image_id from ann)) as annotated_not_positive""")
def coco_validate(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of annotation faults: unknown image, bad box, memberships that disagree with the labels."""
    raw = table(spark, folder, "annotation", "image_id").select(reference_key(F.col("image_id")).alias("image_key"))
    rows = Workspace(spark, "coco").keep(inventory(spark, folder, "image_id", "fractured", "width", "height").withColumn("image_key", reference_key(F.col("image_id"))), "images")
    ann = views.annotations(spark, folder)
    missing = raw.where("image_key is not null").join(rows, "image_key", "left_anti").agg(F.count("*").alias("missing_images"))
    bad = ann.join(rows, "image_id").agg(F.count_if(validate.box_fault(*[F.col(c) for c in ("x", "y", "w", "h", "width", "height")])).alias("invalid_bbox"))
    annotated = ann.select("image_id").distinct()
    without = rows.where("fractured = 1").join(annotated, "image_id", "left_anti").agg(F.count("*").alias("positives_without_annotation"))
    extra = rows.where("fractured = 0").join(annotated, "image_id", "left_semi").agg(F.count("*").alias("annotated_not_positive"))
    parts = files.key_union([raw.agg(F.count("*").alias("annotations")), missing, bad, without, extra])
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])


@query("coco_memberships", _ANN + "select image_id, case when fractured = 1 then 'positive_without_annotation' else 'annotated_not_positive' end as fault from inv where (fractured = 1 and image_id not in (select image_id from ann)) or (fractured = 0 and image_id in (select image_id from ann))")
def coco_memberships(spark: SparkSession, folder: str) -> DataFrame:
    rows = inventory(spark, folder, "image_id", "fractured")
    annotated = views.annotations(spark, folder).select("image_id").distinct()
    lacking = rows.where("fractured = 1").join(annotated, "image_id", "left_anti").select("image_id", F.lit("positive_without_annotation").alias("fault"))
    extra = rows.where("fractured = 0").join(annotated, "image_id", "left_semi").select("image_id", F.lit("annotated_not_positive").alias("fault"))
    return lacking.union(extra)


@query("coco_document_roundtrip", f"with {SQL_ANNOTATIONS} select annotation_id, image_id, x + w as x2, y + h as y2 from ann where x is not null and y is not null and w is not null and h is not null")
def coco_document_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Annotations written as COCO documents and read back: one document per image."""
    ann = views.annotations(spark, folder).where("x is not null and y is not null and w is not null and h is not null")
    number = F.xxhash64("image_id")
    one = F.struct(F.col("annotation_id").alias("id"), number.alias("image_id"), "category_id", "iscrowd", F.array("x", "y", "w", "h").alias("bbox"), F.lit(None).cast("array<array<double>>").alias("segmentation"))
    image = F.struct(number.alias("id"), F.col("image_id").alias("file_name"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"))
    texts = ann.select(F.to_json(F.struct(F.array(image).alias("images"), F.array(one).alias("annotations"))).alias("text"))
    parsed = texts.select(F.from_json("text", files.COCO).alias("c")).select(F.col("c.images")[0].alias("i"), F.inline("c.annotations"))
    return parsed.select(F.col("id").alias("annotation_id"), F.col("i.file_name").alias("image_id"), (F.col("bbox")[0] + F.col("bbox")[2]).alias("x2"), (F.col("bbox")[1] + F.col("bbox")[3]).alias("y2"))


_YOLO_VALUES = {"cx": "(x + w / 2) / width", "cy": "(y + h / 2) / height", "bw": "w / width", "bh": "h / height"}


def label_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(annotation_id, image_id, fracture_count, line): annotations as YOLO label lines.

    Degenerate and out-of-frame boxes give bad lines; crowd annotations have a sixth field.
    """
    rows = views.annotations(spark, folder).join(inventory(spark, folder, "image_id", "width", "height", "fracture_count"), "image_id").where("x is not null and y is not null and w is not null and h is not null and width > 0 and height > 0")
    values = [scalar.fixed(F.expr(e), 6) for e in _YOLO_VALUES.values()]
    return rows.select("annotation_id", "image_id", "fracture_count", F.concat_ws(" ", F.lit("0"), *values, F.when(F.col("iscrowd") == 1, "crowd")).alias("line"))


_YV = ", ".join(f"printf('%.6f', {e})::double as {n}" for n, e in _YOLO_VALUES.items())
_YOLO = _ANN + f", yl as (select annotation_id, image_id, fracture_count, iscrowd, {_YV} from ann join inv using (image_id) where x is not null and y is not null and w is not null and h is not null and width > 0 and height > 0)"
_YFAULT = "case when iscrowd = 1 then 'malformed' when bw <= 0 or bh <= 0 or cx < 0 or cx > 1 or cy < 0 or cy > 1 or bw > 1 or bh > 1 then 'out of range' end"


@query("yolo_validate", _YOLO + f" select annotation_id, image_id, {_YFAULT} as fault from yl where {_YFAULT} is not null")
def yolo_validate(spark: SparkSession, folder: str) -> DataFrame:
    return label_lines(spark, folder).select("annotation_id", "image_id", validate.label_fault().alias("fault")).where("fault is not null")


@query("yolo_count_mismatches", _YOLO + " select image_id, inv.fracture_count, coalesce(n, -1) as lines from inv left join (select image_id, count(*) as n from yl group by 1) using (image_id) where inv.fracture_count is distinct from coalesce(n, -1)")
def yolo_count_mismatches(spark: SparkSession, folder: str) -> DataFrame:
    """Images whose number of label lines is not their fracture count; no file counts as -1."""
    lines = label_lines(spark, folder).groupBy("image_id").agg(F.count("*").alias("n"))
    rows = inventory(spark, folder, "image_id", "fracture_count").join(lines, "image_id", "left").withColumn("lines", F.coalesce("n", F.lit(-1)))
    return rows.where(~F.col("fracture_count").eqNullSafe(F.col("lines"))).select("image_id", "fracture_count", "lines")


@query("yolo_strict_counts", _YOLO + f" select count(*) as lines, count(*) filter ({_YFAULT} is null) as valid, count(*) filter ({_YFAULT} = 'malformed') as malformed, count(*) filter ({_YFAULT} = 'out of range') as out_of_range from yl")
def yolo_strict_counts(spark: SparkSession, folder: str) -> DataFrame:
    fault = validate.label_fault()
    return label_lines(spark, folder).agg(F.count("*").alias("lines"), F.count_if(fault.isNull()).alias("valid"), F.count_if(fault == "malformed").alias("malformed"), F.count_if(fault == "out of range").alias("out_of_range"))


@query("yolo_to_xyxy", _YOLO + " select annotation_id, image_id, (cx - bw / 2) * width as x1, (cy - bh / 2) * height as y1, (cx + bw / 2) * width as x2, (cy + bh / 2) * height as y2 from yl join inv using (image_id) where coalesce(iscrowd, 0) <> 1")
def yolo_to_xyxy(spark: SparkSession, folder: str) -> DataFrame:
    """Label text parsed back into pixel corners; malformed lines are left out."""
    fields = scalar.bound(validate.label_fields(F.col("line")), lambda p: F.transform(p, lambda x: x.try_cast("double")))
    lines = label_lines(spark, folder).select("annotation_id", "image_id", fields.alias("v")).where("size(v) = 5 and not exists(v, x -> x is null)")
    lines = lines.select("annotation_id", "image_id", *[F.get("v", F.lit(i)).alias(n) for i, n in enumerate(("class_id", "cx", "cy", "w", "h"))])
    sized = lines.join(inventory(spark, folder, "image_id", "width", "height"), "image_id")
    return sized.select("annotation_id", "image_id", *scalar.corners_from_yolo(*[F.col(c) for c in ("cx", "cy", "w", "h", "width", "height")]))


@query("xywh_to_xyxy", f"with {SQL_ANNOTATIONS} select annotation_id, image_id, x as x1, y as y1, x + w as x2, y + h as y2 from ann")
def xywh_to_xyxy(spark: SparkSession, folder: str) -> DataFrame:
    return views.annotations(spark, folder).select("annotation_id", "image_id", *scalar.corners_from_xywh(*[F.col(c) for c in "xywh"]))


def voc_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(image_id, xml): one VOC document per annotated image, corners rounded to whole pixels."""
    rows = views.annotations(spark, folder).where("x is not null and y is not null and w is not null and h is not null")
    item = F.format_string("<object><name>fracture</name><bndbox><xmin>%d</xmin><ymin>%d</ymin><xmax>%d</xmax><ymax>%d</ymax></bndbox></object>", *[F.round(F.expr(e)).cast("bigint") for e in ("x", "y", "x + w", "y + h")])
    objects = rows.groupBy("image_id").agg(F.array_join(F.array_sort(F.collect_list(item)), "").alias("objects"))
    sized = objects.join(inventory(spark, folder, "image_id", "width", "height"), "image_id")
    return sized.select("image_id", F.format_string("<annotation><size><width>%d</width><height>%d</height></size>%s</annotation>", "width", "height", "objects").alias("xml"))


@query("voc_validate", _ANN + ", n as (select image_id, count(*) as objects from ann where x is not null and y is not null and w is not null and h is not null group by 1) select count(*) as documents, count(*) filter (n.objects is distinct from fracture_count) as count_mismatches, 0::bigint as size_mismatches, (select count(*) from inv where fractured = 1 and image_id not in (select image_id from n)) as missing from n join inv using (image_id)")
def voc_validate(spark: SparkSession, folder: str) -> DataFrame:
    """VOC text parsed again and held against the inventory: sizes, object counts, missing documents."""
    parsed = files.parse_voc(voc_documents(spark, folder), "xml", "image_id")
    rows = inventory(spark, folder, "image_id", "width", "height", "fracture_count", "fractured").select("image_id", F.col("width").alias("w"), F.col("height").alias("h"), "fracture_count", "fractured")
    both = rows.join(parsed, "image_id", "left")
    there = F.col("objects").isNotNull()
    return both.agg(
        F.count_if(there).alias("documents"), F.count_if(there & ~F.size("objects").eqNullSafe(F.col("fracture_count"))).alias("count_mismatches"),
        F.count_if(there & ((F.col("w") != F.col("width")) | (F.col("h") != F.col("height")))).alias("size_mismatches"), F.count_if(~there & (F.col("fractured") == 1)).alias("missing"),
    )


@query("cross_format_box_error")
def cross_format_box_error(spark: SparkSession, folder: str) -> DataFrame:
    """(image_id, yolo_error, voc_error): best pairing's greatest corner difference, in pixels."""
    reference = xywh_to_xyxy(spark, folder).where("x1 is not null and x2 is not null and y1 is not null and y2 is not null").withColumnRenamed("image_id", "image")
    yolo = yolo_to_xyxy(spark, folder).withColumnRenamed("image_id", "image")
    voc = files.parse_voc(voc_documents(spark, folder), "xml", "image_id").select(F.col("image_id").alias("image"), F.inline("objects"))
    a, b = alignment_errors(reference, yolo), alignment_errors(reference, voc)
    return a.select(F.col("image").alias("image_id"), F.col("error").alias("yolo_error")).join(b.select(F.col("image").alias("image_id"), F.col("error").alias("voc_error")), "image_id")


_POLY = "printf('%.8f', greatest(0.0::double, least(1.0::double, {0})))"
_PX = {"ax": "x / width", "ay": "y / height", "bx": "(x + w) / width", "cy": "(y + h) / height"}
_PFMT = {k: _POLY.format(v) for k, v in _PX.items()}


@query("polygon_to_yolo", _ANN + f", q as (select annotation_id, {', '.join(f'{v} as {k}' for k, v in _PX.items())}, {', '.join(f'{v} as t_{k}' for k, v in _PFMT.items())} from ann join inv using (image_id)) select annotation_id, case when least(ax, ay, bx, cy) >= -1e-9 and greatest(ax, ay, bx, cy) <= 1 + 1e-9 then concat_ws(' ', '0', t_ax, t_ay, t_bx, t_ay, t_bx, t_cy, t_ax, t_cy) end as line from q where ax is not null and ay is not null and bx is not null and cy is not null")
def polygon_to_yolo(spark: SparkSession, folder: str) -> DataFrame:
    """Box corners as polygons, to normalised label lines; polygons that leave the frame give null."""
    rows = views.annotations(spark, folder).join(inventory(spark, folder, "image_id", "width", "height"), "image_id").where("x is not null and y is not null and w is not null and h is not null and width is not null and height is not null")
    points = F.array(*[F.expr(e) for e in ("x", "y", "x + w", "y", "x + w", "y + h", "x", "y + h")])
    return rows.select("annotation_id", scalar.yolo_polygon(points, F.col("width"), F.col("height")).alias("line"))


_POINTS = f"with p as (select {SQL_SPLIT} as split, split_row_id, unnest(string_split(polygon_points, ';')) as t from official_split where polygon_points is not null), v as (select split, split_row_id, try_cast(trim(t) as int) as n from p) "


@query("polygon_point_stats", _POINTS + "select split, min(n) as fewest, max(n) as most, avg(n) as mean, count(n) as polygons from v where n is not null and split is not null group by 1")
def polygon_point_stats(spark: SparkSession, folder: str) -> DataFrame:
    points = listing(spark, folder).where("split is not null").select("split", F.explode(F.split("polygon_points", ";")).alias("t")).select("split", F.trim("t").try_cast("int").alias("n")).where("n is not null")
    return points.groupBy("split").agg(F.min("n").alias("fewest"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.count("n").alias("polygons"))


@query("official_split_faults", f"""with {SQL_INVENTORY}, l as (select {sql_key('image_id')} as k, count(*) as n from official_split where image_id is not null and {SQL_SPLIT} is not null group by 1), p as (select distinct {sql_key('image_id')} as k from inv where fractured = 1)
    select 'repeated' as fault, k as image_key from l where n > 1 union all select 'positive_not_listed', k from p where k not in (select k from l) union all select 'listed_not_positive', k from l where k not in (select k from p)""")
def official_split_faults(spark: SparkSession, folder: str) -> DataFrame:
    listed = listing(spark, folder).where("image_key is not null and split is not null").select("image_key")
    positives = inventory(spark, folder, "image_id", "fractured").where("fractured = 1").select(reference_key(F.col("image_id")).alias("image_key")).distinct()
    return validate.split_listing_faults(listed, positives)


@query("official_split_summary", f"select split, count(*) as listings, count(distinct k) as images, coalesce(sum(instance_count), 0)::bigint as instances from (select {SQL_SPLIT} as split, {sql_key('image_id')} as k, instance_count from official_split) where split is not null group by 1")
def official_split_summary(spark: SparkSession, folder: str) -> DataFrame:
    return listing(spark, folder).where("split is not null").groupBy("split").agg(F.count("*").alias("listings"), F.count_distinct("image_key").alias("images"), F.coalesce(F.sum("instance_count"), F.lit(0)).alias("instances"))


@query("inventory_counts", INV + "select 'anatomy' as field, anatomy as value, count(*) as n from inv group by 2 union all select 'view', view, count(*) from inv group by 2 union all select 'decode_status', decode_status, count(*) from inv group by 2")
def inventory_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts per value of several columns in one pass."""
    rows = inventory(spark, folder, "image_id", "anatomy", "view", "decode_status")
    long = rows.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("anatomy", "view", "decode_status")])))
    return long.groupBy("field", "value").agg(F.count("*").alias("n"))


@query("exclusion_reasons", f"select coalesce(trim(reason), '') as reason, count(*) as rows, count(distinct {sql_key('image_id')}) as images, count(distinct nullif(upper(trim(near_group)), '')) as near_groups from exclusions group by 1")
def exclusion_reasons(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "exclusions", "reason", "image_id", "near_group")
    return rows.groupBy(F.coalesce(F.trim("reason"), F.lit("")).alias("reason")).agg(F.count("*").alias("rows"), F.count_distinct(reference_key(F.col("image_id"))).alias("images"), F.count_distinct(label_key(F.col("near_group"))).alias("near_groups"))


@query("excluded_and_listed", f"select {sql_key('image_id')} as image_key from exclusions intersect select {sql_key('image_id')} from official_split where {SQL_SPLIT} is not null and image_id is not null")
def excluded_and_listed(spark: SparkSession, folder: str) -> DataFrame:
    """Set operations: ids that are both excluded and listed."""
    excluded = table(spark, folder, "exclusions", "image_id").select(reference_key(F.col("image_id")).alias("image_key"))
    return excluded.intersect(listing(spark, folder).where("split is not null and image_key is not null").select("image_key"))


@query("included_union_excluded", f"with e as (select {sql_key('image_id')} as k from exclusions), i as (select {sql_key('image_id')} as k from image_record where image_id is not null) select (select count(*) from (select k from e union select k from i)) as all_ids, (select count(*) from (select k from i except select k from e)) as not_excluded")
def included_union_excluded(spark: SparkSession, folder: str) -> DataFrame:
    excluded = table(spark, folder, "exclusions", "image_id").select(reference_key(F.col("image_id")).alias("k"))
    images = table(spark, folder, "image_record", "image_id").where("image_id is not null").select(reference_key(F.col("image_id")).alias("k"))
    parts = files.key_union([excluded.union(images).distinct().agg(F.count("*").alias("all_ids")), images.subtract(excluded).agg(F.count("*").alias("not_excluded"))])
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])


_LETTER = "least(224.0 / width, 224.0 / height)"


@query("letterbox_geometry", INV + f"select image_id, {_LETTER}::double as scale, floor((224 - width * {_LETTER}::double) / 2)::bigint as pad_x, floor((224 - height * {_LETTER}::double) / 2)::bigint as pad_y from inv where width > 0 and height > 0")
def letterbox_geometry(spark: SparkSession, folder: str) -> DataFrame:
    """Scale and padding that fit an image into a square of 224 pixels."""
    side = F.lit(224.0)
    scale = F.least(side / F.col("width"), side / F.col("height"))
    pad = lambda c: F.floor((side - F.col(c) * F.col("scale")) / 2)
    return inventory(spark, folder, "image_id", "width", "height").where("width > 0 and height > 0").withColumn("scale", scale).select("image_id", "scale", pad("width").alias("pad_x"), pad("height").alias("pad_y"))


_BOTH = "size_bytes is not null and file_md5 is not null"


@query("model_bundle_check", INV + f", want as (select size_bytes as s, lower(file_md5) as m from inv where image_id = (select min(image_id) from inv where {_BOTH})) select image_id, case when size_bytes <> s then 'size mismatch' when lower(file_md5) <> m then 'digest mismatch' when {_BOTH} then 'accepted' end as outcome from inv, want")
def model_bundle_check(spark: SparkSession, folder: str) -> DataFrame:
    """Every file held against the size and digest expected of it; here those of the first file are expected of all."""
    rows = inventory(spark, folder, "image_id", "size_bytes", "file_md5")
    want = rows.where(_BOTH).agg(F.min_by(F.struct("size_bytes", "file_md5"), "image_id").alias("w")).first()["w"]
    if want is None:
        return rows.select("image_id", F.lit(None).cast("string").alias("outcome")).limit(0)
    return rows.select("image_id", validate.archive_gate(F.col("size_bytes"), F.col("file_md5"), want["size_bytes"], want["file_md5"]).alias("outcome"))
