"""Queries on preparation constraints, strict joins, file formats written and read, and the whole audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import reference_key
from ..operators import cleaning, preparation, validate
from ..operators.hamming import near_candidates
from ..functions import scalar
from ..sources import files, images
from ..sources.tables import table
from ..storage import Workspace
from . import audit, views
from .audit import INV
from .catalogue import SQL, query
from .views import SQL_ANNOTATIONS, SQL_INVENTORY, SQL_SPLIT, inventory, listing, sql_key

_BASE = f"with {SQL_ANNOTATIONS}, {SQL_INVENTORY}"
_PARTS = "x is not null and y is not null and w is not null and h is not null"
# The documents list annotated images and the positives that are no multiscan; a crowd has a second polygon, of two points.
_DOCS = f"""{_BASE},
    al as (select annotation_id, {sql_key('image_id')} as k, iscrowd, bbox[1] as x, bbox[2] as y, bbox[3] as w, bbox[4] as h from annotation),
    im as (select {sql_key('image_id')} as k, image_id, raw_width, raw_height, width, height, fractured from inv where image_id in (select image_id from ann) or (fractured = 1 and coalesce(multiscan, 0) = 0)),
    an as (select al.*, im.k is not null as known, raw_width, raw_height from al left join im using (k))"""
_BBOX = "coalesce(w <= 0 or h <= 0 or x < 0 or y < 0 or x + w > raw_width + 1e-3 or y + h > raw_height + 1e-3, true)"
_CORNERS = "coalesce(least(x, x + w) < 0 or least(y, y + h) < 0 or greatest(x, x + w) > raw_width + 1e-3 or greatest(y, y + h) > raw_height + 1e-3, true)"
_SEGMENT = f"case when {_PARTS} then ({_CORNERS})::bigint + coalesce((iscrowd = 1)::bigint, 0) else 1 end"


@query("coco_faults", f"""{_DOCS}
    select 'size_mismatch' as fault, image_id as key, 1::bigint as n from im where raw_width is distinct from width or raw_height is distinct from height
    union all select 'annotation_without_image', annotation_id::varchar, 1 from an where not known
    union all select 'invalid_bbox', annotation_id::varchar, 1 from an where known and {_BBOX}
    union all select 'invalid_segmentation', annotation_id::varchar, {_SEGMENT} from an where known and {_SEGMENT} > 0
    union all select 'image_without_annotation', image_id, 1 from im where k not in (select k from al where k is not null)
    union all select 'positive_missing', image_id, 1 from inv where fractured = 1 and {sql_key('image_id')} not in (select k from im)
    union all select 'image_not_positive', image_id, 1 from im where fractured is distinct from 1""")
def coco_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Annotation documents held against the inventory: images, sizes, boxes and every polygon."""
    ws = Workspace(spark, "cocofaults")
    records = ws.keep(inventory(spark, folder, "image_id", "raw_width", "raw_height", "width", "height", "fractured", "multiscan"), "inventory")
    corner = lambda i: F.get("bbox", F.lit(i))
    x, y, w, h = (corner(i) for i in range(4))
    outline, line = F.array(x, y, x + w, y, x + w, y + h, x, y + h), F.array(x, y, x + w, y + h)
    whole = x.isNotNull() & y.isNotNull() & w.isNotNull() & h.isNotNull()
    rows = table(spark, folder, "annotation", "annotation_id", "image_id", "iscrowd", "bbox").select(
        F.col("annotation_id").alias("id"), reference_key(F.col("image_id")).alias("image_id"), "bbox",
        F.when(whole, F.when(F.col("iscrowd") == 1, F.array(outline, line)).otherwise(F.array(outline))).alias("segmentation"),
    )
    rows = ws.keep(rows, "annotations")
    keyed = records.withColumn("id", reference_key(F.col("image_id")))
    annotated = keyed.join(rows.select(F.col("image_id").alias("id")), "id", "left_semi")
    others = keyed.where("fractured = 1 and coalesce(multiscan, 0) = 0").join(rows.select(F.col("image_id").alias("id")), "id", "left_anti")
    document = annotated.union(others).select("id", F.col("image_id").alias("file_name"), F.col("raw_width").alias("width"), F.col("raw_height").alias("height"))
    return preparation.annotation_faults(document, rows, records.select("image_id", "width", "height", "fractured"))


EXPECTED = {"train": 1900, "val": 300, "test": 400}
_MANIFEST = f"mf as (select i.image_id, i.fractured, i.decode_status, l.split from (select distinct {sql_key('image_id')} as k, {SQL_SPLIT} as split from official_split where image_id is not null) l join inv i on {sql_key('i.image_id')} = l.k)"


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    """(image_id, split, fractured, decode_status): images as official_split lists them; no split is null."""
    listed = listing(spark, folder).where("image_key is not null").select("image_key", "split").distinct()
    rows = inventory(spark, folder, "image_id", "fractured", "decode_status").withColumn("image_key", reference_key(F.col("image_id")))
    return rows.join(listed, "image_key").select("image_id", "split", "fractured", "decode_status")


@query("preparation_faults", f"""{_BASE}, {_MANIFEST}, lb as (select image_id, count(*) as lines from ann where {_PARTS} group by 1), ex as (select * from (values {', '.join(f"('{s}', {n})" for s, n in EXPECTED.items())}) v(split, wanted))
    select 'repeated_image' as fault, image_id as key from mf group by 2 having count(*) > 1
    union all select 'unknown_split', image_id from mf where split is null or split not in (select split from ex)
    union all select 'split_size', split from ex left join (select split, count(*) as n from mf group by 1) using (split) where wanted <> coalesce(n, 0)
    union all select case when fractured = 1 then 'positive_without_label' else 'negative_with_label' end, image_id from mf left join lb using (image_id) where (fractured = 1 and coalesce(lines, 0) = 0) or (fractured = 0 and lines > 0)""")
def preparation_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Constraints of the prepared set: repeated images, splits, their sizes, labels of positives and negatives."""
    labels = views.annotations(spark, folder).where(_PARTS).groupBy("image_id").agg(F.count("*").alias("lines"))
    return preparation.preparation_faults(Workspace(spark, "prepared").keep(_listed(spark, folder), "manifest"), labels, EXPECTED)


@query("materialised_manifest", f"{_BASE}, {_MANIFEST} select image_id, split, 'images/' || split || '/' || image_id as image_path, 'labels/' || split || '/' || regexp_replace(image_id, '\\.[^.]*$', '') || '.txt' as label_path, case when decode_status like '%recovered%' then 'reencode' else 'link' end as action, case when fractured = 1 then 'link' else 'empty' end as label_action from mf where split is not null")
def materialised_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Where the files of each listed image go, and how they come there."""
    made = preparation.materialised(_listed(spark, folder).where("split is not null"))
    return made.select("image_id", "split", "image_path", "label_path", "action", "label_action")


_SAMPLE = """sm as (select image_id, fractured, width, height, case when mode = 'RGB' then 3 when mode = 'L' then 1 end as channels, boxes, masks, raw_width, raw_height
    from inv left join (select image_id, count(*) as boxes, count(*) filter (coalesce(iscrowd, 0) = 0) as masks from ann group by 1) using (image_id))"""


@query("batch_faults", f"""{_BASE}, {_SAMPLE} select image_id, fault from (select image_id, case when channels is distinct from 3 then 'channels' when coalesce(boxes, 0) <> coalesce(masks, 0) then 'box_mask_count'
    when coalesce(masks, 0) > 0 and (raw_width is distinct from width or raw_height is distinct from height) then 'mask_size' when fractured = 0 and coalesce(boxes, 0) > 0 then 'negative_with_box' when fractured = 1 and coalesce(boxes, 0) = 0 then 'positive_without_box' end as fault from sm) where fault is not null""")
def batch_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Training samples that a batch must not hold: a colour image's channels, boxes and masks, mask sizes, labels."""
    counts = views.annotations(spark, folder).groupBy("image_id").agg(F.count("*").alias("boxes"), F.count_if(F.coalesce("iscrowd", F.lit(0)) == 0).alias("masks"))
    rows = inventory(spark, folder, "image_id", "fractured", "width", "height", "mode", "raw_width", "raw_height").join(counts, "image_id", "left")
    channels = F.when(F.col("mode") == "RGB", 3).when(F.col("mode") == "L", 1)
    return preparation.batch_faults(rows.withColumn("channels", channels).withColumnsRenamed({"raw_width": "mask_width", "raw_height": "mask_height"}))


@query("strict_label_counts", audit._YOLO + f" select image_id as stem, count(*) as lines from yl where ({audit._YFAULT}) is null group by 1")
def strict_label_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Lines per label file, of the good lines: the strict reader raises at any other."""
    rows = Workspace(spark, "strictlabels").keep(audit.label_lines(spark, folder), "lines")
    return preparation.strict_labels(rows.where(validate.label_fault().isNull()).withColumnRenamed("image_id", "stem"))


@query("strict_order_lines", "select o_orderkey, o_orderstatus, coalesce(n, 0) as lines from orders left join (select l_orderkey, count(*) as n from lineitem group by 1) on l_orderkey = o_orderkey")
def strict_order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Strict one-to-one join of two relations that must have the same keys."""
    orders = table(spark, folder, "orders", "o_orderkey", "o_orderstatus")
    counts = table(spark, folder, "lineitem", "l_orderkey").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    lines = Workspace(spark, "strictlines").keep(orders.select("o_orderkey").join(counts, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("lines")), "lines")
    return preparation.strict_one_to_one(orders, lines, "o_orderkey")


@query("strict_customer_lookup", "select o_orderkey, c_name from orders join customer on c_custkey = o_custkey")
def strict_customer_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Strict lookup: an order whose customer is missing is an error."""
    customers = table(spark, folder, "customer", "c_custkey", "c_name").withColumnRenamed("c_custkey", "key")
    return preparation.strict_lookup(table(spark, folder, "orders", "o_orderkey", F.col("o_custkey").alias("key")), customers, "key").select("o_orderkey", "c_name")


@query("strict_score_zip", "select prediction_id, probability, label from classifier_prediction")
def strict_score_zip(spark: SparkSession, folder: str) -> DataFrame:
    """Scores and labels that come apart, paired again by their place."""
    rows = table(spark, folder, "classifier_prediction", "prediction_id", "probability", "label")
    place = [F.col("prediction_id")]
    return preparation.strict_zip(rows.select("prediction_id", "probability"), rows.select(F.col("prediction_id").alias("_id"), "label"), Workspace(spark, "zip"), place, [F.col("_id")]).select("prediction_id", "probability", "label")


@query("csv_file_roundtrip", INV + "select image_id, fractured::varchar as fractured, anatomy, width::varchar as width, digest from inv")
def csv_file_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The inventory as a CSV file, written and read: all columns text, null as null."""
    path = f"{Workspace(spark, 'csv').root}/inventory"
    files.write_csv(inventory(spark, folder, "image_id", "fractured", "anatomy", "width", "digest"), path)
    return files.read_csv(spark, path)


@query("manifest_file_split", f"{_BASE}, {_MANIFEST} select image_id, fractured from mf where split = 'val'")
def manifest_file_split(spark: SparkSession, folder: str) -> DataFrame:
    """One split of a written manifest; the filter lists that split's folder only."""
    path = f"{Workspace(spark, 'manifest').root}/manifest"
    files.write_manifest(_listed(spark, folder).where("split is not null"), path)
    return files.read_split(spark.read.parquet(path), "val").select("image_id", "fractured")


@query("label_file_roundtrip", audit._YOLO + " select image_id, count(*) as lines, sum(cx) as cx from yl where coalesce(iscrowd, 0) <> 1 group by 1")
def label_file_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Label texts, one per image, written by split and read back line by line."""
    path = f"{Workspace(spark, 'labels').root}/labels"
    lines = audit.label_lines(spark, folder).where("line not like '%crowd'").select(F.lit("all").alias("split"), F.col("image_id").alias("stem"), F.col("annotation_id").alias("line_number"), "line")
    files.write_labels(lines, path)
    texts = spark.read.schema("stem string, text string").json(path)
    each = texts.select(F.col("stem").alias("image_id"), F.explode(F.split("text", "\n")).alias("line"))
    return each.groupBy("image_id").agg(F.count("*").alias("lines"), F.sum(F.get(validate.label_fields(F.col("line")), F.lit(1)).cast("double")).alias("cx"))


@query("coco_file_roundtrip", f"{_BASE} select annotation_id, image_id, width, height, x + w as x2 from ann join inv using (image_id) where {_PARTS}")
def coco_file_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Annotation documents written as JSON files, one document a line for a bounded share of the images, and read back."""
    rows = views.annotations(spark, folder).where(_PARTS).join(inventory(spark, folder, "image_id", "width", "height"), "image_id").withColumn("number", F.xxhash64("image_id"))
    image = F.struct(F.col("number").alias("id"), F.col("image_id").alias("file_name"), "width", "height")
    one = F.struct(F.col("annotation_id").alias("id"), F.col("number").alias("image_id"), "category_id", "iscrowd", F.array("x", "y", "w", "h").alias("bbox"), F.lit(None).cast("array<array<double>>").alias("segmentation"))
    documents = rows.groupBy("number").agg(F.array_distinct(F.collect_list(image)).alias("images"), F.collect_list(one).alias("annotations")).drop("number")
    path = f"{Workspace(spark, 'coco').root}/coco"
    documents.write.json(path)
    found, annotations = files.coco_tables(spark.read.json(path, schema=files.COCO))
    named = found.select(F.col("id").alias("image_id"), "file_name", "width", "height").distinct()
    return annotations.join(named, "image_id").select(F.col("id").alias("annotation_id"), F.col("file_name").alias("image_id"), "width", "height", (F.get("bbox", F.lit(0)) + F.get("bbox", F.lit(2))).alias("x2"))


_BASIS = "[" + ", ".join(repr(float(v)) for row in images.dct_basis(8) for v in row) + "]"
_LOW = "list_transform(range(64), lambda k: list_sum(list_transform(range(64), lambda i: b[(k // 8) * 8 + i // 8 + 1] * b[(k % 8) * 8 + i % 8 + 1] * e[i + 1]::double)))"


@query("frequency_hashes", f"select vec_id, array_to_string(list_transform(low, lambda v: case when v > list_sort(low[2:64])[32] then '1' else '0' end), '') as bits from (select vec_id, {_LOW} as low from (select vec_id, embedding as e, {_BASIS}::double[] as b from embeddings))")
def frequency_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Perceptual hash of 8 x 8 blocks by their cosine transform, as 64 bits."""
    rows = images.frequency_hashes(table(spark, folder, "embeddings", "vec_id", "embedding"), "vec_id", "embedding")
    return rows.select("vec_id", F.lpad(F.conv("phash", 16, 2), 64, "0").alias("bits"))


def _with_edits(spark: SparkSession, folder: str) -> DataFrame:
    """(vec_id, embedding, label): the vectors, and of each a copy, -1 - vec_id, with one value a tenth smaller."""
    rows = table(spark, folder, "embeddings", "vec_id", "embedding", "label")
    smaller = F.transform("embedding", lambda v, i: F.when(i == F.pmod(F.col("vec_id"), F.lit(64)), (v * 0.9).cast("float")).otherwise(v))
    return rows.union(rows.select(-1 - F.col("vec_id"), smaller, "label"))


_EDITED = "(select vec_id, embedding, label from embeddings union all select -1 - vec_id, list_transform(range(64), lambda i: case when i = vec_id % 64 then (embedding[i + 1]::double * 0.9)::float else embedding[i + 1] end), label from embeddings)"


@query(
    "near_dup_refined",
    f"""with h as (select vec_id, label, embedding, {audit._PH} as p, {audit._DH} as d, list_transform(embedding, lambda v: (v::double + 1) * 127.5) as px from {_EDITED}),
    c as (select a.vec_id as left_id, b.vec_id as right_id, bit_count(xor(a.p::bit, b.p::bit))::int as phash_distance, bit_count(xor(a.d::bit, b.d::bit))::int as dhash_distance, a.px as pa, b.px as pb from h a join h b on a.label = b.label and a.vec_id < b.vec_id),
    f as (select *, list_avg(pa) as ma, list_avg(pb) as mb, list_avg(list_transform(pa, lambda x: x * x)) as qa, list_avg(list_transform(pb, lambda x: x * x)) as qb, list_avg(list_transform(range(64), lambda i: pa[i + 1] * pb[i + 1])) as q from c where phash_distance <= 4 or dhash_distance <= 2),
    g as (select *, qa - ma * ma as va, qb - mb * mb as vb, q - ma * mb as cov from f)
    select left_id, right_id, phash_distance, dhash_distance, {audit._SSIM} as global_ssim from g where {audit._SSIM} >= 0.92 or (phash_distance <= 2 and dhash_distance <= 2)""",
)
def near_dup_refined(spark: SparkSession, folder: str) -> DataFrame:
    """Near pairs at the stated limits (4 bits of phash or 2 of dhash) by bands, refined by SSIM of at least 0.92.

    Pairs within 2 bits of both hashes stay whatever their SSIM. Only pairs that share a band are compared, and only those within the limits read pixels.
    """
    ws = Workspace(spark, "refined")
    rows = _with_edits(spark, folder)
    hashed = ws.keep(rows.withColumn("closed", audit.closed_rows()).select("vec_id", "label", scalar.bits_to_long(scalar.perceptual_bits(F.col("embedding"))).alias("p"), scalar.bits_to_long(scalar.difference_bits(F.col("closed"))).alias("d")), "hashes")
    pairs = near_candidates(hashed, "label", "vec_id", {"p": 4, "d": 2})
    pixels = rows.select("vec_id", F.transform("embedding", lambda v: (v.cast("double") + 1) * 127.5).alias("px")).join(hashed.select("vec_id", "p", "d"), "vec_id")
    side = lambda n: pixels.select(F.col("vec_id").alias(f"{n}"), *[F.col(c).alias(f"{n}_{c}") for c in ("px", "p", "d")])
    full = pairs.join(side("left"), "left").join(side("right"), "right")
    return full.select(
        F.col("left").alias("left_id"), F.col("right").alias("right_id"), scalar.hamming(F.col("left_p"), F.col("right_p")).alias("phash_distance"), scalar.hamming(F.col("left_d"), F.col("right_d")).alias("dhash_distance"),
        scalar.structural_similarity(F.col("left_px"), F.col("right_px")).alias("global_ssim"),
    ).where("global_ssim >= 0.92 or (phash_distance <= 2 and dhash_distance <= 2)")


_CUT = "case when (upto - size / 2) / total <= 0.7::double then 'train' when (upto - size / 2) / total <= 0.7::double + 0.2::double then 'test' else 'validation' end"


@query("group_split_systematic", audit._SPLIT.split(", st(stratum")[0].replace("with recursive", "with recursive") + f", ru as (select split_group, size, stratum, sum(size) over (partition by stratum order by md5('20260912:' || split_group), split_group) as upto, total from od) select split_group, {_CUT} as split from ru")
def group_split_systematic(spark: SparkSession, folder: str) -> DataFrame:
    """Groups dealt by cumulated size instead of one after another: no task holds a stratum. ``group_split`` keeps the sequential rule."""
    ws = Workspace(spark, "systematic")
    decisions = ws.keep(audit._decisions(spark, folder, ws).where("include_provisional and fractured is not null").select("image_id", "split_group"), "included")
    full = inventory(spark, folder, "image_id", "fractured", "anatomy").join(decisions, "image_id")
    return cleaning.deal_groups_by_size(full.select("split_group", "fractured", "anatomy"), ws).select("split_group", "split")


_REPORT = {
    "inventory": "audit_summary", "annotations": "coco_validate", "labels": "yolo_strict_counts", "boxes": "voc_validate",
}
_COUNTED = {
    ("labels", "count_mismatches"): "yolo_count_mismatches", ("near", "candidates"): "near_dup_pairs", ("splits", "faults"): "official_split_faults", ("inventory", "annotation_faults"): "coco_faults",
}
_METRICS = {
    "audit_summary": ["csv_rows", "csv_unique_image_ids", "fractured", "non_fractured", "fracture_instances", "hardware", "multiscan", "truncated_recovered", "exif_oriented_images", "exact_file_duplicate_groups", "exact_pixel_duplicate_groups", "exact_pixel_redundant_images", "exact_pixel_label_conflict_groups"],
    "coco_validate": ["annotations", "missing_images", "invalid_bbox", "positives_without_annotation", "annotated_not_positive"],
    "yolo_strict_counts": ["lines", "valid", "malformed", "out_of_range"],
    "voc_validate": ["documents", "count_mismatches", "size_mismatches", "missing"],
}


def _sql_report() -> str:
    parts = [f"select '{section}' as section, unnest([{', '.join(repr(m) for m in _METRICS[name])}]) as metric, unnest([{', '.join(f'{m}::bigint' for m in _METRICS[name])}]) as value from ({SQL[name]})" for section, name in _REPORT.items()]
    parts += [f"select '{section}', '{metric}', count(*) from ({SQL[name]})" for (section, metric), name in _COUNTED.items()]
    parts.append(f"select 'near', 'label_conflicts', count(*) filter (label_conflict) from ({SQL['near_dup_pairs']})")
    redundant = "from (select count(*) as n, count(distinct fractured) > 1 as torn from inv where file_md5 is not null group by file_md5 having count(*) > 1)"
    parts.append(f"select 'inventory', 'exact_file_redundant_images', coalesce(sum(n - 1), 0)::bigint from ({INV} select n {redundant})")
    parts.append(f"select 'inventory', 'exact_file_label_conflict_groups', count(*) filter (torn) from ({INV} select torn {redundant})")
    return " union all ".join(parts)


@query("audit_report", _sql_report())
def audit_report(spark: SparkSession, folder: str) -> DataFrame:
    """(section, metric, value): the whole audit as one relation, every section's counts."""
    made = {name: f for name, f in ((n, globals().get(n) or getattr(audit, n)) for n in [*_METRICS, *_COUNTED.values()])}
    rows = []
    for section, name in _REPORT.items():
        long = F.inline(F.array(*[F.struct(F.lit(section).alias("section"), F.lit(m).alias("metric"), F.col(m).cast("bigint").alias("value")) for m in _METRICS[name]]))
        rows.append(made[name](spark, folder).select(long))
    ws = Workspace(spark, "report")
    near = ws.keep(made["near_dup_pairs"](spark, folder), "near")
    for (section, metric), name in _COUNTED.items():
        frame = near if name == "near_dup_pairs" else made[name](spark, folder)
        rows.append(frame.agg(F.count("*").alias("value")).select(F.lit(section).alias("section"), F.lit(metric).alias("metric"), "value"))
    rows.append(near.agg(F.count_if("label_conflict").alias("value")).select(F.lit("near"), F.lit("label_conflicts"), "value"))
    same = inventory(spark, folder, "image_id", "file_md5", "fractured").where("file_md5 is not null").groupBy("file_md5").agg(F.count("*").alias("n"), (F.count_distinct("fractured") > 1).alias("torn")).where("n > 1")
    both = same.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("a"), F.count_if("torn").alias("b"))
    named = F.array(F.struct(F.lit("inventory").alias("section"), F.lit("exact_file_redundant_images").alias("metric"), F.col("a").alias("value")), F.struct(F.lit("inventory").alias("section"), F.lit("exact_file_label_conflict_groups").alias("metric"), F.col("b").alias("value")))
    rows.append(both.select(F.inline(named)))
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out
