"""Relations that the queries start from, each with the SQL of the same relation.

The radiograph tables serve as inventory, listing, annotations and classifier scores;
detector boxes, of which there is no table, are read off the order lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import digest_text, hash64, level, reference_key, split_name
from ..sources.tables import image_keys, table

ATTRIBUTES = ("image_id", "path", "fractured", "fracture_count", "hardware", "multiscan", "raw_width", "raw_height", "width", "height", "mode", "exif_orientation", "decode_status", "size_bytes", "file_md5")


def inventory(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """One row per image of image_record: deliveries agree in all attributes, so they collapse.

    anatomy and view are normalised, digest is the pixel digest, p and d are the hashes.
    """
    source = table(spark, folder, "image_record").where("image_id is not null")
    made = {"anatomy": level(F.col("anatomy")), "view": level(F.col("view")), "digest": digest_text(F.col("pixel_md5")), "p": hash64(F.col("phash")), "d": hash64(F.col("dhash"))}
    wanted = columns or (*ATTRIBUTES, *made)
    return source.select(*[made[c].alias(c) if c in made else F.col(c) for c in wanted]).distinct()


def sql_level(c: str) -> str:
    return f"coalesce(nullif(lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')), ''), 'unknown')"


def sql_key(c: str) -> str:
    return f"upper(regexp_replace({c}, '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g'))"


def sql_hash(c: str) -> str:
    digits = f"regexp_replace(regexp_replace(lower({c}), '[\\s:_-]', '', 'g'), '^0x', '')"
    return f"case when regexp_full_match({digits}, '[0-9a-f]{{1,16}}') then ('0x' || {digits})::ubigint end"


def sql_digest(c: str) -> str:
    digits = f"regexp_replace(regexp_replace(lower({c}), '[\\s:_-]', '', 'g'), '^(md5|0x)', '')"
    return f"case when regexp_full_match({digits}, '[0-9a-f]{{32}}') then {digits} end"


SQL_SPLIT = "case when lower(trim(split)) in ('train', 'training') then 'train' when lower(trim(split)) in ('val', 'valid', 'validation') then 'val' when lower(trim(split)) in ('test', 'testing') then 'test' end"
SQL_INVENTORY = (
    f"inv as (select distinct {', '.join(ATTRIBUTES)}, {sql_level('anatomy')} as anatomy, {sql_level('view')} as view, {sql_digest('pixel_md5')} as digest, "
    f"{sql_hash('phash')} as p, {sql_hash('dhash')} as d from image_record where image_id is not null)"
)


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(split_row_id, image_key, split, instance_count, polygon_points) of official_split."""
    return table(spark, folder, "official_split").select("split_row_id", reference_key(F.col("image_id")).alias("image_key"), split_name(F.col("split")).alias("split"), "instance_count", "polygon_points")


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """(image_key, label, raw_probability, probability, prediction, anatomy, view, hardware).

    One row per image: its latest prediction by recorded_at, then prediction_id.
    """
    rows = table(spark, folder, "classifier_prediction").select(
        reference_key(F.col("image_id")).alias("image_key"), F.struct("recorded_at", "prediction_id").alias("at"),
        F.struct("label", "raw_probability", "probability", "prediction", level(F.col("anatomy")).alias("anatomy"), level(F.col("view")).alias("view"), "hardware").alias("s"),
    )
    return rows.where("image_key is not null").groupBy("image_key").agg(F.max_by("s", "at").alias("s")).select("image_key", "s.*")


SQL_SCORES = (
    f"sc as (select * exclude rn from (select {sql_key('image_id')} as image_key, label, raw_probability, probability, prediction, {sql_level('anatomy')} as anatomy, {sql_level('view')} as view, hardware, "
    "row_number() over (partition by " + sql_key("image_id") + " order by recorded_at desc nulls last, prediction_id desc) as rn from classifier_prediction where image_id is not null) where rn = 1), "
    "good as (select * from sc where label in (0, 1) and probability is not null)"
)


def annotations(spark: SparkSession, folder: str) -> DataFrame:
    """(annotation_id, image_id, category_id, iscrowd, x, y, w, h): each distinct annotation of a known image."""
    rows = table(spark, folder, "annotation").select("annotation_id", reference_key(F.col("image_id")).alias("image_key"), "category_id", "iscrowd", *[F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate("xywh")])
    return rows.join(image_keys(table(spark, folder, "image_record", "image_id")), "image_key").drop("image_key")


SQL_ANNOTATIONS = (
    f"keys as (select {sql_key('image_id')} as k, min(image_id) as image_id from image_record where image_id is not null group by 1), "
    f"ann as (select annotation_id, keys.image_id, category_id, iscrowd, bbox[1] as x, bbox[2] as y, bbox[3] as w, bbox[4] as h from annotation a join keys on keys.k = {sql_key('a.image_id')})"
)


def boxes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(targets, predictions) read off lineitem: returned lines are targets, an order is an image."""
    line = table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    made = line.select(
        F.col("l_orderkey").alias("image"), F.concat_ws("-", "l_linenumber", "l_partkey", F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("box"),
        (F.col("l_extendedprice") / 120000).alias("conf"), F.col("l_quantity").alias("x1"), (F.col("l_discount") * 100).alias("y1"),
        (F.col("l_quantity") + 10 + F.col("l_linenumber")).alias("x2"), (F.col("l_discount") * 100 + 5 + F.col("l_tax") * 100).alias("y2"), "l_returnflag",
    )
    return made.where("l_returnflag = 'R'").drop("l_returnflag", "conf"), made.where("l_returnflag <> 'R'").drop("l_returnflag")


SQL_BOXES = (
    "bx as (select l_orderkey as image, l_linenumber || '-' || l_partkey || '-' || round(l_extendedprice * 100)::bigint as box, l_extendedprice / 120000 as conf, l_quantity::double as x1, "
    "l_discount * 100 as y1, (l_quantity + 10 + l_linenumber)::double as x2, l_discount * 100 + 5 + l_tax * 100 as y2, l_returnflag from lineitem), "
    "tg as (select image, box, x1, y1, x2, y2 from bx where l_returnflag = 'R'), pr as (select image, box, conf, x1, y1, x2, y2 from bx where l_returnflag <> 'R')"
)


def sql_iou(a: str, b: str) -> str:
    cut = lambda lo, hi: f"greatest(least({a}.{hi}, {b}.{hi}) - greatest({a}.{lo}, {b}.{lo}), 0)"
    inter = f"({cut('x1', 'x2')} * {cut('y1', 'y2')})"
    area = lambda s: f"greatest({s}.x2 - {s}.x1, 0) * greatest({s}.y2 - {s}.y1, 0)"
    return f"(case when {area(a)} + {area(b)} - {inter} > 0 then {inter} / ({area(a)} + {area(b)} - {inter}) else 0 end)"


SQL_MATCH = (
    "om as (select *, row_number() over (partition by image order by conf desc, box) as rn from pr), tl as (select image, list({'box': box, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2} order by box) as ts from tg group by image), "
    "mst(image, rn, used, box, conf, target, iou) as ("
    "select om.image, 0::bigint, []::varchar[], null::varchar, null::double, null::varchar, null::double from om where rn = 1 "
    "union all select image, rn, case when m >= 0.5 then list_append(used, tb) else used end, box, conf, case when m >= 0.5 then tb end, case when m >= 0.5 then m end from ("
    "select image, rn, used, box, conf, list_max(ious) as m, ts[list_position(ious, list_max(ious))].box as tb from ("
    "select o.image, o.rn, s.used, o.box, o.conf, ts, list_transform(ts, lambda t: case when list_contains(s.used, t.box) then -1 else "
    + sql_iou("t", "o")
    + " end) as ious from mst s join om o on o.image = s.image and o.rn = s.rn + 1 left join tl on tl.image = o.image)))"
    ", mt as (select image, box, conf, target, iou from mst where rn > 0)"
)
SQL_COUNTS = (
    "cnt as (select image, coalesce(gt, 0) as ground_truth_instances, coalesce(pred, 0) as predictions, coalesce(hit, 0) as tp, coalesce(pred, 0) - coalesce(hit, 0) as fp, coalesce(gt, 0) - coalesce(hit, 0) as fn, max_confidence "
    "from (select image, count(*) as gt from tg group by image) full join (select image, count(*) as pred, count(target) as hit, max(conf) as max_confidence from mt group by image) using (image))"
)


def matches(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(targets, predictions, matches at IoU 0.5)."""
    from ..operators.boxes import match

    targets, predictions = boxes(spark, folder)
    return targets, predictions, match(targets, predictions)


def fused_images(spark: SparkSession, folder: str) -> DataFrame:
    """(image, label, classifier_probability, classifier_positive, detector columns...) per order.

    Strict 1:1: orders are the images; those without lines have no boxes.
    """
    from ..operators.boxes import image_counts

    targets, predictions, matched = matches(spark, folder)
    counts = image_counts(targets, predictions, matched)
    orders = table(spark, folder, "orders", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority").select(
        F.col("o_orderkey").alias("image"), (F.col("o_orderstatus") == "F").cast("int").alias("label"), F.least(F.col("o_totalprice") / 500000, F.lit(1.0)).alias("classifier_probability"),
        F.col("o_orderpriority").alias("anatomy"), F.col("o_orderstatus").alias("view"),
    )
    zero = F.lit(0)
    return (
        orders.join(counts, "image", "left")
        .select("image", "label", "classifier_probability", "anatomy", "view", *[F.coalesce(c, zero).alias(c) for c in ("ground_truth_instances", "predictions", "tp", "fp", "fn")], "max_confidence")
        .withColumn("classifier_positive", (F.col("classifier_probability") >= 0.35).cast("int"))
        .withColumn("detector_positive", (F.col("predictions") > 0).cast("int"))
    )


SQL_FUSED = (
    "fu as (select o_orderkey as image, (o_orderstatus = 'F')::int as label, least(o_totalprice / 500000, 1.0)::double as classifier_probability, o_orderpriority as anatomy, o_orderstatus as view, "
    "coalesce(ground_truth_instances, 0) as ground_truth_instances, coalesce(predictions, 0) as predictions, coalesce(tp, 0) as tp, coalesce(fp, 0) as fp, coalesce(fn, 0) as fn, max_confidence, "
    "(o_totalprice / 500000 >= 0.35)::int as classifier_positive, (coalesce(predictions, 0) > 0)::int as detector_positive from orders left join cnt on cnt.image = o_orderkey)"
)
SQL_FUSED_ALL = f"with recursive {SQL_BOXES}, {SQL_MATCH}, {SQL_COUNTS}, {SQL_FUSED}"
