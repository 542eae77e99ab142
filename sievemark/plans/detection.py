"""Queries on detector boxes and on the two models together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import boxes as bx
from ..operators.ordered import numbered
from ..operators.ranking import confusion
from ..sources.tables import table
from ..storage import Workspace
from . import views
from .catalogue import query
from .views import SQL_BOXES, SQL_COUNTS, SQL_FUSED_ALL, SQL_MATCH, sql_iou

WITH = f"with {SQL_BOXES} "
MATCHED = f"with recursive {SQL_BOXES}, {SQL_MATCH}, {SQL_COUNTS} "
MEDIUM, HIGH = 0.30314465408805, 0.40748427672956
GRID = [0.01 + i * (0.80 - 0.01) / 159 for i in range(160)]


@query("iou_pairs", WITH + f"select tg.image, tg.box as target, pr.box as prediction, {sql_iou('tg', 'pr')} as iou from tg join pr on tg.image = pr.image")
def iou_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """IoU of every target with every prediction of its image."""
    targets, predictions = views.boxes(spark, folder)
    t = targets.select("image", F.col("box").alias("target"), *[F.col(c).alias(f"t_{c}") for c in bx.CORNERS])
    p = predictions.select("image", F.col("box").alias("prediction"), *[F.col(c).alias(f"p_{c}") for c in bx.CORNERS])
    return t.join(p, "image").select("image", "target", "prediction", scalar.iou("t_", "p_").alias("iou"))


_PAIRS = f"op as (select a.image, {sql_iou('a', 'b')} as iou from pr a join pr b on a.image = b.image and a.box < b.box)"


@query("overlap_counts", WITH + f", {_PAIRS}, per as (select image, count(*) as boxes from pr group by 1), ov as (select image, count(*) filter (iou >= 0.3::double) as n30, count(*) filter (iou >= 0.5::double) as n50, count(*) filter (iou >= 0.7::double) as n70 from op group by 1) select count(*) as images_with_predictions, count(*) filter (boxes > 1) as multi_prediction_images, max(boxes) as maximum_boxes, coalesce(sum(n30), 0)::bigint as pairs_30, coalesce(sum(n50), 0)::bigint as pairs_50, coalesce(sum(n70), 0)::bigint as pairs_70, count(*) filter (n30 > 0) as images_30, count(*) filter (n50 > 0) as images_50, count(*) filter (n70 > 0) as images_70 from per left join ov using (image)")
def overlap_counts(spark: SparkSession, folder: str) -> DataFrame:
    _, predictions = views.boxes(spark, folder)
    a = predictions.select("image", F.col("box").alias("ba"), *[F.col(c).alias(f"a_{c}") for c in bx.CORNERS])
    b = predictions.select("image", F.col("box").alias("bb"), *[F.col(c).alias(f"b_{c}") for c in bx.CORNERS])
    pairs = a.join(b, "image").where("ba < bb").select("image", scalar.iou("a_", "b_").alias("iou"))
    levels = {"30": 0.3, "50": 0.5, "70": 0.7}
    over = pairs.groupBy("image").agg(*[F.count_if(F.col("iou") >= v).alias(f"n{k}") for k, v in levels.items()])
    per = predictions.groupBy("image").agg(F.count("*").alias("boxes")).join(over, "image", "left")
    zero = F.lit(0)
    return per.agg(
        F.count("*").alias("images_with_predictions"), F.count_if(F.col("boxes") > 1).alias("multi_prediction_images"), F.max("boxes").alias("maximum_boxes"),
        *[F.coalesce(F.sum(f"n{k}"), zero).alias(f"pairs_{k}") for k in levels], *[F.count_if(F.col(f"n{k}") > 0).alias(f"images_{k}") for k in levels],
    )


def _sql_nms(limit: str, name: str = "") -> str:
    return (
        f"ob{name} as (select *, row_number() over (partition by image order by conf desc, box) as rn from pr), "
        f"ns{name}(image, rn, kept) as (select image, rn, [{{'box': box, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] from ob{name} where rn = 1 union all "
        f"select o.image, o.rn, case when len(list_filter(s.kept, lambda k: {sql_iou('k', 'o')} > {limit})) = 0 then list_append(s.kept, {{'box': o.box, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}}) else s.kept end from ns{name} s join ob{name} o on o.image = s.image and o.rn = s.rn + 1), "
        f"nk{name} as (select image, unnest(kept).box as box from (select image, arg_max(kept, rn) as kept from ns{name} group by image))"
    )


@query("nms", f"with recursive {SQL_BOXES}, {_sql_nms('0.5::double')} select image, box from nk")
def nms(spark: SparkSession, folder: str) -> DataFrame:
    _, predictions = views.boxes(spark, folder)
    return bx.suppress(predictions, 0.5).select("image", "box")


CANDIDATES = (0.3, 0.4, 0.5, 0.6, 0.7)
_RATIO = "tp / greatest(1, tp + fp) as precision, tp / greatest(1, tp + fn) as lesion_sensitivity, 2 * (tp / greatest(1, tp + fp)) * (tp / greatest(1, tp + fn)) / greatest(tp / greatest(1, tp + fp) + tp / greatest(1, tp + fn), 1e-12::double) as f1"


_SWEEP = ", ".join(_sql_nms(f"{c}::double", f"_{round(c * 10)}") for c in CANDIDATES)


def _sql_sweep(limit: float) -> str:
    n = f"_{round(limit * 10)}"
    match_ = SQL_MATCH.replace("pr)", f"kp{n})", 1).replace("om as", f"om{n} as").replace("from om ", f"from om{n} ").replace("join om ", f"join om{n} ").replace("tl as", f"tl{n} as").replace("join tl ", f"join tl{n} ").replace("tl.image", f"tl{n}.image").replace("om.image", f"om{n}.image").replace("mst", f"mst{n}").replace("mt as", f"mt{n} as")
    counts = SQL_COUNTS.replace("from mt ", f"from mt{n} ").replace("cnt as", f"cnt{n} as")
    return f"kp{n} as (select pr.* from pr join nk{n} using (image, box)), {match_}, {counts}"


def _sql_row(limit: float) -> str:
    return (
        f"select {limit}::double as nms_iou, (select count(*) from pr) as boxes_before, (tp + fp)::bigint as boxes_after, ((select count(*) from pr) - tp - fp)::bigint as boxes_removed, tp, fp, fn, {_RATIO}, alarms / greatest(negative_images, 1) as negative_image_false_alarm_rate "
        f"from (select sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn, count(*) filter (ground_truth_instances = 0) as negative_images, count(*) filter (ground_truth_instances = 0 and fp > 0) as alarms from cnt_{round(limit * 10)})"
    )


@query("nms_sweep", f"with recursive {SQL_BOXES}, {_SWEEP}, " + ", ".join(map(_sql_sweep, CANDIDATES)) + " " + " union all ".join(map(_sql_row, CANDIDATES)))
def nms_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """What suppression at several IoU limits removes and does to the matching."""
    targets, predictions = views.boxes(spark, folder)
    per = bx.suppression_sweep(targets, predictions, list(CANDIDATES))
    clean, missed = F.col("ground_truth_instances") == 0, F.col("kept") > F.col("tp")
    sums = per.groupBy("nms_iou").agg(
        F.sum("boxes").alias("boxes_before"), F.sum("kept").alias("boxes_after"), (F.sum("boxes") - F.sum("kept")).alias("boxes_removed"), F.sum("tp").alias("tp"), (F.sum("kept") - F.sum("tp")).alias("fp"),
        (F.sum("ground_truth_instances") - F.sum("tp")).alias("fn"), (F.count_if(clean & missed) / F.greatest(F.count_if(clean), F.lit(1))).alias("negative_image_false_alarm_rate"),
    )
    precision, recall = scalar.safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), scalar.safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.select(
        "nms_iou", "boxes_before", "boxes_after", "boxes_removed", "tp", "fp", "fn", precision.alias("precision"), recall.alias("lesion_sensitivity"),
        (2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))).alias("f1"), "negative_image_false_alarm_rate",
    )


@query("greedy_match", MATCHED + "select image, box, target, iou from mt")
def greedy_match(spark: SparkSession, folder: str) -> DataFrame:
    return views.matches(spark, folder)[2].select("image", "box", "target", "iou")


@query("per_image_detection", MATCHED + "select * from cnt")
def per_image_detection(spark: SparkSession, folder: str) -> DataFrame:
    return bx.image_counts(*views.matches(spark, folder))


_SUM = "sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn, count(*) filter (ground_truth_instances = 0) as negative_images, coalesce(sum(fp) filter (ground_truth_instances = 0), 0)::bigint as false_positives_on_negative_images, count(*) filter (ground_truth_instances = 0 and fp > 0) as alarms"
_FULL = f"select tp, fp, fn, negative_images, false_positives_on_negative_images, {_RATIO}, false_positives_on_negative_images / greatest(negative_images, 1) as false_positives_per_negative_image, alarms / greatest(negative_images, 1) as negative_image_false_alarm_rate"


@query("detection_summary", MATCHED + f"{_FULL} from (select {_SUM} from cnt)")
def detection_summary(spark: SparkSession, folder: str) -> DataFrame:
    return bx.detection_summary(bx.image_counts(*views.matches(spark, folder)))


_CURVE = f"""{MATCHED}, th as (select 0.01::double + i * (0.80::double - 0.01::double) / 159 as threshold from range(160) r(i)),
    im as (select distinct image from tg union select distinct image from pr), ne as (select image from im where image not in (select image from tg)),
    cv as (select threshold, coalesce(count(target), 0) as tp, count(mt.image) - count(target) as fp, (select count(*) from tg) - count(target) as fn, (select count(*) from ne) as negative_images,
        count(ne.image) as false_positives_on_negative_images, count(distinct ne.image) as alarms from th left join mt on mt.conf >= threshold left join ne on ne.image = mt.image group by 1)"""


def _curve(spark: SparkSession, folder: str) -> DataFrame:
    targets, predictions, matched = views.matches(spark, folder)
    matched = Workspace(spark, "sweep").keep(matched, "matches")
    images = targets.select("image").union(predictions.select("image"))
    return bx.sweep(targets, matched, images, GRID)


@query("threshold_sweep", _CURVE + f" {_FULL.replace('select tp', 'select round(threshold, 9) as threshold, tp')} from cv")
def threshold_sweep(spark: SparkSession, folder: str) -> DataFrame:
    return _curve(spark, folder).withColumn("threshold", F.round("threshold", 9))


@query("select_threshold", _CURVE + f" select threshold, tp, fp, fn, f1 from ({_FULL.replace('select tp', 'select threshold, tp')} from cv) order by f1 desc, false_positives_per_negative_image, threshold limit 1")
def select_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return bx.select_threshold(_curve(spark, folder)).select("threshold", "tp", "fp", "fn", "f1")


@query("froc", MATCHED + "select conf, (sum(h) over w / (select count(*) from tg)) as sensitivity, (sum(m) over w / (select count(distinct image) from (select image from tg union select image from pr))) as false_positives_per_image from (select conf, count(target) as h, count(*) filter (target is null) as m from mt group by 1) window w as (order by conf desc)")
def froc(spark: SparkSession, folder: str) -> DataFrame:
    targets, predictions, matched = views.matches(spark, folder)
    ws = Workspace(spark, "froc")
    return bx.froc(targets, ws.keep(matched, "matches"), targets.select("image").union(predictions.select("image")), ws)


@query("confidence_tier", WITH + f"select image, box, conf, case when conf < 0 or conf > 1 then null when conf >= {HIGH}::double then 'high' when conf >= {MEDIUM}::double then 'medium' else 'low' end as tier from pr")
def confidence_tier(spark: SparkSession, folder: str) -> DataFrame:
    _, predictions = views.boxes(spark, folder)
    return predictions.select("image", "box", "conf", scalar.confidence_tier(F.col("conf"), MEDIUM, HIGH).alias("tier"))


_TIER = f"case when conf >= {HIGH}::double then 'high' when conf >= {MEDIUM}::double then 'medium' else 'low' end"


@query("image_tier", WITH + f"select image, arg_max({_TIER}, (conf, box)) as tier, max(conf) as max_confidence from pr where conf between 0 and 1 group by 1")
def image_tier(spark: SparkSession, folder: str) -> DataFrame:
    """The tier of an image's most confident box."""
    rows = confidence_tier(spark, folder).where("tier is not null")
    return rows.groupBy("image").agg(F.max_by("tier", F.struct("conf", "box")).alias("tier"), F.max("conf").alias("max_confidence"))


_DECISION = """select image, classifier_positive = 1 as classifier_positive, predictions > 0 as local_evidence, classifier_positive = 1 or predictions > 0 as triage_positive, classifier_positive = 1 and predictions > 0 as strict_positive,
    (classifier_positive = 1) = (predictions > 0) as agreement, (classifier_positive = 1) <> (predictions > 0) as review_required,
    case when classifier_positive = 1 and predictions > 0 then 'fracture_signal_with_local_evidence' when classifier_positive = 0 and predictions = 0 then 'no_fracture_signal' when classifier_positive = 1 then 'global_signal_without_local_evidence' else 'local_evidence_without_global_signal' end as status from fu"""


@query("fusion_decision", SQL_FUSED_ALL + f" {_DECISION}")
def fusion_decision(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.fused_images(spark, folder)
    made = scalar.fused(F.col("classifier_positive") == 1, F.col("predictions"))
    return rows.select("image", (F.col("classifier_positive") == 1).alias("classifier_positive"), *[v.alias(k) for k, v in made.items()])


_CONF = "count(*) as n, count(*) filter (label = 1 and p = 1) as tp, count(*) filter (label = 0 and p = 0) as tn, count(*) filter (label = 0 and p = 1) as fp, count(*) filter (label = 1 and p = 0) as fn"
_CONFR = "n, tp, tn, fp, fn, (tp + tn) / greatest(n, 1) as accuracy, tp / greatest(tp + fn, 1) as sensitivity, tn / greatest(tn + fp, 1) as specificity, (tp / greatest(tp + fn, 1) + tn / greatest(tn + fp, 1)) / 2 as balanced_accuracy"
_POLICIES = "pol as (select 'classifier' as policy, label, classifier_positive as p from fu union all select 'detector', label, detector_positive from fu union all select 'or', label, greatest(classifier_positive, detector_positive) from fu union all select 'and', label, least(classifier_positive, detector_positive) from fu)"


@query("fusion_confusions", SQL_FUSED_ALL + f", {_POLICIES} select policy, {_CONFR} from (select policy, {_CONF} from pol group by 1)")
def fusion_confusions(spark: SparkSession, folder: str) -> DataFrame:
    """Confusion counts of the single and combined decisions, in one pass over a long form."""
    c, d = F.col("classifier_positive"), F.col("detector_positive")
    policies = {"classifier": c, "detector": d, "or": F.greatest(c, d), "and": F.least(c, d)}
    long = views.fused_images(spark, folder).select("label", F.inline(F.array(*[F.struct(F.lit(k).alias("policy"), v.alias("p")) for k, v in policies.items()])))
    return confusion(long, "label", "p", ("policy",))


@query("consensus_only", SQL_FUSED_ALL + f", ag as (select label, classifier_positive as p from fu where classifier_positive = detector_positive) select {_CONFR}, n / (select count(*) from fu) as coverage, 1 - n / (select count(*) from fu) as abstention_rate, (select count(*) from fu where classifier_positive = 1 and detector_positive = 0) as global_only, (select count(*) from fu where classifier_positive = 0 and detector_positive = 1) as local_only from (select {_CONF} from ag)")
def consensus_only(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics where both models agree, with coverage and abstention, as one conditional aggregation."""
    c, d, y = F.col("classifier_positive"), F.col("detector_positive"), F.col("label")
    agree = c == d
    one = F.lit(1)
    sums = views.fused_images(spark, folder).agg(
        F.count("*").alias("_all"), F.count_if(agree).alias("n"), F.count_if(agree & (y == 1) & (c == 1)).alias("tp"), F.count_if(agree & (y == 0) & (c == 0)).alias("tn"),
        F.count_if(agree & (y == 0) & (c == 1)).alias("fp"), F.count_if(agree & (y == 1) & (c == 0)).alias("fn"), F.count_if((c == 1) & (d == 0)).alias("global_only"), F.count_if((c == 0) & (d == 1)).alias("local_only"),
    )
    sensitivity, specificity = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), one), F.col("tn") / F.greatest(F.col("tn") + F.col("fp"), one)
    return sums.select(
        "n", "tp", "tn", "fp", "fn", ((F.col("tp") + F.col("tn")) / F.greatest("n", one)).alias("accuracy"), sensitivity.alias("sensitivity"), specificity.alias("specificity"), ((sensitivity + specificity) / 2).alias("balanced_accuracy"),
        F.try_divide("n", "_all").alias("coverage"), (1 - F.try_divide("n", "_all")).alias("abstention_rate"), "global_only", "local_only",
    )


@query("gated_detection", SQL_FUSED_ALL + ", g as (select coalesce(sum(tp) filter (classifier_positive = 1), 0)::bigint as tp, coalesce(sum(fp) filter (classifier_positive = 1), 0)::bigint as fp, (sum(ground_truth_instances) - coalesce(sum(tp) filter (classifier_positive = 1), 0))::bigint as fn from fu) select tp, fp, fn, tp / greatest(1, tp + fp) as precision, tp / greatest(1, tp + fn) as lesion_sensitivity from g")
def gated_detection(spark: SparkSession, folder: str) -> DataFrame:
    """Detections that count only where the classifier is positive."""
    gate = F.col("classifier_positive") == 1
    kept = lambda c: F.coalesce(F.sum(F.when(gate, F.col(c))), F.lit(0))
    sums = views.fused_images(spark, folder).agg(kept("tp").alias("tp"), kept("fp").alias("fp"), F.coalesce(F.sum("ground_truth_instances"), F.lit(0)).alias("gt")).withColumn("fn", F.col("gt") - F.col("tp"))
    return sums.select("tp", "fp", "fn", scalar.safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), scalar.safe_ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("lesion_sensitivity"))


_CAT = "case when label = 1 and classifier_positive = 1 and detector_positive = 1 then 'consensus_true_positive' when label = 1 and classifier_positive = 1 then 'detector_miss_classifier_rescue' when label = 1 and detector_positive = 1 then 'classifier_miss_detector_rescue' when label = 1 then 'both_miss' when classifier_positive = 1 and detector_positive = 1 then 'both_false_alarm' when classifier_positive = 1 then 'classifier_only_false_alarm' when detector_positive = 1 then 'detector_only_false_alarm' else 'consensus_true_negative' end"


def _categorised(spark: SparkSession, folder: str) -> DataFrame:
    return views.fused_images(spark, folder).withColumn("category", scalar.error_category(F.col("label"), F.col("classifier_positive"), F.col("detector_positive")))


@query("error_taxonomy", SQL_FUSED_ALL + f" select {_CAT} as category, count(*) as images from fu group by 1")
def error_taxonomy(spark: SparkSession, folder: str) -> DataFrame:
    return _categorised(spark, folder).groupBy("category").agg(F.count("*").alias("images"))


_KEY = "case when category in ('classifier_miss_detector_rescue', 'detector_only_false_alarm', 'both_false_alarm') then coalesce(max_confidence, 0) when category = 'both_miss' then -classifier_probability else classifier_probability end"
CATEGORIES = ("classifier_miss_detector_rescue", "detector_miss_classifier_rescue", "both_miss", "both_false_alarm", "classifier_only_false_alarm", "detector_only_false_alarm", "consensus_true_positive")


@query("error_gallery_topk", SQL_FUSED_ALL + f" select category, image, rank_score, place from (select category, image, {_KEY} as rank_score, row_number() over (partition by category order by {_KEY} desc, image) as place from (select *, {_CAT} as category from fu)) where place <= 8 and category <> 'consensus_true_negative'")
def error_gallery_topk(spark: SparkSession, folder: str, examples: int = 8) -> DataFrame:
    """The top examples of each category: per category a bounded top-k, so no group is sorted whole."""
    rows = Workspace(spark, "gallery").keep(_categorised(spark, folder).select("category", "image", scalar.category_rank(F.col("category"), F.col("classifier_probability"), F.col("max_confidence")).alias("rank_score")), "ranked")
    tops = [rows.where(F.col("category") == c).orderBy(F.col("rank_score").desc(), "image").limit(examples) for c in CATEGORIES]
    out = tops[0]
    for t in tops[1:]:
        out = out.union(t)
    return out.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy(F.col("rank_score").desc(), "image")))


@query("group_error_summary", SQL_FUSED_ALL + """, lg as (select 'anatomy' as "group", anatomy as value, * from fu union all select 'view', view, * from fu) select "group", value, count(*) as images, sum(ground_truth_instances)::bigint as gt, sum(predictions)::bigint as pred, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn, sum(tp) / greatest(1, sum(tp) + sum(fp)) as precision, sum(tp) / greatest(1, sum(tp) + sum(fn)) as recall from lg group by 1, 2""")
def group_error_summary(spark: SparkSession, folder: str) -> DataFrame:
    fields = F.array(*[F.struct(F.lit(f).alias("group"), F.col(f).alias("value")) for f in ("anatomy", "view")])
    long = views.fused_images(spark, folder).select(F.inline(fields), "ground_truth_instances", "predictions", "tp", "fp", "fn")
    sums = long.groupBy("group", "value").agg(F.count("*").alias("images"), F.sum("ground_truth_instances").alias("gt"), F.sum("predictions").alias("pred"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    return sums.withColumn("precision", scalar.safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", scalar.safe_ratio(F.col("tp"), F.col("tp") + F.col("fn")))


_RANKED = """, lg as (select 'anatomy' as "group", anatomy as value, * from fu union all select 'view', view, * from fu), gs as (select "group", value, sum(ground_truth_instances)::bigint as gt, sum(tp) / greatest(1, sum(tp) + sum(fn)) as recall from lg group by 1, 2)
    select "group", value, gt, recall, row_number() over (partition by "group" order by recall, gt desc, value) as place from gs"""


@query("group_error_ranking", SQL_FUSED_ALL + _RANKED)
def group_error_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Values of each field from the worst recall on, then by falling number of targets, then by name."""
    sums = group_error_summary(spark, folder).select("group", "value", "gt", "recall")
    return numbered(sums, Workspace(spark, "grouprank"), [F.col("recall"), F.col("gt").desc(), F.col("value")], "place", ("group",))


@query("worst_images", SQL_FUSED_ALL + " select image, fn, fp from fu order by fn desc, fp desc, image limit 20")
def worst_images(spark: SparkSession, folder: str) -> DataFrame:
    return views.fused_images(spark, folder).select("image", "fn", "fp").orderBy(F.col("fn").desc(), F.col("fp").desc(), "image").limit(20)


@query("tier_cutoffs", _CURVE + " select 0.70::double as precision_floor, min(threshold) as cutoff from (select threshold, tp / greatest(1, tp + fp) as precision from cv) where precision >= 0.70 union all select 0.05::double, min(threshold) from (select threshold, tp / greatest(1, tp + fp) as precision from cv) where precision >= 0.05")
def tier_cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    """The first threshold of the sweep whose precision reaches a floor."""
    curve = _curve(spark, folder)
    parts = [curve.where(F.col("precision") >= f).agg(F.min("threshold").alias("cutoff")).select(F.lit(f).alias("precision_floor"), "cutoff") for f in (0.70, 0.05)]
    return parts[0].union(parts[1])


@query("membership_differences", WITH + "select 'orders_only' as side, count(*) as images from orders where o_orderkey not in (select image from bx) union all select 'boxes_only', count(*) from (select distinct image from bx where image not in (select o_orderkey from orders))")
def membership_differences(spark: SparkSession, folder: str) -> DataFrame:
    """Images that only one of two relations has."""
    orders = table(spark, folder, "orders", "o_orderkey").select(F.col("o_orderkey").alias("image"))
    lines = table(spark, folder, "lineitem", "l_orderkey").select(F.col("l_orderkey").alias("image")).distinct()
    only = lambda a, b, n: a.join(b, "image", "left_anti").agg(F.count("*").alias("images")).select(F.lit(n).alias("side"), "images")
    return only(orders, lines, "orders_only").union(only(lines, orders, "boxes_only"))
